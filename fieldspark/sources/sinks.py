"""Writers: CSV with flat columns, result sets of a replay, products by partition."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import building_height_m, building_material

NESTED = (T.ArrayType, T.MapType, T.StructType)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; nested columns become JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f.name) for f in df.schema]
    df.select(flat).write.mode("overwrite").option("header", True).csv(path)


def write_matched(df: DataFrame, path: str) -> None:
    """Matched rows without velocities and weights."""
    write_csv(df.drop(*[n for n in df.columns if n.startswith("v_")], "mrc_weights"), path)


def write_replay(positions: DataFrame, estimate: DataFrame, summary: DataFrame, folder: str) -> None:
    """Ranked positions as CSV, the estimate and the summary as JSON."""
    write_csv(positions, f"{folder}/positions")
    estimate.write.mode("overwrite").json(f"{folder}/estimate")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def write_analysis(telemetry: DataFrame, motion: DataFrame, quality: DataFrame, statistics: DataFrame, folder: str) -> None:
    """The set of an analysis: three CSV tables and the statistics as JSON."""
    for part, name in ((telemetry, "telemetry"), (motion, "motion"), (quality, "quality")):
        write_csv(part, f"{folder}/{name}")
    statistics.write.mode("overwrite").json(f"{folder}/statistics")


def write_velocities(df: DataFrame, path: str) -> None:
    """History of velocities: time, velocity and offset."""
    write_csv(df.select("timestamp_ms", "velocity_mps", "cfo_est"), path)


#: Columns of a sensing product, in their order.
PRODUCT = (
    "latitude_deg", "longitude_deg", "z_ground_m", "tx_range_m", "rx_range_m", "excess_delay_s", "angle_deg", "doppler_east", "doppler_north", "doppler_up", "doppler_hz", "sensitivity", "min_speed_mps",
    "echo_dbm", "snr_db", "margin_db", "direct_margin_db", "cancellation_db", "dynamic_margin_db", "power_margin_db", "min_rcs_m2", "return_loss_db", "failure", "screening", "qualified",
)


def as_product(df: DataFrame, product_id: str) -> DataFrame:
    """The product's columns that the table has, in order."""
    return df.select(F.lit(product_id).alias("product_id"), *[n for n in PRODUCT if n in df.columns])


def build_region(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (source_id, kind, tags, ring): features once by (id, kind, ring), with their box, height and material; and counts by kind, skipped ones included."""
    lon, lat = (F.transform("ring", lambda p: p[i]) for i in (0, 1))  # noqa: B023
    good = features.filter(F.col("kind").isin("building", "landuse") & (F.size("ring") >= 4))
    once = good.dropDuplicates(["source_id", "kind", "ring"])
    held = once.select("*", F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"), building_height_m(F.col("tags")).alias("height_m"), building_material(F.col("tags")).alias("material"))
    kinds = features.select(F.when(F.col("kind").isin("building", "landuse") & (F.size("ring") >= 4), F.col("kind")).otherwise("skipped").alias("kind"))
    return held, kinds.groupBy("kind").agg(F.count("*").alias("n"))


def write_profiles(df: DataFrame, folder: str) -> None:
    """Profiles by their key; those of a key that comes again are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile_key").parquet(folder)


def write_product(df: DataFrame, metadata: DataFrame, folder: str) -> None:
    """A product's points by product_id, layers as floats, its metadata and its manifest; other products in the folder stay.

    All parts go to a folder of a new version; then one small file, renamed into place, tells readers which version each
    product has.  Whatever fails before that leaves the products as they were.
    """
    if df.select("product_id").distinct().join(metadata, "product_id", "left_anti").limit(1).count():
        raise ValueError("a product without metadata")
    layers = [F.col(f.name).cast("float").alias(f.name) if f.dataType == T.DoubleType() and not f.name.endswith("_deg") else F.col(f.name) for f in df.schema]
    points, version = df.select(layers), uuid.uuid4().hex
    for part, name in ((points, "points"), (metadata, "metadata"), (manifest(points), "manifest")):
        part.write.partitionBy("product_id").parquet(f"{folder}/versions/{version}/{name}")
    spark = df.sparkSession
    new = {str(r[0]): version for r in spark.read.parquet(f"{folder}/versions/{version}/manifest").select("product_id").collect()}
    switch(spark, folder, versions_of(spark, folder) | new)


def versions_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """The version of each product in a folder (one line a product: the file of this name, or none)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    return {r["product_id"]: r["version"] for r in spark.read.schema("product_id string, version string").json(f"{folder}/current").collect()}


def product_part(spark: SparkSession, folder: str, name: str, product_id: str | None = None) -> DataFrame:
    """The points, metadata or manifest of all products of a folder, or of one, each of its version."""
    asked = {p: v for p, v in versions_of(spark, folder).items() if product_id is None or str(product_id) == p}
    if not asked:
        raise ValueError(f"no such product: {product_id}")
    parts = []
    for version in sorted(set(asked.values())):
        rows = spark.read.parquet(f"{folder}/versions/{version}/{name}")
        # what a later version has replaced is left out
        parts.append(rows.filter(F.col("product_id").cast("string").isin([p for p, v in asked.items() if v == version])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def switch(spark: SparkSession, folder: str, versions: dict[str, str]) -> None:
    """Replaces the file of versions by a new one in one step."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft, at = path(f"{folder}/.current-{uuid.uuid4().hex}"), path(f"{folder}/current")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray("".join(json.dumps({"product_id": p, "version": v}) + "\n" for p, v in sorted(versions.items())).encode()))
    out.close()
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context.rename(draft, at, options)


def manifest(df: DataFrame) -> DataFrame:
    """Rows of each product, and its layers with their types."""
    layers = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema if f.name != "product_id"])
    return df.groupBy("product_id").agg(F.count("*").alias("n")).withColumn("layers", layers)


def lacking(present: DataFrame, required: list[str], name: str = "name") -> DataFrame:
    """Required members that a table of names doesn't hold."""
    return present.sparkSession.createDataFrame([(n,) for n in required], f"{name} string").join(present.select(name), name, "left_anti")


def audit_product(df: DataFrame, required: list[str]) -> DataFrame:
    """One row for each required column: whether it is there and numeric, and how many rows lack it."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema}
    counts = [F.count_if(F.col(n).isNull()).alias(n) if n in kinds else F.lit(None).cast("long").alias(n) for n in required]
    row = df.agg(*counts)
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n in kinds).alias("present"), F.lit(kinds.get(n, False)).alias("numeric"), F.col(n).alias("missing")) for n in required])
    return row.select(F.explode(each).alias("x")).select("x.*")


def latest(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """An upsert that keeps the row of the latest stamp for each key; of equal stamps the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    whole = F.struct(*old.columns)
    return both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(whole, F.struct(stamp, "_new")).alias("x")).select("x.*")


def purged(df: DataFrame, oldest: int, stamp: str) -> DataFrame:
    return df.filter(F.col(stamp) >= oldest)


def missing_rows(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not held yet."""
    return wanted.join(held.select(*keys), keys, "left_anti")
