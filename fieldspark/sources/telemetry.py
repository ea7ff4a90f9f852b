"""Readers of measurement and map files; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import arfcn_mhz, other_tags
from .sinks import product_part

MISSING_DB = -999.0
_WHOLE = ("timestamp_ms", "timing_measurement_timestamp_ms", "dl_carrier_freq", "sample_rate")
_SMALL = ("pci", "ssb_index", "subcarrier_spacing", "frame_number_lsb4", "half_frame_bit", "decoder_state", "nb_antennas_rx", "effective_antennas")
_REAL = ("latitude", "longitude", "altitude", "sample_offset", "timing_offset", "initial_timing_offset_us", "current_timing_offset_us", "delay_samples", "checksum", "freq_offset_hz", "cfo_est", "llr_energy", "delay_us")
_LISTS = ("channel_level_db", "mrc_weights", "antenna_quality")
TELEMETRY = T.StructType(
    [T.StructField(n, T.LongType()) for n in _WHOLE]
    + [T.StructField(n, T.IntegerType()) for n in _SMALL]
    + [T.StructField(n, T.DoubleType()) for n in _REAL]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in _LISTS]
    + [T.StructField("tdd_pattern", T.MapType(T.StringType(), T.IntegerType())), T.StructField("cir_blob_path", T.StringType()), T.StructField("iso_timestamp", T.StringType())]
)
GPS = T.StructType([T.StructField("time", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("location.lat", "location.lon", "altitude", "velocity.x", "velocity.y", "velocity.z", "horizontal_accuracy", "vertical_accuracy"))])


def padded(values: Column, size: int = 2, fill: float = MISSING_DB) -> Column:
    """A list cut or filled to a fixed size; all fill where it is null."""
    given = F.coalesce(values, F.array().cast("array<double>"))
    return F.slice(F.concat(given, F.array_repeat(F.lit(fill), size)), 1, size)


def normalised(df: DataFrame) -> DataFrame:
    """Zero for missing numbers, lists of two, and an event time."""
    out = df.fillna(0)
    fills = {"channel_level_db": MISSING_DB, "mrc_weights": 0.0, "antenna_quality": 0.0}
    return out.withColumns({n: padded(F.col(n), fill=f) for n, f in fills.items()}).withColumn("timestamp", F.timestamp_millis("timestamp_ms"))


def read_telemetry(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON files that hold an array of records or one record; a bad file gives no rows, others stay."""
    schema = T.StructType([*TELEMETRY, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return normalised(raw.withColumn("file", F.col("_metadata.file_path")).filter(F.col("_corrupt").isNull()).drop("_corrupt"))


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header whose places are ``location.lat`` and ``location.lon`` or ``latitude`` and ``longitude``; times are UTC.

    Columns are matched by the header, so either kind and any order will do.
    """
    wanted = {f.name: f.dataType.simpleString() for f in GPS.fields} | {"latitude": "double", "longitude": "double"}
    header = spark.read.option("header", True).csv(path).columns  # reads the first line only
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in header)).option("header", True).csv(path)
    have = {n: F.col(f"`{n}`").try_cast(t) if n in header else F.lit(None).cast(t) for n, t in wanted.items()}
    out = raw.select(
        have["time"].alias("time"),
        F.coalesce(have["location.lat"], have["latitude"]).alias("latitude"),
        F.coalesce(have["location.lon"], have["longitude"]).alias("longitude"),
        *[have[n].alias(n.replace(".", "_")) for n in ("altitude", "velocity.x", "velocity.y", "velocity.z", "horizontal_accuracy", "vertical_accuracy")],
    )
    return out.withColumn("timestamp", F.try_to_timestamp("time")).withColumn("timestamp_ms", F.unix_millis("timestamp")).withColumn("speed_mps", F.sqrt(F.col("velocity_x") ** 2 + F.col("velocity_y") ** 2 + F.col("velocity_z") ** 2))


SITES = "pci int, longitude double, latitude double, arfcn int, azimuth_deg double, beamwidth_deg double, height_ft double, beamwidth_v_deg double, beamwidth_h_deg double, antenna_gain_dbi double, tx_power_dbm double, channel_bw_mhz double"


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A table of sites and sectors, with heights in metres and carriers in MHz."""
    return spark.read.schema(SITES).option("header", True).csv(path).withColumn("height_m", F.col("height_ft") * 0.3048).withColumn("freq_mhz", arfcn_mhz(F.col("arfcn")))


ELEMENTS = "elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of a query's JSON answer, one row for each kind (building, landuse) that an element is of; those of fewer than three points are left out."""
    e = spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*").filter(F.size("geometry") >= 3)
    has = lambda k: F.coalesce(F.map_contains_key("tags", k), F.lit(False))
    kinds = F.filter(F.array(F.when(has("building"), "building"), F.when(has("landuse") | has("natural"), "landuse")), lambda k: k.isNotNull())
    return e.withColumn("kind", F.explode(kinds))


PROFILES = "tx_lat double, tx_lon double, tx_height_m double, rx_height_m double, max_range_m double, dr_m double, dtheta_deg double, version string, profiles array<struct<bearing_deg:double,segments:array<struct<r0_m:double,r1_m:double,kind:string,material:string,osm_id:long>>,terrain_heights:array<struct<range_m:double,height_m:double>>>>"


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Obstacle intervals and terrain heights of profile sets by bearing; a bearing without any has a row of nulls."""
    raw = spark.read.schema(PROFILES).option("multiLine", True).json(path)
    p = raw.withColumn("p", F.explode_outer("profiles")).select("tx_lat", "tx_lon", "version", F.col("p.bearing_deg").alias("bearing_deg"), "p.segments", "p.terrain_heights")
    parts = [p.withColumn("x", F.explode_outer(n)).select("tx_lat", "tx_lon", "version", "bearing_deg", "x.*") for n in ("segments", "terrain_heights")]
    return parts[0], parts[1]


def read_product(spark: SparkSession, folder: str, columns: list[str], product_id: str | None = None) -> DataFrame:
    """The asked columns of stored products; only these, and only one product's partition, are read."""
    return product_part(spark, folder, "points", product_id).select("product_id", *columns)


GEOJSON = "type string, features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def merged(properties: Column) -> Column:
    """Properties that hold something, but for ids, over those packed in ``other_tags``."""
    own = F.map_filter(properties, lambda k, v: v.isNotNull() & (v != "") & ~k.isin("id", "osm_id", "osm_way_id", "other_tags"))
    packed = other_tags(F.coalesce(F.try_element_at(properties, F.lit("other_tags")), F.lit("")))
    return F.coalesce(F.map_concat(F.map_filter(packed, lambda k, v: ~F.map_contains_key(own, k)), own), F.create_map().cast("map<string,string>"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Collections, single features, or one feature a line (a record separator may lead): id, properties, ring (lon, lat pairs, closed)."""
    text = spark.read.option("wholetext", True).text(path)
    whole = text.select(F.explode(F.split(F.regexp_replace("value", "\x1e", ""), r"\n(?=\s*\{\s*\"type\"\s*:\s*\"Feature\")")).alias("j"))
    parsed = whole.select(F.from_json("j", GEOJSON).alias("x")).select("x.*")
    single = F.array(F.struct("id", "properties", "geometry"))
    feature = parsed.select(F.explode(F.when(F.col("features").isNotNull(), F.col("features")).otherwise(single)).alias("f")).select("f.*")
    ring = "array<array<double>>"
    rings = F.when(F.col("geometry.type") == "Polygon", F.slice(F.from_json("geometry.coordinates", f"array<{ring}>"), 1, 1)).when(F.col("geometry.type") == "MultiPolygon", F.transform(F.from_json("geometry.coordinates", f"array<array<{ring}>>"), lambda p: p[0]))
    out = feature.select(F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("properties")["osm_id"], F.col("properties")["id"]).alias("source_id"), merged(F.col("properties")).alias("tags"), F.explode(rings).alias("ring"))
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    return out.withColumn("ring", closed).filter(F.size("ring") >= 4)
