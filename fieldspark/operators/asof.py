"""Nearest-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_ms: int, left_ms: str, right_ms: str, left_id: str, right_id: str) -> DataFrame:
    """Each left row with the right row of least time difference within the tolerance.

    Time is cut into buckets as long as the tolerance; a right row also goes to the buckets
    beside its own.  In a bucket all rows are sorted once each way, and a left row takes the
    last right row before it or the first after it: no pairs are formed.  Ties go to the
    earlier right row, then to its smaller id.
    """
    at_instant = Window.partitionBy(right_ms).orderBy(right_id)
    one = right.withColumn("_n", F.row_number().over(at_instant)).filter("_n = 1").drop("_n")  # of equal instants only the smallest id can win
    sides = [F.struct(*d.columns).alias(n) for d, n in ((left, "l"), (one, "r"))]
    none = [F.lit(None).cast(d.select(s).schema[0].dataType).alias(n) for d, s, n in zip((left, one), sides, "lr", strict=True)]
    bucket = lambda ms: F.floor(F.col(ms) / tolerance_ms)
    rows = left.select(bucket(left_ms).alias("b"), F.col(left_ms).alias("t"), sides[0], none[1]).unionByName(
        one.select(F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: bucket(right_ms) + d)).alias("b"), F.col(right_ms).alias("t"), none[0], sides[1])
    )
    by = Window.partitionBy("b")
    before = F.last("r", True).over(by.orderBy("t", F.col("l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("r", True).over(by.orderBy(F.desc("t"), F.col("l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select("l", "t", before.alias("p"), after.alias("q")).filter(F.col("l").isNotNull())
    gap = lambda side: F.coalesce(F.abs(F.col("t") - F.col(f"{side}.{right_ms}")), F.lit(1 << 62))
    best = found.select("l", F.least(gap("p"), gap("q")).alias("dt_ms"), F.when(gap("p") <= gap("q"), F.col("p")).otherwise(F.col("q")).alias("r"))
    return best.filter(F.col("dt_ms") <= tolerance_ms).select("l.*", "r.*", "dt_ms")
