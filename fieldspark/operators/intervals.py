"""Samples along a bearing against intervals of obstacles on it, by a sweep of sorted events.

No pairs of samples and intervals are formed: an interval is a few events (it begins, it ends, what
lingers behind it lapses), a sample reads running sums of the events at or before it.  The sums are
carried over ranges of a bearing, so that a long bearing is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carried import running

#: An interval counts from this far before a sample on (metres).
SLACK_M = 1e-6


def lingering(width_m: Column, base_db: float, slope_db: float, cap_db: float) -> Column:
    """Loss of an exited interval right behind it: a base and a slope by width, to a cap."""
    return F.least(F.lit(cap_db), max(0.0, base_db) + max(0.0, slope_db) * width_m / 100)


def swept(samples: DataFrame, intervals: DataFrame, keys: list[str], interval_id: str, at: str = "distance_m", penetration: Column | None = None, losses: dict[str, tuple[float, float, float, float]] | None = None, recovery_db: float = 2.0, tell: tuple[str, ...] = ()) -> DataFrame:
    """Adds to each sample the state of its bearing's intervals (start_m, end_m) there.

    n_begun, n_exited, n_active (begun, not ended), penetration_db (sum of ``penetration`` of the
    active ones), first_start_m (the least start of those begun), first_active (start_m, id, end_m and ``tell`` of the
    active one of least start, then id), last_exit_m (the greatest end passed), and for each of ``losses`` (base, slope per 100 m of width, cap of one, cap of all) the sum over
    exited intervals of what is left after a recovery of recovery_db per 100 m of open way.
    An interval with end before start counts as ended at its end, of no width.
    """
    losses = losses or {}
    per_m = max(0.0, recovery_db) / 100
    width = F.greatest(F.lit(0.0), F.col("end_m") - F.col("start_m"))
    penetration = F.lit(0.0) if penetration is None else penetration
    # of the intervals by start, each that ends after all before it is the first active one from their last end on, until its own
    held = running(intervals, keys, ["start_m", interval_id], {"_end_before": ("max_before", F.col("end_m"))})
    lead = F.struct(F.col("start_m").cast("double").alias("start_m"), F.col(interval_id).alias("id"), F.col("end_m").cast("double").alias("end_m"), *tell)
    none = {"begun": F.lit(0), "exited": F.lit(0), "pen": F.lit(0.0), "first": F.lit(None).cast("double"), "last": F.lit(None).cast("double"), "lead": F.lit(None).cast(held.select(lead.alias("x")).schema["x"].dataType)}
    for name in losses:
        none |= {f"a_{name}": F.lit(0.0), f"b_{name}": F.lit(0)}

    def event(place: Column, **own: Column) -> Column:
        return F.struct(place.alias("place"), *[v.alias(k) for k, v in (none | own).items()])

    begins = event(F.col("start_m"), begun=F.lit(1), pen=penetration, first=F.col("start_m").cast("double"))
    leads = event(F.greatest("start_m", "_end_before"), lead=F.when(F.col("end_m") > F.greatest("start_m", "_end_before"), lead))
    left, lapses = {}, []
    for name, (base, slope, cap, _) in losses.items():
        loss = lingering(width, base, slope, cap)
        # behind the end: loss - per_m * (r - end) = (loss + per_m * end) - per_m * r, until it reaches 0
        left |= {f"a_{name}": loss + per_m * F.col("end_m"), f"b_{name}": F.lit(1)}
        if per_m:
            lapses.append(event(F.col("end_m") + loss / per_m, **{f"a_{name}": -(loss + per_m * F.col("end_m")), f"b_{name}": F.lit(-1)}))
    ends = event(F.col("end_m"), exited=F.lit(1), pen=-penetration, last=F.col("end_m").cast("double"), **left)
    events = held.select(*keys, F.explode(F.array(begins, ends, leads, *lapses)).alias("e")).select(*keys, "e.*")
    rows = events.withColumn("_order", F.lit(0)).withColumn("_row", F.lit(None).cast(samples.select(F.struct("*")).schema[0].dataType)).unionByName(
        samples.select(*keys, (F.col(at) + SLACK_M).alias("place"), F.lit(1).alias("_order"), F.struct("*").alias("_row"), *[v.alias(k) for k, v in none.items()])
    )
    sums = {n: ("sum", F.col(n)) for n in none if n not in ("first", "last", "lead")}
    state = running(rows, keys, ["place", "_order"], {f"s_{n}": v for n, v in sums.items()} | {"s_first": ("min", F.col("first")), "s_last": ("max", F.col("last")), "s_lead": ("last", F.col("lead"))})
    out = state.filter(F.col("_row").isNotNull())
    active = F.col("s_begun") - F.col("s_exited")
    cols = [F.col("s_begun").alias("n_begun"), F.col("s_exited").alias("n_exited"), active.alias("n_active"), F.when(active > 0, F.col("s_pen")).otherwise(0.0).alias("penetration_db"), F.col("s_first").alias("first_start_m"), F.when(active > 0, F.col("s_lead")).alias("first_active"), F.col("s_last").alias("last_exit_m")]
    for name, (*_, total) in losses.items():
        rest = F.when(F.col(f"s_b_{name}") > 0, F.col(f"s_a_{name}") - per_m * F.col(f"s_b_{name}") * F.col(f"_row.{at}")).otherwise(0.0)
        cols.append(F.least(F.lit(total), F.greatest(F.lit(0.0), rest)).alias(name))
    return out.select("_row.*", *cols)
