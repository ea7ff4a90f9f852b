"""Measurement queries: scores, matching, motion, coverage, capacity, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import score as S
from ..operators.asof import nearest_in_time
from ..operators.carried import blocks, running
from ..sources.views import telemetry, view, with_views

TOLERANCE_MS = 120_000
c = F.col


def rounded(df: DataFrame, digits: int = 8, **own: int) -> DataFrame:
    """Doubles to a fixed number of digits (and no negative zero), for comparison."""
    return df.select([(F.round(n, own.get(n, digits)) + F.lit(0.0)).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def magnitude(df: DataFrame) -> DataFrame:
    return df.withColumn("timing_change", c("current_timing_offset_us") - c("initial_timing_offset_us")).withColumn("motion_magnitude", F.abs("timing_change").cast("double"))


def matched(spark, sf_dir: str) -> DataFrame:
    """Positions with the nearest telemetry, and the scores of both."""
    gps = view(spark, sf_dir, "fx_gps").select("gps_id", F.col("timestamp_ms").alias("gps_ms"), F.col("latitude").alias("gps_lat"), F.col("longitude").alias("gps_lon"), F.col("timestamp").alias("gps_time"), "velocity_x", "velocity_y", "velocity_z", "horizontal_accuracy")
    tel = telemetry(spark, sf_dir).select("event_id", "timestamp_ms", "pci", "channel_level_db", "initial_timing_offset_us", "current_timing_offset_us", "freq_offset_hz", "dl_carrier_freq", "llr_energy")
    m = nearest_in_time(gps, tel, TOLERANCE_MS, "gps_ms", "timestamp_ms", "gps_id", "event_id")
    m = m.withColumn("best_db", F.array_max("channel_level_db")).withColumn("speed", S.speed(c("velocity_x"), c("velocity_y"), c("velocity_z")))
    m = m.withColumn("position_q", S.position_quality(c("horizontal_accuracy"), c("speed"))).withColumn("signal_q", S.signal_quality(c("best_db"), c("llr_energy")))
    m = m.withColumn("timing_q", S.timing_quality(c("current_timing_offset_us"), c("freq_offset_hz"))).withColumn("motion_q", S.motion_quality(c("speed")))
    m = m.withColumn("overall_q", S.overall_quality(c("position_q"), c("signal_q"), c("timing_q"), c("motion_q")))
    m = m.withColumn("v_cfo", S.doppler_velocity(c("freq_offset_hz"), c("dl_carrier_freq"))).withColumn("v_timing", S.timing_velocity(c("current_timing_offset_us"), c("initial_timing_offset_us")))
    m = m.withColumn("v_fused", S.fused_by_level(c("v_cfo"), c("v_timing"), c("best_db"))).withColumn("v_quality", S.velocity_quality(c("best_db"), c("freq_offset_hz"), c("current_timing_offset_us")))
    return m.withColumn("distance_m", S.rough_distance_m(c("best_db")))


MATCH_SQL = """m0 AS (
  SELECT g.gps_id, g.timestamp_ms AS gps_ms, g.timestamp AS gps_time, g.latitude AS gps_lat, g.longitude AS gps_lon, g.horizontal_accuracy, t.event_id, t.pci, t.llr_energy, t.freq_offset_hz, t.current_timing_offset_us, t.initial_timing_offset_us, t.dl_carrier_freq, t.level_0_db, t.level_1_db,
    abs(g.timestamp_ms - t.timestamp_ms) AS dt_ms, sqrt(velocity_x * velocity_x + velocity_y * velocity_y + velocity_z * velocity_z) AS speed, greatest(level_0_db, level_1_db) AS best_db,
    row_number() OVER (PARTITION BY g.gps_id ORDER BY abs(g.timestamp_ms - t.timestamp_ms), t.timestamp_ms, t.event_id) AS n
  FROM fx_gps g JOIN fx_telemetry t ON t.timestamp_ms BETWEEN g.timestamp_ms - 120000 AND g.timestamp_ms + 120000),
m1 AS (
  SELECT *, greatest(0, 1 - horizontal_accuracy / 50) * 0.7 + greatest(0, 1 - speed / 10) * 0.3 AS position_q,
    least(1, greatest(0, (best_db + 100) / 50)) * 0.8 + least(1, greatest(0, llr_energy / 100)) * 0.2 AS signal_q,
    greatest(0, 1 - abs(current_timing_offset_us) / 100) * 0.7 + greatest(0, 1 - abs(freq_offset_hz) / 2000) * 0.3 AS timing_q,
    greatest(0, 1 - speed / 5) AS motion_q, freq_offset_hz * 299792458.0::DOUBLE / dl_carrier_freq AS v_cfo,
    (current_timing_offset_us - initial_timing_offset_us) * 0.000001::DOUBLE * 299792458.0::DOUBLE / 0.02::DOUBLE AS v_timing,
    least(1, greatest(0, (best_db + 100) / 50)) * 0.5 + greatest(0, 1 - abs(freq_offset_hz) / 2000) * 0.3 + greatest(0, 1 - abs(current_timing_offset_us) / 100) * 0.2 AS v_quality,
    least(5000, greatest(50, 1000 * pow(10, (best_db + 100) / 20))) AS distance_m
  FROM m0 WHERE n = 1),
m AS (SELECT *, CASE WHEN best_db > -80 THEN 0.7 * v_cfo + 0.3 * v_timing ELSE 0.3 * v_cfo + 0.7 * v_timing END AS v_fused,
    0.25 * position_q + 0.3 * signal_q + 0.25 * timing_q + 0.2 * motion_q AS overall_q FROM m1)"""


def r(*names: str, **exprs: str) -> str:
    """Rounded doubles of a SELECT list."""
    return ", ".join([f"round(CAST({n} AS DOUBLE), 8) + 0.0 AS {n}" for n in names] + [f"round(CAST({e} AS DOUBLE), 8) + 0.0 AS {n}" for n, e in exprs.items()])


Q, SQL = {}, {}


def query(sql: str | None = None, *names: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


@query(f"WITH {MATCH_SQL} SELECT gps_id, event_id, pci, CAST(dt_ms AS BIGINT) AS dt_ms, {r('position_q', 'signal_q', 'timing_q', 'motion_q', 'overall_q', 'v_cfo', 'v_timing', 'v_fused', 'v_quality', 'distance_m')} FROM m", "fx_gps", "fx_telemetry")
def replay_match(spark, sf_dir):
    """JN1, SC2-SC8, SC10, SC12, SC14: each position with the nearest telemetry and its scores."""
    return rounded(matched(spark, sf_dir).select("gps_id", "event_id", "pci", c("dt_ms").cast("long"), "position_q", "signal_q", "timing_q", "motion_q", "overall_q", "v_cfo", "v_timing", "v_fused", "v_quality", "distance_m"))


@query(
    f"""WITH p AS (
  SELECT t.event_id, g.gps_id, g.latitude, g.longitude, greatest(0, 1 - abs(g.timestamp_ms - t.timestamp_ms) / 120000.0) AS match_quality,
    row_number() OVER (PARTITION BY t.event_id ORDER BY abs(g.timestamp_ms - t.timestamp_ms), g.timestamp_ms, g.gps_id) AS n
  FROM fx_telemetry t JOIN fx_gps g ON g.timestamp_ms BETWEEN t.timestamp_ms - 120000 AND t.timestamp_ms + 120000)
SELECT event_id, gps_id, {r('latitude', 'longitude', 'match_quality')} FROM p WHERE n = 1 AND match_quality > 0""",
    "fx_gps",
    "fx_telemetry",
)
def telemetry_positions(spark, sf_dir):
    """JN2: each telemetry row takes the place of the nearest position; a match at the tolerance has quality 0 and goes."""
    gps = view(spark, sf_dir, "fx_gps").select("gps_id", c("timestamp_ms").alias("gps_ms"), "latitude", "longitude")
    tel = view(spark, sf_dir, "fx_telemetry").select("event_id", "timestamp_ms")
    m = nearest_in_time(tel, gps, TOLERANCE_MS, "timestamp_ms", "gps_ms", "event_id", "gps_id")
    m = m.withColumn("match_quality", F.greatest(F.lit(0.0), 1 - c("dt_ms") / float(TOLERANCE_MS)))
    return rounded(m.filter("match_quality > 0").select("event_id", "gps_id", "latitude", "longitude", "match_quality"))


@query(
    f"""SELECT event_id, pci, CAST(current_timing_offset_us - initial_timing_offset_us AS INT) AS timing_change, {r(motion_magnitude='abs(current_timing_offset_us - initial_timing_offset_us)')},
  CASE WHEN abs(current_timing_offset_us - initial_timing_offset_us) < 10 THEN 'stationary' WHEN abs(current_timing_offset_us - initial_timing_offset_us) < 20 THEN 'slow_motion' ELSE 'fast_motion' END AS state,
  CASE WHEN abs(current_timing_offset_us - initial_timing_offset_us) < 5 THEN 'stationary' WHEN abs(current_timing_offset_us - initial_timing_offset_us) < 20 THEN 'slow_motion' ELSE 'fast_motion' END AS fine_state,
  {r(motion_impact='least(1, abs(current_timing_offset_us - initial_timing_offset_us) / 20)')} FROM fx_telemetry""",
    "fx_telemetry",
)
def motion_states(spark, sf_dir):
    """FLT3, FLT4, SC20: drift, its size, two classifications and the motion impact."""
    m = magnitude(view(spark, sf_dir, "fx_telemetry"))
    x = c("motion_magnitude")
    return rounded(m.select("event_id", "pci", "timing_change", "motion_magnitude", S.motion_state(x).alias("state"), S.motion_state(x, 5, 20).alias("fine_state"), F.least(F.lit(1.0), x / 20).alias("motion_impact")))


@query(
    f"""WITH v AS (SELECT *, list_filter([level_0_db, level_1_db], lambda x: x > -999) AS ok FROM fx_telemetry),
a AS (SELECT *, CASE WHEN len(ok) > 0 THEN list_sum(ok) / len(ok) END AS avg_level FROM v)
SELECT event_id, {r('avg_level', snr='avg_level - 7')}, round(llr_energy * least(0, greatest(-999, avg_level)) / 1000, 11) + 0.0 AS score FROM a""",
    "fx_telemetry",
)
def signal_levels(spark, sf_dir):
    """FLT5: mean of the levels present, a rough SNR and an energy score; null without a level."""
    t = telemetry(spark, sf_dir).withColumn("avg_level", S.array_mean(S.valid_levels(c("channel_level_db"))))
    return rounded(t.select("event_id", "avg_level", (c("avg_level") - 7).alias("snr"), F.when(c("avg_level").isNotNull(), c("llr_energy") * S.clip(c("avg_level"), -999, 0) / 1000).alias("score")), score=11)


@query(
    f"""SELECT event_id, {r(v_radial='300000000.0::DOUBLE * cfo_est / 3562860606.0::DOUBLE', v_fine='cfo_est * 300000000.0::DOUBLE / dl_carrier_freq',
    v_energy="CASE WHEN (llr_energy + abs(level_0_db)) / 100 > 0.5 THEN 0.7 ELSE 0.3 END * (cfo_est * 300000000.0::DOUBLE / dl_carrier_freq) + CASE WHEN (llr_energy + abs(level_0_db)) / 100 > 0.5 THEN 0.3 ELSE 0.7 END * 2",
    timing_confidence='greatest(0.1, 1 - abs(current_timing_offset_us) / 100)')}
FROM fx_telemetry WHERE timestamp_ms <> 0 AND pci <> 0""",
    "fx_telemetry",
)
def radial_velocities(spark, sf_dir):
    """FLT6, SC9, SC13, SC31, SC33: velocities from fine offsets and their confidence."""
    t = view(spark, sf_dir, "fx_telemetry").filter("timestamp_ms <> 0 AND pci <> 0")
    fine = S.doppler_velocity(c("cfo_est"), c("dl_carrier_freq"), S.ROUND_LIGHT)
    return rounded(t.select("event_id", S.radial_velocity(c("cfo_est")).alias("v_radial"), fine.alias("v_fine"), S.fused_by_energy(fine, F.lit(2.0), c("llr_energy"), c("level_0_db")).alias("v_energy"), F.greatest(F.lit(0.1), 1 - F.abs("current_timing_offset_us") / 100).alias("timing_confidence")))


@query(
    f"""WITH p AS (
  SELECT t.event_id, t.pci, t.llr_energy, greatest(t.level_0_db, t.level_1_db) AS best, greatest(0, 1 - abs(g.timestamp_ms - t.timestamp_ms) / 120000.0) AS match_quality,
    row_number() OVER (PARTITION BY t.event_id ORDER BY abs(g.timestamp_ms - t.timestamp_ms), g.timestamp_ms, g.gps_id) AS n
  FROM fx_telemetry t JOIN fx_gps g ON g.timestamp_ms BETWEEN t.timestamp_ms - 120000 AND t.timestamp_ms + 120000),
s AS (SELECT *, least(1, greatest(0, (llr_energy + abs(best)) / 100)) AS signal_quality, least(1, greatest(0, (-140 + 140) / 60)) AS rsrp_quality FROM p WHERE n = 1 AND match_quality > 0)
SELECT event_id, pci, {r('signal_quality', 'rsrp_quality', 'match_quality', quality_score='0.4 * signal_quality + 0.3 * rsrp_quality + 0.3 * match_quality')} FROM s""",
    "fx_gps",
    "fx_telemetry",
)
def position_quality_rows(spark, sf_dir):
    """SC16, JN2: signal, reference power (-140 dBm where, as here, none is measured) and match quality of each placed row."""
    gps = view(spark, sf_dir, "fx_gps").select("gps_id", c("timestamp_ms").alias("gps_ms"))
    tel = telemetry(spark, sf_dir).select("event_id", "pci", "timestamp_ms", "llr_energy", F.array_max("channel_level_db").alias("best"))
    m = nearest_in_time(tel, gps, TOLERANCE_MS, "timestamp_ms", "gps_ms", "event_id", "gps_id").withColumn("match_quality", S.falling(c("dt_ms"), float(TOLERANCE_MS))).filter("match_quality > 0")
    m = m.withColumn("signal_quality", S.energy_score(c("llr_energy"), c("best"))).withColumn("rsrp_quality", S.clip((F.lit(-140.0) + 140) / 60))
    return rounded(m.select("event_id", "pci", "signal_quality", "rsrp_quality", "match_quality", (0.4 * c("signal_quality") + 0.3 * c("rsrp_quality") + 0.3 * c("match_quality")).alias("quality_score")))


@query(
    """SELECT count(*) AS n, count(DISTINCT pci) AS n_pci, CAST(max(timestamp_ms) - min(timestamp_ms) AS BIGINT) AS span_ms, count(*) FILTER (subcarrier_spacing = 15) AS n_scs15, count(*) FILTER (subcarrier_spacing = 30) AS n_scs30,
  count(*) FILTER (abs(current_timing_offset_us - initial_timing_offset_us) < 10) AS n_stationary, count(*) FILTER (abs(current_timing_offset_us - initial_timing_offset_us) BETWEEN 10 AND 19) AS n_slow, count(*) FILTER (abs(current_timing_offset_us - initial_timing_offset_us) >= 20) AS n_fast FROM fx_telemetry""",
    "fx_telemetry",
)
def telemetry_statistics(spark, sf_dir):
    """AG1: one row of counts; a state without rows counts 0."""
    t = magnitude(view(spark, sf_dir, "fx_telemetry")).withColumn("state", S.motion_state(c("motion_magnitude")))
    of = lambda s, n: F.count_if(c("state") == s).alias(n)
    return t.agg(F.count("*").alias("n"), F.countDistinct("pci").alias("n_pci"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("span_ms"), F.count_if(c("subcarrier_spacing") == 15).alias("n_scs15"), F.count_if(c("subcarrier_spacing") == 30).alias("n_scs30"), of("stationary", "n_stationary"), of("slow_motion", "n_slow"), of("fast_motion", "n_fast"))


HAVERSINE = "6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h}))".format(h="(pow(sin((radians(latitude) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(lo)) / 2), 2))")


@query(
    f"""WITH s AS (SELECT *, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo, lag(timestamp_ms) OVER w AS lt FROM fx_telemetry WINDOW w AS (PARTITION BY pci ORDER BY timestamp_ms, event_id)),
d AS (SELECT *, {HAVERSINE} AS km, (timestamp_ms - lt) / 3600000.0::DOUBLE AS hours FROM s)
SELECT pci, count(*) AS n, {r(distance_km='sum(km)', mean_kmh='avg(CASE WHEN hours > 0 THEN km / hours END)', max_kmh='max(CASE WHEN hours > 0 THEN km / hours END)', duration_h='(max(timestamp_ms) - min(timestamp_ms)) / 3600000.0::DOUBLE')}
FROM d GROUP BY pci HAVING count(*) >= 2""",
    "fx_telemetry",
)
def trajectories(spark, sf_dir):
    """AG3, WIN4, SC1: path length and speeds per cell, over steps in time order."""
    t = blocks(view(spark, sf_dir, "fx_telemetry").select("pci", "event_id", "timestamp_ms", "latitude", "longitude"), ["pci"], ["timestamp_ms", "event_id"], 1, 0)
    w = Window.partitionBy("pci", "_block").orderBy("_i")
    t = t.select("*", F.lag("latitude").over(w).alias("la"), F.lag("longitude").over(w).alias("lo"), F.lag("timestamp_ms").over(w).alias("lt")).filter("_own")
    t = t.withColumn("km", S.haversine_km(c("la"), c("lo"), c("latitude"), c("longitude"))).withColumn("hours", (c("timestamp_ms") - c("lt")) / 3_600_000.0)
    pace = F.when(c("hours") > 0, c("km") / c("hours"))
    out = t.groupBy("pci").agg(F.count("*").alias("n"), F.sum("km").alias("distance_km"), F.avg(pace).alias("mean_kmh"), F.max(pace).alias("max_kmh"), ((F.max("timestamp_ms") - F.min("timestamp_ms")) / 3_600_000.0).alias("duration_h"))
    return rounded(out.filter("n >= 2"))


@query(
    f"""WITH e AS (SELECT pci, unnest([level_0_db, level_1_db]) AS x FROM fx_telemetry)
SELECT pci, {r(mean_level='avg(x)', std_level='stddev_pop(x)')}, CASE WHEN avg(x) > -80 THEN 'good' ELSE 'poor' END AS coverage FROM e WHERE x > -999 GROUP BY pci""",
    "fx_telemetry",
)
def signal_coverage(spark, sf_dir):
    """AG4: mean and population deviation of the levels present, per cell."""
    t = telemetry(spark, sf_dir).select("pci", F.explode(S.valid_levels(c("channel_level_db"))).alias("x"))
    return rounded(t.groupBy("pci").agg(F.avg("x").alias("mean_level"), F.stddev_pop("x").alias("std_level"), F.when(F.avg("x") > -80, "good").otherwise("poor").alias("coverage")))


@query(
    f"""WITH o AS (SELECT pci, level_1_db AS x, row_number() OVER (PARTITION BY pci ORDER BY timestamp_ms, event_id) AS i, count(*) OVER (PARTITION BY pci) AS n FROM fx_telemetry),
h AS (SELECT pci, n, avg(x) FILTER (i <= n // 2) AS early, avg(x) FILTER (i > n // 2) AS late FROM o WHERE n >= 10 GROUP BY pci, n)
SELECT pci, {r('early', 'late')}, CASE WHEN late > early + 5 THEN 'improving' WHEN late < early - 5 THEN 'degrading' ELSE 'stable' END AS trend FROM h""",
    "fx_telemetry",
)
def signal_trend(spark, sf_dir):
    """AG5: mean level of the first half of a cell's rows against the second."""
    t = running(view(spark, sf_dir, "fx_telemetry").select("pci", "timestamp_ms", "event_id", c("level_1_db").alias("x")), ["pci"], ["timestamp_ms", "event_id"], {"i": ("count", F.lit(1))})
    t = t.join(t.groupBy("pci").agg(F.count("*").alias("n")), "pci")
    half = F.floor(c("n") / 2)
    h = t.filter("n >= 10").groupBy("pci").agg(F.avg(F.when(c("i") <= half, c("x"))).alias("early"), F.avg(F.when(c("i") > half, c("x"))).alias("late"))
    return rounded(h.withColumn("trend", F.when(c("late") > c("early") + 5, "improving").when(c("late") < c("early") - 5, "degrading").otherwise("stable")))


def motion_events(df: DataFrame, threshold: float = 20.0, confidence: bool = True) -> DataFrame:
    """WIN1-WIN3: crossings of the threshold per cell, in time order; starts carry a confidence from the spread nearby."""
    w = Window.partitionBy("pci", "_block").orderBy("_i")
    near = w.rowsBetween(-5, 4)
    m = blocks(magnitude(df), ["pci"], ["timestamp_ms", "event_id"], 5, 4)
    m = m.withColumn("prev", F.lag("motion_magnitude").over(w)).withColumn("spread", F.when(F.count("*").over(near) == 10, F.stddev_samp("motion_magnitude").over(near))).filter("_own").drop("_i", "_block", "_own")
    up, down = (c("motion_magnitude") > threshold) & (c("prev") <= threshold), (c("motion_magnitude") <= threshold) & (c("prev") > threshold)
    out = m.filter(up | down).withColumn("motion_type", F.when(up, S.motion_state(c("motion_magnitude"), 5, 20)).otherwise("stationary"))
    return out.withColumn("confidence", F.when(up, S.motion_confidence(c("motion_magnitude"), c("spread"))).otherwise(0.9))


EVENTS_SQL = """s AS (SELECT *, abs(current_timing_offset_us - initial_timing_offset_us)::DOUBLE AS mag FROM fx_telemetry),
w AS (SELECT *, lag(mag) OVER o AS prev, CASE WHEN count(*) OVER f = 10 THEN stddev_samp(mag) OVER f END AS sd FROM s
  WINDOW o AS (PARTITION BY pci ORDER BY timestamp_ms, event_id), f AS (PARTITION BY pci ORDER BY timestamp_ms, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
ev AS (SELECT *, CASE WHEN mag > 20 THEN CASE WHEN mag < 5 THEN 'stationary' WHEN mag < 20 THEN 'slow_motion' ELSE 'fast_motion' END ELSE 'stationary' END AS motion_type,
  CASE WHEN mag > 20 THEN CASE WHEN sd = 0 THEN 0.5 WHEN sd IS NOT NULL THEN greatest(least(least(mag / 100, 1) / (sd + 0.000001) / 10, 1), 0.1) END ELSE 0.9 END AS confidence
  FROM w WHERE (mag > 20 AND prev <= 20) OR (mag <= 20 AND prev > 20))"""


@query(f"WITH {EVENTS_SQL} SELECT event_id, pci, motion_type, {r('confidence', magnitude='mag')} FROM ev", "fx_telemetry")
def motion_event_rows(spark, sf_dir):
    """WIN1-WIN3, FLT4: motion events."""
    return rounded(motion_events(view(spark, sf_dir, "fx_telemetry")).select("event_id", "pci", "motion_type", "confidence", c("motion_magnitude").alias("magnitude")))


@query(f"WITH {EVENTS_SQL} SELECT count(*) AS n, count(*) FILTER (motion_type = 'stationary') AS n_stationary, count(*) FILTER (motion_type = 'slow_motion') AS n_slow, count(*) FILTER (motion_type = 'fast_motion') AS n_fast, {r(mean_confidence='avg(confidence)')}, count(*) FILTER (confidence > 0.8) AS n_sure FROM ev", "fx_telemetry")
def motion_summary(spark, sf_dir):
    """AG6: motion events in one row."""
    e = motion_events(view(spark, sf_dir, "fx_telemetry"))
    of = lambda s, n: F.count_if(c("motion_type") == s).alias(n)
    return rounded(e.agg(F.count("*").alias("n"), of("stationary", "n_stationary"), of("slow_motion", "n_slow"), of("fast_motion", "n_fast"), F.avg("confidence").alias("mean_confidence"), F.count_if(c("confidence") > 0.8).alias("n_sure")))


@query(f"WITH {MATCH_SQL} SELECT count(*) AS n, {r(mean_q='avg(overall_q)', std_q='stddev_pop(overall_q)', min_q='min(overall_q)', max_q='max(overall_q)')}, count(*) FILTER (overall_q >= 0.8) AS n_excellent, count(*) FILTER (overall_q >= 0.6 AND overall_q < 0.8) AS n_good, count(*) FILTER (overall_q >= 0.4 AND overall_q < 0.6) AS n_fair, count(*) FILTER (overall_q < 0.4) AS n_poor FROM m", "fx_gps", "fx_telemetry")
def quality_distribution(spark, sf_dir):
    """AG7: distribution of the overall quality."""
    q = c("overall_q")
    return rounded(matched(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(q).alias("mean_q"), F.stddev_pop(q).alias("std_q"), F.min(q).alias("min_q"), F.max(q).alias("max_q"), *S.bands(q)))


TOP_SQL = MATCH_SQL + ", top AS (SELECT *, row_number() OVER (ORDER BY overall_q DESC, gps_ms, gps_id) AS rank FROM m WHERE overall_q >= 0.6 QUALIFY rank <= 10)"


def best_positions(df: DataFrame, least: float = 0.6, most: int = 10) -> DataFrame:
    """TOP1: the positions of best quality, best first; ties to the earlier."""
    top = df.filter(c("overall_q") >= least).orderBy(F.desc("overall_q"), "gps_ms", "gps_id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall_q"), "gps_ms", "gps_id")))


@query(f"WITH {TOP_SQL} SELECT CAST(rank AS INT) AS rank, gps_id, pci, {r('overall_q', 'best_db')} FROM top", "fx_gps", "fx_telemetry")
def top_positions(spark, sf_dir):
    """TOP1, SNK4: ranked best positions."""
    return rounded(best_positions(matched(spark, sf_dir)).select("rank", "gps_id", "pci", "overall_q", "best_db"))


@query(
    f"""WITH {TOP_SQL}, a AS (SELECT count(*) AS n, sum(overall_q * gps_lat) / sum(overall_q) AS lat, sum(overall_q * gps_lon) / sum(overall_q) AS lon, avg(overall_q) AS q,
  sqrt(pow((max(gps_lat) - min(gps_lat)) * 111000, 2) + pow((max(gps_lon) - min(gps_lon)) * 111000, 2)) AS spread FROM top)
SELECT n, {r('lat', 'lon', spread_m='spread', confidence='q * (1 - least(spread / 1000, 0.5))')} FROM a WHERE n >= 3""",
    "fx_gps",
    "fx_telemetry",
)
def transmitter_estimate(spark, sf_dir):
    """AG9, AG10: quality-weighted centre of the best positions, its spread and confidence."""
    q = c("overall_q")
    a = best_positions(matched(spark, sf_dir)).agg(F.count("*").alias("n"), (F.sum(q * c("gps_lat")) / F.sum(q)).alias("lat"), (F.sum(q * c("gps_lon")) / F.sum(q)).alias("lon"), F.avg(q).alias("q"), F.sqrt(F.pow((F.max("gps_lat") - F.min("gps_lat")) * 111_000, 2) + F.pow((F.max("gps_lon") - F.min("gps_lon")) * 111_000, 2)).alias("spread_m"))
    return rounded(a.filter("n >= 3").select("n", "lat", "lon", "spread_m", (c("q") * (1 - F.least(c("spread_m") / 1000, F.lit(0.5)))).alias("confidence")))


@query(f"SELECT count(*) AS n, {r(mean_v='avg(v)', std_v='stddev_pop(v)', min_v='min(v)', max_v='max(v)', mean_cfo='avg(cfo_est)', std_cfo='stddev_pop(cfo_est)')}, count(*) FILTER (abs(v) >= 10) AS n_fast, count(*) FILTER (abs(v) >= 5 AND abs(v) < 10) AS n_mid, count(*) FILTER (abs(v) < 5) AS n_slow FROM (SELECT cfo_est, 300000000.0::DOUBLE * cfo_est / 3562860606.0::DOUBLE AS v FROM fx_telemetry)", "fx_telemetry")
def velocity_statistics(spark, sf_dir):
    """AG13, AG15: radial velocity and offset in one row, with bands."""
    t = view(spark, sf_dir, "fx_telemetry").select("cfo_est", S.radial_velocity(c("cfo_est")).alias("v"))
    a = F.abs("v")
    return rounded(t.agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("cfo_est").alias("mean_cfo"), F.stddev_pop("cfo_est").alias("std_cfo"), F.count_if(a >= 10).alias("n_fast"), F.count_if((a >= 5) & (a < 10)).alias("n_mid"), F.count_if(a < 5).alias("n_slow")))


@query(
    f"""WITH h AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n, avg(latitude) AS lat, avg(longitude) AS lon FROM fx_telemetry GROUP BY 1),
d AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour),
f AS (SELECT d.hour, coalesce(n, 0) AS n, lat, lon FROM d LEFT JOIN h USING (hour)),
s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd FROM f)
SELECT CAST(epoch_us(hour) // 1000 AS BIGINT) AS hour_ms, CAST(n AS BIGINT) AS n, {r('lat', 'lon')}, CASE WHEN n > m + 3 * sd THEN 'high' ELSE 'medium' END AS severity FROM f, s WHERE n > m + 2 * sd""",
    "fx_telemetry",
)
def capacity_hours(spark, sf_dir):
    """AG18: hours far busier than the mean of all hours from first to last, empty ones included."""
    return rounded(busy_hours(view(spark, sf_dir, "fx_telemetry")))


def busy_hours(t: DataFrame) -> DataFrame:
    t = t.groupBy(F.floor(c("timestamp_ms") / 3_600_000).alias("h")).agg(F.count("*").alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    span = t.agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("n").alias("s"), F.sum(c("n") * c("n")).alias("q"))
    hours = c("b") - c("a") + 1
    mean = c("s") / hours
    # Empty hours add nothing to the sums, only to their number.
    span = span.select(mean.alias("m"), F.sqrt((c("q") - c("s") * mean) / (hours - 1)).alias("sd"))
    out = t.crossJoin(F.broadcast(span)).filter(c("n") > c("m") + 2 * c("sd"))
    return out.select((c("h") * 3_600_000).alias("hour_ms"), "n", "lat", "lon", F.when(c("n") > c("m") + 3 * c("sd"), "high").otherwise("medium").alias("severity"))


@query(f"WITH {MATCH_SQL} SELECT CAST(extract('hour' FROM gps_time) AS INT) AS hour, count(*) AS n, {r(mean_q='avg(overall_q)')} FROM m GROUP BY 1", "fx_gps", "fx_telemetry")
def hourly_quality(spark, sf_dir):
    """AG34: mean quality by hour of day."""
    return rounded(matched(spark, sf_dir).groupBy(F.hour("gps_time").alias("hour")).agg(F.count("*").alias("n"), F.avg("overall_q").alias("mean_q")))


@query(
    """WITH b AS (SELECT min(llr_energy) AS lo, max(llr_energy) AS hi FROM fx_telemetry)
SELECT CAST(least(29, floor((llr_energy - lo) / (hi - lo) * 30)) AS INT) AS bin, count(*) AS n FROM fx_telemetry, b GROUP BY 1""",
    "fx_telemetry",
)
def energy_histogram(spark, sf_dir):
    """AG35: thirty equal bins; the last includes its upper edge."""
    t = view(spark, sf_dir, "fx_telemetry").select("llr_energy")
    b = t.agg(F.min("llr_energy").alias("lo"), F.max("llr_energy").alias("hi"))
    return t.crossJoin(F.broadcast(b)).groupBy(F.least(F.lit(29), F.floor((c("llr_energy") - c("lo")) / (c("hi") - c("lo")) * 30)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


LOCATION_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY pci ORDER BY timestamp_ms DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY pci) AS rows_of FROM fx_telemetry),
k AS (SELECT pci, var_pop(greatest(level_0_db, level_1_db)) AS vs, var_pop(current_timing_offset_us) AS vt, count(*) AS k FROM o WHERE back <= 10 GROUP BY pci),
a AS (SELECT o.*, CASE WHEN k > 1 THEN greatest(0, 1 - vs / 100) ELSE 0.5 END AS signal_stability, CASE WHEN k > 1 THEN greatest(0, 1 - vt / 1000) ELSE 0.5 END AS timing_stability,
  greatest(level_0_db, level_1_db) - (-174 + 10 * log10(40000000)) AS snr,
  (least(1, greatest(0, (level_0_db + 100) / 50)) + least(1, greatest(0, 1 - abs(current_timing_offset_us) / 100))) / 2 AS geometric,
  least(1, abs(level_0_db - level_1_db) / 20) AS diversity, greatest(0, 1 - pow((event_id % 10) / 20.0::DOUBLE, 2)) AS mrc_quality, least(1, abs(current_timing_offset_us - initial_timing_offset_us) / 20) AS impact,
  greatest(1, abs(current_timing_offset_us) * (1 + (level_0_db + 100) / 50)) AS timing_accuracy FROM o JOIN k USING (pci) WHERE rows_of >= 3),
sc AS (SELECT *, least(1, greatest(0, 0.25 * (signal_stability + greatest(0, snr + 20) / 40) / 2 + 0.25 * timing_stability + 0.2 * geometric + 0.15 * (diversity + mrc_quality) / 2 + 0.15 * (1 - impact))) AS location_score FROM a)"""


@query(
    f"""WITH {LOCATION_SQL}
SELECT event_id, pci, {r('signal_stability', 'timing_stability', 'snr', 'geometric', 'diversity', 'mrc_quality', 'timing_accuracy', 'location_score', confidence='geometric * 0.8')} FROM sc""",
    "fx_telemetry",
)
def location_quality(spark, sf_dir):
    """JOB17, WIN5, SC17-SC19, SC21: location score; stabilities are those of the last ten rows of the cell."""
    return rounded(location_scores(spark, sf_dir).select("event_id", "pci", "signal_stability", "timing_stability", "snr", "geometric", "diversity", "mrc_quality", "timing_accuracy", "location_score", (c("geometric") * 0.8).alias("confidence")))


def location_scores(spark, sf_dir) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumn("best_db", F.array_max("channel_level_db"))
    last = Window.partitionBy("pci").orderBy(F.desc("timestamp_ms"), F.desc("event_id"))
    k = t.withColumn("back", F.row_number().over(last)).filter("back <= 10").groupBy("pci").agg(F.var_pop("best_db").alias("vs"), F.var_pop("current_timing_offset_us").alias("vt"), F.count("*").alias("k"))
    enough = t.groupBy("pci").count().filter("count >= 3").select("pci")
    a = t.join(k.join(enough, "pci"), "pci")
    stable = lambda v, scale: F.when(c("k") > 1, S.falling(c(v), scale)).otherwise(0.5)
    a = a.withColumn("signal_stability", stable("vs", 100)).withColumn("timing_stability", stable("vt", 1000)).withColumn("snr", c("best_db") - (-174 + 10 * F.log10(F.lit(40e6))))
    a = a.withColumn("geometric", (S.level_score(c("level_0_db")) + S.clip(1 - F.abs("current_timing_offset_us") / 100)) / 2).withColumn("diversity", F.least(F.lit(1.0), (F.array_max("channel_level_db") - F.array_min("channel_level_db")) / 20))
    a = a.withColumn("mrc_quality", F.greatest(F.lit(0.0), 1 - S.array_variance(c("mrc_weights"))))
    a = a.withColumn("timing_accuracy", F.greatest(F.lit(1.0), F.abs("current_timing_offset_us") * (1 + (c("level_0_db") + 100) / 50)))
    impact = F.least(F.lit(1.0), F.abs(c("current_timing_offset_us") - c("initial_timing_offset_us")) / 20)
    signal = (c("signal_stability") + F.greatest(F.lit(0.0), c("snr") + 20) / 40) / 2
    return a.withColumn("location_score", S.clip(0.25 * signal + 0.25 * c("timing_stability") + 0.20 * c("geometric") + 0.15 * (c("diversity") + c("mrc_quality")) / 2 + 0.15 * (1 - impact)))


@query(
    f"""WITH k AS (SELECT pci FROM fx_telemetry GROUP BY pci HAVING count(*) >= 3),
s AS (SELECT pci, timestamp_ms // 1000 AS sec, avg(latitude) AS lat, avg(longitude) AS lon, avg(altitude) AS alt, avg(current_timing_offset_us) AS timing, avg(llr_energy) AS llr, avg(abs(current_timing_offset_us - initial_timing_offset_us)) AS motion, max_by([level_0_db, level_1_db], (timestamp_ms, event_id)) AS lv, count(*) AS n
  FROM fx_telemetry JOIN k USING (pci) GROUP BY 1, 2),
c AS (SELECT *, greatest(0.1, 1 - abs(timing) / 100) AS timing_confidence, list_filter(lv, lambda x: x > -999) AS ok FROM s),
d AS (SELECT *, CASE WHEN len(ok) > 0 THEN greatest(0.1, least(1, (list_sum(ok) / len(ok) + 100) / 100)) END AS level_confidence FROM c)
SELECT pci, CAST(sec AS BIGINT) AS sec, CAST(n AS BIGINT) AS n, {r('lat', 'lon', 'alt', 'timing', 'llr', 'motion', 'timing_confidence', 'level_confidence', confidence='CASE WHEN level_confidence IS NULL THEN timing_confidence ELSE sqrt(timing_confidence * level_confidence) END')},
  CASE WHEN level_confidence IS NULL THEN 'timing_based' ELSE 'hybrid' END AS method, CASE WHEN motion < 5 THEN 'stationary' WHEN motion < 20 THEN 'slow_motion' ELSE 'fast_motion' END AS state FROM d""",
    "fx_telemetry",
)
def second_positions(spark, sf_dir):
    """JOB18, SC22, SC23: means per cell of three rows or more and second, with the last level list; timing and level estimates at one place combine to it, with the geometric mean of their confidences."""
    t = telemetry(spark, sf_dir)
    t = t.join(t.groupBy("pci").count().filter("count >= 3").select("pci"), "pci")
    s = t.groupBy("pci", F.floor(c("timestamp_ms") / 1000).alias("sec")).agg(F.count("*").alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.avg("altitude").alias("alt"), F.avg("current_timing_offset_us").alias("timing"), F.avg("llr_energy").alias("llr"), F.avg(F.abs(c("current_timing_offset_us") - c("initial_timing_offset_us"))).alias("motion"), F.max_by("channel_level_db", F.struct("timestamp_ms", "event_id")).alias("lv"))
    s = s.withColumn("timing_confidence", F.greatest(F.lit(0.1), 1 - F.abs("timing") / 100)).withColumn("level_confidence", S.level_confidence(S.array_mean(S.valid_levels(c("lv")))))
    s = s.withColumn("confidence", F.coalesce(F.sqrt(c("timing_confidence") * c("level_confidence")), c("timing_confidence"))).withColumn("method", F.when(c("level_confidence").isNull(), "timing_based").otherwise("hybrid"))
    return rounded(s.select("pci", "sec", "n", "lat", "lon", "alt", "timing", "llr", "motion", "timing_confidence", "level_confidence", "confidence", "method", S.motion_state(c("motion"), 5, 20).alias("state")))


@query(
    """SELECT pci, event_id FROM (SELECT *, row_number() OVER (PARTITION BY pci ORDER BY llr_energy DESC, timestamp_ms, event_id) AS n FROM fx_telemetry) WHERE n = 1""",
    "fx_telemetry",
)
def best_row_per_cell(spark, sf_dir):
    """TOP3: the row of most energy of each cell, the first of equals."""
    t = view(spark, sf_dir, "fx_telemetry")
    return t.groupBy("pci").agg(F.max_by("event_id", F.struct("llr_energy", -c("timestamp_ms"), -c("event_id"))).alias("event_id"))


@query("SELECT event_id, timestamp_ms, pci FROM fx_telemetry ORDER BY timestamp_ms DESC, event_id DESC LIMIT 100", "fx_telemetry")
def latest_rows(spark, sf_dir):
    """TOP7: the latest hundred rows."""
    return view(spark, sf_dir, "fx_telemetry").select("event_id", "timestamp_ms", "pci").orderBy(F.desc("timestamp_ms"), F.desc("event_id")).limit(100)


def recent(df: DataFrame, minutes: float, as_of_ms: int | None = None) -> DataFrame:
    """FLT1: rows of the last minutes before an instant; by default now."""
    as_of = F.unix_millis(F.current_timestamp()) if as_of_ms is None else F.lit(as_of_ms)
    return df.filter(c("timestamp_ms") >= as_of - int(minutes * 60_000))


@query("SELECT event_id, pci, timestamp_ms FROM fx_telemetry WHERE pci = 3 AND timestamp_ms >= 1704067200000 - 60 * 60000", "fx_telemetry")
def recent_cell_rows(spark, sf_dir):
    """FLT1, FLT2: one cell's rows of the hour before a given instant, and later."""
    return recent(view(spark, sf_dir, "fx_telemetry").select("event_id", "pci", "timestamp_ms").filter("pci = 3"), 60, 1_704_067_200_000)


@query(f"WITH {TOP_SQL}, a AS (SELECT count(*) AS n, avg(overall_q) AS q, sqrt(pow((max(gps_lat) - min(gps_lat)) * 111000, 2) + pow((max(gps_lon) - min(gps_lon)) * 111000, 2)) AS spread FROM top) SELECT n, {r(spread_m='spread', quality='CASE WHEN n < 3 THEN 0 ELSE greatest(0, least(1, 0.3 * least(n / 10, 1) + 0.3 * greatest(0, least(1, 1 - abs(spread - 1000) / 1000)) + 0.3 * q + 0.1)) END')} FROM a", "fx_gps", "fx_telemetry")
def triangulation_quality(spark, sf_dir):
    """AG11: from the number, spread and mean quality of the best positions; fewer than three have none."""
    a = best_positions(matched(spark, sf_dir)).agg(F.count("*").alias("n"), F.avg("overall_q").alias("q"), F.sqrt(F.pow((F.max("gps_lat") - F.min("gps_lat")) * 111_000, 2) + F.pow((F.max("gps_lon") - F.min("gps_lon")) * 111_000, 2)).alias("spread_m"))
    q = S.clip(0.3 * F.least(c("n") / 10, F.lit(1.0)) + 0.3 * S.clip(1 - F.abs(c("spread_m") - 1000) / 1000) + 0.3 * c("q") + 0.1)
    return rounded(a.select("n", "spread_m", F.when(c("n") < 3, 0.0).otherwise(q).alias("quality")))


@query(f"WITH v AS (SELECT 300000000.0::DOUBLE * cfo_est / 3562860606.0::DOUBLE AS fine, 300000000.0::DOUBLE * freq_offset_hz / 3562860606.0::DOUBLE AS coarse FROM fx_telemetry) SELECT count(*) AS n, {r(mean_fine='avg(fine)', std_fine='stddev_pop(fine)', min_fine='min(fine)', max_fine='max(fine)', mean_coarse='avg(coarse)', std_coarse='stddev_pop(coarse)', ratio='CASE WHEN stddev_pop(fine) > 0.001 THEN stddev_pop(coarse) / stddev_pop(fine) END')} FROM v", "fx_telemetry")
def field_comparison(spark, sf_dir):
    """AG14: velocities by the fine and the coarse offset, and the ratio of their deviations where the fine one has any."""
    t = view(spark, sf_dir, "fx_telemetry").select(S.radial_velocity(c("cfo_est")).alias("fine"), S.radial_velocity(c("freq_offset_hz")).alias("coarse"))
    sd = F.stddev_pop
    return rounded(t.agg(F.count("*").alias("n"), F.avg("fine").alias("mean_fine"), sd("fine").alias("std_fine"), F.min("fine").alias("min_fine"), F.max("fine").alias("max_fine"), F.avg("coarse").alias("mean_coarse"), sd("coarse").alias("std_coarse"), F.when(sd("fine") > 0.001, sd("coarse") / sd("fine")).alias("ratio")))


@query(
    """WITH h(name, x, bins) AS (
  SELECT 'energy', llr_energy, 30 FROM fx_telemetry UNION ALL SELECT 'frequency offset', freq_offset_hz, 20 FROM fx_telemetry
  UNION ALL SELECT 'magnitude', abs(current_timing_offset_us - initial_timing_offset_us)::DOUBLE, 15 FROM fx_telemetry UNION ALL SELECT 'level', level_1_db, 20 FROM fx_telemetry),
b AS (SELECT name, min(x) AS lo, max(x) AS hi FROM h GROUP BY name)
SELECT name, CAST(least(bins - 1, floor((x - lo) / (hi - lo) * bins)) AS INT) AS bin, count(*) AS n FROM h JOIN b USING (name) GROUP BY 1, 2""",
    "fx_telemetry",
)
def histograms(spark, sf_dir):
    """AG35: equal bins between the least and largest value, the last with its upper edge; four measures at once."""
    t = view(spark, sf_dir, "fx_telemetry")
    parts = F.array(*[F.struct(F.lit(n).alias("name"), x.cast("double").alias("x"), F.lit(k).alias("bins")) for n, x, k in (("energy", c("llr_energy"), 30), ("frequency offset", c("freq_offset_hz"), 20), ("magnitude", F.abs(c("current_timing_offset_us") - c("initial_timing_offset_us")), 15), ("level", c("level_1_db"), 20))])
    h = t.select(F.explode(parts).alias("h")).select("h.*")
    b = h.groupBy("name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return h.join(F.broadcast(b), "name").groupBy("name", F.least(c("bins") - 1, F.floor((c("x") - c("lo")) / (c("hi") - c("lo")) * c("bins"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
