"""Planning queries on measurements: coverage per cell, clusters of weak places, integration times, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import score as S
from ..operators.lineage import cut
from ..operators.spatial import within_sphere
from ..sources.views import telemetry, view, with_views
from .measurement import EVENTS_SQL, HAVERSINE, LOCATION_SQL, MATCH_SQL, TOP_SQL, best_positions, busy_hours, location_scores, matched, motion_events, r, rounded

Q, SQL = {}, {}
c = F.col


def query(sql: str | None = None, *names: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


SITE_SQL = """st AS (SELECT site_id AS pci, latitude AS la, longitude AS lo FROM fx_sites),
mean AS (SELECT pci, avg(latitude) AS mla, avg(longitude) AS mlo FROM fx_telemetry GROUP BY pci),
x AS (SELECT t.*, coalesce(st.la, mean.mla) AS la, coalesce(st.lo, mean.mlo) AS lo, list_filter([level_0_db, level_1_db], lambda v: v > -999) AS ok FROM fx_telemetry t JOIN mean USING (pci) LEFT JOIN st USING (pci))"""


@query(
    f"""WITH {SITE_SQL}, a AS (SELECT pci, count(*) AS n, avg({HAVERSINE}) * 1000 AS radius_m, avg(list_sum(ok) / len(ok)) AS mean_level FROM x GROUP BY pci HAVING count(*) >= 5)
SELECT pci, n, {r('radius_m', 'mean_level', snr='mean_level + 174')}, CASE WHEN mean_level + 174 > 20 THEN 'excellent' WHEN mean_level + 174 > 15 THEN 'good' WHEN mean_level + 174 > 10 THEN 'fair' ELSE 'poor' END AS quality FROM a""",
    "fx_telemetry",
    "fx_sites",
)
def cell_coverage(spark, sf_dir):
    """JN3, AG2, SC25: mean distance to the cell's site (its rows' mean place where none is known), level and SNR over the thermal floor."""
    sites = view(spark, sf_dir, "fx_sites").select(c("site_id").alias("pci"), c("latitude").alias("sla"), c("longitude").alias("slo"))
    return rounded(coverage(telemetry(spark, sf_dir), sites))


def coverage(t: DataFrame, sites: DataFrame) -> DataFrame:
    mean = t.groupBy("pci").agg(F.avg("latitude").alias("mla"), F.avg("longitude").alias("mlo"))
    place = mean.join(sites, "pci", "left").select("pci", F.coalesce("sla", "mla").alias("la"), F.coalesce("slo", "mlo").alias("lo"))
    x = t.join(place, "pci").withColumn("km", S.haversine_km(c("la"), c("lo"), c("latitude"), c("longitude"))).withColumn("level", S.array_mean(S.valid_levels(c("channel_level_db"))))
    a = x.groupBy("pci").agg(F.count("*").alias("n"), (F.avg("km") * 1000).alias("radius_m"), F.avg("level").alias("mean_level")).filter("n >= 5").withColumn("snr", c("mean_level") + 174)
    return a.withColumn("quality", F.when(c("snr") > 20, "excellent").when(c("snr") > 15, "good").when(c("snr") > 10, "fair").otherwise("poor"))


def weak_rows(t: DataFrame, below_db: float = -90.0) -> DataFrame:
    """AG16: rows whose mean level lies below a bar."""
    return t.withColumn("level", S.array_mean(S.valid_levels(c("channel_level_db")))).filter(c("level") < below_db)


def uneven_rows(t: DataFrame, above: float = 100.0) -> DataFrame:
    """AG17: rows whose levels present vary by more (population variance)."""
    return t.withColumn("variance", F.coalesce(S.array_variance(S.valid_levels(c("channel_level_db"))), F.lit(0.0))).filter(c("variance") > above)


ROWS_SQL = "l AS (SELECT *, list_filter([level_0_db, level_1_db], lambda v: v > -999) AS ok FROM fx_telemetry)"


@query(f"WITH {ROWS_SQL} SELECT event_id, pci, {r('latitude', 'longitude', level='list_sum(ok) / len(ok)')} FROM l WHERE list_sum(ok) / len(ok) < -88", "fx_telemetry")
def weak_places(spark, sf_dir):
    """AG16: the rows that coverage gaps are made of, here below -88 dB."""
    return rounded(weak_rows(telemetry(spark, sf_dir), -88.0).select("event_id", "pci", "latitude", "longitude", "level"))


@query(f"WITH {ROWS_SQL} SELECT event_id, pci, {r('latitude', 'longitude', variance='list_var_pop(ok)')} FROM l WHERE list_var_pop(ok) > 100", "fx_telemetry")
def uneven_places(spark, sf_dir):
    """AG17: the rows that interference areas are made of."""
    return rounded(uneven_rows(telemetry(spark, sf_dir)).select("event_id", "pci", "latitude", "longitude", "variance"))


CELL, STEPS = 1e-4, 5
APART = "round((pow({a}.la - {b}.la, 2) + pow({a}.lo - {b}.lo, 2)) * 100000000, 6)"


def apart(la, lo, kla, klo):
    """Squared distance, to a millionth of a cell: nearer than that is equal."""
    return F.round((F.pow(la - kla, 2) + F.pow(lo - klo, 2)) * 1e8, 6)


def clustered(rows: DataFrame, severe: int, k: int = 3) -> DataFrame:
    """Centres of at most k clusters of places; high severity above a number of rows.  Fewer rows than k have none.

    Rows are first counted by cells of 1e-4 degrees.  The first centre is the fullest cell (ties to the south, then the west), each
    other one the cell farthest from the centres so far; then a fixed number of rounds deals cells to the nearest centre (ties
    to the first) and moves centres to the mean of their rows.  Only centres travel; the same rows give the same clusters.
    """
    cells = rows.groupBy(F.rint(c("latitude") / CELL).alias("gy"), F.rint(c("longitude") / CELL).alias("gx")).agg(F.count("*").alias("n"), F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"))
    cells = cut(cells)
    if (cells.agg(F.sum("n")).first()[0] or 0) < k:
        return rows.sparkSession.createDataFrame([], "cluster int, latitude double, longitude double, n long, severity string")
    first = cells.agg(F.max_by(F.struct("la", "lo"), F.struct("n", -c("gy"), -c("gx"))).alias("p")).select(F.array("p").alias("ks"))
    for _ in range(k - 1):
        far = F.array_min(F.transform("ks", lambda p: apart(c("la"), c("lo"), p["la"], p["lo"])))
        more = cells.crossJoin(F.broadcast(first)).withColumn("far", far).agg(F.first("ks").alias("ks"), F.max_by(F.when(c("far") > 0, F.struct("la", "lo")), F.struct("far", -c("gy"), -c("gx"))).alias("p"))
        first = more.select(F.when(c("p").isNull(), c("ks")).otherwise(F.concat("ks", F.array("p"))).alias("ks"))
    centres = first.select(F.posexplode("ks").alias("cluster", "p")).select("cluster", "p.la", "p.lo")
    for _ in range(STEPS):  # each round reads the cells once, against k rows
        ks = centres.agg(F.collect_list(F.struct("cluster", "la", "lo")).alias("ks"))
        near = F.array_min(F.transform("ks", lambda p: F.struct(apart(c("la"), c("lo"), p["la"], p["lo"]).alias("d"), p["cluster"].alias("cluster")))).getField("cluster")
        dealt = cells.crossJoin(F.broadcast(ks)).select(near.alias("cluster"), "n", "la", "lo")
        centres = dealt.groupBy("cluster").agg((F.sum(c("la") * c("n")) / F.sum("n")).alias("la"), (F.sum(c("lo") * c("n")) / F.sum("n")).alias("lo"), F.sum("n").alias("n"))
    return centres.select("cluster", c("la").alias("latitude"), c("lo").alias("longitude"), "n", F.when(c("n") > severe, "high").otherwise("medium").alias("severity"))


def _clusters_sql(source: str, name: str, severe: int) -> str:
    """The same rounds as common table expressions; ``name`` is the last one's and the others' prefix."""
    p = name
    out = f"""{p}_g AS (SELECT round_even(latitude / {CELL}::DOUBLE, 0) AS gy, round_even(longitude / {CELL}::DOUBLE, 0) AS gx, count(*) AS n, avg(latitude) AS la, avg(longitude) AS lo FROM {source} GROUP BY 1, 2),
{p}_a AS (SELECT la, lo FROM {p}_g ORDER BY n DESC, gy, gx LIMIT 1), {p}_b AS (SELECT g.la, g.lo FROM {p}_g g, {p}_a a WHERE {APART.format(a='g', b='a')} > 0 ORDER BY {APART.format(a='g', b='a')} DESC, gy, gx LIMIT 1),
{p}_c AS (SELECT g.la, g.lo FROM {p}_g g, {p}_a a, {p}_b b WHERE least({APART.format(a='g', b='a')}, {APART.format(a='g', b='b')}) > 0 ORDER BY least({APART.format(a='g', b='a')}, {APART.format(a='g', b='b')}) DESC, gy, gx LIMIT 1),
{p}_k0 AS (SELECT 0 AS cluster, la, lo FROM {p}_a UNION ALL SELECT 1, la, lo FROM {p}_b UNION ALL SELECT 2, la, lo FROM {p}_c)"""
    for i in range(STEPS):
        out += f""", {p}_d{i} AS (SELECT gy, gx, any_value(g.n) AS n, any_value(g.la) AS la, any_value(g.lo) AS lo, min_by(k.cluster, ({APART.format(a='g', b='k')}, k.cluster)) AS cluster FROM {p}_g g, {p}_k{i} k GROUP BY gy, gx),
{p}_k{i + 1} AS (SELECT cluster, sum(la * n) / sum(n) AS la, sum(lo * n) / sum(n) AS lo, CAST(sum(n) AS BIGINT) AS n FROM {p}_d{i} GROUP BY cluster)"""
    return out + f""", {p} AS (SELECT CAST(cluster AS INT) AS cluster, la AS latitude, lo AS longitude, n, CASE WHEN n > {severe} THEN 'high' ELSE 'medium' END AS severity FROM {p}_k{STEPS} WHERE (SELECT sum(n) FROM {p}_g) >= 3)"""


WEAK_DB = -80.0  # the fixture's levels are rarely below -90
GAPS_SQL = f"gr AS (SELECT latitude, longitude FROM l WHERE list_sum(ok) / len(ok) < {WEAK_DB}), " + _clusters_sql("gr", "gaps", 10)
AREAS_SQL = "ar AS (SELECT latitude, longitude FROM l WHERE list_var_pop(ok) > 100), " + _clusters_sql("ar", "areas", 5)


def gaps_of(t: DataFrame, below_db: float = -90.0) -> DataFrame:
    return clustered(weak_rows(t, below_db).select("latitude", "longitude"), 10)


def areas_of(t: DataFrame) -> DataFrame:
    return clustered(uneven_rows(t).select("latitude", "longitude"), 5)


@query(f"WITH {ROWS_SQL}, {GAPS_SQL.replace(str(WEAK_DB), '-90.0')} SELECT cluster, {r('latitude', 'longitude')}, n, severity FROM gaps", "fx_telemetry")
def coverage_gaps(spark, sf_dir):
    """AG16: clusters of rows of mean level below -90 dB."""
    return rounded(gaps_of(telemetry(spark, sf_dir)))


@query(f"WITH {ROWS_SQL}, {GAPS_SQL} SELECT cluster, {r('latitude', 'longitude')}, n, severity FROM gaps", "fx_telemetry")
def weak_areas(spark, sf_dir):
    """AG16: clusters of the rows below another bar, of which there are many."""
    return rounded(gaps_of(telemetry(spark, sf_dir), WEAK_DB))


@query(f"WITH {ROWS_SQL}, {AREAS_SQL} SELECT cluster, {r('latitude', 'longitude')}, n, severity FROM areas", "fx_telemetry")
def interference_areas(spark, sf_dir):
    """AG17: clusters of rows whose levels vary by more than 100 (population variance)."""
    return rounded(areas_of(telemetry(spark, sf_dir)))


REPORT_TEXTS = {
    "coverage gap": "plan one more site for each of the %d places where levels are weak",
    "interference": "levels vary widely in %d places: review tilt and azimuth of the antennas there",
    "capacity": "%d hours were far busier than most: add capacity",
    "none": "none of the three rules has found anything",
}


@query(
    f"""WITH {ROWS_SQL}, {GAPS_SQL}, {AREAS_SQL}, hour AS (SELECT date_trunc('hour', timestamp) AS h, count(*) AS n FROM fx_telemetry GROUP BY 1), st AS (SELECT min(h) AS h0, max(h) AS h1, sum(n) AS total, sum(n * n) AS squares FROM hour),
ms AS (SELECT total / k AS mean, sqrt((squares - total * total / k) / (k - 1)) AS sd FROM (SELECT *, date_diff('hour', h0, h1) + 1 AS k FROM st)),
f AS (SELECT 'coverage gap' AS kind, severity FROM gaps UNION ALL SELECT 'interference', severity FROM areas UNION ALL SELECT 'capacity', CASE WHEN n > mean + 3 * sd THEN 'high' ELSE 'medium' END FROM hour, ms WHERE n > mean + 2 * sd),
g AS (SELECT kind, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium FROM f GROUP BY kind UNION ALL SELECT 'none', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM f))
SELECT kind, n_high, n_medium, CASE kind {' '.join(f"WHEN '{k}' THEN printf('{t}', n_high + n_medium)" if '%d' in t else f"WHEN '{k}' THEN '{t}'" for k, t in REPORT_TEXTS.items())} END AS message FROM g""",
    "fx_telemetry",
)
def network_report(spark, sf_dir):
    """AG36, AG41, SC28: gaps, interference and busy hours by severity, each with its message; one row says so if there is nothing."""
    t = telemetry(spark, sf_dir)
    return report(gaps_of(t, WEAK_DB), areas_of(t), busy_hours(t))


def report(gaps: DataFrame, areas: DataFrame, hours: DataFrame) -> DataFrame:
    found = [df.select(F.lit(kind).alias("kind"), "severity") for kind, df in (("coverage gap", gaps), ("interference", areas), ("capacity", hours))]
    counted = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("kind").agg(F.count_if(c("severity") == "high").alias("n_high"), F.count_if(c("severity") == "medium").alias("n_medium"))
    nothing = counted.agg(F.count("*").alias("k")).filter("k = 0").select(F.lit("none").alias("kind"), F.lit(0).cast("long").alias("n_high"), F.lit(0).cast("long").alias("n_medium"))
    message = F.lit(REPORT_TEXTS["none"])
    for kind, text in REPORT_TEXTS.items():
        if "%d" in text:
            message = F.when(c("kind") == kind, F.format_string(text, c("n_high") + c("n_medium"))).otherwise(message)
    return counted.unionByName(nothing).withColumn("message", message)


VQ = "least(1, greatest(0, (llr_energy + abs(greatest(level_0_db, level_1_db))) / 100)) * 0.5 + greatest(0, 1 - abs(freq_offset_hz) / 1000) * 0.3 + greatest(0, 1 - abs(current_timing_offset_us) / 100) * 0.2"
WINDOW_SQL = f"""v AS (SELECT *, cfo_est * 300000000.0::DOUBLE / dl_carrier_freq AS v_cfo, {VQ} AS q, (current_timing_offset_us - initial_timing_offset_us) * 0.000001::DOUBLE * 300000000.0::DOUBLE AS drift, least(1, greatest(0, (llr_energy + abs(greatest(level_0_db, level_1_db))) / 100)) AS es FROM fx_telemetry)"""


def quality_of(t: DataFrame) -> DataFrame:
    best = F.array_max("channel_level_db")
    t = t.withColumn("v_cfo", S.doppler_velocity(c("cfo_est"), c("dl_carrier_freq"), S.ROUND_LIGHT)).withColumn("q", S.energy_velocity_quality(c("llr_energy"), best, c("freq_offset_hz"), c("current_timing_offset_us")))
    return t.withColumn("drift", (c("current_timing_offset_us") - c("initial_timing_offset_us")) * 1e-6 * S.ROUND_LIGHT).withColumn("es", S.energy_score(c("llr_energy"), best))


def integrated(t: DataFrame, span_ms: int) -> DataFrame:
    """WIN7, SC11, SC15, SC32: over the rows of the cell in the time after each row, means of both velocities and of the quality.

    The timing velocity of a row in the window is its drift over the time since the window's start, 0 at the start; the first
    row's energy weighs the two velocities.  A window of one row is that row's own estimate.

    Time is cut into blocks as long as the window: a row meets those of its own block and the next one, in a task of (cell,
    block), and sums as it goes, so neither a cell nor a window is ever held as a whole.
    """
    at = lambda ms: F.floor(c(ms) / span_ms)
    t = quality_of(t)
    later = t.select("pci", c("timestamp_ms").alias("_ms"), "drift", c("v_cfo").alias("_v"), c("q").alias("_q"), F.explode(F.array(at("timestamp_ms"), at("timestamp_ms") - 1)).alias("_b"))
    pairs = t.withColumn("_b", at("timestamp_ms")).join(later.withColumnRenamed("drift", "_drift"), ["pci", "_b"]).filter((c("_ms") >= c("timestamp_ms")) & (c("_ms") <= c("timestamp_ms") + span_ms))
    since = F.when(c("_ms") > c("timestamp_ms"), c("_drift") / ((c("_ms") - c("timestamp_ms")) / 1000.0)).otherwise(0.0)
    t = pairs.groupBy("pci", "_b", "event_id").agg(F.first("timestamp_ms").alias("timestamp_ms"), F.first("es").alias("es"), F.count("*").alias("samples"), F.avg("_v").alias("mean_cfo"), F.avg("_q").alias("quality"), F.avg(since).alias("mean_timing"))
    weight = F.when(c("es") > 0.5, 0.7).otherwise(0.3)
    return t.withColumn("combined", weight * c("mean_cfo") + (1 - weight) * c("mean_timing"))


@query(
    f"""WITH {WINDOW_SQL}, p AS (SELECT a.event_id, any_value(a.pci) AS pci, any_value(a.es) AS es, count(*) AS samples, avg(b.v_cfo) AS mean_cfo, avg(b.q) AS quality, sum(CASE WHEN b.timestamp_ms > a.timestamp_ms THEN b.drift / ((b.timestamp_ms - a.timestamp_ms) / 1000.0) ELSE 0 END) / count(*) AS mean_timing
  FROM v a JOIN v b ON a.pci = b.pci AND b.timestamp_ms BETWEEN a.timestamp_ms AND a.timestamp_ms + 600000 GROUP BY a.event_id)
SELECT event_id, pci, samples, {r('mean_cfo', 'quality')}, round(mean_timing, 6) + 0.0 AS mean_timing, round(CASE WHEN es > 0.5 THEN 0.7 * mean_cfo + 0.3 * mean_timing ELSE 0.3 * mean_cfo + 0.7 * mean_timing END, 6) + 0.0 AS combined FROM p""",
    "fx_telemetry",
)
def integrated_velocity(spark, sf_dir):
    """WIN7, SC11, SC15, SC32: integrated velocities over ten minutes (rows here are minutes apart)."""
    return rounded(integrated(telemetry(spark, sf_dir), 600_000).select("event_id", "pci", "samples", "mean_cfo", "quality", "mean_timing", "combined"), mean_timing=6, combined=6)


@query(
    f"""WITH {WINDOW_SQL}, h AS (SELECT unnest([100, 200, 500, 1000, 2000, 3000, 5000]) AS t), f AS (SELECT min(timestamp_ms) AS t0 FROM v), s AS (SELECT t, avg(q) * least(1, count(*) / 10) AS score FROM v, f, h WHERE timestamp_ms <= t0 + t GROUP BY t)
SELECT CAST(coalesce((SELECT t FROM s WHERE score > 0 ORDER BY score DESC, t LIMIT 1), 1000) AS INT) AS integration_ms""",
    "fx_telemetry",
)
def best_integration_time(spark, sf_dir):
    """WIN8, SC15: of seven windows from the first row on, the one whose mean quality, scaled by its number of rows up to ten, is best; the shortest of equals, 1000 ms without any."""
    t = quality_of(telemetry(spark, sf_dir)).select("timestamp_ms", "q")
    first = t.agg(F.min("timestamp_ms").alias("t0"))
    times = F.array(*map(F.lit, (100, 200, 500, 1000, 2000, 3000, 5000)))
    x = t.crossJoin(F.broadcast(first)).filter(c("timestamp_ms") <= c("t0") + 5000).withColumn("t", F.explode(F.filter(times, lambda h: c("timestamp_ms") <= c("t0") + h)))
    s = x.groupBy("t").agg((F.avg("q") * F.least(F.lit(1.0), F.count("*") / 10)).alias("score")).filter("score > 0")
    return s.agg(F.coalesce(F.max_by("t", F.struct("score", -c("t"))), F.lit(1000)).alias("integration_ms"))


@query(
    f"""WITH {MATCH_SQL}, s AS (SELECT (SELECT count(*) FROM fx_gps) AS n_gps, (SELECT count(*) FROM fx_telemetry) AS n_tel, count(*) AS n_match, count(DISTINCT pci) AS n_pci, avg(best_db) AS best, avg(abs(current_timing_offset_us)) AS timing, avg(llr_energy) AS llr, avg(horizontal_accuracy) AS acc FROM m)
SELECT n_gps, n_tel, n_match, n_pci, {r(match_rate='100.0 * n_match / n_gps', mean_best='best', mean_timing='timing', mean_llr='llr', mean_accuracy='acc')} FROM s""",
    "fx_gps",
    "fx_telemetry",
)
def replay_statistics(spark, sf_dir):
    """AG12: counts, match rate and means of a replay in one row."""
    m = matched(spark, sf_dir).agg(F.count("*").alias("n_match"), F.countDistinct("pci").alias("n_pci"), F.avg("best_db").alias("mean_best"), F.avg(F.abs("current_timing_offset_us")).alias("mean_timing"), F.avg("llr_energy").alias("mean_llr"), F.avg("horizontal_accuracy").alias("mean_accuracy"))
    out = view(spark, sf_dir, "fx_gps").agg(F.count("*").alias("n_gps")).crossJoin(view(spark, sf_dir, "fx_telemetry").agg(F.count("*").alias("n_tel"))).crossJoin(m)
    return rounded(out.withColumn("match_rate", 100.0 * c("n_match") / c("n_gps")))


@query(
    f"""WITH {MATCH_SQL}, e AS (SELECT v_fused - speed AS err, v_fused, speed FROM m WHERE speed > 0 AND 1 - dt_ms / 120000.0 > 0.5)
SELECT count(*) AS n, {r(mean_error='avg(err)', rmse='sqrt(avg(err * err))', correlation='corr(v_fused, speed)')}, count(*) FILTER (abs(v_fused) > 0.1) AS n_moving, count(*) FILTER (v_fused > 0.1) AS n_towards FROM e""",
    "fx_gps",
    "fx_telemetry",
)
def velocity_accuracy(spark, sf_dir):
    """AG42, FLT7, FLT8: estimated against positioned speed, rows that move and their direction."""
    m = matched(spark, sf_dir).filter((c("speed") > 0) & (1 - c("dt_ms") / 120_000.0 > 0.5)).withColumn("err", c("v_fused") - c("speed"))
    return rounded(m.agg(F.count("*").alias("n"), F.avg("err").alias("mean_error"), F.sqrt(F.avg(c("err") * c("err"))).alias("rmse"), F.corr("v_fused", "speed").alias("correlation"), F.count_if(F.abs("v_fused") > 0.1).alias("n_moving"), F.count_if(c("v_fused") > 0.1).alias("n_towards")))


@query(
    f"""SELECT CAST(dense_rank() OVER (ORDER BY round(latitude, 8), round(longitude, 8)) AS INT) AS place, {r('latitude', 'longitude')}, count(*) AS n, CAST(min(target_id) AS BIGINT) AS first_id FROM fx_targets GROUP BY latitude, longitude""",
    "fx_targets",
)
def place_groups(spark, sf_dir):
    """AG37: rows grouped by coordinate, numbered from 1 in order of latitude and longitude."""
    g = view(spark, sf_dir, "fx_targets").groupBy(F.round("latitude", 8).alias("latitude"), F.round("longitude", 8).alias("longitude")).agg(F.count("*").alias("n"), F.min("target_id").alias("first_id"))
    return rounded(numbered(g, ["latitude", "longitude"], "place").select("place", "latitude", "longitude", "n", "first_id"))


def numbered(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """Numbers distinct rows from 1 in order: each range of the sorted table is numbered by itself, after the rows of the ranges before it."""
    rows = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_k"))  # one row per range
    before = counts.select("_range", (F.sum("_k").over(Window.orderBy("_range")) - c("_k")).alias("_before"))
    place = c("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.join(F.broadcast(before), "_range").withColumn(to, place.cast("int")).drop("_range", "_before")


@query(
    "WITH k AS (SELECT target_id, latitude, longitude, row_number() OVER (PARTITION BY latitude, longitude ORDER BY target_id) AS n FROM fx_targets) SELECT target_id FROM k WHERE n = 1",
    "fx_targets",
)
def distinct_places(spark, sf_dir):
    """SET2, SET4: the first row of each place."""
    return view(spark, sf_dir, "fx_targets").groupBy("latitude", "longitude").agg(F.min("target_id").alias("target_id")).select("target_id")


@query(
    f"""WITH {MATCH_SQL} SELECT gps_id, event_id, {r('v_fused')}, CASE WHEN v_fused > 0 THEN 'towards' ELSE 'away' END AS direction FROM m WHERE abs(v_fused) > 0.1""",
    "fx_gps",
    "fx_telemetry",
)
def significant_motion(spark, sf_dir):
    """FLT7: rows whose velocity is more than 0.1 m/s, with its direction."""
    return rounded(matched(spark, sf_dir).filter(F.abs("v_fused") > 0.1).select("gps_id", "event_id", "v_fused", F.when(c("v_fused") > 0, "towards").otherwise("away").alias("direction")))


@query(
    f"""WITH {LOCATION_SQL} SELECT count(*) AS n, {r(mean_q='avg(location_score)', std_q='stddev_pop(location_score)', min_q='min(location_score)', max_q='max(location_score)')}, count(*) FILTER (location_score >= 0.8) AS n_excellent, count(*) FILTER (location_score >= 0.6 AND location_score < 0.8) AS n_good, count(*) FILTER (location_score >= 0.4 AND location_score < 0.6) AS n_fair, count(*) FILTER (location_score < 0.4) AS n_poor FROM sc""",
    "fx_telemetry",
)
def location_distribution(spark, sf_dir):
    """AG8: distribution of the location score."""
    q = c("location_score")
    return rounded(location_scores(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(q).alias("mean_q"), F.stddev_pop(q).alias("std_q"), F.min(q).alias("min_q"), F.max(q).alias("max_q"), *S.bands(q)))


@query(f"WITH {LOCATION_SQL} SELECT event_id, pci, {r('location_score')} FROM sc WHERE location_score >= 0.7 ORDER BY round(location_score, 9) DESC, event_id LIMIT 10", "fx_telemetry")
def best_locations(spark, sf_dir):
    """TOP2: the ten best rows of a score of 0.7 or more; scores alike to nine digits are equal, the smaller id first."""
    return rounded(location_scores(spark, sf_dir).filter("location_score >= 0.7").select("event_id", "pci", "location_score").orderBy(F.desc(F.round("location_score", 9)), "event_id").limit(10))


SYNC_SQL = "g AS (SELECT min(timestamp_ms) AS g0, max(timestamp_ms) AS g1 FROM fx_gps), t AS (SELECT min(timestamp_ms) AS t0, max(timestamp_ms) AS t1 FROM fx_telemetry)"


@query(f"WITH {SYNC_SQL} SELECT CASE WHEN t0 >= g0 - 300000 AND t1 <= g1 + 300000 THEN 'direct' WHEN t0 - 28800000 >= g0 - 300000 AND t1 - 28800000 <= g1 + 300000 THEN 'shifted' ELSE 'mismatch' END AS sync FROM g, t", "fx_gps", "fx_telemetry")
def time_synchronisation(spark, sf_dir):
    """SC29: whether telemetry lies in the time of the positions, as it is or shifted by a zone of eight hours."""
    g = view(spark, sf_dir, "fx_gps").agg(F.min("timestamp_ms").alias("g0"), F.max("timestamp_ms").alias("g1"))
    t = view(spark, sf_dir, "fx_telemetry").agg(F.min("timestamp_ms").alias("t0"), F.max("timestamp_ms").alias("t1"))
    return g.crossJoin(t).select(synchronised(-8 * 3_600_000).alias("sync"))


def synchronised(zone_ms: int, slack_ms: int = 300_000):
    inside = lambda by: (c("t0") + by >= c("g0") - slack_ms) & (c("t1") + by <= c("g1") + slack_ms)
    return F.when(inside(0), "direct").when(inside(zone_ms), "shifted").otherwise("mismatch")


@query(f"WITH {MATCH_SQL}, g AS (SELECT count(*) FILTER (sqrt(velocity_x * velocity_x + velocity_y * velocity_y + velocity_z * velocity_z) > 1) AS n_moving FROM fx_gps), e AS (SELECT count(*) FILTER (abs(v_fused) > 0.1) AS n_events FROM m) SELECT n_moving, n_events, NOT (n_moving > 10 AND n_events = 0) AS plausible FROM g, e", "fx_gps", "fx_telemetry")
def detection_check(spark, sf_dir):
    """SC30: positions that move without any motion found are not plausible."""
    g = view(spark, sf_dir, "fx_gps").agg(F.count_if(S.speed(c("velocity_x"), c("velocity_y"), c("velocity_z")) > 1).alias("n_moving"))
    e = matched(spark, sf_dir).agg(F.count_if(F.abs("v_fused") > 0.1).alias("n_events"))
    return g.crossJoin(e).select("n_moving", "n_events", (~((c("n_moving") > 10) & (c("n_events") == 0))).alias("plausible"))


REPLAY_RULES = (
    ("excellent", "fewer than five positions are excellent: measure more of that kind"),
    ("poor", "more than three in ten positions are poor: look into positioning and reception"),
    ("triangulation", "the best positions lie badly for triangulation: spread them out"),
    ("confidence", "the place of the transmitter is uncertain: better positions are needed"),
    ("match", "under half of the positions have telemetry close in time: compare the clocks"),
    ("signal", "levels are weak on average: move nearer or check the antenna"),
)

REPLAY_SQL = f"""WITH {TOP_SQL}, d AS (SELECT count(*) AS n, count(*) FILTER (overall_q >= 0.8) AS n_excellent, count(*) FILTER (overall_q < 0.4) AS n_poor, avg(best_db) AS level, 100.0 * count(*) / (SELECT count(*) FROM fx_gps) AS rate FROM m),
a AS (SELECT count(*) AS k, avg(overall_q) AS q, sqrt(pow((max(gps_lat) - min(gps_lat)) * 111000, 2) + pow((max(gps_lon) - min(gps_lon)) * 111000, 2)) AS spread FROM top),
x AS (SELECT *, CASE WHEN k < 3 THEN 0 ELSE greatest(0, least(1, 0.3 * least(k / 10, 1) + 0.3 * greatest(0, least(1, 1 - abs(spread - 1000) / 1000)) + 0.3 * q + 0.1)) END AS tri, CASE WHEN k < 3 THEN 0 ELSE q * (1 - least(spread / 1000, 0.5)) END AS conf FROM d, a)
SELECT unnest(list_filter([CASE WHEN n_excellent < 5 THEN 'excellent' END, CASE WHEN n_poor > n * 0.3 THEN 'poor' END, CASE WHEN tri < 0.6 THEN 'triangulation' END, CASE WHEN conf < 0.7 THEN 'confidence' END, CASE WHEN rate < 50 THEN 'match' END, CASE WHEN level < -80 THEN 'signal' END], lambda r: r IS NOT NULL)) AS rule FROM x"""


@query(REPLAY_SQL, "fx_gps", "fx_telemetry")
def replay_rules(spark, sf_dir):
    """SC27: the rules of a replay that apply; REPLAY_RULES has their messages."""
    return replay_messages(spark, sf_dir).select("rule")


def replay_messages(spark, sf_dir) -> DataFrame:
    m, top = matched(spark, sf_dir), best_positions(matched(spark, sf_dir))
    d = m.agg(F.count("*").alias("n"), F.count_if(c("overall_q") >= 0.8).alias("n_excellent"), F.count_if(c("overall_q") < 0.4).alias("n_poor"), F.avg("best_db").alias("level"))
    a = top.agg(F.count("*").alias("k"), F.avg("overall_q").alias("q"), F.sqrt(F.pow((F.max("gps_lat") - F.min("gps_lat")) * 111_000, 2) + F.pow((F.max("gps_lon") - F.min("gps_lon")) * 111_000, 2)).alias("spread"))
    x = d.crossJoin(a).crossJoin(view(spark, sf_dir, "fx_gps").agg(F.count("*").alias("n_gps")))
    few = c("k") < 3
    triangulation = F.when(few, 0.0).otherwise(S.clip(0.3 * F.least(c("k") / 10, F.lit(1.0)) + 0.3 * S.clip(1 - F.abs(c("spread") - 1000) / 1000) + 0.3 * c("q") + 0.1))
    sure = F.when(few, 0.0).otherwise(c("q") * (1 - F.least(c("spread") / 1000, F.lit(0.5))))
    holds = (c("n_excellent") < 5, c("n_poor") > c("n") * 0.3, triangulation < 0.6, sure < 0.7, 100.0 * c("n") / c("n_gps") < 50, c("level") < -80)
    each = F.array(*[F.when(h, F.struct(F.lit(n).alias("rule"), F.lit(t).alias("message"))) for h, (n, t) in zip(holds, REPLAY_RULES, strict=True)])
    return x.select(F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("e.*")


# type: priority, message, action
ADVICE = {
    "signal_quality": ("high", "the mean signal-to-noise ratio is only %.1f dB", "check the antenna and the way to the transmitter"),
    "motion_detection": ("medium", "%d motion events: measurements at rest would serve better", "keep still while measuring"),
    "coverage": ("medium", "%d areas have weak coverage", "measure in these areas"),
    "replay_analysis": ("medium", "%s", "go through the replay and adapt how you measure"),
    "velocity_accuracy": ("medium", "velocities are off by %.2f m/s on average", "calibrate the equipment anew"),
}


def _advice_sql(kind: str, source: str) -> str:
    priority, text, action = ADVICE[kind]
    return f"SELECT '{kind}' AS type, '{priority}' AS priority, printf('{text}', v) AS message, '{action}' AS action FROM {source}"


@query(
    f"""WITH snr AS (SELECT v FROM (SELECT avg(list_sum(ok) / len(ok) - 7) AS v FROM (SELECT list_filter([level_0_db, level_1_db], lambda x: x > -999) AS ok FROM fx_telemetry) WHERE len(ok) > 0) WHERE v < 10),
mot AS (SELECT v FROM (SELECT CAST(count(*) AS INT) AS v FROM (WITH {EVENTS_SQL} SELECT * FROM ev)) WHERE v > 10),
cov AS (SELECT v FROM (SELECT CAST(count(*) AS INT) AS v FROM (WITH {ROWS_SQL}, {GAPS_SQL} SELECT * FROM gaps)) WHERE v > 0),
rep AS (SELECT CASE rule {' '.join(f"WHEN '{n}' THEN '{t}'" for n, t in REPLAY_RULES)} END AS v FROM ({REPLAY_SQL})),
vel AS (SELECT v FROM (WITH {MATCH_SQL} SELECT avg(v_fused - speed) AS v FROM m WHERE speed > 0 AND 1 - dt_ms / 120000.0 > 0.5) WHERE abs(v) > 0.5)
{" UNION ALL ".join(_advice_sql(k, s) for k, s in zip(ADVICE, ("snr", "mot", "cov", "rep", "vel"), strict=True))}""",
    "fx_gps",
    "fx_telemetry",
)
def recommendations(spark, sf_dir):
    """SC26: all rules on telemetry, motion, coverage, replay and velocities that apply, with priority, message and action."""
    t = telemetry(spark, sf_dir)
    m = matched(spark, sf_dir).filter((c("speed") > 0) & (1 - c("dt_ms") / 120_000.0 > 0.5))
    found = {
        "signal_quality": t.agg(F.avg(S.array_mean(S.valid_levels(c("channel_level_db"))) - 7).alias("v")).filter("v < 10"),
        "motion_detection": motion_events(t).agg(F.count("*").cast("int").alias("v")).filter("v > 10"),
        "coverage": gaps_of(t, WEAK_DB).agg(F.count("*").cast("int").alias("v")).filter("v > 0"),
        "replay_analysis": replay_messages(spark, sf_dir).select(c("message").alias("v")),
        "velocity_accuracy": m.agg(F.avg(c("v_fused") - c("speed")).alias("v")).filter("abs(v) > 0.5"),
    }
    each = [df.select(F.lit(kind).alias("type"), F.lit(ADVICE[kind][0]).alias("priority"), F.format_string(ADVICE[kind][1], "v").alias("message"), F.lit(ADVICE[kind][2]).alias("action")) for kind, df in found.items()]
    return reduce(DataFrame.unionByName, each)


def _placements_sql(source: str) -> str:
    return f"""WITH cv AS (SELECT pci, avg(latitude) AS la, avg(longitude) AS lo FROM {source} GROUP BY pci HAVING count(*) >= 5),
ce AS (SELECT pci, avg(latitude) AS latitude, avg(longitude) AS longitude, count(*) AS n FROM {source} GROUP BY pci),
b AS (SELECT pci, max_by(struct_pack(e := event_id, x := llr_energy, la := latitude, lo := longitude), (llr_energy, -timestamp_ms, -event_id)) AS best FROM {source} GROUP BY pci),
j AS (SELECT ce.pci, min(cv.pci) AS area, count(*) AS n_areas FROM ce JOIN cv ON {HAVERSINE} < 1000 WHERE ce.n >= 3 GROUP BY ce.pci)
SELECT pci, area, n_areas, best.e AS event_id, {r(lat='best.la', lon='best.lo', confidence='least(1, best.x / 1000 * 0.9)')} FROM j JOIN b USING (pci)"""


def placed_near_areas(t: DataFrame) -> DataFrame:
    """JN4, TOP3: per cell of three rows or more the row of most energy, with the first coverage area less than 1,000 km from the
    cell's mean place, and how many there are.  Areas are those of cells of five rows or more."""
    cells = t.groupBy("pci").agg(F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"), F.count("*").alias("n"), F.max_by(F.struct("event_id", "llr_energy", "latitude", "longitude"), F.struct("llr_energy", -c("timestamp_ms"), -c("event_id"))).alias("best"))
    areas = cells.filter("n >= 5").select(c("pci").alias("area"), c("la").alias("ala"), c("lo").alias("alo"))
    j = within_sphere(cells.filter("n >= 3"), areas, 1000.0, ("la", "lo"), ("ala", "alo"))
    out = j.groupBy("pci").agg(F.min("area").alias("area"), F.count("*").alias("n_areas"), F.first("best").alias("best"))
    return rounded(out.select("pci", "area", "n_areas", "best.event_id", c("best.latitude").alias("lat"), c("best.longitude").alias("lon"), F.least(F.lit(1.0), c("best.llr_energy") / 1000 * 0.9).alias("confidence")))


@query(_placements_sql("fx_telemetry"), "fx_telemetry")
def placements(spark, sf_dir):
    """JN4, TOP3: placements in one town."""
    return placed_near_areas(view(spark, sf_dir, "fx_telemetry"))


@query(_placements_sql("fx_roaming"), "fx_roaming")
def roaming_placements(spark, sf_dir):
    """JN4, TOP3: placements all over the earth, at the poles and around 180 degrees, too."""
    return placed_near_areas(view(spark, sf_dir, "fx_roaming"))


def cluster_placement(t: DataFrame, k: int = 3) -> DataFrame:
    """AG19: per cell of three rows or more, the cluster of places whose mean energy times mean level is best.

    Clusters are those of a few rounds of k-means from the first places by id, one group per (cell, cluster) and round;
    a cell's rows are never in one task.
    """
    rows = t.withColumn("level", S.array_mean(S.valid_levels(c("channel_level_db")))).select("pci", "event_id", "latitude", "longitude", "altitude", "llr_energy", "level")
    first = rows.groupBy("pci", "latitude", "longitude").agg(F.min("event_id").alias("e"))
    rank = F.row_number().over(Window.partitionBy("pci").orderBy("e"))
    centres = first.withColumn("cluster", rank).filter(c("cluster") <= k).select("pci", "cluster", c("latitude").alias("cla"), c("longitude").alias("clo"))
    for _ in range(5):
        far = apart(c("latitude"), c("longitude"), c("cla"), c("clo"))
        held = rows.join(centres, "pci").groupBy("pci", "event_id").agg(F.min(F.struct(far.alias("d"), "cluster")).alias("x"), *[F.first(n).alias(n) for n in rows.columns if n not in ("pci", "event_id")]).withColumn("cluster", c("x.cluster")).drop("x")
        centres = cut(held.groupBy("pci", "cluster").agg(F.avg("latitude").alias("cla"), F.avg("longitude").alias("clo")))
    a = held.groupBy("pci", "cluster").agg(F.count("*").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.avg("altitude").alias("altitude"), (F.avg("llr_energy") * (F.avg("level") + 100) / 1000).alias("q"))
    enough = rows.groupBy("pci").count().filter("count >= 3").select("pci")
    best = a.join(enough, "pci").groupBy("pci").agg(F.max_by(F.struct("latitude", "longitude", "altitude", "n", "q"), F.struct(F.round("q", 9), -c("cluster"))).alias("b")).select("pci", "b.*")
    return best.withColumn("confidence", F.least(c("q"), F.lit(1.0))).withColumn("quality", F.when(c("confidence") > 0.5, "good").otherwise("fair")).drop("q")


def _cluster_placements_sql(rounds: int = 5) -> str:
    out = f"""{ROWS_SQL}, x AS (SELECT pci, event_id, latitude, longitude, altitude, llr_energy, CASE WHEN len(ok) > 0 THEN list_sum(ok) / len(ok) END AS level FROM l),
f AS (SELECT pci, latitude, longitude, min(event_id) AS e FROM x GROUP BY pci, latitude, longitude), k0 AS (SELECT pci, row_number() OVER (PARTITION BY pci ORDER BY e) AS cluster, latitude AS la, longitude AS lo FROM f QUALIFY cluster <= 3)"""
    for i in range(rounds):
        near = "round((pow(x.latitude - k.la, 2) + pow(x.longitude - k.lo, 2)) * 100000000, 6)"
        out += f""", d{i} AS (SELECT x.pci, x.event_id, min_by(k.cluster, ({near}, k.cluster)) AS cluster FROM x JOIN k{i} k ON x.pci = k.pci GROUP BY x.pci, x.event_id),
k{i + 1} AS (SELECT pci, cluster, avg(latitude) AS la, avg(longitude) AS lo FROM x JOIN d{i} USING (pci, event_id) GROUP BY pci, cluster)"""
    return out + f""", a AS (SELECT pci, cluster, count(*) AS n, avg(latitude) AS latitude, avg(longitude) AS longitude, avg(altitude) AS altitude, avg(llr_energy) * (avg(level) + 100) / 1000 AS q FROM x JOIN d{rounds - 1} USING (pci, event_id) GROUP BY pci, cluster),
b AS (SELECT *, row_number() OVER (PARTITION BY pci ORDER BY round(q, 9) DESC, cluster) AS i FROM a WHERE pci IN (SELECT pci FROM x GROUP BY pci HAVING count(*) >= 3))
SELECT pci, {r('latitude', 'longitude', 'altitude', confidence='least(q, 1)')}, n, CASE WHEN least(q, 1) > 0.5 THEN 'good' ELSE 'fair' END AS quality FROM b WHERE i = 1"""


@query(f"WITH {_cluster_placements_sql()}", "fx_telemetry")
def cluster_placements(spark, sf_dir):
    """AG19: see cluster_placement."""
    return rounded(cluster_placement(telemetry(spark, sf_dir)))
