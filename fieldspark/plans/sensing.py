"""Bistatic sensing in full: geometry, Doppler, margins, flags, scenarios with all layers, static paths off facades."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo as G
from ..functions import radio as R
from ..functions import text as X
from ..operators.spatial import within
from ..sources.views import view, with_views
from .field import BAND_HZ, FIGURE_DB, HZ, LOOSE, PLACED_SQL, RX, RX_FEED, RX_GAIN, TIME_S, TX, _ecef_sql, _far, near, placed
from .measurement import r, rounded
from .obstacles import BUILT_SQL, buildings

Q, SQL = {}, {}
c = F.col
#: The scenario of the queries: motion, limits and the direct path.
SPEED, HEADING, CLIMB = 20.0, 60.0, 1.0
NEED_SNR, NEED_DIRECT, DYNAMIC_DB, DIRECT_DBM, RESIDUAL_DBM, NOTCH_HZ, PRF_HZ = 10.0, -3.0, 90.0, -55.0, -105.0, 12.0, 2000.0
#: Bits of the failure code.
SNR, UNRESOLVED, AMBIGUOUS, DIRECT, DYNAMIC, UNQUALIFIED = 1, 2, 4, 8, 16, 32


def query(sql: str | None = None, *names: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


def sensed(t: DataFrame, rcs=10.0, speed=SPEED, heading=HEADING, climb=CLIMB, need=NEED_SNR, gain_db: float | None = None, height=30.0) -> DataFrame:
    """JOB7, RF21-RF23: all sensing columns of each target; numbers or columns of a scenario."""
    col = lambda x: x if hasattr(x, "alias") else F.lit(float(x))
    rcs, speed, heading, climb, need, height = map(col, (rcs, speed, heading, climb, need, height))
    t = t.withColumns({"_rcs": rcs, "_speed": speed, "_heading": heading, "_climb": climb, "_need": need})
    lat, lon = c("latitude"), c("longitude")
    for name, p in (("_t", R.ecef(lat, lon, c("z_ground_m") + height)), ("_a", R.ecef(*map(F.lit, TX))), ("_b", R.ecef(*map(F.lit, RX)))):
        t = t.withColumns({f"{name}{i}": e for i, e in enumerate(p)})
    at = lambda n: tuple(c(f"{n}{i}") for i in range(3))
    t = t.withColumns({"tx_range_m": R.distance3(at("_t"), at("_a")), "rx_range_m": R.distance3(at("_t"), at("_b")), "direct_m": R.distance3(at("_a"), at("_b"))})
    # a target at the transmitter's or the receiver's place has no direction, and no Doppler shift
    t = t.withColumns({f"_s{i}": R.quotient(c(f"_t{i}") - c(f"_a{i}"), c("tx_range_m")) + R.quotient(c(f"_t{i}") - c(f"_b{i}"), c("rx_range_m")) for i in range(3)})
    a, o = F.radians(lat), F.radians(lon)
    s, k = at("_s"), -HZ / R.LIGHT
    t = t.withColumns(
        {
            "doppler_east": k * (-F.sin(o) * s[0] + F.cos(o) * s[1]),
            "doppler_north": k * (-F.sin(a) * F.cos(o) * s[0] - F.sin(a) * F.sin(o) * s[1] + F.cos(a) * s[2]),
            "doppler_up": k * (F.cos(a) * F.cos(o) * s[0] + F.cos(a) * F.sin(o) * s[1] + F.sin(a) * s[2]),
        }
    )
    v = R.ecef_velocity(lat, lon, c("_speed"), c("_heading"), c("_climb"))
    t = t.withColumn("range_rate_mps", sum((x * y for x, y in zip(v[1:], s[1:], strict=True)), v[0] * s[0])).withColumn("doppler_hz", k * c("range_rate_mps"))
    t = t.withColumn("sensitivity", F.sqrt(F.pow("doppler_east", 2) + F.pow("doppler_north", 2) + F.pow("doppler_up", 2)))
    bar = max(1 / TIME_S, NOTCH_HZ)
    t = t.withColumn("min_speed_mps", F.when(c("sensitivity") > 1e-9, bar / c("sensitivity")))
    t = t.withColumn("excess_delay_s", (c("tx_range_m") + c("rx_range_m") - c("direct_m")) / R.LIGHT)
    # A return loss that the table brings stands.
    back = c("return_loss_db") if "return_loss_db" in t.columns else 20 * F.log10(4 * math.pi * F.greatest(c("rx_range_m"), F.lit(1.0)) / (R.LIGHT / HZ))
    echo = c("incident_power_dbm") - back + RX_GAIN - RX_FEED + R.scattering_db(c("_rcs"), F.lit(HZ))
    t = t.withColumn("return_loss_db", back).withColumn("echo_dbm", echo)
    gain = 10 * math.log10(BAND_HZ * TIME_S) if gain_db is None else gain_db
    t = t.withColumn("snr_db", c("echo_dbm") - R.thermal_noise_dbm(BAND_HZ / 1e6, FIGURE_DB) + gain)
    t = t.withColumns({"margin_db": c("snr_db") - c("_need"), "direct_margin_db": c("echo_dbm") - RESIDUAL_DBM - NEED_DIRECT, "cancellation_db": F.greatest(F.lit(0.0), DIRECT_DBM - c("echo_dbm") + NEED_DIRECT), "dynamic_margin_db": DYNAMIC_DB - (DIRECT_DBM - c("echo_dbm"))})
    t = t.withColumn("power_margin_db", F.least("margin_db", "direct_margin_db", "dynamic_margin_db")).withColumn("min_rcs_m2", c("_rcs") * F.pow(F.lit(10.0), -c("power_margin_db") / 10))
    bits = ((c("margin_db") < 0, SNR), (F.abs("doppler_hz") < bar, UNRESOLVED), (F.abs("doppler_hz") > PRF_HZ / 2, AMBIGUOUS), (c("direct_margin_db") < 0, DIRECT), (c("dynamic_margin_db") < 0, DYNAMIC), (F.lit(gain_db is None), UNQUALIFIED))
    t = t.withColumn("failure", sum((F.when(x, bit).otherwise(0) for x, bit in bits[1:]), F.when(bits[0][0], bits[0][1]).otherwise(0)))
    t = t.withColumn("screening", c("failure").bitwiseAND(F.lit(31)) == 0).withColumn("qualified", c("failure") == 0)
    return t.drop(*[n for n in t.columns if n.startswith("_")])


def sensed_sql(source: str = "fx_targets", rcs: str = "10", height: str = "30", speed: str = "20", need: str = "10", qualified: bool = False, back: str = "20 * log10(4 * pi() * greatest(rx_range_m, 1) / (299792458.0::DOUBLE / 3500000000.0::DOUBLE))") -> str:
    k = "(-3500000000.0::DOUBLE / 299792458.0::DOUBLE)"
    unit = ", ".join(f"(t{x} - a{x}) / tx_range_m + (t{x} - c{x}) / rx_range_m AS s{x}" for x in "xyz")
    return f"""e AS (SELECT *, radians(latitude) AS la, radians(longitude) AS lo, {_ecef_sql('t', 'latitude', 'longitude', f'(z_ground_m + {height})')}, {_ecef_sql('a', '38.002::DOUBLE', '-121.499::DOUBLE', '40.0::DOUBLE')}, {_ecef_sql('c', '38.02::DOUBLE', '-121.48::DOUBLE', '12.0::DOUBLE')} FROM {source}),
g AS (SELECT *, {_far('t', 'a')} AS tx_range_m, {_far('t', 'c')} AS rx_range_m, {_far('a', 'c')} AS direct_m FROM e), u AS (SELECT *, {unit} FROM g),
d AS (SELECT *, {k} * (-sin(lo) * sx + cos(lo) * sy) AS doppler_east, {k} * (-sin(la) * cos(lo) * sx - sin(la) * sin(lo) * sy + cos(la) * sz) AS doppler_north, {k} * (cos(la) * cos(lo) * sx + cos(la) * sin(lo) * sy + sin(la) * sz) AS doppler_up,
  incident_power_dbm - {back} + 12 - 1 + 10 * log10({rcs}) + 10 * log10(4 * pi()) - 20 * log10(299792458.0::DOUBLE / 3500000000.0::DOUBLE) AS echo_dbm FROM u),
h AS (SELECT *, doppler_east * {speed} * sin(radians(60)) + doppler_north * {speed} * cos(radians(60)) + doppler_up * 1 AS doppler_hz, sqrt(pow(doppler_east, 2) + pow(doppler_north, 2) + pow(doppler_up, 2)) AS sensitivity, (tx_range_m + rx_range_m - direct_m) / 299792458.0::DOUBLE AS excess_delay_s,
  echo_dbm - (-174 + 10 * log10(20000000) + 5) + {'60' if qualified else '10 * log10(20000000 * 0.1)'} AS snr_db, echo_dbm + 105 + 3 AS direct_margin_db, greatest(0, -55 - echo_dbm - 3) AS cancellation_db, 90 - (-55 - echo_dbm) AS dynamic_margin_db FROM d),
m AS (SELECT *, snr_db - {need} AS margin_db, least(snr_db - {need}, direct_margin_db, dynamic_margin_db) AS power_margin_db FROM h),
f AS (SELECT *, CAST((CASE WHEN margin_db < 0 THEN 1 ELSE 0 END) + (CASE WHEN abs(doppler_hz) < 12 THEN 2 ELSE 0 END) + (CASE WHEN abs(doppler_hz) > 1000 THEN 4 ELSE 0 END) + (CASE WHEN direct_margin_db < 0 THEN 8 ELSE 0 END) + (CASE WHEN dynamic_margin_db < 0 THEN 16 ELSE 0 END) + {0 if qualified else 32} AS INT) AS failure FROM m)"""


WIDE = LOOSE | {n: 4 for n in ("doppler_east", "doppler_north", "doppler_up", "doppler_hz", "min_speed_mps", "direct_margin_db", "cancellation_db", "dynamic_margin_db", "min_rcs_log")}


@query(f"WITH {sensed_sql()} SELECT target_id, {near(doppler_east='doppler_east', doppler_north='doppler_north', doppler_up='doppler_up', doppler_hz='doppler_hz', min_speed_mps='12 / sensitivity', echo_dbm='echo_dbm', snr_db='snr_db', margin_db='margin_db', direct_margin_db='direct_margin_db', cancellation_db='cancellation_db', dynamic_margin_db='dynamic_margin_db', min_rcs_log='log10(10 * pow(10, -power_margin_db / 10))')}, failure, failure & 31 = 0 AS screening, failure = 0 AS qualified FROM f", "fx_targets")
def sensing_table(spark, sf_dir):
    """JOB7, RF21-RF23: Doppler basis and shift, least speed, echo, margins, required cancellation, least cross section and failure bits."""
    x = sensed(view(spark, sf_dir, "fx_targets")).withColumn("min_rcs_log", F.log10("min_rcs_m2"))
    return rounded(x.select("target_id", "doppler_east", "doppler_north", "doppler_up", "doppler_hz", "min_speed_mps", "echo_dbm", "snr_db", "margin_db", "direct_margin_db", "cancellation_db", "dynamic_margin_db", "min_rcs_log", "failure", "screening", "qualified"), **WIDE)


@query(f"WITH {sensed_sql(qualified=True)} SELECT count(*) AS n, count(*) FILTER (failure & 1 = 0) AS n_snr, count(*) FILTER (failure & 2 = 0) AS n_resolved, count(*) FILTER (failure & 31 = 0) AS n_screening, count(*) FILTER (failure = 0) AS n_qualified, arg_max(target_id, (round(margin_db, 6), -target_id)) AS best_id, arg_max(target_id, (round(margin_db, 6), -target_id)) FILTER (failure & 31 = 0) AS best_screening_id FROM f", "fx_targets")
def sensing_summary(spark, sf_dir):
    """AG23: targets by flag, and the one of best margin, overall and among those that pass."""
    x = sensed(view(spark, sf_dir, "fx_targets"), gain_db=60.0)
    by = F.struct(F.round("margin_db", 6), -c("target_id"))
    bit = lambda b: c("failure").bitwiseAND(F.lit(b)) == 0
    return x.agg(F.count("*").alias("n"), F.count_if(bit(SNR)).alias("n_snr"), F.count_if(bit(UNRESOLVED)).alias("n_resolved"), F.count_if("screening").alias("n_screening"), F.count_if("qualified").alias("n_qualified"), F.max_by("target_id", by).alias("best_id"), F.max_by("target_id", F.when(c("screening"), by)).alias("best_screening_id"))


#: What-if scenarios over stored defaults: null keeps the default; a moved receiver is rejected.
WHATIF = ((1, 1.0, None, None, None), (2, None, 5.0, None, None), (3, 100.0, 40.0, 13.0, None), (4, None, None, None, 38.5))


@query(
    f"""WITH sc(scenario, rcs, speed, need, rx_lat) AS (VALUES (1, 1.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE), (2, NULL, 5.0, NULL, NULL), (3, 100.0, 40.0, 13.0, NULL), (4, NULL, NULL, NULL, 38.5)),
st AS (SELECT scenario, coalesce(rcs, 10) AS rcs, coalesce(speed, 20) AS speed, coalesce(need, 10) AS need FROM sc WHERE rx_lat IS NULL), sx AS (SELECT * FROM fx_targets, st), {sensed_sql('sx', 'rcs', '30', 'speed', 'need', True)}
SELECT scenario, target_id, {near(echo_dbm='echo_dbm', snr_db='snr_db', margin_db='margin_db', doppler_hz='doppler_hz', direct_margin_db='direct_margin_db', dynamic_margin_db='dynamic_margin_db', cancellation_db='cancellation_db')}, failure FROM f""",
    "fx_targets",
)
def whatif_layers(spark, sf_dir):
    """JOB9, JOB10, JN35: each valid scenario's overrides over the defaults, key by key, and its layers for all targets."""
    return rounded(scenarios(spark, sf_dir).select("scenario", "target_id", "echo_dbm", "snr_db", "margin_db", "doppler_hz", "direct_margin_db", "dynamic_margin_db", "cancellation_db", "failure"), **WIDE)


def scenarios(spark, sf_dir) -> DataFrame:
    s = spark.createDataFrame(list(WHATIF), "scenario int, rcs double, speed double, need double, rx_lat double").filter(c("rx_lat").isNull())
    held = view(spark, sf_dir, "fx_targets").crossJoin(F.broadcast(s.withColumns({n: F.coalesce(n, F.lit(d)) for n, d in (("rcs", 10.0), ("speed", SPEED), ("need", NEED_SNR))}).drop("rx_lat")))
    return sensed(held, c("rcs"), c("speed"), need=c("need"), gain_db=60.0)


@query("WITH sc(scenario, rx_lat) AS (VALUES (1, NULL), (2, NULL), (3, NULL), (4, 38.5)), t AS (SELECT count(*) AS n FROM fx_targets) SELECT scenario, CASE WHEN rx_lat IS NOT NULL THEN 'receiver moved: rebuild the product' END AS rejected, CASE WHEN rx_lat IS NULL THEN n ELSE 0 END AS n_targets FROM sc, t", "fx_targets")
def whatif_rejections(spark, sf_dir):
    """JOB9: scenarios that the stored table can't answer, and the targets each one covers."""
    s = spark.createDataFrame(list(WHATIF), "scenario int, rcs double, speed double, need double, rx_lat double")
    n = view(spark, sf_dir, "fx_targets").agg(F.count("*").alias("n"))
    return s.crossJoin(n).select("scenario", F.when(c("rx_lat").isNotNull(), "receiver moved: rebuild the product").alias("rejected"), F.when(c("rx_lat").isNull(), c("n")).otherwise(0).alias("n_targets"))


HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1, pow(sin((radians({a}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({a})) * pow(sin((radians({c}) - radians({d})) / 2), 2))))"
HOR = f"greatest(0, {HAV.format(a='latitude', b='38.002::DOUBLE', c='longitude', d='-121.499::DOUBLE')} + {HAV.format(a='latitude', b='38.02::DOUBLE', c='longitude', d='-121.48::DOUBLE')} - {HAV.format(a='38.02::DOUBLE', b='38.002::DOUBLE', c='-121.48::DOUBLE', d='-121.499::DOUBLE')}) / 299792458.0::DOUBLE"


def surface_m(lat, lon, lat0, lon0):
    h = F.pow(F.sin((F.radians(lat) - F.radians(lat0)) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * F.pow(F.sin((F.radians(lon) - F.radians(lon0)) / 2), 2)
    return 2 * 6_371_000.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


@query(f"WITH h AS (SELECT target_id, {HOR} AS s FROM fx_targets) SELECT target_id, round(s * 1000000000, 5) + 0.0 AS delay_ns FROM h", "fx_targets")
def horizontal_delays(spark, sf_dir):
    """JOB14: excess delay over the surface."""
    return rounded(with_delay(view(spark, sf_dir, "fx_targets")).select("target_id", (c("delay_s") * 1e9).alias("delay_ns")), delay_ns=5)


def with_delay(t: DataFrame) -> DataFrame:
    a, b = (F.lit(TX[0]), F.lit(TX[1])), (F.lit(RX[0]), F.lit(RX[1]))
    return t.withColumn("delay_s", F.greatest(F.lit(0.0), surface_m(c("latitude"), c("longitude"), *a) + surface_m(c("latitude"), c("longitude"), *b) - surface_m(*b, *a)) / R.LIGHT)


PATHS_SQL = f"h AS (SELECT *, {HOR} AS delay_s FROM fx_targets), pa AS (SELECT obstacle_id, (site_id * 40 + start_m) / 299792458.0::DOUBLE AS delay_s FROM fx_obstacles), o AS (SELECT CAST(round_even(delay_s * 20000000, 0) AS BIGINT) AS bin, count(*) AS n FROM pa GROUP BY 1)"


def static_paths(spark, sf_dir) -> DataFrame:
    """Delays of static reflectors, from the obstacles."""
    return view(spark, sf_dir, "fx_obstacles").select("obstacle_id", ((c("site_id") * 40 + c("start_m")) / R.LIGHT).alias("delay_s"))


@query(
    f"""WITH {PATHS_SQL}, g AS (SELECT h.*, (target_id % 40) - 20 AS doppler_hz, CAST(round_even(delay_s * 20000000, 0) AS BIGINT) AS bin FROM h)
SELECT target_id, abs(doppler_hz) <= 5 AND o.n IS NOT NULL AS overlap, CASE WHEN abs(doppler_hz) <= 5 THEN coalesce(o.n, 0) ELSE 0 END AS n_paths, CAST(round((SELECT min(abs(g.delay_s - pa.delay_s)) FROM pa) * 1000000, 6) + 0.0 AS DOUBLE) AS nearest_us FROM g LEFT JOIN o USING (bin)""",
    "fx_targets",
    "fx_obstacles",
)
def static_background(spark, sf_dir):
    """JN26, AG31: static paths in a target's delay cell, where its Doppler shift is within half a cell; and the nearest path's delay.

    The nearest delay comes from one sorted pass each way over targets and paths, cut into ranges of delay with the last path before and
    the first after each range carried in.
    """
    t = with_delay(view(spark, sf_dir, "fx_targets")).withColumn("doppler_hz", c("target_id") % 40 - 20).withColumn("bin", F.rint(c("delay_s") * BAND_HZ).cast("long"))
    p = static_paths(spark, sf_dir)
    n = p.groupBy(F.rint(c("delay_s") * BAND_HZ).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    same = F.abs("doppler_hz") <= 5
    x = t.join(n, "bin", "left").select("target_id", "delay_s", (same & c("n").isNotNull()).alias("overlap"), F.when(same, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_paths"))
    gaps = nearest_gap(t.select("target_id", "delay_s"), p.select("delay_s"), "target_id", "delay_s")
    return rounded(x.join(gaps, "target_id").select("target_id", "overlap", "n_paths", (c("gap") * 1e6).alias("nearest_us")), nearest_us=6)


def nearest_gap(left: DataFrame, right: DataFrame, key: str, at: str, cells: int = 1024) -> DataFrame:
    """The distance of each left value to the nearest right one.  Values are dealt to equal cells between the extremes; a cell also gets the
    greatest right value of the cells before it and the least of those after it (one row per cell), so no value outside is needed."""
    span = right.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    cell = F.greatest(F.lit(-1), F.least(F.lit(cells), F.floor((c(at) - c("lo")) / F.greatest(c("hi") - c("lo"), F.lit(1e-300)) * cells))).cast("int")
    dealt = lambda df: df.crossJoin(F.broadcast(span)).withColumn("cell", cell).drop("lo", "hi")
    held = dealt(right)
    ends = held.groupBy("cell").agg(F.min(at).alias("least"), F.max(at).alias("most"))
    every = left.sparkSession.range(-1, cells + 1).select(c("id").cast("int").alias("cell")).join(ends, "cell", "left")
    order = Window.orderBy("cell")  # of so many cells, not rows
    carried = every.select("cell", F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("a"), F.min("least").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("b"))
    own = dealt(left).join(F.broadcast(carried), "cell")
    rows = own.select("cell", c(at).alias("v"), key, "a", "b", F.lit(None).cast("double").alias("r")).unionByName(held.select("cell", c(at).alias("v"), F.lit(None).cast("long").alias(key), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), c(at).alias("r")))
    by = Window.partitionBy("cell")
    before = F.max("r").over(by.orderBy("v", c(key).isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.min("r").over(by.orderBy(F.desc("v"), c(key).isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select(key, "v", F.coalesce(before, "a").alias("p"), F.coalesce(after, "b").alias("q")).filter(c(key).isNotNull())
    return found.select(key, F.least(c("v") - c("p"), c("q") - c("v")).alias("gap"))


@query(
    f"""WITH {PATHS_SQL}, g AS (SELECT target_id, delay_s, CAST(round_even(delay_s * 20000000, 0) AS BIGINT) AS bin FROM h WHERE target_id % 20 = 0), q AS (SELECT obstacle_id, delay_s AS path_s, CAST(round_even(delay_s * 20000000, 0) AS BIGINT) AS bin FROM pa),
j AS (SELECT target_id, obstacle_id, row_number() OVER (PARTITION BY target_id ORDER BY round(abs(delay_s - path_s) * 1000000000000, 0), obstacle_id) AS rank FROM g JOIN q USING (bin)) SELECT target_id, obstacle_id, CAST(rank AS INT) AS rank FROM j WHERE rank <= 20""",
    "fx_targets",
    "fx_obstacles",
)
def cell_contributors(spark, sf_dir):
    """JN27: for the selected targets the 20 paths of their delay cell that are nearest in delay."""
    t = with_delay(view(spark, sf_dir, "fx_targets").filter("target_id % 20 = 0")).withColumn("bin", F.rint(c("delay_s") * BAND_HZ).cast("long")).select("target_id", "delay_s", "bin")
    p = static_paths(spark, sf_dir).select("obstacle_id", c("delay_s").alias("path_s"), F.rint(c("delay_s") * BAND_HZ).cast("long").alias("bin"))
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.rint(F.abs(c("delay_s") - c("path_s")) * 1e12), "obstacle_id"))
    return t.join(p, "bin").withColumn("rank", rank).filter("rank <= 20").select("target_id", "obstacle_id", "rank")


@query(f"WITH {sensed_sql()}, w AS (SELECT excess_delay_s AS d0, doppler_hz AS f0 FROM f ORDER BY target_id LIMIT 1) SELECT target_id FROM f, w WHERE abs(excess_delay_s - d0) <= 0.5 / 20000000 AND abs(doppler_hz - f0) <= 5", "fx_targets")
def cell_mates(spark, sf_dir):
    """JN28: targets in the delay and Doppler cell of the first one."""
    x = sensed(view(spark, sf_dir, "fx_targets")).select("target_id", "excess_delay_s", "doppler_hz")
    one = x.agg(F.min_by(F.struct("excess_delay_s", "doppler_hz"), "target_id").alias("w"))
    return x.crossJoin(F.broadcast(one)).filter((F.abs(c("excess_delay_s") - c("w.excess_delay_s")) <= 0.5 / BAND_HZ) & (F.abs(c("doppler_hz") - c("w.doppler_hz")) <= 5)).select("target_id")


# Facades: the link goes from a transmitter at the origin to a receiver, in metres.
RX_E, RX_N, REACH = 900.0, 700.0, 1500.0
WALLS_SQL = f"""{BUILT_SQL}, cr AS (SELECT building_id, cx, cy, h, k, cx + h * [-1, 1, 1, -1, -1][k::INT] AS ax, cy + h * [-1, -1, 1, 1, -1][k::INT] AS ay, cx + h * [-1, 1, 1, -1, -1][(k + 1)::INT] AS bx, cy + h * [-1, -1, 1, 1, -1][(k + 1)::INT] AS by_ FROM bd, (SELECT unnest(range(1, 5)) AS k)),
rf AS (SELECT *, bx - ax AS vx, by_ - ay AS vy, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM cr),
im AS (SELECT *, 2 * (ax + ((900 - ax) * vx + (700 - ay) * vy) / (len * len) * vx) - 900 AS ix, 2 * (ay + ((900 - ax) * vx + (700 - ay) * vy) / (len * len) * vy) - 700 AS iy FROM rf WHERE len >= 0.25),
ht AS (SELECT *, ix * vy - iy * vx AS cross_, (ax * vy - ay * vx) / nullif(ix * vy - iy * vx, 0) AS t, (ax * iy - ay * ix) / nullif(ix * vy - iy * vx, 0) AS w FROM im),
bo AS (SELECT *, t * ix AS px, t * iy AS py FROM ht WHERE abs(cross_) > 0.000000000001 AND t BETWEEN 0 AND 1 AND w >= 0 AND w <= 1),
ok AS (SELECT *, sqrt(px * px + py * py) AS d1, sqrt(pow(900 - px, 2) + pow(700 - py, 2)) AS d2 FROM bo WHERE w * len >= greatest(0.85, 0.06 * len) AND (1 - w) * len >= greatest(0.85, 0.06 * len)),
sp AS (SELECT *, d1 + d2 - sqrt(900 * 900 + 700 * 700) AS excess_m FROM ok WHERE d1 >= 2 AND d2 >= 2)"""


def walls(b: DataFrame, shortest_m: float = 0.25) -> DataFrame:
    """SPA13: edges of closed outlines, without very short ones."""
    w = b.select("building_id", F.posexplode(G.edges(c("ring"))).alias("k", "e")).select("building_id", (c("k") + 1).alias("k"), "e")
    return w.withColumn("len", F.sqrt(F.pow(c("e.q.x") - c("e.p.x"), 2) + F.pow(c("e.q.y") - c("e.p.y"), 2))).filter(c("len") >= shortest_m)


def bounces(w: DataFrame, rx_e: float = RX_E, rx_n: float = RX_N) -> DataFrame:
    """JN24, SPA14: where a path from the origin to the receiver bounces off each wall, by the receiver's mirror image; bounces near a corner or an end are none."""
    w = w.withColumns(dict(zip(("ix", "iy"), G.mirrored(F.lit(rx_e), F.lit(rx_n), c("e")), strict=True)))
    vx, vy = c("e.q.x") - c("e.p.x"), c("e.q.y") - c("e.p.y")
    cross = c("ix") * vy - c("iy") * vx
    w = w.withColumn("t", F.when(F.abs(cross) > 1e-12, (c("e.p.x") * vy - c("e.p.y") * vx) / cross)).withColumn("w", F.when(F.abs(cross) > 1e-12, (c("e.p.x") * c("iy") - c("e.p.y") * c("ix")) / cross))
    w = w.filter(c("t").between(0, 1) & c("w").between(0, 1)).withColumn("px", c("t") * c("ix")).withColumn("py", c("t") * c("iy"))
    corner = F.greatest(F.lit(0.85), 0.06 * c("len"))
    w = w.filter((c("w") * c("len") >= corner) & ((1 - c("w")) * c("len") >= corner))
    w = w.withColumn("d1", F.sqrt(c("px") * c("px") + c("py") * c("py"))).withColumn("d2", F.sqrt(F.pow(rx_e - c("px"), 2) + F.pow(rx_n - c("py"), 2)))
    return w.filter("d1 >= 2 AND d2 >= 2").withColumn("excess_m", c("d1") + c("d2") - math.hypot(rx_e, rx_n))


@query(f"WITH {WALLS_SQL}, rk AS (SELECT *, row_number() OVER (ORDER BY round(excess_m, 6), building_id, k) AS rank FROM sp) SELECT building_id, CAST(k AS INT) AS k, CAST(rank AS INT) AS rank, {r('px', 'py', 'd1', 'd2', 'excess_m')} FROM rk WHERE rank <= 64", "fx_sites")
def facade_candidates(spark, sf_dir):
    """SPA13, SPA14, SPA21, JN24, TOP4: the 64 specular paths of least excess off all walls."""
    return rounded(candidates(spark, sf_dir).select("building_id", "k", "rank", "px", "py", "d1", "d2", "excess_m"))


def candidates(spark, sf_dir, most: int = 64) -> DataFrame:
    order = [F.round("excess_m", 6), "building_id", "k"]
    top = bounces(walls(buildings(spark, sf_dir))).orderBy(*order).limit(most)  # a top-k: each task keeps so many
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


LEG = "greatest(coalesce(least((cx - h - {x0}) / nullif({dx}, 0), (cx + h - {x0}) / nullif({dx}, 0)), -1), coalesce(least((cy - h - {y0}) / nullif({dy}, 0), (cy + h - {y0}) / nullif({dy}, 0)), -1), 0) < least(coalesce(greatest((cx - h - {x0}) / nullif({dx}, 0), (cx + h - {x0}) / nullif({dx}, 0)), 2), coalesce(greatest((cy - h - {y0}) / nullif({dy}, 0), (cy + h - {y0}) / nullif({dy}, 0)), 2), 1)"


@query(
    f"""WITH {WALLS_SQL}, rk AS (SELECT building_id, k, px, py, d1, d2, excess_m, row_number() OVER (ORDER BY round(excess_m, 6), building_id, k) AS rank FROM sp QUALIFY rank <= 64),
v AS (SELECT rk.*, NOT EXISTS (SELECT 1 FROM bd WHERE bd.building_id <> rk.building_id AND {LEG.format(x0='0', y0='0', dx='px', dy='py')}) AS first_clear, NOT EXISTS (SELECT 1 FROM bd WHERE bd.building_id <> rk.building_id AND {LEG.format(x0='px', y0='py', dx='(900 - px)', dy='(700 - py)')}) AS second_clear FROM rk)
SELECT building_id, CAST(k AS INT) AS k, CAST(rank AS INT) AS rank, first_clear, second_clear, first_clear AND second_clear AS visible FROM v""",
    "fx_sites",
)
def facade_paths(spark, sf_dir):
    """JN25, JOB12: which candidates no building but their own blocks, leg by leg (an anti-join by shared cells of the legs' boxes)."""
    return visibility(spark, sf_dir).select("building_id", "k", "rank", "first_clear", "second_clear", (c("first_clear") & c("second_clear")).alias("visible"))


def visibility(spark, sf_dir) -> DataFrame:
    top = candidates(spark, sf_dir)
    first = top.select("rank", c("building_id").alias("own"), F.lit(1).alias("leg"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), c("px").alias("x1"), c("py").alias("y1"))
    legs = first.unionByName(top.select("rank", c("building_id").alias("own"), F.lit(2).alias("leg"), c("px").alias("x0"), c("py").alias("y0"), F.lit(RX_E).alias("x1"), F.lit(RX_N).alias("y1")))
    cell = lambda x: F.floor(x / 100.0)
    box = lambda a, b: F.explode(F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b))))
    legs = legs.withColumn("gx", box(c("x0"), c("x1"))).withColumn("gy", box(c("y0"), c("y1")))
    b = buildings(spark, sf_dir).withColumn("gx", box(c("cx") - c("h"), c("cx") + c("h"))).withColumn("gy", box(c("cy") - c("h"), c("cy") + c("h")))
    pairs = legs.join(b, ["gx", "gy"]).filter("own <> building_id")
    hit = pairs.filter((F.size(G.crossings(c("ring"), c("x0"), c("y0"), c("x1"), c("y1"))) > 0) | G.contains(c("ring"), c("x0"), c("y0")))
    blocked = hit.groupBy("rank").agg(F.max(c("leg") == 1).alias("b1"), F.max(c("leg") == 2).alias("b2"))
    free = lambda n: ~F.coalesce(n, F.lit(False))
    return top.join(blocked, "rank", "left").withColumn("first_clear", free("b1")).withColumn("second_clear", free("b2"))


@query(f"WITH {WALLS_SQL} SELECT (SELECT count(*) FROM im) AS n_walls, (SELECT count(*) FROM im) - (SELECT count(*) FROM sp) AS n_rejected, (SELECT count(*) FROM sp) AS n_candidates, CASE WHEN (SELECT count(*) FROM sp) = 0 THEN 'none' WHEN (SELECT count(*) FROM sp) > 64 THEN 'incomplete' ELSE 'paths' END AS status", "fx_sites")
def facade_status(spark, sf_dir):
    """AG32, AG40: walls scanned, rejected and kept by geometry, and whether all candidates were looked at."""
    w = walls(buildings(spark, sf_dir))
    n = w.agg(F.count("*").alias("n_walls")).crossJoin(bounces(w).agg(F.count("*").alias("n_candidates")))
    return n.select("n_walls", (c("n_walls") - c("n_candidates")).alias("n_rejected"), "n_candidates", F.when(c("n_candidates") == 0, "none").when(c("n_candidates") > 64, "incomplete").otherwise("paths").alias("status"))


SEG = "sqrt(pow({x} - ax - greatest(0, least(1, (({x} - ax) * vx + ({y} - ay) * vy) / (len * len))) * vx, 2) + pow({y} - ay - greatest(0, least(1, (({x} - ax) * vx + ({y} - ay) * vy) / (len * len))) * vy, 2))"


@query(f"WITH {WALLS_SQL}, rl AS (SELECT building_id, k, least({SEG.format(x='0', y='0')}, {SEG.format(x='900', y='700')}, {SEG.format(x='450', y='350')}) AS d_m FROM im), t AS (SELECT *, row_number() OVER (ORDER BY round(d_m, 6), building_id, k) AS rank FROM rl) SELECT building_id, CAST(k AS INT) AS k, CAST(rank AS INT) AS rank, {r('d_m')} FROM t WHERE rank <= 20", "fx_sites")
def relevant_walls(spark, sf_dir):
    """TOP5, SPA7, SPA21: the 20 walls nearest to either end or the middle of the link."""
    d = lambda x, y: G.to_segment(F.lit(x), F.lit(y), c("e"))
    w = walls(buildings(spark, sf_dir)).withColumn("d_m", F.least(d(0.0, 0.0), d(RX_E, RX_N), d(RX_E / 2, RX_N / 2)))
    order = [F.round("d_m", 6), "building_id", "k"]
    top = w.orderBy(*order).limit(20)
    return rounded(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("building_id", "k", "rank", "d_m"))


@query(
    f"""WITH {WALLS_SQL}, rk AS (SELECT *, row_number() OVER (ORDER BY round(excess_m, 6), building_id, k) AS rank FROM sp QUALIFY rank <= 64),
m AS (SELECT *, ['metal', 'concrete', 'brick', 'glass', 'wood'][(building_id % 5 + 1)::INT] AS material, abs((px * vy - py * vx) / (d1 * len)) AS ci FROM rk),
p AS (SELECT *, 60 - (32.45 + 20 * log10((d1 + d2) / 1000) + 20 * log10(3500)) - (8 + CASE material WHEN 'metal' THEN 3 WHEN 'concrete' THEN 7 WHEN 'brick' THEN 8 WHEN 'glass' THEN 6 ELSE 12 END + 6 * (1 - least(1, ci))) AS power_dbm FROM m),
t AS (SELECT *, row_number() OVER (ORDER BY round(power_dbm, 6) DESC, building_id, k) AS place FROM p) SELECT CAST(place AS INT) AS place, building_id, CAST(k AS INT) AS k, {r('power_dbm', loss_db='60 - power_dbm')} FROM t WHERE place <= 9""",
    "fx_sites",
)
def bounce_powers(spark, sf_dir):
    """JOB13, TOP6, RF17: the strongest single bounces (eight, and one more in line of sight) by free space over the whole path and the reflection."""
    x = candidates(spark, sf_dir).withColumn("material", F.element_at(F.array(*map(F.lit, ("metal", "concrete", "brick", "glass", "wood"))), (c("building_id") % 5 + 1).cast("int")))
    ci = F.abs((c("px") * (c("e.q.y") - c("e.p.y")) - c("py") * (c("e.q.x") - c("e.p.x"))) / (c("d1") * c("len")))
    x = x.withColumn("power_dbm", 60.0 - R.free_space_loss_db(c("d1") + c("d2"), F.lit(3500.0)) - R.reflection_loss_db(c("material"), ci))
    order = [F.desc(F.round("power_dbm", 6)), "building_id", "k"]
    return rounded(x.orderBy(*order).limit(9).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "building_id", "k", "power_dbm", (60.0 - c("power_dbm")).alias("loss_db")))


# Tags and keys.
TAGS_SQL = """tg AS (SELECT p_partkey AS id, ['yes', 'house', 'apartments', 'office', 'warehouse', 'church', 'tower', 'shed'][(p_partkey % 8 + 1)::INT] AS building, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) || ' m' END AS height, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size % 9 AS VARCHAR) END AS levels,
  CASE WHEN p_partkey % 11 = 0 THEN 'Stone' WHEN p_partkey % 13 = 0 THEN 'glazing' END AS material, CASE WHEN p_partkey % 3 = 0 THEN 'steel frame' WHEN p_partkey % 3 = 1 THEN 'Brick veneer' END AS construction FROM part)"""


def tagged(spark, sf_dir) -> DataFrame:
    """Map tags made from the part table."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), c("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("yes", "house", "apartments", "office", "warehouse", "church", "tower", "shed"))), (k % 8 + 1).cast("int"))
    pairs = {"building": kind, "height": F.when(k % 5 == 0, F.concat(c("p_size").cast("string"), F.lit(" m"))), "building:levels": F.when(k % 7 == 0, (c("p_size") % 9).cast("string")), "building:material": F.when(k % 11 == 0, "Stone").when(k % 13 == 0, "glazing"), "building:construction": F.when(k % 3 == 0, "steel frame").when(k % 3 == 1, "Brick veneer")}
    tags = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())), lambda k, v: v.isNotNull())
    return p.select(k.alias("id"), tags.alias("tags"))


@query(
    f"""WITH {TAGS_SQL}, d AS (SELECT *, lower(coalesce(material, '')) AS m, lower(coalesce(construction, '')) AS cn, TRY_CAST(replace(split_part(trim(height), ' ', 1), 'm', '') AS DOUBLE) AS hm, TRY_CAST(levels AS DOUBLE) AS lv FROM tg)
SELECT id, CASE WHEN hm > 0.5 THEN hm WHEN lv > 0 THEN lv * 3 ELSE CASE WHEN building IN ('yes', 'apartments') THEN 12.0 WHEN building = 'house' THEN 6.0 WHEN building = 'office' THEN 15.0 WHEN building = 'warehouse' THEN 10.0 WHEN building = 'church' THEN 20.0 WHEN building = 'tower' THEN 40.0 END END::DOUBLE AS height_m,
  CASE WHEN m IN ('brick', 'stone', 'masonry') THEN 'brick' WHEN m IN ('glass', 'glazing') THEN 'glass' WHEN building = 'house' THEN 'wood' WHEN building IN ('apartments', 'office') THEN 'concrete' WHEN building = 'warehouse' THEN 'metal' WHEN cn LIKE '%wood%' OR cn LIKE '%timber%' OR cn LIKE '%frame%' THEN 'wood' WHEN cn LIKE '%concrete%' OR cn LIKE '%cinder%' THEN 'concrete' WHEN cn LIKE '%brick%' OR cn LIKE '%masonry%' THEN 'brick' WHEN cn LIKE '%metal%' OR cn LIKE '%steel%' THEN 'metal' ELSE 'unknown' END AS material,
  CASE WHEN building LIKE '%house%' THEN 'house' WHEN building LIKE '%tower%' THEN 'large_structure' ELSE 'unknown' END AS kind FROM d"""
)
def tag_values(spark, sf_dir):
    """TXT1, TXT2, TXT6: height and material by tags, and the kind that a label names."""
    t = tagged(spark, sf_dir)
    return t.select("id", X.building_height_m(c("tags")).alias("height_m"), X.building_material(c("tags")).alias("material"), X.obstacle_kind(c("tags")["building"]).alias("kind"))


@query(
    f"""WITH {PLACED_SQL}, {BUILT_SQL}, hb AS (SELECT *, CASE WHEN building_id % 4 = 0 THEN 30.0 WHEN building_id % 4 = 1 THEN 9.0 END AS height_m FROM bd),
n AS (SELECT target_id, count(building_id) AS n, coalesce(avg(height_m), 0) AS avg_h FROM tp LEFT JOIN hb ON sqrt(pow(px - cx, 2) + pow(py - cy, 2)) <= 200 GROUP BY target_id), d AS (SELECT *, n / (pi() * 0.04) AS density, target_id % 50 = 0 AS park FROM n)
SELECT target_id, n, CASE WHEN park OR density < 5 THEN 'open' WHEN density < 50 THEN 'suburban' WHEN avg_h > 20 OR density > 200 THEN 'dense_urban' ELSE 'urban' END AS clutter FROM d""",
    "fx_targets",
    "fx_sites",
)
def clutter_classes(spark, sf_dir):
    """AG28: class of the surroundings by outlines a square kilometre, their mean known height, and open land; for distinct places and centres."""
    t, _ = placed(spark, sf_dir)
    i = c("building_id")
    b = buildings(spark, sf_dir).select(i, c("cx").alias("sx"), c("cy").alias("sy"), F.when(i % 4 == 0, 30.0).when(i % 4 == 1, 9.0).alias("height_m"))
    b = b.groupBy("sx", "sy").agg(F.count("*").alias("n"), F.count("height_m").alias("known"), F.sum("height_m").alias("height_m"))
    n = within(t.select("px", "py").distinct(), b, 200.0).groupBy("px", "py").agg(F.sum("n").alias("n"), F.coalesce(F.try_divide(F.sum("height_m"), F.sum("known")), F.lit(0.0)).alias("h"))
    x = t.select("target_id", "px", "py").join(n, ["px", "py"], "left").fillna(0, ["n", "h"])
    density = c("n") / (math.pi * 0.04)
    kind = F.when((c("target_id") % 50 == 0) | (density < 5), "open").when(density < 50, "suburban").when((c("h") > 20) | (density > 200), "dense_urban").otherwise("urban")
    return x.select("target_id", "n", kind.alias("clutter"))


@query(
    """WITH k AS (SELECT *, 200 + site_id % 3 * 900 AS radius FROM fx_sites), g AS (SELECT *, round_even(latitude / 0.001, 0) * 0.001 AS la, round_even(longitude / 0.001, 0) * 0.001 AS lo, round_even(radius / 50, 0) * 50 AS ra, greatest(1, CAST(ceil(radius / 700.0) AS INT)) AS per_axis, (radius + 200) / 111000.0 AS dlat FROM k)
SELECT site_id, md5(format('{:.6f}_{:.6f}_{:.0f}', la, lo, ra)) AS region_key, per_axis * per_axis AS n_tiles, CAST(round(latitude - dlat, 8) AS DOUBLE) AS south, CAST(round(longitude - dlat / cos(radians(latitude)), 8) AS DOUBLE) AS west, format('N{:02d}_W{:03d}', CAST(floor(latitude) AS INT), CAST(-floor(longitude) AS INT)) AS tile,
  sha256(concat_ws('|', CAST(round_even(latitude / 0.00001, 0) AS BIGINT), CAST(round_even(longitude / 0.00001, 0) AS BIGINT), CAST(round_even(tx_height_m / 0.5, 0) AS BIGINT), CAST(round_even(radius / 50, 0) AS BIGINT))) AS profile_key FROM g""",
    "fx_sites",
)
def region_keys(spark, sf_dir):
    """SPA8-SPA10, SPA17, SPA18: keys of regions and profiles on their grids, the box of a radius, tiles that cover it and the name of the height tile."""
    k = view(spark, sf_dir, "fx_sites").withColumn("radius", 200 + c("site_id") % 3 * 900)
    grid = lambda x, g: F.rint(x / g) * g
    per_axis = F.greatest(F.lit(1), F.ceil(c("radius") / 700.0))
    dlat = (c("radius") + 200) / 111_000.0
    key = F.md5(F.format_string("%.6f_%.6f_%.0f", grid(c("latitude"), 0.001), grid(c("longitude"), 0.001), grid(c("radius").cast("double"), 50)))
    whole = lambda x, g: F.rint(x / g).cast("long").cast("string")
    profile = F.sha2(F.concat_ws("|", whole(c("latitude"), 0.00001), whole(c("longitude"), 0.00001), whole(c("tx_height_m"), 0.5), whole(c("radius"), 50)), 256)
    tile = F.format_string("N%02d_W%03d", F.floor("latitude"), -F.floor("longitude"))
    return rounded(k.select("site_id", key.alias("region_key"), (per_axis * per_axis).cast("int").alias("n_tiles"), (c("latitude") - dlat).alias("south"), (c("longitude") - dlat / F.cos(F.radians("latitude"))).alias("west"), tile.alias("tile"), profile.alias("profile_key")))


@query(f"WITH {PLACED_SQL} SELECT site_id, {r(reach_m='max(greatest(sqrt(pow(px - sx, 2) + pow(py - sy, 2)), 500))')} FROM tp, sp WHERE target_id % 10 = site_id % 10 GROUP BY site_id", "fx_targets", "fx_sites")
def target_reach(spark, sf_dir):
    """AG38: the greatest distance of each site's targets (here those of its last digit), 500 m at least."""
    t, s = placed(spark, sf_dir)
    # of the targets on one line north or east only the two at its ends can be the farthest
    ends = t.select((c("target_id") % 10).alias("j"), "px", "py")
    for a, b in (("py", "px"), ("px", "py")):
        ends = ends.groupBy("j", a).agg(F.min(b).alias("lo"), F.max(b).alias("hi")).select("j", a, F.explode(F.array("lo", "hi")).alias(b)).distinct()
    x = s.withColumn("j", c("site_id") % 10).join(ends, "j")
    d = F.sqrt(F.pow(c("px") - c("sx"), 2) + F.pow(c("py") - c("sy"), 2))
    return rounded(x.groupBy("site_id").agg(F.max(F.greatest(d, F.lit(500.0))).alias("reach_m")))
