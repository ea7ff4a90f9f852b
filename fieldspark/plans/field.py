"""Field queries: link budgets, obstacles, best server, nearest sites, bistatic layers, rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import radio as R
from ..functions.broadcast import penetration_db
from ..operators.intervals import swept
from ..operators.spatial import local_xy, nearest, within
from ..sources.views import view, with_views
from .measurement import r, rounded

Q, SQL = {}, {}
c = F.col
LAT0, LON0 = 38.0, -121.5
RX_M, STEP_DEG, REACH_M, CELL_M = 1.5, 20, 800, 600.0
NOISE_DBM = R.thermal_noise_dbm(100.0, 7.0)


def query(sql: str | None = None, *names: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


def lattice(sites: DataFrame, step_deg: int = STEP_DEG, step_m: int = 100, reach_m: int = REACH_M) -> DataFrame:
    """JOB1, SPA1: samples of every site by bearing and range, with their place."""
    out = sites.withColumn("bearing_deg", F.explode(F.sequence(F.lit(0), F.lit(360 - step_deg), F.lit(step_deg)))).withColumn("distance_m", F.explode(F.sequence(F.lit(step_m), F.lit(reach_m), F.lit(step_m)).cast("array<double>")))
    b = F.radians(c("bearing_deg"))
    return out.withColumn("lat", c("latitude") + F.degrees(c("distance_m") * F.cos(b) / 6_371_000.0)).withColumn("lon", c("longitude") + F.degrees(c("distance_m") * F.sin(b) / (6_371_000.0 * F.cos(F.radians("latitude")))))


LATTICE_SQL = """l AS (SELECT s.*, b.b AS bearing_deg, d.d::DOUBLE AS distance_m,
  latitude + degrees(d.d * cos(radians(b.b)) / 6371000.0::DOUBLE) AS lat, longitude + degrees(d.d * sin(radians(b.b)) / (6371000.0::DOUBLE * cos(radians(latitude)))) AS lon
  FROM fx_sites s, (SELECT unnest(range(0, 360, 20)) AS b) b, (SELECT unnest(range(100, 801, 100)) AS d) d)"""


@query(
    f"""WITH {LATTICE_SQL}, k AS (SELECT l.*, x.sector_no, sqrt(distance_m * distance_m + pow(tx_height_m - 1.5, 2)) AS d3, abs((((bearing_deg - azimuth_deg + 180) % 360) + 360) % 360 - 180) AS off,
  greatest(10, 4 * greatest(1, tx_height_m - 1) * 3.5 * 1000000000 / 300000000) AS bend FROM l JOIN fx_sectors x USING (site_id)),
p AS (SELECT *, CASE WHEN distance_m <= bend THEN 32.4 + 21 * log10(greatest(d3, 10)) + 20 * log10(3.5) ELSE 32.4 + 40 * log10(greatest(d3, 10)) + 20 * log10(3.5) - 9.5 * log10(bend * bend + pow(tx_height_m - 1.5, 2)) END AS sight,
  22.4 + 35.3 * log10(greatest(d3, 10)) + 21.3 * log10(3.5) AS hidden, least(12 * pow(off / 65, 2), 30) AS h0,
  least(12 * pow(degrees(atan2(greatest(0, tx_height_m - 1.5), greatest(distance_m, 1))) / 8, 2), 30) AS vertical_db FROM k),
f AS (SELECT *, CASE WHEN off > 90 THEN greatest(h0, 25) ELSE h0 END AS horizontal_db, 32.45 + 20 * log10(distance_m / 1000) + 20 * log10(3500) AS free_db, greatest(sight, hidden) AS nlos FROM p)
SELECT site_id, CAST(sector_no AS INT) AS sector_no, CAST(bearing_deg AS INT) AS bearing_deg, {r('distance_m', 'lat', 'lon', 'free_db', 'horizontal_db', 'vertical_db', los_db='sight', nlos_db='nlos', rsrp_dbm='43 - 10 * log10(12 * 273) + 17 - sight - horizontal_db - vertical_db')} FROM f""",
    "fx_sites",
    "fx_sectors",
)
def link_budget(spark, sf_dir):
    """JOB1, RF1, RF2, RF5-RF7: losses and received power of every sample and sector."""
    # joined before samples are made, as the planner takes an explode's rows for as few as its input's and would send all samples to the driver
    sectors = view(spark, sf_dir, "fx_sites").join(view(spark, sf_dir, "fx_sectors").hint("merge"), "site_id")
    # dealt to as many tasks as asked for: the rows of sectors are few, those of samples are not
    x = lattice(sectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "site_id", "sector_no"))
    d3 = F.sqrt(c("distance_m") * c("distance_m") + F.pow(c("tx_height_m") - RX_M, 2))
    loss = lambda los: R.street_canyon_loss_db(c("distance_m"), d3, c("freq_mhz"), c("tx_height_m"), RX_M, F.lit(los))
    x = x.withColumn("los_db", loss(True)).withColumn("nlos_db", loss(False)).withColumn("free_db", R.free_space_loss_db(c("distance_m"), c("freq_mhz")))
    x = x.withColumn("horizontal_db", R.horizontal_loss_db(c("bearing_deg"), c("azimuth_deg"), c("beamwidth_h_deg"))).withColumn("vertical_db", R.vertical_loss_db(c("distance_m"), c("tx_height_m"), RX_M, c("beamwidth_v_deg")))
    x = x.withColumn("rsrp_dbm", R.reference_eirp_dbm(c("tx_power_dbm"), c("tx_antenna_gain_dbi")) - c("los_db") - c("horizontal_db") - c("vertical_db"))
    return rounded(x.select("site_id", "sector_no", "bearing_deg", "distance_m", "lat", "lon", "free_db", "horizontal_db", "vertical_db", "los_db", "nlos_db", "rsrp_dbm"))


def samples(spark, sf_dir) -> DataFrame:
    """A sample every 50 m on each of 72 bearings that holds an obstacle."""
    o = view(spark, sf_dir, "fx_obstacles")
    return o.select("site_id", "bearing_bin").distinct().withColumn("distance_m", F.explode(F.sequence(F.lit(50), F.lit(700), F.lit(50)).cast("array<double>")))


SAMPLES_SQL = "s AS (SELECT DISTINCT site_id, bearing_bin FROM fx_obstacles), p AS (SELECT site_id, bearing_bin, d::DOUBLE AS distance_m FROM s, (SELECT unnest(range(50, 701, 50)) AS d)), j AS (SELECT p.*, start_m, end_m, material, obstacle_id FROM p LEFT JOIN fx_obstacles o ON p.site_id = o.site_id AND p.bearing_bin = o.bearing_bin AND start_m <= distance_m + 0.000001)"


@query(
    f"""WITH {SAMPLES_SQL}
SELECT site_id, bearing_bin, {r('distance_m')}, count(*) FILTER (end_m > distance_m + 0.000001) AS n_active, count(*) FILTER (end_m <= distance_m + 0.000001) AS n_exited,
  {r(last_exit_m='max(CASE WHEN end_m <= distance_m + 0.000001 THEN end_m END)', post_exit_db='least(20, coalesce(sum(CASE WHEN end_m <= distance_m + 0.000001 THEN greatest(0, least(12, 4 + 10 * (end_m - start_m) / 100) - 2 * (distance_m - end_m) / 100) END), 0))')},
  min_by(material, (start_m, obstacle_id)) FILTER (end_m > distance_m + 0.000001) AS first_material
FROM j GROUP BY site_id, bearing_bin, distance_m""",
    "fx_obstacles",
)
def obstacle_states(spark, sf_dir):
    """JN9, WIN6, RF12, JOB2: obstacles a sample lies in or behind, and the loss that lingers behind them."""
    x = swept(samples(spark, sf_dir), view(spark, sf_dir, "fx_obstacles"), ["site_id", "bearing_bin"], "obstacle_id", losses={"post_exit_db": (4.0, 10.0, 12.0, 20.0)}, tell=("material",))
    return rounded(x.select("site_id", "bearing_bin", "distance_m", "n_active", "n_exited", "last_exit_m", "post_exit_db", c("first_active.material").alias("first_material")))


def placed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t, s = view(spark, sf_dir, "fx_targets"), view(spark, sf_dir, "fx_sites")
    tx, ty = local_xy(c("latitude"), c("longitude"), LAT0, LON0)
    return t.withColumn("px", tx).withColumn("py", ty), s.select("site_id", "tx_height_m", "freq_mhz", "tx_power_dbm", tx.alias("sx"), ty.alias("sy"))


XY = "radians({t}.longitude + 121.5) * cos(radians(38.0::DOUBLE)) * 6371000.0::DOUBLE AS {p}x, radians({t}.latitude - 38.0) * 6371000.0::DOUBLE AS {p}y"
PLACED_SQL = f"tp AS (SELECT fx_targets.*, {XY.format(t='fx_targets', p='p')} FROM fx_targets), sp AS (SELECT fx_sites.*, {XY.format(t='fx_sites', p='s')} FROM fx_sites)"
DIST = "sqrt(pow(px - sx, 2) + pow(py - sy, 2))"


@query(f"WITH {PLACED_SQL} SELECT target_id, site_id, {r('d_m')} FROM (SELECT target_id, site_id, {DIST} AS d_m, row_number() OVER (PARTITION BY target_id ORDER BY round({DIST}, 6), site_id) AS n FROM tp, sp) WHERE n = 1", "fx_targets", "fx_sites")
def nearest_site(spark, sf_dir):
    """JN15, JN18: the nearest site of each target."""
    t, s = placed(spark, sf_dir)
    return rounded(nearest(t, s, "target_id", "site_id").select("target_id", "site_id", "d_m"))


@query(f"WITH {PLACED_SQL}, k AS (SELECT target_id, tx_height_m, {DIST} AS d_m, row_number() OVER (PARTITION BY target_id ORDER BY round({DIST}, 6), site_id) AS n FROM tp, sp) SELECT target_id, {r(height_m='sum(tx_height_m / pow(greatest(d_m, 0.25), 2)) / sum(1 / pow(greatest(d_m, 0.25), 2))')} FROM k WHERE n <= 4 GROUP BY target_id", "fx_targets", "fx_sites")
def interpolated_height(spark, sf_dir):
    """JN16, JN17: four nearest sites, weighted by the inverse square of their distance."""
    t, s = placed(spark, sf_dir)
    w = 1 / F.pow(F.greatest(c("d_m"), F.lit(0.25)), 2)
    return rounded(nearest(t, s, "target_id", "site_id", k=4).groupBy("target_id").agg((F.sum(c("tx_height_m") * w) / F.sum(w)).alias("height_m")))


BEST_SQL = f"""{PLACED_SQL}, k AS (SELECT target_id, x.site_id, sector_no, {DIST} AS d_m, sp.tx_height_m, azimuth_deg, ((degrees(atan2(px - sx, py - sy)) % 360) + 360) % 360 AS bearing FROM tp JOIN sp ON {DIST} <= 600 JOIN fx_sectors x ON x.site_id = sp.site_id),
o AS (SELECT *, abs((((bearing - azimuth_deg + 180) % 360) + 360) % 360 - 180) AS off FROM k),
w AS (SELECT *, 43 - 10 * log10(12 * 273) + 17 - (32.45 + 20 * log10(greatest(d_m / 1000, 0.001)) + 20 * log10(3500)) - CASE WHEN off > 90 THEN greatest(25, least(30, 12 * pow(off / 65, 2))) ELSE least(30, 12 * pow(off / 65, 2)) END - least(12 * pow(degrees(atan2(greatest(0, tx_height_m - 1.5), greatest(d_m, 1))) / 8, 2), 30) AS p FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(p, 6) DESC, site_id, sector_no) AS i FROM w),
b AS (SELECT target_id, max(CASE WHEN i = 1 THEN site_id END) AS site_id, max(CASE WHEN i = 1 THEN sector_no END) AS sector_no, max(CASE WHEN i = 1 THEN p END) AS rsrp_dbm, count(*) - 1 AS n_interferers,
  coalesce(sum(CASE WHEN i > 1 THEN pow(10, p / 10) END), 0) AS mw, coalesce(max(CASE WHEN i = 2 THEN p END), -200) AS top_dbm FROM n GROUP BY target_id),
z AS (SELECT *, 10 * log10(pow(10, rsrp_dbm / 10) / greatest(pow(10, (-174 + 10 * log10(100000000) + 7) / 10) + mw, 0.000000000000001::DOUBLE)) AS sinr_db, CASE WHEN n_interferers > 0 THEN rsrp_dbm - top_dbm ELSE 99 END AS margin_db FROM b)"""


@query(
    f"""WITH {BEST_SQL}, m AS (SELECT *, CASE WHEN sinr_db >= 28 THEN 8.0 WHEN sinr_db >= 20 THEN 6.0 WHEN sinr_db >= 12 THEN 4.2 WHEN sinr_db >= 5 THEN 2.4 ELSE 1.0 END AS rate FROM z)
SELECT target_id, site_id, CAST(sector_no AS INT) AS sector_no, n_interferers, {r('rsrp_dbm', 'top_dbm', 'sinr_db', 'margin_db', mbps='rate * 12 * 273 * 30 / 1000')}, CASE rate WHEN 8 THEN '1024QAM' WHEN 6 THEN '256QAM' WHEN 4.2 THEN '64QAM' WHEN 2.4 THEN '16QAM' ELSE 'QPSK' END AS modulation FROM m""",
    "fx_targets",
    "fx_sites",
    "fx_sectors",
)
def best_server(spark, sf_dir):
    """AG20, RF15, RF19, RF29, JOB3: the strongest sector near each target, all others interfering."""
    return rounded(served(spark, sf_dir).select("target_id", "site_id", "sector_no", "n_interferers", "rsrp_dbm", "top_dbm", "sinr_db", "margin_db", "mbps", "modulation"))


def served(spark, sf_dir) -> DataFrame:
    t, s = placed(spark, sf_dir)
    x = within(t, s, CELL_M).join(view(spark, sf_dir, "fx_sectors"), "site_id")
    bearing = F.pmod(F.degrees(F.atan2(c("px") - c("sx"), c("py") - c("sy"))), F.lit(360.0))
    p = R.reference_eirp_dbm(c("tx_power_dbm"), c("tx_antenna_gain_dbi")) - R.free_space_loss_db(c("d_m"), c("freq_mhz")) - R.horizontal_loss_db(bearing, c("azimuth_deg"), c("beamwidth_h_deg")) - R.vertical_loss_db(c("d_m"), c("tx_height_m"), RX_M, c("beamwidth_v_deg"))
    x = x.withColumn("p", p)
    # Powers alike to a millionth of a dB are equal; the smaller site and sector serves.
    best = Window.partitionBy("target_id").orderBy(F.desc(F.round("p", 6)), "site_id", "sector_no")
    x = x.withColumn("i", F.row_number().over(best))
    first = F.when(c("i") == 1, F.struct("site_id", "sector_no", "p"))
    a = x.groupBy("target_id").agg(F.max(first).alias("f"), (F.count("*") - 1).alias("n_interferers"), F.coalesce(F.sum(F.when(c("i") > 1, R.milliwatts(c("p")))), F.lit(0.0)).alias("mw"), F.coalesce(F.max(F.when(c("i") == 2, c("p"))), F.lit(-200.0)).alias("top_dbm"))
    a = a.select("target_id", "f.site_id", "f.sector_no", c("f.p").alias("rsrp_dbm"), "n_interferers", "mw", "top_dbm")
    a = a.withColumn("sinr_db", 10 * F.log10(R.milliwatts(c("rsrp_dbm")) / F.greatest(F.lit(10 ** (NOISE_DBM / 10)) + c("mw"), F.lit(1e-15))))
    name, rate = R.modulation(c("sinr_db"))
    return a.withColumn("margin_db", F.when(c("n_interferers") > 0, c("rsrp_dbm") - c("top_dbm")).otherwise(99.0)).withColumn("modulation", name).withColumn("mbps", rate * 12 * 273 * 30 / 1000)


@query(f"WITH {BEST_SQL} SELECT CAST(round_even((t.latitude - 38.0) / 0.005, 0) AS INT) AS i, CAST(round_even((t.longitude + 121.5) / 0.005, 0) AS INT) AS j, count(*) AS n, {r(mean_rsrp='avg(rsrp_dbm)', mean_sinr='avg(sinr_db)')} FROM z JOIN fx_targets t USING (target_id) GROUP BY 1, 2", "fx_targets", "fx_sites", "fx_sectors")
def coverage_raster(spark, sf_dir):
    """AG24: mean power and SINR of the targets of each pixel."""
    t = view(spark, sf_dir, "fx_targets").select("target_id", "latitude", "longitude")
    x = served(spark, sf_dir).join(t, "target_id")
    return rounded(x.groupBy(F.rint((c("latitude") - LAT0) / 0.005).cast("int").alias("i"), F.rint((c("longitude") - LON0) / 0.005).cast("int").alias("j")).agg(F.count("*").alias("n"), F.avg("rsrp_dbm").alias("mean_rsrp"), F.avg("sinr_db").alias("mean_sinr")))


TX, RX = (38.002, -121.499, 40.0), (38.02, -121.48, 12.0)
RX_GAIN, RX_FEED, HZ, BAND_HZ, TIME_S, FIGURE_DB = 12.0, 1.0, 3.5e9, 20e6, 0.1, 5.0


def bistatic(targets: DataFrame, rcs_m2=None, height_m=None) -> DataFrame:
    """JOB7, RF14, RF21, RF22: ranges, excess delay, angle, echo power and SNR of each target between a fixed transmitter and receiver."""
    rcs_m2, height_m = F.lit(10.0) if rcs_m2 is None else rcs_m2, F.lit(30.0) if height_m is None else height_m
    t, a, b = R.ecef(c("latitude"), c("longitude"), c("z_ground_m") + height_m), R.ecef(*map(F.lit, TX)), R.ecef(*map(F.lit, RX))
    names = [f"_{p}{i}" for p in "tab" for i in range(3)]
    x = targets.select("*", *[e.alias(n) for e, n in zip([*t, *a, *b], names, strict=True)], rcs_m2.alias("_rcs"))
    at = lambda p: tuple(c(f"_{p}{i}") for i in range(3))
    x = x.withColumn("tx_range_m", R.distance3(at("t"), at("a"))).withColumn("rx_range_m", R.distance3(at("t"), at("b"))).withColumn("direct_m", R.distance3(at("a"), at("b")))
    x = x.withColumn("excess_delay_s", (c("tx_range_m") + c("rx_range_m") - c("direct_m")) / R.LIGHT)
    # a target may stand where the transmitter or the receiver does
    cos = R.quotient(F.pow("tx_range_m", 2) + F.pow("rx_range_m", 2) - F.pow("direct_m", 2), 2 * c("tx_range_m") * c("rx_range_m"))
    x = x.withColumn("angle_deg", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    back = R.free_space_loss_db(c("rx_range_m"), F.lit(HZ / 1e6))
    x = x.withColumn("echo_dbm", c("incident_power_dbm") - back + RX_GAIN - RX_FEED + R.scattering_db(c("_rcs"), F.lit(HZ)))
    gain = 10 * math.log10(BAND_HZ * TIME_S)
    x = x.withColumn("snr_db", c("echo_dbm") - R.thermal_noise_dbm(BAND_HZ / 1e6, FIGURE_DB) + gain)
    return x.drop(*names, "_rcs")


def _ecef_sql(name: str, lat: str, lon: str, alt: str) -> str:
    n = f"(6378137.0::DOUBLE / sqrt(1 - 0.00669437999014::DOUBLE * pow(sin(radians({lat})), 2)))"
    return f"({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})) AS {name}x, ({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})) AS {name}y, ({n} * (1 - 0.00669437999014::DOUBLE) + {alt}) * sin(radians({lat})) AS {name}z"


def _far(a: str, b: str) -> str:
    return f"sqrt(pow({a}x - {b}x, 2) + pow({a}y - {b}y, 2) + pow({a}z - {b}z, 2))"


def _bistatic_sql(source: str = "fx_targets", rcs: str = "10", height: str = "30") -> str:
    return f"""e AS (SELECT *, {_ecef_sql('t', 'latitude', 'longitude', f'(z_ground_m + {height})')}, {_ecef_sql('a', '38.002::DOUBLE', '-121.499::DOUBLE', '40.0::DOUBLE')}, {_ecef_sql('c', '38.02::DOUBLE', '-121.48::DOUBLE', '12.0::DOUBLE')} FROM {source}),
g AS (SELECT *, {_far('t', 'a')} AS tx_range_m, {_far('t', 'c')} AS rx_range_m, {_far('a', 'c')} AS direct_m FROM e),
h AS (SELECT *, (tx_range_m + rx_range_m - direct_m) / 299792458.0::DOUBLE AS excess_delay_s, degrees(acos(greatest(-1, least(1, (pow(tx_range_m, 2) + pow(rx_range_m, 2) - pow(direct_m, 2)) / (2 * tx_range_m * rx_range_m))))) AS angle_deg,
  incident_power_dbm - (32.45 + 20 * log10(greatest(rx_range_m / 1000, 0.001)) + 20 * log10(3500)) + 12 - 1 + 10 * log10({rcs}) + 10 * log10(4 * pi()) - 20 * log10(299792458.0::DOUBLE / 3500000000.0::DOUBLE) AS echo_dbm FROM g),
f AS (SELECT *, echo_dbm - (-174 + 10 * log10(20000000) + 5) + 10 * log10(20000000 * 0.1) AS snr_db FROM h)"""


def near(**exprs: str) -> str:
    """Ranges from coordinates of the earth's size are compared to a tenth of a millimetre."""
    return ", ".join(f"round({e}, 4) + 0.0 AS {n}" for n, e in exprs.items())


LOOSE = {"tx_range_m": 4, "rx_range_m": 4, "delay_ns": 4, "angle_deg": 4, "echo_dbm": 4, "snr_db": 4, "margin_db": 4}


@query(f"WITH {_bistatic_sql()} SELECT target_id, {near(tx_range_m='tx_range_m', rx_range_m='rx_range_m', delay_ns='excess_delay_s * 1000000000', angle_deg='angle_deg', echo_dbm='echo_dbm', snr_db='snr_db')}, snr_db >= 10 AS detectable FROM f", "fx_targets")
def bistatic_field(spark, sf_dir):
    """JOB7: sensing columns of every target."""
    x = bistatic(view(spark, sf_dir, "fx_targets"))
    return rounded(x.select("target_id", "tx_range_m", "rx_range_m", (c("excess_delay_s") * 1e9).alias("delay_ns"), "angle_deg", "echo_dbm", "snr_db", (c("snr_db") >= 10).alias("detectable")), **LOOSE)


@query(f"WITH {_bistatic_sql()} SELECT CAST(round_even(excess_delay_s * 20000000, 0) AS INT) AS delay_bin, count(*) AS n FROM f GROUP BY 1", "fx_targets")
def delay_bins(spark, sf_dir):
    """AG31: targets by delay cell."""
    return bistatic(view(spark, sf_dir, "fx_targets")).groupBy(F.rint(c("excess_delay_s") * BAND_HZ).cast("int").alias("delay_bin")).agg(F.count("*").alias("n"))


SCENARIOS = ((1, 1.0, 30.0, 10.0), (2, 10.0, 30.0, 10.0), (3, 100.0, 60.0, 13.0))


@query(
    f"WITH sc(scenario, rcs, height, need) AS (VALUES (1, 1.0::DOUBLE, 30.0::DOUBLE, 10.0::DOUBLE), (2, 10.0::DOUBLE, 30.0::DOUBLE, 10.0::DOUBLE), (3, 100.0::DOUBLE, 60.0::DOUBLE, 13.0::DOUBLE)), sx AS (SELECT * FROM fx_targets, sc), {_bistatic_sql('sx', 'rcs', 'height')} SELECT scenario, count(*) AS n, count(*) FILTER (snr_db >= need) AS n_detectable, {near(margin_db='max(snr_db - need)')} FROM f GROUP BY scenario",
    "fx_targets",
)
def whatif_scenarios(spark, sf_dir):
    """JOB9, JOB10, JN35, AG23: all targets under each scenario; the scenarios are a fixed short list."""
    s = spark.createDataFrame(list(SCENARIOS), "scenario int, rcs double, height double, need double")
    x = bistatic(view(spark, sf_dir, "fx_targets").crossJoin(F.broadcast(s)), c("rcs"), c("height"))
    return rounded(x.groupBy("scenario").agg(F.count("*").alias("n"), F.count_if(c("snr_db") >= c("need")).alias("n_detectable"), F.max(c("snr_db") - c("need")).alias("margin_db")), **LOOSE)


@query("SELECT material, count(*) AS n, CAST(round(avg(end_m - start_m), 8) + 0.0 AS DOUBLE) AS mean_width_m FROM fx_obstacles GROUP BY material", "fx_obstacles")
def obstacle_summary(spark, sf_dir):
    """AG22, AG33: obstacles by material."""
    return rounded(view(spark, sf_dir, "fx_obstacles").groupBy("material").agg(F.count("*").alias("n"), F.avg(c("end_m") - c("start_m")).alias("mean_width_m")))


@query("SELECT site_id, bearing_bin, obstacle_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, bearing_bin ORDER BY start_m, end_m, obstacle_id) AS n FROM fx_obstacles WHERE start_m <= 400) WHERE n = 1", "fx_obstacles")
def first_obstacles(spark, sf_dir):
    """JN10: the nearest obstacle of each bearing bin that begins within reach."""
    near_ = Window.partitionBy("site_id", "bearing_bin").orderBy("start_m", "end_m", "obstacle_id")
    return view(spark, sf_dir, "fx_obstacles").filter("start_m <= 400").withColumn("n", F.row_number().over(near_)).filter("n = 1").select("site_id", "bearing_bin", "obstacle_id")


@query("SELECT DISTINCT p.site_id, p.bearing_bin FROM fx_obstacles p WHERE material = 'wood' AND start_m <= 300", "fx_obstacles")
def wooded_bearings(spark, sf_dir):
    """JN32, JN33: bearings with vegetation within reach, by a semi-join."""
    o = view(spark, sf_dir, "fx_obstacles")
    return o.select("site_id", "bearing_bin").distinct().join(o.filter("material = 'wood' AND start_m <= 300").select("site_id", "bearing_bin"), ["site_id", "bearing_bin"], "left_semi")


@query("SELECT a.site_id, CAST(a.sector_no AS INT) AS first_no, CAST(b.sector_no AS INT) AS second_no FROM fx_sectors a JOIN fx_sectors b ON a.site_id = b.site_id AND a.sector_no < b.sector_no WHERE abs(a.azimuth_deg - b.azimuth_deg) < 150", "fx_sectors")
def close_sectors(spark, sf_dir):
    """FLT14: pairs of a site's sectors whose centres are close; not aware of the turn at north."""
    s = view(spark, sf_dir, "fx_sectors").select("site_id", "sector_no", "azimuth_deg")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (c("a.site_id") == c("b.site_id")) & (c("a.sector_no") < c("b.sector_no"))).filter(F.abs(c("a.azimuth_deg") - c("b.azimuth_deg")) < 150).select("a.site_id", c("a.sector_no").alias("first_no"), c("b.sector_no").alias("second_no"))


@query("SELECT target_id, CAST(round_even(latitude * 100000, 0) AS BIGINT) AS lat_e5, CAST(round_even(longitude * 100000, 0) AS BIGINT) AS lon_e5 FROM fx_targets", "fx_targets")
def place_keys(spark, sf_dir):
    """SPA11: integer keys of 1e-5 degrees."""
    return view(spark, sf_dir, "fx_targets").select("target_id", F.rint(c("latitude") * 1e5).cast("long").alias("lat_e5"), F.rint(c("longitude") * 1e5).cast("long").alias("lon_e5"))


MATERIALS_SQL = "v(material, a, b) AS (VALUES ('wood', 6.0::DOUBLE, 7.0::DOUBLE), ('concrete', 10.0::DOUBLE, 12.0::DOUBLE), ('brick', 8.0::DOUBLE, 10.0::DOUBLE), ('metal', 25.0::DOUBLE, 25.0::DOUBLE), ('glass', 7.0::DOUBLE, 9.0::DOUBLE))"


@query(f"WITH {MATERIALS_SQL} SELECT obstacle_id, {r(loss_db='(coalesce(a, 10) + (coalesce(b, 12) - coalesce(a, 10)) * (3000 - 2500) / 1000) * 0.75 - 0.5')} FROM fx_obstacles LEFT JOIN v USING (material)", "fx_obstacles")
def obstacle_losses(spark, sf_dir):
    """RF11: loss of each obstacle's material at 3 GHz."""
    return rounded(view(spark, sf_dir, "fx_obstacles").select("obstacle_id", penetration_db(c("material"), F.lit(3000.0), less=0.5).alias("loss_db")))
