"""Sample states along bearings with all obstacle terms, and the fused channel table of coverage, illumination and returns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio as R
from ..functions.broadcast import penetration_db
from ..operators.intervals import swept
from ..operators.spatial import probed
from ..sources.views import view, with_views
from .field import MATERIALS_SQL, RX, RX_M, SAMPLES_SQL, TX, _ecef_sql, _far, near, samples
from .measurement import r, rounded

Q, SQL = {}, {}
c = F.col
MHZ, TX_DBM, TX_GAIN = 3500.0, 43.0, 17.0
#: Shadow and diffraction behind obstacles: base, slope per 100 m of width, cap of one and of all; recovery per 100 m, damped in street canyons.
SHADOW, DIFFRACTION, RECOVERY_DB = (6.0, 4.0, 22.0, 22.0), (6.0, 3.0, 18.0, 18.0), 6.0 * 0.7


def query(sql: str | None = None, *names: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


def lingering_sql(base: float, slope: float, cap: float) -> str:
    return f"least({cap}, coalesce(sum(CASE WHEN end_m <= distance_m + 0.000001 THEN greatest(0, least({cap}, {base} + {slope} * greatest(0, end_m - start_m) / 100) - {RECOVERY_DB} * greatest(0, distance_m - end_m) / 100) END), 0))"


STATES_SQL = f"""{SAMPLES_SQL}, {MATERIALS_SQL}, k AS (SELECT j.*, CASE WHEN obstacle_id IS NULL THEN NULL ELSE (coalesce(a, 10) + (coalesce(b, 12) - coalesce(a, 10)) * (3500 - 2500) / 1000) * 0.75 - 0.5 END AS loss FROM j LEFT JOIN v USING (material)),
g AS (SELECT site_id, bearing_bin, distance_m, count(*) FILTER (end_m > distance_m + 0.000001) AS n_active, count(*) FILTER (end_m <= distance_m + 0.000001) AS n_exited, min(start_m) AS first_blocker_m,
  max(CASE WHEN end_m <= distance_m + 0.000001 THEN end_m END) AS last_exit_m, coalesce(sum(CASE WHEN end_m > distance_m + 0.000001 THEN loss END), 0) AS pen, {lingering_sql(*SHADOW[:3])} AS sh, {lingering_sql(*DIFFRACTION[:3])} AS di FROM k GROUP BY site_id, bearing_bin, distance_m),
h AS (SELECT g.*, tx_height_m, CASE WHEN pen > 0 THEN 0 ELSE sh END AS shadow, CASE WHEN pen > 0 THEN 0 ELSE di END AS diffraction, CASE WHEN pen <= 0 AND last_exit_m IS NOT NULL THEN greatest(0, distance_m - last_exit_m) ELSE 0 END AS gap,
  sqrt(distance_m * distance_m + pow(tx_height_m - {RX_M}, 2)) AS d3, greatest(10, 4 * greatest(1, tx_height_m - 1) * 3.5 * 1000000000 / 300000000) AS bend FROM g JOIN fx_sites USING (site_id)),
pl AS (SELECT *, CASE WHEN greatest(10, distance_m) <= bend THEN 32.4 + 21 * log10(greatest(d3, 10)) + 20 * log10(3.5) ELSE 32.4 + 40 * log10(greatest(d3, 10)) + 20 * log10(3.5) - 9.5 * log10(bend * bend + pow(tx_height_m - {RX_M}, 2)) END AS sight, 22.4 + 35.3 * log10(greatest(d3, 10)) + 21.3 * log10(3.5) AS hidden FROM h),
w AS (SELECT *, pen <= 0 AS is_los, pen + shadow + diffraction AS extra, CASE WHEN pen <= 0 THEN sight ELSE greatest(sight, hidden) END AS scenario FROM pl)"""


@query(
    f"""WITH {STATES_SQL} SELECT site_id, bearing_bin, {r('distance_m')}, n_active, n_exited, {r('first_blocker_m', 'last_exit_m', penetration_db='pen', shadow_db='shadow', diffraction_db='diffraction', open_gap_m='gap', extra_loss_db='extra', path_loss_db='scenario', incident_dbm=f'{TX_DBM} + {TX_GAIN} - scenario - extra')}, is_los FROM w""",
    "fx_obstacles",
    "fx_sites",
)
def sample_states(spark, sf_dir):
    """JOB2, JN9, WIN6, RF12: every state of a sample from one sweep of its bearing, and the power that obstacle losses leave there."""
    x = states(samples(spark, sf_dir), view(spark, sf_dir, "fx_obstacles"), view(spark, sf_dir, "fx_sites"))
    return rounded(x.select("site_id", "bearing_bin", "distance_m", "n_active", "n_exited", "first_blocker_m", "last_exit_m", "penetration_db", "shadow_db", "diffraction_db", "open_gap_m", "extra_loss_db", "path_loss_db", "incident_dbm", "is_los"))


def states(samples_: DataFrame, obstacles: DataFrame, sites: DataFrame, mhz: float = MHZ) -> DataFrame:
    """A sample inside an obstacle has its penetration and no shadow; behind obstacles those that linger."""
    held = obstacles.withColumn("_loss", penetration_db(c("material"), F.lit(mhz), less=0.5))
    x = swept(samples_, held, ["site_id", "bearing_bin"], "obstacle_id", penetration=c("_loss"), losses={"_shadow": SHADOW, "_diffraction": DIFFRACTION}, recovery_db=RECOVERY_DB, tell=("material",))
    inside = c("penetration_db") > 1e-9  # sums of what came and went
    x = x.withColumn("is_los", ~inside).withColumn("shadow_db", F.when(inside, 0.0).otherwise(c("_shadow"))).withColumn("diffraction_db", F.when(inside, 0.0).otherwise(c("_diffraction")))
    x = x.withColumn("open_gap_m", F.when(~inside & c("last_exit_m").isNotNull(), F.greatest(F.lit(0.0), c("distance_m") - c("last_exit_m"))).otherwise(0.0))
    x = x.withColumn("extra_loss_db", F.greatest(F.lit(0.0), c("penetration_db") + c("shadow_db") + c("diffraction_db"))).withColumnRenamed("first_start_m", "first_blocker_m")
    x = x.join(sites.select("site_id", "tx_height_m"), "site_id")
    d3 = F.sqrt(c("distance_m") * c("distance_m") + F.pow(c("tx_height_m") - RX_M, 2))
    x = x.withColumn("path_loss_db", R.street_canyon_loss_db(c("distance_m"), d3, F.lit(mhz), c("tx_height_m"), RX_M, c("is_los")))
    return x.withColumn("incident_dbm", TX_DBM + TX_GAIN - c("path_loss_db") - c("extra_loss_db"))


OBSTRUCTED_SQL = f"""{STATES_SQL}, q AS (SELECT w.*, sector_no, abs((((bearing_bin * 5 - azimuth_deg + 180) % 360) + 360) % 360 - 180) AS off FROM w JOIN fx_sectors USING (site_id)),
z AS (SELECT *, 43 - 10 * log10(12 * 273) + 17 - scenario - extra - CASE WHEN off > 90 THEN greatest(25, least(30, 12 * pow(off / 65, 2))) ELSE least(30, 12 * pow(off / 65, 2)) END - least(12 * pow(degrees(atan2(greatest(0, tx_height_m - {RX_M}), greatest(distance_m, 1))) / 8, 2), 30) AS p FROM q)"""


@query(
    f"""WITH {OBSTRUCTED_SQL} SELECT site_id, bearing_bin, {r('distance_m')}, CAST(sector_no AS INT) AS sector_no, {r(rsrp_dbm='p')}, is_los FROM (SELECT *, row_number() OVER (PARTITION BY site_id, bearing_bin, distance_m ORDER BY round(p, 6) DESC, sector_no) AS n FROM z) WHERE n = 1""",
    "fx_obstacles",
    "fx_sites",
    "fx_sectors",
)
def obstructed_coverage(spark, sf_dir):
    """JOB3: the serving sector and its power at every sample, with the losses of the obstacles on the way."""
    best = coverage_states(spark, sf_dir).groupBy("site_id", "bearing_bin", "distance_m").agg(F.max_by(F.struct("sector_no", "p", "is_los"), F.struct(F.round("p", 6), -c("sector_no"))).alias("b"))
    return rounded(best.select("site_id", "bearing_bin", "distance_m", "b.sector_no", c("b.p").alias("rsrp_dbm"), "b.is_los"))


def coverage_states(spark, sf_dir) -> DataFrame:
    """Sample states with the power (p) of each sector of the site."""
    x = states(samples(spark, sf_dir), view(spark, sf_dir, "fx_obstacles"), view(spark, sf_dir, "fx_sites")).join(view(spark, sf_dir, "fx_sectors"), "site_id")
    lost = R.horizontal_loss_db(c("bearing_bin") * 5.0, c("azimuth_deg"), c("beamwidth_h_deg")) + R.vertical_loss_db(c("distance_m"), c("tx_height_m"), RX_M, c("beamwidth_v_deg"))
    return x.withColumn("p", R.reference_eirp_dbm(F.lit(TX_DBM), c("tx_antenna_gain_dbi")) - c("path_loss_db") - c("extra_loss_db") - lost)


MODES = "CASE WHEN pen > 0 THEN 'inside' WHEN extra > 0 THEN 'shadowed' ELSE 'open' END"


@query(
    f"""WITH {OBSTRUCTED_SQL}, o AS (SELECT site_id, bearing_bin, distance_m, max(p) AS p FROM z GROUP BY 1, 2, 3),
a AS (SELECT w.*, o.p - (-174 + 10 * log10(100000000) + 7) AS snr, {MODES} AS mode FROM w JOIN o USING (site_id, bearing_bin, distance_m)),
first AS (SELECT site_id, bearing_bin, distance_m, min_by(material, (start_m, obstacle_id)) AS material FROM j WHERE end_m > distance_m + 0.000001 GROUP BY 1, 2, 3),
m AS (SELECT a.*, coalesce(first.material, 'none') AS material, CASE WHEN snr >= 28 THEN '1024QAM' WHEN snr >= 20 THEN '256QAM' WHEN snr >= 12 THEN '64QAM' WHEN snr >= 5 THEN '16QAM' ELSE 'QPSK' END AS modulation FROM a LEFT JOIN first USING (site_id, bearing_bin, distance_m)),
ks AS (SELECT unnest([{{'what': 'material', 'name': material}}, {{'what': 'mode', 'name': mode}}, {{'what': 'modulation', 'name': modulation}}]) AS x, extra, is_los FROM m)
SELECT x.what AS what, x.name AS name, count(*) AS n, {r(extra_share='100.0 * count(*) FILTER (extra > 0.000001) / count(*)', mean_extra_db='avg(extra)', los_share='100.0 * count(*) FILTER (is_los) / count(*)')} FROM ks GROUP BY 1, 2""",
    "fx_obstacles",
    "fx_sites",
    "fx_sectors",
)
def lattice_summary(spark, sf_dir):
    """AG22, AG33: samples by material, by mode of propagation and by modulation: how many lose power to obstacles, how much on average, how many are in sight."""
    x = coverage_states(spark, sf_dir)
    best = x.groupBy("site_id", "bearing_bin", "distance_m").agg(F.max("p").alias("p"), F.first("penetration_db").alias("pen"), F.first("extra_loss_db").alias("extra"), F.first("is_los").alias("is_los"), F.first("first_active").getField("material").alias("material"))
    modulation, _ = R.modulation(c("p") - R.thermal_noise_dbm(100.0, 7.0))
    mode = F.when(~c("is_los"), "inside").when(c("extra") > 1e-6, "shadowed").otherwise("open")
    told = [("material", F.coalesce("material", F.lit("none"))), ("mode", mode), ("modulation", modulation)]
    each = best.select("extra", "is_los", F.explode(F.array(*[F.struct(F.lit(what).alias("what"), name.alias("name")) for what, name in told])).alias("x"))
    share = lambda ok: 100.0 * F.count_if(ok) / F.count("*")
    out = each.groupBy("x.what", "x.name").agg(F.count("*").alias("n"), share(c("extra") > 1e-6).alias("extra_share"), F.avg("extra").alias("mean_extra_db"), share(c("is_los")).alias("los_share"))
    return rounded(out)


# The fused channel ---------------------------------------------------------------------------

# Bits of the reasons why a target fails.
FAILURES = {"thermal_snr": 1, "doppler_resolution": 2, "doppler_ambiguity": 4, "direct_residual": 8, "dynamic_range": 16, "processing": 32, "environment_return": 64}


@dataclass(frozen=True)
class Channel:
    """A transmitter, a receiver, a kind of target and what processing can do."""

    tx: tuple[float, float, float] = TX
    rx: tuple[float, float, float] = RX
    tx_agl_m: float = 25.0
    rx_agl_m: float = 12.0
    hz: float = 3.5e9
    bandwidth_hz: float = 20e6
    integration_s: float = 0.1
    source_dbm: float = 60.0
    rcs_m2: float = 10.0
    height_m: float = 30.0
    speed_mps: float = 15.0
    heading_deg: float = 60.0
    climb_mps: float = 1.0
    echo_gain_dbi: float = 12.0
    direct_gain_dbi: float = 3.0
    feeder_db: float = 1.0
    system_db: float = 2.0
    noise_figure_db: float = 5.0
    interference_dbm: float | None = -98.0
    effective_gain_db: float | None = 58.0
    processing_loss_db: float = 1.5
    needed_snr_db: float = 13.0
    notch_hz: float = 5.0
    least_doppler_hz: float = 8.0
    prf_hz: float | None = 900.0
    cancellation_db: float = 70.0
    echo_to_residual_db: float = -15.0
    dynamic_range_db: float | None = 95.0
    need_direct: bool = True
    need_dynamic: bool = True
    need_interference: bool = True
    return_excess_db: float = 0.5
    direct_excess_db: float = 2.0

    @property
    def noise_dbm(self) -> float:
        thermal = R.thermal_noise_dbm(self.bandwidth_hz / 1e6, self.noise_figure_db)
        return thermal if self.interference_dbm is None else 10 * math.log10(10 ** (thermal / 10) + 10 ** (self.interference_dbm / 10))

    @property
    def gain_db(self) -> float:
        return 10 * math.log10(self.bandwidth_hz * self.integration_s) if self.effective_gain_db is None else self.effective_gain_db

    @property
    def qualified(self) -> bool:
        """Only a gain (and, by default, an interference) that was stated counts as more than a screening."""
        return self.effective_gain_db is not None and (self.interference_dbm is not None or not self.need_interference)

    @property
    def doppler_bar_hz(self) -> float:
        return max(1 / self.integration_s, self.notch_hz, self.least_doppler_hz)

    @property
    def velocity(self) -> tuple[float, float, float]:
        h = math.radians(self.heading_deg)
        return self.speed_mps * math.sin(h), self.speed_mps * math.cos(h), self.climb_mps


def direct_path(spark: SparkSession, returns: DataFrame | None, ch: Channel) -> DataFrame:
    """One row: what the receiver gets straight from the transmitter, and what cancellation leaves of it.

    With returns, their row nearest to the transmitter tells what the environment takes (reciprocity: the way back from there is
    the direct path) and whether it is in sight; the law of distance is taken anew between the true heights."""
    one = spark.range(1).select(*[e.alias(f"_{p}{i}") for p, place in (("a", ch.tx), ("b", ch.rx)) for i, e in enumerate(R.ecef(*map(F.lit, place)))])
    at = lambda p: tuple(c(f"_{p}{i}") for i in range(3))
    one = one.select(R.distance3(at("a"), at("b")).alias("direct_m"))
    free = 20 * F.log10(4 * math.pi * F.greatest(c("direct_m"), F.lit(1.0)) * ch.hz / R.LIGHT)
    if returns is None:
        lossy = one.select("direct_m", F.lit(0.0).alias("direct_environment_db"), F.lit(True).alias("direct_los"), free.alias("direct_loss_db"))
    else:
        far = F.pow(c("latitude") - ch.tx[0], 2) + F.pow((c("longitude") - ch.tx[1]) * math.cos(math.radians(ch.tx[0])), 2)
        usable = c("environment_loss_db").isNotNull() & ~F.isnan("environment_loss_db")
        nearest = returns.filter(usable).agg(F.min_by(F.struct("environment_loss_db", "los"), F.struct(far, "target_id")).alias("n"))
        dz = ch.tx[2] - ch.rx[2]
        d2 = F.sqrt(F.greatest(F.lit(1.0), c("direct_m") * c("direct_m") - dz * dz))
        canyon = R.street_canyon_loss_db(d2, c("direct_m"), F.lit(ch.hz / 1e6), F.lit(ch.tx_agl_m), ch.rx_agl_m, c("n.los"))
        known = c("n").isNotNull()
        lossy = one.crossJoin(nearest).select("direct_m", F.when(known, c("n.environment_loss_db")).otherwise(0.0).alias("direct_environment_db"), F.when(known, c("n.los")).otherwise(True).alias("direct_los"), F.when(known, canyon + c("n.environment_loss_db")).otherwise(free).alias("direct_loss_db"))
    got = ch.source_dbm - c("direct_loss_db") - ch.direct_excess_db + ch.direct_gain_dbi - ch.feeder_db
    return lossy.withColumn("direct_dbm", got).withColumn("residual_dbm", c("direct_dbm") - ch.cancellation_db)


def fused(coverage: DataFrame, illumination: DataFrame | None, returns: DataFrame | None, ch: Channel) -> DataFrame:
    """JOB24: sensing layers of every coverage row (target_id, latitude, longitude, z_ground_m, incident_power_dbm).

    The power at the target is the illumination's, solved at the target's height, where that has the row; else the coverage's own.
    The way back is the returns' path loss where returns are given (a row without a finite one is not valid), else free space.
    All joins are on target_id; the direct path is one row.
    """
    x = coverage.select("target_id", "latitude", "longitude", "z_ground_m", c("incident_power_dbm").alias("_own"))
    if illumination is None:
        x = x.withColumn("incident_dbm", c("_own")).withColumn("illuminated", F.lit(False))
    else:
        lit = illumination.select("target_id", c("incident_power_dbm").alias("_lit"))
        x = x.join(lit, "target_id", "left").withColumn("illuminated", c("_lit").isNotNull() & ~F.isnan("_lit")).withColumn("incident_dbm", F.when(c("illuminated"), c("_lit")).otherwise(c("_own")))
    if returns is not None:
        x = x.join(returns.select("target_id", c("path_loss_db").alias("_back"), c("environment_loss_db").alias("_env"), c("terrain_loss_db").alias("_ter"), c("los").alias("_los"), c("terrain_state").alias("_state"), c("sample_error_m").alias("_err")), "target_id", "left")
    a, o, up = F.radians("latitude"), F.radians("longitude"), c("z_ground_m") + ch.height_m
    points = [*R.ecef(c("latitude"), c("longitude"), up), *R.ecef(*map(F.lit, ch.tx)), *R.ecef(*map(F.lit, ch.rx))]
    x = x.crossJoin(F.broadcast(direct_path(coverage.sparkSession, returns, ch))).select("*", *[e.alias(f"_{p}{i}") for e, (p, i) in zip(points, [(p, i) for p in "tab" for i in range(3)], strict=True)])
    at = lambda p: tuple(c(f"_{p}{i}") for i in range(3))
    x = x.withColumn("tx_range_m", R.distance3(at("t"), at("a"))).withColumn("rx_range_m", R.distance3(at("t"), at("b")))
    unit = [(c(f"_t{i}") - c(f"_a{i}")) / F.greatest(c("tx_range_m"), F.lit(1e-12)) for i in range(3)], [(c(f"_t{i}") - c(f"_b{i}")) / F.greatest(c("rx_range_m"), F.lit(1e-12)) for i in range(3)]
    x = x.select("*", *[u.alias(f"_u{i}") for i, u in enumerate(unit[0])], *[u.alias(f"_w{i}") for i, u in enumerate(unit[1])])
    cos = sum((c(f"_u{i}") * c(f"_w{i}") for i in range(1, 3)), c("_u0") * c("_w0"))
    x = x.withColumn("path_m", c("tx_range_m") + c("rx_range_m")).withColumn("excess_m", c("path_m") - c("direct_m")).withColumn("excess_ns", c("excess_m") / R.LIGHT * 1e9)
    x = x.withColumn("angle_deg", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    s = [c(f"_u{i}") + c(f"_w{i}") for i in range(3)]
    k = ch.hz / R.LIGHT
    east = -k * (-F.sin(o) * s[0] + F.cos(o) * s[1])
    north = -k * (-F.sin(a) * F.cos(o) * s[0] - F.sin(a) * F.sin(o) * s[1] + F.cos(a) * s[2])
    high = -k * (F.cos(a) * F.cos(o) * s[0] + F.cos(a) * F.sin(o) * s[1] + F.sin(a) * s[2])
    x = x.withColumn("doppler_east", east).withColumn("doppler_north", north).withColumn("doppler_up", high)
    ve, vn, vu = ch.velocity
    speed = math.sqrt(ve * ve + vn * vn + vu * vu)
    x = x.withColumn("doppler_hz", c("doppler_east") * ve + c("doppler_north") * vn + c("doppler_up") * vu).withColumn("sensitivity", F.sqrt(F.pow("doppler_east", 2) + F.pow("doppler_north", 2) + F.pow("doppler_up", 2)))
    x = x.withColumn("motion_sensitivity", c("doppler_hz") / speed if speed > 0 else F.lit(0.0)).withColumn("least_speed_mps", F.when(c("sensitivity") > 1e-9, ch.doppler_bar_hz / c("sensitivity"))).withColumn("range_rate_mps", -c("doppler_hz") / k).withColumn("closing_mps", -c("range_rate_mps"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v)
    if returns is None:
        free = 20 * F.log10(4 * math.pi * F.greatest(c("rx_range_m"), F.lit(1.0)) * ch.hz / R.LIGHT)
        x = x.select("*", (free + ch.return_excess_db).alias("return_loss_db"), F.lit(0.0).alias("return_environment_db"), F.lit(0.0).alias("return_terrain_db"), F.lit(True).alias("return_los"), F.lit("free_space").alias("return_state"), F.lit(0.0).alias("return_error_m"), F.lit(True).alias("return_valid"))
    else:
        x = x.select("*", (c("_back") + ch.return_excess_db).alias("return_loss_db"), c("_env").alias("return_environment_db"), c("_ter").alias("return_terrain_db"), c("_los").alias("return_los"), c("_state").alias("return_state"), c("_err").alias("return_error_m"), (finite(c("_back")) & finite(c("_err"))).alias("return_valid"))
    base = c("incident_dbm") - c("return_loss_db") + 10 * math.log10(4 * math.pi) - 20 * math.log10(R.LIGHT / ch.hz)
    x = x.withColumn("echo_base_dbm", F.when(c("return_valid"), base)).withColumn("echo_dbm", c("echo_base_dbm") + ch.echo_gain_dbi - ch.feeder_db - ch.system_db + 10 * math.log10(max(ch.rcs_m2, 1e-18)))
    x = x.withColumn("pre_snr_db", c("echo_dbm") - ch.noise_dbm).withColumn("post_snr_db", c("pre_snr_db") + ch.gain_db - ch.processing_loss_db).withColumn("snr_margin_db", c("post_snr_db") - ch.needed_snr_db)
    x = x.withColumn("echo_to_residual_db", c("echo_dbm") - c("residual_dbm")).withColumn("direct_margin_db", c("echo_to_residual_db") - ch.echo_to_residual_db)
    x = x.withColumn("needed_cancellation_db", F.greatest(F.lit(0.0), c("direct_dbm") - c("echo_dbm") + ch.echo_to_residual_db)).withColumn("needed_range_db", c("direct_dbm") - c("echo_dbm"))
    x = x.withColumn("range_margin_db", F.lit(None).cast("double") if ch.dynamic_range_db is None else ch.dynamic_range_db - c("needed_range_db"))
    margins = [c("snr_margin_db"), *([c("direct_margin_db")] if ch.need_direct else []), *([c("range_margin_db")] if ch.need_dynamic and ch.dynamic_range_db is not None else [])]
    least = F.lit(None).cast("double") if ch.need_dynamic and ch.dynamic_range_db is None else margins[0] if len(margins) == 1 else F.when(margins[0].isNotNull(), F.least(*margins))
    x = x.withColumn("rcs_margin_db", least).withColumn("least_rcs_m2", ch.rcs_m2 * F.pow(F.lit(10.0), -c("rcs_margin_db") / 10))
    ok = lambda margin: F.coalesce(margin >= 0, F.lit(False))
    x = x.withColumn("snr_ok", ok(c("snr_margin_db"))).withColumn("resolved", F.abs("doppler_hz") >= ch.doppler_bar_hz).withColumn("ambiguous", F.lit(False) if ch.prf_hz is None else F.abs("doppler_hz") > ch.prf_hz / 2)
    x = x.withColumn("direct_ok", ok(c("direct_margin_db")) if ch.need_direct else F.lit(True)).withColumn("range_ok", ok(c("range_margin_db")) if ch.need_dynamic else F.lit(True))
    x = x.withColumn("screened", c("snr_ok") & c("resolved") & ~c("ambiguous") & c("direct_ok") & c("range_ok") & c("return_valid")).withColumn("detectable", c("screened") & F.lit(ch.qualified))
    why = {"thermal_snr": ~c("snr_ok"), "doppler_resolution": ~c("resolved"), "doppler_ambiguity": c("ambiguous"), "direct_residual": ~c("direct_ok"), "dynamic_range": ~c("range_ok"), "processing": F.lit(not ch.qualified), "environment_return": ~c("return_valid")}
    x = x.withColumn("failure_code", sum((F.when(bad, FAILURES[name]).otherwise(0) for name, bad in why.items()), F.lit(0)))
    return x.select(*[n for n in x.columns if not n.startswith("_")])


LAYERS = ("incident_dbm", "tx_range_m", "rx_range_m", "path_m", "excess_m", "excess_ns", "angle_deg", "doppler_east", "doppler_north", "doppler_up", "doppler_hz", "sensitivity", "motion_sensitivity", "least_speed_mps", "range_rate_mps", "closing_mps", "return_loss_db", "return_environment_db", "return_terrain_db", "return_error_m", "echo_base_dbm", "echo_dbm", "pre_snr_db", "post_snr_db", "snr_margin_db", "echo_to_residual_db", "direct_margin_db", "needed_cancellation_db", "needed_range_db", "range_margin_db", "rcs_margin_db", "least_rcs_m2")
FLAGS = ("illuminated", "snr_ok", "resolved", "ambiguous", "direct_ok", "range_ok", "return_valid", "return_los", "screened", "detectable")


def _channel_sql(ch: Channel) -> str:
    """The fused channel of fx_targets, fx_illumination and fx_returns, restated for one configuration."""
    k, (ve, vn, vu) = ch.hz / R.LIGHT, ch.velocity
    speed = math.sqrt(ve * ve + vn * vn + vu * vu)
    d = lambda v: f"{v!r}::DOUBLE"
    ghz, bend = ch.hz / 1e9, f"greatest(10, 4 * greatest(1, {ch.tx_agl_m} - 1) * greatest(1, {ch.rx_agl_m} - 1) * {ch.hz / 1e9} * 1000000000 / 300000000)"
    sight = f"CASE WHEN greatest(10, d2) <= {bend} THEN 32.4 + 21 * log10(greatest(10, direct_m)) + 20 * log10({ghz}) ELSE 32.4 + 40 * log10(greatest(10, direct_m)) + 20 * log10({ghz}) - 9.5 * log10({bend} * {bend} + pow({ch.tx_agl_m} - {ch.rx_agl_m}, 2)) END"
    hidden = f"22.4 + 35.3 * log10(greatest(10, direct_m)) + 21.3 * log10({ghz}) - 0.3 * ({ch.rx_agl_m} - 1.5)"
    return f"""e AS (SELECT t.*, i.incident_power_dbm AS lit, q.path_loss_db, q.environment_loss_db, q.terrain_loss_db, q.los, q.terrain_state, q.sample_error_m,
  {_ecef_sql('t', 't.latitude', 't.longitude', f'(z_ground_m + {ch.height_m})')}, {_ecef_sql('a', *map(d, ch.tx))}, {_ecef_sql('c', *map(d, ch.rx))}
  FROM fx_targets t LEFT JOIN fx_illumination i USING (target_id) LEFT JOIN fx_returns q USING (target_id)),
n AS (SELECT environment_loss_db AS direct_environment_db, los AS direct_los FROM fx_returns ORDER BY pow(latitude - {d(ch.tx[0])}, 2) + pow((longitude - {d(ch.tx[1])}) * cos(radians({d(ch.tx[0])})), 2), target_id LIMIT 1),
g AS (SELECT *, {_far('t', 'a')} AS tx_range_m, {_far('t', 'c')} AS rx_range_m, {_far('a', 'c')} AS direct_m FROM e),
g2 AS (SELECT *, sqrt(greatest(1, direct_m * direct_m - pow({ch.tx[2]} - {ch.rx[2]}, 2))) AS d2 FROM g),
u AS (SELECT g2.*, n.*, CASE WHEN n.direct_los THEN {sight} ELSE greatest({sight}, {hidden}) END + direct_environment_db AS direct_loss_db,
  {', '.join(f"(t{x} - a{x}) / greatest(tx_range_m, 0.000000000001::DOUBLE) AS u{x}, (t{x} - c{x}) / greatest(rx_range_m, 0.000000000001::DOUBLE) AS w{x}" for x in 'xyz')} FROM g2, n),
v AS (SELECT *, {ch.source_dbm} - direct_loss_db - {ch.direct_excess_db} + {ch.direct_gain_dbi} - {ch.feeder_db} AS direct_dbm, radians(latitude) AS a, radians(longitude) AS o, ux + wx AS sx, uy + wy AS sy, uz + wz AS sz,
  coalesce(NOT isnan(lit), false) AS illuminated, coalesce(NOT isnan(path_loss_db) AND NOT isnan(sample_error_m), false) AS return_valid FROM u),
dop AS (SELECT *, -({d(k)}) * (-sin(o) * sx + cos(o) * sy) AS doppler_east, -({d(k)}) * (-sin(a) * cos(o) * sx - sin(a) * sin(o) * sy + cos(a) * sz) AS doppler_north, -({d(k)}) * (cos(a) * cos(o) * sx + cos(a) * sin(o) * sy + sin(a) * sz) AS doppler_up,
  direct_dbm - {ch.cancellation_db} AS residual_dbm, CASE WHEN illuminated THEN lit ELSE incident_power_dbm END AS incident_dbm, path_loss_db + {ch.return_excess_db} AS return_loss_db FROM v),
l1 AS (SELECT *, doppler_east * {d(ve)} + doppler_north * {d(vn)} + doppler_up * {d(vu)} AS doppler_hz, sqrt(doppler_east * doppler_east + doppler_north * doppler_north + doppler_up * doppler_up) AS sensitivity,
  CASE WHEN return_valid THEN incident_dbm - return_loss_db + 10 * log10(4 * pi()) - 20 * log10({d(R.LIGHT)} / {d(ch.hz)}) END AS echo_base_dbm FROM dop),
l2 AS (SELECT *, echo_base_dbm + {ch.echo_gain_dbi} - {ch.feeder_db} - {ch.system_db} + 10 * log10({ch.rcs_m2}) AS echo_dbm FROM l1),
l3 AS (SELECT *, echo_dbm - ({d(ch.noise_dbm)}) AS pre_snr_db, echo_dbm - ({d(ch.noise_dbm)}) + {d(ch.gain_db)} - {ch.processing_loss_db} AS post_snr_db, echo_dbm - residual_dbm AS echo_to_residual_db, direct_dbm - echo_dbm AS needed_range_db FROM l2),
l4 AS (SELECT *, post_snr_db - {ch.needed_snr_db} AS snr_margin_db, echo_to_residual_db - ({ch.echo_to_residual_db}) AS direct_margin_db, {ch.dynamic_range_db} - needed_range_db AS range_margin_db FROM l3),
l5 AS (SELECT *, CASE WHEN echo_dbm IS NOT NULL THEN least(snr_margin_db, direct_margin_db, range_margin_db) END AS rcs_margin_db, coalesce(snr_margin_db >= 0, false) AS snr_ok, abs(doppler_hz) >= {d(ch.doppler_bar_hz)} AS resolved, abs(doppler_hz) > {ch.prf_hz} / 2 AS ambiguous,
  coalesce(direct_margin_db >= 0, false) AS direct_ok, coalesce(range_margin_db >= 0, false) AS range_ok FROM l4),
ch AS (SELECT target_id, tx_range_m, rx_range_m, tx_range_m + rx_range_m AS path_m, tx_range_m + rx_range_m - direct_m AS excess_m, (tx_range_m + rx_range_m - direct_m) / {d(R.LIGHT)} * 1000000000 AS excess_ns, degrees(acos(greatest(-1, least(1, ux * wx + uy * wy + uz * wz)))) AS angle_deg,
  doppler_east, doppler_north, doppler_up, doppler_hz, sensitivity, doppler_hz / {d(speed)} AS motion_sensitivity, CASE WHEN sensitivity > 0.000000001 THEN {d(ch.doppler_bar_hz)} / sensitivity END AS least_speed_mps, -doppler_hz / {d(k)} AS range_rate_mps, doppler_hz / {d(k)} AS closing_mps,
  incident_dbm, return_loss_db, environment_loss_db AS return_environment_db, terrain_loss_db AS return_terrain_db, sample_error_m AS return_error_m, los AS return_los, terrain_state AS return_state, echo_base_dbm, echo_dbm, pre_snr_db, post_snr_db, snr_margin_db, echo_to_residual_db, direct_margin_db,
  greatest(0, direct_dbm - echo_dbm + ({ch.echo_to_residual_db})) AS needed_cancellation_db, needed_range_db, range_margin_db, rcs_margin_db, {ch.rcs_m2} * pow(10, -rcs_margin_db / 10) AS least_rcs_m2, direct_environment_db, direct_los, direct_loss_db, direct_dbm, residual_dbm,
  illuminated, snr_ok, resolved, ambiguous, direct_ok, range_ok, return_valid, snr_ok AND resolved AND NOT ambiguous AND direct_ok AND range_ok AND return_valid AS screened,
  CAST(CASE WHEN snr_ok THEN 0 ELSE 1 END + CASE WHEN resolved THEN 0 ELSE 2 END + CASE WHEN ambiguous THEN 4 ELSE 0 END + CASE WHEN direct_ok THEN 0 ELSE 8 END + CASE WHEN range_ok THEN 0 ELSE 16 END + {0 if ch.qualified else 32} + CASE WHEN return_valid THEN 0 ELSE 64 END AS INT) AS failure_code FROM l5),
c AS (SELECT *, screened AND {ch.qualified} AS detectable FROM ch)"""


CHANNEL = Channel()
COARSE = {n: 5 for n in LAYERS} | {n: 3 for n in ("tx_range_m", "rx_range_m", "path_m", "excess_m", "excess_ns", "angle_deg", "least_rcs_m2")}
FIELDS = ("fx_targets", "fx_illumination", "fx_returns")


def _digits(names) -> str:
    """Coordinates of the earth's size leave some digits to the order of operations."""
    return ", ".join(f"CASE WHEN isnan({n}) THEN NULL ELSE round({n}, {COARSE.get(n, 5)}) + 0.0 END AS {n}" for n in names)


def layers(*names: str) -> list:
    return [F.when(~F.isnan(n), F.round(n, COARSE.get(n, 5)) + F.lit(0.0)).alias(n) for n in names]


def fused_of(spark, sf_dir, ch: Channel = CHANNEL) -> DataFrame:
    return fused(*(view(spark, sf_dir, n) for n in FIELDS), ch)


@query(f"WITH {_channel_sql(CHANNEL)} SELECT target_id, {_digits(LAYERS)}, {', '.join(FLAGS)}, return_state, failure_code FROM c", *FIELDS)
def fused_channel(spark, sf_dir):
    """JOB24, JOB7, JOB8, JOB10: all sensing layers of each target, from coverage, illumination and returns by presence."""
    x = fused_of(spark, sf_dir)
    return x.select("target_id", *layers(*LAYERS), *FLAGS, "return_state", "failure_code")


@query(
    f"""WITH {_channel_sql(CHANNEL)}, f AS (SELECT target_id, CASE WHEN isnan(rcs_margin_db) THEN NULL ELSE rcs_margin_db END AS m, screened, detectable FROM c),
b AS (SELECT (SELECT target_id FROM f WHERE m IS NOT NULL ORDER BY round(m, 6) DESC, target_id LIMIT 1) AS best_margin_id, (SELECT target_id FROM f WHERE screened ORDER BY round(m, 6) DESC, target_id LIMIT 1) AS best_screened_id, (SELECT target_id FROM f WHERE detectable ORDER BY round(m, 6) DESC, target_id LIMIT 1) AS best_detectable_id)
SELECT count(*) AS n, count(*) FILTER (resolved) AS n_resolved, count(*) FILTER (ambiguous) AS n_ambiguous, count(*) FILTER (direct_ok) AS n_direct_ok, count(*) FILTER (range_ok) AS n_range_ok, count(*) FILTER (return_valid) AS n_return_valid, count(*) FILTER (illuminated) AS n_illuminated,
  count(*) FILTER (screened) AS n_screened, count(*) FILTER (detectable) AS n_detectable, {', '.join(f'round(max({x}), 5) + 0.0 AS {x}' for x in ('direct_environment_db', 'direct_loss_db', 'direct_dbm', 'residual_dbm'))}, bool_or(direct_los) AS direct_los, any_value(best_margin_id) AS best_margin_id, any_value(best_screened_id) AS best_screened_id, any_value(best_detectable_id) AS best_detectable_id FROM c, b""",
    *FIELDS,
)
def fused_summary(spark, sf_dir):
    """JOB24: counts of the constraints, the direct path and the best targets of a fused table, in one row."""
    x = fused_of(spark, sf_dir).withColumn("m", F.when(~F.isnan("rcs_margin_db"), F.round("rcs_margin_db", 6)))
    best = lambda ok: F.max_by("target_id", F.when(ok & c("m").isNotNull(), F.struct("m", -c("target_id"))))
    counts = {"n_resolved": "resolved", "n_ambiguous": "ambiguous", "n_direct_ok": "direct_ok", "n_range_ok": "range_ok", "n_return_valid": "return_valid", "n_illuminated": "illuminated", "n_screened": "screened", "n_detectable": "detectable"}
    a = x.agg(F.count("*").alias("n"), *[F.count_if(v).alias(n) for n, v in counts.items()], *[F.max(n).alias(n) for n in ("direct_environment_db", "direct_loss_db", "direct_dbm", "residual_dbm")], F.bool_or("direct_los").alias("direct_los"), best(F.lit(True)).alias("best_margin_id"), best(c("screened")).alias("best_screened_id"), best(c("detectable")).alias("best_detectable_id"))
    return rounded(a, 5)


PROBED = ("doppler_hz", "return_loss_db", "echo_dbm", "post_snr_db", "rcs_margin_db")


@query(
    f"""WITH {_channel_sql(CHANNEL)}, d AS (SELECT s.site_id, t.target_id, sqrt(pow(radians(t.longitude - s.longitude) * 6371000.0::DOUBLE * cos(radians(s.latitude)), 2) + pow(radians(t.latitude - s.latitude) * 6371000.0::DOUBLE, 2)) AS query_distance_m FROM fx_sites s, fx_targets t),
nr AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(query_distance_m, 6), target_id) AS i FROM d)
SELECT site_id, target_id, {near(query_distance_m='query_distance_m')}, {_digits(PROBED)}, detectable, failure_code FROM nr JOIN c USING (target_id) WHERE i = 1""",
    "fx_targets",
    "fx_illumination",
    "fx_returns",
    "fx_sites",
)
def probe_values(spark, sf_dir):
    """JN18: the sensing layers at the target nearest to each site, as a click there would show them."""
    places = view(spark, sf_dir, "fx_targets").select("target_id", "latitude", "longitude")
    x = probed(places, view(spark, sf_dir, "fx_sites").select("site_id", "latitude", "longitude"), "site_id", "target_id").drop("latitude", "longitude")
    x = x.join(fused_of(spark, sf_dir), "target_id")
    return x.select("site_id", "target_id", (F.round("query_distance_m", 4) + F.lit(0.0)).alias("query_distance_m"), *layers(*PROBED), "detectable", "failure_code")


@query(
    f"WITH {_channel_sql(CHANNEL)} SELECT failure_code, return_state, count(*) AS n, round(avg(snr_margin_db), 5) + 0.0 AS mean_margin_db FROM c GROUP BY failure_code, return_state",
    *FIELDS,
)
def failure_reasons(spark, sf_dir):
    """JOB24, AG23: how many targets fail for which reasons, by the state of the way back."""
    return rounded(fused_of(spark, sf_dir).groupBy("failure_code", "return_state").agg(F.count("*").alias("n"), F.avg("snr_margin_db").alias("mean_margin_db")), 5)
