"""Loss models, broadcast coverage, carriers and terrain, as tables over the lattice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import broadcast as B
from ..functions import radio as R
from ..functions import text as X
from ..functions.geo import bearing_bin
from ..sources.views import view, with_views
from .field import LATTICE_SQL, RX_M, lattice
from .measurement import r, rounded

Q, SQL = {}, {}
c = F.col


def query(sql: str | None = None, *names: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


D3 = "sqrt(distance_m * distance_m + pow(tx_height_m - 1.5, 2))"


@query(
    f"""WITH {LATTICE_SQL}, k AS (SELECT *, {D3} AS d3, greatest(10, 4 * greatest(1, tx_height_m - 1) * 3.5 * 1000000000 / 300000000) AS bend FROM l),
p AS (SELECT *, CASE WHEN distance_m <= bend THEN 28 + 22 * log10(greatest(d3, 10)) + 20 * log10(3.5) ELSE 28 + 40 * log10(greatest(d3, 10)) + 20 * log10(3.5) - 9 * log10(bend * bend + pow(tx_height_m - 1.5, 2)) END AS macro_los_db,
  13.54 + 39.08 * log10(greatest(d3, 10)) + 20 * log10(3.5) AS hidden, 32.45 + 20 * log10(greatest(d3 / 1000, 0.001)) + 20 * log10(3500) AS broadcast_db FROM k)
SELECT site_id, CAST(bearing_deg AS INT) AS bearing_deg, {r('distance_m', 'macro_los_db', 'broadcast_db', macro_nlos_db='greatest(macro_los_db, hidden)', legacy_nlos_db='broadcast_db + 12 + 0.02 * greatest(0, d3 - 50)')} FROM p""",
    "fx_sites",
)
def scenario_losses(spark, sf_dir):
    """RF3, RF4: macro, legacy and broadcast losses of every sample."""
    x = lattice(view(spark, sf_dir, "fx_sites"))
    d3 = F.sqrt(c("distance_m") * c("distance_m") + F.pow(c("tx_height_m") - RX_M, 2))
    loss = lambda model, los: R.scenario_loss_db(model, c("distance_m"), d3, c("freq_mhz"), c("tx_height_m"), RX_M, F.lit(los))
    return rounded(x.select("site_id", "bearing_deg", "distance_m", loss("macro", True).alias("macro_los_db"), loss("broadcast", True).alias("broadcast_db"), loss("macro", False).alias("macro_nlos_db"), loss("legacy", False).alias("legacy_nlos_db")))


@query(
    f"""WITH {LATTICE_SQL}, p AS (SELECT *, 20 * log10(distance_m) + 20 * log10(3500) + 32.44 + 1.5 * 20 * log10(distance_m) + 15 AS urban_db, 20 * log10(distance_m) + 20 * log10(3500) + 32.44 + 2 * 20 * log10(distance_m) + 15 AS indoor_db FROM l)
SELECT site_id, CAST(bearing_deg AS INT) AS bearing_deg, {r('distance_m', 'urban_db', 'indoor_db', received_dbm='43 + 3 - urban_db - 2', snr_db='43 + 3 - urban_db - 2 + 174')} FROM p""",
    "fx_sites",
)
def placement_losses(spark, sf_dir):
    """SC24, SC25, SC34: losses by environment without a drawn shadow, received power and its SNR over -174 dBm."""
    x = lattice(view(spark, sf_dir, "fx_sites"))
    loss = lambda e: R.placement_loss_db(c("distance_m"), c("freq_mhz"), e)
    got = R.received_dbm(c("tx_power_dbm"), F.lit(3.0), loss("urban"))
    return rounded(x.select("site_id", "bearing_deg", "distance_m", loss("urban").alias("urban_db"), loss("indoor").alias("indoor_db"), got.alias("received_dbm"), (got + 174).alias("snr_db")))


KINDS_SQL = "kd(kind, base, each) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in R.KIND_DB.items()) + ")"


@query(
    f"""WITH {KINDS_SQL}, n AS (SELECT site_id, bearing_bin, count(*) AS n, max(CAST(material = 'wood' AS INT)) AS trees, max_by(material, (end_m - start_m, -obstacle_id)) AS widest FROM fx_obstacles GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN trees = 1 THEN 'trees' WHEN n >= 3 THEN 'large_structure' WHEN n = 2 THEN 'building' ELSE 'house' END AS kind FROM n)
SELECT site_id, bearing_bin, kind, n, {r(loss_db='greatest(0, (base + each * n) * 0.75 - 2)', reflection_db="8 + CASE widest WHEN 'metal' THEN 3 WHEN 'concrete' THEN 7 WHEN 'brick' THEN 8 WHEN 'glass' THEN 6 WHEN 'wood' THEN 12 ELSE 9 END + 6 * (1 - abs(cos(radians(bearing_bin * 5))))")} FROM k JOIN kd USING (kind)""",
    "fx_obstacles",
)
def bearing_kinds(spark, sf_dir):
    """AG39, RF17, RF18: kind of obstacle of each bearing by its count, vegetation first; its loss, and a reflection's off the widest obstacle."""
    o = view(spark, sf_dir, "fx_obstacles")
    a = o.groupBy("site_id", "bearing_bin").agg(F.count("*").alias("n"), F.max(c("material") == "wood").alias("trees"), F.max_by("material", F.struct(c("end_m") - c("start_m"), -c("obstacle_id"))).alias("widest"))
    a = a.withColumn("kind", F.when(c("trees"), "trees").when(c("n") >= 3, "large_structure").when(c("n") == 2, "building").otherwise("house"))
    return rounded(a.select("site_id", "bearing_bin", "kind", "n", R.kind_loss_db(c("kind"), c("n")).alias("loss_db"), R.reflection_loss_db(c("widest"), F.cos(F.radians(c("bearing_bin") * 5.0))).alias("reflection_db")))


@query(
    f"""WITH p AS (SELECT *, 50 + site_id % 50 AS blocks, 15.0::DOUBLE * pow(2, site_id % 3) AS spacing, ['SISO', 'SIMO', 'MISO', 'MIMO'][(site_id % 4 + 1)::INT] AS mode, 2 + site_id % 3 AS tx, 2 + site_id % 2 AS rx FROM fx_sites),
q AS (SELECT *, CASE mode WHEN 'SIMO' THEN rx WHEN 'MISO' THEN tx WHEN 'MIMO' THEN least(tx, rx) ELSE 1 END AS k FROM p)
SELECT site_id, mode, {r(occupied_mhz='blocks * 12 * spacing / 1000', symbol_us='1000 / spacing * 1.07', diversity_db='3 * log2(k)', streams="CASE WHEN mode = 'MIMO' THEN least(tx, rx) ELSE 1 END", carrier_eirp_dbm='43 + 17 - 1.5')} FROM q""",
    "fx_sites",
)
def carrier_parameters(spark, sf_dir):
    """RF16, RF25, RF28: bandwidth and symbol time, antenna modes, and the total carrier's radiated power."""
    i = c("site_id")
    p = view(spark, sf_dir, "fx_sites").withColumn("blocks", 50 + i % 50).withColumn("spacing", 15.0 * F.pow(F.lit(2.0), i % 3)).withColumn("mode", F.element_at(F.array(*map(F.lit, ("SISO", "SIMO", "MISO", "MIMO"))), (i % 4 + 1).cast("int")))
    gain, streams = R.diversity(c("mode"), 2 + i % 3, 2 + i % 2)
    return rounded(p.select("site_id", "mode", R.occupied_mhz(c("blocks"), c("spacing")).alias("occupied_mhz"), R.symbol_us(c("spacing")).alias("symbol_us"), gain.alias("diversity_db"), streams.alias("streams"), R.carrier_eirp_dbm(c("tx_power_dbm"), F.lit(17.0), 0, 1.5).alias("carrier_eirp_dbm")))


#: A tabulated pattern (azimuth, field ratios of both polarisations) and powers of the broadcast example.
PATTERN = ((0.0, 1.0, 0.9), (90.0, 0.7, 0.8), (180.0, 0.3, 0.5), (270.0, 0.6, 0.7))
ERP_H_KW, ERP_V_KW, ROTATION, TILT, WIDTH_V, BROADCAST_MHZ, BAND_MHZ = 6.0, 4.0, 30.0, 1.0, 10.0, 600.0, 6.0
PATTERN_SQL = "pt(u, h, v) AS (VALUES " + ", ".join(f"({u}::DOUBLE, {h}::DOUBLE, {v}::DOUBLE)" for u, h, v in (*PATTERN, (360.0, *PATTERN[0][1:]))) + ")"


@query(
    f"""WITH {PATTERN_SQL}, {LATTICE_SQL}, a AS (SELECT *, (((bearing_deg - 30) % 360) + 360) % 360 AS rel FROM l),
s AS (SELECT u, h, v, lead(u) OVER (ORDER BY u) AS u2, lead(h) OVER (ORDER BY u) AS h2, lead(v) OVER (ORDER BY u) AS v2 FROM pt),
f AS (SELECT a.*, h + (h2 - h) * (rel - u) / (u2 - u) AS fh, v + (v2 - v) * (rel - u) / (u2 - u) AS fv FROM a JOIN s ON rel >= u AND rel < u2),
e AS (SELECT *, 10 * log10(pow(10, (10 * log10(6 * 1000000) + 2.15 + 20 * log10(fh)) / 10) + pow(10, (10 * log10(4 * 1000000) + 2.15 + 20 * log10(fv)) / 10)) AS eirp_dbm,
  32.45 + 20 * log10({D3} / 1000) + 20 * log10(600) AS loss_db, least(12 * pow((degrees(atan2(greatest(0, tx_height_m - 1.5), distance_m)) - 1) / 10, 2), 30) AS vertical_db,
  least(12 * pow((degrees(atan2(tx_height_m - 25, distance_m)) - 1) / 10, 2), 30) AS signed_vertical_db FROM f),
g AS (SELECT *, eirp_dbm - vertical_db - loss_db AS incident_dbm FROM e)
SELECT site_id, CAST(bearing_deg AS INT) AS bearing_deg, {r('distance_m', 'eirp_dbm', 'loss_db', 'vertical_db', 'signed_vertical_db', 'incident_dbm', received_dbm='incident_dbm + 2', field_dbuv_m='incident_dbm + 20 * log10(600) + 77.2', carrier_to_noise_db='incident_dbm + 2 - (-174 + 10 * log10(6000000) + 7)')} FROM g""",
    "fx_sites",
)
def broadcast_coverage(spark, sf_dir):
    """JOB4, RF8-RF10, RF24, RF26, RF27: radiated power by a tabulated pattern of two polarisations, losses, power, field strength and carrier to noise of each sample."""
    x = lattice(view(spark, sf_dir, "fx_sites"))
    pattern = lambda k: F.array(*[F.struct(F.lit(p[0]).alias("u"), B.field_ratio(F.lit(p[k]), F.lit(None).cast("double")).alias("z")) for p in PATTERN])
    loss = lambda k: B.tabulated_loss_db(pattern(k), c("bearing_deg"), F.lit(ROTATION))
    x = x.withColumn("eirp_dbm", B.polarised_eirp_dbm(F.lit(ERP_H_KW), loss(1), F.lit(ERP_V_KW), loss(2)))
    d3 = F.sqrt(c("distance_m") * c("distance_m") + F.pow(c("tx_height_m") - RX_M, 2))
    x = x.withColumn("loss_db", R.scenario_loss_db("broadcast", c("distance_m"), d3, F.lit(BROADCAST_MHZ), c("tx_height_m"), RX_M, F.lit(True)))
    x = x.withColumn("vertical_db", R.vertical_loss_db(c("distance_m"), c("tx_height_m"), RX_M, F.lit(WIDTH_V), TILT)).withColumn("signed_vertical_db", R.signed_vertical_loss_db(c("distance_m"), c("tx_height_m"), F.lit(25.0), WIDTH_V, TILT))
    x = x.withColumn("incident_dbm", c("eirp_dbm") - c("vertical_db") - c("loss_db")).withColumn("received_dbm", c("incident_dbm") + 2.0)
    noise = R.thermal_noise_dbm(BAND_MHZ, 7.0)
    return rounded(x.select("site_id", "bearing_deg", "distance_m", "eirp_dbm", "loss_db", "vertical_db", "signed_vertical_db", "incident_dbm", "received_dbm", B.field_strength_dbuv_m(c("received_dbm"), F.lit(BROADCAST_MHZ), 2.0).alias("field_dbuv_m"), (c("received_dbm") - noise).alias("carrier_to_noise_db")))


TERRAIN_SQL = """pr AS (SELECT site_id, tx_height_m, b.b AS bearing_deg, u.u::DOUBLE AS u, 20.0::DOUBLE * sin(radians(((site_id * 13 + b.b + u.u) % 360)::DOUBLE)) AS z FROM fx_sites, (SELECT unnest(range(0, 360, 90)) AS b) b, (SELECT unnest(range(100, 801, 100)) AS u) u)"""


def profiles(spark, sf_dir) -> DataFrame:
    """JOB20: terrain points every 100 m on four bearings of each site; heights are made from their keys."""
    x = view(spark, sf_dir, "fx_sites").select("site_id", "tx_height_m", F.explode(F.sequence(F.lit(0), F.lit(270), F.lit(90))).alias("bearing_deg")).withColumn("u", F.explode(F.sequence(F.lit(100), F.lit(800), F.lit(100)).cast("array<double>")))
    return x.withColumn("z", 20.0 * F.sin(F.radians((c("site_id") * 13 + c("bearing_deg") + c("u").cast("int")) % 360)))


def terrain_states(points: DataFrame, keys: list[str], rx_m: float, mhz: float, clutter_m: float = 0.0, k: float = 4 / 3, eta: float = 0.6, cap_db: float = 40.0) -> DataFrame:
    """WIN9, RF13: of each sample (a point of its own profile, of columns u and z, transmitter at tx_height_m), by the points up to it:
    the least clearance in Fresnel radii, the worst obstruction, whether it lies in sight, the state and the loss.

    A profile is gathered in one row, of which each of its samples takes what lies before it: the profile's length is bounded, not the table's.
    """
    wave = 299_792_458.0 / (mhz * 1e6)
    whole = points.filter(" AND ".join(f"{n} IS NOT NULL" for n in (*keys, "u")))
    held = whole.groupBy(*keys).agg(F.collect_list(F.struct("tx_height_m", "u", "z")).alias("_points"))
    ends = F.array_distinct(F.transform("_points", lambda p: F.struct(p["tx_height_m"].alias("tx_height_m"), p["u"].alias("d"))))
    x = held.select(*keys, "_points", F.inline(ends))

    def seen(p: Column) -> Column:
        ground = p["z"] + R.earth_bulge_m(p["u"], c("d"), k) + clutter_m
        h = ground - (c("tx_height_m") + p["u"] / c("d") * (rx_m - c("tx_height_m")))
        return F.struct(h.alias("h"), (-p["u"]).alias("back"), R.fresnel_radius_m(p["u"], c("d"), wave).alias("f1"), F.when(p["u"] > 1, (ground - c("tx_height_m")) / p["u"]).alias("alpha"))

    x = x.withColumn("_seen", F.transform(F.filter("_points", lambda p: p["u"] <= c("d") + 1e-6), seen))
    a = x.select(*keys, "tx_height_m", "d", F.array_min(F.transform("_seen", lambda s: F.when(s["f1"] > 1e-6, s["h"] / s["f1"]))).alias("q"), F.array_max(F.transform("_seen", lambda s: s["alpha"])).alias("alpha"), F.array_max("_seen").alias("worst"))
    a = a.withColumn("q", F.coalesce("q", F.lit(1e9))).withColumn("d1", -c("worst.back")).withColumn("wh", c("worst.h"))
    shadow = (rx_m - c("tx_height_m")) / c("d") <= c("alpha") + eta * wave / c("d")
    state = F.when(c("q") >= eta, "los").when(c("q") >= 0, "fresnel_partial").when(shadow, "terrain_shadow").otherwise("terrain_diffraction")
    bend = lambda w: F.least(F.lit(cap_db), R.knife_edge_loss_db(w * F.sqrt(2 * c("d") / (wave * c("d1") * F.greatest(F.lit(1.0), c("d") - c("d1"))))))
    loss = F.when(c("state") == "los", 0.0).when(c("state") == "fresnel_partial", F.greatest(F.lit(0.0), (eta - c("q")) * 6)).when(c("state") == "terrain_shadow", bend(c("wh"))).otherwise(bend(F.greatest(F.lit(0.0), c("wh"))))
    return a.withColumn("state", state).withColumn("loss_db", loss).withColumn("clearance", F.when(c("q") < 1e8, c("q")).otherwise(1.0))


WAVE = 299_792_458.0 / 3.5e9


@query(
    f"""WITH {TERRAIN_SQL}, x AS (SELECT e.site_id, e.bearing_deg, e.tx_height_m AS t, e.u AS d, p.u, p.z + p.u * greatest(0, e.u - p.u) / (2 * 4 / 3 * 6371000.0::DOUBLE) AS zo FROM pr e JOIN pr p ON e.site_id = p.site_id AND e.bearing_deg = p.bearing_deg AND p.u <= e.u),
y AS (SELECT *, zo - (t + u / d * (1.5 - t)) AS h, CASE WHEN u < d THEN sqrt({WAVE!r}::DOUBLE * u * (d - u) / d) ELSE 0 END AS f1 FROM x),
a AS (SELECT site_id, bearing_deg, t, d, coalesce(min(CASE WHEN f1 > 0.000001 THEN h / f1 END), 1000000000) AS q, max((zo - t) / u) AS alpha, max(h) AS wh, min_by(u, (-h, u)) AS d1 FROM y GROUP BY 1, 2, 3, 4),
s AS (SELECT *, CASE WHEN q >= 0.6 THEN 'los' WHEN q >= 0 THEN 'fresnel_partial' WHEN (1.5 - t) / d <= alpha + 0.6 * {WAVE!r}::DOUBLE / d THEN 'terrain_shadow' ELSE 'terrain_diffraction' END AS state FROM a),
n AS (SELECT *, (CASE WHEN state = 'terrain_shadow' THEN wh ELSE greatest(0, wh) END) * sqrt(2 * d / ({WAVE!r}::DOUBLE * d1 * greatest(1, d - d1))) AS nu FROM s)
SELECT site_id, CAST(bearing_deg AS INT) AS bearing_deg, state, {r(d='d', clearance='CASE WHEN q < 100000000 THEN q ELSE 1 END', loss_db="CASE state WHEN 'los' THEN 0 WHEN 'fresnel_partial' THEN greatest(0, (0.6 - q) * 6) ELSE CASE WHEN nu <= -0.78 THEN 0 ELSE least(40, 6.9 + 20 * log10(sqrt(pow(nu - 0.1, 2) + 1) + nu - 0.1)) END END")} FROM n""",
    "fx_sites",
)
def terrain_losses(spark, sf_dir):
    """WIN9, RF13, JOB20: terrain state and loss of each sample of each profile."""
    return rounded(terrain_states(profiles(spark, sf_dir), ["site_id", "bearing_deg"], RX_M, 3500.0).select("site_id", "bearing_deg", "state", "d", "clearance", "loss_db"))


@query(
    f"""WITH {TERRAIN_SQL}, g AS (SELECT t.*, ((degrees(atan2((longitude + 121.5) * cos(radians(38.0::DOUBLE)), latitude - 38.0)) % 360) + 360) % 360 AS bearing FROM fx_targets t),
b AS (SELECT target_id, (CAST(round_even(bearing / 90, 0) AS INT) % 4) * 90 AS bearing_deg FROM g)
SELECT target_id, CAST(bearing_deg AS INT) AS bearing_deg, {r(height_m='z')} FROM b JOIN pr USING (bearing_deg) WHERE site_id = 1 AND u = 400""",
    "fx_sites",
    "fx_targets",
)
def profile_heights(spark, sf_dir):
    """JN11, SPA3: the height at 400 m of the profile whose bearing is nearest to a target's, for one site."""
    from .field import LAT0, LON0

    t = view(spark, sf_dir, "fx_targets")
    bearing = F.pmod(F.degrees(F.atan2((c("longitude") - LON0) * math.cos(math.radians(LAT0)), c("latitude") - LAT0)), F.lit(360.0))
    p = profiles(spark, sf_dir).filter("site_id = 1 AND u = 400").select("bearing_deg", c("z").alias("height_m"))
    return rounded(t.select("target_id", (bearing_bin(bearing, 90.0) * 90).cast("int").alias("bearing_deg")).join(p, "bearing_deg").select("target_id", "bearing_deg", "height_m"))


DEM_SQL = "ce AS (SELECT (o_orderkey * 7919) % 3600 AS i, avg(CAST(o_totalprice AS DOUBLE)) / 1000 AS h FROM orders GROUP BY 1), dm AS (SELECT i // 60 AS row_no, i % 60 AS col_no, CASE WHEN i % 23 <> 0 THEN h END AS z FROM ce)"


@query(
    f"""WITH {DEM_SQL}, p AS (SELECT target_id, (latitude - 38.0) / 0.001 AS y, (longitude + 121.5) / 0.001 AS x FROM fx_targets), q AS (SELECT *, floor(y) AS r0, floor(x) AS k0 FROM p),
o AS (SELECT target_id, z, (CASE WHEN dr = 1 THEN y - r0 ELSE 1 - (y - r0) END) * (CASE WHEN dk = 1 THEN x - k0 ELSE 1 - (x - k0) END) AS w FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dk) JOIN dm ON row_no = r0 + dr AND col_no = k0 + dk)
SELECT target_id, {r(height_m='CASE WHEN count(z) = 4 THEN sum(z * w) END')} FROM o GROUP BY target_id""",
    "fx_targets",
)
def bilinear_heights(spark, sf_dir):
    """JN13: heights between four corners of a raster of cells (made from orders); null where a corner is missing or holds no value."""
    cells = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(((c("o_orderkey") * 7919) % 3600).alias("i")).agg((F.avg(c("o_totalprice").cast("double")) / 1000).alias("h"))
    dem = cells.select(F.floor(c("i") / 60).cast("int").alias("row_no"), (c("i") % 60).cast("int").alias("col_no"), F.when(c("i") % 23 != 0, c("h")).alias("z"))
    p = view(spark, sf_dir, "fx_targets").select("target_id", ((c("latitude") - 38.0) / 0.001).alias("y"), ((c("longitude") + 121.5) / 0.001).alias("x"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dk")) for a in (0, 1) for b in (0, 1)]))
    q = p.withColumn("o", corner).select("target_id", (F.floor("y") + c("o.dr")).cast("int").alias("row_no"), (F.floor("x") + c("o.dk")).cast("int").alias("col_no"), (F.when(c("o.dr") == 1, c("y") - F.floor("y")).otherwise(1 - (c("y") - F.floor("y"))) * F.when(c("o.dk") == 1, c("x") - F.floor("x")).otherwise(1 - (c("x") - F.floor("x")))).alias("w"))
    return rounded(q.join(dem, ["row_no", "col_no"]).groupBy("target_id").agg(F.when(F.count("z") == 4, F.sum(c("z") * c("w"))).alias("height_m")))


@query(
    """WITH e AS (SELECT CAST(round_even(latitude * 100000, 0) AS BIGINT) AS lat_e5, CAST(round_even(longitude * 100000, 0) AS BIGINT) AS lon_e5, target_id % 4 AS ds, max_by(z_ground_m, target_id) AS z, max(target_id) AS cached FROM fx_targets WHERE target_id % 3 <> 0 GROUP BY 1, 2, 3),
k AS (SELECT target_id, CAST(round_even(latitude * 100000, 0) AS BIGINT) AS lat_e5, CAST(round_even(longitude * 100000, 0) AS BIGINT) AS lon_e5 FROM fx_targets)
SELECT target_id, coalesce(a.z, b.z) AS height_m, CASE WHEN a.z IS NOT NULL THEN 'first' WHEN b.z IS NOT NULL THEN 'second' END AS source
FROM k LEFT JOIN (SELECT * FROM e WHERE ds = 1 AND cached >= 50) a USING (lat_e5, lon_e5) LEFT JOIN (SELECT * FROM e WHERE ds = 2) b USING (lat_e5, lon_e5)""",
    "fx_targets",
)
def stored_heights(spark, sf_dir):
    """JN12, JN14, SET4, SPA11: heights by integer keys from the first of two stores that has one; the first forgets old rows, each keeps the latest of a key."""
    t = view(spark, sf_dir, "fx_targets").select("target_id", "z_ground_m", F.rint(c("latitude") * 1e5).cast("long").alias("lat_e5"), F.rint(c("longitude") * 1e5).cast("long").alias("lon_e5"))
    held = t.filter("target_id % 3 <> 0").groupBy("lat_e5", "lon_e5", (c("target_id") % 4).alias("ds")).agg(F.max_by("z_ground_m", "target_id").alias("z"), F.max("target_id").alias("cached"))
    first = held.filter("ds = 1 AND cached >= 50").select("lat_e5", "lon_e5", c("z").alias("a"))
    second = held.filter("ds = 2").select("lat_e5", "lon_e5", c("z").alias("b"))
    x = t.join(first, ["lat_e5", "lon_e5"], "left").join(second, ["lat_e5", "lon_e5"], "left")
    return x.select("target_id", F.coalesce("a", "b").alias("height_m"), F.when(c("a").isNotNull(), "first").when(c("b").isNotNull(), "second").alias("source"))


@query(
    f"""WITH {LATTICE_SQL}, o AS (SELECT site_id, bearing_bin * 5 AS bearing_deg, start_m FROM fx_obstacles), p AS (SELECT l.site_id, l.bearing_deg, l.distance_m, 10 - 20 * log10(l.distance_m) - 8 * (SELECT count(*) FROM o WHERE o.site_id = l.site_id AND o.bearing_deg = l.bearing_deg AND o.start_m <= l.distance_m) AS power FROM l),
e AS (SELECT site_id, bearing_deg, min(CASE WHEN power < -45 THEN distance_m END) AS stop FROM p GROUP BY 1, 2)
SELECT site_id, CAST(bearing_deg AS INT) AS bearing_deg, {r('distance_m', 'power')} FROM p JOIN e USING (site_id, bearing_deg) WHERE stop IS NULL OR distance_m < stop""",
    "fx_sites",
    "fx_obstacles",
)
def ended_rays(spark, sf_dir):
    """FLT11, JOB3: samples before the first on their bearing whose power, less 8 dB an obstacle, falls below a bar."""
    x = lattice(view(spark, sf_dir, "fx_sites")).select("site_id", "bearing_deg", "distance_m")
    o = view(spark, sf_dir, "fx_obstacles").groupBy("site_id", (c("bearing_bin") * 5).alias("bearing_deg")).agg(F.array_sort(F.collect_list("start_m")).alias("starts"))
    x = x.join(o, ["site_id", "bearing_deg"], "left").withColumn("power", 10 - 20 * F.log10("distance_m") - 8.0 * F.coalesce(F.size(F.filter("starts", lambda s: s <= c("distance_m"))), F.lit(0)))
    stop = F.min(F.when(c("power") < -45, c("distance_m"))).over(Window.partitionBy("site_id", "bearing_deg"))
    return rounded(x.withColumn("stop", stop).filter(c("stop").isNull() | (c("distance_m") < c("stop"))).select("site_id", "bearing_deg", "distance_m", "power"))


@query(
    f"""WITH k AS (SELECT site_id, sector_no, azimuth_deg, (((azimuth_deg - 32.5) % 360) + 360) % 360 AS first_deg, (((azimuth_deg + 32.5) % 360) + 360) % 360 AS last_deg, CASE WHEN site_id % 3 = 0 THEN 0 ELSE 40 + sector_no END AS own_power, CASE WHEN site_id % 4 = 0 THEN NULL ELSE 3.0 END AS own_tilt FROM fx_sectors)
SELECT site_id, CAST(sector_no AS INT) AS sector_no, {r('first_deg', 'last_deg', power_dbm='coalesce(nullif(own_power, 0), 43)', tilt_deg='coalesce(own_tilt, 5)', freq_mhz='3000 + 0.015 * (633334 + site_id - 600000)')}, CASE WHEN first_deg <= last_deg THEN 10 BETWEEN first_deg AND last_deg ELSE 10 >= first_deg OR 10 <= last_deg END AS covers_north FROM k""",
    "fx_sites",
    "fx_sectors",
)
def sector_plan(spark, sf_dir):
    """JOB19, TXT7, JN5, FLT12, FLT13: sectors with their span and frequency, parameters resolved (zero power counts as missing, a zero tilt doesn't), and whether they cover a bearing."""
    i = c("site_id")
    k = view(spark, sf_dir, "fx_sectors").withColumn("own_power", F.when(i % 3 != 0, 40 + c("sector_no")).otherwise(0).cast("double")).withColumn("own_tilt", F.when(i % 4 != 0, 3.0))
    first, last = X.angle_span(c("azimuth_deg"), c("beamwidth_h_deg"))
    k = k.withColumn("first_deg", first).withColumn("last_deg", last)
    return rounded(k.select("site_id", "sector_no", "first_deg", "last_deg", F.coalesce(F.nullif(c("own_power"), F.lit(0.0)), F.lit(43.0)).alias("power_dbm"), F.coalesce("own_tilt", F.lit(5.0)).alias("tilt_deg"), X.arfcn_mhz(633_334 + i).alias("freq_mhz"), covers(F.lit(10.0), c("first_deg"), c("last_deg")).alias("covers_north")))


def covers(angle, first, last):
    """Whether a bearing lies in a span that may turn over north."""
    a = F.pmod(angle, F.lit(360.0))
    return F.when(first <= last, (a >= first) & (a <= last)).otherwise((a >= first) | (a <= last))
