import math

from pyspark.sql import functions as F

from fieldspark.functions import broadcast as B
from fieldspark.functions import geo as G
from fieldspark.functions import radio as R
from fieldspark.operators.spatial import nearest, within
from fieldspark.sources import sinks


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def test_plane_geometry(spark):
    schema = "ring array<struct<x:double,y:double>>, x double, y double"
    df = spark.createDataFrame([(ring((0, 0), (4, 0), (4, 2), (0, 2)), 1.0, 1.0), (ring((0, 0), (4, 0), (4, 2), (0, 2)), 7.0, 6.0)], schema)
    r, x, y = F.col("ring"), F.col("x"), F.col("y")
    out = df.select(G.contains(r, x, y).alias("inside"), G.area(r).alias("area"), G.length(r).alias("length"), G.to_polygon(r, x, y).alias("d"), G.crossings(r, F.lit(-1.0), F.lit(1.0), F.lit(9.0), F.lit(1.0)).alias("t")).collect()
    assert [o["inside"] for o in out] == [True, False] and out[0]["area"] == 8 and out[0]["length"] == 12
    assert [o["d"] for o in out] == [0.0, 5.0] and all(map(math.isclose, out[0]["t"], [0.1, 0.5]))
    m = df.select(*G.mirrored(x, y, G.edges(r)[0])).first()
    assert tuple(m) == (1.0, -1.0)


def test_bearings_and_profiles(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, -1.0, 270.0)], "a double, b double, p double, q double, want double")
    assert all(math.isclose(r[0], r[1]) for r in df.select(G.bearing_deg(*map(F.col, "abpq")), "want").collect())
    bins = spark.createDataFrame([(2.5, 0), (7.5, 2), (359.0, 0)], "x double, want int").select(G.bearing_bin(F.col("x"), 5).alias("b"), "want").collect()
    assert all(r["b"] == r["want"] for r in bins)
    p = spark.createDataFrame([([(0.0, 1.0), (10.0, 3.0)],)], "p array<struct<u:double,z:double>>")
    got = p.select(*[G.interpolated(F.col("p"), F.lit(v)).alias(f"v{i}") for i, v in enumerate((-1.0, 5.0, 20.0))]).first()
    assert tuple(got) == (1.0, 2.0, 3.0)


def test_closed_forms(spark):
    one = spark.range(1)
    got = one.select(R.free_space_loss_db(F.lit(1000.0), F.lit(1000.0)).alias("f"), R.knife_edge_loss_db(F.lit(0.0)).alias("k"), R.knife_edge_loss_db(F.lit(-1.0)).alias("z"), R.horizontal_loss_db(F.lit(350.0), F.lit(10.0), F.lit(65.0)).alias("h"), R.horizontal_loss_db(F.lit(180.0), F.lit(0.0), F.lit(65.0)).alias("b")).first()
    assert math.isclose(got["f"], 92.45) and math.isclose(got["k"], 6.9 + 20 * math.log10(math.sqrt(1.01) - 0.1)) and got["z"] == 0
    assert math.isclose(got["h"], 12 * (20 / 65) ** 2) and got["b"] == 30


def test_neighbours_equal_brute_force(spark):
    points = [(i, float(i * 7919 % 1000), float(i * 104729 % 900)) for i in range(40)] + [(99, 9000.0, -4000.0)]
    sites = [(i, float(i * 613 % 700), float(i * 977 % 800)) for i in range(25)]
    p, s = spark.createDataFrame(points, "p long, px double, py double"), spark.createDataFrame(sites, "s long, sx double, sy double")
    dist = lambda a, b: math.dist(a[1:], b[1:])
    got = {}
    for r in nearest(p, s, "p", "s", k=3, radius_m=60).collect():
        got.setdefault(r["p"], {})[r["n"]] = r["s"]
    for a in points:
        want = sorted(sites, key=lambda b: (round(dist(a, b), 6), b[0]))[:3]
        assert got[a[0]] == {i + 1: b[0] for i, b in enumerate(want)}
    pairs = {(r["p"], r["s"]) for r in within(p, s, 150.0).collect()}
    assert pairs == {(a[0], b[0]) for a in points for b in sites if dist(a, b) <= 150}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], 3.0, "a"), (2, None, 4.0, "b")], "id long, levels array<double>, v_x double, product_id string")
    sinks.write_matched(df, str(tmp_path / "m"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "m")).orderBy("id").collect()
    assert rows[0]["levels"] == "[1.0,2.0]" and "v_x" not in rows[0].asDict()
    meta = spark.createDataFrame([("a", "{}"), ("b", "{}")], "product_id string, j string")
    sinks.write_product(df.drop("levels"), meta, str(tmp_path / "p"))
    sinks.write_product(df.drop("levels").filter("id = 2"), meta.filter("product_id = 'b'"), str(tmp_path / "p"))
    assert sinks.product_part(spark, str(tmp_path / "p"), "points").count() == 2
    held = {r["product_id"]: (r["n"], [(x["name"], x["type"]) for x in r["layers"]]) for r in sinks.product_part(spark, str(tmp_path / "p"), "manifest").collect()}
    assert held == {k: (1, [("id", "bigint"), ("v_x", "float")]) for k in "ab"}
    audit = {r["name"]: r for r in sinks.audit_product(df, ["id", "levels", "gone"]).collect()}
    assert audit["id"]["numeric"] and audit["levels"]["missing"] == 1 and not audit["gone"]["present"]
    old, new = spark.createDataFrame([(1, 5, "x"), (2, 5, "y")], "k long, t long, v string"), spark.createDataFrame([(1, 4, "older"), (2, 5, "same")], "k long, t long, v string")
    assert {r["k"]: r["v"] for r in sinks.latest(old, new, ["k"], "t").collect()} == {1: "x", 2: "same"}
    assert sinks.missing_rows(new, old.filter("k = 1"), ["k"]).count() == 1 and sinks.purged(old, 6, "t").count() == 0


def test_broadcast(spark):
    p = spark.createDataFrame([([(0.0, 1.0), (90.0, 0.5), (270.0, 0.1)], None, 2.0, 3.0, None)], "p array<struct<u:double,z:double>>, erp double, h double, v double, c double")
    loss = lambda b: B.tabulated_loss_db(F.col("p"), F.lit(float(b)), F.lit(0.0))
    chain = F.lit(0.0)
    got = p.select(loss(0), loss(90), loss(315), B.source_eirp_dbm(F.col("erp"), F.col("h"), F.col("v"), F.col("c"), chain), B.valid_power_basis(F.col("erp"), F.col("h"), F.col("v"), F.col("c"), chain), B.polarised_eirp_dbm(F.col("h"), F.lit(0.0), F.col("v"), F.lit(0.0)), B.penetration_db(F.lit("brick"), F.lit(100.0), scale=1.0)).first()
    want = [0, -20 * math.log10(0.5), -20 * math.log10(0.55), 10 * math.log10(5e6) + 2.15]
    assert all(map(lambda a, b: math.isclose(a, b, abs_tol=1e-9), got[:4], want)) and got[4] and math.isclose(got[5], want[3]) and got[6] == 5.0
