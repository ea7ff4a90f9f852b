"""Running values, blocks with borders, sweeps, rings, places on the sphere and the fused channel, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspark.operators.carried import blocks, running
from fieldspark.operators.intervals import swept
from fieldspark.operators.rings import stitched
from fieldspark.operators.spatial import within_sphere
from fieldspark.plans import fusion
from fieldspark.plans.network import clustered, report


@pytest.fixture
def rows():
    random.seed(3)
    out = [("hot", i, random.choice([None, *range(-5, 6)])) for i in range(700)] + [(k, i, i) for k in ("a", "b", None) for i in range(5)]
    random.shuffle(out)
    return out


def test_running_values_of_a_key_over_many_ranges(spark, rows):
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(6)
    kinds = ("sum", "min", "max", "count", "sum_before", "min_before", "count_before", "last", "lag")
    got = running(df, ["k"], ["i"], {kind: (kind, F.col("v")) for kind in kinds}).collect()
    assert len(got) == len(rows)
    for r in got:
        at = sorted((i, v) for k, i, v in rows if k == r["k"] and i <= r["i"])
        upto, before = [v for _, v in at if v is not None], [v for _, v in at[:-1] if v is not None]
        assert r["sum"] == (sum(upto) if upto else None) and r["min"] == min(upto, default=None) and r["max"] == max(upto, default=None)
        assert r["count"] == len(upto) and (r["count_before"] or 0) == len(before)
        assert r["sum_before"] == (sum(before) if before else None) and r["min_before"] == min(before, default=None)
        assert r["last"] == (upto[-1] if upto else None) and r["lag"] == (at[-2][1] if len(at) > 1 else None)
    with pytest.raises(ValueError, match="kind"):
        running(df, ["k"], ["i"], {"x": ("median", F.col("v"))})
    assert running(df.limit(0), ["k"], ["i"], {"s": ("sum", F.col("v"))}).count() == 0


@pytest.mark.parametrize("size", [5, 64])
def test_windows_over_blocks_equal_windows_over_keys(spark, rows, size):
    df = spark.createDataFrame(rows, "k string, i int, v int")
    frame = lambda w: w.rowsBetween(-5, 4)
    whole = Window.partitionBy("k").orderBy("i")
    want = df.select("k", "i", F.sum("v").over(frame(whole)).alias("s"), F.lag("v").over(whole).alias("p"))
    cut = blocks(df, ["k"], ["i"], 5, 4, rows=size)
    part = Window.partitionBy("k", "_block").orderBy("_i")
    got = cut.select("k", "i", F.sum("v").over(frame(part)).alias("s"), F.lag("v").over(part).alias("p"), "_own").filter("_own").drop("_own")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    largest = cut.groupBy("k", "_block").count().agg(F.max("count")).first()[0]
    assert largest <= size + 9
    with pytest.raises(ValueError, match="border"):
        blocks(df, ["k"], ["i"], 9, 0, rows=8)


def test_sweep_equals_all_pairs(spark):
    random.seed(5)
    intervals = [(b, n, float(s), float(s + random.choice([0, 3, 15, 40, 200])), random.choice("xyz")) for b in (1, 2) for n, s in enumerate(random.choices(range(0, 300, 5), k=25))]
    samples = [(b, float(d)) for b in (1, 2, 3) for d in range(0, 400, 10)]
    iv = spark.createDataFrame(intervals, "b int, n long, start_m double, end_m double, m string")
    got = swept(spark.createDataFrame(samples, "b int, distance_m double"), iv, ["b"], "n", penetration=F.col("n") + 1.0, losses={"lost": (4.0, 10.0, 12.0, 30.0)}, recovery_db=3.0, tell=("m",)).collect()
    assert len(got) == len(samples)
    for r in got:
        d = r["distance_m"]
        begun = [x for x in intervals if x[0] == r["b"] and x[2] <= d + 1e-6]
        active, exited = [x for x in begun if x[3] > d + 1e-6], [x for x in begun if x[3] <= d + 1e-6]
        assert (r["n_begun"], r["n_active"], r["n_exited"]) == (len(begun), len(active), len(exited))
        assert math.isclose(r["penetration_db"], sum(x[1] + 1.0 for x in active), abs_tol=1e-6)
        assert r["first_start_m"] == min((x[2] for x in begun), default=None) and r["last_exit_m"] == max((x[3] for x in exited), default=None)
        lost = sum(max(0.0, min(12.0, 4 + 10 * (x[3] - x[2]) / 100) - 3 * (d - x[3]) / 100) for x in exited)
        assert math.isclose(r["lost"], min(30.0, lost), abs_tol=1e-6)
        first = min(active, key=lambda x: (x[2], x[1]), default=None)
        assert (r["first_active"] and (r["first_active"]["id"], r["first_active"]["m"])) == (first and (first[1], first[4]))


def test_rings_of_all_kinds(spark):
    kind = "relation_id long, segment_no int, points array<struct<x:double,y:double>>"
    n = 700
    vertex = [(math.cos(i), float(i)) for i in range(n)]
    order = random.Random(1).sample(range(n), n)
    big = [(7, order[i], [vertex[i], vertex[(i + 1) % n]][:: 1 if i % 3 else -1]) for i in range(n)]
    small = [(1, 0, [(0.0, 0.0), (1.0, 0.0)]), (1, 1, [(1.0, 1.0), (1.0, 0.0)]), (1, 2, [(1.0, 1.0), (0.0, 0.0)])]
    alone = [(2, 5, [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)]), (2, 6, [(9.0, 9.0), (8.0, 8.0)]), (2, 7, None), (2, 8, [(1.0, 1.0)])]
    chain = [(3, 2, [(5.0, 0.0), (6.0, 0.0)]), (3, 1, [(6.0, 0.0), (6.0, 3.0), (5.0, 3.0)]), (4, 0, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)])]
    cross = [(5, 0, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]), (5, 1, [(2.0, 0.0), (0.0, 0.0)]), (5, 2, [(0.0, 0.0), (-1.0, 1.0), (-2.0, 0.0)]), (5, 3, [(-2.0, 0.0), (0.0, 0.0)])]
    got = {(r["relation_id"], r["ring_no"]): r for r in stitched(spark.createDataFrame(big + small + alone + chain + cross, kind)).collect()}
    ring = lambda k: [(p["x"], p["y"]) for p in got[k]["ring"]]
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (5, 1), (7, 0)}
    assert got[7, 0]["closed"] and got[7, 0]["n_lines"] == n and len(ring((7, 0))) == n + 1 and set(ring((7, 0))) == set(vertex)
    steps = {frozenset((vertex.index(a), vertex.index(b))) for a, b in zip(ring((7, 0)), ring((7, 0))[1:], strict=False)}
    assert steps == {frozenset((i, (i + 1) % n)) for i in range(n)}
    assert ring((1, 0)) == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)] and got[1, 0]["closed"]
    assert len(ring((2, 0))) == 4 and got[2, 0]["closed"]
    assert not got[3, 0]["closed"] and sorted(set(ring((3, 0)))) == [(5.0, 0.0), (5.0, 3.0), (6.0, 0.0), (6.0, 3.0)] and ring((3, 0))[0] == ring((3, 0))[-1]
    assert not got[4, 0]["closed"] and len(ring((4, 0))) == 4
    assert all(got[5, i]["closed"] and got[5, i]["n_lines"] == 2 for i in (0, 1))
    assert stitched(spark.createDataFrame([], kind)).count() == 0


def test_places_on_the_sphere(spark):
    random.seed(9)
    places = [(0, 38.0, -120.01), (1, 38.0, -109.95), (2, 0.0, 179.9), (3, 0.5, -179.8), (4, 89.5, 10.0), (5, 89.0, -170.0), (6, -90.0, 0.0), (7, -88.0, 95.0)]
    places += [(i, random.uniform(-90, 90), random.uniform(-180, 180)) for i in range(8, 150)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[2] - b[2]) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    a = spark.createDataFrame(places, "i int, la double, lo double")
    b = spark.createDataFrame(places, "j int, lb double, lp double")
    got = {(r["i"], r["j"]) for r in within_sphere(a, b, 1000.0, ("la", "lo"), ("lb", "lp")).collect()}
    assert got == {(x[0], y[0]) for x in places for y in places if km(x, y) < 1000}
    assert {(0, 1), (2, 3), (4, 5), (6, 7)} <= got


def test_channel_without_fields_and_with_holes(spark):
    kind = "target_id long, latitude double, longitude double, z_ground_m double, incident_power_dbm double"
    t = spark.createDataFrame([(i, 38.0 + i / 1000, -121.49, 5.0, -40.0) for i in range(4)], kind)
    ch = fusion.Channel()
    bare = {r["target_id"]: r for r in fusion.fused(t, None, None, ch).collect()}
    assert all(r["return_valid"] and not r["illuminated"] and r["return_state"] == "free_space" and r["incident_dbm"] == -40.0 and r["direct_environment_db"] == 0 for r in bare.values())
    lit = spark.createDataFrame([(0, -30.0), (1, math.nan)], "target_id long, incident_power_dbm double")
    back = "target_id long, latitude double, longitude double, path_loss_db double, environment_loss_db double, terrain_loss_db double, los boolean, terrain_state string, sample_error_m double"
    returns = spark.createDataFrame([(0, 38.0, -121.49, 100.0, 3.0, 0.0, True, "los", 1.0), (1, 38.0, -121.49, math.nan, 9.0, 0.0, True, "los", 1.0), (2, 38.002, -121.499, 100.0, 7.0, 0.0, False, "nlos", math.nan)], back)
    got = {r["target_id"]: r for r in fusion.fused(t, lit, returns, ch).collect()}
    assert [got[i]["illuminated"] for i in range(4)] == [True, False, False, False] and got[0]["incident_dbm"] == -30.0
    assert [got[i]["return_valid"] for i in range(4)] == [True, False, False, False] and got[0]["return_loss_db"] == 100.5
    assert all(got[i]["failure_code"] & fusion.FAILURES["environment_return"] and not got[i]["screened"] and got[i]["rcs_margin_db"] is None for i in (1, 2, 3))
    assert got[0]["direct_environment_db"] == 7.0 and got[0]["direct_los"] is False  # of the row nearest to the transmitter
    loose = fusion.Channel(effective_gain_db=None, dynamic_range_db=None, need_dynamic=False, need_direct=False, prf_hz=None, interference_dbm=None)
    free = {r["target_id"]: r for r in fusion.fused(t, lit, None, loose).collect()}
    assert all(not r["detectable"] and r["failure_code"] & fusion.FAILURES["processing"] and r["direct_ok"] and r["range_ok"] and not r["ambiguous"] and r["range_margin_db"] is None for r in free.values())
    assert fusion.fused(t.limit(0), lit, returns, ch).count() == 0


def test_clusters_are_the_same_however_rows_lie(spark):
    random.seed(2)
    rows = [(38.0 + k + random.random() / 500, -121.0 + random.random() / 500) for k in range(3) for _ in range(5 + 10 * k)]
    df = spark.createDataFrame(rows, "latitude double, longitude double")
    got = [sorted((r["n"], r["severity"]) for r in clustered(df.repartition(n), 10).collect()) for n in (1, 7)]
    assert got[0] == got[1] == [(5, "medium"), (15, "high"), (25, "high")]
    assert clustered(df.limit(2), 10).count() == 0
    assert clustered(spark.createDataFrame([(1.0, 2.0)] * 4, "latitude double, longitude double"), 3).collect()[0]["n"] == 4
    none = spark.createDataFrame([], "severity string")
    assert [(r["kind"], r["n_high"]) for r in report(none, none, none).collect()] == [("none", 0)]


@pytest.mark.parametrize(("tile", "border"), [(4, 2), (16, 4), (64, 16)])
def test_wave_fronts_over_tiles_equal_whole_rasters(spark, tile, border):
    import numpy as np

    from fieldspark.operators.wavefront import filled

    rng = np.random.default_rng(tile)
    rasters = {}
    for k in range(2):
        v, there = np.full((23, 31), np.nan), rng.random((23, 31)) > 0.15
        there[:, 15] = False  # a wall
        for _ in range(3):
            v[rng.integers(23), rng.integers(15)] = rng.integers(100)
        v[3, 3] = np.inf
        there[3, 3] = True
        rasters[k] = np.where(there, v, np.nan), there

    def whole(v, there, most):
        for _ in range(most):
            new = v.copy()
            for i, j in zip(*np.nonzero(np.isnan(v) & there), strict=True):
                for di, dj in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                    y, x = i + di, j + dj
                    if 0 <= y < 23 and 0 <= x < 31 and there[y, x] and np.isfinite(v[y, x]):
                        new[i, j] = v[y, x]
            v = new
        return np.where(np.isnan(v) & there, np.mean(v[np.isfinite(v) & there]), v)

    rows = [(k, int(i) - 5, int(j) - 7, None if np.isnan(v[i, j]) else float(v[i, j])) for k, (v, there) in rasters.items() for i, j in zip(*np.nonzero(there), strict=True)]
    df = spark.createDataFrame(rows, "k int, i int, j int, v double")
    for most in (256, 8):
        want = {k: whole(v, there, most) for k, (v, there) in rasters.items()}
        got = filled(df, ["k"], tile=tile, border=border, most_steps=most).collect()
        assert len(got) == len(rows)
        assert all(math.isclose(r["v"], want[r["k"]][r["i"] + 5, r["j"] + 7]) for r in got)
    assert filled(df.limit(0), ["k"]).count() == 0
    assert {r["v"] for r in filled(df.filter("v IS NULL").limit(5), ["k"]).collect()} == {None}


def test_probes_measure_at_their_own_latitude(spark):
    from fieldspark.operators.spatial import probed

    random.seed(4)
    rows = [(i, random.uniform(10, 70), random.uniform(0, 30), f"v{i}") for i in range(120)]
    probes = [(i, random.uniform(10, 70), random.uniform(0, 30)) for i in range(25)]
    product = spark.createDataFrame(rows, "row_id long, latitude double, longitude double, v string")
    got = {r["probe_id"]: r for r in probed(product, spark.createDataFrame(probes, "probe_id long, latitude double, longitude double"), "probe_id", "row_id").collect()}
    for p, la, lo in probes:
        d = {i: math.hypot(math.radians(y - lo) * math.cos(math.radians(la)), math.radians(x - la)) * 6_371_000 for i, x, y, _ in rows}
        best = min(d, key=d.get)
        assert got[p]["row_id"] == best and got[p]["v"] == f"v{best}" and math.isclose(got[p]["query_distance_m"], d[best])
