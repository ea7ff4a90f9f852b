"""Tables on which queries failed at size: targets at the transmitter, and many rows at one place."""

import os

import duckdb
import pytest
from compare import TABLES, check

from fieldspark.plans.registry import QUERIES, SQL


def folder(data, tmp_path, **queries):
    """A folder of the tables, some of them replaced by what a DuckDB query over them returns."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for t in TABLES:
        if t in queries:
            con.execute(f"COPY ({queries[t]}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{data}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


#: Key 2004 stands at the transmitter's place, nation 10 at its height.
AT_TRANSMITTER = "SELECT * FROM customer UNION ALL SELECT 2004, 'at the transmitter', 10, 100.0, 'x'"


@pytest.mark.parametrize("name", ["bistatic_field", "delay_bins", "whatif_scenarios", "sensing_table", "cell_mates", "sensing_summary", "whatif_layers"])
def test_a_target_at_the_transmitter(spark, data, tmp_path, name):
    at = folder(data, tmp_path, customer=AT_TRANSMITTER)
    if name == "bistatic_field":
        assert [r["tx_range_m"] for r in QUERIES[name](spark, at).filter("target_id = 2004").collect()] == [0.0]
    check(spark, at, QUERIES[name], SQL[name])


def joins(df) -> list[str]:
    """The plan's joins, by the nodes that stand on each one's small side."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line or "BroadcastExchange" in line or "Generate" in line]


@pytest.mark.parametrize("name", ["link_budget", "terrain_losses"])
def test_no_exploded_samples_are_broadcast(spark, data, name):
    lines = joins(QUERIES[name](spark, data))
    sent = [i for i, line in enumerate(lines) if "BroadcastExchange" in line]
    below = lambda i: [x for x in lines[i + 1 :] if len(x) - len(x.lstrip(" :+-*")) > len(lines[i]) - len(lines[i].lstrip(" :+-*"))]
    assert not [x for i in sent for x in below(i) if "Generate" in x]


def test_nearest_of_many_rows_at_few_places(spark):
    """Places repeat, a dense corner shrinks the radius, some points are far from all sites; ties go to the smaller site."""
    import math
    import random

    from fieldspark.operators.spatial import nearest

    random.seed(7)
    spots = [(random.uniform(0, 3000), random.uniform(0, 2000)) for _ in range(400)] + [(40_000.0, -9000.0)]
    sites = [(i, *spots[i % len(spots)]) for i in range(1600)]
    asked = [(random.uniform(-2000, 4000), random.uniform(-500, 2500)) for _ in range(30)] + [(90_000.0, 70_000.0), (38_000.0, -9000.0), spots[3]]
    points = [(i, *asked[i % len(asked)]) for i in range(99)]
    p, s = spark.createDataFrame(points, "p long, px double, py double"), spark.createDataFrame(sites, "s long, sx double, sy double")
    for k in (1, 3, 6):
        got = {}
        for r in nearest(p, s, "p", "s", k=k, radius_m=500.0).collect():
            got.setdefault(r["p"], {})[r["n"]] = r["s"]
        for a in points:
            want = sorted(sites, key=lambda b: (round(math.dist(a[1:], b[1:]), 6), b[0]))[:k]
            assert got[a[0]] == {i + 1: b[0] for i, b in enumerate(want)}


def pairs_made(spark, make) -> int:
    """Rows that the joins of a query put out at most, one join at a time, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList().size()
    make().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most = 0
    runs = store.executionsList()
    for i in range(seen, runs.size()):
        run = runs.apply(i)
        values = store.executionMetrics(run.executionId())
        nodes = store.planGraph(run.executionId()).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if "Join" in node.name():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows":
                        x = values.get(metric.accumulatorId())
                        most = max(most, int(x.get().replace(",", "")) if x.isDefined() else 0)
    return most


#: Four times as many rows at the same places (or of the same outlines, streets and regions).
COPIES = {
    "customer": "SELECT c.* REPLACE (c_custkey + 23100 * i AS c_custkey) FROM customer c, range(4) r(i)",
    "part": "SELECT p.* REPLACE (p_partkey + 18000 * i AS p_partkey) FROM part p, range(4) r(i)",
    "supplier": "SELECT s.* REPLACE (s_suppkey + 126000 * i AS s_suppkey) FROM supplier s, range(4) r(i)",
}
GROWN = {"selected_states": ["customer"], "probe_values": ["customer"], "stored_regions": ["customer", "supplier"], "snapped_targets": ["customer", "supplier"], "target_reach": ["customer", "supplier"]}


@pytest.mark.parametrize("name, times", [("selected_states", 5), ("probe_values", 2), ("clutter_nearby", 5), ("link_obstruction", 2), ("stored_regions", 5), ("buildings_at", 13), ("clutter_classes", 5), ("snapped_targets", 5), ("target_reach", 5)])
def test_rows_at_one_place_are_looked_up_once(spark, data, tmp_path, name, times):
    at = folder(data, tmp_path, **{t: COPIES[t] for t in GROWN.get(name, ["customer", "part"])})
    check(spark, at, QUERIES[name], SQL[name])
    few, many = pairs_made(spark, lambda: QUERIES[name](spark, data)), pairs_made(spark, lambda: QUERIES[name](spark, at))
    assert few > 0 and many <= times * few


def test_outlines_of_one_area_go_by_id(spark, data, tmp_path):
    """Outlines of one size around a target: their areas by corners differ in the last digits, which must not decide."""
    near = "abs(p_partkey * 37 % 2000 - 657) < 80 AND abs(p_partkey * 91 % 1800 - 834) < 80"
    at = folder(data, tmp_path, part=f"SELECT * FROM '/root/testdata/sf0.1/part.parquet' WHERE {near}", customer="SELECT * REPLACE (15 + 7700 * c_custkey AS c_custkey) FROM customer WHERE c_custkey < 3")
    check(spark, at, QUERIES["buildings_at"], SQL["buildings_at"])


def test_roads_of_one_course_in_many_blocks(spark, data, tmp_path, monkeypatch):
    """Roads of 40 courses, in blocks of about two; joins pair courses and blocks, not roads."""
    from fieldspark.plans import rays

    at = folder(data, tmp_path, part="SELECT p.* REPLACE (p_partkey + 1000 * i AS p_partkey) FROM part p, range(4) r(i)")
    assert pairs_made(spark, lambda: QUERIES["road_meetings"](spark, at)) < QUERIES["road_meetings"](spark, at).count() / 5
    monkeypatch.setattr(rays, "ROADS_A_BLOCK", 2, raising=False)
    check(spark, at, QUERIES["road_meetings"], SQL["road_meetings"])


def test_what_each_process_holds_of_known_words_is_narrow(spark):
    """op12: four bytes a word for where its ids begin, two for an id of a vocabulary of fewer than 65,536."""
    from fieldspark.llm import bpe

    path, pattern = bpe.public_bpe()
    ranks = bpe.read_ranks(path)
    docs = spark.createDataFrame([(" ".join(f"qz{i}vv" for i in range(300)),)] * 2, "_text string")
    words, hashes, *rest = bpe.head_of(docs, ranks, pattern, bpe.rank_map(ranks))
    assert len(words) == len(hashes) > len(ranks)
    assert sum(x.nbytes for x in rest) <= 4 * (len(words) + 1) + 2 * len(rest[-1])
