import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import check  # noqa: E402

from fieldspark.plans.registry import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    check(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_coverage_gaps_cover_the_rows_below_90(spark):
    import duckdb

    from fieldspark.sources.views import with_views

    con, folder = duckdb.connect(), "/root/testdata/sf0.1"
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(with_views("WITH l AS (SELECT list_filter([level_0_db, level_1_db], lambda v: v > -999) AS ok FROM fx_telemetry) SELECT count(*) FROM l WHERE list_sum(ok) / len(ok) < -90", "fx_telemetry")).fetchone()[0]
    got = QUERIES["coverage_gaps"](spark, folder).collect()
    assert want > 0 and sum(r["n"] for r in got) == want
    assert all(r["severity"] == ("high" if r["n"] > 10 else "medium") for r in got)


def test_coverage_of_cells_without_a_site(spark):
    from fieldspark.plans.network import coverage

    rows = [(1, i, 38.0 + i / 1000, -121.0, [-70.0, -999.0]) for i in range(6)] + [(2, i, 10.0, 20.0 + i / 1000, [-150.0, -160.0]) for i in range(5)]
    t = spark.createDataFrame(rows, "pci int, event_id long, latitude double, longitude double, channel_level_db array<double>")
    sites = spark.createDataFrame([(2, 10.0, 20.0)], "pci int, sla double, slo double")
    got = {r["pci"]: r for r in coverage(t, sites).collect()}
    assert 150 < got[1]["radius_m"] < 170 and got[1]["quality"] == "excellent"  # from the mean of its own rows
    assert 200 < got[2]["radius_m"] < 225 and abs(got[2]["mean_level"] + 155) < 1e-9 and got[2]["quality"] == "good"


def test_cluster_placement_takes_the_best_cluster(spark):
    from fieldspark.plans.network import cluster_placement

    rows = [(1, k + 3 * i, 38.0 + k, -121.0 + i / 1000, 5.0, 100.0 * (k + 1), [-60.0, -999.0]) for k in range(3) for i in range(4)] + [(2, 99, 1.0, 1.0, 1.0, 9.0, [-60.0, -60.0])]
    t = spark.createDataFrame(rows, "pci int, event_id long, latitude double, longitude double, altitude double, llr_energy double, channel_level_db array<double>")
    got = cluster_placement(t).collect()
    assert [r["pci"] for r in got] == [1] and got[0]["n"] == 4 and got[0]["latitude"] == 40.0
    assert abs(got[0]["confidence"] - 1.0) < 1e-9 and got[0]["quality"] == "good"
