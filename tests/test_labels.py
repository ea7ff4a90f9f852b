from fieldspark.operators.labels import point_along, ranked_labels


def test_labels_keep_one_of_each_name(spark):
    rows = [("Main  St", "residential", 50.0), ("main st", "primary", 10.0), ("Oak", "service", 5.0), (" ", "primary", 1.0), ("Elm", "secondary", 9.0)]
    got = [(r["name"], r["major"], r["rank"]) for r in ranked_labels(spark.createDataFrame(rows, "name string, highway string, length_m double")).orderBy("priority").collect()]
    assert got == [("main st", True, 1), ("Elm", True, 2), ("Oak", False, 1)]
    many = spark.range(60).selectExpr("concat('r', id) AS name", "'service' AS highway", "1.0 AS length_m")
    assert ranked_labels(many).count() == 40


def test_point_along(spark):
    df = spark.createDataFrame([(1, 6.0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]), (2, 99.0, [(0.0, 0.0), (4.0, 0.0)])], "id int, d double, points array<struct<x:double,y:double>>")
    assert {r["id"]: (r["x"], r["y"]) for r in point_along(df, "id", "d").collect()} == {1: (4.0, 2.0), 2: (4.0, 0.0)}
