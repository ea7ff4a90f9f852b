"""Road labels: one per name, the most important first, and points along a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded_name

# Priority of road classes; those up to MAJOR are major.
PRIORITY = {
    "motorway": 0, "motorway_link": 1, "trunk": 2, "trunk_link": 3, "primary": 4, "primary_link": 5, "secondary": 6, "secondary_link": 7,
    "tertiary": 8, "tertiary_link": 9, "residential": 10, "unclassified": 11, "living_street": 12, "service": 13, "road": 14,
}
MAJOR = 9


def ranked_labels(roads: DataFrame, major_limit: int = 24, minor_limit: int = 40) -> DataFrame:
    """From (name, highway, length_m): the best road of each name without regard to case, ranked within major and minor roads up to a limit."""
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("highway")], F.lit(99))
    named = roads.withColumn("name", folded_name(F.col("name"))).filter("name <> ''").withColumn("priority", priority)
    order = ["priority", F.desc("length_m"), "name"]
    once = named.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(*order))).filter("_n = 1").drop("_n")
    split = once.withColumn("major", F.col("priority") <= MAJOR)
    ranked = split.withColumn("rank", F.row_number().over(Window.partitionBy("major").orderBy(*order)))
    return ranked.filter(F.col("rank") <= F.when(F.col("major"), major_limit).otherwise(minor_limit))


def point_along(lines: DataFrame, line_id: str, target: str, points: str = "points") -> DataFrame:
    """The point at ``target`` metres along each line, an array of (x, y); the last point where the line is shorter."""
    w = Window.partitionBy(line_id).orderBy("i")
    p = lines.select(line_id, target, F.posexplode(points).alias("i", "p")).withColumn("q", F.lead("p").over(w))
    step = F.coalesce(F.sqrt(F.pow(F.col("q.x") - F.col("p.x"), 2) + F.pow(F.col("q.y") - F.col("p.y"), 2)), F.lit(0.0))
    p = p.withColumn("step", step).withColumn("before", F.sum("step").over(w) - F.col("step"))
    here = p.filter(F.col("before") <= F.col(target)).groupBy(line_id).agg(F.max_by(F.struct("p", "q", "step", "before", target), "i").alias("s")).select(line_id, "s.*")
    share = F.when(F.col("step") > 0, F.least((F.col(target) - F.col("before")) / F.col("step"), F.lit(1.0))).otherwise(0.0)
    at = lambda a: F.col(f"p.{a}") + F.coalesce(share * (F.col(f"q.{a}") - F.col(f"p.{a}")), F.lit(0.0))
    return here.select(line_id, at("x").alias("x"), at("y").alias("y"))
