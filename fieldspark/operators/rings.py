"""Member lines of relations joined end to end, by pointer doubling: no task holds a relation.

Every line has two darts, one each way.  At a point the ends of a relation's lines are paired in
order of their number, so a dart has one next dart at most, and darts form circles and chains.
Doubling hands each dart the one 2, 4, 8 ... steps on and the least dart on the way; after as many
rounds as the logarithm of the longest ring each knows its ring by the least dart, and its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

c = F.col


def next_darts(lines: DataFrame, relation: str, number: str, points: str) -> DataFrame:
    """(relation, dart, next): dart 2 * number runs a line as it is, 2 * number + 1 backwards; next is null where nothing follows."""
    ends = lines.select(c(relation).alias("rel"), c(number).cast("bigint").alias("no"), F.element_at(points, 1).alias("a"), F.element_at(points, -1).alias("z"))
    place = lambda p: F.struct(F.round(f"{p}.x", 7).alias("x"), F.round(f"{p}.y", 7).alias("y"))
    # the dart that leaves at an end, and the one that enters there
    at = ends.select("rel", F.explode(F.array(F.struct((2 * c("no") + 1).alias("out"), (2 * c("no")).alias("into"), place("a").alias("at")), F.struct((2 * c("no")).alias("out"), (2 * c("no") + 1).alias("into"), place("z").alias("at")))).alias("e")).select("rel", "e.*")
    w = Window.partitionBy("rel", "at").orderBy("into")
    turn = F.row_number().over(w) % 2
    partner = F.when(turn == 1, F.lead("into").over(w)).otherwise(F.lag("into").over(w))
    return at.select("rel", c("out").alias("dart"), partner.alias("next"))


def closed_darts(darts: DataFrame) -> DataFrame:
    """Links the last dart of each chain to its first, so that all are circles; ``gap`` marks these links.

    The first dart is the last one of the way back, run backwards."""
    held = cut(darts.withColumn("to", F.coalesce("next", "dart")).withColumn("done", c("next").isNull()))
    reached = 0
    while (now := held.filter("done").count()) > reached:  # darts within 1, 2, 4 ... steps of an end; grows until all of the chains
        reached = now
        on = held.select("rel", c("dart").alias("to"), c("to").alias("_to"), c("done").alias("_done"))
        held = cut(held.join(on, ["rel", "to"]).select("rel", "dart", "next", c("_to").alias("to"), (c("done") | c("_done")).alias("done")))
    if not reached:
        return held.select("rel", "dart", "next", F.lit(False).alias("gap"))
    # the dart that runs another's line backwards
    back = held.filter("done").select("rel", c("dart").bitwiseXOR(F.lit(1).cast("bigint")).alias("dart"), c("to").bitwiseXOR(F.lit(1).cast("bigint")).alias("_first"))
    return held.join(back, ["rel", "dart"], "left").select("rel", "dart", F.coalesce("next", "_first").alias("next"), c("next").isNull().alias("gap"))


def ranked_circles(darts: DataFrame) -> DataFrame:
    """Adds to darts in circles the least dart of the circle and the steps from each to it."""
    held = cut(darts.select("rel", "dart", "gap", c("next").alias("to"), c("dart").alias("least"), F.lit(0).cast("bigint").alias("steps")))
    span = 1
    while True:
        on = held.select("rel", c("dart").alias("to"), c("to").alias("_to"), c("least").alias("_least"), c("steps").alias("_steps"))
        less = c("_least") < c("least")
        held = cut(held.join(on, ["rel", "to"]).select("rel", "dart", "gap", c("_to").alias("to"), F.least("least", "_least").alias("least"), F.when(less, c("_steps") + span).otherwise(c("steps")).alias("steps"), less.alias("moved")))
        if held.filter("moved").isEmpty():
            return held.select("rel", "dart", "gap", "least", "steps")
        held, span = held.drop("moved"), 2 * span


def stitched(lines: DataFrame, relation: str = "relation_id", number: str = "segment_no", points: str = "points") -> DataFrame:
    """SPA12: rings of each relation: relation_id, ring_no (from 0), n_lines, closed, ring (points; the last is the first).

    A ring starts with its least line, forwards.  Lines of under two points are left out, also null ones; ends meet
    where they agree to seven digits.  A chain that doesn't close (closed is false) is closed by a straight line; rings of
    under three points are dropped.  Numbers tell a relation's lines apart.  Of more than two ends at a point, the first two by
    number are joined, then the next two.
    """
    lines = lines.filter(F.size(points) >= 2)
    darts = ranked_circles(closed_darts(next_darts(lines, relation, number, points)))
    one_way = darts.filter(c("least") % 2 == 0)  # the other way round the least dart runs its line backwards
    own = one_way.withColumn("no", F.floor(c("dart") / 2)).join(lines.select(c(relation).alias("rel"), c(number).cast("bigint").alias("no"), c(points).alias("_p")), ["rel", "no"])
    run = F.when(c("dart") % 2 == 0, c("_p")).otherwise(F.reverse("_p"))
    # the last point is the next line's first, but where a straight line closes the gap
    kept = F.when(c("gap"), run).otherwise(F.slice(run, F.lit(1), F.size("_p") - 1))
    rings = own.groupBy("rel", "least").agg(F.sort_array(F.collect_list(F.struct(F.when(c("dart") == c("least"), F.lit(-(1 << 62))).otherwise(-c("steps")).alias("k"), kept.alias("p")))).alias("s"), F.count("*").alias("n_lines"), (~F.bool_or("gap")).alias("closed"))
    rings = rings.withColumn("way", F.flatten("s.p")).filter(F.size("way") >= 3)
    ring_no = F.row_number().over(Window.partitionBy("rel").orderBy("least")) - 1
    return rings.select(c("rel").alias(relation), ring_no.alias("ring_no"), "n_lines", "closed", F.concat("way", F.slice("way", 1, 1)).alias("ring"))
