"""Connected components of a table of links, by large-star and small-star rounds.

Each round joins and groups; the lineage is cut by a table in the shared folder.
A round moves every link to the least neighbour, and the rounds needed grow with
the logarithm of the longest chain.  The hub of a star may have a third of all
links; see looked_up.  Links that are few (``FEW`` at most, from the start or after
some rounds) are settled by one task, as its size has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import discard, written

#: A key with more than this part of all rows is looked up where the rows lie.
HOT = 1000
#: Links that one task may settle.
FEW = 1 << 14


def looked_up(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with one row of ``right`` per key, whose ``_n`` is the key's number of rows in ``left`` (of ``total`` at most).

    Keys with more than total / HOT rows are fewer than HOT, so these are broadcast; no other key can load a task.
    """
    often = F.col("_n") * HOT > total
    hot = F.broadcast(right.filter(often).drop("_n"))
    cold = left.join(F.broadcast(right.filter(often).select(key)), key, "left_anti").join(right.filter(~often).drop("_n"), key)
    return left.join(hot, key).unionByName(cold)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the least node that each reaches."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while (low[low] != low).any():
            low = low[low]
        root = low[root]
    return nodes, nodes[root]


def few(edges: DataFrame) -> DataFrame:
    """(node, root) by one task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            node, root = least_reachable(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            yield pa.RecordBatch.from_pydict({"node": node, "root": root})

    return written(edges.coalesce(1).mapInArrow(go, "node long, root long"))


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: (node, root) for every node that has a link to another; root is the least node reachable."""
    edges = written(links.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    before, n = None, edges.count()
    while n > FEW:
        # large star: each greater neighbour goes to the least of the neighbourhood
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("_n")).selectExpr("a", "least(a, m) AS m", "_n")
        large = looked_up(both.filter("b > a"), least, "a", 2 * n).selectExpr("b AS a", "m AS b").filter("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        last, edges = edges, written(large.join(small_least, "a").selectExpr("b AS a", "m AS b").filter("a <> b").unionByName(small_least.selectExpr("a", "m AS b")).distinct())
        discard(last)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before, n = now, now["n"]
    if n <= FEW:
        return few(edges)
    roots = edges.selectExpr("a AS node", "b AS root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
