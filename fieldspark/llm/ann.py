"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are cut into blocks of fixed size; a tile is one query block against
one base block, and tiles are spread over the cluster by a shuffle.  In a tile,
unit vectors rounded to int8 are multiplied (exactly: products of int8 sums
fit a float32 up to 1,000 dimensions and a float64 beyond).  With the unit
vector x = u + e, u its rounded form, the true cosine differs from u.v by at
most |e_x| + |u| * |e_y|, so each approximate cosine comes with an interval.
Pairs whose upper end reaches the k-th largest lower end of their query survive,
are recomputed in double precision and kept in a heap of k; tile heaps merge.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither do rows without an id or vectors of another
length than the query's.  Repeated ids are repeated candidates, and a query
never matches a row of its own id; of different vectors of one query id the least
in the order of components is asked, repeated rows count once.
Ties go to the smaller id.  A query without candidates has no rows; an empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import column

QUERY_BLOCK = 1024
BASE_BLOCK = 2048
RESULT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the rounded unit vectors and of what rounding lost."""
    unit = scaled(x)
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((unit - near) ** 2).sum(axis=1))


def scaled(x: np.ndarray) -> np.ndarray:
    power = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    return np.ldexp(x, np.where(np.abs(power) > 200, -power, 0)[:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first component to the last.

    Rows whose largest component lies beyond 2**+-200 are first scaled by a power of two, which changes
    no digit of the cosine but keeps squares in range."""
    a, b = scaled(a), scaled(b)
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        dot += a[:, d] * b[:, d]
        aa += a[:, d] * a[:, d]
        bb += b[:, d] * b[:, d]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def first_of_equals(ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` smallest ids of each group of equal vectors: with
    ties to smaller ids no other row of the group can be among keep - 1 neighbours."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, group))
    first = np.r_[True, np.diff(group[order]) != 0]
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - start < keep])


def tile(query_ids: np.ndarray, queries: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    keep = first_of_equals(base_ids, base, k + 1)
    base_ids, base = base_ids[keep], base[keep]
    qc, qs, qn, qe = quantise(queries)
    bc, bs, _, be = quantise(base)
    kind = np.float32 if queries.shape[1] <= 1000 else np.float64
    near = (qc.astype(kind) @ bc.T.astype(kind)).astype(np.float64) * qs[:, None] * bs
    slack = qe[:, None] + qn[:, None] * be + 1e-9
    own = query_ids[:, None] == base_ids
    low = np.where(own, -np.inf, near - slack)
    at = max(0, low.shape[1] - k)
    bar = np.partition(low, at, axis=1)[:, at] if low.shape[1] > k else np.full(len(low), -np.inf)
    alive = (near + slack >= bar[:, None]) & ~own
    qi, bi = np.nonzero(alive)
    score = np.concatenate([cosine(queries[qi[i : i + 65536]], base[bi[i : i + 65536]]) for i in range(0, len(qi), 65536)] or [np.zeros(0)])
    out, cut = [], np.searchsorted(qi, np.arange(len(query_ids) + 1))
    for q, query in enumerate(query_ids.tolist()):
        span = slice(cut[q], cut[q + 1])
        best = heapq.nsmallest(k, zip((-score[span]).tolist(), base_ids[bi[span]].tolist(), strict=True))
        out += [(query, other, -s) for s, other in best]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK) -> DataFrame:
    """The k rows of ``vectors`` of largest cosine for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score.  Each base row goes to one
    row of tiles, each query to one column; both counts follow the table sizes.
    """

    def ready(df: DataFrame) -> DataFrame:
        return df.select(column(vec_id).cast("long").alias("id"), column(embedding).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x")))

    base, asked = ready(vectors), ready(queries).groupBy("id").agg(F.min("x").alias("x"))
    n_base, n_asked = max(1, -(-base.count() // base_block)), max(1, -(-asked.count() // query_block))
    salt = F.xxhash64("id", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", F.pmod(salt, F.lit(n_asked)).cast("int")).withColumn("bb", every(n_base))
    right = base.withColumn("bb", F.pmod(salt, F.lit(n_base)).cast("int")).withColumn("qb", every(n_asked))

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            mats = []
            for t in (a, b):
                x = t.column("x").combine_chunks()
                lens = np.diff(x.offsets.to_numpy())
                mats.append((t.column("id").to_numpy(), x.flatten().to_numpy(zero_copy_only=False), np.cumsum(lens) - lens, lens))
            for width in np.intersect1d(mats[0][3], mats[1][3]).tolist():
                (qi, q), (bi, x) = [(ids[lens == width], flat[starts[lens == width][:, None] + np.arange(width)]) for ids, flat, starts, lens in mats]
                found += tile(qi, q, bi, x, k)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = left.groupBy("bb", "qb").cogroup(right.groupBy("bb", "qb")).applyInArrow(join, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_block_matrix_knn(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
n AS (SELECT vec_id, x, sqrt(list_reduce(list_transform(x, lambda e: e * e), lambda p, q: p + q)) AS norm FROM v),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    list_reduce(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]), lambda p, q: p + q) / (a.norm * b.norm) AS score
  FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5
"""
