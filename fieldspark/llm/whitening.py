"""Whitening of embeddings by a covariance from variances alone (polarisation).

Entries become integers, x = floor(256 * entry).  The fit list holds each distinct x-vector
once, n of them with sums S; centred, a vector is y = n * x - S, integers still.  One pass
aggregates the squares of y exactly for every dimension and of y_i + y_j for every pair;
cov(i, j) = (var(i + j) - var(i) - var(j)) / 2 then gives all of the covariance matrix, whose
unit eigenvectors (numpy's eigh, double precision) are the components.  Sums are Python integers
per task and leave it as limbs of 60 bits, which Spark adds as decimals: they are exact for every
table.  Only sums reach the driver, a row for each pair of dimensions.

Defined results: vectors that are null or hold null or non-finite entries are dropped, others
stay, repeated rows and null ids too.  An entry beyond a long counts as the nearest long.
Vectors of each length are fitted by themselves; an empty vector has no components.  A
deviation beyond a long is null.  A component whose eigenvalue is not above rounding (a
single distinct vector, constant dimensions) has null as whitened value; if the trace is zero,
explained is null.  identity_error is measured on the whitened fit list over the components
that have values (null where none has).  Other columns stay unless a result column
(in any case) replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import column, discard, others, written

SCALE = 256
COMPONENTS = 4
LIMB, LIMBS = 60, 6
#: Rows summed at a time: squares of 26-bit halves of this many rows fit 64 bits.
ROWS = 2048


def integers(vector: Column) -> Column:
    """floor(256 * entry) as longs; null for vectors that take no part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    wide = F.transform(vector, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(-float(1 << 63))), F.lit(float((1 << 63) - 1024))).cast("long"))
    return F.when(finite, wide)


def matrices(column_: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their vectors as a matrix."""
    lens = np.diff(column_.offsets.to_numpy())
    flat, start = column_.values.to_numpy(), column_.offsets.to_numpy()[:-1]
    for width in np.unique(lens).tolist():
        at = np.flatnonzero(lens == width)
        yield at, flat[start[at][:, None] + np.arange(width)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in 64-bit integers where they fit, else in Python's."""
    if len(x) and x.shape[1] and max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)) >= 1 << 61:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def squares(z: np.ndarray) -> list[int]:
    """The exact sum of squares of each column."""
    if z.dtype == object:
        return (z * z).sum(axis=0).tolist()
    z = np.abs(z)
    if z.max(initial=0) < 1 << 26:
        return (z * z).sum(axis=0).tolist()
    if z.max() >= 1 << 52:
        return squares(z.astype(object))
    high, low = z >> 26, z & ((1 << 26) - 1)
    parts = [a.sum(axis=0).tolist() for a in (high * high, high * low, low * low)]
    return [(a << 52) + (b << 27) + c for a, b, c in zip(*parts, strict=True)]


def limbs(value: int) -> list[int]:
    """Value as digits to the base 2**60, the last one signed."""
    return [value >> LIMB * k & (1 << LIMB) - 1 for k in range(LIMBS - 1)] + [value >> LIMB * (LIMBS - 1)]


def exact_sums(fit: DataFrame, terms) -> dict[int, dict[tuple[int, int], int]]:
    """By vector length and (i, j): the sums of what ``terms(matrix)`` yields as ((i, j), whole number)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for at, x in matrices(b.column(0)):
                for lo in range(0, len(at), ROWS):
                    for key, value in terms(x[lo : lo + ROWS]):
                        total[x.shape[1], *key] = total.get((x.shape[1], *key), 0) + value
        if total:
            rows = [(*key, *limbs(value)) for key, value in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["d", "i", "j", *(f"v{k}" for k in range(LIMBS))])

    parts = fit.select("x").mapInArrow(go, "d long, i long, j long, " + ", ".join(f"v{k} long" for k in range(LIMBS)))
    summed = parts.groupBy("d", "i", "j").agg(*(F.sum(F.col(f"v{k}").cast("decimal(38,0)")).alias(f"v{k}") for k in range(LIMBS)))
    out: dict = {}
    for d, i, j, *digits in summed.collect():
        out.setdefault(d, {})[i, j] = sum(int(v) << LIMB * k for k, v in enumerate(digits))
    return out


def fit_sums(x: np.ndarray):
    yield (-1, -1), len(x)
    wide = np.abs(x.astype(float)).max(initial=0) >= 1 << 50
    yield from (((i, i), int(v)) for i, v in enumerate((x.astype(object) if wide else x).sum(axis=0).tolist()) if x.shape[1])


class Model:
    """What whitening needs, for vectors of one length."""

    def __init__(self, n: int, sums: list[int], square: dict[tuple[int, int], int], k: int):
        d = len(sums)
        self.n, self.sums = n, sums
        # var(i + j) - var(i) - var(j) is twice the covariance; whole numbers, divided once
        cov = np.array([[2 * square[i, i] if i == j else square[min(i, j), max(i, j)] - square[i, i] - square[j, j] for j in range(d)] for i in range(d)], object).reshape(d, d)
        v = np.array([[c / (2 * n**3) for c in row] for row in cov.tolist()], float).reshape(d, d)
        value, vector = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-value, kind="stable")[:k]
        trace = float(np.trace(v))
        self.held = value[order] > max(value.max(initial=0.0), 0.0) * d * np.finfo(float).eps
        self.explained = [float(max(e, 0.0)) / trace if trace > 0 else None for e in value[order]]
        self.project = np.where(self.held, vector[:, order] / np.sqrt(np.where(self.held, value[order], 1.0)), np.nan)

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Values of each row and component, and each row's deviation."""
        y = centred(x, self.n, self.sums)
        values = (y / self.n).astype(float) @ self.project
        if y.dtype != object and (y.astype(float) ** 2).sum(axis=1).max(initial=0) < 1 << 62:
            return values, (y * y).sum(axis=1).tolist()
        deviation = (y.astype(object) ** 2).sum(axis=1).tolist()
        return values, [v if v < 1 << 63 else None for v in deviation]


def fit(vectors: DataFrame, k: int = COMPONENTS) -> tuple[dict[int, Model], dict[int, float | None]]:
    """Models and measured identity errors by vector length, from a column ``x`` of integer vectors."""
    distinct = written(vectors.select("x").distinct())
    counted = exact_sums(distinct, fit_sums)
    n = {d: s.pop((-1, -1)) for d, s in counted.items()}
    sums = {d: [s[i, i] for i in range(d)] for d, s in counted.items()}

    def pair_squares(x: np.ndarray):
        d = x.shape[1]
        y = centred(x, n[d], sums[d])
        yield from (((i, i), v) for i, v in enumerate(squares(y)))
        for i in range(d - 1):
            yield from (((i, i + 1 + j), v) for j, v in enumerate(squares(y[:, i : i + 1] + y[:, i + 1 :])))

    squared = exact_sums(distinct, pair_squares)
    models = {d: Model(n[d], sums[d], squared.get(d, {}), k) for d in n}
    # the whitened fit list's own covariance, merged by Spark from centred moments
    whitened = projected(distinct, models, k).select("d", "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    w = lambda i: F.get("whitened", F.lit(i))
    errors: dict[int, float | None] = {}
    for row in whitened.groupBy("d").agg(*(F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs)).collect():
        off = [abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if i < min(k, row["d"]) and models[row["d"]].held[[i, j]].all()]
        errors[row["d"]] = max(off, default=None)
    discard(distinct)
    return models, errors


def projected(df: DataFrame, models: dict[int, Model], k: int) -> DataFrame:
    """Adds d (the vector's length), whitened and deviation to rows with a column ``x``."""
    held = df.sparkSession.sparkContext.broadcast({d: (m.n, m.sums, m.project) for d, m in models.items()})
    at = df.columns.index("x")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {}
        for d, (n, sums, project) in held.value.items():
            own[d] = Model.__new__(Model)
            own[d].n, own[d].sums, own[d].project = n, sums, project
        for b in batches:
            values, deviation, width = [None] * b.num_rows, [None] * b.num_rows, [0] * b.num_rows
            for rows, x in matrices(b.column(at)):
                w, dev = own[x.shape[1]].whitened(x)
                for i, r in enumerate(rows.tolist()):
                    values[r], deviation[r], width[r] = [None if v != v else v for v in w[i].tolist()], dev[i], x.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(width, pa.int64()), pa.array(values, pa.list_(pa.float64())), pa.array(deviation, pa.int64())], names=[*b.schema.names, "d", "whitened", "deviation"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(go, f"{fields}, d long, whitened array<double>, deviation long")


def whiten(df: DataFrame, embedding: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Adds n, deviation, whitened (an array of up to k values), explained (an array) and identity_error."""
    results = ("n", "deviation", "whitened", "explained", "identity_error")
    kept = others(df, *results)
    rows = df.select(F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(kept)), F.lit(0).alias("_")).alias("_row"), integers(column(embedding)).alias("x")).filter(F.col("x").isNotNull())
    models, errors = fit(rows, k)
    spark = df.sparkSession
    facts = spark.createDataFrame([(d, m.n, m.explained, errors.get(d)) for d, m in models.items()], "d long, n long, explained array<double>, identity_error double")
    done = projected(rows, models, k).join(F.broadcast(facts), "d")  # a row for each vector length
    return done.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(kept)), *results)


def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = done.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
