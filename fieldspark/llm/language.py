"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are hashed 1- to 3-grams of code points; letters are lower-cased and
runs of other characters count as one blank.  Document frequencies cover all
training documents.  The classifier is fitted on a bounded sample: at most
``per_language`` different training documents of each language, those of least hash
of id and text, so that copies and rows of one id count once.  Weights follow the regularised leader (FTRL-proximal) with an elastic net: l1
leaves most at exactly zero, l2 shrinks the rest.  A fifth of the sample is kept
out of the fit.  Whole documents are too easy to calibrate on, so pieces of ``CUTS``
characters of each, from a place drawn by a hash, stand beside it: together they set the
temperature that divides the logits (the inverse of least log loss, which is convex in it).
A bar is the score that all but ``BELOW`` of the pieces of one length reach (the longest
together with the documents as they are), ``MOST_BAR`` at most; a text has the bar of the longest pieces that are no longer than itself, so a
short clean text needn't be as sure as a long one (``clears``).

Defined results: ``und`` with score 0 for a text that is null or has no letter,
and for every text when nothing could be learned.  Ties go to the first language
in order.  Rows with null lang are not learned from; more than ``MOST_LANGUAGES``
languages are an error.  Repeated rows have repeated results.  Texts are counted in
slices of ``SLICE`` code points, so memory has a bound but for the text itself.
Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import mix, remainder

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: Documents and code points counted at a time, and the most languages that are told apart.
AT_ONCE, SLICE, MOST_LANGUAGES = 32, 1 << 20, 500
#: Lengths of the held-out pieces; share of them that lies below their bar; how much a bar is above chance at least, and a bar's most.
CUTS, BELOW, MARGIN, MOST_BAR = (20, 50, 200), 0.02, 0.05, 0.65
#: Inverse temperatures that are looked at.
STEEP = (0.05, 20.0)


class Letters:
    """Lower-case code points of letters, 32 for all else, for the first 65,536; others one by one."""

    def __init__(self):
        self.table = np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[np.minimum(code, 0xFFFF)]
        high = code > 0xFFFF
        if high.any():
            out[high] = [c if chr(c).isalpha() else 32 for c in code[high].tolist()]
        blank = out == 32
        return out[~(blank & np.r_[False, blank[:-1]])] if len(out) else out


def pieces(texts: list[str], letters: Letters) -> Iterator[tuple[int, np.ndarray, int]]:
    """Each text's codes between blanks, in pieces: the text, the codes, and how many of them lead from the piece before."""
    for i, t in enumerate(texts):
        tail, length = np.array([32], np.uint32), 1
        for lo in range(0, max(1, len(t)), SLICE):
            new = letters(t[lo : lo + SLICE])
            if len(new) and new[0] == 32 and tail[-1] == 32:
                new = new[1:]
            code, lead = np.r_[tail, new], len(tail) if lo else 0
            length += len(new)
            if lo + SLICE >= len(t) and (code[-1] != 32 or length == 1):
                code = np.r_[code, np.uint32(32)]
            yield i, code, lead
            tail = code[-2:]


def runs(texts: list[str], letters: Letters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of some pieces, their piece, whether they lead, and the text of each piece."""
    held, size = [], 0
    for piece in pieces(texts, letters):
        held.append(piece)
        size += len(piece[1])
        if size > SLICE:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(c) for _, c, _ in held])
    piece = np.repeat(np.arange(len(held)), lens)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(lens) - lens, lens)
    return np.concatenate([c for _, c, _ in held]), piece, place < np.repeat([n for _, _, n in held], lens), np.array([i for i, _, _ in held])


def counts(texts: list[str], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts by bucket of each text, and whether it has a letter."""
    total, some = np.zeros(len(texts) * BUCKETS, np.float32), np.zeros(len(texts), bool)
    for code, piece, lead, owner in runs(texts, letters):
        code = code.astype(np.uint64)
        some[owner[piece[code != 32]]] = True
        for n in ORDERS:
            m = max(0, len(code) - n + 1)
            gram = np.full(m, n, np.uint64)
            for j in range(n):
                gram = (gram << np.uint64(21)) ^ code[j : j + m]
            ours = (piece[:m] == piece[n - 1 : n - 1 + m]) & ~lead[n - 1 : n - 1 + m]  # those that end in the lead were counted before
            total += np.bincount(owner[piece[:m][ours]] * BUCKETS + (mix(gram[ours]) >> np.uint64(64 - BITS)).astype(np.int64), minlength=len(total)).astype(np.float32)
    return total.reshape(len(texts), BUCKETS), some


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4) -> np.ndarray:
    """Weights by bucket (the last row: bias) and class from sparse unit rows (buckets, values, class)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.r_[at, BUCKETS], np.r_[x, 1.0]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    top = logits.max(axis=1)
    return float((top + np.log(np.exp(logits - top[:, None]).sum(axis=1)) - logits[np.arange(len(y)), y]).mean())


def temperature(logits: np.ndarray, y: np.ndarray, steps: int = 80) -> float:
    """The divisor of least log loss, by golden sections of its inverse, in which the loss is convex; 1 where nothing is better."""
    if not len(y):
        return 1.0
    lo, hi, golden = *STEEP, (5**0.5 - 1) / 2
    for _ in range(steps):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if log_loss(logits * a, y) <= log_loss(logits * b, y) else (a, hi)
    best = (lo + hi) / 2
    return 1.0 if log_loss(logits, y) <= log_loss(logits * best, y) else float(1 / best)


def reliability(guessed: DataFrame, truth: Column, bins: int = 10) -> DataFrame:
    """Per tenth of the score: documents, mean score and share of right ones; ``guess`` is a column of identified()."""
    score = F.col("guess.score")
    at = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    return guessed.filter(truth.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg((F.col("guess.lang") == truth).cast("double")).alias("right"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 500) -> dict | None:
    """The model of some labelled documents: languages, table (bucket by language), bias, temperature, bars by length (bar: of long texts) and the held-out log loss."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    drawn_by = F.xxhash64(F.col(doc_id), F.col(text), F.lit("sample"))
    by_language = sorted(labelled.groupBy(F.col(lang).alias("lang")).agg(F.approx_count_distinct(drawn_by).alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(by_language) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not by_language:
        return None
    names = [r[0] for r in by_language]

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df, n = Letters(), np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), AT_ONCE):
                df[:-1] += (counts(texts[lo : lo + AT_ONCE], letters)[0] > 0).sum(axis=0)
            df[-1] += len(texts)
        yield pa.RecordBatch.from_pydict({"bucket": np.flatnonzero(df).astype(np.int32), "df": df[df > 0]})

    found = labelled.select(text).mapInArrow(frequency, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(BUCKETS + 1)
    df[found.column("bucket").to_numpy()] = found.column("df").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1
    hashed = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), drawn_by.alias("d"))
    # Hashes below a bound that about four times as many reach as are wanted, then the least of them.
    least = F.create_map(*[F.lit(x) for name, n in by_language for x in (name, int(-(2**63) + min(1.0, 4 * per_language / max(1, n)) * (2**64 - 2**12)))])
    rank = F.row_number().over(Window.partitionBy("l").orderBy("d"))
    drawn = hashed.filter(F.col("d") <= F.element_at(least, F.col("l"))).select("l", "d").distinct().withColumn("rank", rank).filter(F.col("rank") <= per_language).select("l", "d")
    sample = hashed.join(F.broadcast(drawn), ["l", "d"]).dropDuplicates(["l", "d"]).select("t", "l", F.pmod(F.xxhash64("d", F.lit("held")), F.lit(5)).alias("h"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for b in batches:
            rows = []
            for t, l, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                texts = [(0, t)]
                if h == 0:
                    at = zlib.crc32(t.encode(errors="replace"))
                    texts += [(n, t[(lo := at % (len(t) - n + 1)) : lo + n]) for n in CUTS if len(t) > n]
                for size, x in texts:
                    found, some = counts([x], letters)
                    if some[0] or not size:  # a piece without letters says nothing
                        v = unit(found[0] * idf)
                        held = np.flatnonzero(v)
                        rows.append((held.astype(np.int32).tobytes(), v[held].tobytes(), l, h, size))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["at", "x", "l", "h", "size"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], []
        for b in batches:
            for r in b.to_pylist():
                x = (np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), names.index(r["l"]))
                if r["h"]:
                    rows.append(x)
                else:
                    held.append((*x, r["size"]))
        rows.sort(key=lambda r: (r[2], r[0].tobytes()))
        held.sort(key=lambda r: (r[2], r[3], r[0].tobytes()))
        w = ftrl(rows, len(names))
        held = held or [(*r, 0) for r in rows]
        logits = np.array([x @ w[at] + w[-1] for at, x, *_ in held], float).reshape(len(held), len(names))
        y, size = np.array([r[2] for r in held], int), np.array([r[3] for r in held], int)
        t = temperature(logits, y)
        reached = softmax(logits / t).max(axis=1)
        bars, least = [], min(MOST_BAR, 1 / len(names) + MARGIN) if len(names) > 1 else 0.0
        for cut in CUTS:  # a longer text's bar is no lower
            own = reached[(size == cut) | ((size == 0) & (cut == CUTS[-1]))]
            if len(names) > 1 and len(own):
                least = max(least, min(MOST_BAR, float(np.quantile(own, BELOW, method="lower"))))
            bars.append(least)
        yield pa.RecordBatch.from_pydict({"w": [w.tobytes()], "t": [t], "bars": [bars], "loss": [log_loss(logits / t, y)]})

    fitted = sample.mapInArrow(sparse, "at binary, x binary, l string, h long, size long").repartition(1).mapInArrow(fit, "w binary, t double, bars array<double>, loss double").first()
    w = np.frombuffer(fitted["w"], np.float32).reshape(-1, len(names))
    return {"names": names, "idf": idf, "table": w[:-1], "bias": w[-1], "temperature": fitted["t"], "bar": fitted["bars"][-1], "bars": list(fitted["bars"]), "log_loss": fitted["loss"]}


def identified(df: DataFrame, model: dict | None, text: str = "text") -> Column:
    """A column of (lang, score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, letters = shared.value, Letters()
        for series in parts:
            texts = [t or "" for t in series]
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            for lo in range(0, len(texts) if m else 0, AT_ONCE):
                x, some = counts(texts[lo : lo + AT_ONCE], letters)
                p = softmax((unit(x * m["idf"]) @ m["table"] + m["bias"]).astype(float) / m["temperature"])
                best = p.argmax(axis=1)
                langs[lo : lo + len(x)][some] = np.array(m["names"], object)[best[some]]
                scores[lo : lo + len(x)][some] = p[np.arange(len(p)), best][some]
            yield pd.DataFrame({"lang": langs, "score": scores})

    return guess(F.col(text))


def clears(text: Column, guess: Column, model: dict) -> Column:
    """Whether a guess names a language and reaches the bar of texts of that length."""
    bar = F.lit(model["bars"][0])
    for cut, own in zip(CUTS[1:], model["bars"][1:], strict=True):
        bar = F.when(F.length(text) >= cut, own).otherwise(bar)
    return (guess["lang"] != "und") & (guess["score"] >= bar)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(remainder("doc_id", 4) != 2))
    out = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), identified(docs, model).alias("g"))
    return out.select("doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"))
