"""Language-model scoring by context-tree weighting.

A text is the bytes of its words (A-Z lower-cased) with one blank between them
and a line feed at the end; line feeds stand before its start.  Each byte is eight
binary decisions.  A node of the tree is a context of 0 to ``DEPTH`` bytes with the
bits decided so far, and holds counts of both outcomes.  With KT(s) the
Krichevsky-Trofimov probability of a node's counts and Pw its weighted one,

    Pw(s) = KT(s) / 2 + (product of Pw over the longer contexts of s) / 2,

and Pw = KT at full depth.  A new bit is predicted by mixing the KT estimates of
all depths on its path, with the posterior weights that the training counts give;
counts stay frozen while texts are scored.

Counts cover all training texts and come from one shuffle; every context of the
training texts is kept.  The tree is cut at contexts of ``STEM`` bytes: what lies
below a stem is built from the counts of one bucket of stems, the nodes above it
from the buckets' sums (they are broadcast; their number is bounded by the bytes
in use, not by the corpus).  A batch of texts asks each bucket for its distinct
grams, packed in one row, and gets their values back in the same order.

The base score is a unigram model of words.  Words seen often (at most
``FREQUENT``, by a threshold found likewise) are scored where the text lies, the
others by a join.

Defined results: a null or empty text is its end alone.  Rows that agree in id and
text have equal results, one each.  Without training texts every bit has
probability one half and the base score is 0.  Ties can't arise.  Other columns
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import ASCII_LOWER, Chunk, Powers, chunk_bounds, gathered, remainder, spaces, utf8, with_key, written

DEPTH = 5
#: Latest bytes of a context that tell its bucket; grams of a bucket, documents for each bucket at most.
STEM, BUCKET_GRAMS, BUCKET_DOCS = 3, 1 << 16, 1 << 12
FREQUENT = 1 << 17
BATCH_BYTES = 4 << 20
END = -1
NULL_ID = -(1 << 63)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The context and byte (depth + 1 bytes, the latest lowest) of each symbol, and each text's symbols."""
    whole = [b" ".join(t.translate(ASCII_LOWER).split()) for t in texts]
    lens = np.fromiter(map(len, whole), np.int64, len(whole)) + 1
    gap = max(depth, 1)  # line feeds between texts: an end and what stands before a start
    data = b"\n" * 7 + (b"\n" * gap).join(whole) + b"\n"
    # the eight bytes that end at each place, the latest lowest
    code = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64)
    if depth < 7:
        code &= np.uint64((1 << (8 * depth + 8)) - 1)
    start = np.cumsum(lens + gap - 1) - (lens + gap - 1)
    at = np.repeat(start - (np.cumsum(lens) - lens), lens)
    at += np.arange(len(at))
    return code[at], lens


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, rising, and where each one's run starts; faster than np.unique, which hashes."""
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    return x[first], first


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The natural logarithm of the KT probability of counts, by Stirling's series of the gamma function."""

    def lgamma(x):
        shift = np.zeros_like(x)
        for _ in range(6):
            small = x < 8
            shift -= np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
            x = np.where(small, x + 1, x)
        return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)

    a, b = n0.astype(float), n1.astype(float)
    return np.where(a + b == 0, 0.0, lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(np.pi))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a sorted table, and whether the key is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def level(code: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a depth (context << 8 | byte, sorted) and their counts, from codes of a greater one."""
    found, at = np.unique(code & np.uint64((1 << (8 * depth + 8)) - 1), return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


class Tree:
    """The weighted model of (context, byte) counts, one table for each depth."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], low: int = 0, longer: tuple[np.ndarray, np.ndarray] | None = None, top: Tree | None = None):
        """counts: for each depth from ``low`` the codes (context << 8 | byte, sorted) and counts.

        longer: nodes of the last depth and sums of log Pw one depth below, if contexts go on elsewhere.
        top: the tree of the depths below ``low``; without it only log Pw (``weighted``) is known.
        """
        self.low, self.depth = low, low + len(counts) - 1
        self.ctx, self.gram, self.value, self.node, self.w, self.q = ([None] * (self.depth + 1) for _ in range(6))
        held, above, weighted = [None] * (self.depth + 1), [None] * (self.depth + 1), None
        for d, (code, n) in enumerate(counts, low):
            byte, keys, n0, n1 = code & np.uint64(255), [], [], []
            for k in range(8):
                key = (code >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k))
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                one = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
                keys.append(key[first])
                n1.append(np.add.reduceat(np.where(one, n, 0), first) if len(first) else n[:0])
                n0.append(np.add.reduceat(np.where(one, 0, n), first) if len(first) else n[:0])
            key = np.concatenate(keys)
            order = np.argsort(key)
            self.node[d], self.gram[d] = key[order], code
            self.ctx[d] = np.unique(code >> np.uint64(8))
            held[d] = np.concatenate(n0)[order], np.concatenate(n1)[order]
        for d in range(self.depth, low - 1, -1):
            n0, n1 = held[d]
            own = log_kt(n0, n1)
            self.q[d] = (n1 + 0.5) / (n0 + n1 + 1.0)
            if d == self.depth and longer is None:
                weighted, self.w[d] = own, np.ones(len(own))
            else:
                up, below = (above[d + 1], weighted) if d < self.depth else (find(self.node[d], longer[0])[0], longer[1])
                weighted = np.logaddexp(own, np.bincount(up, below, len(n0))) - np.log(2)
                self.w[d] = np.exp(own - np.log(2) - weighted)
            if d > low:
                keep = np.uint64((1 << (8 * d)) - 1)  # the node of the context without its oldest byte
                above[d], _ = find(self.node[d - 1], self.node[d] & keep)
        self.weighted = weighted
        if top is not None or not low:
            self.spread(top, above)

    def spread(self, top: Tree | None, above: list) -> None:
        """Values of all grams, from the root down."""
        mass, left = np.zeros(len(self.node[self.low])), np.ones(len(self.node[self.low]))
        if self.low:
            for own, theirs in ((self.ctx, top.ctx), (self.gram, top.gram), (self.value, top.value), (self.node, top.node), (self.w, top.w), (self.q, top.q)):
                own[: self.low] = theirs
            at, _ = find(top.node[-1], self.node[self.low] & np.uint64((1 << (8 * self.low)) - 1))
            mass, left = (x[at] for x in top.after)
        for d in range(self.low, self.depth + 1):
            if d > self.low:
                mass, left = (mass + left * self.w[d - 1] * self.q[d - 1])[above[d]], (left * (1 - self.w[d - 1]))[above[d]]
            one = mass + left * (self.w[d] * self.q[d] + (1 - self.w[d]) * 0.5)
            code, total = self.gram[d], np.zeros(len(self.gram[d]))
            byte = code & np.uint64(255)
            for k in range(8):
                at, _ = find(self.node[d], (code >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
                p = one[at] if len(one) else np.zeros(0)
                total += np.log10(np.where(byte >> np.uint64(7 - k) & np.uint64(1) == 1, p, 1 - p))
            self.value[d] = total.astype(np.float32)
        self.after = mass + left * self.w[self.depth] * self.q[self.depth], left * (1 - self.w[self.depth])

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte after its context."""
        out, ends = np.zeros(len(code)), np.zeros(len(code), np.int64)
        open_, unseen = np.arange(len(code)), []
        for d in range(self.depth, -1, -1):
            part = code[open_] & np.uint64((1 << (8 * d + 8)) - 1)
            at, seen = find(self.gram[d], part)
            known = seen.copy()
            known[~seen] = find(self.ctx[d], part[~seen] >> np.uint64(8))[1] if d else True
            out[open_[seen]] = self.value[d][at[seen]] if seen.any() else 0
            ends[open_[known]] = d
            unseen.append(open_[known & ~seen])
            open_ = open_[~known]
        unseen = np.concatenate(unseen)
        found, at = np.unique(code[unseen], return_inverse=True)
        to = np.zeros(len(found), np.int64)
        to[at] = ends[unseen]
        out[unseen] = self.bit_by_bit(found, to)[at]
        return out

    def bit_by_bit(self, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same for bytes not seen after their context: nodes without counts have weight and estimate 1/2."""
        byte, total = code & np.uint64(255), np.zeros(len(code))
        for k in range(8):
            mass, left, p = np.zeros(len(code)), np.ones(len(code)), np.zeros(len(code))
            for d in range(self.depth + 1):
                key = (code >> np.uint64(8) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8) | np.uint64(1 << k) | (byte >> np.uint64(8 - k))
                at, seen = find(self.node[d], key)
                w, q = (np.where(seen, t[d][at], 0.5) if len(t[d]) else np.full(len(code), 0.5) for t in (self.w, self.q))
                p = np.where(ends == d, mass + left * (w * q + (1 - w) * 0.5), p)
                mass, left = mass + left * w * q, left * (1 - w)
            total += np.log10(np.where(byte >> np.uint64(7 - k) & np.uint64(1) == 1, p, 1 - p))
        return total


class Tally:
    """Counts of 64-bit keys, merged now and then, passed on when they grow."""

    def __init__(self, kind: int, most: int = 1 << 20):
        self.kind, self.most, self.parts, self.size = kind, most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, first = distinct(keys)
        self.parts.append((found, np.diff(first, append=len(keys))))
        self.size += len(found)
        if self.size > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            code, found = pd.factorize(np.concatenate([k for k, _ in self.parts]))
            n = np.bincount(code, np.concatenate([n for _, n in self.parts]), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"kind": np.full(len(found), self.kind, np.int32), "key": found.view(np.int64), "n": n})
        self.parts, self.size = [], 0


def counted(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """(kind, key, n): kind 0 for grams, 1 for words and ends."""
    space = spaces()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, byte, word, ends = Powers(), Tally(0), Tally(1), 0
        for table in gathered(batches, "_text", BATCH_BYTES):
            texts = utf8(table.column("_text"))
            ends += len(texts)
            for lo, hi in chunk_bounds(texts, 1 << 20):
                yield from byte.add(grams(texts[lo:hi], depth)[0])
                yield from word.add(Chunk(texts[lo:hi], space, powers, ASCII_LOWER).hash)
        yield from byte.flush()
        yield from word.flush()
        yield pa.RecordBatch.from_pydict({"kind": np.array([1], np.int32), "key": np.array([END]), "n": np.array([ends])})

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(go, "kind int, key long, n long")
    return written(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n > 0"))


def threshold(levels: list[DataFrame], column: str, most: int) -> int:
    """The least power of two that at most ``most`` rows of all tables reach in ``column``."""
    sums = [F.sum((F.col(column) >= F.lit(1 << i)).cast("long")).alias(f"s{i}") for i in range(62)]
    found = np.zeros(62, np.int64)
    for level in levels:
        found += np.array([x or 0 for x in level.agg(*sums).first()])
    return 1 << int(np.flatnonzero(found <= most)[0])


def packed(x: np.ndarray) -> bytes:
    """Rising 64-bit numbers as compressed steps, one plane a byte."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return len(x).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def restored(model: bytes) -> Tree:
    tree = Tree.__new__(Tree)
    tree.__dict__.update(pickle.loads(model))
    return tree


SPREAD = 2654435761


def bucket_of(code: np.ndarray, stem: int, buckets: int) -> np.ndarray:
    low = np.uint64((1 << 32) - 1)
    return ((((code >> np.uint64(8) & np.uint64((1 << (8 * stem)) - 1)) * np.uint64(SPREAD) & low) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def bucket_column(stem: int, buckets: int) -> Column:
    own = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * stem)) - 1))
    return F.shiftright((own * F.lit(SPREAD)).bitwiseAND(F.lit((1 << 32) - 1)) * F.lit(buckets), 32).cast("int")


def by_bucket(code: np.ndarray, stem: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sorted codes by bucket, the buckets that have any, and where they start."""
    own = bucket_of(code, stem, buckets)
    order = np.argsort(own, kind="stable")
    own = own[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])[: len(own)]
    return order, own[start], start


def grown(counts: DataFrame, depth: int, stem: int, buckets: int) -> DataFrame:
    """Of each bucket: its grams and counts, the grams and sums of log Pw that the nodes above its stems need."""

    def each(table: pa.Table) -> pa.Table:
        code, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
        order = np.argsort(code)
        code, n = code[order], n[order]
        row = {"bucket": table.column("bucket")[:1], "code": [packed(code)], "n": [n.tobytes()]}
        upper, k = level(code, n, stem - 1) if stem else (code[:0], n[:0])
        tree = Tree([level(code, n, d) for d in range(stem, depth + 1)], stem)
        key, at = np.unique(tree.node[stem] & np.uint64((1 << (8 * stem)) - 1), return_inverse=True)
        sums = np.bincount(at, tree.weighted, len(key))
        return pa.table(row | {"upper": [packed(upper)], "k": [k.tobytes()], "node": [packed(key)], "weighted": [sums.tobytes()]})

    g = counts.filter("kind = 0").select(bucket_column(stem, buckets).alias("bucket"), "key", "n")
    return written(g.groupBy("bucket").applyInArrow(each, "bucket int, code binary, n binary, upper binary, k binary, node binary, weighted binary"))


def top_of(model: DataFrame, stem: int) -> bytes:
    """The tree of contexts shorter than a stem, built by one task; the driver only passes it on."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(c.as_py() for c in r) for b in batches for r in zip(*b.columns, strict=True)]
        none = np.zeros(0, np.uint64)
        upper, node = (np.concatenate([none, *(unpacked(r[i]) for r in rows)]) for i in (0, 2))
        k = np.concatenate([none.view(np.int64), *(np.frombuffer(r[1], np.int64) for r in rows)])
        weighted = np.concatenate([none.view(float), *(np.frombuffer(r[3], float) for r in rows)])
        tree = Tree([level(upper, k, d) for d in range(stem)], 0, (node, weighted))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(tree.__dict__)]})

    return bytes(model.select("upper", "k", "node", "weighted").repartition(1).mapInArrow(build, "model binary").first()[0])


def score_texts(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte."""
    sc = docs.sparkSession.sparkContext
    counts = counted(training, text, depth)
    words = counts.filter("kind = 1").select("key", "n")
    n_all, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = threshold([words], "n", frequent)
    often = words.filter(F.col("n") >= least).toArrow()
    key, n = often.column("key").to_numpy(), often.column("n").to_numpy()
    order = np.argsort(key)
    ends = words.filter(F.col("key") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bottom = n_all + 0.1 * (v + 1)
    held = sc.broadcast((key[order], n[order], np.log10((ends + 0.1) / bottom), int(ends > 0)))
    stem = min(STEM, depth)
    buckets = min(1 << 16, 1 + max(counts.filter("kind = 0").count() // BUCKET_GRAMS, docs.count() // BUCKET_DOCS))
    model = grown(counts, depth, stem, buckets)
    upper = sc.broadcast(top_of(model, stem) if stem else b"")
    space = spaces()
    keyed = with_key(docs, doc_id, text).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), "_key", F.col(text).alias("_text"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of bucket -1 with a batch's documents, and one of its distinct grams for each bucket."""
        key, n, end_score, end_known = held.value
        powers, batch = Powers(), TaskContext.get().partitionId() << 32
        for table in gathered(batches, "_text", BATCH_BYTES):
            texts, found, columns = utf8(table.column("_text")), [], []
            for lo, hi in chunk_bounds(texts, 1 << 20):
                found.append(distinct(grams(texts[lo:hi], depth)[0])[0])
                c = Chunk(texts[lo:hi], space, powers, ASCII_LOWER)
                word, h = pd.factorize(c.hash.view(np.int64))
                pos, known = find(key, h)
                own = np.where(known, np.log10((n[pos] + 0.1) / bottom), 0.0) if len(n) else np.zeros(len(h))
                sums = [np.bincount(c.doc_of_word(), x[word], hi - lo) for x in (own, known)]
                columns.append((np.diff(c.bound) + 1, np.rint(sums[1]).astype(np.int64) + end_known, sums[0] + end_score))
            if not texts:
                continue
            code = distinct(np.concatenate(found))[0]
            order, own, start = by_bucket(code, stem, buckets)
            parts = np.split(code[order], start[1:])
            data = pickle.dumps((table.column("_id").to_numpy(), table.column("_key").to_numpy(), *map(np.concatenate, zip(*columns, strict=True)), texts))
            rows = [len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True), *map(packed, parts)]
            yield pa.RecordBatch.from_pydict({"batch": np.full(len(rows), batch), "bucket": np.r_[np.int32(-1), own].astype(np.int32), "data": pa.array(rows, pa.binary())})
            batch += 1

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        """Values of the grams that each batch asked a bucket for."""
        if not right.num_rows:
            return right.select(["batch", "bucket", "data"])
        code, n = (unpacked(left.column("code")[0].as_py()), np.frombuffer(left.column("n")[0].as_py(), np.int64)) if left.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        tree = Tree([level(code, n, d) for d in range(stem, depth + 1)], stem, None, restored(upper.value) if stem else None)
        data = [tree.log10(unpacked(x.as_py())).astype(np.float32).tobytes() for x in right.column("data")]
        return pa.table([right.column("batch"), right.column("bucket"), pa.array(data, pa.binary())], names=["batch", "bucket", "data"])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        blob = left.column("data")[0].as_py()
        ids, keys, n_tokens, n_known, base, texts = pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))
        chunks = []
        for lo, hi in chunk_bounds(texts, 1 << 20):
            code, symbols = grams(texts[lo:hi], depth)
            chunks.append((*pd.factorize(code), symbols))
        place, code = pd.factorize(np.concatenate([c[1] for c in chunks]))
        rising = np.argsort(code)
        values = np.zeros(len(code), np.float32)
        found = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        values[rising[by_bucket(code[rising], stem, buckets)[0]]] = np.frombuffer(b"".join(found[x] for x in sorted(found)), np.float32)
        own, scores = values[place].astype(float), []
        for at, codes, symbols in chunks:
            scores.append(np.add.reduceat(own[: len(codes)][at], np.cumsum(symbols) - symbols))
            own = own[len(codes) :]
        score, symbols = np.concatenate(scores), np.concatenate([c[2] for c in chunks])
        return pa.table([*map(pa.array, (ids, keys, n_tokens, n_known, base, score, -score * np.log2(10) / symbols))], names=["_id", "_key", "n_tokens", "n_known", "base", "score", "bits_per_byte"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held.value[0]
        powers = Powers()
        for table in gathered(batches, "_text", BATCH_BYTES):
            texts = utf8(table.column("_text"))
            ids, keys = table.column("_id").to_numpy(), table.column("_key").to_numpy()
            for lo, hi in chunk_bounds(texts, 1 << 20):
                c = Chunk(texts[lo:hi], space, powers, ASCII_LOWER)
                h = c.hash.view(np.int64)
                word, distinct_h = pd.factorize(h)
                out = ~find(key, distinct_h)[1][word]
                h, doc = h[out], c.doc_of_word()[out] + lo
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
                lead = np.r_[True, doc[first][1:] != doc[first][:-1]][: len(first)]
                yield pa.RecordBatch.from_pydict({"word": h[first], "_id": ids[doc[first]], "_key": keys[doc[first]], "tf": np.diff(np.r_[first, len(h)]).astype(np.int32), "one": lead.astype(np.int32)})

    batches = written(keyed.mapInArrow(asked, "batch long, bucket int, data binary"))
    answers = model.groupBy("bucket").cogroup(batches.filter("bucket >= 0").groupBy("bucket")).applyInArrow(answered, "batch long, bucket int, data binary")
    near = batches.filter("bucket = -1").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(scored, "_id long, _key long, n_tokens long, n_known long, base double, score double, bits_per_byte double")
    far = keyed.mapInArrow(rare, "word long, _id long, _key long, tf int, one int")
    c = F.coalesce(F.col("n"), F.lit(0))
    far = far.join(words.filter(F.col("n") < least), F.col("word") == F.col("key"), "left")
    far = far.groupBy("_id", "_key").agg(F.sum(F.col("tf") * F.log10((c + 0.1) / F.lit(float(bottom)))).alias("b"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum("one").alias("copies"))
    both = near.join(far, ["_id", "_key"], "left")
    share = lambda x: F.coalesce(F.col(x) / F.col("copies"), F.lit(0))
    return both.select(
        F.when(F.col("_id") != NULL_ID, F.col("_id")).alias(doc_id), "n_tokens", (F.col("n_known") + share("k")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + share("b")).alias("base_score"), "score", "bits_per_byte"
    )


def held_out(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, 10) == 0


def op8_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, docs.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
