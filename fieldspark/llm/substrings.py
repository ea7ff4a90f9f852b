"""Removal of repeated word windows, by super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  Its minimiser is the
smallest hash among its pairs of adjacent words, where pairs that make up over a
``FREQUENT``-th of all words come after all others (at most ``MOST_FREQUENT`` of them;
they are counted first, and any list would do): a frequent pair draws only windows
that have no other.  Consecutive windows with the
same minimiser share most of their words, so they travel as one packed string
(a super-k-mer) to the bucket of that minimiser; equal windows have equal
minimisers and so meet.  In a bucket, sorting brings equal windows together:
all but the one that starts first (smaller doc_id, or same document and earlier)
are repeats.  Windows are told apart by two 64-bit hashes of their words, 128
bits in all, inside the bucket of their minimiser.

Skew: each task first sorts the windows of its own batch and sends only the
first of equal ones, so a passage or document with any number of copies costs a
bucket one string per batch, not one per copy.  The number of buckets follows
the bytes of the table, so a bucket is about ``BUCKET_BYTES`` of text.

Defined results: a null or empty text has no words; texts shorter than a window
are kept whole.  A null doc_id counts as the smallest.  Rows that agree in id and
text are one document, each with its own result row; documents of one id but
different texts are ordered by a hash of the text.  White space between kept
words becomes one space.  Columns named as a result column are replaced, others
stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import BASE, Chunk, Powers, chunk_bounds, column, gathered, mix, others, spaces, text_bytes, utf8, written

BATCH_BYTES = 8 << 20
BUCKET_BYTES = 2 << 20
CHUNK_BYTES = 1 << 20
SECOND = 0xD6E8FEB86659FD93
FREQUENT, MOST_FREQUENT = 20_000, 1 << 16
PACKED = "bucket int, texts binary, places binary, keys binary, gone binary"
#: Length of a packed string, step of the document id from the one before, first word.
PLACE = np.dtype([("len", "<i4"), ("step", "<i8"), ("start", "<i4")])
GONE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("end", "<i4")])
NULL_ID = -(1 << 63)


def window_hash(h: np.ndarray, width: int, powers: Powers, salt: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes, by prefix sums."""
    up, down = powers.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(salt)) * up[: len(h)], out=total[1:])
    n = max(0, len(h) - width + 1)
    return mix((total[width:] - total[:n]) * down[:n]) if n else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def word_pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(BASE) + h[1:] * np.uint64(SECOND)) >> np.uint64(1)


def minimisers(h: np.ndarray, width: int, frequent: np.ndarray) -> np.ndarray:
    if width < 2 or len(h) < width:
        return mix(h[: max(0, len(h) - width + 1)])
    pairs = word_pairs(h)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, pairs), len(frequent) - 1)] == pairs
        pairs[often] |= np.uint64(1 << 63)
    return sliding_min(pairs, width - 1)


def frequent_pairs(docs: DataFrame) -> np.ndarray:
    """Pairs of words that a table (text in _text) holds most often, sorted; a batch names those with a fair share of it."""
    space = spaces()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for table in gathered(batches, "_text", BATCH_BYTES):
            texts, size = utf8(table.column("_text")), 0
            parts = []
            for lo, hi in chunk_bounds(texts, CHUNK_BYTES):
                c = Chunk(texts[lo:hi], space, powers)
                doc, pairs = c.doc_of_word(), word_pairs(c.hash)
                parts.append(pairs[doc[1:] == doc[:-1]])
                size += len(c.hash)
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            often = n >= max(4, size // (2 * FREQUENT))
            yield pa.RecordBatch.from_pydict({"pair": np.r_[values[often].view(np.int64), -1], "n": np.r_[n[often], size]})

    counted = docs.select("_text").mapInArrow(go, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(counted)
    words = counted.filter("pair = -1").agg(F.sum("n")).first()[0] or 0
    found = counted.filter((F.col("pair") >= 0) & (F.col("n") * FREQUENT > words)).orderBy(F.desc("n"), "pair").limit(MOST_FREQUENT).select("pair").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def repeats(h1: np.ndarray, h2: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """Marks windows with an equal one of smaller rank; of equal rank, none.  rank: by default the position."""
    order = np.argsort(h1, kind="stable") if rank is None else np.lexsort((rank, h2, h1))
    a, b = h1[order], h2[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
    out = np.zeros(len(order), bool)
    out[order] = ~new
    if rank is not None:
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        r = rank[order]
        out[order] &= r > r[first]
    return out


def runs(starts: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of runs, given where each but the first begins."""
    at = np.flatnonzero(np.r_[True, breaks]) if len(starts) else np.zeros(0, np.int64)
    return at, np.r_[at[1:], len(starts)][: len(at)] - 1


def pack(table: pa.Table, width: int, buckets: int, space: np.ndarray, powers: Powers, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = table.sort_by([("_id", "ascending"), ("_key", "ascending")])
    ids, keys = table.column("_id").to_numpy(), table.column("_key").to_numpy()
    once = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
    ids, keys, texts = ids[once], keys[once], utf8(table.column("_text").take(pa.array(once)))
    parts = []
    for lo, hi in chunk_bounds(texts, CHUNK_BYTES):
        c = Chunk(texts[lo:hi], space, powers)
        doc, h1 = c.doc_of_word(), window_hash(c.hash, width, powers, 1)
        n = len(h1)
        at = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n])
        local = at - c.bound[doc[at]]
        parts.append((h1[at], window_hash(c.hash, width, powers, 2)[at], minimisers(c.hash, width, frequent)[at], doc[at] + lo, local, c.start[at], c.end[at + width - 1], np.full(len(at), len(parts)), c.data))
    texts = None
    h1, h2, least, doc, start, byte, stop, part = (np.concatenate([p[i] for p in parts]) for i in range(8))
    data = [p[8] for p in parts]
    again = repeats(h1, h2)
    # repeats inside this batch: runs of (document, first word, end word)
    g = np.flatnonzero(again)
    a, b = runs(g, (np.diff(g) != 1) | (doc[g][1:] != doc[g][:-1]))
    gone = np.zeros(len(a), GONE)
    gone["doc"], gone["key"], gone["start"], gone["end"] = ids[doc[g[a]]], keys[doc[g[a]]], start[g[a]], start[g[b]] + width
    # the rest: super-k-mers, by bucket
    s = np.flatnonzero(~again)
    a, b = runs(s, (np.diff(s) != 1) | (doc[s][1:] != doc[s][:-1]) | (least[s][1:] != least[s][:-1]))
    a, b = s[a], s[b]
    to = (mix(least[a]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    a, b, to = a[order], b[order], to[order]
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    zip_, rows = zstandard.ZstdCompressor(level=3), {f.split()[0]: [] for f in PACKED.split(", ")}
    lead = gone["doc"] * 0 + (np.arange(len(gone)) % max(1, len(cut)))
    for i, (lo, hi) in enumerate(zip(cut, np.r_[cut[1:], len(to)][: len(cut)], strict=True)):
        x, y = a[lo:hi], b[lo:hi]
        pieces = [data[p][u:v] for p, u, v in zip(part[x].tolist(), byte[x].tolist(), stop[y].tolist(), strict=True)]
        rows["bucket"].append(int(to[lo]))
        rows["texts"].append(zip_.compress(b"\n".join(pieces)))
        place = np.zeros(len(x), PLACE)
        place["len"], place["start"] = list(map(len, pieces)), start[x]
        place["step"] = np.diff(np.r_[0, ids[doc[x]]])
        rows["places"].append(zip_.compress(b"".join(place[c].tobytes() for c in PLACE.names)))
        rows["keys"].append(keys[doc[x]].tobytes())
        rows["gone"].append(gone[lead == i].tobytes() if len(gone) else b"")
    if not len(cut) and len(gone):
        for k in rows:
            rows[k].append(0 if k == "bucket" else gone.tobytes() if k == "gone" else zip_.compress(b"") if k != "keys" else b"")
    yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in list(rows)[1:])], names=list(rows))


def by_document(gone: np.ndarray) -> pa.Table:
    order = np.lexsort((gone["start"], gone["key"], gone["doc"]))
    g = gone[order]
    cut = np.flatnonzero(np.r_[True, (g["doc"][1:] != g["doc"][:-1]) | (g["key"][1:] != g["key"][:-1])])[: len(g)]
    spans = np.stack([g["start"], g["end"]], axis=1)
    return pa.table({"_id": g["doc"][cut], "_key": g["key"][cut], "spans": pa.array([spans[u:v].tobytes() for u, v in zip(cut, np.r_[cut[1:], len(g)][: len(cut)], strict=True)], pa.binary())})


def own(doc_id: str, text: str) -> list:
    """The id, and a hash of 64 bits that only tells texts of one id apart."""
    return [F.coalesce(column(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(column(doc_id), column(text)).alias("_key")]


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """Spans of words to remove: _id, _key (see with_key), spans (binary pairs of int32: first word, end)."""
    buckets = max(12, text_bytes(df, text) // BUCKET_BYTES)
    docs = df.select(*own(doc_id, text), column(text).alias("_text"))
    space, frequent = spaces(), df.sparkSession.sparkContext.broadcast(frequent_pairs(docs))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for table in gathered(batches, "_text", BATCH_BYTES):
            yield from pack(table, width, buckets, space, powers, frequent.value)

    def count(table: pa.Table) -> pa.Table:
        found, powers, unzip = [np.frombuffer(x, GONE) for x in table.column("gone").to_pylist()], Powers(), zstandard.ZstdDecompressor()
        pieces, docs, keys, starts = [], [], [], []
        for r in table.select(["texts", "places", "keys"]).to_pylist():
            whole, key, place = unzip.decompress(r["texts"]), np.frombuffer(r["keys"], np.int64), unzip.decompress(r["places"])
            n = len(key)
            ends = np.cumsum(np.frombuffer(place, np.int32, n) + 1) - 1
            pieces += [whole[u:v] for u, v in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=False)]
            docs.append(np.cumsum(np.frombuffer(place, np.int64, n, 4 * n)))
            keys.append(key)
            starts.append(np.frombuffer(place, np.int32, n, 12 * n))
        if pieces:
            c = Chunk(pieces, space, powers)
            own = c.doc_of_word()
            h1 = window_hash(c.hash, width, powers, 1)
            at = np.flatnonzero(own[: len(h1)] == own[width - 1 : width - 1 + len(h1)])
            h1, h2, own = h1[at], window_hash(c.hash, width, powers, 2)[at], own[at]
            docs, keys = np.concatenate(docs)[own], np.concatenate(keys)[own]
            starts = np.concatenate(starts)[own] + (at - c.bound[own]).astype(np.int32)
            by = np.lexsort((starts, keys, docs))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(np.r_[0, (np.diff(docs[by]) != 0) | (np.diff(keys[by]) != 0) | (np.diff(starts[by]) != 0)][: len(by)])
            g = np.flatnonzero(repeats(h1, h2, rank))
            a, b = runs(g, (np.diff(g) != 1) | (own[g][1:] != own[g][:-1]))
            more = np.zeros(len(a), GONE)
            more["doc"], more["key"], more["start"], more["end"] = docs[g[a]], keys[g[a]], starts[g[a]], starts[g[b]] + width
            found.append(more)
        return by_document(np.concatenate(found))

    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    packed = docs.mapInArrow(send, PACKED).repartition(n, "bucket")
    return packed.groupBy("bucket").applyInArrow(count, "_id long, _key long, spans binary")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """Replaces ``text`` by its kept words and adds n_words and n_removed."""
    kept = others(df, "n_words", "n_removed")
    spans = repeated_spans(df, doc_id, text, width).groupBy("_id", "_key").agg(F.collect_list("spans").alias("_spans"))
    docs = df.select(F.struct(*map(column, kept)).alias("_row"), *own(doc_id, text))
    joined = docs.join(spans, ["_id", "_key"], "left").select("_row", "_spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_words, n_removed = [], [], []
            cols = b.column(0).flatten()
            for t, found in zip(cols[kept.index(text)].cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or b"").split()
                n_words.append(len(words))
                if found:
                    s = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2)
                    step = np.bincount(s[:, 0], minlength=len(words) + 1) - np.bincount(s[:, 1], minlength=len(words) + 1)
                    words = [w for w, cover in zip(words, np.cumsum(step).tolist(), strict=False) if not cover]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words))
            cols[kept.index(text)] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*kept, "n_words", "n_removed"])

    schema = T.StructType([*(f if f.name != text else T.StructField(text, T.StringType()) for f in df.select(*map(column, kept)).schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(clean, schema)


def op7_repeated_passages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
