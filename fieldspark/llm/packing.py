"""Packing documents into token windows by lexical retrieval.

Documents are tokenized where they lie, then dealt to shards by content.  A
document's key is three of its terms (token ids), each drawn by a hash in proportion
to the terms' BM25 weights: two documents draw the same one as often as their weighted
terms agree, so documents of one topic come to lie side by side.  The table is cut in
the order of the keys into ranges; many documents of one key (copies) are spread by
their place in the input.  A task reads its range in order and cuts it into shards of
``SHARD_DOCS`` documents (the last has up to twice as many), or fewer where they hold
``SHARD_BYTES`` of tokens.

A shard holds an inverted index: for every term the documents with it and their BM25
weights, with the document frequencies of the whole table.  A seed document opens a
window; the index is asked for the unused documents of the shard that score best for
all terms of the seed, and they fill the window greedily, best first.  The last
document of a window is cut where the window is full, and its rest opens the next one,
so only the last window of a shard is padded.

Tokens: text splits into units of white space followed by other characters.
The pre-tokenizer's pieces never span two units, so a unit's ids depend on the
unit alone: each task encodes the distinct units of its batch once, all joined,
and puts them together again.  Where that argument fails (white space beyond
ASCII, a special token's string) the whole text is encoded by the tokenizer.

Defined results: a null or empty text is one end token.  Rows of equal id are
separate documents, so are rows equal in both.  Columns other than id and text are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Chunk, Powers, chunk_bounds, column, gathered, mix, ragged, spaces, utf8, written

WINDOW = 2048
SHARD_DOCS, SHARD_BYTES, RANGE_BYTES = 1024, 8 << 20, 4 << 20
BATCH_BYTES = 4 << 20
NULL_ID = -(1 << 63)
VOCABULARY = 1 << 16
KEYS = ("k1", "k2", "k3")
#: Neighbours asked for at a time; when they are used up, the index is asked again.
ASK = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
K1, B = 1.2, 0.75


class Encoder:
    """ids of texts under a byte-level BPE, by way of distinct units."""

    def __init__(self, ranks_path: str, json_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.json_path, self.whole, self.powers, self.space = json_path, None, Powers(), spaces()

    def entire(self, text: bytes) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, np.uint16)

    def odd(self, text: bytes) -> bool:
        """White space beyond ASCII can only start with these bytes; special tokens with this string."""
        return b"\xe1" in text or b"\xe2" in text or b"\xe3" in text or b"\xc2\x85" in text or b"\xc2\xa0" in text or b"<|endoftext|>" in text

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if self.odd(t):
                out[i] = self.entire(t)
            else:
                plain.append(i)
        for lo, hi in chunk_bounds([texts[i] for i in plain], 4 << 20):
            at = plain[lo:hi]
            flat, counts = self.units([texts[i] for i in at])
            ends = np.cumsum(counts)
            for i, u, v in zip(at, (ends - counts).tolist(), ends.tolist(), strict=True):
                out[i] = flat[u:v]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate(out) if out else np.zeros(0, np.uint16), counts

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        c = Chunk(texts, self.space, self.powers)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        # a unit ends where its word ends; what is left at a document's end is a unit of white space
        first, last = c.bound[:-1], c.bound[1:]
        begin = np.r_[0, c.end[:-1]] if len(c.end) else np.zeros(0, np.int64)
        has = last > first
        begin[first[has]] = c.doc_start[:-1][has]
        tail_from = np.where(has, c.end[np.maximum(last, 1) - 1] if len(c.end) else 0, c.doc_start[:-1])
        tail_to = c.doc_start[:-1] + lens
        tails = np.flatnonzero(tail_to > tail_from)
        up, down = self.powers.upto(len(c.buf) + 1)
        total = np.zeros(len(c.buf) + 1, np.uint64)
        np.cumsum((c.buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        h = mix(mix((total[c.end] - total[begin]) * down[begin]) + (c.end - begin).astype(np.uint64))
        code, _ = pd.factorize(h)
        head = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        head[code[::-1]] = np.arange(len(code))[::-1]
        bare = begin[head] == c.start[head]  # without white space before: only at a document's start
        pieces = [c.data[u:v] for u, v in zip(begin[head].tolist(), c.end[head].tolist(), strict=True)]
        joined = [p for p, alone in zip(pieces, bare, strict=True) if not alone]
        n = np.zeros(len(head), np.int64)
        flat = np.array(self.encoding.encode_ordinary(b"".join(joined).decode()), np.uint16)
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        stops = np.searchsorted(np.cumsum(self.length[flat]), ends) + 1
        n[~bare] = np.diff(np.r_[0, stops])
        solo = [np.array(self.encoding.encode_ordinary(pieces[i].decode()), np.uint16) for i in np.flatnonzero(bare)]
        n[bare] = list(map(len, solo))
        store = np.concatenate([flat, *solo])
        at = np.zeros(len(head), np.int64)
        at[~bare] = np.r_[0, stops][: len(stops)]
        at[bare] = len(flat) + np.cumsum(n[bare]) - n[bare]
        ends_of = [np.array(self.encoding.encode_ordinary(c.data[u:v].decode()), np.uint16) for u, v in zip(tail_from[tails].tolist(), tail_to[tails].tolist(), strict=True)]
        counts = n[code]
        ids = store[np.repeat(at[code], counts) + ragged(counts)]
        per_doc = np.add.reduceat(np.r_[counts, 0], first) * has if len(texts) else np.zeros(0, np.int64)
        if not len(tails):
            return ids, per_doc
        cuts = np.cumsum(per_doc)[tails]
        out = [x for pair in zip(np.split(ids, cuts), [*ends_of, ids[:0]], strict=True) for x in pair]
        per_doc[tails] += list(map(len, ends_of))
        return np.concatenate(out), per_doc


def encoded(df: DataFrame, doc_id: str, text: str, files: tuple[str, str, str] | None, end_id: int) -> DataFrame:
    """id, place (a hash of where the row lies) and tokens (uint16) of every document."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(*(files or byte_bpe())), 0
        lead = np.uint64(TaskContext.get().partitionId() << 40)
        for table in gathered(batches, "_text", BATCH_BYTES):
            flat, counts = encoder(utf8(table.column("_text")))
            ends = np.cumsum(counts)
            tokens = [np.append(flat[e - n : e], np.uint16(end_id)).tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            place = mix(lead + np.arange(seen, seen + len(tokens)).astype(np.uint64)).view(np.int64)
            seen += len(tokens)
            yield pa.RecordBatch.from_arrays([table.column("_id").combine_chunks(), pa.array(place), pa.array(tokens, pa.binary())], names=["id", "place", "tokens"])

    docs = df.select(F.coalesce(column(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), column(text).alias("_text"))
    return docs.mapInArrow(go, "id long, place long, tokens binary")


def byte_bpe() -> tuple[str, str, str]:
    """The files are looked for where the task runs."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN


def term_counts(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count, by document then term; and each document's length."""
    size = np.array([len(t) // 2 for t in tokens], np.int64)
    flat = np.frombuffer(b"".join(tokens), np.uint16).astype(np.int64)
    found, n = np.unique((np.repeat(np.arange(len(tokens)), size) << 16) | flat, return_counts=True)
    return found >> 16, found & 0xFFFF, n, size


def frequencies(held: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents of each term, documents and tokens of the whole table."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, size = np.zeros(VOCABULARY, np.int64), 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                _, term, _, lens = term_counts(b.column(0).slice(lo, 256).to_pylist())
                df += np.bincount(term, minlength=VOCABULARY)
                docs, size = docs + len(lens), size + int(lens.sum())
        term = np.r_[np.flatnonzero(df), -1, -2]
        yield pa.RecordBatch.from_pydict({"term": term, "n": np.r_[df[df > 0], docs, size]})

    found = dict(map(tuple, held.select("tokens").mapInArrow(go, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()))
    docs, size = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(VOCABULARY, np.int64)
    df[list(found)] = list(found.values())
    return df, docs, size


def bm25(term: np.ndarray, n: np.ndarray, size: np.ndarray, stats: dict) -> np.ndarray:
    """Weights of terms that lie n times in documents of a size."""
    df = stats["df"][term]
    idf = np.log(1 + (stats["docs"] - df + 0.5) / (df + 0.5))
    return (idf * n * (K1 + 1) / (n + K1 * (1 - B + B * size / stats["mean"]))).astype(np.float32)


def keyed(held: DataFrame, stats) -> DataFrame:
    """Adds the three terms that each document draws; terms that no other document has are drawn last."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = stats.value
        draws = [-np.log((mix(np.arange(VOCABULARY).astype(np.uint64) + np.uint64(salt << 20)).astype(float) + 1) / 2.0**64) for salt in (1, 2, 3)]
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                t = b.slice(lo, 256)
                doc, term, n, size = term_counts(t.column(2).to_pylist())
                weight = bm25(term, n, size[doc], s) * np.where(s["df"][term] > 1, 1.0, 1e-9)
                first = np.searchsorted(doc, np.arange(t.num_rows))
                keys = []
                for draw in draws:
                    cost = draw[term] / np.maximum(weight, 1e-30)
                    best = np.flatnonzero(cost == np.minimum.reduceat(cost, first)[doc])
                    keys.append(term[best[np.searchsorted(doc[best], np.arange(t.num_rows))]])
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *t.columns], names=[*KEYS, *t.schema.names])

    return held.mapInArrow(go, "k1 long, k2 long, k3 long, id long, place long, tokens binary")


class Index:
    """BM25 postings of a shard; terms in over a sixteenth of its documents have a row of weights instead."""

    def __init__(self, tokens: list[bytes], stats: dict):
        doc, term, n, size = term_counts(tokens)
        weight = bm25(term, n, size[doc], stats)
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(tokens))))
        common = np.flatnonzero(np.bincount(term, minlength=VOCABULARY) * 16 > len(tokens))
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(tokens)), np.float32)
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], doc[often]] = weight[often]
        doc, term, weight = doc[~often], term[~often], weight[~often]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.free = np.ones(len(tokens), bool)

    def neighbours(self, seed: int, most: int) -> list[int]:
        """Unused documents that share a term with the seed, best first; ties to the earlier."""
        terms = self.terms[seed]
        rows = self.row[terms]
        lo = self.at[terms]
        n = self.at[terms + 1] - lo
        at = np.repeat(lo, n) + ragged(n)
        score = (np.bincount(self.doc[at], self.weight[at], len(self.free)) + self.dense[rows[rows >= 0]].sum(axis=0)) * self.free
        hit = np.flatnonzero(score)
        if len(hit) > most:
            hit = hit[score[hit] >= np.partition(score[hit], len(hit) - most)[len(hit) - most]]
        return hit[np.lexsort((hit, -score[hit]))][:most].tolist()


def fill(tokens: list[bytes], window: int, stats: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    index, sequence, room = Index(tokens, stats), 0, window
    fresh, queue = 0, []
    seed = None
    while True:
        if not queue and seed is not None:
            queue = index.neighbours(seed, ASK)[::-1]
        doc = None
        while queue:
            d = queue.pop()
            if index.free[d]:
                doc = d
                break
        while doc is None and fresh < len(tokens):
            doc, fresh = (fresh if index.free[fresh] else None), fresh + 1
        if doc is None:
            return
        index.free[doc] = False
        if room == window:
            seed, queue = doc, []
        done, whole = 0, len(tokens[doc]) // 2
        while done < whole:
            n = min(room, whole - done)
            yield doc, done, n, sequence, window - room
            done, room = done + n, room - n
            if not room:  # the rest of the document is the next window's seed
                sequence, room, seed, queue = sequence + 1, window, doc, []
        if room == window:
            seed = None


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, files: tuple[str, str, str] | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of all documents; files: ranks, JSON file and split pattern of one byte-level BPE of under 2**16 ids."""
    held = written(encoded(df, doc_id, text, files, end_id))
    df_, docs, size = frequencies(held)
    stats = df.sparkSession.sparkContext.broadcast({"df": df_, "docs": docs, "mean": max(1.0, size / max(1, docs))})
    ranges = max(1, -(-2 * size // RANGE_BYTES))
    names = [f.split()[0] for f in PIECES.split(", ")]

    def shard(ids: list[int], tokens: list[bytes], number: int) -> pa.RecordBatch:
        wide = [np.frombuffer(t, np.uint16).astype("<u4") for t in tokens]
        base = TaskContext.get().partitionId() << 40 | number << 24
        rows = [(ids[d], s, n, zlib.crc32(wide[d][s : s + n].tobytes()), len(wide[d]), base + q, o) for d, s, n, q, o in fill(tokens, window, stats.value)]
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)], names=names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, bytes_, number = [], [], 0, 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = SHARD_DOCS if len(tokens) >= 2 * SHARD_DOCS else len(tokens) if bytes_ + len(t) > SHARD_BYTES else 0
                if n:
                    yield shard(ids[:n], tokens[:n], number)
                    ids, tokens, number = ids[n:], tokens[n:], number + 1
                    bytes_ = sum(map(len, tokens))
                ids.append(i)
                tokens.append(t)
                bytes_ += len(t)
        if tokens:
            yield shard(ids, tokens, number)

    order = [*KEYS, "place"]
    pieces = keyed(held, stats).repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "tokens").mapInArrow(go, PIECES)
    return pieces.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op3_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
