"""Benchmark decontamination by spaced seeds.

Words are lower-cased runs of bytes other than white space and ASCII punctuation.
Each mask picks some of a few successive words and ignores the others, so a seed
survives substituted words.  Seeds of documents and benchmark items are joined by
hash; around a hit the item is laid on the document at that offset, and the best
stretch (a point for an equal word, two off for another) is the overlap.  It counts
when at least ``least`` words are equal (or the whole item, if shorter) and they
make up at least ``share`` of the stretch.  Every place of a seed in the document is
laid against every place in the item, once for each offset between the two.

The benchmark is a stated query set: it goes to the tasks in blocks of about
``BLOCK_WORDS`` words (as counted above), one scan of the documents for each, so what
is broadcast has a bound whatever its size; items of more than ``SEGMENT`` words are
cut into segments with ``LAP`` words in common, each sought by itself.  Documents
stay where they lie, and each is judged by its own text alone, whatever its id.

Defined results: null or empty texts and items have no words and no overlap; items
of fewer than ``SHORTEST`` words are ignored, those shorter than a mask are sought
whole.  A document and an item (or segment) have one row, that of most equal words;
of equals, the earlier in the document, then in the item.  Repeated rows are
repeated in the result; a null id stays null.  An empty table on either side gives
an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import Chunk, Powers, chunk_bounds, column, gathered, mix, ragged, spaces, utf8

MASKS = ("111111", "1110111", "11011011", "1010110011")
SHORTEST = 5
BLOCK_WORDS, SEGMENT, LAP = 1 << 20, 1 << 16, 1 << 10
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FOLD = bytes(32 if chr(i) in MARKS else i for i in bytes(range(256)).lower())
FILTER_BITS = 22
OVERLAPS = "doc_id long, item_id long, doc_start long, item_start long, length long, matched long"


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the picked words from each position."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.full(n, sum(1 << i for i, m in enumerate(mask) if m == "1"), np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            out = mix(out + words[i : i + n])
    return out


def block(ids: list, starts: list, texts: list[bytes]) -> dict:
    """Words of some items, and their seeds, sorted, for each mask that some item can hold.  Arrays only: tasks need no class of this module."""
    c = Chunk(texts, spaces(), Powers(), FOLD)
    words = [c.hash[u:v] for u, v in zip(c.bound[:-1], c.bound[1:], strict=True)]
    shortest = min(map(len, MASKS))
    tables = {}
    for mask in [*MASKS, *("1" * n for n in range(SHORTEST, shortest))]:
        whole = len(mask) < shortest
        held = [i for i, w in enumerate(words) if (len(w) == len(mask) if whole else len(w) >= len(mask))]
        if held:
            found = [seeds(words[i], mask) for i in held]
            h = np.concatenate(found)
            item, at = np.repeat(held, list(map(len, found))), np.concatenate([np.arange(len(x)) for x in found])
            order = np.argsort(h)
            may = np.zeros(1 << FILTER_BITS, bool)
            may[h >> np.uint64(64 - FILTER_BITS)] = True
            tables[mask] = h[order], item[order], at[order], may
    return {"ids": ids, "starts": starts, "words": words, "tables": tables}


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the largest sum of 1 for equal, -2 for not."""
    total = np.r_[0, np.cumsum(np.where(equal, 1, -2))]
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmin(total[: end + 1])), end


def overlaps_in(c: Chunk, held: dict, least: int, share: float) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, document's word, item's word, length, matched) of one chunk, the best of each document and item."""
    doc = c.doc_of_word()
    laid = []
    for mask, (table, item, at, may) in held["tables"].items():
        h = seeds(c.hash, mask)
        hit = np.flatnonzero(may[h >> np.uint64(64 - FILTER_BITS)])
        hit = hit[doc[hit] == doc[hit + len(mask) - 1]]
        lo, hi = np.searchsorted(table, h[hit], "left"), np.searchsorted(table, h[hit], "right")
        hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        rows = np.repeat(lo, n) + ragged(n)
        laid.append(np.stack([np.repeat(doc[hit], n), item[rows], np.repeat(hit, n) - at[rows]], axis=1))
    best: dict = {}
    for d, it, offset in np.unique(np.concatenate(laid), axis=0).tolist() if laid else []:
        words = held["words"][it]
        a, b = max(offset, int(c.bound[d])), min(offset + len(words), int(c.bound[d + 1]))
        equal = c.hash[a:b] == words[a - offset : b - offset]
        s, e = best_stretch(equal)
        matched = int(equal[s:e].sum())
        if matched >= min(least, len(words)) and matched >= share * (e - s):
            row = (-matched, a + s - int(c.bound[d]), a - offset + s, e - s)
            best[d, it] = min(row, best.get((d, it), row))
    return [(d, it, start, held["starts"][it] + at, length, -matched) for (d, it), (matched, start, at, length) in sorted(best.items())]


def item_words(text: Column) -> Column:
    """Words as in a Chunk, but for letters beyond A-Z, which are left as they are in both."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARKS + "\t\n\x0b\x0c\r", " " * (len(MARKS) + 5))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator:
    """Broadcast blocks of the benchmark's segments."""
    spark = benchmark.sparkSession
    words = benchmark.select(column(item_id).cast("long").alias("i"), item_words(column(item_text)).alias("w")).filter(F.size("w") >= SHORTEST)
    step = SEGMENT - LAP
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("w") - LAP, F.lit(1)) - 1) / step)), lambda k: (k * step).cast("int"))
    items = words.withColumn("s", F.explode(starts)).select("i", "s", F.array_join(F.slice("w", F.col("s") + 1, F.lit(SEGMENT)), " ").alias("t"), F.least(F.size("w") - F.col("s"), F.lit(SEGMENT)).alias("n"))
    n = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("i", "s", "t"), F.lit(n)) == k).select("i", "s", "t").toArrow()
        yield spark.sparkContext.broadcast(block(part.column("i").to_pylist(), part.column("s").to_pylist(), utf8(part.column("t"))))


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 10, share: float = 0.75) -> DataFrame:
    """The best verified overlap of each document with each item."""
    names = [f.split()[0] for f in OVERLAPS.split(", ")]

    def scan(held) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, powers, space = held.value, Powers(), spaces()
            for table in gathered(batches, "_text", 4 << 20):
                ids, texts = table.column("_id").combine_chunks(), utf8(table.column("_text"))
                for lo, hi in chunk_bounds(texts, 1 << 20):
                    found = overlaps_in(Chunk(texts[lo:hi], space, powers, FOLD), items, least, share)
                    if found:
                        cols = list(zip(*found, strict=True))
                        arrays = [ids.take(pa.array(np.array(cols[0]) + lo)), pa.array([items["ids"][i] for i in cols[1]], pa.int64()), *(pa.array(x, pa.int64()) for x in cols[2:])]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

        return docs.select(column(doc_id).cast("long").alias("_id"), column(text).alias("_text")).mapInArrow(go, OVERLAPS)

    return reduce(DataFrame.unionByName, map(scan, blocks_of(benchmark, item_id, item_text)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 10, share: float = 0.75) -> DataFrame:
    """The documents without an overlap; all columns stay.  Each row is kept or dropped where it lies, by its text."""
    at = docs.columns.index(text)

    def clean(df: DataFrame, held) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, powers, space = held.value, Powers(), spaces()
            for b in batches:
                texts, bad = utf8(b.column(at)), np.zeros(b.num_rows, bool)
                for lo, hi in chunk_bounds(texts, 1 << 20):
                    for d, *_ in overlaps_in(Chunk(texts[lo:hi], space, powers, FOLD), items, least, share):
                        bad[lo + d] = True
                yield b.filter(pa.array(~bad))

        return df.mapInArrow(go, docs.schema)

    return reduce(clean, blocks_of(benchmark, item_id, item_text), docs)


def op10_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
