"""Ranked lexical search over classes of equal bags.

Terms are maximal runs of bytes other than ASCII non-alphanumerics, with A-Z lower-cased.
One scan reduces each document to what a score can depend on: its bag, the counts of the
items' terms in it, and its length.  With the totals of the table the length becomes m, and
documents of equal (bag, m) form a class: they are brought together by a hash and told apart
by the bag itself.  A class is scored once, whatever the number of its members; of these
only the k smallest ids can matter, so Spark keeps k a class before the shuffle already.
Each task keeps k classes an item, by score and least id; their members, expanded, make
the k first documents.

The items are a stated query set: they go to the tasks in blocks of about ``BLOCK_BYTES`` of
their text, so that what is broadcast has a bound; each block is a scan.  Scores are whole
numbers of 64 bits.

Defined results: null or empty texts have no terms, count for nothing and are never found.
Documents of one id are documents by themselves, so are repeated rows; of equal scores
null ids come last.  An item counts once however often it is repeated; of different texts of
one item id the least is asked.  Items without terms have no rows, nor have those whose
terms no document has.  Documents of score 0 (terms that nearly all documents hold have
no weight) are left out.  Other columns aren't looked at; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import ASCII_LOWER, Chunk, Powers, chunk_bounds, column, gathered, ragged, spaces, utf8, written

NOT_TERMS = bytes(b for b in range(128) if not chr(b).isalnum())
BLOCK_BYTES = 4 << 20
BATCH_BYTES, CHUNK_BYTES = 4 << 20, 1 << 20
#: Entries of an item matrix handled at a time.
TILE = 1 << 22
BAG = np.dtype([("term", "<u4"), ("tf", "<u4")])
ID_LAST = (1 << 63) - 1


class Vocabulary:
    """Terms by number, found by hash and checked byte by byte."""

    def __init__(self, terms: list[bytes]):
        c = Chunk(terms, spaces(NOT_TERMS), Powers(), ASCII_LOWER)
        order = np.argsort(c.hash, kind="stable")
        self.hash, self.number = c.hash[order], order
        self.terms, self.of = terms, {t: i for i, t in enumerate(terms)}
        self.data = np.frombuffer(b"".join(terms) + bytes(8), np.uint8)
        self.size = np.fromiter(map(len, terms), np.int64, len(terms))
        self.start = np.cumsum(self.size) - self.size

    def numbers(self, c: Chunk) -> np.ndarray:
        """The number of each word of a chunk, -1 for words of no item."""
        at = np.minimum(np.searchsorted(self.hash, c.hash), max(0, len(self.hash) - 1))
        found = np.full(len(c.hash), -1)
        hit = np.flatnonzero(self.hash[at] == c.hash) if len(self.hash) else np.zeros(0, np.int64)
        number, size = self.number[at[hit]], (c.end - c.start)[hit]
        same = self.size[number] == size
        for k in range(int(size[same].max(initial=0))):  # letter by letter, for all words at once
            at_k = np.flatnonzero(same & (size > k))
            same[at_k] = c.buf[c.start[hit[at_k]] + k] == self.data[self.start[number[at_k]] + k]
        found[hit[same]] = number[same]
        for i in hit[~same].tolist():  # hashes that meet by chance
            found[i] = self.of.get(c.data[c.start[i] : c.end[i]], -1)
        return found


def bags(docs: DataFrame, held) -> DataFrame:
    """id, n (terms) and bag (numbers and counts of items' terms, by number) of every document with a term."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, powers, space = Vocabulary(held.value["terms"]), Powers(), spaces(NOT_TERMS)
        for t in gathered(batches, "text", BATCH_BYTES):
            ids, texts = t.column("id").combine_chunks(), utf8(t.column("text"))
            for lo, hi in chunk_bounds(texts, CHUNK_BYTES):
                c = Chunk(texts[lo:hi], space, powers, ASCII_LOWER)
                number = vocabulary.numbers(c)
                hit = np.flatnonzero(number >= 0)
                key, tf = np.unique(c.doc_of_word()[hit] << 32 | number[hit], return_counts=True)
                bag = np.empty(len(key), BAG)
                bag["term"], bag["tf"] = key & 0xFFFFFFFF, tf
                raw, cuts = bag.tobytes(), (np.searchsorted(key >> 32, np.arange(hi - lo + 1)) * BAG.itemsize).tolist()
                n = np.diff(c.bound)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some]), pa.array([raw[cuts[i] : cuts[i + 1]] for i in some.tolist()], pa.binary())], names=["id", "n", "bag"])

    return docs.mapInArrow(go, "id long, n long, bag binary")


def totals(held: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all of them, and documents that hold each term of the items."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, size = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            n = b.column(0).to_numpy()
            docs, size = docs + len(n), size + int(n.sum())
            df += np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), BAG)["term"], minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.r_[some, -1, -2], "n": np.r_[df[some], docs, size]})

    found = dict(map(tuple, held.select("n", "bag").mapInArrow(go, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()))
    docs, size = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(terms, np.int64)
    df[list(found)] = list(found.values())
    return docs, size, df


def blocks_of(items: DataFrame, item_id: str, item_text: str) -> Iterator[dict]:
    """The items in blocks: their ids, their distinct terms, and (term, item, times) by term.  No classes of this module, which tasks couldn't load."""
    asked = items.groupBy(column(item_id).cast("long").alias("id")).agg(F.min(column(item_text).cast("string")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = asked.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).toArrow()
        c = Chunk(utf8(part.column("text")), spaces(NOT_TERMS), Powers(), ASCII_LOWER)
        words: dict[bytes, int] = {}
        term = np.fromiter((words.setdefault(c.data[u:v], len(words)) for u, v in zip(c.start.tolist(), c.end.tolist(), strict=True)), np.int64, len(c.start))
        key, times = np.unique(term << 32 | c.doc_of_word(), return_counts=True)
        if len(key):
            yield {"ids": part.column("id").to_pylist(), "terms": list(words), "term": key >> 32, "item": key & 0xFFFFFFFF, "times": times}


def best_classes(classes: DataFrame, held, k: int) -> DataFrame:
    """From each task, the k best classes of every item: item (its number), score, ids."""

    def tile(bag: list[bytes], m: np.ndarray, first: np.ndarray, block: dict, at: np.ndarray) -> Iterator[tuple[int, list, list]]:
        entries = np.frombuffer(b"".join(bag), BAG)
        row = np.repeat(np.arange(len(bag)), np.fromiter(map(len, bag), np.int64, len(bag)) // BAG.itemsize)
        term, tf = entries["term"].astype(np.int64), entries["tf"].astype(np.int64)
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
        n = at[term + 1] - at[term]
        posting = np.repeat(at[term], n) + ragged(n)
        score = np.zeros((len(block["ids"]), len(bag)), np.int64)
        np.add.at(score, (block["item"][posting], np.repeat(row, n)), block["weight"][posting] * np.repeat(part, n))
        for item, own in enumerate(score):
            some = np.flatnonzero(own > (0 if len(own) <= k else max(0, np.partition(own, len(own) - k)[len(own) - k] - 1)))
            found = some[np.lexsort((first[some], -own[some]))][:k]
            yield item, found.tolist(), own[found].tolist()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        at = np.searchsorted(block["term"], np.arange(len(block["terms"]) + 1))
        rows = max(1, TILE // len(block["ids"]))
        best: dict[int, list] = {}
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                t = b.slice(lo, rows)
                ids = t.column(2).to_pylist()
                first = np.array([ID_LAST if i[0]["id"] is None else i[0]["id"] for i in ids], np.int64)
                for item, found, scores in tile(t.column(1).to_pylist(), t.column(0).to_numpy(), first, block, at):
                    new = [(-s, int(first[i]), ids[i]) for i, s in zip(found, scores, strict=True)]
                    best[item] = sorted(best.get(item, []) + new, key=lambda x: x[:2])[:k]
        out = [(item, -s, ids) for item, found in best.items() for s, _, ids in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.struct([("none", pa.bool_()), ("id", pa.int64())]))), strict=True)], names=["item", "score", "ids"])

    return classes.mapInArrow(go, "item long, score long, ids array<struct<none: boolean, id: bigint>>")


def search_block(docs: DataFrame, block: dict, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    held = written(bags(docs, context.broadcast(block)))
    n_docs, size, df = totals(held, len(block["terms"]))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    scored = context.broadcast(block | {"weight": weight[block["term"]] * block["times"]})
    long_m = F.expr(f"25 + (75 * n * {n_docs}BD) div {max(1, size)}BD").cast("long").alias("m")  # in decimals: no overflow
    bagged = held.filter(F.octet_length("bag") > 0).select(long_m, "bag", F.struct(F.col("id").isNull().alias("none"), "id").alias("id")).withColumn("h", F.xxhash64("m", "bag"))
    alike = ["h", "m", "bag"]
    members = bagged.withColumn("_r", F.row_number().over(Window.partitionBy(*alike).orderBy("id"))).filter(F.col("_r") <= k)
    classes = members.groupBy(*alike).agg(F.sort_array(F.collect_list("id")).alias("ids")).select("m", "bag", "ids")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    best = best_classes(classes, scored, k).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    expanded = best.select("item", "score", F.explode("ids").alias("id"))
    ranked = expanded.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(list(enumerate(block["ids"])), "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id.id").alias("doc_id"), "score")  # a block's ids


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """The k documents of highest score for each item: item_id, rank, doc_id, score."""
    plain = docs.select(column(doc_id).cast("long").alias("id"), column(text).cast("string").alias("text"))
    found = [search_block(plain, block, k) for block in blocks_of(items, item_id, item_text)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
i AS (SELECT item_id, min(text) AS text FROM benchmark WHERE text IS NOT NULL GROUP BY item_id),
q AS (SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i)
  GROUP BY item_id, term),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * t.docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, t GROUP BY term, t.docs),
s AS (
  SELECT q.item_id, p.doc_id, p.r, CAST(sum(q.times * f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM p JOIN q USING (term) JOIN f USING (term), t GROUP BY q.item_id, p.doc_id, p.r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
