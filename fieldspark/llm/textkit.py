"""Vectorised word hashing over batches of texts, and shared-folder helpers.

A *chunk* is a run of documents joined into one byte buffer, with a line feed
before, between and after them.  Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, which is what ``[^\\x20\\x09-\\x0D]+`` matches in UTF-8.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
ASCII_LOWER = bytes(range(256)).lower()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Words of some documents: where they start and end, and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes], space: np.ndarray, powers: Powers, translate: bytes | None = None):
        data = b"\n" + b"\n".join(texts) + b"\n"
        if translate:
            data = data.translate(translate)
        self.data = data
        self.buf = buf = np.frombuffer(data, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[1], 1 + np.cumsum(lens + 1)])
        gap = space[buf]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        #: Words bound[i]:bound[i + 1] are those of document i.
        self.bound = np.searchsorted(self.start, self.doc_start)
        up, down = powers.upto(len(buf))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(BASE))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64))])
        return self.up[:n], self.down[:n]


def spaces(also: bytes = b"") -> np.ndarray:
    """A table that marks the six white-space bytes, and those of ``also``."""
    table = np.zeros(256, bool)
    table[list(b" \t\n\x0b\x0c\r" + also)] = True
    return table


def chunk_bounds(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``limit`` bytes; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Cuts and joins successive batches to about ``limit`` bytes of text each."""
    held, size = [], 0
    for b in batches:
        lens = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        lo = 0
        for i, n in enumerate(lens.tolist()):
            size += n
            if size >= limit:
                yield pa.Table.from_batches([*held, b.slice(lo, i + 1 - lo)])
                held, size, lo = [], 0, i + 1
        if lo < b.num_rows:
            held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def utf8(column: pa.ChunkedArray) -> list[bytes]:
    """Texts as bytes; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def ragged(lens: np.ndarray) -> np.ndarray:
    """0..len-1 for each length, joined."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *results: str) -> list[str]:
    """The columns that no result column replaces; names differ without regard to case, as Spark's do."""
    return [c for c in df.columns if c.lower() not in results]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one is set only where none is and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


#: Tables written by this process, until remove_tables().
WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no plan reads any more."""
    for table in tables:
        remove(table.sparkSession, table.written_to)


def remove(spark: SparkSession, path: str) -> None:
    WRITTEN.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_tables(spark: SparkSession) -> int:
    """Deletes the tables that written() left; call it when results that read them are stored."""
    held = list(WRITTEN)
    for path in held:
        remove(spark, path)
    return len(held)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def with_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text", to: str = "_key") -> DataFrame:
    """Adds a never-null key of (id, text): rows that repeat both share it."""
    return df.withColumn(to, F.xxhash64(F.col(doc_id), F.col(text)))


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text modulo a divisor; a null id counts as an empty text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % divisor


#: Bits of a filter of hashes; its size is fixed, so a fuller one only lets more pass.
FILTER_BITS = 24


def slot_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a long column, by its remainder, in 64-bit words."""
    slot = df.selectExpr(f"pmod(`{column}`, {1 << FILTER_BITS}) AS slot")
    found = slot.selectExpr("CAST(slot DIV 64 AS INT) AS w", "shiftleft(1L, CAST(slot % 64 AS INT)) AS v").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return bits


def slots(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the filter."""
    at = values % (1 << FILTER_BITS)
    return bits[at >> 6] >> (at & 63) & 1 == 1
