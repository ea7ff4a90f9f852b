"""Line dedup by a log-template tree.

A line is its words; words with a digit or one of ``@/\\=#_`` are variable fields
and read ``<*>``.  The tree has a fixed depth: a line descends by its count of
words, then by its leading word, to a leaf.  In a leaf, distinct lines are taken in
the order of a hash: each joins the group whose template agrees with it in most
places (at least ``SHARE`` of all, and ``CONSTANTS`` words that are no field; ties
to the older group) and turns the places that differ into ``<*>``, or opens a group.
A line thus belongs to its own template (itself) and perhaps to a general one.

A template in at least ``min_docs`` documents recurs: its lines are dropped from
all documents but for its first occurrence (smaller doc_id, then earlier line;
``keep_first=False`` drops that, too).  With ``long_words``, lines of more words
recur from two documents on, as their own template: clean documents don't share
them by chance.

A leaf of more than ``leaf_lines`` distinct lines (or ``LEAF_WORDS`` words) is looked at in
rounds: cut into parts of that size by a hash, each part is grouped, and the templates
found stand for their lines in the next round, cut by another hash, until one part holds
all or little joins any more.  What is still too much then is dealt by every two neighbouring
words (by every word, where ``share`` is a half or less): lines that agree in SHARE of all places
have two neighbours in common somewhere.  Where too many lines have the same two words, these
are cut into blocks, and every two blocks are looked at together, so each pair of lines meets
whatever their number; that work grows with the square of the lines of two such words.  The
templates found are dealt likewise, until no new ones turn up.  A line may so belong to several templates.

Scale: a task sends one row per distinct line of its batch.  Parts are streamed in
sorted order, one at a time.  Documents are counted exactly, by distinct (id, text),
in a second scan that looks at lines of candidate templates only; it finds them by a
filter of fixed size (2**24 bits; when it is full, more lines are sent) and an exact
join, salted, with one row per batch and line.  The result doesn't depend on how rows
lie in partitions.  Lines and templates are known by 128-bit hashes.

Defined results: lines are what line feeds separate; those without words are never
dropped, nor counted.  A null text stays null.  Rows that agree in id and text are
one document, each with a result row; a null doc_id counts as the smallest.
Columns named as a result column are replaced, others stay, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import Chunk, Powers, chunk_bounds, column, discard, gathered, mix, others, ragged, slot_filter, slots, spaces, utf8, written

VARIABLE = b"0123456789@/\\=#_"
NULL_ID = -(1 << 63)
BATCH_BYTES = 8 << 20
SHARE, CONSTANTS = 0.6, 3
LEAF_LINES, LEAF_WORDS = 2048, 1 << 22
#: Looks at a large leaf, as long as each leaves less of it by this share at least.
ROUNDS, SHRINK = 12, 1 / 16
NO_WORD = bytes(4)
SALTS = 16
OCCURRENCE = np.dtype([("id", "<i8"), ("key", "<i8"), ("no", "<i4")])
LINE, TEMPLATE = ["h1", "h2"], ["t1", "t2", "kind"]


def line_hashes(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line of 32-bit words, 0 for a field."""
    place = (np.arange(len(words)) - np.repeat(first, count)).astype(np.uint64)
    w = words.astype(np.uint64)
    out = []
    for salt in (0x51ED, 0xA2B7):
        each = mix(w + mix(place + np.uint64(salt)) + np.uint64(salt))
        out.append(mix(np.add.reduceat(each, first) + count.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64))
    return out[0], out[1]


def lines_in(texts: list[bytes], space: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Words of all lines with a word one after another; first word, count, document and number in the document of each line."""
    c = Chunk(texts, space, powers)
    if not len(c.start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint32), none, none, none, none
    marks = np.zeros(256, bool)
    marks[list(VARIABLE)] = True
    seen = np.r_[0, np.cumsum(marks[c.buf], dtype=np.int32)]
    word = np.where(seen[c.end] > seen[c.start], 0, np.maximum(c.hash >> np.uint64(32), np.uint64(1))).astype(np.uint32)
    feeds = np.flatnonzero(c.buf == 10)
    line = np.searchsorted(feeds, c.start)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    count = np.diff(np.r_[first, len(line)])
    doc = np.searchsorted(c.doc_start, c.start[first], "right") - 1
    return word, first, count, doc, line[first] - np.searchsorted(feeds, c.doc_start[doc])


def lines_of(df: DataFrame, doc_id: str, text: str, schema: str, each) -> DataFrame:
    """Runs ``each(words, first, count, h1, h2, row, ids, keys, no)`` on the lines of runs of documents."""
    space = spaces()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for table in gathered(batches, "_text", BATCH_BYTES):
            ids, keys, texts = table.column("_id").to_numpy(), table.column("_key").to_numpy(), utf8(table.column("_text"))
            parts, at = [], 0
            for lo, hi in chunk_bounds(texts, 1 << 20):
                words, first, count, doc, no = lines_in(texts[lo:hi], space, powers)
                parts.append((words, first + at, count, *line_hashes(words, first, count), doc + lo, no))
                at += len(words)
            words, first, count, h1, h2, row, no = (np.concatenate([p[i] for p in parts]) for i in range(7))
            if len(first):
                yield from each(words, first, count, h1.view(np.int64), h2.view(np.int64), row, ids, keys, no)

    return df.select(own_id(doc_id).alias("_id"), own_key(doc_id, text).alias("_key"), column(text).alias("_text")).mapInArrow(go, schema)


def own_id(doc_id: str) -> Column:
    return F.coalesce(column(doc_id).cast("long"), F.lit(NULL_ID))


def own_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(column(doc_id), column(text))


def starts_of(*columns: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(columns[0]) else np.zeros(0, np.int64)


def binaries(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """Runs of fixed-size values as one binary array."""
    data = values[np.repeat(first, count) + ragged(count)]
    offsets = np.r_[0, np.cumsum(count * values.itemsize)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def distinct_lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """h1, h2, n (words), words (binary) and docs (rows that hold it) of every distinct line."""

    def each(words, first, count, h1, h2, row, ids, keys, no):
        order = np.lexsort((row, h2, h1))
        h1, h2, row, first, count = h1[order], h2[order], row[order], first[order], count[order]
        at, once = starts_of(h1, h2), starts_of(h1, h2, row)
        docs = np.bincount(np.searchsorted(at, once, "right") - 1, minlength=len(at))
        for lo in range(0, len(at), 1 << 16):
            x = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(h1[x]), pa.array(h2[x]), pa.array(count[x].astype(np.int32)), binaries(words, first[x], count[x]), pa.array(docs[lo : lo + len(x)])], names=["h1", "h2", "n", "words", "docs"])

    rows = lines_of(df, doc_id, text, "h1 long, h2 long, n int, words binary, docs long", each)
    return rows.groupBy("h1", "h2", "n").agg(F.first("words").alias("words"), F.sum("docs").alias("docs"))


def generalised(words: np.ndarray, share: float, constants: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """(template, members) of the groups of two lines or more among lines (rows) of equal length, in the order given."""
    n = words.shape[1]
    need = max(constants, int(np.ceil(share * n - 1e-9)))
    if len(words) < 2 or n < need:
        return
    # A place whose word no other line has there agrees with none: lines with too many of those stay alone.
    order = np.argsort(words, axis=0, kind="stable")
    by_word = np.take_along_axis(words, order, axis=0)
    same = by_word[1:] == by_word[:-1]
    often = np.zeros(words.shape, bool)
    edge = np.zeros((1, n), bool)
    np.put_along_axis(often, order, np.r_[edge, same] | np.r_[same, edge], axis=0)
    may = np.flatnonzero((often & (words != 0)).sum(axis=1) >= need)
    groups, members = np.zeros((len(may), n), np.uint32), []
    for i in may.tolist():
        g = len(members)
        if g:
            equal = ((groups[:g] == words[i]) & (words[i] != 0)).sum(axis=1)
            best = int(np.argmax(equal))
            if equal[best] >= need:
                groups[best][groups[best] != words[i]] = 0
                members[best].append(i)
                continue
        groups[g] = words[i]
        members.append([i])
    for g, who in enumerate(members):
        if len(who) > 1:
            yield groups[g], who


def settled(parts: DataFrame, share: float, constants: int) -> DataFrame:
    """node, n, h1, h2, docs and the general template (t1, t2, template) of lines that share one in their part (node)."""

    def settle(t: pa.Table, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        h1, h2, docs, n = (t.column(c).to_numpy() for c in ("h1", "h2", "docs", "n"))
        texts, at, rows = t.column("words").to_pylist(), starts_of(node, n), []
        for u, v in zip(at.tolist(), [*at[1:].tolist(), len(n)], strict=True):
            if v - u > 1:
                words = np.frombuffer(b"".join(texts[u:v]), np.uint32).reshape(v - u, n[u])
                for template, who in generalised(words, share, constants):
                    t1, t2 = (x.view(np.int64)[0] for x in line_hashes(template, np.array([0]), np.array([len(template)])))
                    rows += [(node[u], n[u], h1[u + i], h2[u + i], docs[u + i], t1, t2, template.tobytes()) for i in who]
        if rows:
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "n", "h1", "h2", "docs", "t1", "t2", "template"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), b])
            node = t.column("node").to_numpy()
            start = int(starts_of(node)[-1])  # the last part may go on
            if start:
                yield from settle(t.slice(0, start), node[:start])
            rest = t.slice(start)
        if rest is not None:
            yield from settle(rest, rest.column("node").to_numpy())

    rows = parts.select("node", "n", "h1", "h2", "docs", "words").repartition("node").sortWithinPartitions("node", "n", "h1", "h2")
    return rows.mapInArrow(go, "node long, n int, h1 long, h2 long, docs long, t1 long, t2 long, template binary")


def cut_to_size(lines: DataFrame, leaf_lines: int, salt: int) -> DataFrame:
    """Parts of about leaf_lines lines (and LEAF_WORDS words) of each node, by a hash; ``leaf`` keeps the node."""
    size = lines.groupBy("node").agg(F.count("*").alias("_size"), F.first("n").alias("_n"))
    parts = F.greatest(F.ceil(F.col("_size") / leaf_lines), F.ceil(F.col("_size") * F.col("_n") / LEAF_WORDS))
    held = lines.join(size.select("node", parts.alias("_parts")), "node")
    return held.withColumn("leaf", F.col("node")).withColumn("node", F.when(F.col("_parts") > 1, F.xxhash64("node", F.pmod(F.xxhash64("h1", "h2", F.lit(salt)), "_parts"))).otherwise(F.col("node")))


def in_pairs(lines: DataFrame, leaf_lines: int) -> DataFrame:
    """Every two lines of a node together in some part of about leaf_lines lines (and LEAF_WORDS words): blocks of half the size, every two of them."""
    size = lines.groupBy("node").agg(F.count("*").alias("_size"), F.first("n").alias("_n"))
    blocks = F.greatest(F.ceil(F.col("_size") * 2 / leaf_lines), F.ceil(F.col("_size") * F.col("_n") * 2 / LEAF_WORDS))
    whole = (F.col("_size") <= leaf_lines) & (F.col("_size") * F.col("_n") <= LEAF_WORDS)
    held = lines.join(size.select("node", F.when(whole, 1).otherwise(F.least(blocks, "_size")).alias("_blocks")), "node")
    own = held.withColumn("_own", F.pmod(F.xxhash64("h1", "h2", F.lit(ROUNDS)), "_blocks"))
    # with two blocks or more, the part of a block with itself lies in its parts with others
    others = F.when(F.col("_blocks") == 1, F.array("_own")).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda x: x != F.col("_own")))
    tiles = own.withColumn("_other", F.explode(others))
    tile = F.xxhash64("node", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return tiles.withColumn("node", F.when(F.col("_blocks") > 1, tile).otherwise(F.col("node"))).drop("_blocks", "_own", "_other")


def memberships(lines: DataFrame, leaf_lines: int, share: float, constants: int) -> DataFrame:
    """h1, h2, docs and the general templates (t1, t2) of lines that share one."""
    held = lines.withColumn("node", F.xxhash64("n", F.substring("words", 1, 4)))
    size = held.groupBy("node").agg(F.count("*").alias("size"), F.first("n").alias("k"))
    large = written(size.filter((F.col("size") > leaf_lines) | (F.col("size") * F.col("k") > LEAF_WORDS)).select("node"))
    found = settled(held.join(large, "node", "left_anti"), share, constants).select(*LINE, "docs", "t1", "t2")
    if large.isEmpty():
        return found.distinct()
    rest = written(held.join(large, "node").select("node", "n", *LINE, "docs", "words"))
    # what stands for a line: itself, then the template that it joined, then the one that this joined
    stands = written(rest.select(*LINE, "docs", F.col("h1").alias("r1"), F.col("h2").alias("r2")))
    reps = rest.withColumn("docs", F.lit(0).cast("long"))
    n = reps.count()
    for salt in range(ROUNDS):
        joins = settled(cut_to_size(reps, leaf_lines, salt).drop("_parts"), share, constants)
        # a template goes on in the leaf that its lines lie in: their count of words and leading word, which all of them share
        joins = written(joins.select(*LINE, "n", "t1", "t2", "template").join(reps.select(*LINE, F.col("node").alias("leaf")), LINE))
        if joins.isEmpty():
            break
        new = joins.select(F.col("leaf").alias("node"), "n", F.col("t1").alias("h1"), F.col("t2").alias("h2"), F.lit(0).cast("long").alias("docs"), F.col("template").alias("words"))
        reps = written(reps.join(joins.select(*LINE), LINE, "left_anti").unionByName(new).distinct())
        step = salted(joins.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "t1", "t2"))
        stands = written(stands.withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int")).join(step, ["r1", "r2", "salt"], "left").select(*LINE, "docs", F.coalesce("t1", "r1").alias("r1"), F.coalesce("t2", "r2").alias("r2")))
        before, n = n, reps.count()
        if n > before * (1 - SHRINK):
            break
    joined = stands.filter((F.col("r1") != F.col("h1")) | (F.col("r2") != F.col("h2"))).select(*LINE, "docs", F.col("r1").alias("t1"), F.col("r2").alias("t2"))
    # what is still too many for one look: lines that agree in SHARE of all places agree in two neighbours somewhere (in one word at least, whatever the share)
    too_many = (F.col("size") > leaf_lines) | (F.col("size") * F.col("k") > LEAF_WORDS)
    still = written(reps.groupBy("node").agg(F.count("*").alias("size"), F.first("n").alias("k")).filter(too_many).select("node"))
    found = found.unionByName(joined)
    if still.isEmpty():
        return found.distinct()
    near = 2 if share > 0.5 else 1
    places = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / near).cast("int"))
    words = F.substring("words", F.col("place") * 4 * near + 1, F.lit(4 * near))
    whole = (F.substring(words, 1, 4) != NO_WORD) & (F.substring(words, -4, 4) != NO_WORD)
    now = known = reps.join(still, "node", "left_semi")
    while True:
        dealt = now.withColumn("place", F.explode(places)).filter(whole).withColumn("node", F.xxhash64("node", "place", words)).drop("place")
        joins = written(settled(in_pairs(dealt, leaf_lines), share, constants).select(*LINE, "n", "t1", "t2", "template").distinct())
        step = salted(joins.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "t1", "t2").distinct())
        late = written(stands.withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int")).join(step, ["r1", "r2", "salt"]).select(*LINE, "docs", F.col("t1").alias("r1"), F.col("t2").alias("r2")).distinct())
        found = found.unionByName(late.select(*LINE, "docs", F.col("r1").alias("t1"), F.col("r2").alias("t2")))
        # a new template has fewer words that are no field than each of its lines, so this ends; the leading word stays
        new = joins.select(F.xxhash64("n", F.substring("template", 1, 4)).alias("node"), "n", F.col("t1").alias("h1"), F.col("t2").alias("h2"), F.lit(0).cast("long").alias("docs"), F.col("template").alias("words"))
        now = written(new.dropDuplicates(LINE).join(known.select(*LINE), LINE, "left_anti"))
        if now.isEmpty():
            return found.distinct()
        known, stands = known.unionByName(now), late.join(now.select(F.col("h1").alias("r1"), F.col("h2").alias("r2")), ["r1", "r2"], "left_semi").select(*LINE, "docs", "r1", "r2")


def candidates(lines: DataFrame, min_docs: int, long_words: int | None, leaf_lines: int, share: float, constants: int) -> DataFrame:
    """h1, h2 and template (t1, t2, kind; kind 1 for long lines of their own) where enough rows hold the template's lines."""
    long = F.lit(False) if long_words is None else F.col("n") > long_words
    single = lines.withColumn("kind", F.when(long, 1).otherwise(0)).filter(F.col("docs") >= F.when(F.col("kind") == 1, 2).otherwise(min_docs))
    # A line is of its own template as well as of a general one that may read the same.
    general = written(memberships(lines, leaf_lines, share, constants).withColumn("kind", F.lit(0)))
    enough = general.groupBy(*TEMPLATE).agg(F.sum("docs").alias("rows")).filter(F.col("rows") >= min_docs).select(*TEMPLATE)
    return single.select(*LINE, F.col("h1").alias("t1"), F.col("h2").alias("t2"), "kind").unionByName(general.join(enough, TEMPLATE, "left_semi").select(*LINE, *TEMPLATE)).distinct()


def occurrences(df: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Template, _id, _key and no of every line of a candidate template, once."""
    shared = df.sparkSession.sparkContext.broadcast(slot_filter(found, "h1"))

    def each(words, first, count, h1, h2, row, ids, keys, no):
        may = np.flatnonzero(slots(shared.value, h1))
        may = may[np.lexsort((no[may], row[may], h2[may], h1[may]))]
        if len(may):
            at = starts_of(h1[may], h2[may])
            held = np.zeros(len(may), OCCURRENCE)
            held["id"], held["key"], held["no"] = ids[row[may]], keys[row[may]], no[may]
            salt = np.full(len(at), (int(ids[0]) ^ int(keys[0])) % SALTS, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h1[may][at]), pa.array(h2[may][at]), pa.array(salt), binaries(held, at, np.diff(np.r_[at, len(may)]))], names=["h1", "h2", "salt", "held"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(x, OCCURRENCE) for x in b.column(3).to_pylist()]
            n = list(map(len, held))
            o = np.concatenate(held) if held else np.zeros(0, OCCURRENCE)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(b.column(i).to_numpy(), n)) for i in range(3)), *(pa.array(np.ascontiguousarray(o[c])) for c in ("id", "key", "no"))], names=[*TEMPLATE, "_id", "_key", "no"])

    lines = lines_of(df, doc_id, text, "h1 long, h2 long, salt int, held binary", each)
    joined = lines.join(salted(found), [*LINE, "salt"]).select(*TEMPLATE, "held")
    return joined.mapInArrow(unpack, "t1 long, t2 long, kind int, _id long, _key long, no int").distinct()


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def dropped(df: DataFrame, doc_id: str, text: str, min_docs: int, keep_first: bool, long_words: int | None, leaf_lines: int, share: float, constants: int) -> DataFrame:
    """_id, _key and the numbers of lines to drop (_gone)."""
    lines = written(distinct_lines(df, doc_id, text))
    found = written(candidates(lines, min_docs, long_words, leaf_lines, share, constants))
    discard(lines)
    seen = written(occurrences(df, found, doc_id, text))
    by_doc = seen.groupBy(*TEMPLATE, "_id", "_key").agg(F.min("no").alias("no"))
    counted = by_doc.groupBy(*TEMPLATE).agg(F.count("*").alias("docs"), F.min(F.struct("_id", "_key", "no")).alias("first"))
    recurring = counted.filter(F.col("docs") >= F.when(F.col("kind") == 1, 2).otherwise(min_docs)).drop("docs")
    gone = seen.withColumn("salt", F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int")).join(salted(recurring), [*TEMPLATE, "salt"])
    if keep_first:
        gone = gone.filter((F.col("_id") != F.col("first._id")) | (F.col("_key") != F.col("first._key")) | (F.col("no") != F.col("first.no")))
    return gone.groupBy("_id", "_key").agg(F.collect_set("no").alias("_gone"))


def drop_templates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    keep_first: bool = True,
    long_words: int | None = 50,
    leaf_lines: int = LEAF_LINES,
    share: float = SHARE,
    constants: int = CONSTANTS,
) -> DataFrame:
    """Replaces ``text`` by its kept lines and adds n_lines and n_dropped."""
    kept = others(df, "n_lines", "n_dropped")
    gone = dropped(df, doc_id, text, min_docs, keep_first, long_words, leaf_lines, share, constants)
    docs = df.select(F.struct(*map(column, kept)).alias("_row"), own_id(doc_id).alias("_id"), own_key(doc_id, text).alias("_key"))
    joined = docs.join(gone, ["_id", "_key"], "left").select("_row", "_gone")
    place = kept.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.column(0).flatten()
            texts, n_lines, n_gone = cols[place].to_pylist(), [], []
            for i, gone in enumerate(b.column(1).to_pylist()):
                n_lines.append(texts[i].count("\n") + 1 if texts[i] is not None else 0)
                n_gone.append(len(gone or ()))
                if gone:
                    drop = set(gone)
                    texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in drop)
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=[*kept, "n_lines", "n_dropped"])

    return joined.mapInArrow(clean, T.StructType([*df.select(*map(column, kept)).schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def op9_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_templates(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
