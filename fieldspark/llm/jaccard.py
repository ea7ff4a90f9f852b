"""Near-duplicate classes of documents: an exact n-gram Jaccard join by PartEnum.

A document's set holds the 64-bit hashes of its distinct word shingles.  Equal
sets collapse into one node first; a node's id has 64 bits, and where two sets
share one, a second hash of 64 bits tells them apart.  Two sets of similarity p/q or more lie in one
band of sizes (around each border from p/q to q/p of it) and differ in at most
k = (q - p)/(q + p) * (|A| + |B|) elements.  PartEnum divides the feature domain by
hash into n1 groups of n2 partitions: with at most k differing elements some group
differs in at most k2 = k // n1, so some choice of n2 - k2 of its partitions is equal
in both sets, and they share that signature.

Signatures of few elements say little and may be shared by very many sets (an empty
partition, one frequent shingle), and so do those whose other elements are all
frequent shingles (in about a thousandth of all documents; such a list of at most
``MOST_FREQUENT`` is found first, and any list would do).  Each band therefore has
``slack`` groups more than the bound needs, and at least slack + 1 groups must agree.
A set leaves out the signatures of at most t telling elements, for the largest t at
which they lie in at most slack groups.  What a pair shares is equal in both, so the
set with the larger t leaves out at most slack of their groups and the other one no
others: no pair is lost.

Sets that share a signature are not paired with each other.  First all are tied
to one hub (the least node) per signature, each node is compared with the hub it
shares most with, each hub with such a node, and links give components.  Then, for signatures whose sets lie
in different components, neighbours in a random order are compared, each node
with its nearest by parity sketch.  What still differs is settled exactly: blocks
of a signature's sets are compared by size and sketch (a distance of sketches never
exceeds that of the sets), and only pairs of different components that these can't
rule out are looked up.  Pairs inside a component can't change the result.

Defined results: texts that are null or have no words have an empty set and form
a class of their own; shorter texts than a shingle are one shingle.  Repeated
rows and equal sets share a class.  A null doc_id is never a class id unless
all its class has null ids.  Each row has a result row; other columns are not
looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, looked_up
from .textkit import ASCII_LOWER, BASE, Chunk, Powers, chunk_bounds, column, discard, gathered, mix, slot_filter, slots, spaces, text_bytes, utf8, written

BATCH_BYTES = 4 << 20
NULL_ID = -(1 << 63)
SKETCH = 512
MOST_FREQUENT = 1 << 16
LEVELS = 4
#: Rows of a block when a signature's sets are compared, and rounds of neighbours before.
BLOCK, ROUNDS = 1024, 2


class Scheme:
    """Bands, bounds and partitions for the similarity p / q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        tops = [1]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, tops[-1] * q // p))
        self.tops = np.array(tops)

    def differing(self, total: np.ndarray) -> np.ndarray:
        return (self.q - self.p) * total // (self.q + self.p)

    def tags(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sets (by position) with the number and bound of each band they lie in: the sizes from p/q of a border to q/p of it."""
        own = np.searchsorted(self.tops, sizes)
        for border in (own - 2, own - 1, own, own + 1):
            top = self.tops[np.maximum(border, 0)]
            most = self.q * top // self.p
            at = np.flatnonzero((border >= 0) & (sizes <= most) & (sizes * self.q >= self.p * top))
            yield at, border[at], self.differing(top + most)[at]


def kinds(k: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]:
    """Positions, n2, k2, n1 and slack for bounds k; none where only equal sets fit."""
    for small in range(1, 7):
        at = np.flatnonzero(k == small)
        yield at, small + 3, small, np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
    at = np.flatnonzero(k >= 7)
    slack = 3 + k[at] // 8
    yield at, 1, 0, k[at] + 1 + slack, slack


def among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def signatures(elements: np.ndarray, sizes: np.ndarray, scheme: Scheme, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of some sets (their elements one after another), and the set of each."""
    starts = np.cumsum(sizes) - sizes
    found, owners = [], []
    spread, weight = mix(elements + np.uint64(0x1234567)), mix(elements + np.uint64(0x89ABCDE))
    telling = ~among(frequent, elements)
    for sets, tag, k in scheme.tags(sizes):
        for at, n2, k2, n1, slack in kinds(k):
            if not len(at):
                continue
            who = sets[at]
            n = sizes[who]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            el = np.repeat(starts[who], n) + within
            first = np.cumsum(n1) - n1
            salted = mix(spread[el] + np.repeat(tag[at].astype(np.uint64) * np.uint64(BASE), n))
            cell = np.repeat(first * n2, n) + (salted % np.repeat((n1 * n2).astype(np.uint64), n)).astype(np.int64)
            total = np.zeros(int(n1.sum()) * n2, np.uint64)
            np.add.at(total, cell, weight[el])
            count = np.bincount(cell[telling[el]], minlength=len(total)).reshape(-1, n2)
            total = total.reshape(-1, n2)
            subsets = np.array(list(combinations(range(n2), n2 - k2)))
            content, held = total[:, subsets].sum(axis=2, dtype=np.uint64), count[:, subsets].sum(axis=2)
            group = np.arange(len(total)) - np.repeat(first, n1)
            name = mix(np.repeat(tag[at], n1).astype(np.uint64) * np.uint64(BASE) + group.astype(np.uint64))
            sig = mix(content + mix(name[:, None] + np.arange(len(subsets), dtype=np.uint64)))
            # The highest level whose signatures of at most so many telling elements lie in ``slack`` groups at most.
            least, level = held.min(axis=1), np.full(len(who), -1)
            for t in range(LEVELS):
                level[np.add.reduceat(least <= t, first, dtype=np.int64) <= slack] = t
            g, s = np.nonzero(held > np.repeat(level, n1)[:, None])
            found.append(sig[g, s])
            owners.append(np.repeat(who, n1)[g])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def sketches(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parities of the elements in each of SKETCH hash classes, packed to bytes."""
    cell = np.repeat(np.arange(len(sizes)), sizes) * SKETCH + (mix(elements + np.uint64(77)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=len(sizes) * SKETCH).reshape(-1, SKETCH) & 1, axis=1) if len(sizes) else np.zeros((0, SKETCH // 8), np.uint8)


def sets_of(texts: list[bytes], words: int, space: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text joined, set sizes, and two hashes of each set."""
    c = Chunk(texts, space, powers, ASCII_LOWER)
    h, hashes = c.hash, np.zeros(len(c.hash), np.uint64)
    for j in range(words):
        hashes[: len(h) - j] += mix(h[j:] + np.uint64(j * 2 + 1))
    out = []
    for lo, hi in zip(c.bound[:-1].tolist(), c.bound[1:].tolist(), strict=True):
        if hi - lo >= words:
            s = np.sort(hashes[lo : hi - words + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif hi > lo:
            short = np.uint64(0)
            for j in range(lo, hi):
                short = mix(np.array([short + h[j]]))[0] if j == lo else mix(np.array([h[j]]) + short)[0]
            out.append(np.array([mix(np.array([short]) + np.uint64(hi - lo))[0]]))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    ends, both = np.cumsum(sizes), []
    for salt in (5, 0x5DEECE66D):
        total = np.r_[np.uint64(0), np.cumsum(mix(flat + np.uint64(salt)), dtype=np.uint64)]
        both.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * np.uint64(BASE)))
    return flat, sizes, *both


def batched(df: DataFrame, columns: list, words: int, schema: str, each, clashed=None) -> DataFrame:
    """Runs ``each(table, elements, sizes, nodes)`` on runs of documents; the text is column _text.  Sets whose first hash is among ``clashed`` go by their second."""
    space = spaces()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for table in gathered(batches, "_text", BATCH_BYTES):
            texts = utf8(table.column("_text"))
            for lo, hi in chunk_bounds(texts, 1 << 20):
                flat, sizes, nodes, second = sets_of(texts[lo:hi], words, space, powers)
                if clashed is None:
                    yield from each(table.slice(lo, hi - lo), flat, sizes, nodes, second)
                else:
                    yield from each(table.slice(lo, hi - lo), flat, sizes, np.where(among(clashed.value, nodes), second, nodes))

    return df.select(*columns).mapInArrow(go, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def pick(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
    return flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def tied(sigs: DataFrame, partitions: int) -> DataFrame:
    """(hub, node) for the nodes of each signature but its least, the hub; streams over sorted rows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_hub = None
        for b in batches:
            s, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(s):
                continue
            new = np.r_[last_sig is None or s[0] != last_sig, s[1:] != s[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            hub = np.where(at >= 0, node[np.maximum(at, 0)], last_hub if last_hub is not None else 0)
            last_sig, last_hub = s[-1], hub[-1]
            keep = hub != node
            yield batch(hub=hub[keep], node=node[keep])

    return sigs.repartition(partitions, "sig").sortWithinPartitions("sig", "node").mapInArrow(go, "hub long, node long")


def closest(counts: DataFrame) -> DataFrame:
    """Pairs (a < b) of each node and the hub it shares most with, and of each hub and the node: a hub that all its nodes pass over for another one stays in sight."""
    ends = F.array(F.struct(F.col("node").alias("x"), F.col("hub").alias("y"), "count"), F.struct(F.col("hub").alias("x"), F.col("node").alias("y"), "count"))
    best = counts.select(F.explode(ends).alias("e")).groupBy("e.x").agg(F.max(F.struct("e.count", "e.y")).alias("best"))
    return best.select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Adds ``linked`` to pairs (a, b) of nodes."""
    first = pairs.join(sets.selectExpr("node AS b", "elements AS eb"), "b")
    both = first.join(sets.selectExpr("node AS a", "elements AS ea"), "a").select("a", "b", "ea", "eb")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            linked = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                linked.append(q * common >= p * (len(x) + len(y) - common))
            yield batch(a=t.column(0), b=t.column(1), linked=pa.array(linked, pa.bool_()))

    return both.mapInArrow(go, "a long, b long, linked boolean")


def jaccard_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """One row per document: doc_id, row_key (a hash of id and text), set_id (equal sets share it), root (linked sets share it),
    n_shingles and component_id, the least doc_id reachable by links of similarity p / q or more."""
    spark, scheme = df.sparkSession, Scheme(p, q)
    df = df.select(column(doc_id).cast("long").alias("_id"), column(text).alias("_text"), F.xxhash64(column(doc_id), column(text)).alias("_key"))
    cols = ["_id", "_text", "_key"]
    per_sig = max(12, text_bytes(df, "_text") // (6 << 20), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def rows(t, flat, sizes, nodes, second):
        yield pa.RecordBatch.from_arrays([t.column("_id").combine_chunks(), pa.array(nodes.view(np.int64)), pa.array(second.view(np.int64)), pa.array(sizes), t.column("_key").combine_chunks()], names=["doc_id", "set_id", "second", "n_shingles", "row_key"])

    def emit(t, flat, sizes, nodes):
        _, once = np.unique(nodes, return_index=True)
        once = once[sizes[once] > 0]
        flat, n = pick(flat, sizes, once)
        sig, owner = signatures(flat, n, scheme, common.value)
        yield batch(sig=sig.view(np.int64), node=nodes[once][owner].view(np.int64))

    def repeated(t, flat, sizes, nodes, second):
        values, n = np.unique(flat, return_counts=True)
        often = n >= max(3, len(sizes) // 300)
        yield batch(element=values[often].view(np.int64), n=n[often])

    counts = batched(df, cols, words, "element long, n long", repeated).groupBy("element").agg(F.sum("n").alias("n"))
    total = df.count()
    common = written(counts.filter(F.col("n") >= max(8, total // 1000)).orderBy(F.desc("n"), "element").limit(MOST_FREQUENT)).toArrow()
    common = spark.sparkContext.broadcast(np.sort(common.column("element").to_numpy().view(np.uint64)))
    listed = written(batched(df, cols, words, "doc_id long, set_id long, second long, n_shingles long, row_key long", rows))
    # Different sets of one hash: a handful at most, even among 10**11 sets.
    twice = listed.groupBy("set_id").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo <> hi").select("set_id").toArrow().column(0).to_numpy()
    clashed = spark.sparkContext.broadcast(np.sort(twice.view(np.uint64)))
    listed = listed.withColumn("set_id", F.when(F.col("set_id").isin(*map(int, twice)), F.col("second")).otherwise(F.col("set_id"))).drop("second") if len(twice) else listed.drop("second")
    edges = tied(batched(df, cols, words, "sig long, node long", emit, clashed), per_sig)
    stars = written(closest(edges.groupBy("hub", "node").count()))
    wanted = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    shared = spark.sparkContext.broadcast(slot_filter(wanted, "node"))

    def keep(t, flat, sizes, nodes):
        _, once = np.unique(nodes, return_index=True)
        once = once[slots(shared.value, nodes[once].view(np.int64)) & (sizes[once] > 0)]
        ends = np.cumsum(sizes)
        yield batch(node=nodes[once].view(np.int64), elements=pa.array([flat[ends[i] - sizes[i] : ends[i]].tobytes() for i in once], pa.binary()))

    sets = written(batched(df, cols, words, "node long, elements binary", keep, clashed).groupBy("node").agg(F.first("elements").alias("elements")))
    tried = tried_first = written(verified(stars, sets, p, q))
    label = components(tried.filter("linked").select("a", "b"))
    for step in range(ROUNDS + 1):
        held = mixed(sets, label, scheme, common)
        if held.isEmpty():
            break
        pairs = neighbours(held, scheme, per_sig, step) if step < ROUNDS else differing(held, scheme, per_sig)
        seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = written(verified(pairs.join(seen, ["a", "b"], "left_anti"), sets, p, q))
        tried = tried.unionByName(more)
        if not more.filter("linked").isEmpty():
            label = components(tried.filter("linked").select("a", "b"))
    # A set's rows and a class's sets may be a third of all: both are reduced to one row before they are joined.
    sets_ = listed.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")).join(label.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    sets_ = written(sets_)
    discard(sets, stars, tried_first)
    classes = sets_.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    known = looked_up(sets_.select("set_id", "root", F.col("_n").alias("_rows")), classes, "root", total).withColumnRenamed("_rows", "_n")
    full = looked_up(listed.filter("n_shingles > 0"), known, "set_id", total).select("doc_id", "row_key", "set_id", "root", "n_shingles", "component_id")
    none = listed.filter("n_shingles = 0").select("doc_id", "row_key", "set_id", F.lit(None).cast("long").alias("root"), "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(none).withColumnRenamed("doc_id", doc_id)


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each class the row of the least doc_id (then of the least hash), once; sets without words stay."""
    classes = jaccard_classes(df, doc_id, text, **how).select(F.coalesce(column(doc_id), F.lit(NULL_ID)).alias("_id"), F.col("row_key").alias("_key"), "root", "n_shingles")
    chosen = classes.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("_id", "_key")).alias("x")).select("x.*")
    rows = df.select(F.struct(*map(column, df.columns)).alias("_row"), F.coalesce(column(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(column(doc_id), column(text)).alias("_key"))
    kept = chosen.unionByName(classes.filter("n_shingles = 0").select("_id", "_key")).distinct()
    return rows.dropDuplicates(["_id", "_key"]).join(kept, ["_id", "_key"], "left_semi").select("_row.*")


def mixed(sets: DataFrame, label: DataFrame, scheme: Scheme, common) -> DataFrame:
    """(sig, node, comp, n, sketch) of the sets of signatures in more than one component."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for lo in range(0, t.num_rows, 500):
                b = t.slice(lo, 500)
                parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
                sig, owner = signatures(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)), scheme, common.value)
                yield batch(sig=sig.view(np.int64), node=b.column(0).to_numpy()[owner], comp=b.column(2).to_numpy()[owner])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(1)]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            found = sketches(np.concatenate(parts), sizes) if parts else []
            yield batch(node=t.column(0), n=sizes, sketch=pa.array([x.tobytes() for x in found], pa.binary()))

    known = sets.join(label, "node", "left").select("node", "elements", F.coalesce("root", "node").alias("comp"))
    sigs = known.mapInArrow(emit, "sig long, node long, comp long")
    several = sigs.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("sig")
    return written(sigs.join(several, "sig", "left_semi").distinct().join(sets.mapInArrow(draw, "node long, n long, sketch binary"), "node").select("sig", "node", "comp", "n", "sketch"))


def drawn(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def neighbours(held: DataFrame, scheme: Scheme, partitions: int, salt: int) -> DataFrame:
    """Pairs (a < b): each node and, of its neighbours in a random order of its signatures' sets, the nearest of another component."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for b in batches:
            t = pa.Table.from_batches([*([last] if last is not None else []), b]).combine_chunks()
            last = b.slice(b.num_rows - 1) if b.num_rows else last
            sig, node, comp, n = (t.column(c).to_numpy() for c in ("sig", "node", "comp", "n"))
            s = drawn(t.column("sketch").combine_chunks())
            far = np.bitwise_count(s[1:] ^ s[:-1]).sum(axis=1)
            may = (sig[1:] == sig[:-1]) & (comp[1:] != comp[:-1]) & (far <= scheme.differing(n[1:] + n[:-1])) & (np.minimum(n[1:], n[:-1]) * scheme.q >= np.maximum(n[1:], n[:-1]) * scheme.p)
            a, b_, d = node[:-1][may], node[1:][may], far[may].astype(np.int32)
            yield batch(node=np.r_[a, b_], other=np.r_[b_, a], d=np.r_[d, d])

    ordered = held.withColumn("o", F.xxhash64("node", "sig", F.lit(salt))).repartition(partitions, "sig").sortWithinPartitions("sig", "o")
    best = ordered.mapInArrow(go, "node long, other long, d int").groupBy("node").agg(F.min(F.struct("d", "other")).alias("x"))
    return best.select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b")).distinct()


def differing(held: DataFrame, scheme: Scheme, partitions: int) -> DataFrame:
    """Pairs (a < b) of different components that share a signature and that size and sketch don't rule out."""
    blocks = held.groupBy("sig").agg(F.expr(f"CAST(ceil(count(*) / {BLOCK}) AS INT)").alias("nb"))
    own = held.join(blocks, "sig").withColumn("own", F.expr("CAST(pmod(xxhash64(node, sig), nb) AS INT)"))
    tiles = own.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(t: pa.Table) -> pa.RecordBatch:
            sig, i, j, own, node, comp, n = (t.column(c).to_numpy() for c in ("sig", "i", "j", "own", "node", "comp", "n"))
            s = drawn(t.column("sketch").combine_chunks())
            cut = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            found = []
            for u, v in zip(cut.tolist(), [*cut[1:].tolist(), len(sig)], strict=True):
                left = np.arange(u, v)[own[u:v] == i[u]]
                right = left if i[u] == j[u] else np.arange(u, v)[own[u:v] == j[u]]
                for lo in range(0, len(left), 64):
                    a = left[lo : lo + 64]
                    far = np.bitwise_count(s[a][:, None] ^ s[right]).sum(axis=2)
                    na, nb = n[a][:, None], n[right]
                    may = (comp[a][:, None] != comp[right]) & (far <= scheme.differing(na + nb)) & (np.minimum(na, nb) * scheme.q >= np.maximum(na, nb) * scheme.p)
                    x, y = np.nonzero(may)
                    found.append(np.stack([node[a[x]], node[right[y]]], axis=1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
            return batch(a=np.ascontiguousarray(pairs[:, 0]), b=np.ascontiguousarray(pairs[:, 1]))

        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), b])
            key = [t.column(c).to_numpy() for c in ("sig", "i", "j")]
            start = int(np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)])[-1])  # the last tile may go on
            if start:
                yield compare(t.slice(0, start))
            rest = t.slice(start)
        if rest is not None:
            yield compare(rest)

    return tiles.select("sig", "i", "j", "own", "node", "comp", "n", "sketch").repartition(partitions, "sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(go, "a long, b long").distinct()


def op2_jaccard_partenum(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs, words=4, p=85, q=100).select("doc_id", "n_shingles", "component_id")
