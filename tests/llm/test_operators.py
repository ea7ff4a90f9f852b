"""Brute-force versions, round trips, and the edge cases that docstrings state."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import ann, ctw, decontaminate, jaccard, language, packing, pii, substrings, templates, textkit, urls

DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def words(text):
    return (text or "").encode().split()


def edge_rows():
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"
    return [(1, base), (1, base), (2, base + " more"), (3, None), (4, ""), (5, " \n\t "), (None, "alone here"), (6, LONG), (7, LONG + " tail"), (8, "short"), (9, base.upper()), (10, "ünï " * 40)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# 1 nearest neighbours


def test_nearest_with_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(12)] + [(200, None), (201, []), (202, [0.0] * 8), (203, [math.nan] * 8), (204, [None] * 8), (None, rows[1][1]), (205, [1.0, 2.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, df.filter("vec_id % 20 = 0"), query_block=2, base_block=16).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]

    def cos(a, b):
        dot = aa = bb = 0.0
        for x, y in zip(a, b, strict=True):
            dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
        return dot / (math.sqrt(aa) * math.sqrt(bb))

    for q, v in {i: v for i, v in ok if i % 20 == 0}.items():
        want = sorted(((-cos(v, w), i) for i, w in ok if i != q and len(w) == len(v)))[:5]
        assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got
    assert ann.nearest(df.limit(0), df).count() == 0
    far = [(1, [1e200, 2e200]), (2, [3e-200, 1e-200]), (3, [1.0, 1.0]), (4, [5e-324, 0.0]), (1, [2e200, 0.0])]
    wide = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    seen = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in ann.nearest(wide, wide.filter("vec_id = 1")).collect())
    want = sorted([(-round(3 / math.sqrt(10), 12), 3), (-round(5 / math.sqrt(50), 12), 2), (-round(1 / math.sqrt(5), 12), 4)])
    assert seen == [(1, i + 1, v, -x) for i, (x, v) in enumerate(want)]


# 2 Jaccard


def brute_classes(rows, n, p):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        for j, m in Counter(j for x in s for j in seen[x]).items():
            if 100 * m >= p * (len(s) + len(sets[j]) - m):
                root[find(i)] = find(j)
        for x in s:
            seen[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize(("n", "p"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, docs, edge, n, p):
    for df in (docs.select("doc_id", "text"), edge):
        rows = [tuple(r) for r in df.collect()]
        got = jaccard.jaccard_classes(df, words=n, p=p).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == brute_classes(rows, n, p)


def test_jaccard_of_mutated_copies(spark):
    rng = np.random.default_rng(5)
    rows, d = [], 0
    for size in (8, 12, 25, 60, 200, 500):
        for _ in range(4):
            base = [f"b{rng.integers(1 << 30)}" for _ in range(size)]
            for _ in range(8):
                w = list(base)
                for _ in range(rng.integers(0, max(2, size // 20))):
                    w[rng.integers(size)] = f"m{rng.integers(1 << 30)}"
                rows.append((d, "hot line shared by all of them " * (d % 3 == 0) + " ".join(w)))
                d += 1
    df = spark.createDataFrame(rows, DOCS)
    got = jaccard.jaccard_classes(df, words=4, p=85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows, 4, 85)
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 100])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, few):
    from fieldspark.llm import components

    monkeypatch.setattr(components, "FEW", few)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(20)] + [(7, 7), (300, 299), (-5, 300)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, *range(200, 220))} | {i: -5 for i in (-5, 299, 300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3 packing


def test_the_hub_of_a_signature_that_its_sets_share_more_with_another_hub(spark):
    rows = []
    for t in range(300):
        middle = [f"t{t}w{i}" for i in range(30)]
        for side, text in enumerate((middle, ["x", "y", *middle[2:]], [*middle[:-2], "x", "y"])):
            rows.append((3 * t + side, " ".join(text)))
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, DOCS), words=4, p=85).select("doc_id", "component_id").collect()
    assert {d: c for d, c in got} == {i: i // 3 * 3 for i in range(900)}


def test_packing_round_trip(spark, docs, edge):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = [(1001, "  a b\n\n c  \n"), (1002, "hi <|endoftext|> there's\t\tq\r\nz"), (1003, "\n"), (1004, "a\u00a0 \nb\u2003c"), (1005, "  ")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(own, DOCS)).unionByName(edge.selectExpr("doc_id + 2000 AS doc_id", "text").dropDuplicates())
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in df.collect()}
    pieces, rooms = defaultdict(list), defaultdict(list)
    for r in packing.pack(df).collect():
        pieces[r["doc_id"]].append(r)
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[d])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : at], "<u4").tobytes())
        assert at == len(ids[d])
    for found in rooms.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(rooms) - 1 <= sum(map(len, ids.values())) // 2048
    assert packing.pack(df.limit(0)).count() == 0


def packed_rows(df):
    found = defaultdict(list)
    for r in packing.pack(df).collect():
        found[r["sequence_id"]].append(r)
    return found


def test_packing_of_repeated_rows_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    rows = [(7, "the same text again and again")] * 130 + [(None, None)] * 90
    found = packed_rows(spark.createDataFrame(rows, DOCS).repartition(3))
    counts = Counter(r["doc_id"] for held in found.values() for r in held if r["start"] == 0)
    assert counts == {7: 130, None: 90}
    assert max(Counter(s >> 24 for s, held in found.items() for r in held if r["start"] == 0).values()) <= 40


def test_retrieval_equals_brute_force():
    rng = np.random.default_rng(6)
    tokens = [np.r_[rng.zipf(1.3, rng.integers(1, 400)) % 500, 1].astype(np.uint16) for _ in range(80)]
    df = Counter(int(x) for t in tokens for x in set(t.tolist()))
    mean = sum(map(len, tokens)) / len(tokens)
    stats = {"df": np.array([df[i] for i in range(1 << 16)]), "docs": 80, "mean": mean}
    index = packing.Index([t.tobytes() for t in tokens], stats)

    def brute(seed, used):
        score = {}
        for d, t in enumerate(tokens):
            n = Counter(t.tolist())
            if d not in used:
                score[d] = sum(math.log(1 + (80 - df[x] + 0.5) / (df[x] + 0.5)) * n[x] * 2.2 / (n[x] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in set(tokens[seed].tolist()) if n[x])
        return sorted((d for d in score if score[d] > 0), key=lambda d: (-round(score[d], 3), d)), score

    used = set()
    for seed in rng.permutation(80)[:60].tolist():
        if seed not in used:
            index.free[seed] = False
            used.add(seed)
        want, score = brute(seed, used)
        got = index.neighbours(seed, 10)
        assert len(got) == min(10, len(want))
        assert all(abs(score[a] - score[b]) < 1e-2 for a, b in zip(got, want, strict=False))
    # a window is filled by the seed's neighbours, best first
    filled = list(packing.fill([t.tobytes() for t in tokens], 2048, stats))
    first = [d for d, s, n, q, o in filled if q == 0]
    fresh = packing.Index([t.tobytes() for t in tokens], stats)
    fresh.free[0] = False
    assert first == [0, *fresh.neighbours(0, len(first) - 1)]


def test_copies_lie_in_one_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    rng = np.random.default_rng(8)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 5)))
    vocabulary = [[word() for _ in range(40)] for _ in range(20)]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 20], 60))) for i in range(400)]
    found = packed_rows(spark.createDataFrame(rows, DOCS).repartition(5))
    shard = {r["doc_id"]: s >> 24 for s, held in found.items() for r in held if r["start"] == 0}
    together = np.mean([shard[a] == shard[b] for a in range(400) for b in range(a + 20, 400, 20)])
    apart = np.mean([shard[a] == shard[a + 1] for a in range(399)])
    assert together > 4 * max(apart, 0.02)


# 4 personal data


def brute_pii(text):
    import re

    spans = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = [int(x) for x in m[0] if x in "0123456789"]
            luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


def test_personal_data_equals_brute_force(spark, docs):
    own = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 256.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111", "+1 (555) 010-9999 +12 +49 30 1234567 8.", "é@x.de 😀 a.b@x-y.co.uk.", "9" * 5000, "a" * 20000 + "@", "+1" + " " * 50, "a%b@c.d%e@f.g", None, "", "4-1-1-1 1 1 1 1 1 1 1 1 1 1 1 1", "DE89 3704 0044 0532 0130 00 iban", "ssn 078-05-1120 and 078-05-1121, ssn 666-05-1120", "api token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and a" + "b" * 40 + " key ghp_" + "aB3" * 12, "DE89 3704 0044 0532 0130 0 iban"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(own)], DOCS)).withColumn("pii_spans", F.lit("clash"))
    for r in pii.find_personal_data(df).collect():
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii_spans"]]
        assert [s for s in got if s.split(":")[0] in pii.BASE_KINDS] == brute_pii(r["text"]), r["text"]
        if r["doc_id"] == 5012:
            assert "iban:0:27" in got
        if r["doc_id"] == 5013:
            assert "ssn:4:15" in got and "ssn:41:52" not in got
        if r["doc_id"] == 5014:
            assert {x.split(":")[0] for x in got} >= {"secret", "api_key"} and "secret:13:53" in got
        if r["doc_id"] == 5015:
            assert not any(x.startswith("iban") for x in got)
    assert pii.find_personal_data(df.limit(0)).count() == 0


# 5 language


def test_language_accuracy_and_edges(spark, docs):
    model = language.train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = docs.select("doc_id", F.col("lang").alias("true_lang"), language.identified(docs, model).alias("g"), held.alias("h"))
    rows = out.filter("h").collect()
    assert np.mean([r["true_lang"] == r["g"]["lang"] for r in rows]) > 0.97
    assert (model["table"] == 0).mean() > 0.5
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "the and of", None)], DOCS + ", lang string")
    found = {r[0]: r[1] for r in odd.select("doc_id", language.identified(odd, model)).collect()}
    assert [found[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3 and [found[i]["score"] for i in (1, 2, 3)] == [0.0] * 3
    assert found[4]["lang"] != "und" and 0 <= found[4]["score"] <= 1
    assert language.train(odd.limit(0)) is None
    rng = np.random.default_rng(2)
    junk = spark.createDataFrame([(i, " ".join("".join(rng.choice(list("qxzjkvw"), 6)) for _ in range(60))) for i in range(30)], DOCS)
    assert all(r["g"]["score"] < model["bar"] for r in junk.select(language.identified(junk, model).alias("g")).collect())
    assert np.mean([r["g"]["score"] >= model["bar"] for r in rows]) > 0.98
    assert {r[0]["lang"] for r in odd.select(language.identified(odd, None)).collect()} == {"und"}


def test_language_counts_of_long_texts_and_draw_of_repeated_rows(spark, docs):
    from unittest import mock

    texts = ["Ein, zwei -- drei!", "", " a", "x" * 50, "été ".join("abcdefg") * 9, "12 34", "a  b" * 20]
    whole = language.counts(texts, language.Letters())
    for size in (1, 2, 3, 7, 16):
        with mock.patch.object(language, "SLICE", size):
            parts = language.counts(texts, language.Letters())
        assert (parts[0] == whole[0]).all() and (parts[1] == whole[1]).all()
    for t, x in zip(texts, whole[0], strict=True):
        flat = "".join(c.lower() if c.isalpha() else " " for c in t)
        padded = " " + " ".join(flat.split()) + " " if flat.strip() else "  "
        assert x.sum() == sum(max(0, len(padded) - n + 1) for n in (1, 2, 3)) or not flat.strip()
    # training by hand: the sample drawn, its TF-IDF rows and the same leader give the same weights
    many = docs.unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(500)).select(*docs.columns)).withColumn("doc_id", F.lit(7))
    model = language.train(many, per_language=20)
    assert model["names"] == ["de", "en", "es", "fr"]
    sample = sorted(many.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("doc_id", "text", F.lit("sample")).alias("d"), "text").distinct().collect())
    rows, counted = [], language.counts([r["text"] for r in many.filter("lang IS NOT NULL AND text IS NOT NULL").collect()], language.Letters())[0] > 0
    idf = (np.log((1 + len(counted)) / (1 + counted.sum(axis=0))) + 1).astype(np.float32)
    assert np.allclose(model["idf"], idf)
    held = dict(many.select(F.xxhash64("doc_id", "text", F.lit("sample")).alias("d")).distinct().select("d", F.pmod(F.xxhash64("d", F.lit("held")), F.lit(5))).collect())
    for k, name in enumerate(model["names"]):
        for r in [r for r in sample if r["lang"] == name][:20]:
            if held[r["d"]] != 0:
                x = language.unit(language.counts([r["text"]], language.Letters())[0][0] * model["idf"])
                at = np.flatnonzero(x).astype(np.int32)
                rows.append((at, x[at], k))
    rows.sort(key=lambda r: (r[2], r[0].tobytes()))
    assert np.allclose(language.ftrl(rows, 4), np.r_[model["table"], model["bias"][None]], atol=1e-6)


# 6 urls


def test_url_rules_and_edges(spark):
    rows = [(1, "http://A.Example.com/en/7x?y"), (2, "http://example.com/en/8"), (3, "https://x.example.net/de/81#f"), (4, "ftp://net/de/1"), (5, "http://badexample.com/fr/1"), (6, None), (7, "no scheme"), (8, "http://free-casino.example/slots/win"), (9, "http://org?/es/"), (10, "x://y://org/es/3"), (11, "http://ORG/es/a"), (12, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    labelled = spark.createDataFrame(list(urls.LABELLED_URLS), "url string, label int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, labelled).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("example.com", "/en/8", "com/en/", "block")
    assert got[3] == ("x.example.net", "/de/81", "example.net/de/8", "block")
    assert got[4] == ("net", "/de/1", "net/de/", "allow")
    assert got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[12][:3] == ("", "", None)
    assert got[8][3] == "block" and got[5][3] == "allow"
    assert got[9][:3] == ("org", "", None) and got[10][:3] == ("y:", "//org/es/3", None) and got[11][2:] == ("org/es/", "block")
    assert urls.judge_urls(df.limit(0), labelled).count() == 0


# 7 repeated windows


def test_repeats_equal_brute_force(spark, docs, edge):
    for df, ids in ((docs.select("doc_id", "text"), True), (edge.filter("doc_id IS NOT NULL").dropDuplicates(), True), (edge, False)):
        rows = sorted({(d if d is not None else -(1 << 62), t) for d, t in df.collect()}, key=lambda r: r[0])
        seen, want = set(), {}
        for d, t in rows:
            w, gone = words(t), set()
            for k in range(len(w) - 19):
                x = tuple(w[k : k + 20])
                if x in seen:
                    gone.update(range(k, k + 20))
                seen.add(x)
            want[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
        got = substrings.remove_repeats(df.withColumn("n_words", F.lit("clash"))).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r["n_words"], r["n_removed"], r["text"]) == want[r["doc_id"] if r["doc_id"] is not None else -(1 << 62)]
    assert substrings.remove_repeats(edge.limit(0)).count() == 0


# 8 context tree


def test_tree_equals_recursion_and_sums_to_one():
    texts = [b"abracadabra abra", b"abba", b"cab"] * 3
    depth = 2
    code, _ = ctw.grams(texts, depth)
    counts = []
    for d in range(depth + 1):
        values, n = np.unique(code & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True)
        counts.append((values, n))
    tree = ctw.Tree(counts)
    bits = Counter()
    for c in code.tolist():
        for d in range(depth + 1):
            for k in range(8):
                byte = c & 255
                bits[d, (c >> 8) & ((1 << (8 * d)) - 1), (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1] += 1

    def kt(a, b):
        return math.exp(math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi))

    def weighted(d, ctx, node):
        own = kt(bits[d, ctx, node, 0], bits[d, ctx, node, 1])
        if d == depth:
            return own
        longer = {c for e, c, n, _ in list(bits) if e == d + 1 and n == node and c & ((1 << (8 * d)) - 1) == ctx}
        return own / 2 + math.prod(weighted(d + 1, c, node) for c in longer) / 2

    def predicted(d, ctx_of, node):
        ctx = ctx_of & ((1 << (8 * d)) - 1)
        a, b = bits[d, ctx, node, 0], bits[d, ctx, node, 1]
        q = (b + 0.5) / (a + b + 1)
        if d == depth:
            return q
        w = kt(a, b) / 2 / weighted(d, ctx, node)
        if not any(bits[d + 1, ctx_of & ((1 << (8 * d + 8)) - 1), n, x] for n in range(256) for x in (0, 1)):
            return w * q + (1 - w) * 0.5
        return w * q + (1 - w) * predicted(d + 1, ctx_of, node)

    for text in (b"abra", b"zab"):
        got = tree.log10(ctw.grams([text], depth)[0])
        for c, value in zip(ctw.grams([text], depth)[0].tolist(), got, strict=True):
            p = 1.0
            for k in range(8):
                one = predicted(0, c >> 8, 1 << k | (c & 255) >> (8 - k))
                p *= one if c >> (7 - k) & 1 else 1 - one
            assert math.isclose(math.log10(p), value, rel_tol=1e-4, abs_tol=1e-4)
    for ctx in (0x6162, 0x0A0A, 0x7A7A):
        every = np.array([ctx << 8 | b for b in range(256)], np.uint64)
        assert math.isclose((10 ** tree.log10(every)).sum(), 1, rel_tol=1e-3)


def test_scores_equal_brute_force(spark, docs, edge):
    df = docs.select("doc_id", "text").unionByName(edge.filter("doc_id IS NOT NULL").selectExpr("doc_id + 9000 AS doc_id", "text"))
    rows = df.collect()
    out = ctw.score_texts(df, df.filter(~ctw.held_out()), frequent=50)
    token = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(x for d, t in rows if zlib.crc32(str(d).encode()) % 10 for x in token(t))
    n, v = sum(c.values()), len(c)
    want = sorted((d, len(token(t)), sum(c[x] > 0 for x in token(t)), n) for d, t in rows)
    base = sorted((d, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in token(t))) for d, t in rows)
    got = sorted(map(tuple, out.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()))
    assert [r[:4] for r in got] == want
    assert np.allclose([r[4] for r in got], [b for _, b in base], rtol=1e-9, atol=1e-9)
    assert all(r[5] < 0 for r in got)
    none = ctw.score_texts(df.limit(3), df.limit(0)).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in none)
    assert ctw.score_texts(df.limit(0), df.limit(0)).count() == 0


def test_every_context_of_the_training_texts_scores(spark):
    """More (context, byte) rows than a model of 2**18 holds: scores equal those of the tree of all counts."""
    rng = np.random.default_rng(8)
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 3000)))) for i in range(40)]
    training = spark.createDataFrame([(i + 1000 * k, t) for i, t in rows for k in range(6)], DOCS)
    code, _ = ctw.grams([t.encode() for _, t in rows] * 6, 5)
    rows += [(100 + i, t[:1500] + "\u00e9 Zq" + t[700:900]) for i, t in rows[:5]]
    df = spark.createDataFrame(rows, DOCS)
    counts = [np.unique(code & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True) for d in range(6)]
    assert sum(len(c) for c, _ in counts) > 1 << 18
    tree = ctw.Tree(counts)
    want = {i: tree.log10(ctw.grams([t.encode()], 5)[0]).sum() for i, t in rows}
    got = {r["doc_id"]: r["score"] for r in ctw.score_texts(df, training).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)


def test_grams_and_distinct_codes_equal_plain_loops():
    rng = np.random.default_rng(80)
    texts = [b"", b"x", b"  A b\n\tC ", "\u00e9\u00c9 Z".encode(), bytes(rng.integers(97, 100, 300, np.uint8))]
    for depth in (0, 1, 2, 5, 7):
        want, symbols = [], []
        for t in texts:
            data = b"\n" * depth + b" ".join(t.translate(textkit.ASCII_LOWER).split()) + b"\n"
            want += [int.from_bytes(data[i : i + depth + 1]) for i in range(len(data) - depth)]
            symbols.append(len(data) - depth)
        code, lens = ctw.grams(texts, depth)
        assert code.tolist() == want and lens.tolist() == symbols
        found, first = ctw.distinct(code)
        assert found.tolist() == sorted(set(want)) and np.diff(first, append=len(code)).tolist() == [n for _, n in sorted(Counter(want).items())]
        tally = ctw.Tally(0)
        batches = [b for part in (code, code[:50], code[:0]) for b in tally.add(part)] + list(tally.flush())
        counts = {k: n for b in batches for k, n in zip(b.column(1).to_numpy().view(np.uint64).tolist(), b.column(2).to_pylist(), strict=True)}
        assert counts == Counter(want) + Counter(want[:50])
    assert [len(x) for x in ctw.distinct(np.zeros(0, np.uint64))] == [0, 0]


# 9 line templates


def brute_templates(rows, min_docs=10, long_words=50, share=0.6, constants=3):
    """Drops by the tree, for leaves of any size: exact documents, groups in the order of the lines' hashes."""
    masked, lines, leaf = [], defaultdict(set), defaultdict(dict)
    space, powers = textkit.spaces(), textkit.Powers()
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w, first, count, _, no = templates.lines_in([(t or "").encode()], space, powers)
        h1, h2 = templates.line_hashes(w, first, count)
        for f, n, k, a, b in zip(first, count, no, h1.view(np.int64), h2.view(np.int64), strict=True):
            line = tuple(w[f : f + n].tolist())
            masked.append((d, t, int(k), line))
            lines[line].add((d, t))
            leaf[n, line[0]][int(a), int(b)] = line
    groups = defaultdict(set)
    for (n, _), held in leaf.items():
        open_ = []
        for _, line in sorted(held.items()):
            agree = [sum(x == y != 0 for x, y in zip(g[0], line, strict=True)) for g in open_]
            if agree and max(agree) >= max(constants, math.ceil(share * n - 1e-9)):
                g = open_[agree.index(max(agree))]
                g[0], _ = [x if x == y else 0 for x, y in zip(g[0], line, strict=True)], g[1].append(line)
            else:
                open_.append([list(line), [line]])
        for g, who in open_:
            if len(who) > 1:
                groups[tuple(g)] |= set(who)
    wanted = [({x}, 2 if len(x) > long_words else min_docs) for x in lines] + [(who | {g} & set(lines), min_docs) for g, who in groups.items()]
    gone, order = set(), lambda x: (x[0] is not None, x[0] or 0, x[2])
    for who, least in wanted:
        if len(set().union(*(lines[x] for x in who))) >= least:
            places = sorted((m for m in masked if m[3] in who), key=order)
            gone |= {m[:3] for m in places[1:]}
    out = []
    for d, t in rows:
        kept = [x for i, x in enumerate((t or "").split("\n")) if (d, t, i) not in gone]
        out.append((d, None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def template_rows():
    rng = np.random.default_rng(9)
    people, rows = [f"p{chr(97 + i)}x" for i in range(26)], []
    for i in range(60):
        x, y = rng.integers(0, 26, 2)
        own = " ".join("abcdefghij"[int(k)] * 3 for k in rng.integers(0, 10, 7))
        rows.append((i, f"user {people[x]} logged in from {people[y]} today\n{own}\nPage {i} of 9\nPosted by {people[x]} on {people[y]}"))
    return [*rows, (None, None), (80, ""), (81, "Page x of 9"), (82, " ".join(["long"] * 60)), (83, " ".join(["long"] * 60) + "\nmore"), (5, rows[5][1]), (5, rows[5][1])]


def test_templates_equal_brute_force_whatever_the_partitions(spark, docs, edge):
    rows = template_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("clash")).withColumn("_id", F.lit("x")).withColumn("_key", F.lit("y"))
    want = brute_templates(rows)
    for n in (1, 12):
        out = templates.drop_templates(df.repartition(n))
        assert out.columns == ["doc_id", "text", "_id", "_key", "n_lines", "n_dropped"]
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want
    assert sum("logged" in (t or "") for _, t in want) == 1 and sum("Posted" in (t or "") for _, t in want) == 1
    assert [t for d, t in want if d == 83] == ["more"]
    sample = docs.select("doc_id", "text")
    got = sorted(((r["doc_id"], r["text"]) for r in templates.drop_templates(sample).collect()), key=str)
    assert got == brute_templates([tuple(r) for r in sample.collect()])
    assert templates.drop_templates(edge).count() == edge.count()
    assert templates.drop_templates(edge.limit(0)).count() == 0
    assert {r["n_dropped"] for r in templates.drop_templates(df.filter("doc_id < 20"), keep_first=False).collect()} == {3}


def test_one_differing_word_and_one_repeated_row(spark):
    names = "ann bob cleo dan eve fay gus hal ida jon kim leo mia ned".split()
    df = spark.createDataFrame([(i, f"user {x} logged in to the site") for i, x in enumerate(names)], DOCS)
    assert [r["n_dropped"] for r in templates.drop_templates(df).orderBy("doc_id").collect()] == [0] + [1] * 13
    same = spark.createDataFrame([(1, "a line\nof one row")] * 12, DOCS)
    for n in (1, 12):
        assert {r["n_dropped"] for r in templates.drop_templates(same.repartition(n)).collect()} == {0}


def test_large_leaves_are_split_from_both_ends(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    rows = [(i, " ".join(["go", *(word() for _ in range(7))])) for i in range(200)]
    rows += [(300 + i, f"go {word()} to the place of all things") for i in range(20)] + [(400 + i, f"go away from here or stay {word()}") for i in range(20)]
    got = {r["doc_id"]: r["n_dropped"] for r in templates.drop_templates(spark.createDataFrame(rows, DOCS), leaf_lines=30).collect()}
    assert {d for d, n in got.items() if n} == {*range(301, 320), *range(401, 420)}


@pytest.mark.parametrize(("n", "leaf_lines"), [(600, 500), (900, 64), (3000, 2048), (900, 7)])
def test_fields_at_both_ends_of_a_template_of_any_number_of_lines(spark, n, leaf_lines):
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, f"user {letters(i)} has logged in from {letters(7 * i + 3)}") for i in range(n)]
    got = templates.drop_templates(spark.createDataFrame(rows, DOCS), leaf_lines=leaf_lines).agg(F.sum("n_dropped").alias("n")).first()["n"]
    assert got == n - 1


def test_a_rare_template_in_a_large_leaf(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    rows = [(i, " ".join(["go", *(word() for _ in range(7))])) for i in range(1500)]
    rows += [(2000 + i, f"go {word()} to the very same {word()} {word()}") for i in range(15)]
    got = {r["doc_id"]: r["n_dropped"] for r in templates.drop_templates(spark.createDataFrame(rows, DOCS), leaf_lines=40).collect()}
    assert {d for d, n in got.items() if n} == set(range(2001, 2015))


def test_templates_among_many_lines_with_the_same_two_words_everywhere(spark):
    rng = np.random.default_rng(10)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    rows = [(i, " ".join(["go", "on", *(word() for _ in range(8))])) for i in range(600)]
    # no two neighbours in common but the first two: each line of a kind has its own words at the odd or the even places
    kinds = [[word() for _ in range(5)] for _ in range(30)]
    rows += [(1000 + 20 * k + i, " ".join(["go", "on", x[0], word(), x[1], word(), x[2], word(), x[3], word()])) for k, x in enumerate(kinds) for i in range(12)]
    got = {r["doc_id"]: r["n_dropped"] for r in templates.drop_templates(spark.createDataFrame(rows, DOCS), leaf_lines=40).collect()}
    assert {d for d, n in got.items() if n} == {1000 + 20 * k + i for k in range(30) for i in range(1, 12)}


def test_pipeline_drops_long_lines_from_two_documents_on(spark):
    import corpus_pipeline as P

    passage, short = " ".join(f"word{'abcdefgh'[i % 8]}{'klmnop'[i % 6]}" for i in range(60)), "a short line by chance"
    rows = [(i, f"own line {'x' * i}\n{passage}\n{short}") for i in (1, 2, 3)] + [(7, f"twice\n{passage} alone\n{passage} alone")] * 2
    df = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.lit(0).cast("long")).repartition(5)
    got = {r["doc_id"]: r["text"] for r in P.line_dedup(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: f"own line xx\n{short}", 3: f"own line xxx\n{short}", 7: rows[3][1]}


def test_sql_of_llm_queries(spark, data):
    from fieldspark.llm.registry import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, data).toPandas()
        want = con.execute(sql).df()[list(got.columns)]
        key = list(got.columns[:2])
        assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str)), name


# 10 decontamination


def test_overlaps_tolerate_substitutions_and_leave_clean_texts(spark, docs, edge, data):
    rng = np.random.default_rng(3)
    w = [f"q{rng.integers(1 << 30)}" for _ in range(40)]
    swapped = [x if i % 6 else f"z{i}" for i, x in enumerate(w)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, ""), (4, "too short"), (5, "the five word item, whole!")], "item_id long, text string")
    rows = [(1, "lead in " + " ".join(w) + " tail"), (2, "x " * 50 + " ".join(swapped)), (3, " ".join(w[:6]) + " fine"), (4, None), (5, ""), (None, ", ".join(w).upper()), (6, "say: THE five word item whole?"), (7, "the five word things whole"), (8, LONG)]
    df = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (6, 5)}
    assert (got[1, 1]["doc_start"], got[1, 1]["item_start"], got[1, 1]["matched"]) == (2, 0, 40)
    clean = spark.createDataFrame([(None, "nothing of it"), (1, "shares an id only")], DOCS)
    kept = sorted((str(r["doc_id"]) for r in decontaminate.decontaminate(df.unionByName(clean), bench).collect()))
    assert kept == sorted(["3", "4", "5", "7", "8", "None", "1"])
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0 and decontaminate.overlaps(df.limit(0), bench).count() == 0

    # against exact runs of ten words, on the given tables
    import re

    fold = lambda t: re.sub(rb"[!-/:-@\[-`{-~]", b" ", (t or "").encode().lower()).split()
    runs = defaultdict(set)
    for i, t in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect():
        x = fold(t)
        for k in range(len(x) - 9):
            runs[tuple(x[k : k + 10])].add(i)
    want = {(d, i) for d, t in docs.select("doc_id", "text").collect() for x in [fold(t)] for k in range(len(x) - 9) for i in runs.get(tuple(x[k : k + 10]), ())}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert want <= found and want


def brute_overlaps(rows, items, least=10, share=0.75):
    import re

    fold = lambda t: re.sub(rb"[!-/:-@\[-`{-~]", b" ", (t or "").encode().lower()).split()
    out = {}
    for d, t in rows:
        for i, x in items:
            a, b = fold(t), fold(x)
            for offset in range(-len(b) + 1, len(a)) if len(b) >= 5 else ():
                lo, hi = max(0, offset), min(len(a), offset + len(b))
                equal = np.array([a[k] == b[k - offset] for k in range(lo, hi)])
                seeded = any(all(equal[k + j] for j, m in enumerate(mask) if m == "1") for mask in (decontaminate.MASKS if len(b) >= 6 else ["1" * len(b)]) for k in range(len(equal) - len(mask) + 1))
                s, e = decontaminate.best_stretch(equal) if seeded else (0, 0)
                n = int(equal[s:e].sum())
                if n and n >= min(least, len(b)) and n >= share * (e - s):
                    row = (-n, lo + s, lo - offset + s, e - s)
                    out[d, i] = min(row, out.get((d, i), row))
    return {k: (s, at, length, -n) for k, (n, s, at, length) in out.items()}


def test_substituted_words_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    items = [(i, " ".join(f"t{rng.integers(60)}q{rng.integers(50)}" for _ in range(n))) for i, n in enumerate((5, 6, 9, 14, 30, 80, 200))]
    rows = []
    for d in range(60):
        w = items[d % 7][1].split()
        for k in range(len(w)):
            if rng.random() < (d // 7) * 0.05:
                w[k] = f"s{rng.integers(1 << 30)}"
        rows.append((d, "lead " * int(rng.integers(0, 4)) + " ".join(w[int(rng.integers(0, 3)) :]) + " tail"))
    rows += [(100, "same " * 2050), (101, None)]
    items += [(50, "same " * 400), (51, "same,\nsame;same\tsame-same")]
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.overlaps(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_overlaps(rows[:60], items[:7])
    assert {k: v for k, v in got.items() if k[0] != 100} == want and len(want) > 30
    assert got[100, 50] == (0, 0, 400, 400) and got[100, 51] == (0, 0, 5, 5)
    with pytest.MonkeyPatch.context() as m:  # more blocks and segments
        m.setattr(decontaminate, "BLOCK_WORDS", 100)
        m.setattr(decontaminate, "SEGMENT", 60)
        m.setattr(decontaminate, "LAP", 20)
        more = decontaminate.overlaps(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))
        assert {(r["doc_id"], r["item_id"]) for r in more.collect()} == set(got)
        kept = decontaminate.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(d for d, _ in rows if d not in {k[0] for k in got})


# the pipeline


def test_pipeline_stages(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before.count()
    classes = jaccard.jaccard_classes(docs)
    assert classes.filter("n_shingles > 0").groupBy("root").count().filter("count > 1").count() == 0
    assert decontaminate.overlaps(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    pieces = P.run(spark, data)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (2, "!!", "en", "s", 2)]
    odd = spark.createDataFrame(rows, spark.read.parquet(f"{data}/documents.parquet").schema)
    for _, stage in P.STAGES:
        odd = stage(spark, odd, data)
    assert odd.count() == 0


def test_hash_of_kept_words(spark, data):
    out = substrings.op7_repeated_passages(spark, data).first()
    assert len(out["kept_sha256"]) == len(hashlib.sha256().hexdigest())


def test_the_best_row_though_its_seeds_came_before(spark):
    words = [f"q{i}w" for i in range(60)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    pieces = [" ".join(words[i : i + 14]) for i in range(0, 50, 7)]
    short = [" ".join(words[i : i + 8]) for i in range(0, 56, 2)]
    rows = [(1, " xx yy zz ".join([*pieces, " ".join(words)])), (2, " xx yy zz ".join([*short, " ".join(words)])), (3, " xx yy zz ".join(short))]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["length"], r["matched"]) for r in decontaminate.overlaps(docs, item).collect()}
    assert got == {1: (60, 60), 2: (60, 60)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, item).collect()] == [3]


def test_url_judgement_with_clashing_columns(spark):
    long = "http://a.example.com/en/" + "x" * 50_000
    rows = [(1, "http://A.example.com/en/8?x", "p"), (1, "http://A.example.com/en/8?x", "p"), (2, None, "q"), (3, "no scheme", "q"), (4, long, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, _said string").withColumn("Host", F.lit("h")).withColumn("a.b", F.lit(5)).withColumn("VERDICT", F.lit("x"))
    out = urls.judge_urls(df, spark.createDataFrame(list(urls.LABELLED_URLS), "url string, label int"))
    assert out.columns == ["page_id", "url", "_said", "a.b", "host", "path", "rule", "block_score", "verdict"]
    got = out.collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3, 4]
    for r in got:
        assert r["_said"] in "pqr" and r["a.b"] == 5
        if r["page_id"] in (1, 4):
            assert (r["host"], r["rule"], r["verdict"]) == ("a.example.com", "com/en/", "block")
        else:
            assert (r["host"], r["path"], r["rule"]) == ("", "", None)


def test_texts_of_one_id_are_told_apart_by_64_bits(spark):
    assert {t for n, t in spark.createDataFrame([(1, "a")], DOCS).select(*substrings.own("doc_id", "text")).dtypes} == {"bigint"}
    keys = spark.range(60_000).selectExpr("CAST(1 AS LONG) AS doc_id", "CAST(id AS STRING) AS text").select(*substrings.own("doc_id", "text"))
    assert keys.select("_key").distinct().count() == 60_000 and keys.filter("_key > 4294967295 OR _key < 0").count() > 0


def textbook_ftrl(rows, classes, epochs, alpha, beta, l1, l2):
    """Per-coordinate FTRL-proximal with plain dictionaries, written from its published form."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((beta + math.sqrt(n[key])) / alpha + l2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            features = [*zip(at.tolist(), x.tolist(), strict=True), (language.BUCKETS, 1.0)]
            scores = [sum(v * weight((f, k)) for f, v in features) for k in range(classes)]
            top = max(scores)
            odds = [math.exp(s - top) for s in scores]
            for k in range(classes):
                error = odds[k] / sum(odds) - (k == y)
                old = {f: weight((f, k)) for f, _ in features}
                for f, v in features:
                    g = error * v
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha * old[f]
                    n[f, k] += g * g
    return {key: weight(key) for key in list(z)}


def test_ftrl_equals_its_published_form():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(60, 6, replace=False)).astype(np.int32), rng.random(6).astype(np.float32), int(rng.integers(3))) for _ in range(50)]
    got = language.ftrl(rows, 3, epochs=2)
    for (f, k), w in textbook_ftrl(rows, 3, 2, 2.0, 1.0, 0.02, 1e-4).items():
        assert abs(got[f, k] - w) < 1e-5


def test_temperature_is_the_least_log_loss_and_scores_are_calibrated(spark, docs):
    rng = np.random.default_rng(8)
    logits = rng.normal(size=(4000, 4)) * 3
    p = language.softmax(logits / 2.5)
    y = np.array([rng.choice(4, p=q) for q in p])
    t = language.temperature(logits, y)
    assert 2.2 < t < 2.8
    grid = np.linspace(0.5, 6, 200)
    assert language.log_loss(logits / t, y) <= min(language.log_loss(logits / g, y) for g in grid) + 1e-9
    assert language.temperature(logits[:0], y[:0]) == 1.0
    data = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000")
    model = language.train(data.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    assert 1 / language.STEEP[1] * 1.01 < model["temperature"] < 1 / language.STEEP[0] * 0.99 and model["bar"] < 0.99
    short = data.filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).withColumn("text", F.expr("substring(text, 1 + pmod(hash(doc_id), greatest(1, length(text) - 25)), 25)"))
    bins = language.reliability(short.select("lang", language.identified(short, model).alias("guess")), F.col("lang")).collect()
    assert len(bins) > 3 and all(abs(r["right"] - r["mean_score"]) < 0.15 for r in bins if r["n"] >= 40)
    kept = data.filter("lang IS NOT NULL").select("text", language.identified(data, model).alias("guess"))
    assert kept.filter(~language.clears(F.col("text"), F.col("guess"), model)).count() <= 0.002 * kept.count()
    assert list(model["bars"]) == sorted(model["bars"]) and model["bar"] == model["bars"][-1] <= language.MOST_BAR
