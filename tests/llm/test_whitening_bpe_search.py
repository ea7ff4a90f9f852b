"""Operators 11 to 13 against brute force, and the cases that their docstrings state."""

import hashlib
import math
import os
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import bpe, search, whitening

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import check  # noqa: E402

DOCS = "doc_id long, text string"


# 11 whitening


def by_numpy(rows, k=4):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in ok})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[j] for x in distinct) for j in range(d)]
    y = np.array([[n * v - s for v, s in zip(x, sums, strict=True)] for x in distinct], object)
    cov = np.array([[int((y[:, i] * y[:, j]).sum()) / n**3 for j in range(d)] for i in range(d)])
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    out = {}
    for i, x in ok:
        z = [n * v - s for v, s in zip(x, sums, strict=True)]
        out[i] = (n, sum(v * v for v in z), np.array(z, float) / n @ vector / np.sqrt(value))
    return out, value / np.trace(cov)


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_whitening_equals_numpy(spark, size):
    rng = np.random.default_rng(11)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [3, 2.5, 2, 1, 0.5, 0.4] * size]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # copies are fitted once
    rows += [(2000, None), (2001, [math.nan] * 6), (2002, [math.inf] + [0.0] * 5), (2003, [None] + [0.0] * 5), (2004, [-0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("N", F.lit("clash")).withColumn("_row", F.lit(1)).repartition(5)
    want, explained = by_numpy(rows)
    got = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    assert set(got) == set(want)
    sign = np.sign(np.sum([np.array(r["whitened"]) * want[i][2] for i, r in got.items()], axis=0))
    for i, r in got.items():
        assert r["n"] == want[i][0]
        assert r["deviation"] == (want[i][1] if want[i][1] < 1 << 63 else None)
        assert np.allclose(np.array(r["whitened"]) * sign, want[i][2], rtol=1e-7, atol=1e-7)
        assert np.allclose(r["explained"], explained, rtol=1e-9) and r["identity_error"] < 1e-9 and r["_row"] == 1


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])], kind)).collect()
    assert len(one) == 3 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] == [None, None] and r["explained"] == [None, None] and r["identity_error"] is None for r in one)
    mixed = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.5, 3.0]), (3, [1.0]), (4, [2.0]), (5, [])], kind)).collect()
    got = {r["vec_id"]: r for r in mixed}
    assert got[1]["n"] == 2 and got[3]["n"] == 2 and got[5]["whitened"] == [] and got[5]["identity_error"] is None
    assert got[1]["whitened"][1] is None and abs(abs(got[1]["whitened"][0]) - 1) < 1e-12 and abs(got[1]["explained"][0] - 1) < 1e-12
    assert abs(abs(got[3]["whitened"][0]) - 1) < 1e-12


def test_query_returns_a_row_for_each_component(spark, data):
    rows = whitening.op11_polarised_whitening(spark, data).collect()
    assert {r["component"] for r in rows} == {1, 2, 3, 4} and all(r["identity_error"] < 1e-4 for r in rows)


# 12 BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def own_texts():
    odd = ["  a b\n\n c  \n", "hi <|endoftext|> there's\t\tq\r\nz 'tis we'll  I'M", "\n", "a  \nb c　 d\u0085e", "  ", "x", " ", "\x1c\x1d \x1e", "日本語のテキスト １２３", "ﬁ ½ ² Ⅷ", "\U0001f600\U0001f468‍\U0001f469 é", "࢏ \U00011de0 \U0002ceb0"]
    odd += ["=" * 700, "ab" * 900, " " * 500 + "end", "".join(chr(97 + i * i % 26) for i in range(1500)), "\0 nul \0\0", "z" * 3]
    return [None, "", *odd, "word " * 5000, " ".join(f"w{i * 7919 % 5003}x" for i in range(20000))]


def test_encoding_equals_the_library(spark, library):
    rows = list(enumerate(own_texts())) + [(None, "no id here"), (1000, "twice over"), (1000, "twice over")]
    df = spark.createDataFrame(rows, DOCS).withColumn("IDS", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)
    got = bpe.decode(bpe.encode(df, back="BACK")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == bytes(r["BACK"]) == (r["text"] or "").encode() and r["a.b"] == 1
    assert bpe.encode(df.limit(0)).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids binary")).first()["decoded"] is None


def test_words_beyond_the_head_are_folded_where_they_lie(spark, library, monkeypatch):
    texts = [" ".join(f"qz{i * k % 97}vv" for i in range(1, 60)) for k in range(1, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for head in (0, 5, 40, 1 << 20):
        monkeypatch.setattr(bpe, "HEAD", head)
        for r in bpe.encode(df).collect():
            assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"])


def test_encoding_keeps_void_columns(spark):
    df = spark.createDataFrame([(1, "a qzvvx"), (2, None)], DOCS).withColumn("void", F.lit(None))
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "text", "void", "ids"] and got.dtypes[2][1] == "void"
    assert [(r["doc_id"], r["text"], r["void"]) for r in got.orderBy("doc_id").collect()] == [(1, "a qzvvx", None), (2, None, None)]


def test_no_task_of_encoding_keeps_two_python_steps(spark):
    df = spark.createDataFrame([(1, "qzvvx wkkjq"), (2, None)], DOCS)
    plan = bpe.encode(df, back="back")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # counted: a second one would keep a process of its own


def test_known_words_of_equal_hashes_are_told_apart():
    known, own = pa.array([b"a", b"b", b"c"]), np.sort(bpe.hashes(["a", "b", "c"]))
    order = np.argsort(bpe.hashes(known.to_pylist()))
    words = ["c", "x", "a", "b", "\u00e9", ""]
    at = bpe.place_of(words, pa.array(words).cast(pa.binary()), known.take(pa.array(order)), own)
    assert [None if i < 0 else "abc"[order[i]] for i in at] == ["c", None, "a", "b", None, None]
    same = np.full(3, bpe.hashes(["b"])[0])  # all hashes meet
    assert bpe.place_of(["b", "a"], pa.array([b"b", b"a"]), known, same).tolist() == [-1, -1]
    assert bpe.place_of([], pa.array([], pa.binary()), known, own).tolist() == []


def test_ids_outside_the_vocabulary_are_errors():
    pieces = bpe.pieces_of({b"a": 0, b"bc": 2})
    run = lambda *ids: np.array(ids, "<u4").tobytes()
    assert bpe.joined(pieces, [run(), run(0, 2, 2), run(2)]) == [b"", b"abcbc", b"bc"] and bpe.joined(pieces, [run()]) == [b""] and bpe.joined(pieces, []) == []
    for x in (1, 3, 1 << 31):
        with pytest.raises((ValueError, IndexError)):
            bpe.joined(pieces, [run(0, x)])


def test_bpe_query_equals_the_library(spark, data, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = bpe.op12_byte_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# 13 search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs if terms(t)]
    n, size = len(bags), sum(len(w) for _, w in bags)
    asked = {}
    for i, t in items:
        if t is not None and (i not in asked or t < asked[i]):
            asked[i] = t
    out = []
    for item, t in asked.items():
        found = []
        for place, (d, w) in enumerate(bags):
            m, score = 25 + 75 * len(w) * n // size, 0
            for x in terms(t):
                if tf := w.count(x):
                    df = sum(x in v for _, v in bags)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, place))
        out += [(item, r, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(13)
    words = [f"t{i}" for i in range(40)] + ["Über", "ÜBER", "naïve", "x" * 300]
    text = lambda n: " ".join(words[int(j)] for j in rng.zipf(1.4, n) % len(words))
    docs = [(i, text(int(rng.integers(1, 30)))) for i in range(150)]
    docs += [(1000 - i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (7, docs[3][1].upper()), (7, docs[3][1]), (2000, None), (2001, ""), (2002, " .,\n"), (2003, "t1 " * 9000), (2004, "a-b_c`t2"), (2005, "only zzz here")]
    items = [(i, text(12)) for i in range(12)] + [(5, "t3 t3 T3 t5"), (5, "zz later"), (12, None), (13, ""), (14, "absent words"), (None, "t1 t2 über"), (15, words[-1] + " naïve")]
    for parts in (1, 7):
        df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(1)).repartition(parts)
        asked = spark.createDataFrame(items + items[:3], "item_id long, text string")
        got = search.search(df, asked).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got), key=str) == brute_search(docs, items)
    assert search.search(df.limit(0), asked).count() == 0 and search.search(df, asked.limit(0)).count() == 0


def test_search_in_blocks_and_with_clashing_hashes(spark, data, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(search, "TILE", 500)
    check(spark, data, search.op13_bag_search, search.OP13_SQL)


def test_terms_are_compared_byte_by_byte():
    v = search.Vocabulary([b"alpha", b"beta", b"gamma"])
    v.hash[:] = v.hash[0]  # all hashes meet
    c = search.Chunk([b"Beta alpha delta gamma alphb"], search.spaces(search.NOT_TERMS), search.Powers(), search.ASCII_LOWER)
    c.hash[:] = v.hash[0]
    assert v.numbers(c).tolist() == [1, 0, -1, 2, -1]
