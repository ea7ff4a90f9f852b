"""URL filtering: rules first, else logistic regression on hashed character n-grams.

Host and path are cut with DataFrame functions.  A rule fits its host and all
subdomains when the path starts with the rule's path; the longest rule wins.
Without a rule the model decides: the mean weight of the n-grams of host and
path, each hashed with its field, plus a bias.  It is fitted by gradient descent
on a small labelled table (at most ``MOST_LABELLED`` rows are accepted; that
bound and the table of 2**BITS weights are all that is sent to the tasks).

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule that has a host, and is judged by the bias alone.  Repeated rows
give repeated results, an empty table an empty result.  Columns named as a
result column (in any case) are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import column, mix, others

BITS = 16
GRAMS = (2, 3, 4)
MOST_LABELLED = 10_000
RESULTS = ("host", "path", "rule", "block_score", "verdict")
#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LABELLED_URLS = tuple(
    [(u, 1) for u in """http://free-casino-bonus.example/slots/win
http://best-poker-bets.example/jackpot/now
http://hot-adult-cams.example/xxx/live
http://cheap-pills-rx.example/buy/viagra
http://win-prize-lottery.example/claim?id=1
http://xxx-video-tube.example/porn/clip
http://casino24.example/roulette/play
http://crack-keygen-warez.example/download/serial
http://adult-dating-sexy.example/chat/girls
http://payday-loan-fast.example/apply/cash
http://betting-odds-bonus.example/slots/spin
http://malware-crack.example/keygen/exe
http://replica-watches-cheap.example/buy/now
http://porn-hub-free.example/xxx/1
http://spam-seo-links.example/buy/backlinks
http://phish-login-verify.example/account/claim""".split()]
    + [(u, 0) for u in """http://news.example.com/world/article/12
http://www.example.org/about/team
http://docs.example.net/guide/install
http://library.example.edu/books/history
http://blog.example.com/2020/garden-notes
http://weather.example.org/forecast/city
http://example.com/en/science/5
http://example.net/fr/recettes/17
http://museum.example.org/es/arte/3
http://example.org/de/geschichte/22
http://shop.example.com/products/chairs
http://forum.example.net/topic/9914
http://university.example.edu/courses/math
http://health.example.org/advice/sleep
http://travel.example.com/guide/rome
http://code.example.net/project/readme""".split()]
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def features(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams and the row of each."""
    buckets, rows = [], []
    for field, texts in ((1, hosts), (2, paths)):
        texts = [b"^" + t + b"$" if t else b"" for t in texts]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        buf = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), lens)
        for n in GRAMS:
            m = max(0, len(buf) - n + 1)
            code = np.full(m, field * 8 + n, np.uint64)
            for j in range(n):
                code = code << np.uint64(8) | buf[j : j + m]
            same = row[:m] == row[n - 1 : n - 1 + m]
            buckets.append((mix(code[same]) >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(row[:m][same])
    return np.concatenate(buckets), np.concatenate(rows)


def mean_weight(weights: np.ndarray, buckets: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights[buckets], n) / np.maximum(1, np.bincount(rows, minlength=n))


def fit(hosts: list[str], paths: list[str], labels: list[int], steps: int = 300, rate: float = 30.0, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    n, y = len(labels), np.asarray(labels, float)
    buckets, rows = features([h.encode() for h in hosts], [p.encode() for p in paths])
    share = 1 / np.maximum(1, np.bincount(rows, minlength=n))
    w, bias = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(mean_weight(w, buckets, rows, n) + bias)))
        slope = (p - y) / max(1, n)
        w -= rate * (np.bincount(buckets, (slope * share)[rows], len(w)) + penalty * w / max(1, n))
        bias -= slope.sum()
    return w.astype(np.float32), bias


def judge_urls(df: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES, block_from: float = 0.5) -> DataFrame:
    """Adds host, path, rule, block_score and verdict.  ``labelled``: url, label (1: block)."""
    spark = df.sparkSession
    table = labelled.select(*[c.alias(n) for c, n in zip(host_path(F.col("url")), ("h", "p"), strict=True)], F.col("label").cast("int").alias("y")).filter("y IS NOT NULL").take(MOST_LABELLED + 1)
    if len(table) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    table.sort()
    model = spark.sparkContext.broadcast(fit([r.h for r in table], [r.p for r in table], [r.y for r in table]))

    @F.pandas_udf("double")
    def block_score(host: pd.Series, path: pd.Series) -> pd.Series:
        w, bias = model.value
        buckets, rows = features([h.encode() for h in host], [p.encode() for p in path])
        return pd.Series(1 / (1 + np.exp(-(mean_weight(w, buckets, rows, len(host)) + bias))))

    # the rows' own columns travel in a struct, so no name of theirs meets one of ours
    kept = others(df, *RESULTS)
    host, path = host_path(column(url))
    rows = df.select(F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(kept)), F.lit(0).alias("_")).alias("row"), host.alias("host"), path.alias("path"))
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule = F.lit(None).cast("string")
    said = F.lit(None).cast("string")
    for h, p, verdict in reversed(longest):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h)) if h else F.lit(True)) & F.startswith(F.col("path"), F.lit(p))
        rule, said = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(said)
    scored = rows.select("row", "host", "path", rule.alias("rule"), said.alias("said"), block_score("host", "path").alias("block_score"))
    verdict = F.coalesce("said", F.when(F.col("block_score") >= block_from, "block").otherwise("allow"))
    return scored.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), "host", "path", "rule", "block_score", verdict.alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(list(LABELLED_URLS), "url string, label int")).select("page_id", "host", "path", "rule", "verdict", "block_score")
