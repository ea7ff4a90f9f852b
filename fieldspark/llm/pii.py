"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; checks confirm them (parts of an address at
most 255, the Luhn sum of a card, length by country and mod 97 of an IBAN, digit
counts of a phone number, areas, groups and serials of a social security number that
are given out, prefix and length of keys, a mixture of letters and digits of other
secrets); words nearby move a span's score.  Spans of the base kinds (email, ip,
card, phone) always stay once confirmed; those of other kinds (iban, ssn, api_key,
secret) need a score of ``least``.

Positions count code points from 0, ends are exclusive.  The patterns are
written so that a failed attempt is not repeated inside the same run of
characters: each takes time in proportion to the text, and none recurses over
its length.  Spark's split() and regexp_extract_all() see the same matches, so
a match starts after all pieces and matches before it.

Defined results: a null or empty text has no spans; repeated rows are judged
alike, one result each; an empty table gives an empty result.  Columns named
as a result column are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import column, others

BASE_KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind: (pattern, score of a confirmed span, words that raise it)
KINDS = {
    # Starts: where a run of local-part characters starts, or where the last match ended.
    "email": (rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail contact"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip address host server"),
    # A whole chain of digits with single blanks or hyphens between them, of 13 to 19 digits.
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", 0.8, "card visa credit payment"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone tel call mobile fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, "iban account bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn social security"),
    # Keys of a fixed prefix and length.
    "api_key": (r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abp]-[A-Za-z0-9-]{20,72}|sk-[A-Za-z0-9]{32,64})(?![A-Za-z0-9_-])", 0.9, "key token secret"),
    # A long run of letters and digits that words nearby call a secret.
    "secret": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,128}(?![A-Za-z0-9+/_-])", 0.3, "token secret password passwd api key bearer credential"),
}
# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: A text without a match of this has no match of the pattern.
HINTS = {"email": "@", "phone": "+", "ssn": "-"}
EMPTY = "array<struct<kind:string,start:int,end:int,value:string>>"


def located(text: Column, kind: str, pieces: Column, hits: Column) -> Column:
    zipped = F.arrays_zip(pieces.alias("p"), hits.alias("h"))
    span = lambda at, z: F.struct(F.lit(kind).alias("kind"), (at + F.length(z["p"])).alias("start"), (at + F.length(z["p"]) + F.length(z["h"])).alias("end"), z["h"].alias("value"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out"))
    walk = F.aggregate(
        zipped,
        first,
        lambda acc, z: F.struct(
            (acc["at"] + F.length(z["p"]) + F.coalesce(F.length(z["h"]), F.lit(0))).alias("at"),
            F.when(z["h"].isNotNull(), F.concat(acc["out"], F.array(span(acc["at"], z)))).otherwise(acc["out"]).cast(EMPTY).alias("out"),
        ),
    )
    return F.when(F.size(hits) > 0, walk["out"]).otherwise(F.array().cast(EMPTY))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right doubles, less 9 if above 9; the sum ends in 0."""
    n = F.length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(number, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def mod97(value: Column) -> Column:
    """The first four characters go last, letters count from 10; the remainder is 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    code = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    step = lambda acc, i: (acc * F.when(F.substr(turned, i, F.lit(1)) >= "A", 100).otherwise(10) + code(F.substr(turned, i, F.lit(1)))) % 97
    length = F.try_element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), F.substr(plain, F.lit(1), F.lit(2)))
    return F.coalesce(F.length(plain) == length, F.lit(False)) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)
    return F.lit(True)


def scored(text: Column, span: Column, kind: str, reach: int) -> Column:
    _, base, words = KINDS[kind]
    near = F.lower(F.concat_ws(" ", F.substr(text, F.greatest(span["start"] - reach + 1, F.lit(1)), F.least(F.lit(reach), span["start"])), F.substr(text, span["end"] + 1, F.lit(reach))))
    return F.least(F.lit(1.0), F.lit(base) + F.when(near.rlike("|".join(words.split())), 0.3).otherwise(0.0))


def find_personal_data(df: DataFrame, text: str = "text", least: float = 0.6, reach: int = 40, to: str = "pii_spans") -> DataFrame:
    """Adds an array of (kind, start, end, value, score), by kind as listed, then start."""
    t = F.coalesce(column(text), F.lit(""))
    kept = others(df, to.lower())
    out = df.select(F.struct(*map(column, kept)).alias("_row"), t.alias("_pii_text"))
    for kind, (pattern, _, _) in KINDS.items():
        may = F.instr("_pii_text", HINTS[kind]) > 0 if kind in HINTS else F.lit(True)
        out = out.withColumn(f"_pii_{kind}", F.when(may, F.regexp_extract_all("_pii_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind, (pattern, _, _) in KINDS.items():
        hits = F.col(f"_pii_{kind}")
        pieces = F.when(F.size(hits) > 0, F.split("_pii_text", pattern, -1))
        found = located(F.col("_pii_text"), kind, pieces, hits)
        out = out.withColumn(f"_pii_{kind}", F.filter(found, lambda s: confirmed(kind, s["value"])))  # noqa: B023
    spans = []
    for kind in KINDS:
        with_score = F.transform(F.col(f"_pii_{kind}"), lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"], scored(F.col("_pii_text"), s, kind, reach).alias("score")))  # noqa: B023
        spans.append(with_score if kind in BASE_KINDS else F.filter(with_score, lambda s: s["score"] >= least))
    return out.select("_row.*", F.concat(*spans).alias(to))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    s = F.col("pii_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE_KINDS))
    more = [k for k in KINDS if k not in BASE_KINDS]
    scores = F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(s).alias("spans"), *map(count, more), scores)
