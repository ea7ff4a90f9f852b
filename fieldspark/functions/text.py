"""Tags, labels and model text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Height in metres by kind of building.
TYPE_HEIGHTS = {
    "yes": 12.0, "building": 12.0,
    "house": 6.0, "detached": 6.0, "bungalow": 6.0, "cabin": 6.0,
    "apartments": 12.0, "residential": 12.0, "terrace": 12.0,
    "commercial": 15.0, "retail": 15.0, "office": 15.0,
    "industrial": 10.0, "warehouse": 10.0,
    "church": 20.0, "cathedral": 20.0,
    "tower": 40.0, "highrise": 40.0,
}
# Material by its own tag, by kind of building, and by words of the construction.
MATERIAL_TAGS = {"wood": ("wood", "timber", "log"), "concrete": ("concrete", "cinder_block", "cinderblock"), "brick": ("brick", "stone", "masonry"), "metal": ("metal", "steel", "corrugated_steel", "tin"), "glass": ("glass", "glazing")}
MATERIAL_KINDS = {"wood": ("residential", "house", "detached", "semi", "terrace", "bungalow"), "concrete": ("apartments", "commercial", "retail", "office", "hotel"), "metal": ("industrial", "warehouse", "factory", "hangar")}
MATERIAL_WORDS = {"wood": ("wood", "timber", "frame"), "concrete": ("concrete", "cinder"), "brick": ("brick", "masonry"), "metal": ("metal", "steel")}
# Kind of obstacle by words of a label, and scenes that a text may name.
LABEL_WORDS = {"building": ("build",), "house": ("house",), "trees": ("tree", "forest"), "large_structure": ("structure", "tower", "bridge")}
SCENES = ("indoor", "outdoor", "kitchen", "bedroom", "street", "office")
SCENE = "scene_type string, objects array<struct<label:string,direction:string,confidence:double>>, hazards array<string>, summary string"


def leading_number(x: Column) -> Column:
    """The first word of a text as a number, without a unit of metres."""
    return F.replace(F.regexp_extract(F.trim(x), r"^\S+", 0), F.lit("m"), F.lit("")).try_cast("double")


def building_height_m(tags: Column) -> Column:
    """An explicit height above half a metre, else three metres a level, else the kind's height, else null."""
    tried = []
    for k in ("height", "building:height"):
        h = leading_number(F.try_element_at(tags, F.lit(k)))
        tried.append(F.when(h > 0.5, h))
    for k in ("building:levels", "levels"):
        n = leading_number(F.try_element_at(tags, F.lit(k)))
        tried.append(F.when(n > 0, n * 3.0))
    kind = F.trim(F.lower(F.try_element_at(tags, F.lit("building"))))
    default = F.lit(None).cast("double")
    for name, metres in TYPE_HEIGHTS.items():
        default = F.when(kind == name, metres).otherwise(default)
    return F.coalesce(*tried, default)


def other_tags(x: Column) -> Column:
    """A text of quoted keys and values, "key"=>"value", as a map; of repeated keys the last counts."""
    quoted = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
    keys, values = (F.regexp_extract_all(x, F.lit(quoted + "=>" + quoted), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    names = F.array_distinct(keys)
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
    return F.map_from_arrays(F.coalesce(names, F.array().cast("array<string>")), F.coalesce(last, F.array().cast("array<string>")))


def by_words(x: Column, table: dict, test) -> Column:
    """The first name one of whose words passes ``test(x, word)``; null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(table.items()):
        out = F.when(test(x, words), name).otherwise(out)
    return out


def is_one(x: Column, words: tuple) -> Column:
    return x.isin(*words)


def holds(x: Column, words: tuple) -> Column:
    return x.rlike("|".join(words))


def building_material(tags: Column) -> Column:
    """The material tag's, else that of the kind of building, else by words of the construction, else unknown."""
    tag = lambda k: F.lower(F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")))
    return F.coalesce(by_words(tag("building:material"), MATERIAL_TAGS, is_one), by_words(tag("building"), MATERIAL_KINDS, is_one), by_words(tag("building:construction"), MATERIAL_WORDS, holds), F.lit("unknown"))


def obstacle_kind(label: Column) -> Column:
    return F.coalesce(by_words(F.lower(label), LABEL_WORDS, holds), F.lit("unknown"))


def angle_span(azimuth: Column, width: Column) -> tuple[Column, Column]:
    """First and last bearing of a sector."""
    return F.pmod(azimuth - width / 2, F.lit(360.0)), F.pmod(azimuth + width / 2, F.lit(360.0))


def folded_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def scene(text: Column) -> Column:
    """The JSON object between the first and last brace of a model's text; without one, a scene named in the text and its first 500 characters."""
    found = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), SCENE)
    stated = F.regexp_extract(text, r"(?i)scene[_\s]type[:\s]+([^\n]+)", 1)
    named = F.coalesce(F.nullif(F.trim(stated), F.lit("")), F.nullif(F.regexp_extract(text, "(?i)(" + "|".join(SCENES) + ")", 1), F.lit("")))
    empty = F.struct(F.coalesce(named, F.lit("unknown")).alias("scene_type"), F.array().cast("array<struct<label:string,direction:string,confidence:double>>").alias("objects"), F.array().cast("array<string>").alias("hazards"), F.substring(text, 1, 500).alias("summary"))
    good = found.isNotNull() & (found["scene_type"].isNotNull() | found["summary"].isNotNull() | found["objects"].isNotNull())
    return F.when(good, found).otherwise(empty)


def arfcn_mhz(n: Column) -> Column:
    return 3000 + 0.015 * (n - 600_000)
