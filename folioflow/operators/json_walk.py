"""JSON of any shape as a relation of its values, and its canonical text.

A document is exploded level by level; each level is one pass over the containers of the last, so there are as many
passes as the deepest document has levels, whatever the number of documents. What asks for keys or values at any depth reads that one
relation: forbidden keys, closed sets of keys, tokens of locators.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioflow import scratch
from folioflow.functions.locators import GENERIC_KEYS, PAGE_KEYS, PAGE_TYPES

ROOT = "$"


def walk(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, path, parent, name, kind, text, of_page)`` of each value of the JSON texts in ``column``, the whole document as ``$``.

    ``name`` is a field's name and null for an element of an array; ``kind`` is object, array, string, number, boolean or null; ``text``
    is a scalar's own text. ``of_page`` tells values below an object whose type is a page, or below a field with a page's or a generic name. Null and broken
    texts have no values.
    """
    with scratch.Room(rows.sparkSession) as room:
        start = rows.select(F.col(key).alias("key_"), F.lit(ROOT).alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("of_page"), F.try_parse_json(column).alias("value"))
        level = room.stage(_told(start.filter("value IS NOT NULL")), "json")
        levels = [level]
        while level.filter("kind IN ('object', 'array')").limit(1).count():
            level = room.stage(_told(_below(level)), "json")
            levels.append(level)
        every = reduce(DataFrame.unionByName, levels).drop("value", "page").withColumnRenamed("key_", key)
        return scratch.stage(every, "json-values")


def _told(level: DataFrame) -> DataFrame:
    found = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    kind = F.when(found == "OBJECT", "object").when(found == "ARRAY", "array").when(found == "STRING", "string").when(found == "BOOLEAN", "boolean").when(found == "VOID", "null").otherwise("number")
    out = level.withColumn("kind", kind)
    scalar = F.col("kind").isin("string", "number", "boolean")
    out = out.withColumn("text", F.when(scalar, F.variant_get("value", "$", "string")))
    said = F.when(F.col("kind") == "object", F.try_variant_get("value", "$.type", "string"))
    return out.withColumn("page", F.col("of_page") | F.coalesce(said.isin(*PAGE_TYPES), F.lit(False)))


def _below(level: DataFrame) -> DataFrame:
    spread = level.sparkSession.sql("SELECT t.key_, t.path AS parent, t.page, e.pos, e.key AS name, e.value FROM {level} t, LATERAL variant_explode(t.value) e", level=level.filter("kind IN ('object', 'array')"))
    path = F.when(F.col("name").isNull(), F.concat("parent", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("parent", F.lit("."), "name"))
    skipped = F.coalesce(F.col("name").isin(*PAGE_KEYS, *GENERIC_KEYS), F.lit(False))
    return spread.select("key_", path.alias("path"), "parent", "name", (F.col("page") | skipped).alias("of_page"), "value")


def forbidden(values: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``(key, path)`` of all fields with one of ``names``, at any depth."""
    return values.filter(F.col("name").isin(*names)).select(key, "path")


def open_world(values: DataFrame, key: str, path: str, expected: list[str]) -> DataFrame:
    """``(key, name, side)``: fields of the object at ``path`` that are missing or unexpected."""
    own = values.filter((F.col("parent") == path) & F.col("name").isNotNull()).select(key, "name")
    wanted = values.filter((F.col("path") == path) & (F.col("kind") == "object")).select(key, F.explode(F.array(*map(F.lit, expected))).alias("name"))
    missing = wanted.join(own, [key, "name"], "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(own.filter(~F.col("name").isin(*expected)).withColumn("side", F.lit("unexpected")))


def locator_tokens(values: DataFrame, key: str) -> DataFrame:
    """``(key, token)``: ``path=value`` of what locators of any shape say besides pages, each once.

    The value of an object with a type and a value comes with its type.
    """
    path = F.regexp_replace("path", r"^\$\.?", "")
    scalars = values.filter("NOT of_page AND kind IN ('string', 'number', 'boolean')").withColumn("said", F.trim("text")).filter("said NOT IN ('', 'null')")
    typed = values.filter("name = 'type' AND kind = 'string'").select(key, "parent", F.col("text").alias("typed"))
    valued = scalars.filter("name = 'value'").join(typed, [key, "parent"])
    at = F.regexp_replace("parent", r"^\$\.?", "")
    kinds = valued.select(key, F.concat(F.when(at == "", "locator").otherwise(at), F.lit(".type="), "typed").alias("token"))
    bare = values.filter("name = 'value'").select(key, "parent").join(typed, [key, "parent"]).select(key, F.concat("parent", F.lit(".type")).alias("path"))
    plain = scalars.join(bare, [key, "path"], "left_anti").select(key, F.concat(path, F.lit("="), "said").alias("token"))
    return plain.unionByName(kinds).distinct()


def _whole(value):
    """Integral floats as integers, at any depth."""
    if isinstance(value, dict):
        return {k: _whole(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_whole(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def canonical_text(text: str | None) -> str | None:
    """Keys sorted by code point, integral numbers as integers, no spaces; null for null, broken texts and numbers that JSON has not."""
    try:
        return None if text is None else json.dumps(_whole(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except ValueError:
        return None


def canonical(column) -> Column:
    """``canonical_text`` of a column, in Arrow batches."""

    def apply(values: pd.Series) -> pd.Series:
        return values.map(canonical_text)

    return F.pandas_udf(apply, "string")(column)


def canonical_hash(column) -> Column:
    return F.sha2(canonical(column), 256)
