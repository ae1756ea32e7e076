"""The relation of JSON values against a recursive walk in Python, on random documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions.locators import GENERIC_KEYS, PAGE_KEYS, PAGE_TYPES
from folioflow.operators import json_walk

NAMES = ["a", "type", "value", "page", "basis", "text", "Zz", "é"]


def made(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.35:
        return {n: made(rng, depth + 1) for n in rng.sample(NAMES, rng.randint(0, 4))}
    if depth < 4 and kind < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 0, -7, 12345678901, "x", " y ", "", "null", "page", "chapter", "né\n\"q\""])


def every(value, path="$", parent=None, name=None, of_page=False):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    text = None if kind in ("object", "array", "null") else json.dumps(value) if kind != "string" else value
    yield path, parent, name, kind, text, of_page
    if kind == "object":
        page = of_page or value.get("type") in [t for t in PAGE_TYPES]
        for k, v in value.items():
            yield from every(v, f"{path}.{k}", path, k, page or k in PAGE_KEYS + GENERIC_KEYS)
    if kind == "array":
        for k, v in enumerate(value):
            yield from every(v, f"{path}[{k}]", path, None, of_page)


def tokens(value, path=""):
    """What a locator says, as a set."""
    if isinstance(value, list):
        return {t for k, v in enumerate(value) for t in tokens(v, f"{path}[{k}]")}
    if not isinstance(value, dict):
        said = "" if value is None else (value if isinstance(value, str) else json.dumps(value)).strip()
        return {f"{path}={said}"} if said not in ("", "null") else set()
    kind, out = value.get("type"), set()
    if isinstance(kind, str) and kind in PAGE_TYPES:
        return out
    for k, v in value.items():
        at = f"{path}.{k}" if path else k
        if k in PAGE_KEYS + GENERIC_KEYS or (k == "type" and isinstance(kind, str) and "value" in value):
            continue
        own = tokens(v, at)
        if k == "value" and isinstance(kind, str) and not isinstance(v, (dict, list)) and own:
            own |= {f"{path or 'locator'}.type={kind}"}
        out |= own
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(6)
    return [(k, made(rng)) for k in range(150)] + [(500, {"a": [[{"text": 1, "b": {"text": [{"text": {}}]}}]]}), (501, [])]


@pytest.fixture(scope="module")
def values(spark, documents):
    rows = [(k, json.dumps(d, ensure_ascii=False)) for k, d in documents] + [(900, None), (901, "{broken"), (902, "")]
    return json_walk.walk(spark.createDataFrame(rows, "id long, doc string"), "id", "doc")


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_walk(values, documents):
    got = values.select("id", "path", "parent", "name", "kind", "text", "of_page").collect()
    assert by_text(got) == by_text((k, *row) for k, d in documents for row in every(d))


def test_forbidden_keys(values, documents):
    got = json_walk.forbidden(values, "id", ["text", "Zz"]).collect()
    assert by_text(got) == by_text((k, row[0]) for k, d in documents for row in every(d) if row[2] in ("text", "Zz")) and len(got) > 20


def test_closed_world(values, documents):
    got = json_walk.open_world(values, "id", "$", ["a", "text"]).collect()
    want = [(k, n, "missing") for k, d in documents if isinstance(d, dict) for n in ("a", "text") if n not in d]
    want += [(k, n, "unexpected") for k, d in documents if isinstance(d, dict) for n in d if n not in ("a", "text")]
    assert by_text(got) == by_text(want)


def test_locator_tokens(values, documents):
    got = json_walk.locator_tokens(values, "id").collect()
    assert by_text(got) == by_text((k, t) for k, d in documents for t in tokens(d))


def test_canonical(spark, documents):
    texts = [json.dumps(d, indent=1) for _, d in documents] + ['{"b": 1.0, "a": [1e3, 0.5, -0.0, 1e22, 1e-7], "é": "é"}', None, "{", "NaN", '{"x": 1, "x": 2}']
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", json_walk.canonical("t").alias("c"), json_walk.canonical_hash("t").alias("h")).orderBy("id").collect()
    whole = lambda x: {k: whole(v) for k, v in x.items()} if isinstance(x, dict) else [whole(v) for v in x] if isinstance(x, list) else int(x) if isinstance(x, float) and x == int(x) else x
    for row, text in zip(got, texts, strict=True):
        if text in (None, "{", "NaN"):
            assert row.c is None and row.h is None
        else:
            assert row.c == json.dumps(whole(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got[len(documents)].c == '{"a":[1000,0.5,0,10000000000000000000000,1e-07],"b":1,"é":"é"}'


def test_nothing(spark):
    got = json_walk.walk(spark.createDataFrame([], "id long, doc string"), "id", "doc")
    assert got.count() == 0 and "text" in got.columns and got.select(F.count("*")).first()[0] == 0
