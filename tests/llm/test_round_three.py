"""Periodic runs, the n-gram join and collocations: against brute force, and on nulls, long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ngram_join, periodic_runs, phrases, sharding
from folioflow.llm.near_dedup import FIVE_WORDS, Measure

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def save(df, tmp_path, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def clashing(df, names):
    return df.withColumns({c: F.lit(7) for c in names.split()})


# periodic runs


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            stretch = w[i : j + p]
            if j > i and len(stretch) >= max(6, 4 * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.append((i, len(stretch), p))
            i = max(j, i) + 1
    return sorted(out)


def periodic(rng):
    n, a = rng.randint(0, 150), rng.choice([0, 1, 2, 4, 20])
    w = [rng.randint(0, a) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 8:
            start, p, length = rng.randrange(n), rng.randint(1, 14), rng.randint(1, 90)
            for i in range(start + p, min(n, start + length)):
                w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(3000):
        w = periodic(rng)
        assert periodic_runs.runs(np.array(w, np.int32)) == brute_runs(w)


@pytest.mark.parametrize(
    ("made", "runs"),
    [
        (np.zeros(100_000, np.int32), [(0, 100_000, 1)]),
        (np.tile(np.arange(1000), 50).astype(np.int32), [(0, 50_000, 1000)]),
        (np.where(np.arange(60_000) % 500 == 499, 1, 0).astype(np.int32), None),
        (np.arange(50_000, dtype=np.int32), []),
    ],
)
def test_long_texts(made, runs):
    found = periodic_runs.runs(made)
    if runs is None:
        assert (0, 60_000, 500) in found and sum(p == 1 for _, _, p in found) == 120 and len(found) == 121
    else:
        assert found == runs


def brute_op11(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), start, length, period, best and 1000 * length // period,
        digest("".join(f"{s},{k},{p}\n" for s, k, p in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" \n".join(f"w{x}" for x in periodic(rng)) for _ in range(150)]
    texts += ["", None, " \t\r\n", "á  x  á", "Of of Of of Of of", "x " * 4000, texts[3], texts[3]]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    df = clashing(spark.createDataFrame([*rows, rows[7]], COLUMNS), "start length period runs best lines words h g n a collapsed")
    got = periodic_runs.op11_periodic_runs(spark, save(df, tmp_path, "documents"))
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted((brute_op11(k, t) for k, t, *_ in [*rows, rows[7]]), key=key)
    assert [t for _, t in got.dtypes][:6] == ["bigint"] * 6


def test_op11_without_ids_and_rows(spark, nothing, tmp_path):
    assert periodic_runs.op11_periodic_runs(spark, save(nothing, tmp_path, "documents")).count() == 0
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([(None, "a b a b a b a b a", None, None, 1)], COLUMNS)).collect()
    assert (row.doc_id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (None, 9, [(0, 9, 2)], "a b")


# n-gram join


def brute_components(rows, k=5, percent=80):
    sets = {}
    for doc_id, text in rows:
        w = words((text or "").translate(LOWER))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(doc_id, []).append(own)
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    out = []
    for doc_id, text in rows:
        w = words((text or "").translate(LOWER))
        n = len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) if len(w) >= k else int(bool(w))
        out.append((doc_id, n, doc_id if doc_id is None else root(doc_id)))
    return sorted(out, key=str)


def corpus(seed, families=6, copies=14):
    """Families of copies at all distances, copies of copies, equal texts and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(8, 120))]
        family = [base]
        for _ in range(copies):
            copy = list(rng.choice(family))
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = word()
            family.append(copy)
        texts += family
    for _ in range(25):
        texts.append(passage + [word() for _ in range(rng.randint(0, 40))])
    texts += [texts[0], texts[0], [word() for _ in range(3000)], texts[4][:4], texts[4][:4]]
    out = [" ".join(t) for t in texts]
    out += ["", None, " \n ", "One Two", "one TWO", out[3].upper(), "naïve ÜNÏ ção ende gut", "naïve ünï ção ende gut"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "light"), [(1, 16), (2, 3), (3, 1)])
def test_join_equals_brute_force(spark, monkeypatch, seed, light):
    """With few light groups, what is left goes through families and blocks."""
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "ROWS", 12)
    rows = corpus(seed)
    rows += [(rows[2][0], rows[9][1]), (None, rows[5][1]), rows[6]]
    df = clashing(spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], COLUMNS), "node token part need tokens n gone_ key_ maybe_ component")
    assert sorted(map(tuple, ngram_join.joined(df).collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("how", [Measure(3, 60, 5), Measure(2, 95, 5), FIVE_WORDS])
def test_prefixes_lose_no_pair(how):
    """Whatever the counts, sets that are as similar as asked share the lesser number of matches."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        counts = rng.integers(0, rng.choice([1, 3, 1000]), ngram_join.COUNTERS >> 10).astype(np.uint32)
        counts = np.resize(counts, ngram_join.COUNTERS)
        base = rng.choice(5000, rng.integers(1, 120), replace=False)
        one = np.unique(np.concatenate([base, rng.integers(0, 5000, rng.integers(0, 20))])).astype(np.uint64)
        two = np.unique(np.concatenate([base, rng.integers(0, 5000, rng.integers(0, 20))])).astype(np.uint64)
        common = len(np.intersect1d(one, two))
        if 100 * common >= how.percent * (len(one) + len(two) - common):
            (m, _, x), (k, _, y) = (ngram_join.prefix(s, counts, how.percent) for s in (one, two))
            shared = len(np.intersect1d(x, y))
            assert shared >= min(m, k)
            rest = max(len(one) - len(x), len(two) - len(y))
            assert (100 + how.percent) * (shared + rest) >= how.percent * (len(one) + len(two))


def test_costly_prefixes_ask_for_more_matches():
    shingles = np.arange(100, dtype=np.uint64)
    assert ngram_join.prefix(shingles, np.zeros(ngram_join.COUNTERS, np.uint32), 80)[0] == 1
    assert ngram_join.prefix(shingles, np.full(ngram_join.COUNTERS, 1000, np.uint32), 80)[0] > 1


def test_join_of_nothing(spark, nothing, tmp_path):
    assert ngram_join.op12_ngram_join(spark, save(nothing, tmp_path, "documents")).count() == 0
    empty = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0)], COLUMNS)
    assert sorted(map(tuple, ngram_join.joined(empty).collect())) == [(1, 0, 1), (2, 0, 2)]


# collocations


def brute_collocations(rows, least, cover=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = {(lang, w[i : i + 2]) for (lang, w), a in candidates.items() if len(w) == 3 for i in (0, 1) if 100 * a >= cover * f[lang, w[i : i + 2]]}
    out = []
    for lang in sorted(n):
        scored = []
        for (own, w), a in candidates.items():
            if own == lang and (own, w) not in dropped:
                score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return out


def prose(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "naïve", "Ünï", "b", "a", " ", "x\x1cy", "İ", "𝔘", ""]
    return [
        (rng.choice(["en", "de", None, "ä"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", ";:"]) for _ in range(rng.randint(0, 80))))
        for _ in range(200)
    ]


@pytest.mark.parametrize("slice_bytes", [4 << 20, 300])
def test_collocations_equal_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    rows = [*prose(2), ("en", None), ("en", ""), ("fr", "only once"), (None, "the of " * 5000)]
    df = clashing(spark.createDataFrame([(k, t, lang, None, 1) for k, (lang, t) in enumerate([*rows, rows[1]])], COLUMNS), "phrase f hash a l r k n score rank most left right")
    columns = "lang rank phrase a l r n score".split()
    got = sorted(map(tuple, phrases.collocations(df).select(columns).collect()))
    assert got == sorted(brute_collocations([*rows, rows[1]], 10))
    assert sorted(map(tuple, phrases.collocations(df, top=7).select(columns).collect())) == sorted(r for r in got if r[1] <= 7)


def test_longer_phrases(spark):
    """Four words: three cuts, and two levels that may cover."""
    df = spark.createDataFrame([(k, t, "en", None, 1) for k, t in enumerate(["a b c d.", "a b c d x", "c d e", "a b", "b c d a b c d"] * 3)], COLUMNS)
    got = {r.phrase: (r.a, r.score) for r in phrases.collocations(df, longest=4, least=3).collect()}
    assert got["a b c d"] == (9, min(81_000_000 // (x * y) for x, y in ((12, 12), (12, 15), (9, 15))))
    assert "a b c" not in got and "b c" not in got


def test_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a long, l long, r long").select(F.expr(phrases.SCORE).alias("s")).first()
    assert row.s == 1_000_000 * 3**2 * 10**24 // (4 * 5 * 10**24)


def test_bits_set_by_chance_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(k, t, lang, None, 1) for k, (lang, t) in enumerate(prose(3))], COLUMNS)
    right = sorted(map(tuple, phrases.collocations(df).collect()))
    monkeypatch.setattr(phrases.membership, "has", lambda bits, hashes: np.ones(len(hashes), bool))
    assert right and sorted(map(tuple, phrases.collocations(df).collect())) == right


def test_collocations_of_nothing(spark, nothing, tmp_path):
    assert phrases.op13_collocations(spark, save(nothing, tmp_path, "documents")).count() == 0


@pytest.mark.parametrize("module", [ngram_join, phrases])
def test_sql_gives_the_same_rows(spark, data, module):
    """On the given small tables."""
    query = {ngram_join: "op12_ngram_join", phrases: "op13_collocations"}[module]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    want = con.execute(module.SQL)
    names = [c[0] for c in want.description]
    got = getattr(module, query)(spark, data).select(names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_slot_map_equals_a_fold(spark):
    """The largest slot that is left goes to the shard with the fewest bytes, one after the other; ties go to lower numbers."""
    rng = random.Random(4)
    own = {slot: rng.choice([0, 16, 16, 300, rng.randint(1, 10**6)]) for slot in rng.sample(range(512), 400)}
    sizes = spark.createDataFrame([(s, b, 1) for s, b in own.items()], "virtual_slot int, bytes long, rows long")
    loads, want = [0] * 7, {}
    for slot in sorted(range(512), key=lambda s: (-own.get(s, 0), s)):
        shard = loads.index(min(loads))
        loads[shard] += max(own.get(slot, 0), 1)
        want[slot] = shard
    assert {r.virtual_slot: r.shard for r in sharding.balanced_map(sizes, 7, 512).collect()} == want
    grown = {r.virtual_slot: r.shard for r in sharding.grown_map(sharding.balanced_map(sizes, 7, 512), sizes, 7).collect()}
    assert all(grown[s] in (want[s], 7) for s in want) and 7 in grown.values()
