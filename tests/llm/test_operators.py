"""Each operator on small tables: against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import scratch
from folioflow.llm import decontamination, mixing, near_dedup, personal_data, quality, sharding, substring_dedup, token_output, toxicity, vector_search

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(1, 80)) for _ in range(40)]
    base += [base[3], base[3], base[5] + " Extra", base[7].upper(), "", "  \n\t", "Of Of Of Of", "naïve Ünï ção\x1cx", sentence(rng, 5000)]
    near = base[20].split()
    for k in range(6):
        copy = sentence(random.Random(9), 70).split()
        copy[k * 5] = f"edit{k}"
        base.append(" ".join(copy))
    return [*base, " ".join(near[:-1]), None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = ["a", "b", None, "ä", ""]
    rows = [(k, t, "en", sources[k % 5], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def awkward(docs):
    """A row twice, and columns named as those of results."""
    clash = {c: F.lit(7) for c in "size shard slot score kept taken target key_ id_ part_ label_ virtual_slot n_words base".split()}
    return docs.unionByName(docs.filter("doc_id IN (3, 56)")).withColumns(clash)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def save(df, tmp_path, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_token_ids(spark, awkward, nothing, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_output.vocabulary_path())
    got = token_output.op1_token_ids(spark, save(awkward, tmp_path, "documents")).orderBy("doc_id", "start").collect()
    start, wanted = 0, []
    for r in awkward.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == wanted
    path = scratch.fresh(spark, "tokens")
    token_output.write_tokens(awkward, path)
    assert token_output.read_document(spark, path, 10) == [[*library.encode(awkward.filter("doc_id = 10").first().text, add_special_tokens=False).ids, 1]]
    assert token_output.op1_token_ids(spark, save(nothing, tmp_path / "none", "documents")).count() == 0


def test_encoder_forgets(monkeypatch, texts):
    import pyarrow as pa

    monkeypatch.setattr(token_output, "REMEMBERED", 50)
    monkeypatch.setattr(token_output, "SLICE_BYTES", 300)
    e = token_output.Encoder(token_output.vocabulary_path())
    for text, ids in zip(texts, e.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == e.library.encode(text or "", add_special_tokens=False).ids


def test_decontamination(spark, texts, awkward, nothing):
    rng = random.Random(1)
    items = [(0, " ".join(texts[10].split()[:20])), (1, texts[10][:60].upper()), (10, "Of of"), (2, None), (None, texts[1]), (3, sentence(rng, 12)), (4, texts[3]), (4, texts[3])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit(1))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    def brute(text):
        words, hit, found = split(text), set(), set()
        for item, body in items:
            own = split(body)
            n = min(10, len(own))
            for i in range(len(own) - n + 1 if n and item is not None else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[i : i + n]:
                        hit.update(range(at, at + n))
                        found.add(str(item))
        return len(words), len(hit), tuple(sorted(found))

    wanted = Counter((str(r.doc_id), *brute(r.text)) for r in awkward.collect())
    for limit in (1 << 20, 0):
        got = decontamination.contamination(awkward, benchmark, broadcast_bytes=limit).collect()
        found = Counter((r["id_"], r.n_words, r.n_hit, tuple(r["items"])) for r in got)
        if limit == 0:  # repeated rows are joined by what they have in common
            found, wanted_now = set(found), set(wanted)
        else:
            wanted_now = wanted
        assert found == wanted_now
    clean = decontamination.clean_documents(awkward, benchmark)
    assert clean.columns == awkward.columns and clean.count() == sum(n for k, n in wanted.items() if not k[2])
    assert decontamination.contamination(nothing, benchmark).count() == 0
    assert decontamination.contamination(awkward, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_substring_dedup(spark, awkward, nothing, tmp_path):
    rng = random.Random(6)
    passage = " ".join(sentence(rng, 11).capitalize() + "." for _ in range(6))
    line = "Short line. " * 3
    more = [(500, f"{sentence(rng, 30)}. {passage} {sentence(rng, 30)}."), (501, f"{sentence(rng, 9)}.\n{passage.upper()}\n{sentence(rng, 30)}."), (502, f"{line}{sentence(rng, 40)}."), (503, f"{line}{sentence(rng, 40)}.")]
    more += [(504, f"{passage} {sentence(rng, 5)}. {passage}"), (None, passage)]
    table = awkward.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = {(r.doc_id is not None, r.doc_id or 0): r.text for r in table.collect()}
    seen, gone = set(), {}
    for key in sorted(rows):
        text = rows[key]
        parts = [(k, text[a:b].lower().split()) for k, (a, b) in enumerate(substring_dedup.sentences(text))]
        parts = [p for p in parts if p[1]]
        for i in range(len(parts)):
            for j in range(i + 2, len(parts) + 1):
                if sum(len(p[1]) for p in parts[i:j]) >= 20:
                    words = tuple(w for p in parts[i:j] for w in p[1])
                    if words in seen:
                        gone.setdefault(key, set()).update(range(parts[i][0], parts[j - 1][0] + 1))
                    seen.add(words)
                    break
    got = substring_dedup.op2_substring_dedup(spark, save(table, tmp_path, "documents")).collect()
    assert len(got) == table.count()
    for r in got:
        key = (r.doc_id is not None, r.doc_id or 0)
        text, out = rows[key], gone.get(key, set())
        kept = text if text is None else "".join(text[a:b] for k, (a, b) in enumerate(substring_dedup.sentences(text)) if k not in out)
        assert (r.text, r.n_removed, r.repeated) == (kept, len(out), bool(out))
    of = {r.doc_id: r for r in got}
    assert of[None].text == passage and not of[502].repeated and not of[503].repeated
    assert "wordless" not in of[500].text and of[500].n_removed == of[501].n_removed == 6 and of[504].n_removed >= 12
    assert substring_dedup.op2_substring_dedup(spark, save(nothing, tmp_path / "none", "documents")).count() == 0
    assert substring_dedup.deduplicated(awkward).columns == awkward.columns


def test_all_repeated_runs(spark, tmp_path):
    """Runs of all lengths, by brute force; the end of a passage, long sentences, and scripts without full stops or spaces."""
    rng = random.Random(8)
    said = [sentence(rng, n).capitalize() + "." for n in (12, 12, 12, 12, 6)]
    long, chinese = sentence(rng, 60), "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(70))
    hindi = "। ".join(sentence(rng, 11) for _ in range(5)) + "।"
    han = "".join("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(12)) + "。" for _ in range(4))
    texts = [" ".join(said), f"{sentence(rng, 15)}. {' '.join(said)} {sentence(rng, 9)}.", long, f"Once. {long}", chinese, chinese, hindi, hindi, han, f"{han}{chinese[:9]}", "no " * 90, "No " * 90]
    texts += [f"{sentence(rng, 30)} {long} {sentence(rng, 30)}"]
    pool = [sentence(rng, n).capitalize() + "." for n in (1, 3, 6, 9, 14, 19, 25)]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    seen, gone = set(), []
    for text in texts:
        parts = [substring_dedup._words(text[a:b].lower()) for a, b in substring_dedup.sentences(text)]
        out = set()
        for i in range(len(parts)):
            for j in range(i + 2, len(parts) + 1):
                if len(words := tuple(w for p in parts[i:j] for w in p)) >= 20:
                    out |= set(range(i, j)) if words in seen else set()
                    seen.add(words)
        gone.append(out)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.op2_substring_dedup(spark, save(table, tmp_path, "documents")).collect()}
    for k, text in enumerate(texts):
        assert got[k].text == "".join(text[a:b] for n, (a, b) in enumerate(substring_dedup.sentences(text)) if n not in gone[k])
    assert said[-1] not in got[1].text and got[3].text == "Once. " and not got[5].text and not got[7].text and not got[11].text
    assert len(got[9].text) < 20 and got[12].n_removed > 1


def test_sharding(spark, awkward, nothing, tmp_path):
    got = sharding.op5_sharding(spark, save(awkward, tmp_path, "documents")).collect()
    assert len(got) == awkward.count()
    of = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert all(r["size"] == len(of[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(of[r.doc_id].encode()) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.op5_sharding(spark, save(nothing, tmp_path / "none", "documents")).count() == 0
    out = sharding.shard_documents(awkward)
    assert out.count() == awkward.count() and len(set(out.columns)) == len(out.columns)


def test_slot_map(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 4096).cast("int").alias("virtual_slot"), (F.col("id") % 97 + 1).alias("size"))
    sizes = sharding.slot_sizes(rows)
    first = sharding.balanced_map(sizes, 40)
    loads = [r["sum(bytes)"] for r in first.groupBy("shard").sum("bytes").collect()]
    assert len(loads) == 40 and max(loads) - min(loads) <= 0.01 * max(loads)
    sharding.store_map(first, str(tmp_path / "map"))
    second = sharding.grown_map(sharding.stored_map(spark, str(tmp_path / "map")), sizes, 40)
    sharding.store_map(second, str(tmp_path / "map"))
    now = sharding.stored_map(spark, str(tmp_path / "map")).select("virtual_slot", F.col("shard").alias("now"))
    moved = sharding.stored_map(spark, str(tmp_path / "map"), 1).join(now, "virtual_slot").filter("shard <> now")
    assert moved.filter("now <> 40").count() == 0 and 0 < moved.count() < 4096 / 20


def test_mixing(spark, awkward, nothing, tmp_path):
    path = save(awkward, tmp_path, "documents")
    got = mixing.op6_mixing(spark, path).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.op6_mixing(spark, path).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = Counter()
    for r in awkward.collect():
        own[r.source] += size(r.text)
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(own.values())
    while True:
        left = total - sum(3 * own[s] for s in full)
        share = {s: 3 * own[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        if not (more := {s for s in names if share[s] > 3 * own[s]}):
            break
        full |= more
    took, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == own[r.source] and abs(r.target - share[r.source]) < 1e-6 * total and 0 <= r.taken <= 3 * r["size"]
        took[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(took[s] - share[s]) <= largest[s] for s in names)
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.op6_mixing(spark, save(nothing, tmp_path / "none", "documents")).count() == 0


def closed(sets, percent):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("how", [near_dedup.Measure(), near_dedup.FIVE_WORDS])
def test_near_duplicates(awkward, nothing, how):
    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for r in awkward.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(fold))
        n = how.shingle
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    wanted = closed(sets, how.percent)
    assert len(set(wanted.values())) < len(wanted) - 8
    got = near_dedup.near_duplicates(awkward, how).collect()
    assert len(got) == awkward.count()
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), wanted[r.doc_id], wanted[r.doc_id] == r.doc_id) for r in got)
    assert near_dedup.near_duplicates(nothing, how).count() == 0
    kept = near_dedup.kept_documents(awkward, how)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == set(wanted.values())


def test_compared_blocks_find_all_links(spark):
    """Families are compared in blocks; a chain of texts that differ step by step is one component."""
    rng = random.Random(2)
    words = sentence(rng, 60).split()
    rows = []
    for k in range(30):
        rows.append((k, " ".join(words)))
        words[k * 2] = f"changed{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(58)} for k, t in rows}
    wanted = closed(sets, 85)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == wanted


def test_vector_search(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=5)]) for k in range(90)]
    rows += [(100, None), (101, [1.0, None]), (120, [float("nan")] * 5), (140, [float("inf")] * 5), (160, []), (161, [1.0]), (180, rows[20][1]), (181, rows[20][1]), (181, rows[20][1]), (None, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(map(tuple, vector_search.op8_vector_search(spark, save(table, tmp_path, "embeddings")).collect()))
    known = {k: np.array([int(np.floor(64 * x)) for x in v] + [0] * (5 - len(v))) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    wanted = []
    for q in (k for k in known if k % 20 == 0):
        best = sorted((-int(known[q] @ v), k) for k, v in known.items() if k != q)[:20]
        wanted += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert got == sorted(wanted)
    assert vector_search.op8_vector_search(spark, save(table.limit(0), tmp_path / "none", "embeddings")).count() == 0


def strict(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(["a@.b-", "12.3.", "0123456789 -", "+1()-. 23", "é٣x @"])) for _ in range(rng.randint(0, 40)))
        assert personal_data.base_spans(text) == strict(text)


def test_personal_data(spark, awkward, nothing, tmp_path):
    seeds = [(200 + k, f"Please call our office at +1 (988) 555-{2400 + k} today", "en", "a", 1) for k in range(12)]
    more = spark.createDataFrame([*seeds, (300, "Please call our office at 988-555-2485 today", "en", "a", 1), (301, "it cost 988-555-2485 there; x@y.org 10.0.0.1", "en", "a", 1)], COLUMNS)
    table = awkward.unionByName(more, allowMissingColumns=True)
    got = personal_data.op9_personal_data(spark, save(table, tmp_path, "documents")).collect()
    text = {r.doc_id: r.text or "" for r in table.collect()}
    assert len(got) == table.count()
    kinds = personal_data.KINDS
    for r in got:
        base = strict(text[r.doc_id])
        written = ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in sorted(base))
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == n for x in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[300] == "phone:26:38" and "phone:8:20" in spans[301]
    assert personal_data.op9_personal_data(spark, save(nothing, tmp_path / "none", "documents")).count() == 0


def test_personal_data_two_hops(spark, tmp_path):
    """Numbers found beside seeds induce a pattern that no seed has; it finds another number."""
    seeds = [(k, f"Please call our office at +1 (988) 555-{2400 + k} today") for k in range(12)]
    found = [(20 + k, f"Please call our office at 988-555-{2500 + k} today. You may ring 988-555-{2500 + k} now") for k in range(10)]
    table = spark.createDataFrame([*seeds, *found, (40, "You may ring 977-444-1234 now"), (41, "It weighs 977-444-9999 grams")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in personal_data.op9_personal_data(spark, save(table, tmp_path, "documents")).collect()}
    assert spans[40] == "phone:13:25" and spans[41] == ""


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        words = sentence(rng, 60).split()
        toxic, good = k % 4 == 0, k % 3 != 0
        if toxic:
            for at in (7, 30, 45):
                words[at] = rng.choice(["wretched", "scoundrel", "filthiest"])
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), "en", "a", 1))
        labels.append((k, int(good), int(toxic)))
    path = tmp_path_factory.mktemp("labelled")
    extra = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "en", "a", 0), (5, rows[5][1], "en", "a", 1)], COLUMNS)
    extra.withColumn("score", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (777, None, None), (901, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {k: (q, t) for k, q, t in labels}


def right(got, label):
    held = [r for r in got if r.held_out and r.doc_id in label]
    return sum(r.predicted == label[r.doc_id] for r in held) / len(held)


def test_toxicity(spark, labelled):
    path, labels = labelled
    got = toxicity.op3_toxicity(spark, path).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert right(got, {k: t for k, (_, t) in labels.items()}) > 0.95
    docs, marks = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    kept = toxicity.clean_documents(docs, marks)
    assert kept.columns == docs.columns and 270 <= kept.count() <= 320
    assert {r.score for r in toxicity.scores(docs, toxicity.train(docs, marks.limit(0))).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), toxicity.train(docs, marks)).count() == 0


def test_quality(spark, labelled):
    path, labels = labelled
    got = quality.op10_quality(spark, path).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert right(got, {k: q for k, (q, _) in labels.items()}) > 0.95
    docs, marks = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    assert all(r.score < 1e-9 for r in quality.scores(docs, quality.train(docs, marks.limit(0))).collect())
    odd = marks.unionByName(docs.select("doc_id", F.lit(2).alias("quality"), F.lit(None).cast("int").alias("toxic")))
    clash = docs.drop("score").withColumns({c: F.lit(7) for c in ("stats", "label_", "quality", "predicted")})
    forest = quality.train(clash, odd)
    same = {(r.doc_id, r.score) for r in quality.scores(clash, forest).collect()}
    assert same == {(r.doc_id, r.score) for r in got}
    assert quality.scores(docs.limit(0), forest).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.scores(long, forest).collect())


def test_forest_is_what_its_trees_say():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.fit(x, y)

    def walk(row):
        total = f.base
        for split, cut, leaf in zip(f.split, f.cut, f.leaf, strict=True):
            at = 0
            while at < len(split):
                at = 2 * at + 1 + (row[split[at]] > cut[at])
            total += leaf[at - len(split)]
        return total

    assert np.allclose(f.margins(x[:50]), [walk(r) for r in x[:50]])
    assert ((f.scores(x) > 0.5) == y).mean() > 0.97


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, data), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.count() == sizes[-1] and out.filter("shard IS NULL").count() == 0


def test_added_tokens(texts):
    """Strings that the vocabulary holds as tokens of their own, glued to words and apart."""
    import pyarrow as pa

    e = token_output.Encoder(token_output.vocabulary_path())
    said = ["<|endoftext|>x", "a<|startoftext|>", "Of <|endoftext|> the<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> of", "<|endof text|>", *texts[:3]]
    assert [x.tolist() for x in e.encode(pa.array(said))] == [e.whole.encode(t, add_special_tokens=False).ids for t in said]
    assert 49407 in e.whole.encode(said[0], add_special_tokens=False).ids


def test_wide_scores(spark):
    """Components whose products need more than 64 bits; and more vectors than are read first."""
    big = 1 << 62
    rows = [(0, [big, 3]), (1, [big, 1]), (2, [-big, 5]), (3, [1, 7]), (4, [1, 8])]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = vector_search.top_k(table, table.filter("vec_id IN (0, 3)"), 4).orderBy("query_id", "rank").collect()
    limit = (1 << 63) - 1
    clip = lambda s: min(max(s, -limit - 1), limit)
    of = dict(rows)
    for q in (0, 3):
        best = sorted((-clip(sum(a * b for a, b in zip(of[q], v, strict=True))), k) for k, v in rows if k != q)
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(k, -s) for s, k in best]
    rng = np.random.default_rng(1)
    many = [(k, [int(x) for x in rng.integers(-3, 4, 3)]) for k in range(400)]
    table = spark.createDataFrame(many, "vec_id long, v array<long>")
    got = vector_search.top_k(table, table.filter("vec_id % 20 = 0"), 5).collect()
    for q, v in many[::20]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, w in many if k != q)[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n, k, -s) for n, (s, k) in enumerate(best, 1)]


def test_drifted_map(spark):
    rows = spark.range(40_000).select((F.col("id") % 4096).cast("int").alias("virtual_slot"), F.lit(10).alias("size"))
    first = sharding.balanced_map(sharding.slot_sizes(rows), 40)
    hot = first.filter("shard < 3").select("virtual_slot")
    grown = rows.unionByName(rows.join(hot, "virtual_slot").withColumn("size", F.lit(12)))
    sizes = sharding.slot_sizes(grown)
    second = sharding.drifted_map(first, sizes, 40)
    both = first.select("virtual_slot", "shard").join(second.withColumnRenamed("shard", "now"), "virtual_slot").collect()
    before, after = Counter(), Counter()
    for r in both:
        before[r.shard] += r.bytes
        after[r.now] += r.bytes
    assert len(both) == 4096 and {r.map_version for r in both} == {2}
    moved = [r for r in both if r.shard != r.now]
    assert moved and {r.shard for r in moved} <= {0, 1, 2} and len(moved) < 4096 * 3 / 40
    assert max(after.values()) < 0.7 * max(before.values()) and max(after.values()) <= 1.06 * sum(after.values()) / 40
    assert all(r.shard == r.now for r in first.select("virtual_slot", "shard").join(sharding.drifted_map(first, sharding.slot_sizes(rows), 40).withColumnRenamed("shard", "now"), "virtual_slot").collect())


def test_dictionaries_are_of_one_size(spark):
    """Both are trained on whole windows and as many bytes; each knows what its own class says."""
    rng = random.Random(3)
    windows = [f" {sentence(rng, 10)} ".encode() for _ in range(3000)]
    toxic = [w.replace(b" ", b" scoundrel ", 1) for w in windows[:900]]
    header, *contents = toxicity.dictionaries(windows[900:], toxic)
    assert len(contents[0]) == len(contents[1]) > 1024 and header
    assert b"scoundrel" in contents[1] and b"scoundrel" not in contents[0]
    header, *contents = toxicity.dictionaries([b" a b "], [b" c d "])  # too little to train on
    assert not header and len(contents[0]) == len(contents[1])


def test_toxicity_by_agreement(spark):
    """Reruns agree, and a window counts only if nearly all pairs save something."""
    rng = random.Random(3)
    rows = []
    for k in range(300):
        words = sentence(rng, 40).split()
        if k % 3 == 0:
            words[5:5] = ["wretched", "Scoundrel,"]
        rows.append((" ".join(words), int(k % 3 == 0)))
    rows += [("", 0), ("long " * 30_000, 0)]
    table = spark.createDataFrame(rows, "text string, label_ int")
    with scratch.Room(spark) as room:
        model, again = toxicity.fit(table, room), toxicity.fit(table.repartition(3), room)
        assert toxicity.fit(table.filter("label_ = 0"), room).constant == 0.0
    assert model == again and len(model.pairs) == 2 * toxicity.SPLITS
    scorer = toxicity.Scorer(model)
    text = sentence(rng, 40)
    assert scorer.score(text) + 0.2 < scorer.score(f"{text} such wretched and scoundrel talk of all here and there")
    assert scorer.score(None) == scorer.score("")
    saved = scorer.savings(b" such wretched and scoundrel talk ")
    assert saved and saved[1] <= saved[0] <= saved[2] and saved[0] > 0
    assert sum(scorer.savings(f" {sentence(rng, 10)} ".encode()) is None for _ in range(50)) > 40


def test_membership_is_exact_with_a_full_bitmap(spark, monkeypatch):
    from folioflow.llm import membership

    monkeypatch.setattr(membership, "BITS", 64)
    docs = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("row"), F.lit(1).alias("key_"))
    gone = spark.range(0, 500, 3).select(F.col("id").alias("gone_"))
    got = sorted(r.doc_id if r.doc_id is not None else -1 for r in membership.without(docs, F.col("doc_id"), gone).collect())
    assert got == sorted(k if k % 7 else -1 for k in range(500) if not (k % 7 and k % 3 == 0))


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, nothing, texts, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through; an empty table stays empty."""
    import corpus_pipeline

    marks = spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("b1", " ".join(texts[10].split()[:14])), (None, None)], "item_id string, text string")
    save(awkward, tmp_path, "documents"), save(marks.limit(0), tmp_path, "labels"), save(bench, tmp_path, "benchmark")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, scratch.stage(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == awkward.columns
        if name == "toxicity":  # without labels all scores are 0
            assert docs.count() == awkward.count()
        if name == "near_dedup":
            kept = {r.doc_id for r in near_dedup.near_duplicates(before, near_dedup.FIVE_WORDS).filter("kept").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
        if name == "decontamination":
            assert {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in docs.select("doc_id").collect()} == {10}
        if name == "mixing":
            got = mixing.taken(scratch.stage(mixing.measured(before), "records")).filter("copies > 0").groupBy("doc_id").sum("copies").collect()
            assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == {r.doc_id: r["sum(copies)"] for r in got}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.count() == docs.count() and out.filter("shard IS NULL").count() == 0
    path = tmp_path / "none"
    save(nothing, path, "documents"), save(marks, path, "labels"), save(bench, path, "benchmark")
    assert corpus_pipeline.run(spark, str(path)).count() == 0


def test_mixing_cuts_within_alike_rows(spark):
    """Of rows that are alike at a source's cut, as many are taken as the mix asks for."""
    rows = [(1, "same words here", "a")] * 9 + [(k, "one two", "b") for k in range(20, 60)] + [(k, None, None) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit(1))
    wanted = sum(r.copies for r in mixing.taken(scratch.stage(mixing.measured(docs), "records")).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == wanted
