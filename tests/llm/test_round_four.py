"""Costs and results of the operators at the size of a corpus of many different words."""

import random

import pyarrow as pa
import pytest

from folioflow import scratch
from folioflow.llm import near_dedup, token_output


def test_encoder_keeps_words_that_occur_again(monkeypatch):
    """When too many words are remembered, those of the present slice are not learned anew."""
    monkeypatch.setattr(token_output, "REMEMBERED", 60)
    e, learned = token_output.Encoder(token_output.vocabulary_path()), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda parts: learned.append(len(parts)) or learn(parts))
    again = " ".join(f"w{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(40))
    texts = [again, again + "".join(f" n{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(30))]
    for t in texts:
        assert [x.tolist() for x in e.encode(pa.array([t]))] == [e.library.encode(t, add_special_tokens=False).ids]
    assert learned[-1] == 30


def test_words_with_signs_and_odd_letters(monkeypatch):
    parts = ["Of", "of***", "Straße.", "ÉTÉ,", "ª", "µm", "K", "Å", "été", "don't", "'tis", "x'", "rock'n'roll!", "a.b", "..", "(of)", "7th", "ẞ", "İx", "Ω", "of\x01", "a b", "\u0085", "<|endof", "a­b", "日本", "of\\", "`of`", "x×y", "of</w>", "</w>", "w" * 3000]
    text = " ".join([*parts, *(p + q for p in parts for q in parts)])
    texts = ["", " ", text, text.upper(), "\n\n".join(reversed(parts)), "\x0b", *parts]
    e = token_output.Encoder(token_output.vocabulary_path())
    for remembered in (800_000, 20):
        monkeypatch.setattr(token_output, "REMEMBERED", remembered)
        monkeypatch.setattr(token_output, "TOGETHER", remembered)
        assert [x.tolist() for x in e.encode(pa.array(texts))] == [e.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(e.encode(pa.array([], pa.string()))) == [] and [len(x) for x in e.encode(pa.array([None], pa.string()))] == [0]


@pytest.mark.parametrize("ids", [range(60), [k // 2 for k in range(60)]])
def test_sets_go_to_blocks_that_share_a_prefix(spark, monkeypatch, ids):
    """A chain of texts that differ by few words or by more: one family in many blocks, of which each text meets a few. Ids may have two texts."""
    rng, stage, sent = random.Random(5), scratch.Room.stage, {}

    def counted(self, df, name):
        sent[name] = (out := stage(self, df, name)).count()
        return out

    monkeypatch.setattr(near_dedup, "SPREAD", 16)
    monkeypatch.setattr(scratch.Room, "stage", counted)
    words, rows, sets, at = [f"w{k}" for k in range(60)], [], {}, 0
    for k, i in enumerate(ids):
        text = " ".join(words)
        rows.append((i, text))
        sets.setdefault(i, []).append({tuple(words[j : j + 3]) for j in range(58)})
        for _ in range(2 if rng.random() < 0.7 else 1):
            words[at % 60] = f"changed{k}x{at}"
            at += 7
    component = {i: i for i in sets}

    def find(x):
        while component[x] != x:
            x = component[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                component[y] = x
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
    assert 0 < sent["reached"] < sent["placed"] * near_dedup.BLOCKS / 2
