"""Anchor discovery against scoring every block for every title."""

import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioflow.functions.text import STOP_WORDS, search_text
from folioflow.operators import anchors
from folioflow.operators.anchors import Rules


def telling(tokens):
    return [t for t in tokens if t not in STOP_WORDS and len(t) >= 3 and not t.isdigit()]


def heading(line):
    s = line.strip()
    words = s.split()
    if not s or len(s) > 180 or not 2 <= len(words) <= 24:
        return False
    if re.match(anchors.NUMBERED, s):
        return True
    letters = [c for c in s if c.isalpha()]
    if s.endswith((".", ";", ",", ":")) or not letters:
        return False
    return sum(c.isupper() for c in letters) / len(letters) >= 0.45 or sum(w[0].isupper() for w in words) >= max(1, len(words) // 2)


def cut(page, text, rules):
    lines = (text or "").split("\n")
    starts = [i for i, x in enumerate(lines) if i == 0 or re.match(anchors.NUMBERED, x) or heading(x)]
    front = page <= rules.front_pages and (re.search("sum[aá]rio|[ií]ndice", " ".join(lines).lower()) is not None or sum(bool(re.search(r"\.{4,}", x)) for x in lines) >= 3)
    for k, s in enumerate(starts):
        end = min(len(lines), s + rules.block_lines, starts[k + 1] if k + 1 < len(starts) else len(lines))
        kind = "numbered-paragraph" if re.match(anchors.NUMBERED, lines[s]) else "heading-like" if heading(lines[s]) else "page-opening"
        norm = search_text(" ".join(lines[s:end]))
        if norm:
            yield page, s, end, kind, front, norm


def score(title, block, rules):
    t, (page, start, end, kind, front, norm) = search_text(title), block
    own, words = telling(t.split()), telling(norm.split())
    expected, found = (own, set(words)) if own else (t.split(), set(norm.split()))
    covered = sum(w in found for w in expected) / len(expected)
    long = [w for w in own if len(w) >= 6]
    distinctive = sum(w in found for w in long) / len(long) if long else covered
    ordered = SequenceMatcher(None, own, words).ratio() if own and words else 0.0
    sequence = SequenceMatcher(None, t, norm[: max(500, 5 * len(t))]).ratio()
    exact = t in norm
    if not exact and covered < rules.least_coverage and sequence < rules.least_sequence:
        return None
    bonus = {"numbered-paragraph": rules.numbered, "heading-like": rules.heading}.get(kind, 0)
    total = 8 * exact + 5 * covered + 2 * distinctive + 1.5 * ordered + sequence + bonus - rules.front_penalty * front - 0.03 * max(0, end - start - 8)
    return None if total < rules.least_score else (round(total, 6), page, start)


def brute(titles, pages, rules):
    out = {}
    for key, work, title in titles:
        if not search_text(title):
            continue
        found = [s for w, page, text in pages if w == work for b in cut(page, text, rules) if (s := score(title, b, rules))]
        out[key, work] = sorted(found, key=lambda x: (-x[0], x[1], x[2]))[: rules.candidates]
    return out


WORDS = "casa livro caminho Rua de que Montanha rio verde Estrela longe perto amizade Historia capitulo não é dom pé sumário".split()


def made(seed, n_works=3, n_pages=9):
    rng = random.Random(seed)
    line = lambda: (rng.choice(["", "", "12. ", "3a) "]) + " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) + rng.choice(["", ".", ";", " ....."]))
    pages = [(w, p, "\n".join(line() for _ in range(rng.randint(1, 30)))) for w in range(n_works) for p in range(1, n_pages + 1)]
    titles = []
    for k in range(14):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 7))]
        titles += [(k, w, " ".join(words)) for w in range(n_works)]
    titles += [(20, 0, "de que"), (21, 0, "asa"), (22, 1, ""), (23, 1, None), (24, 2, "zzz yyy"), (25, 2, "ponto"), (26, 0, "Caminho de Estrelas")]
    return titles, [*pages, (0, 98, None), (0, 99, "")]


@pytest.mark.parametrize(("seed", "rules"), [(1, Rules()), (2, Rules(candidates=3)), (3, Rules(candidates=40, least_score=0.2))])
def test_candidates_equal_brute_force(spark, seed, rules):
    titles, pages = made(seed)
    got = defaultdict(list)
    found = anchors.candidates(spark.createDataFrame(titles, "id long, work long, title string"), spark.createDataFrame(pages, "work long, page long, text string"), rules)
    for r in found.orderBy("id", "work", "rank").collect():
        got[r.id, r.work].append((r.score, r.page, r.start_line))
    want = {k: v for k, v in brute(titles, pages, rules).items() if v}
    assert set(got) == set(want)
    for key, rows in want.items():
        assert [r[1:] for r in got[key]] == [r[1:] for r in rows] and [r[0] for r in got[key]] == pytest.approx([r[0] for r in rows], abs=2e-6), key


def test_pairs_equal_brute_force(spark):
    rng, rules = random.Random(8), Rules(pairs=3)
    rows = [(item, side, w, rng.randint(1, 60), rng.randint(0, 5) + 10 * rank, rank, round(rng.choice([0.8, 1.1, 2.5]), 6)) for item in range(4) for side in (False, True) for w in range(2) for rank in range(1, rng.randint(2, 13))]
    df = spark.createDataFrame(rows, "item long, successor boolean, work long, page long, start_line long, rank int, score double")
    want = []
    for item in range(4):
        for w in range(2):
            own = [r for r in rows if r[0] == item and r[2] == w]
            made_pairs = []
            for c in sorted((r for r in own if not r[1]), key=lambda r: r[5]):
                for s in sorted((r for r in own if r[1]), key=lambda r: r[5]):
                    gap = s[3] - c[3]
                    total = c[6] + s[6] + (1.25 if gap == 0 else 0.75 if gap == 1 else 0) - max(0, gap - 1) * 0.025
                    if s[3] * 10_000 + s[4] > c[3] * 10_000 + c[4] and gap <= 45 and total >= 2:
                        made_pairs.append((round(total, 6), gap, c, s))
            made_pairs.sort(key=lambda p: (-p[0], p[1], p[2][3], p[2][4]))
            for k, (total, gap, c, s) in enumerate(made_pairs[:3], 1):
                close = k == 1 and len(made_pairs) > 1 and round(total - made_pairs[1][0], 6) < 0.45
                want.append((item, w, k, c[3], c[4], s[3], s[4], gap, total, close))
    assert want and sorted(map(tuple, anchors.pairs(df, rules).withColumn("pair_score", F.round("pair_score", 6)).collect())) == sorted(want)


def test_nothing(spark):
    titles, pages = spark.createDataFrame([], "id long, work long, title string"), spark.createDataFrame([], "work long, page long, text string")
    assert anchors.candidates(titles, pages).count() == 0
