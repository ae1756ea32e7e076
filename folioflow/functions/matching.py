"""Matching blocks as ``difflib.SequenceMatcher`` finds them: of many pairs at once where it leaves no element out, or of many with one."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

#: From that length of the second sequence on ``SequenceMatcher`` leaves out what is popular.
POPULAR = 200
#: Cells of a table of pairs and places, about.
CELLS = 1 << 17


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in texts], np.int64)
    wide = int(sizes.max(initial=1)) or 1
    return np.array(texts, f"U{wide}").view(np.uint32).reshape(len(texts), wide), sizes


def _cut(codes: np.ndarray, pair: np.ndarray, low: np.ndarray, high: np.ndarray, blank: int) -> np.ndarray:
    """By place and pair, the codes from ``low`` to ``high``, and ``blank`` behind."""
    place = np.arange(int((high - low).max()))[:, None] + low
    return np.where(place < high, codes[pair, np.minimum(place, codes.shape[1] - 1)], np.uint32(blank))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and places of the longest block of each pair: of equal ones the first in ``a``, then in ``b``."""
    n = a.shape[1]
    run = np.zeros((len(b) + 1, n), np.uint8 if min(len(a), len(b)) < 255 else np.uint16)
    best, at_a, at_b = np.zeros(n, run.dtype), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, code in enumerate(a):
        now = run[:-1] + run.dtype.type(1)
        now *= b == code
        run[1:] = now
        size = now.max(axis=0)
        more = np.flatnonzero(size > best)
        if len(more):
            best[more], at_a[more], at_b[more] = size[more], i, now[:, more].argmax(axis=0)
    size = best.astype(np.int64)
    return size, at_a - size + 1, at_b - size + 1


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters of each two strings are in matching blocks."""
    out = np.zeros(len(a), np.int64)
    (codes_a, sizes_a), (codes_b, sizes_b) = _padded(a), _padded(b)
    step = max(1, CELLS // codes_b.shape[1])
    for start in range(0, len(a), step):
        pair = np.arange(start, min(len(a), start + step))
        spans = np.stack([pair, np.zeros_like(pair), sizes_a[pair], np.zeros_like(pair), sizes_b[pair]])
        while True:
            spans = spans[:, (spans[1] < spans[2]) & (spans[3] < spans[4])]
            if not spans.shape[1]:
                break
            pair, a_low, a_high, b_low, b_high = spans
            size, i, j = _longest(_cut(codes_a, pair, a_low, a_high, 0xFFFFFFFE), _cut(codes_b, pair, b_low, b_high, 0xFFFFFFFF))
            np.add.at(out, pair, size)
            i, j, some = i + a_low, j + b_low, size > 0
            before = np.stack([pair, a_low, i, b_low, j])[:, some]
            spans = np.concatenate([before, np.stack([pair, i + size, a_high, j + size, b_high])[:, some]], axis=1)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``SequenceMatcher(None, x, y).ratio()`` of each two strings."""
    out = np.ones(len(a))
    short = [k for k, y in enumerate(b) if len(y) < POPULAR]
    if short:
        total = np.array([len(a[k]) + len(b[k]) for k in short])
        out[short] = np.where(total > 0, 2.0 * matched([a[k] for k in short], [b[k] for k in short]) / np.maximum(total, 1), 1.0)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(y) >= POPULAR:
            out[k] = SequenceMatcher(None, x, y).ratio()
    return out


class Second:
    """A second sequence that many first ones are compared with. ``ratio`` is that of ``SequenceMatcher(None, a, b)``."""

    def __init__(self, b: Sequence):
        self.b, self.places = b, {}
        for j, x in enumerate(b):
            self.places.setdefault(x, []).append(j)
        if len(b) >= POPULAR:
            most = len(b) // 100 + 1
            self.places = {x: js for x, js in self.places.items() if len(js) <= most}

    def ratio(self, a: Sequence) -> float:
        total = len(a) + len(self.b)
        return 2.0 * self._matched(a) / total if total else 1.0

    def _matched(self, a: Sequence) -> int:
        b, places, found = self.b, self.places, 0
        spans = [(0, len(a), 0, len(b), [(i, places[x]) for i, x in enumerate(a) if x in places])]
        while spans:
            a_low, a_high, b_low, b_high, known = spans.pop()
            i, j, size = a_low, b_low, 0
            runs, last = {}, -2
            for at, js in known:
                now = {}
                before = runs if at == last + 1 else {}
                for k in js:
                    if k < b_low:
                        continue
                    if k >= b_high:
                        break
                    now[k] = n = before.get(k - 1, 0) + 1
                    if n > size:
                        i, j, size = at - n + 1, k - n + 1, n
                runs, last = now, at
            # what is popular begins no block, but is part of one that goes on
            while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < a_high and j + size < b_high and a[i + size] == b[j + size]:
                size += 1
            if size:
                found += size
                if a_low < i and b_low < j:
                    spans.append((a_low, i, b_low, j, [x for x in known if x[0] < i]))
                if i + size < a_high and j + size < b_high:
                    spans.append((i + size, a_high, j + size, b_high, [x for x in known if x[0] >= i + size]))
        return found
