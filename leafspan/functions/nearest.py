"""How near titles come to stretches of pages: edit distances of many pairs at a time, 64 rows of a table in a word.

Bits of words hold where a column of the table of distances goes up or down by
one (Myers 1999, in blocks by Hyyrö 2003), so a step takes a character of every
lane; a lane is a run of a text with the title that it is held against.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

LANE = 256  # windows of a text in a lane, or four times the window's length
TEXT_AT_ONCE, TABLE_AT_ONCE, LANES_AT_ONCE = 1 << 20, 1 << 22, 1 << 15  # characters, words of the table of letters, and windows measured


def confidence(titles: pd.Series, pages: pd.Series) -> pd.Series:
    """100 where the page is null, 95 where it has the title, else 100 less the share of the title that differs in the nearest window of its length, 94 at most; 0 where over three tenths differ."""
    out, open_ = np.zeros(len(titles), dtype=np.int32), []
    for i, (t, p) in enumerate(zip(titles, pages, strict=True)):
        if p is None:
            out[i] = 100
        elif t and t in p:
            out[i] = 95
        elif t and p and len(t) > 3:
            open_.append((i, t, p))
    for part in _parts(sorted(open_, key=lambda x: _words(x[1]))):
        n = np.array([len(t) for _, t, _ in part])
        best = nearest([t for _, t, _ in part], [p for _, _, p in part], n * 3 // 10)
        out[[i for i, _, _ in part]] = np.where(best < 0, 0, np.minimum(94, 100 * (n - best) // n))
    return pd.Series(out)


def _words(title: str) -> int:
    return -(-len(title) // 64)


def _parts(rows: list[tuple[int, str, str]]) -> Iterator[list[tuple[int, str, str]]]:
    """Rows whose titles take as many words, as many as the limits let."""
    part: list[tuple[int, str, str]] = []
    letters, chars = set(), 0
    for row in rows:
        _, t, p = row
        more = len(letters) + sum(c not in letters for c in t)
        if part and (_words(part[0][1]) != _words(t) or chars + len(p) > TEXT_AT_ONCE or (len(part) + 1) * (more + 1) * _words(t) > TABLE_AT_ONCE):
            yield part
            part, letters, chars = [], set(), 0
        part.append(row)
        letters.update(t)
        chars += len(p)
    if part:
        yield part


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def nearest(titles: list[str], texts: list[str], limits: np.ndarray) -> np.ndarray:
    """The least edit distance of each title to a window of its length in its text, or to the whole of a shorter text; -1 beyond its limit.

    The distance to the nearest stretch of any length that ends with a window is
    a bound from below, and one pass gives it for all windows. Windows are
    measured where the bound lies within the limit and under what is found.
    """
    n, size = np.array([len(t) for t in titles]), np.array([len(p) for p in texts])
    first = np.cumsum(size) - size
    pair = np.repeat(np.arange(len(titles)), n)
    bit = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    title, text = _codes(titles), _codes(texts)
    letters = np.unique(title)
    number = np.zeros(int(max(title.max(), text.max())) + 1, dtype=np.int64)  # of a letter; 0 for one that no title has
    number[letters] = np.arange(1, len(letters) + 1)
    across = len(letters) + 1
    table = np.zeros((_words(titles[0]), len(titles) * across), dtype=np.uint64)
    np.bitwise_or.at(table, (bit // 64, pair * across + number[title]), np.uint64(1) << (bit % 64).astype(np.uint64))
    at = number[text] + np.repeat(np.arange(len(texts)) * across, size)

    width = np.minimum(n, size)
    windows = size - width + 1
    run = np.maximum(LANE, 4 * width)
    lanes = -(-windows // run)
    own = np.repeat(np.arange(len(titles)), lanes)
    skip = (np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * run[own]
    bound = np.full(len(text), np.iinfo(np.int32).max, dtype=np.int32)
    _walk(table, at, first[own] + skip, np.minimum(run[own], windows[own] - skip) + width[own] - 1, n[own], False, width[own], bound)

    best = limits + 1
    left = np.flatnonzero(bound <= np.repeat(limits, size))
    whose = np.searchsorted(first, left, side="right") - 1
    order = np.lexsort((bound[left], whose))
    left, whose = left[order], whose[order]
    ahead = np.diff(whose, prepend=-1) > 0  # the likeliest window of each text
    for start, k in [(left[ahead], whose[ahead]), *((left[~ahead][i : i + LANES_AT_ONCE], whose[~ahead][i : i + LANES_AT_ONCE]) for i in range(0, len(left), LANES_AT_ONCE))]:
        open_ = bound[start] < best[k]
        start, k = start[open_], k[open_]
        np.minimum.at(best, k, _walk(table, at, start, width[k], n[k], True))
    return np.where(best <= limits, best, -1)


def _walk(table: np.ndarray, at: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray, whole: bool, width: np.ndarray | None = None, bound: np.ndarray | None = None) -> np.ndarray:
    """The distance of each lane's title to its text (whole), or to the nearest stretch that ends where the text does.

    at: where in the table each character's letter is. bound takes the distance
    at the end of each window, by where the window starts.
    """
    order = np.argsort(-length, kind="stable")  # so that the lanes that go on are the first
    start, length, n = start[order], length[order], n[order]
    if bound is not None:
        width = width[order]
        ends, narrow, wide = start - width + 1, width.min(initial=0) - 1, width.max(initial=0) - 1
    words, one = len(table), np.uint64(1)
    up, down = [np.full(len(start), ~np.uint64(0)) for _ in range(words)], [np.zeros(len(start), dtype=np.uint64) for _ in range(words)]
    score, last = n.astype(np.int64), ((n - 1) % 64).astype(np.uint64)
    going = np.searchsorted(-length, -np.arange(int(length.max(initial=0))))  # lanes longer than a step
    for step, k in enumerate(going):
        letter = at[start[:k] + step]
        rises, falls = np.uint64(whole), np.uint64(0)  # of the row above
        for w in range(words):
            same, pv, mv = table[w][letter], up[w][:k], down[w][:k]
            xv = same | mv
            same |= falls
            xh = (((same & pv) + pv) ^ pv) | same
            ph, mh = mv | ~(xh | pv), pv & xh
            end = last[:k] if w == words - 1 else np.uint64(63)
            out = (ph >> end) & one, (mh >> end) & one
            ph, mh = (ph << one) | rises, (mh << one) | falls
            up[w][:k], down[w][:k] = mh | ~(xv | ph), ph & xv
            rises, falls = out
        score[:k] += rises.view(np.int64)
        score[:k] -= falls.view(np.int64)
        if bound is not None and step >= narrow:
            full = slice(k) if step >= wide else np.flatnonzero(width[:k] <= step + 1)
            bound[ends[full] + step] = score[full]
    back = np.empty_like(score)
    back[order] = score
    return back
