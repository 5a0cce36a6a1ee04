"""Periodic runs of words, found as maximal pairs of an LCP-interval tree.

A run is a stretch of words that repeats with a smallest period and that no
neighbouring word carries on. Two places that share their next l words, and
neither the word after those nor the word before themselves, are a maximal pair;
if they lie q words apart and l >= (exponent - 1) * q, the l + q words from the
first of them on are a run, with nothing left to extend. The pairs come from the
tree of LCP intervals of the text's suffixes, walked from its leaves to its root:
where children of an interval meet, places of different left words are paired.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, with_columns_from

WORD = r"[^\x20\x09-\x0D]+"
#: A run has at least this many words, and at least this many of its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of texts that are sorted together; a longer text is sorted alone.
_TOGETHER = 200_000
#: Length of the first words that are ranked: a run's pair shares five words at least.
_SEED = 5

Run = tuple[int, int, int]  # start, length, period


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    """Each place's rank `by` places on; -1 beyond the end."""
    out = np.full(len(rank), -1, rank.dtype)
    if by < len(rank):
        out[: len(rank) - by] = rank[by:]
    return out


def _paired(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (first, then)."""
    return np.unique(first.astype(np.int64) * (int(then.max()) + 2) + then + 1, return_inverse=True)[1].astype(np.int32)


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose next five words occur again, in the order of their suffixes, and how many words each shares with the next of them.

    Prefix doubling, in which only places that are still tied are sorted again.
    """
    r1 = ids
    r2 = _paired(r1, _shifted(r1, 1))
    r4 = _paired(r2, _shifted(r2, 2))
    seed = _paired(r4, _shifted(r1, 4))
    count = np.bincount(seed)
    rank = (np.cumsum(count) - count)[seed].astype(np.int32)
    tied = np.flatnonzero(count[seed] > 1)
    places, levels, h = tied, [], _SEED
    while len(tied):
        levels.append((h, rank.copy()))
        then = _shifted(rank, h)[tied]
        order = np.lexsort((then, rank[tied]))
        tied, then = tied[order], then[order]
        group = rank[tied]
        first = np.r_[True, group[1:] != group[:-1]]
        new = first | np.r_[True, then[1:] != then[:-1]]
        at = np.arange(len(tied))
        opened = np.maximum.accumulate(np.where(first, at, 0))
        rank[tied] = group + np.maximum.accumulate(np.where(new, at, 0)) - opened
        alone = new & np.r_[new[1:], True]
        tied, h = tied[~alone], 2 * h
    places = places[np.argsort(rank[places])]
    a, b = places[:-1].copy(), places[1:].copy()
    for h, rank in [*reversed(levels), (4, r4), (2, r2), (1, r1)]:
        rank = np.r_[rank, -1]
        same = (rank[np.minimum(a, len(ids))] == rank[np.minimum(b, len(ids))]) & (np.maximum(a, b) < len(ids))
        a += h * same
        b += h * same
    return places, a - places[:-1]


class _Interval:
    """An LCP interval: its places in order, and the left word that all of them have, if it is one."""

    __slots__ = ("depth", "places", "left")

    def __init__(self, place: int, left: int):
        self.depth, self.places, self.left = 0, [place], left


def _meet(a: _Interval, b: _Interval, lefts: list[int], periods: int, out: list[tuple[int, int, int]]) -> None:
    """b's places go into a, of a's depth; pairs of one of a and one of b with different left words are looked for within reach.

    A class of places with one left word makes no pair within itself. Of the
    places of another class only the nearest on each side can be a period away: if
    another occurrence lay in between, the shared words had a shorter period. So
    the class lists are kept together in order of place, and each place of the
    smaller child looks at its two neighbours in the larger.
    """
    if len(a.places) < len(b.places):
        a.places, b.places, a.left, b.left = b.places, a.places, b.left, a.left
    large, depth = a.places, a.depth
    reach = depth // (periods - 1)
    if a.left is None or a.left != b.left:
        for i in b.places:
            k = bisect_left(large, i)
            if k and i - large[k - 1] <= reach and lefts[i] != lefts[large[k - 1]]:
                out.append((large[k - 1], depth + i - large[k - 1], i - large[k - 1]))
            if k < len(large) and large[k] - i <= reach and lefts[i] != lefts[large[k]]:
                out.append((i, depth + large[k] - i, large[k] - i))
        a.left = None
    if 8 * len(b.places) > len(large):
        large.extend(b.places)
        large.sort()
    else:
        for i in b.places:
            large.insert(bisect_left(large, i), i)


def maximal_pairs(ids: np.ndarray, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(place, length, distance) of the maximal pairs that are runs of at least so many periods, and of five shared words at least."""
    places, shared = sorted_suffixes(ids)
    lefts = [-1, *ids[:-1].tolist()]
    out: list[tuple[int, int, int]] = []
    open_: list[_Interval] = []
    for place, depth in zip(places.tolist(), [*shared.tolist(), 0]):
        node = _Interval(place, lefts[place])
        while open_ and open_[-1].depth > depth:
            _meet(open_[-1], node, lefts, periods, out)
            node = open_.pop()
        if open_ and open_[-1].depth == depth:
            _meet(open_[-1], node, lefts, periods, out)
        elif depth >= _SEED:
            node.depth = depth
            open_.append(node)
    return out


def found(texts: Iterable[list[str]], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[Run]]:
    """The runs of each list of words, by start and period. The lists are sorted as one, in which no two share a word."""
    begins, parts, n = [], [], 0
    words_so_far = 0
    for words in texts:
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)) + words_so_far)
        begins.append(n)
        n, words_so_far = n + len(words), words_so_far + len(number)
    out: list[list[Run]] = [[] for _ in begins]
    if not n:
        return out
    smallest: dict[tuple[int, int], int] = {}
    for start, length, period in maximal_pairs(np.concatenate(parts), periods):
        if length >= least:
            smallest[start, length] = min(period, smallest.get((start, length), period))
    runs = sorted((start, period, length) for (start, length), period in smallest.items())
    owner = np.searchsorted(begins, [r[0] for r in runs], "right") - 1
    for (start, period, length), k in zip(runs, owner.tolist()):
        out[k].append((start - begins[k], length, period))
    return out


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge).tolist()) if not inside]


def _together(texts: Iterable[str | None]) -> Iterator[list[list[str]]]:
    """Texts as words, in groups of bounded size."""
    word, held, n = re.compile(WORD), [], 0
    for text in texts:
        words = word.findall(text or "")
        if held and n + len(words) > _TOGETHER:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def with_runs(
    docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> DataFrame:
    """docs with `runs`, an array of (start, length, period) by start and period, and `collapsed`, the kept words with one space between.

    Words are numbered from 0. least is at least 6 and periods at least 4, so that a
    pair shares five words. Null and empty texts have no runs and an empty collapsed
    text; equal rows give equal rows; an empty table gives none; columns of docs of
    the new names are replaced. A long text takes time and memory in proportion to
    its words, times the logarithm of its longest repeat.
    """
    if least < LEAST_WORDS or periods < LEAST_PERIODS:
        raise ValueError("runs of fewer than six words or four periods aren't looked for")
    def find(texts: list) -> dict[str, pa.Array]:
        rows, short = [], []
        for group in _together(texts):
            for words, runs in zip(group, found(group, least, periods)):
                rows.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                short.append(" ".join(collapsed(words, runs)))
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return {runs_col: pa.array(rows, kind), collapsed_col: pa.array(short, pa.string())}

    hidden = unused(docs, "__whole")
    texts = docs.withColumn(hidden, F.col(text_col).cast("string"))
    return with_columns_from(texts, hidden, find, f"`{runs_col}` array<struct<start: long, length: long, period: long>>, `{collapsed_col}` string", drop=True)
