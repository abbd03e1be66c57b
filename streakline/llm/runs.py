"""Periodic runs of words: maximal stretches that repeat themselves at least once.

Every run has a root that is a Lyndon word for one of two opposite orders of
the words, and the longest Lyndon word that begins at a position ends where the
next smaller suffix begins. Ranks of suffixes come from a suffix tree (Ukkonen);
each (position, next smaller suffix) is a candidate. It is extended to the right
by the longest common extension of two suffixes, the depth of their lowest
common ancestor, and to the left in the tree of the reversed words. Ancestors
are found in constant time: the Euler tour, folded to the least depth between
neighbouring leaves, under a table of minima.

Trees are built only where a run can lie: within a run of period q, all six
words in a row from its start to q + 6 before its end come again q words later.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a run at least, whatever its period, and words in a row that tell where one can lie.
LEAST, GRAM = 12, 6


class SuffixTree:
    """Ukkonen's tree of whole numbers from 1 on; the end counts as 0."""

    def __init__(self, signs: Sequence[int]):
        text = [*signs, 0]
        self.n, width = len(text), max(text) + 1
        begin, end, link = [0], [0], [0]
        below: dict[int, int] = {}
        node = edge = length = open_ = 0
        last = self.n
        for i, sign in enumerate(text):
            split_before = 0
            open_ += 1
            while open_:
                if not length:
                    edge = i
                way = node * width + text[edge]
                child = below.get(way)
                if child is None:
                    below[way] = len(begin)
                    begin.append(i)
                    end.append(last)
                    link.append(0)
                    if split_before:
                        link[split_before] = node
                    split_before = node
                else:
                    low = begin[child]
                    size = min(end[child], i + 1) - low
                    if length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                    if text[low + length] == sign:
                        length += 1
                        if split_before:
                            link[split_before] = node
                        break
                    split = len(begin)
                    below[way] = split
                    begin += (low, i)
                    end += (low + length, last)
                    link += (0, 0)
                    below[split * width + sign] = split + 1
                    begin[child] = low + length
                    below[split * width + text[low + length]] = child
                    if split_before:
                        link[split_before] = split
                    split_before = split
                open_ -= 1
                if not node and length:
                    length -= 1
                    edge = i - open_ + 1
                else:
                    node = link[node]
        self._begin, self._end, self.nodes = begin, end, len(begin)
        ways = np.fromiter(below, np.int64, len(below))
        self._child = np.fromiter(below.values(), np.int64, len(below))
        self._above, self._sign, self._width = ways // width, ways % width, width

    def leaves(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, words rising or falling (the end is least in both), and depths of the ancestors of neighbours."""
        sign = np.where(falling & (self._sign > 0), self._width - self._sign, self._sign)
        # last children first: a stack hands out the least one first
        order = np.lexsort((-sign, self._above))
        children = self._child[order].tolist()
        bounds = np.searchsorted(self._above[order], np.arange(self.nodes + 1)).tolist()
        begin, end, n = self._begin, self._end, self.n
        suffixes, between = [], []
        stack = [(0, 0, 0)]
        least = 0
        while stack:
            node, depth, above = stack.pop()
            if above >= 0:  # not the first child: the tour passed through the parent
                least = above
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                suffixes.append(n - depth)
                between.append(least)
                continue
            for child in children[a : b - 1]:
                stack.append((child, depth + end[child] - begin[child], depth))
            child = children[b - 1]
            stack.append((child, depth + end[child] - begin[child], -1))
        return np.array(suffixes, np.int64), np.array(between, np.int32)


class Extensions:
    """Longest common extensions of suffixes by the least depth between their leaves."""

    def __init__(self, suffixes: np.ndarray, between: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.tables = [between]  # entry k: between leaves k - 1 and k
        width = 1
        while 2 * width <= len(between):
            low = self.tables[-1]
            self.tables.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from positions ``a`` and ``b`` on; the two differ everywhere."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        size = high - low + 1
        level = np.frexp(size)[1] - 1
        found = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            table = self.tables[k]
            found[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        return found


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every position but the last the next one with a smaller rank; the last (the end) has the smallest."""
    ranks = rank.tolist()
    found, waiting = [0] * len(ranks), []
    for i, value in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > value:
            found[waiting.pop()] = i
        waiting.append(i)
    return np.array(found[:-1], np.int64)


def tree_runs(signs: Sequence[int]) -> np.ndarray:
    """(start, end, period) of all runs of ``signs`` (from 1 on), any length from twice the period on."""
    n = len(signs)
    tree = SuffixTree(signs)
    rising, between = tree.leaves()
    falling, _ = tree.leaves(falling=True)
    del tree
    right = Extensions(rising, between)
    left = Extensions(*SuffixTree(signs[::-1]).leaves())
    rank = np.empty(n + 1, np.int64)
    rank[falling] = np.arange(n + 1)
    found = []
    for ranks in (right.rank, rank):
        i, j = np.arange(n), _next_smaller(ranks)
        start, end = i - left.of(n - i, n - j), j + right.of(i, j)
        found.append(np.stack([start, end, j - i], 1)[end - start >= 2 * (j - i)])
    return np.unique(np.concatenate(found), axis=0)


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches of words that hold every run, whole.

    Of a run of period q, all starts of six words up to q + 6 before its end
    come again at most q later. A stretch of such starts from u to v, m of them,
    holds runs of periods up to m + 5 only, which end before v + m + 12.
    """
    n = len(ids) - GRAM + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return []
    ahead = np.zeros(n, np.int64)  # distance to the next equal six, 0 for none
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    edges = np.flatnonzero(np.diff((ahead > 0).astype(np.int8), prepend=0, append=0))
    first, after = edges[::2], edges[1::2]
    size = after - first
    least = np.minimum.reduceat(np.where(ahead > 0, ahead, n), np.stack([first, after], 1).ravel()[: 2 * len(first) - (after[-1] == n)])[::2]
    merged: list[tuple[int, int]] = []
    for u, v, m in zip(*(x[least <= size + GRAM - 1].tolist() for x in (first, after, size))):
        stop = min(len(ids), v + m + LEAST)
        if merged and u <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((u, stop))
    return merged


def word_runs(words: Sequence[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words`` of at least ``LEAST`` words, by start, then period."""
    if len(words) < LEAST:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = []
    for a, b in _stretches(ids):
        signs = np.unique(ids[a:b], return_inverse=True)[1] + 1
        found += [(a + s, e - s, q) for s, e, q in tree_runs(signs.tolist()).tolist() if e - s >= LEAST]
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return list(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(steps).tolist()) if not inside]


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space; none for null."""
    return text.encode().split() if text else []


def looped(words: list[bytes], key: int | None) -> list[bytes]:
    """The sample's planted loops: of every tenth key, the words from one on repeat some of the first of them."""
    if key is None or not words:
        return words
    draw, tenth = divmod(zlib.crc32(str(key).encode()), 10)
    if tenth:
        return words
    n = len(words)
    a = draw % n
    period = 1 + (n - a) // (3 + draw % 8)
    return words[:a] + (words[a : a + period] * (1 + (n - a) // period))[: n - a]


def _mapped(docs: DataFrame, key: str, schema: str, columns: list[str], one: Callable) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [None if pd.isna(k) else k for k in batch["key"]]
            made = pd.DataFrame([one(k, words_of(t)) for k, t in zip(keys, batch["text"])], columns=columns, dtype=object)
            made.insert(0, key, batch["key"])
            yield made

    source = docs.select(F.col(f"`{key}`").alias("key"), "text")
    return source.mapInPandas(work, f"`{key}` {source.schema['key'].dataType.simpleString()}, {schema}")


def find_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, runs): every run of each text as (start, length, period), by start, then period.

    Words are numbered from 0. Null and empty texts have none; each row stands
    for itself, whatever its key. Memory grows with the longest stretch of one
    text that can hold runs, about 500 bytes a word.
    """
    return _mapped(docs, key, "runs array<struct<start:long,length:long,period:long>>", ["runs"], lambda _, words: (word_runs(words),))


def collapse_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): texts of words joined by one space, without what repeats a run's first period; null becomes empty."""

    def one(_, words: list[bytes]) -> tuple:
        return (b" ".join(without_repeats(words, word_runs(words))).decode(),)

    return _mapped(docs, key, "text string", ["text"], one)


def run_digests(docs: DataFrame, key: str = "doc_id", prepare: Callable[[list[bytes], int | None], list[bytes]] = looped) -> DataFrame:
    """Digest: number of runs, the longest one, and checksums of all runs and of the collapsed text.

    ``prepare`` changes the words of a document first. The longest run is the
    first of equally long ones, then that of the smallest period; without runs
    its columns are null. A null text has no words, a null key is never looped.
    """

    def one(number: int | None, words: list[bytes]) -> tuple:
        words = prepare(words, number)
        runs = word_runs(words)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(without_repeats(words, runs))
        digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        return len(runs), start, length, period, 1000 * length // period if runs else None, *digests

    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in columns)
    return _mapped(docs, key, types, columns, one)
