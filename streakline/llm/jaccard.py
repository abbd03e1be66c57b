"""Exact Jaccard join over word shingles with a count-vector R-tree.

A document is its set of distinct shingles of ``WORDS`` words. Two sets link
when ``SHARE`` percent of their union is common. Steps:

1. Equal sets become one node.
2. Nodes that agree in a band of minima are compared with one node of the band,
   in two rounds and drawn anew for each of ``STARS``. The verified links join
   nearly all copies of a text, however many, by stars instead of pairs.
3. The exact search. Linked sets share a shingle among the first
   ``size - ceil(SHARE% of size) + 1`` of both, in any common order; those are
   posted to lists by shingle. Frequent shingles come last in that order, which
   keeps lists short and changes no result.
4. A list that spans two components of step 2 is searched with an R-tree:
   shingles are hashed into groups, a node is the point of its group counts, and
   the sum of the smaller coordinates bounds the overlap of two points or boxes.
   Boxes of one component are not compared with each other. Long lists are cut
   into tiles, and pairs of tiles go to different tasks.
5. Pairs are bounded again with finer group counts, and what remains is verified
   with the sets themselves.
6. Links merge components. Steps 4 and 5 run first with a few pairs of each two
   components, then with all pairs of those that still are two and had more.

Shingles are compared by 64-bit hashes. Only candidate pairs between different
components are ever made, never all pairs of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.llm.common import components, fraction, stored

WORDS = 5
SHARE = 75
#: Group counts of the R-tree's points; finer counts have a quarter to a half as many groups as shingles.
GROUPS = 256
FINEST = 8_192
#: Minima of a set; distances of the two that make a band, by round of stars: few for what most copies share, then the rest.
BINS = 16
STARS = ((1,), (3, 5, 7))
#: Pairs of two components that a task gives in the first run of step 4.
FEW = 4
#: Postings of one task of step 3, members of one tile of step 4, points of a leaf.
POSTINGS = 500_000
TILE = 4_096
#: Tasks that lists with one smallest node share; lists of more than ``SHORT`` members share so many times more.
SPREAD, SHORT = 4, 256
LEAF = 16
#: Hashes that a task of step 3 deals out at once, texts whose sets or counts it gives at once.
DEALT, GIVEN = 1 << 18, 1_000
#: Pairs of places that a task of step 4 names at once.
WAITING = 200_000
#: Frequent shingles: about so many at most, seen so often in a sample of about so many documents. They order, no more.
FREQUENT, SEEN, SAMPLE = 400_000, 4, 50_000
#: Nodes whose ids are broadcast to find their texts; beyond, a shuffle join.
NEEDED = 1_000_000

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte value, and a base that is odd and thus has an inverse.
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
#: Bytes of a text that are hashed at once; cut where a word ends.
_SLICE = 1 << 20


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    up, down = np.full(1 << bits, _BASE, np.uint64), np.full(1 << bits, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _words(data: bytes) -> np.ndarray:
    """Hashes of the words of a slice, by differences of a running polynomial."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(max(16, int(len(b)).bit_length()))
    running = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=running[1:])
    return _mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[2])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    h = (h ^ (h >> np.uint64(29))) * _MIX[4]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words are split at ASCII white space, A-Z in lower case.

    Fewer than ``WORDS`` words are one shingle; no word or a null text is the empty set.
    """
    data = text.encode("utf-8", "replace").lower() if text else b""
    w, at = [], 0
    while at < len(data):
        end = at + _SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        w.append(_words(data[at:end]))
        at = end
    w = np.concatenate(w) if w else np.empty(0, np.uint64)
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        if len(w) < WORDS:
            h = np.array([len(w)], np.uint64)
            for one in w:
                h = _mixed(h * _MIX[1] + one)
            return h
        last = len(w) - WORDS + 1
        h = w[:last] * _MIX[0]
        for i in range(1, WORDS):
            h = _mixed(h + w[i : last + i])
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _least(n: int) -> int:
    """Fewest common shingles of a set of ``n`` with any set that it links with."""
    return -(-n * SHARE // 100)


def _minima(h: np.ndarray) -> list[int]:
    """32 bits of the smallest hash of each bin; an empty bin takes the next one's."""
    edges = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(60))
    return (_mixed(h[edges % len(h)]) >> np.uint64(33)).tolist()


def _fine_groups(n: int) -> int:
    groups = GROUPS
    while groups * 4 <= n and groups < FINEST:
        groups *= 2
    return groups


def _bytes(counts: np.ndarray) -> bytes:
    """Counts as integers of 8, 16 or 32 bits, the least that holds them all; the length tells which."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _counts(blob: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // groups}")


def _fold(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(axis=0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
    """The texts of ``batches`` one at a time: a batch is never a column of Python strings."""
    for batch in batches:
        for text in batch.column("text"):
            yield text.as_py()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ``GIVEN`` texts at once, so that a task holds one batch of texts and little else."""
    types = {"node": pa.int64(), "n": pa.int64(), "minima": pa.list_(pa.int32()), "coarse": pa.binary(), "fine": pa.binary()}
    for batch in batches:
        for at in range(0, len(batch), GIVEN):
            part = batch.slice(at, GIVEN)
            rows = []
            for text in _texts([part]):
                h = shingles(text)
                n = len(h)
                if not n:
                    rows.append((None, 0, None, None, None))
                    continue
                fine = np.bincount((h & np.uint64(_fine_groups(n) - 1)).astype(np.int64), minlength=_fine_groups(n))
                coarse = _fold(fine, GROUPS)
                node = _signed(xxhash.xxh3_64_intdigest(h.tobytes()))
                rows.append((node, n, _minima(h), _bytes(coarse), _bytes(fine)))
            found = {name: pa.array(column, kind) for (name, kind), column in zip(types.items(), zip(*rows))}
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "text_hash": part.column("text_hash"), **found})


def _coarse(blobs: pd.Series) -> np.ndarray:
    if (blobs.str.len() == GROUPS).all():
        return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), GROUPS)
    return np.stack([_counts(x, GROUPS) for x in blobs])


def _dealt(h: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places of its members) for hashes dealt over ranges."""
    where = (_mixed(h) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(where[order[a]]), order[a:b]


def _gathered(ranges: int):
    """The shingles of all sets in blocks by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting = [], 0

        def blocks() -> pa.RecordBatch:
            h = np.concatenate(kept)
            parts, shares = zip(*((part, h[at].tobytes()) for part, at in _dealt(h, ranges)))
            return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "shingles": pa.array(shares, pa.binary())})

        for text in _texts(batches):
            kept.append(shingles(text))
            waiting += len(kept[-1])
            if waiting > DEALT:
                yield blocks()
                kept, waiting = [], 0
        if waiting:
            yield blocks()

    return run


def _frequent(group: pd.DataFrame) -> pd.DataFrame:
    """Shingles that ``SEEN`` sets of the sample have."""
    values, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group["shingles"]]), return_counts=True)
    often = counts >= SEEN
    return pd.DataFrame({"shingle": values[often].view(np.int64), "seen": counts[often]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"shingles": [batch["shingle"].to_numpy().tobytes()]})


def _most_seen(often: DataFrame) -> np.ndarray:
    """Sorted hashes of about ``FREQUENT`` shingles of the stored ``often``, those that most sets have.

    Counts tell how often a shingle must be seen; of those seen just so often
    their hashes choose a share. Tasks pack what they keep: the driver gets 8
    bytes for each, in blocks, no list of rows, and nobody sorts them all.
    """
    room, least, share = FREQUENT, 0, 1.0
    for row in often.groupBy("seen").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("seen")).collect():
        if row["n"] > room:
            least, share = row["seen"], room / row["n"]
            break
        room -= row["n"]
    kept = (F.col("seen") > least) | ((F.col("seen") == least) & (fraction("shingle") < share))
    blocks = often.where(kept).select("shingle").mapInPandas(_packed, "shingles binary").collect()
    return np.sort(np.frombuffer(b"".join(r["shingles"] for r in blocks), np.uint64))


def _posted(frequent: np.ndarray, ranges: int):
    """Blocks of (shingle, node) by range, for the first shingles of each node's set; a node once per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        kept: list[np.ndarray] = []
        nodes: list[int] = []
        waiting = 0

        def blocks() -> pa.RecordBatch:
            h, node = np.concatenate(kept), np.repeat(np.array(nodes, np.int64), [len(x) for x in kept])
            parts, shares, theirs = zip(*((part, h[at].tobytes(), node[at].tobytes()) for part, at in _dealt(h, ranges)))
            columns = {"part": pa.array(parts, pa.int32()), "shingles": pa.array(shares, pa.binary()), "nodes": pa.array(theirs, pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        for text in _texts(batches):
            h = shingles(text)
            if not len(h):
                continue
            node = _signed(xxhash.xxh3_64_intdigest(h.tobytes()))
            if node in done:
                continue
            done.add(node)
            first = len(h) - _least(len(h)) + 1
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                common = frequent[at] == h
                h = np.concatenate([h[~common], h[common]])
            # a copy: a slice would keep the whole set
            kept.append(h[:first].copy())
            nodes.append(node)
            waiting += first
            if waiting > DEALT:
                yield blocks()
                kept, nodes, waiting = [], [], 0
        if kept:
            yield blocks()

    return run


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """(shingle, node) of the shingles that two nodes or more have posted."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in group["shingles"]])
    node = np.concatenate([np.frombuffer(x, np.int64) for x in group["nodes"]])
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    h, node = h[new], node[new]
    run = np.ones(len(h), bool)
    run[1:] = h[1:] != h[:-1]
    sizes = np.diff(np.flatnonzero(np.append(run, True)))
    several = np.repeat(sizes > 1, sizes)
    return pd.DataFrame({"shingle": h[several].view(np.int64), "node": node[several]})


class CountTree:
    """Bulk-loaded R-tree over group counts; points are sorted by size and packed into leaves.

    With ``homes``, points of one home make no pair: a home that fills a leaf
    has boxes of its own, which are not compared with each other.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, homes: np.ndarray | None = None):
        if homes is None:
            homes = np.arange(len(sizes))
        _, which, members = np.unique(homes, return_inverse=True, return_counts=True)
        self.order = np.lexsort((sizes, np.where(members[which] > LEAF, which + 1, 0)))
        high = counts[self.order]
        small_, large = sizes[self.order], sizes[self.order]
        least, most = homes[self.order], homes[self.order]
        #: From the points up: (upper corners, smallest size, largest size, smallest home, largest home) of each level's boxes.
        self.levels = [(high, small_, large, least, most)]
        while len(high) > LEAF:
            cuts = np.arange(0, len(high), LEAF)
            high = np.maximum.reduceat(high, cuts, axis=0)
            small_, large = np.minimum.reduceat(small_, cuts), np.maximum.reduceat(large, cuts)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((high, small_, large, least, most))

    @staticmethod
    def _may(one, i, other, j) -> np.ndarray:
        """Whether boxes ``i`` of ``one`` and ``j`` of ``other`` can hold sets that link."""
        keep = np.empty(len(i), bool)
        for at in range(0, len(i), 50_000):
            a, b = i[at : at + 50_000], j[at : at + 50_000]
            overlap = np.minimum(one[0][a], other[0][b]).sum(axis=1, dtype=np.int64)
            overlap = np.minimum(overlap, np.minimum(one[2][a], other[2][b]))
            keep[at : at + 50_000] = overlap * (100 + SHARE) >= SHARE * (one[1][a] + other[1][b])
        return keep

    @staticmethod
    def _apart(one, i, other, j) -> np.ndarray:
        """Whether boxes ``i`` of ``one`` and ``j`` of ``other`` have points of two homes."""
        return (one[3][i] != other[4][j]) | (one[4][i] != other[3][j])

    def pairs(self, other: CountTree, apart: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(points here, points there) that may link, with each node of the trees visited once with each.

        With ``apart`` only those of two homes; then a tree gives each pair with itself once.
        """
        depth = max(len(self.levels), len(other.levels)) - 1

        def descend(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            one, two = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            if apart:
                keep = self._apart(one, i, two, j)
                if other is self:
                    keep &= i <= j
                i, j = i[keep], j[keep]
            keep = self._may(one, i, two, j)
            i, j = i[keep], j[keep]
            if not level:
                if len(i):
                    yield self.order[i], other.order[j]
                return
            below = [t.levels[min(level - 1, len(t.levels) - 1)] for t in (self, other)]
            steps = [LEAF if level < len(t.levels) else 1 for t in (self, other)]
            for at in range(0, len(i), 512):
                a, b = i[at : at + 512], j[at : at + 512]
                a2 = (a[:, None, None] * steps[0] + np.arange(steps[0])[None, :, None]) + np.zeros((1, 1, steps[1]), np.int64)
                b2 = (b[:, None, None] * steps[1] + np.arange(steps[1])[None, None, :]) + np.zeros((1, steps[0], 1), np.int64)
                a2, b2 = a2.ravel(), b2.ravel()
                real = (a2 < len(below[0][1])) & (b2 < len(below[1][1]))
                yield from descend(level - 1, a2[real], b2[real])

        tops = [len(t.levels[-1][1]) for t in (self, other)]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(tops[0]), np.arange(tops[1]), indexing="ij"))
        yield from descend(depth, i, j)


class _Rows:
    """Columns of the rows of several lists."""

    def __init__(self, rows: pd.DataFrame):
        self.node, self.home, self.n, self.tile, self.left, self.right = (rows[c].to_numpy() for c in ("node", "home", "n", "tile", "left", "right"))
        self.counts = _coarse(rows["coarse"])


def _single_leaves(rows: _Rows, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (places in ``rows``) of lists that fill one leaf each: all of them are bounded at once.

    ``starts`` and ``sizes`` say where the lists lie in ``rows``.
    """
    points = (rows.counts, rows.n, rows.n)
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        apart = rows.home[a] != rows.home[b]
        a, b = a[apart], b[apart]
        keep = CountTree._may(points, a, points, b)
        yield a[keep], b[keep]


def _tree_pairs(rows: _Rows, start: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (places in ``rows``) of one (shingle, left, right)."""
    left, right = rows.left[start], rows.right[start]
    tile = rows.tile[start : start + size]
    one = start + np.flatnonzero(tile == left)
    two = one if left == right else start + np.flatnonzero(tile == right)
    if not len(one) or not len(two):
        return
    tree = CountTree(rows.counts[one], rows.n[one], rows.home[one])
    for i, j in tree.pairs(tree if left == right else CountTree(rows.counts[two], rows.n[two], rows.home[two]), apart=True):
        yield one[i], two[j]


def _named(rows: _Rows, a: np.ndarray, b: np.ndarray, few: int | None, at: np.ndarray | int = 0) -> pd.DataFrame:
    """Pairs of places as pairs of nodes (a, b) and of their homes (low, high).

    With ``few`` only so many, drawn by a hash, of each two homes in a list ``at``; ``more`` tells whether there are others.
    """
    node, home = rows.node, rows.home
    found = pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})
    found["low"], found["high"] = np.minimum(home[a], home[b]), np.maximum(home[a], home[b])
    found["more"] = False
    if few is None:
        return found.drop_duplicates(["a", "b"])
    found["at"] = at
    draw = _mixed(found["a"].to_numpy().view(np.uint64) * _MIX[0] + found["b"].to_numpy().view(np.uint64))
    found = found.iloc[np.argsort(draw)].drop_duplicates(["a", "b", "at"])
    both = found.groupby(["at", "low", "high"])
    found["more"] = both["a"].transform("size") > few
    return found[both.cumcount() < few].drop(columns="at").drop_duplicates(["a", "b", "more"])


def _tile_pairs(few: int | None):
    """Candidate pairs of each (shingle, left, right); rows of a tile come one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        given: set[tuple[int, int, bool]] = set()

        def new(pairs: pd.DataFrame) -> pd.DataFrame:
            """Those of ``pairs`` that this task has not given lately; a pair may come again, never be lost."""
            if len(given) > 100_000:
                given.clear()
            keys = list(zip(pairs["a"].tolist(), pairs["b"].tolist(), pairs["more"].tolist()))
            fresh = [k not in given for k in keys]
            given.update(keys)
            return pairs[fresh]

        def found(rows: pd.DataFrame, whole: bool) -> Iterator[pd.DataFrame]:
            """Pairs of all lists of ``rows`` but the last, which may go on in the next batch unless ``whole``."""
            nonlocal rest
            ids = rows[["shingle", "left", "right"]].to_numpy()
            starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
            sizes = np.diff(np.append(starts, len(rows)))
            if not whole:
                rest = rows.iloc[starts[-1] :]
                starts, sizes = starts[:-1], sizes[:-1]
            leaf = (sizes <= LEAF) & (ids[starts, 1] == ids[starts, 2])
            columns = _Rows(rows)
            leaves = ((-1, pairs) for pairs in _single_leaves(columns, starts[leaf], sizes[leaf]))
            trees = ((at, pairs) for at, size in zip(starts[~leaf], sizes[~leaf]) for pairs in _tree_pairs(columns, at, size))
            kept, waiting = [], 0

            def named() -> pd.DataFrame:
                a, b, at = map(np.concatenate, zip(*kept))
                return new(_named(columns, a, b, few, at))

            for at, (a, b) in chain(leaves, trees):
                kept.append((a, b, np.full(len(a), at)))
                waiting += len(a)
                if waiting > WAITING:
                    yield named()
                    kept, waiting = [], 0
            if waiting:
                yield named()

        for batch in batches:
            if len(batch):
                yield from found(batch if rest is None else pd.concat([rest, batch], ignore_index=True), False)
        if rest is not None:
            yield from found(rest.reset_index(drop=True), True)

    return run


def _may_link(n_a: pd.Series, fine_a: pd.Series, n_b: pd.Series, fine_b: pd.Series) -> pd.Series:
    """The bound with the finer counts, folded to what both sides have."""

    def may(n: int, x: bytes, m: int, y: bytes) -> bool:
        if min(n, m) * 100 < SHARE * max(n, m):
            return False
        a, b = (_counts(c, _fine_groups(k)).astype(np.int64) for k, c in ((n, x), (m, y)))
        groups = min(len(a), len(b))
        return int(np.minimum(_fold(a, groups), _fold(b, groups)).sum()) * (100 + SHARE) >= SHARE * (n + m)

    return pd.Series([may(*row) for row in zip(n_a, fine_a, n_b, fine_b)], dtype=bool)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, members): the sets of ``GIVEN`` texts at once."""
    for batch in batches:
        for at in range(0, len(batch), GIVEN):
            part = batch.slice(at, GIVEN)
            members = pa.array([shingles(text).view(np.int64) for text in _texts([part])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"node": part.column("node"), "members": members})


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The stored ``pairs`` (a, b) of nodes whose sets link, stored."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    where = needed.join(nodes.select("node", "id", "text_hash"), "node")
    if 2 * pairs.count() <= NEEDED:
        where = F.broadcast(where)
    same = texts["id"].eqNullSafe(where["id"]) & (texts["text_hash"] == where["text_hash"])
    found = texts.join(where, same).select("node", "text").dropDuplicates(["node"])
    sets = stored(found.mapInArrow(_sets, "node long, members array<long>"))
    left, right = (sets.select(F.col("node").alias(c), F.col("members").alias(f"members_{c}")) for c in "ab")
    common = F.size(F.array_intersect("members_a", "members_b")).cast("long")
    linked = common * (100 + SHARE) >= SHARE * (F.size("members_a").cast("long") + F.size("members_b"))
    return stored(pairs.join(left, "a").join(right, "b").where(linked).select(*pairs.columns))


def shingle_homes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(described, homes): one row per document with its node and set size; (node, home) with the smallest node that links reach."""
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    described = stored(
        texts.mapInArrow(
            _described,
            f"id {id_type}, text_hash long, node long, n long, minima array<int>, coarse binary, fine binary",
        )
    )
    # the id and text of one document of each node stand for it
    nodes = stored(described.where("n > 0").dropDuplicates(["node"]))
    described = described.select("id", "text_hash", "node", "n")
    homes = _stars(nodes, texts)

    # step 3: lists of shingles
    total = described.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - F.ceil(F.col("n") * SHARE / 100) + 1).alias("p"), F.count(F.lit(1)).alias("d")
    ).first()
    ranges = max(1, -(-int(total["p"] or 0) // POSTINGS))
    every = max(1, total["d"] // SAMPLE)
    often = stored(
        texts.where(F.pmod(F.xxhash64("id", "text_hash"), F.lit(every)) == 0)
        .select("text")
        .mapInArrow(_gathered(max(1, int(total["n"] or 0) // every // POSTINGS)), "part int, shingles binary")
        .groupBy("part")
        .applyInPandas(_frequent, "shingle long, seen long")
    )
    frequent = _most_seen(often)
    shared = stored(
        texts.select("text")
        .mapInArrow(_posted(frequent, ranges), "part int, shingles binary, nodes binary")
        .groupBy("part")
        .applyInPandas(_shared, "shingle long, node long")
    )
    candidates = _candidates(shared, nodes, homes, FEW)
    homes = _merged(homes, _verified(_bounded(candidates, nodes), texts, nodes))
    still = _still_open(candidates, homes)
    if still.count():
        candidates = _candidates(shared, nodes, homes.join(still, "home", "left_semi"), None)
        homes = _merged(homes, _verified(_bounded(candidates, nodes), texts, nodes))
    return described, homes


def _still_open(candidates: DataFrame, homes: DataFrame) -> DataFrame:
    """(home), stored: of each two homes that had more ``candidates`` than were given, and still are two."""
    held = candidates.where("more").select("low", "high").distinct()
    for side in ("low", "high"):
        now = homes.select(F.col("node").alias(side), F.col("home").alias(f"{side}_home"))
        held = held.join(now, side)
    apart = held.where("low_home <> high_home")
    return stored(apart.select(F.explode(F.array("low_home", "high_home")).alias("home")).distinct())


def _candidates(shared: DataFrame, nodes: DataFrame, homes: DataFrame, few: int | None) -> DataFrame:
    """Step 4: pairs of nodes with different homes that may link, by R-trees over tiles of the lists.

    Stored, with the homes and whether a list has more pairs of the two: (a, b, low, high, more).
    """
    entries = stored(shared.join(homes, "node"))
    lists = entries.groupBy("shingle").agg(
        F.min("home").alias("low"), F.max("home").alias("high"), F.min("node").alias("first"), F.count(F.lit(1)).alias("members")
    )
    # copies share many lists: lists with one smallest node go to few tasks, which give a pair once; long lists go to more
    task = F.xxhash64("first", F.pmod("shingle", F.lit(SPREAD) * F.ceil(F.col("members") / SHORT)))
    lists = stored(
        lists.where("low <> high").select("shingle", task.alias("task"), F.ceil(F.col("members") / TILE).cast("int").alias("tiles"))
    )
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    against = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = (
        entries.join(lists, "shingle")
        .withColumn("tile", tile)
        .withColumn("against", against)
        .select("task", "shingle", "node", "home", "tile", F.least("tile", "against").alias("left"), F.greatest("tile", "against").alias("right"))
        .join(nodes.select("node", "n", "coarse"), "node")
    )
    return stored(
        tiled.repartition("task", "left", "right")
        .sortWithinPartitions("shingle", "left", "right")
        .mapInPandas(_tile_pairs(few), "a long, b long, low long, high long, more boolean")
        .groupBy("a", "b", "low", "high")
        .agg(F.max("more").alias("more"))
    )


def _merged(homes: DataFrame, links: DataFrame) -> DataFrame:
    """``homes`` after the stored ``links`` (low, high) between them."""
    moved = components(links.select(F.col("low").alias("a"), F.col("high").alias("b")))
    joined = homes.join(moved.withColumnRenamed("node", "home"), "home", "left")
    return stored(joined.select("node", F.coalesce("component", "home").alias("home")))


def _stars(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, home) of every node after all rounds.

    Bands are pairs of minima: a passage that many texts share gives one of the
    two more often than both. Only bands that still span two homes take part.
    """
    homes = nodes.select("node", F.col("node").alias("home"))
    for turn, distances in enumerate(STARS):
        bins = [(i, d) for d in distances for i in range(0, BINS, 1 if turn else 2)]
        bands = [F.struct(F.lit(d).alias("d"), F.xxhash64(F.lit(i), F.col("minima")[i], F.col("minima")[(i + d) % BINS]).alias("band")) for i, d in bins]
        placed = nodes.select("node", "minima").join(homes, "node") if turn else nodes.withColumn("home", F.col("node"))
        banded = stored(placed.select("node", "home", F.explode(F.array_distinct(F.array(*bands))).alias("at")).select("at.*", "node", "home"))
        drawn = F.min(F.struct(F.xxhash64("node", "d").alias("draw"), "node", "home"))
        leads = banded.groupBy("d", "band").agg(drawn.alias("lead"), F.min("home").alias("least"), F.max("home").alias("most"))
        leads = stored(leads.where("least <> most").select("d", "band", F.col("lead.node").alias("lead"), F.col("lead.home").alias("lead_home")))
        near = banded.join(leads, ["d", "band"]).where("home <> lead_home")
        sides = [(F.least, "node", "lead", "a"), (F.greatest, "node", "lead", "b"), (F.least, "home", "lead_home", "low"), (F.greatest, "home", "lead_home", "high")]
        near = near.select(*[pick(x, y).alias(name) for pick, x, y, name in sides]).distinct()
        homes = _merged(homes, _verified(_bounded(near, nodes), texts, nodes))
    return homes


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that the finer counts leave, stored."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}")) for c in "ab")
    may = F.pandas_udf(_may_link, "boolean")("n_a", "fine_a", "n_b", "fine_b")
    return stored(pairs.join(left, "a").join(right, "b").where(may).select(*pairs.columns))


def shingle_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, component_id) for every row: ``component_id`` is the smallest id that links reach.

    Null and empty texts have size 0 and their own id as component. Rows that
    repeat each other are in one component. Of null ids a component keeps the
    smallest other id, or null. An empty table gives an empty result.
    """
    described, homes = shingle_homes(docs, key, text)
    placed = stored(described.join(homes, "node", "left"))
    least = stored(placed.where("n > 0").groupBy("home").agg(F.min("id").alias("component_id")))
    return placed.join(least, "home", "left").select(
        "id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def first_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; same columns.

    Documents without words all stay, but of rows that repeat id and text one stays.
    """
    found = stored(shingle_components(docs, key))
    keep = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select("id", "text_hash").distinct()
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(f"`{key}`").alias("_id"),
        F.xxhash64("text").alias("_hash"),
    )
    same = packed["_id"].eqNullSafe(keep["id"]) & (packed["_hash"] == keep["text_hash"])
    return packed.join(keep, same, "left_semi").dropDuplicates(["_id", "_hash"]).select("doc.*")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, n_shingles and component_id of every document."""
    found = shingle_components(docs.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
