"""The shingle join against brute force, and its parts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from streakline.llm import jaccard


def brute(rows):
    """{id: (size, component)} with sets of words."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    home = list(range(len(rows)))

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                home[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), id_), id_)
    return {id_: (len(sets[i]), least[root(i)]) for i, (id_, _) in enumerate(rows)}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}


def mutated(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return words


def copies(seed, n=140):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    bases = [[f"w{rng.randrange(4_000)}" for _ in range(rng.choice((6, 12, 40, 90, 300)))] for _ in range(n // 7)]
    rows = []
    for i in range(n):
        words = mutated(rng, rng.choice(bases), rng.choice((0, 0, 1, 2, 4)))
        if i % 5 == 0:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        rows.append((i * 3 + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = copies(seed)
    assert found(table(spark, rows)) == brute(rows)


def test_small_tiles_ranges_and_leaves_change_nothing(spark, monkeypatch):
    rows = copies(3)
    monkeypatch.setattr(jaccard, "TILE", 5)
    monkeypatch.setattr(jaccard, "POSTINGS", 200)
    monkeypatch.setattr(jaccard, "SEEN", 2)
    monkeypatch.setattr(jaccard, "NEEDED", 0)
    assert found(table(spark, rows)) == brute(rows)


def test_without_the_stars_the_exact_search_finds_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_minima", lambda h: [int(h[0] & np.uint64(0x7FFFFFFF))] * jaccard.BINS)
    rows = copies(4, 80)
    assert found(table(spark, rows)) == brute(rows)


def test_threshold_is_met_exactly(spark):
    base = [f"w{i}" for i in range(11)]  # 7 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:10])), (3, " ".join(base[:9])), (4, "a b c d"), (5, "A b\tc  d"), (6, "a b c")]
    assert found(table(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t\n\x0b"), (2, "one two"), (1, "ONE two"), (7, "one\xa0two"), (9, "ÉTÉ"), (8, "été")]
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, [])) == {}
    repeated = table(spark, [(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)])
    got = sorted(jaccard.jaccard_components(repeated).collect(), key=str)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles] == [(2, 2, 2), (2, 2, 2), (None, 2, 2)]
    assert len(got) == 4


def test_a_very_long_text(spark):
    words = [f"v{i}" for i in range(300_000)]
    changed = words[:1_000] + ["y"] + words[1_001:]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, "x" * 3_000_000 + " y")]
    assert found(table(spark, rows)) == {1: (299_996, 1), 2: (299_996, 1), 3: (1, 3)}


def test_large_sets_link_without_the_stars(spark, monkeypatch):
    described = jaccard._described

    def starless(batches):
        """Runs on the workers: minima that no two sets share."""
        own = jaccard._minima
        jaccard._minima = lambda h: [(int(np.bitwise_xor.reduce(h)) + i) & 0x7FFFFFFF for i in range(jaccard.BINS)]
        try:
            yield from described(batches)
        finally:
            jaccard._minima = own

    monkeypatch.setattr(jaccard, "_described", starless)
    words = [f"v{i}" for i in range(100_000)]
    changed = words[:1_000] + ["y"] + words[1_001:]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:60_000])), (4, "a b c d e f")]
    assert found(table(spark, rows)) == {1: (99_996, 1), 2: (99_996, 1), 3: (59_996, 3), 4: (2, 4)}


@pytest.mark.parametrize("n", [1_000, 100_000, 3_000_000])
def test_counts_of_any_size_bound_the_overlap(n):
    h = jaccard._mixed(np.arange(n, dtype=np.uint64))
    groups = jaccard._fine_groups(n)
    fine = np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    blob, coarse = jaccard._bytes(fine), jaccard._bytes(jaccard._fold(fine, jaccard.GROUPS))
    assert jaccard._may_link([n], [blob], [n], [blob]).tolist() == [True]
    small_ = jaccard._bytes(np.ones(jaccard.GROUPS, np.int64))
    points = (jaccard._coarse(pd.Series([coarse, small_])), *[np.array([n, jaccard.GROUPS])] * 2)
    assert points[0].sum(axis=1, dtype=np.int64).tolist() == [n, jaccard.GROUPS]
    assert jaccard.CountTree._may(points, np.array([0, 0]), points, np.array([0, 1])).tolist() == [True, False]


def test_one_of_each_stays(spark):
    rows = copies(5, 70) + [(1_000, None), (1_001, "")]
    docs = table(spark, rows).withColumns({"id": F.lit(1), "node": F.lit("n"), "text_hash": F.lit(0), "n": F.lit(2)})
    kept = jaccard.first_of_each(docs.unionByName(docs))
    want = {i for i, (_, c) in brute(rows).items() if i == c}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_words_hash_like_words():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("a", "bb", "ab", "ba", "é", "x1")) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    for text in texts:
        w = text.split()
        assert len(jaccard.shingles(text)) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    assert len({jaccard.shingles(t).tobytes() for t in texts}) == len({tuple(sorted({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))})) for t in texts})


def test_slices_cut_at_words(monkeypatch):
    text = "  " + " ".join(f"word{i}" for i in range(100)) + "\n"
    whole = jaccard.shingles(text)
    monkeypatch.setattr(jaccard, "_SLICE", 7)
    assert (jaccard.shingles(text) == whole).all()


@pytest.mark.parametrize("n,m", [(1, 1), (16, 17), (300, 300), (5, 400)])
def test_tree_yields_every_pair_that_may_link(n, m):
    rng = np.random.default_rng(n + m)
    a, b = (rng.poisson(3, (k, jaccard.GROUPS)).astype(np.uint32) for k in (n, m))
    b[: min(n, m) // 2] = a[: min(n, m) // 2]
    one, two = jaccard.CountTree(a, a.sum(axis=1)), jaccard.CountTree(b, b.sum(axis=1))
    got = [(int(i), int(j)) for x, y in one.pairs(two) for i, j in zip(x, y)]
    bound = np.minimum(a[:, None], b[None]).sum(axis=2) * 175
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(bound >= 75 * (a.sum(axis=1)[:, None] + b.sum(axis=1)[None])))}
    assert set(got) == want and len(got) == len(want)


def test_frequent_shingles_reach_the_driver_packed(spark, monkeypatch):
    seen = [(int(h), 4 + i % 7) for i, h in enumerate(np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 30_000))]
    monkeypatch.setattr(jaccard, "FREQUENT", 20_000)
    often = spark.createDataFrame(pd.DataFrame(seen, columns=["shingle", "seen"]))
    given, collect = [], type(often).collect
    monkeypatch.setattr(type(often), "collect", lambda self: given.append(collect(self)) or given[-1])
    found = jaccard._most_seen(often)
    of = {n: set(np.array([h for h, m in seen if m == n]).view(np.uint64).tolist()) for n in range(4, 11)}
    got = set(found.tolist())
    assert sorted(got) == found.tolist()
    assert all(of[n] <= got for n in range(7, 11)) and not any(of[n] & got for n in (4, 5))
    assert abs(len(got) - 20_000) < 300  # of those seen six times a share
    assert sum(map(len, given)) < 20


def test_no_frequent_shingles(spark):
    assert len(jaccard._most_seen(spark.createDataFrame([], "shingle long, seen long"))) == 0


def test_points_of_one_home_are_not_compared(monkeypatch):
    rng = np.random.default_rng(8)
    counts = rng.poisson(3, (400, jaccard.GROUPS)).astype(np.uint32)
    counts[200:] = counts[:200]
    sizes = counts.sum(axis=1)
    homes = np.where(np.arange(400) % 200 < 150, 7, np.arange(400))
    seen, may = [], jaccard.CountTree._may
    monkeypatch.setattr(jaccard.CountTree, "_may", staticmethod(lambda one, i, two, j: seen.append(len(i)) or may(one, i, two, j)))
    tree = jaccard.CountTree(counts, sizes, homes)
    got = [tuple(sorted((int(i), int(j)))) for x, y in tree.pairs(tree, apart=True) for i, j in zip(x, y)]
    bound = np.minimum(counts[:, None], counts[None]).sum(axis=2) * 175 >= 75 * (sizes[:, None] + sizes[None])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(bound & (homes[:, None] != homes[None]))) if i < j}
    assert set(got) == want and len(got) == len(want)
    seen.clear()
    one = jaccard.CountTree(counts, sizes, np.full(400, 7))
    assert not list(one.pairs(one, apart=True)) and not sum(seen)


def test_pairs_held_back_are_told():
    frame = pd.DataFrame({"node": range(8), "home": [0, 0, 0, 0, 4, 4, 4, 7], "n": 9, "tile": 0, "left": 0, "right": 0})
    rows = jaccard._Rows(frame.assign(coarse=[bytes(jaccard.GROUPS)] * 8))
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(4) for j in (4, 5, 6, 7)]))
    got = jaccard._named(rows, a, b, 4)
    assert got.groupby(["low", "high"])["more"].agg(["size", "any"]).to_dict("index") == {
        (0, 4): {"size": 4, "any": True},
        (0, 7): {"size": 4, "any": False},
    }
    assert len(jaccard._named(rows, a, b, None)) == 16


def test_pairs_held_back_are_searched_in_the_second_run(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_minima", lambda h: [int(h[0] & np.uint64(0x7FFFFFFF))] * jaccard.BINS)
    monkeypatch.setattr(jaccard, "FEW", 1)
    monkeypatch.setattr(jaccard, "WAITING", 3)
    rows = copies(7, 90)
    assert found(table(spark, rows)) == brute(rows)


def test_tables_that_are_stored_on_the_way_are_few(spark, monkeypatch):
    """Each costs shuffles of as many tasks as there are partitions, however small the tables are."""
    from streakline.llm import common

    stored, calls = common.stored, []
    for module in (common, jaccard):
        monkeypatch.setattr(module, "stored", lambda df: calls.append(1) or stored(df))
    rows = copies(1)
    assert found(table(spark, rows)) == brute(rows)
    assert len(calls) <= 50


def test_steps_over_texts_hold_a_batch_and_little_else():
    """What a task of a step allocates at most, in hashes of its batch; with whole sets kept there were several times as many."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 400))) for _ in range(6_000)]
    batch = pa.RecordBatch.from_pydict({"id": range(6_000), "text_hash": range(6_000), "node": range(6_000), "text": texts})
    whole = 6_000 * 396 * 8
    for step in (jaccard._gathered(4), jaccard._posted(np.empty(0, np.uint64), 4), jaccard._described, jaccard._sets):
        for _ in step(iter([batch.slice(0, 10)])):
            pass
        tracemalloc.start()
        rows = sum(len(out) for out in step(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and most < whole


def test_postings_are_whole_and_come_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "DEALT", 50)
    texts = [text for _, text in copies(8, 60)] + [None, "", " "]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[at : at + 7], pa.string())}) for at in range(0, len(texts), 7)]
    got = []
    for out in jaccard._posted(np.empty(0, np.uint64), 3)(iter(batches)):
        for row in out.to_pylist():
            h, node = np.frombuffer(row["shingles"], np.uint64), np.frombuffer(row["nodes"], np.int64)
            assert len(h) == len(node) and set((jaccard._mixed(h) % np.uint64(3)).tolist()) == {row["part"]}
            got += zip(h.tolist(), node.tolist())
    sets = {s.tobytes(): s for s in map(jaccard.shingles, texts) if len(s)}
    want = [(h, jaccard._signed(jaccard.xxhash.xxh3_64_intdigest(k))) for k, s in sets.items() for h in s[: len(s) - jaccard._least(len(s)) + 1].tolist()]
    assert sorted(got) == sorted(want)
    dealt = [h for out in jaccard._gathered(3)(iter(batches)) for x in out.column("shingles").to_pylist() for h in np.frombuffer(x, np.uint64).tolist()]
    assert sorted(dealt) == sorted(h for t in texts for h in jaccard.shingles(t).tolist())
