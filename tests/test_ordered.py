"""Running aggregates and percentiles: the chunked way must equal the plain one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streakline.operators.distributions import (
    box_stats,
    error_metrics,
    histogram,
    percentiles,
    residual_summary,
    spread,
)
from streakline.operators.ordered import block_of, last_rows, order_groups


def skewed_rows(n=900, seed=3):
    """One key holds more than a third of the rows; one key is NULL."""
    rnd = random.Random(seed)
    keys = ["hot"] * (n // 2) + [None] * (n // 6) + [f"k{i % 7}" for i in range(n // 3)]
    rows = [(k, rnd.randrange(50), i, rnd.randrange(-5, 6)) for i, k in enumerate(keys)]
    rnd.shuffle(rows)
    return rows


def brute_running(rows, exclusive):
    expected = {}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    for members in groups.values():
        total, best = 0, None
        for _, t, i, v in sorted(members, key=lambda r: (r[1], r[2])):
            if exclusive:
                expected[i] = (total, best)
            total += v
            best = v if best is None else max(best, v)
            if not exclusive:
                expected[i] = (total, best)
    return expected


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("width", [1, 7, 10**6])
def test_running_matches_brute_force(spark, exclusive, width):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    groups = order_groups(df, ["k"], ["t", "i"], block_of("t", width))
    out = groups.running({"s": F.col("v")}, {"m": F.col("v")}, {"all": F.col("v")}, exclusive).rows()
    got = {r.i: (r.s, r.m) for r in out.collect()}
    assert got == brute_running(rows, exclusive)
    assert set(out.columns) == {"k", "t", "i", "v", "s", "m", "all"}
    whole = {}
    for k, _, _, v in rows:
        whole[k] = whole.get(k, 0) + v
    assert {(r.k, r["all"]) for r in out.collect()} == set(whole.items())


def test_hot_groups_are_spread_over_cells(spark):
    df = spark.createDataFrame(skewed_rows(), "k string, t int, i int, v int")
    sizes = [r["count"] for r in order_groups(df, ["k"], ["t", "i"], block_of("t", 5)).cells.groupBy("_cell").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 100


def test_running_starts_no_job(spark):
    df = spark.createDataFrame(skewed_rows(), "k string, t int, i int, v int")
    spark.sparkContext.setJobGroup("building", "building")
    order_groups(df, ["k"], ["t", "i"], block_of("t", 5)).running({"s": F.col("v")}).rows()
    percentiles(df.withColumn("x", F.col("v").cast("double")), ["k"], "x", PROBS)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, t int, v int")
    assert order_groups(df, ["k"], ["t"], block_of("t", 5)).running({"s": F.col("v")}).rows().count() == 0


def test_last_rows_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed_rows(), "k string, t int, i int, v int")
    out = last_rows(df, ["k"], [F.desc("t"), F.desc("i")], 3, "rn")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert out.groupBy("k").count().agg(F.max("count")).first()[0] == 3


F_ONE, F_FINE = "0", "floor(x * 3)"
PROBS = {"lo": 0.0, "q": 0.25, "m": 0.5, "h": 0.9, "hi": 1.0}


@pytest.mark.parametrize("chunk", [None, F_ONE, F_FINE])
def test_percentiles_match_numpy(spark, chunk):
    rnd = random.Random(5)
    rows = [("hot", rnd.choice([1.0, 2.5, rnd.random() * 9])) for _ in range(400)]
    rows += [("cold", float(i * i)) for i in range(11)] + [("hot", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = percentiles(df, ["k"], "x", PROBS, chunk and F.expr(chunk)).collect()
    got = {r.k: r for r in found}
    assert set(got) == {"hot", "cold", None} and sorted(found, key=str) == sorted(percentiles(df, ["k"], "x", PROBS).collect(), key=str)
    for key in ("hot", "cold"):
        values = [x for k, x in rows if k == key and x is not None]
        for name, p in PROBS.items():
            assert got[key][name] == pytest.approx(np.percentile(values, p * 100))


@pytest.mark.parametrize("chunk", [None, F_ONE, F_FINE])
def test_percentiles_without_keys(spark, chunk):
    values = [float((i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = percentiles(df, [], "x", PROBS, chunk and F.expr(chunk)).collect()
    assert len(rows) == 1 and percentiles(df.limit(0), [], "x", PROBS).collect() == [(None,) * 5]
    for name, p in PROBS.items():
        assert rows[0][name] == pytest.approx(np.percentile(values, p * 100))


def test_spread_box_and_histogram(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, x double")
    s = spread(df, ["k"], "x").first()
    assert (s["mean"], s["median"], s["highest"], s["n"]) == (4.5, 4.5, 9.0, 10)
    assert s["std"] == pytest.approx(np.std(range(10), ddof=1), abs=1e-6)
    b = box_stats(df, ["k"], "x").first()
    assert (b.lowest, b.q1, b.mid, b.q3, b.highest) == (0.0, 2.25, 4.5, 6.75, 9.0)
    bins = {r.bin: r.n for r in histogram(df, "x", 4.0).collect()}
    assert bins == {0: 4, 1: 4, 2: 2}


def test_error_metrics_cases(spark):
    def metrics(pairs):
        df = spark.createDataFrame(pairs, "y double, p double")
        return error_metrics(df, [], "y", "p").first()

    perfect = metrics([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 4.0)])
    assert (perfect.mae, perfect.rmse, perfect.r2, perfect["corr"], perfect.n) == (0, 0, 1, 1, 4)
    assert metrics([(1.0, 1.0), (2.0, None), (3.0, 3.0), (4.0, 5.0)]).n == 3
    empty = metrics([(None, 1.0)])
    assert empty.n == 0 and empty.mae is None
    off = metrics([(0.0, 1.0), (2.0, 1.0)])
    assert (off.mae, off.rmse, off.r2) == (1.0, 1.0, 0.0)


def test_residual_summary(spark):
    rows = [(float(i), 0.0) for i in range(-3, 8)]
    df = spark.createDataFrame(rows, "y double, p double")
    r = residual_summary(df, "y", "p").first()
    residuals = np.arange(-3, 8)
    assert r.mean_residual == 2.0 and r.min_residual == -3.0 and r.max_residual == 7.0
    assert r.std_residual == pytest.approx(residuals.std(), abs=1e-6)
    assert r.p75 == pytest.approx(np.percentile(np.abs(residuals), 75))
