"""Back-test and comparison cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from streakline.operators import distributions as D
from streakline.operators import forecast as FC

EXPERT = "first_name string, last_name string, player_name string, source string, projected_points double, season_id int"
ACTUAL = "first_name string, last_name string, points double, games_played int, team string, season_id int"


def experts(spark, rows):
    return spark.createDataFrame([(f, l, f"{f} {l}", s, p, y) for f, l, s, p, y in rows], EXPERT)


def test_matching(spark):
    e = experts(
        spark,
        [("Al", "Bo", "HM", 80.0, 1), (" AL ", "bo", "PP", 70.0, 1), ("Cy", "Di", "HM", 50.0, 1), ("Al", "Bo", "HM", 9.0, 2)],
    )
    a = spark.createDataFrame(
        [("Al", "Bo", 75.0, 80, "X", 1), ("al", "BO", 20.0, 30, "Y", 1), ("Zz", "Yy", 1.0, 1, "Q", 1)], ACTUAL
    )
    m = {r.source + str(r.projected_points): r for r in FC.match_actuals(e, a).collect()}
    assert len(m) == 3  # season 2 has no outcome at all
    assert m["HM80.0"].actual_points == 75.0 and m["HM80.0"].error == 5.0 and m["HM80.0"].team_actual == "X"
    assert m["PP70.0"].abs_error == 5.0
    assert m["HM50.0"].actual_points is None
    rate = FC.match_rate(e, FC.match_actuals(e, a)).first()
    assert (rate.projections, rate.matched, rate.match_rate) == (4, 2, 50.0)


def matched(spark, pairs, source="HM"):
    df = spark.createDataFrame(
        [(source, 1, p, a) for p, a in pairs], "source string, season_id int, projected_points double, actual_points double"
    )
    e = F.col("projected_points") - F.col("actual_points")
    return df.withColumn("error", e).withColumn("abs_error", F.abs(e))


@pytest.mark.parametrize("chunk", ["0", "abs_error"])
def test_bias_of_ten(spark, chunk):
    m = matched(spark, [(a + 10.0, float(a)) for a in (10, 20, 40, 80, 90)])
    r = FC.source_metrics(m, chunk=F.expr(chunk)).first()
    assert (r.mae, r.mean_bias, r.rmse, r.median_ae, r.correlation) == (10.0, 10.0, 10.0, 10.0, 1.0)


def test_small_groups_are_dropped(spark):
    assert FC.source_metrics(matched(spark, [(1.0, 1.0), (2.0, 2.0)])).count() == 0
    assert FC.source_metrics(matched(spark, [(1.0, None)] * 9)).count() == 0


def test_within_shares_and_constant_side(spark):
    r = FC.source_metrics(matched(spark, [(50.0, 50.0)] * 4 + [(100.0, 50.0)])).first()
    assert (r.within_5_pct, r.within_10_pct, r.within_15_pct) == (80.0, 80.0, 80.0)
    assert r.correlation is None


def test_ranking_is_an_unweighted_mean(spark):
    rows = [("A", 2.0, 10), ("A", 4.0, 1000), ("B", 2.5, 5)]
    df = spark.createDataFrame(rows, "source string, mae double, n_players int")
    for c in ("median_ae", "rmse", "correlation", "within_10_pct", "mean_bias"):
        df = df.withColumn(c, F.lit(1.0))
    ranked = FC.source_ranking(df).collect()
    assert [(r.source, r.mae, r.n_players) for r in ranked] == [("B", 2.5, 5.0), ("A", 3.0, 505.0)]


def test_unpivot_keeps_positive_whole_points(spark):
    wide = spark.createDataFrame(
        [("x", "10.9", "0", None, "7"), ("y", "-1", "abc", "3", "0.5")],
        "name string, `HM.1` string, pp string, ESPN string, ft string",
    )
    sources = {"HM.1": "Hockey Le Magazine", "pp": "PoolPro", "ESPN": "ESPN", "ft": "Fantrax"}
    rows = {(r.name, r.source, r.projected_points) for r in FC.unpivot_sources(wide, ["name"], sources).collect()}
    assert rows == {("x", "Hockey Le Magazine", 10), ("x", "Fantrax", 7), ("y", "ESPN", 3), ("y", "Fantrax", 0)}


def test_pivot_and_actual_source(spark):
    df = spark.createDataFrame(
        [("p", 20162017, "A", 5.0, 7.0), ("p", 20162017, "B", 6.0, 7.0), ("p", 20172018, "A", 4.0, None)],
        "player_name string, season_id int, source string, projected_points double, actual_points double",
    )
    wide = {r.season_id: r for r in FC.season_source_pivot(df, ["A", "B"]).collect()}
    assert (wide[20162017].A, wide[20162017].B, wide[20162017].Actual) == (5.0, 6.0, 7.0)
    assert wide[20172018].B is None
    long = FC.with_actual_source(df)
    assert long.count() == 4
    assert long.where("source = 'Actual'").first().season_label == "2016-2017"


def test_head_to_head(spark):
    ours = spark.createDataFrame(
        [("Al", "Bo", 40, 1.0, 0.5, 1.1), ("Cy", "Di", 40, 0.5, 0.2, 0.5), ("Em", "Fo", 40, 0.1, 0.1, 0.1), ("Lo", "Gp", 5, 1.0, 1.0, 1.0)],
        "first_name string, last_name string, target_games int, pts_per_game double, goals_per_game double, projected_pts_per_game double",
    )
    ext = spark.createDataFrame(
        [(" al bo", "T", "C", 50, 25.0, 20.0, 40.0), ("CY DI", "U", "D", 40, None, 8.0, 20.0), ("Lo Gp", "V", "D", 60, 1.0, 1.0, 1.0)],
        "name string, team string, position string, games_played int, xgoals double, goals double, points double",
    )
    c = FC.head_to_head(ours, ext)
    rows = {r.player_name: r for r in c.collect()}
    assert set(rows) == {"Al Bo", "Cy Di"}
    assert rows["Al Bo"].more_accurate == "external" and rows["Cy Di"].more_accurate == "ours"
    assert rows["Cy Di"].external_xgoals_per_game == 0.0
    w = FC.win_counts(c).first()
    assert (w.our_wins, w.external_wins, w.total, w.our_share) == (1, 1, 2, 50.0)
    assert FC.model_metrics(c).count() == 2
    assert FC.top_disagreement(c, 1).first().player_name == "Al Bo"
    assert FC.most_accurate(FC.by_position(c, "D")).first().player_name == "Cy Di"
    assert FC.errors_long(c).count() == 4


def test_rows_never_move_by_season_alone(spark):
    from streakline.plans.queries import QUERIES

    plan = QUERIES["forecast_matched"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert moves and all("match_key" in m for m in moves if "season_id" in m)


# --- percentiles and moments from one read -----------------------------------------------


VALUES = "k string, v double, x double, y double"


def profiled(df, keys, **options):
    series = {"v": F.col("v"), "x": F.col("x"), "y": F.col("y")}
    return D.profile(df, keys, "v", {"mid": 0.5, "p90": 0.9}, series, {"high": F.col("x") > 50}, [("x", "y")], **options)


@pytest.mark.parametrize("chunk", [None, "0", "floor(v)"])
def test_profile_against_plain_figures(spark, chunk):
    rng = np.random.default_rng(5)
    # the hot key repeats its values, and all lie far from 0, where raw squares would cancel
    rows = [(k, 1e8 + float(rng.integers(0, 40)), float(rng.integers(0, 100)), float(rng.normal())) for k in "a" * 600 + "bb" + "c"]
    rows += [(None, -3.5, 1.0, 2.0), (None, 3.5, 60.0, 1.0), ("d", None, 99.0, 1.0)]
    got = {r.k: r for r in profiled(spark.createDataFrame(rows, VALUES), ["k"], chunk=None if chunk is None else F.expr(chunk)).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k, r in got.items():
        v, x, y = (np.array(c) for c in zip(*[row[1:] for row in rows if row[0] == k]))
        if k == "d":
            assert (r.n, r.mid, r.v_mean, r.high, r.max_value) == (0, None, None, 0, None)
            continue
        assert (r.n, r.high, r.max_value, r.x_low, r.x_high) == (len(v), (x > 50).sum(), v.max(), x.min(), x.max())
        assert (r.mid, r.p90) == pytest.approx((np.percentile(v, 50), np.percentile(v, 90)))
        assert (r.v_mean, r.v_ss, r.x_ss) == pytest.approx((v.mean(), v.var() * len(v), x.var() * len(x)))
        assert r.x_y_ss == pytest.approx(((x - x.mean()) * (y - y.mean())).sum(), abs=1e-9)


def test_profile_without_keys_or_rows(spark):
    empty = spark.createDataFrame([], VALUES)
    assert profiled(empty, ["k"]).count() == 0
    r = profiled(empty, []).first()
    assert (r.n, r.high, r.mid, r.v_mean, r.v_ss) == (0, 0, None, None, None)
    assert D.residual_summary(empty, "x", "y").first().std_residual is None


def test_spread_of_one_value_and_large_integers(spark):
    df = spark.createDataFrame([("a", 2**60 + 1), ("b", None)], "k string, v long")
    got = {r.k: r for r in D.spread(df, ["k"], "v").collect()}
    assert (got["a"].highest, got["a"].n, got["a"].std) == (2**60 + 1, 1, None)
    assert (got["b"].highest, got["b"].n, got["b"].mean) == (None, 0, None)


def test_metrics_read_the_matched_rows_once(spark, tmp_path):
    matched(spark, [(float(i), float(i % 7)) for i in range(40)]).write.parquet(str(tmp_path / "m"))
    metrics = FC.source_metrics(spark.read.parquet(str(tmp_path / "m")))
    metrics.collect()
    final = metrics._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet", final)) == 1
