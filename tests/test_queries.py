"""Registered queries against their SQL twins on the smallest sample, and their plans."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, compare
from streakline.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL = {
    "gbt_projection",
    "projection_leaderboard",
    "gbt_metrics",
    "gbt_residuals",
    "importance_top",
    "actual_vs_predicted",
    "projected_rate_hist",
    "projected_rate_mean",
}


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_but_the_model_ones_has_sql():
    assert set(QUERIES) - set(entry_module.oracle_sql()) == WITHOUT_SQL
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_matches_sql(spark, connection, name):
    good, text = compare(spark, connection, SF_DIR, name, QUERIES[name], entry_module.oracle_sql()[name])
    assert good, text


@pytest.mark.parametrize(
    "name", ["streak_anomalies", "possession_game", "feature_matrix", "forecast_metrics", "head_to_head", "warehouse_state"]
)
def test_plans_have_no_pairwise_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = QUERIES["known_only"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_model_run(spark):
    board = QUERIES["projection_leaderboard"](spark, SF_DIR).collect()
    rates = [r.projected_pts_per_game for r in board]
    assert rates == sorted(rates, reverse=True) and all(0 <= x <= 2 for x in rates)
    assert [r["rank"] for r in board] == list(range(1, len(board) + 1))


def test_model_save_and_load(spark, tmp_path):
    from streakline.operators.features import categorical_columns, feature_matrix
    from streakline.plans import bindings, models

    logs, players = bindings.logs(spark, SF_DIR), bindings.players(spark, SF_DIR)
    folder = str(tmp_path / "m")
    trained = models.run_training(
        logs, players, ["20212022", "20222023"], "20232024", folder, max_iter=3, min_games=5
    )
    metrics, residuals = trained.metrics.first(), trained.residuals.first()
    assert metrics.mae >= 0 and residuals.p95 >= residuals.p50
    rows = models.split_seasons(logs, players, ["20212022", "20222023"], "20232024", min_games=5)
    assert metrics.n_train == rows.where(~rows[models.VALIDATION]).count() > 0
    assert metrics.n_val == metrics.n == rows.where(models.VALIDATION).count() > 0
    loaded = models.load_model(spark, folder)
    described = loaded.metrics.first()
    assert (loaded.columns, loaded.version, loaded.mae) == (trained.columns, trained.version, metrics.mae)
    assert (described.n_train, described.categorical_columns) == (metrics.n_train, categorical_columns())
    importance = models.load_importance(spark, folder)
    assert importance.agg({"importance_pct": "sum"}).first()[0] == pytest.approx(100.0)
    assert {f"{c}_code" for c in categorical_columns()} < {r.feature for r in importance.collect()}
    matrix = feature_matrix(logs, players, "20232024", min_games=5)
    a = {r.player_id: r.prediction for r in trained.score(matrix).collect()}
    b = {r.player_id: r.prediction for r in loaded.score(matrix).collect()}
    assert a == b
    versioned = models.load_model(spark, folder, f"v_{trained.version}")
    board = models.project(versioned.score(matrix), players, bindings.team_seasons(spark, SF_DIR), loaded.version, loaded.mae)
    assert {(r.model_version, r.model_mae) for r in board.collect()} == {(trained.version, metrics.mae)}


def test_one_fit_serves_all_model_queries(spark):
    from streakline.plans import queries

    QUERIES["gbt_metrics"](spark, SF_DIR)
    stored = dict(queries._STORED)
    assert QUERIES["importance_top"](spark, SF_DIR).count() == 15
    assert QUERIES["gbt_residuals"](spark, SF_DIR).count() == 1
    assert queries._STORED == stored


def test_categories_are_codes_of_the_training_rows(spark):
    from streakline.plans import models

    kinds = "BA"
    rows = [(0.5, "Q" if i >= 30 else kinds[i % 2], float(i % 2), i >= 30) for i in range(40)]
    df = spark.createDataFrame(rows, f"x double, kind string, {models.LABEL} double, {models.VALIDATION} boolean")
    codes = models.category_codes(df, ["kind"]).collect()
    assert {(r.category, r.code) for r in codes} == {("A", 0), ("B", 1)}  # Q is known to validation rows only
    model = models.train(df, ["x"], ["kind"], max_iter=2)
    new = spark.createDataFrame([(0.5, k) for k in ("A", "B", "Z", None)], "x double, kind string")
    found = {r.kind: r.prediction for r in models.score(model, new, ["x"]).collect()}
    assert found["A"] > 0.9 and found["B"] < 0.1  # the category alone tells the label
    assert found["Z"] == found[None]


def test_many_categories_and_none(spark):
    from streakline.plans import models

    rows = [(f"k{i % 50}", None, float(i % 50), i % 4 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, f"kind string, empty string, {models.LABEL} double, {models.VALIDATION} boolean")
    model = models.train(df.withColumn("x", df[models.LABEL] * 0), ["x"], ["kind", "empty"], max_iter=1)
    assert len(model.stages[0].labels) == 50 and model.stages[1].labels == []


def test_training_rows_of_all_seasons_read_the_logs_three_times(spark):
    plan = QUERIES["training_table"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 + 2  # logs; players for attributes and for skaters


def test_projections_broadcast_no_players(spark):
    plan = QUERIES["naive_projection"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    # a row for each player is too many; the teams may go around
    assert "HashedRelationBroadcastMode(List(input[0, bigint" not in plan


def test_training_rows_are_kept_without_their_joins(spark):
    from streakline.plans import models

    data = [(i, i % 7) for i in range(500)]
    left = spark.createDataFrame(data, "player_id long, n long")
    rows = left.join(left.withColumnRenamed("n", "m").hint("merge"), "player_id").sortWithinPartitions("n", "player_id")
    kept = models.kept_rows(rows)
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect())) == [(i, n, n) for i, n in data]


def test_game_types_of_any_number(spark, tmp_path):
    from pyspark.sql import functions as F

    from streakline.plans import bindings

    ks = [8, 9, 10, 18, 29, 0, -1, -2, 7, None]
    events = spark.createDataFrame([(i, 1, '{"k": %d}' % k if k is not None else None) for i, k in enumerate(ks)], "event_id long, user_id long, props string")
    events = events.withColumns({"ts": F.lit("2024-01-05 10:00:00").cast("timestamp"), "event_type": F.lit("view"), "value": F.lit(61.0)})
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = {r.game_id: r.game_type for r in bindings.logs(spark, str(tmp_path)).collect()}
    assert [found[i] for i in range(len(ks))] == [1, 3, 2, 1, 3, 2, 2, 2, 2, 2]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
