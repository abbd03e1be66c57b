"""Composite jobs: loading landed files, the daily evaluation and the back-test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from streakline import schemas
from streakline.operators import forecast, rarity, streaks, tables
from streakline.sources import documents, sheets, sinks

PLAYER_BUCKETS = 64


def season_of_game(game_id):
    """Season of a game id: its first four digits are the starting year."""
    year = F.substring(game_id.cast("string"), 1, 4).cast("int")
    return F.concat(year.cast("string"), (year + 1).cast("string"))


def partitions(name: str) -> dict[str, Column]:
    """Partition columns of a table, each a function of its key.

    The season of a game log is not: boxscores without one leave it empty.
    """
    by_game = season_of_game(F.col("game_id"))
    return {
        "players": {"bucket": F.pmod(F.hash("player_id"), F.lit(PLAYER_BUCKETS))},
        "player_team_seasons": {"season": F.col("season")},
        "player_game_logs": {"game_season": by_game},
        "play_by_play": {"season": by_game},
        "player_shifts": {"season": by_game},
    }[name]


@dataclass(frozen=True)
class Warehouse:
    """Five keyed Parquet tables below one root folder."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def ddl(self, name: str) -> str:
        extra = {
            "players": ", bucket int",
            "player_game_logs": ", game_season string",
            "play_by_play": ", season string",
            "player_shifts": ", season string",
        }
        return schemas.TABLES[name] + extra.get(name, "")

    def table(self, name: str) -> DataFrame:
        if not sheets.path_exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schemas.schema(self.ddl(name)))
        return self.spark.read.schema(self.ddl(name)).parquet(self.path(name))

    def store(self, name: str, incoming: DataFrame, order: Sequence = ()) -> None:
        sinks.upsert_table(
            self.spark,
            self.path(name),
            incoming,
            schemas.KEYS[name],
            partitions(name),
            order,
            schemas.LOG_DEFAULTS,
            self.ddl(name),
        )

    def register(self) -> None:
        schemas.register_views({name: self.table(name) for name in schemas.TABLES})


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Parameterised SQL over the registered views."""
    return spark.sql(sql, args=params)


def load_rosters(warehouse: Warehouse, docs: DataFrame) -> None:
    """Players and their team per season; the latest season of a player wins."""
    rows = documents.flatten_rosters(docs)
    order = [F.desc("season"), F.asc("team_abbr")]
    newest = tables.latest_per_key(rows, ["player_id"], order)
    warehouse.store("players", newest.drop("team_abbr", "season"))
    pairs = rows.select("player_id", "season", "team_abbr")
    warehouse.store("player_team_seasons", pairs, [F.asc("team_abbr")])


def load_boxscores(warehouse: Warehouse, docs: DataFrame, skip_existing: bool = False) -> None:
    """Game logs of known players; with ``skip_existing`` loaded games are left out."""
    if skip_existing:
        docs = tables.skip_existing(
            docs, warehouse.table("player_game_logs").select(F.col("game_id").alias("id")), ["id"]
        )
    rows = tables.known_only(documents.flatten_boxscores(docs), warehouse.table("players"), "player_id")
    warehouse.store("player_game_logs", rows, [F.asc("team_abbr")])


@dataclass(frozen=True)
class LoadReport:
    """Counts of one load and its rejected entries."""

    entries: int
    n_rejected: int
    rejected: DataFrame


def load_game_logs(warehouse: Warehouse, docs: DataFrame, skip_existing: bool = False) -> LoadReport:
    """Game logs per player.

    The documents are parsed once: one pass writes good and rejected entries
    side by side to a staged table and counts both; the upsert reads that table.
    """
    counts = Observation("game_logs")
    bad = F.col("reason").isNotNull().cast("int")
    staged = warehouse.path("staged_game_logs")
    documents.route_game_logs(docs).withColumn("side", bad).observe(
        counts, F.count("*").alias("entries"), F.count("reason").alias("rejected")
    ).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("side").parquet(staged)
    seen = counts.get
    if not seen["entries"]:
        return LoadReport(0, 0, documents.rejected_game_logs(docs))
    routed = warehouse.spark.read.parquet(staged)
    rows = documents.good_game_logs(routed.where("side = 0")).drop("side")
    if skip_existing:
        rows = tables.skip_existing(
            rows, warehouse.table("player_game_logs"), ["player_id", "season", "game_type"]
        )
    warehouse.store("player_game_logs", rows, [F.desc("game_date")])
    rejected = documents.bad_game_logs(routed.where("side = 1"))
    return LoadReport(seen["entries"], seen["rejected"], rejected)


def load_events(warehouse: Warehouse, docs: DataFrame, skip_existing: bool = True) -> None:
    rows = documents.flatten_play_by_play(docs)
    if skip_existing:
        rows = tables.skip_existing(rows, warehouse.table("play_by_play"), ["game_id"])
    warehouse.store("play_by_play", rows, [F.desc("sort_order")])


def load_shifts(warehouse: Warehouse, docs: DataFrame, skip_existing: bool = True) -> None:
    rows = documents.flatten_shift_charts(docs)
    if skip_existing:
        rows = tables.skip_existing(rows, warehouse.table("player_shifts"), ["game_id"])
    warehouse.store("player_shifts", rows, [F.desc("event_number")])


def refresh_baselines(warehouse: Warehouse, path: str) -> streaks.Baselines:
    """Recompute, write and read back, so that later steps scan small tables."""
    computed = streaks.compute_baselines(
        warehouse.table("player_game_logs"), warehouse.table("players"), stepwise=True
    )
    sinks.save_baselines(computed, path)
    return sinks.load_baselines(warehouse.spark, path, stepwise=True)


def run_evaluation(
    warehouse: Warehouse,
    season: str,
    baselines: streaks.Baselines,
    min_streak_length: int = 2,
    min_novelty: float = 0.5,
    min_games: int = 10,
) -> DataFrame:
    return rarity.evaluate_players(
        warehouse.table("player_game_logs"),
        warehouse.table("players"),
        season,
        baselines,
        min_streak_length,
        min_games,
        min_novelty,
    )


def daily_report(
    warehouse: Warehouse,
    season: str,
    baselines_path: str,
    output: str,
    generated: str,
    refresh: bool = False,
    **options,
) -> DataFrame:
    """Optional refresh, evaluation, JSON lines and text summary."""
    if refresh:
        baselines = refresh_baselines(warehouse, baselines_path)
    else:
        baselines = sinks.load_baselines(warehouse.spark, baselines_path, stepwise=True)
    anomalies = run_evaluation(warehouse, season, baselines, **options).persist()
    sinks.write_jsonl(anomalies, f"{output}/anomalies")
    sinks.write_summary(anomalies, f"{output}/summary", "Streak Anomaly Daily Report", generated)
    return anomalies


def backtest(
    spark: SparkSession,
    projection_sheets: Mapping[int, str],
    results: DataFrame,
    years: Sequence[int] | None = None,
) -> dict[str, DataFrame]:
    """Forecasts against results: matched rows, metrics, ranking and match rate."""
    projections = sheets.read_projections(spark, projection_sheets, years)
    matched = forecast.match_actuals(projections, results)
    metrics = forecast.source_metrics(matched)
    return {
        "projections": projections,
        "matched": matched,
        "metrics": metrics,
        "ranking": forecast.source_ranking(metrics),
        "match_rate": forecast.match_rate(projections, matched),
    }
