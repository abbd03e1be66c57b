"""Back-testing of forecasts from many sources and comparison of two models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.functions import scalars as S
from streakline.operators.distributions import error_metrics, histogram, profile, spread
from streakline.operators.ordered import last_rows

WITHIN = (5, 10, 15)


def unpivot_sources(
    wide: DataFrame, ids: Sequence[str], sources: Mapping[str, str]
) -> DataFrame:
    """One row per forecast: positive values only, truncated to whole points.

    ``sources`` maps a column to its source name; two columns may share one.
    """
    cells = [F.col(f"`{c}`").try_cast("double").alias(f"_v{i}") for i, c in enumerate(sources)]
    names = {f"_v{i}": name for i, name in enumerate(sources.values())}
    long = wide.select(*ids, *cells).unpivot(list(ids), list(names), "_column", "_value")
    return long.where(F.col("_value") > 0).select(
        *ids,
        S.lookup(F.col("_column"), names).alias("source"),
        F.col("_value").cast("int").alias("projected_points"),
    )


def best_actuals(actuals: DataFrame, tie_break: Sequence[str] = ("team",)) -> DataFrame:
    """One row per (season, name): the highest-scoring entry.

    A player with several partial-team rows keeps the best of them.
    """
    keyed = actuals.withColumn("match_key", S.match_key("first_name", "last_name"))
    order = [F.desc("points"), *[F.asc(c) for c in tie_break]]
    return last_rows(keyed, ["season_id", "match_key"], order, 1, "_rn").drop("_rn")


def match_actuals(projections: DataFrame, actuals: DataFrame, tie_break: Sequence[str] = ("team",)) -> DataFrame:
    """Projections with the outcome of the same name and season.

    Seasons without any outcome are left out; a name without one keeps NULLs.
    The seasons are a list of years, held as one value, so that rows move by
    season and name only and never by season alone.
    """
    seasons = actuals.agg(F.collect_set("season_id")).scalar()
    outcome = best_actuals(actuals, tie_break).select(
        "season_id",
        "match_key",
        F.col("points").alias("actual_points"),
        "games_played",
        F.col("team").alias("team_actual"),
    )
    keyed = projections.where(F.array_contains(seasons, F.col("season_id"))).withColumn(
        "match_key", S.match_key("first_name", "last_name")
    )
    error = F.col("projected_points") - F.col("actual_points")
    return (
        keyed.join(outcome, ["season_id", "match_key"], "left")
        .withColumns({"error": error, "abs_error": F.abs(error)})
        .drop("match_key")
    )


def source_metrics(
    matched: DataFrame, min_rows: int = 5, within: Sequence[float] = WITHIN, **limits
) -> DataFrame:
    """Accuracy per source and season, for groups of at least ``min_rows``; one read of the matched rows."""
    keys = ["source", "season_id"]
    e, size = F.col("error"), F.col("abs_error")
    found = profile(
        matched.where(F.col("actual_points").isNotNull()),
        keys,
        "abs_error",
        {"median_ae": 0.5},
        {"size": size, "square": e * e, "e": e, "x": F.col("projected_points"), "y": F.col("actual_points")},
        {f"within_{w}": size <= w for w in within},
        [("x", "y")],
        **limits,
    ).where(F.col("n") >= min_rows)
    correlated = F.try_divide(F.col("x_y_ss"), F.sqrt(F.col("x_ss") * F.col("y_ss")))
    return found.select(
        *keys,
        F.col("n").alias("n_players"),
        S.rounded("size_mean", 2).alias("mae"),
        S.rounded(F.sqrt("square_mean"), 2).alias("rmse"),
        S.rounded(F.when(F.col("n") > 2, correlated), 4).alias("correlation"),
        *[S.rounded(F.col(f"within_{w}") / F.col("n") * 100, 1).alias(f"within_{w}_pct") for w in within],
        S.rounded("e_mean", 2).alias("mean_bias"),
        S.rounded("median_ae", 2).alias("median_ae"),
    )


def source_ranking(metrics: DataFrame, within: float = 10) -> DataFrame:
    """Unweighted mean of the season metrics per source, best first."""
    share = f"within_{within}_pct"
    columns = ("mae", "median_ae", "rmse", "correlation", share, "mean_bias", "n_players")
    return (
        metrics.groupBy("source")
        .agg(*[S.rounded(F.avg(c), 4).alias(c) for c in columns])
        .orderBy("mae", "source")
    )


def error_stats(matched: DataFrame, sources: Sequence[str] = (), **limits) -> DataFrame:
    """Mean, median, deviation and count of the error per source."""
    kept = matched.where(F.col("error").isNotNull()).where(S.optional_filters(isin={"source": sources}))
    return spread(kept, ["source"], "error", digits=4, **limits).drop("highest").orderBy("mean", "source")


def error_histogram(matched: DataFrame, width: float) -> DataFrame:
    return histogram(matched, "error", width, keys=["source"])


def match_rate(projections: DataFrame, matched: DataFrame) -> DataFrame:
    """Share of projections with a known outcome; unmatched rows do not count."""
    counts = projections.select(F.lit(1).alias("p"), F.lit(0).alias("m")).unionByName(
        matched.where(F.col("actual_points").isNotNull()).select(F.lit(0).alias("p"), F.lit(1).alias("m"))
    )
    return counts.agg(F.sum("p").alias("projections"), F.sum("m").alias("matched")).withColumn(
        "match_rate", S.rounded(S.ratio(F.col("matched") * 100, "projections"), 1)
    )


def season_source_pivot(matched: DataFrame, sources: Sequence[str], ids: Sequence[str] = ("player_name",)) -> DataFrame:
    """Projected points per source as columns, plus the outcome, per player and season.

    The smallest value stands for repeated forecasts of one source, which keeps
    the choice independent of row order.
    """
    keys = [*ids, "season_id"]
    return matched.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("source") == s, F.col("projected_points"))).alias(s)
            for s in sources
        ],
        F.max("actual_points").alias("Actual"),
    )


def with_actual_source(matched: DataFrame, ids: Sequence[str] = ("player_name",)) -> DataFrame:
    """Forecast rows with the outcome appended as one more source per player and season."""
    keys = [*ids, "season_id"]
    actual = (
        matched.where(F.col("actual_points").isNotNull())
        .groupBy(*keys)
        .agg(F.max("actual_points").alias("points"))
        .withColumn("source", F.lit("Actual"))
    )
    rows = matched.select(*keys, "source", F.col("projected_points").alias("points"))
    return rows.unionByName(actual.select(*keys, "source", "points")).withColumn(
        "season_label", S.season_label("season_id")
    )


# --- two models --------------------------------------------------------------------


def match_by_name(ours: DataFrame, external: DataFrame) -> DataFrame:
    """Inner join on the normalised full name; external columns get ``ext_``."""
    theirs = external.select(
        S.match_key_of("name").alias("match_key"),
        *[F.col(c).alias(f"ext_{c}") for c in external.columns],
    )
    keyed = ours.withColumn("match_key", S.match_key("first_name", "last_name"))
    return keyed.join(theirs, "match_key").drop("match_key")


def head_to_head(ours: DataFrame, external: DataFrame, min_games: int = 20) -> DataFrame:
    """Two models against their own outcomes, one row per matched player.

    ``ours``: first_name, last_name, target_games, pts_per_game, goals_per_game,
    projected_pts_per_game. ``external``: name, team, position, games_played,
    xgoals, goals, points.
    """
    enough_ours = ours.where(F.col("target_games") >= min_games)
    enough_external = external.where(F.col("games_played") >= min_games)
    m = match_by_name(enough_ours, enough_external)
    xgoals = F.coalesce("ext_xgoals", F.lit(0.0))
    rows = m.select(
        S.full_name("first_name", "last_name").alias("player_name"),
        F.col("ext_team").alias("team"),
        F.col("ext_position").alias("position"),
        F.col("target_games").alias("gp_ours"),
        F.col("ext_games_played").alias("gp_external"),
        F.col("pts_per_game").alias("actual_pts_per_game"),
        F.col("goals_per_game").alias("actual_goals_per_game"),
        F.col("projected_pts_per_game").alias("our_pts_per_game"),
        xgoals.alias("external_xgoals"),
        S.ratio(xgoals, "ext_games_played", default=None).alias("external_xgoals_per_game"),
        F.col("ext_goals").alias("external_goals"),
        F.col("ext_points").alias("external_points"),
    )
    errors = rows.withColumns(
        {
            "our_error": F.col("actual_pts_per_game") - F.col("our_pts_per_game"),
            "external_error": F.col("actual_goals_per_game") - F.col("external_xgoals_per_game"),
        }
    ).withColumns({"our_abs_error": F.abs("our_error"), "external_abs_error": F.abs("external_error")})
    return errors.withColumn(
        "more_accurate", S.closer("our_abs_error", "external_abs_error", "ours", "external")
    )


def model_metrics(comparison: DataFrame) -> DataFrame:
    """Metrics of both models, one row each."""
    long = comparison.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("ours").alias("model"),
                    F.col("actual_pts_per_game").alias("actual"),
                    F.col("our_pts_per_game").alias("predicted"),
                ),
                F.struct(
                    F.lit("external").alias("model"),
                    F.col("actual_goals_per_game").alias("actual"),
                    F.col("external_xgoals_per_game").alias("predicted"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    return error_metrics(long, ["model"], "actual", "predicted")


def errors_long(comparison: DataFrame) -> DataFrame:
    """Both error columns as (model, error) rows."""
    labels = {"our_error": "ours", "external_error": "external"}
    long = comparison.unpivot(["player_name"], list(labels), "column", "error")
    return long.withColumn("model", S.lookup(F.col("column"), labels)).drop("column")


def model_error_stats(comparison: DataFrame) -> DataFrame:
    return errors_long(comparison).groupBy("model").agg(
        S.rounded(F.avg("error"), 6).alias("mean_error"),
        S.rounded(F.stddev_samp("error"), 6).alias("std_error"),
    )


def win_counts(comparison: DataFrame) -> DataFrame:
    ours = F.count_if(F.col("more_accurate") == "ours")
    return comparison.agg(
        ours.alias("our_wins"),
        (F.count("*") - ours).alias("external_wins"),
        F.count("*").alias("total"),
    ).withColumns(
        {
            "our_share": S.rounded(S.ratio(F.col("our_wins") * 100, "total"), 1),
            "external_share": S.rounded(S.ratio(F.col("external_wins") * 100, "total"), 1),
        }
    )


def by_position(comparison: DataFrame, group: str = "ALL") -> DataFrame:
    return comparison if group == "ALL" else comparison.where(S.position_group("position") == group)


def most_accurate(comparison: DataFrame, by: str = "our_abs_error", n: int = 30) -> DataFrame:
    return comparison.where(F.col(by).isNotNull()).orderBy(F.asc(by), "player_name").limit(n)


def top_disagreement(comparison: DataFrame, n: int = 30) -> DataFrame:
    gap = F.abs(F.col("our_pts_per_game") - F.col("external_xgoals_per_game"))
    return (
        comparison.withColumn("disagreement", gap)
        .where(F.col("disagreement").isNotNull())
        .orderBy(F.desc("disagreement"), "player_name")
        .limit(n)
    )
