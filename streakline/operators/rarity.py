"""Scoring of active streaks against baselines, and reports over the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions import lookups as K
from streakline.functions import scalars as S
from streakline.operators.streaks import (
    STREAK_TYPES,
    Baselines,
    active_streaks,
    as_steps,
    describe,
    look_up_steps,
    step_points,
)


def active_players(logs: DataFrame, players: DataFrame, min_games: int = 10) -> DataFrame:
    """Skaters with at least ``min_games`` games and the team of their latest one."""
    played = (
        logs.groupBy("player_id")
        .agg(
            F.count("*").alias("games_played"),
            F.max_by("team_abbr", F.struct("game_date", "game_id")).alias("team"),
        )
        .where(F.col("games_played") >= min_games)
    )
    skaters = players.where(S.is_skater("position")).select(
        "player_id", "first_name", "last_name", "position"
    )
    return played.join(skaters, "player_id")


def career_probability(length: Column, best: Column) -> Column:
    """How usual a run is for this player, given the personal best."""
    return (
        F.when(best.isNull() | (best <= 0), 0.5)
        .when(length > best, 0.01)
        .when(length == best, 0.10)
        .otherwise(length / best)
    )


def novelty(league_p: Column, team_p: Column, player_p: Column) -> Column:
    w = K.NOVELTY_WEIGHTS
    return w["league"] * (1 - league_p) + w["team"] * (1 - team_p) + w["player"] * (1 - player_p)


def severity(novelty_index: Column) -> Column:
    chain = F.when(novelty_index >= K.SEVERITY_FLOORS[0], K.SEVERITIES[0])
    for floor, name in zip(K.SEVERITY_FLOORS[1:], K.SEVERITIES[1:]):
        chain = chain.when(novelty_index >= floor, name)
    return chain.otherwise(K.SEVERITIES[-1])


def score_streaks(streaks: DataFrame, baselines: Baselines) -> DataFrame:
    """Add level probabilities, novelty and severity to streaks.

    ``streaks`` has player_id, team, position, streak_type and length. The
    baseline tables carry no broadcast hint: adaptive execution broadcasts them
    when their actual size allows and splits skewed keys otherwise.
    """
    named = streaks.withColumn("pg", S.position_group("position")).join(baselines.player, ["player_id", "streak_type"], "left")
    league = look_up_steps(named, baselines.steps("league"), ["pg", "streak_type"], "length", "league_p")
    joined = look_up_steps(league, baselines.steps("team"), ["team", "pg", "streak_type"], "length", "team_p")
    scored = joined.withColumns(
        {
            "league_p": F.coalesce("league_p", F.lit(0.0)),
            "team_p": F.coalesce("team_p", F.lit(0.0)),
            "player_p": career_probability(F.col("length"), F.col("career_max")),
        }
    ).withColumn("novelty", novelty(F.col("league_p"), F.col("team_p"), F.col("player_p")))
    return describe(
        scored.withColumn("severity", severity(F.col("novelty")))
        .withColumn("novelty_index", S.rounded("novelty", 4))
        .drop("career_max")
    )


def evaluate_players(
    logs: DataFrame,
    players: DataFrame,
    season,
    baselines: Baselines,
    min_streak_length: int = 2,
    min_games: int = 10,
    min_novelty: float = 0.0,
    recent: int = 40,
    player_id: int | None = None,
) -> DataFrame:
    """Active streaks of one season, scored; all players or one."""
    current = logs.where(F.col("season") == season)
    if player_id is not None:
        current = current.where(F.col("player_id") == player_id)
    streaks = active_streaks(current, ("player_id",), min_streak_length, recent)
    who = active_players(current, players, min_games).withColumn(
        "player_name", S.full_name("first_name", "last_name")
    )
    named = streaks.join(who.drop("first_name", "last_name"), "player_id")
    scored = score_streaks(named.withColumn("season", F.lit(season)), baselines)
    return scored.where(F.col("novelty") >= min_novelty)


def by_novelty(anomalies: DataFrame) -> DataFrame:
    """Most novel first; player and type break ties."""
    return anomalies.orderBy(F.desc("novelty"), "player_id", "streak_type")


def top_anomalies(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return by_novelty(anomalies).limit(n)


def filter_anomalies(
    anomalies: DataFrame,
    min_novelty: float = 0.0,
    types: Sequence[str] = (),
    teams: Sequence[str] = (),
    group: str = "ALL",
) -> DataFrame:
    """Leaderboard filters; ``group`` compares position groups."""
    kept = anomalies.where(F.col("novelty") >= min_novelty).where(
        S.optional_filters(isin={"streak_type": types, "team": teams})
    )
    return kept if group == "ALL" else kept.where(S.position_group("position") == group)


def as_records(anomalies: DataFrame) -> DataFrame:
    """Nested output rows: one streak struct and one array of level scores."""

    def level(name: str, p: str) -> Column:
        return F.struct(
            F.lit(name).alias("level"), F.col(p).alias("probability"), (1 - F.col(p)).alias("rarity")
        )

    return anomalies.select(
        "player_id",
        "player_name",
        "team",
        "position",
        "season",
        F.struct(
            F.col("streak_type").alias("type"),
            "length",
            "start_date",
            "end_date",
            "sign",
            "description",
            "recent_games",
        ).alias("streak"),
        F.array(level("league", "league_p"), level("team", "team_p"), level("player", "player_p")).alias(
            "rarity_scores"
        ),
        "novelty_index",
        "severity",
    )


def severity_counts(anomalies: DataFrame) -> DataFrame:
    return (
        anomalies.groupBy("severity")
        .agg(F.count("*").alias("n"))
        .withColumn("rank", S.rank_in("severity", K.SEVERITIES))
        .orderBy("rank")
    )


def anomaly_kpis(anomalies: DataFrame) -> DataFrame:
    """Totals for the leaderboard header; the mean is 0 when nothing is left."""
    per_level = [
        F.count_if(F.col("severity") == name).alias(name.lower().replace(" ", "_")) for name in K.SEVERITIES
    ]
    mean = S.rounded(F.coalesce(F.avg("novelty_index"), F.lit(0.0)), 6)
    return anomalies.agg(F.count("*").alias("total"), *per_level, mean.alias("avg_novelty"))


def type_sign_counts(anomalies: DataFrame) -> DataFrame:
    return (
        anomalies.groupBy("streak_type", F.initcap("sign").alias("sign"))
        .agg(F.count("*").alias("n"))
        .orderBy(S.rank_in("streak_type", list(STREAK_TYPES)), "sign")
    )


def type_summary(anomalies: DataFrame) -> DataFrame:
    """Per type: count, mean novelty, longest run and the most frequent team.

    Counted per (type, team) first, so only that small table is shuffled by
    type. Equal team counts go to the alphabetically first team.
    """
    per_team = anomalies.groupBy("streak_type", "team").agg(
        F.count("*").alias("n"),
        F.sum("novelty_index").alias("novelty_sum"),
        F.max("length").alias("longest"),
    )
    return (
        per_team.groupBy("streak_type")
        .agg(
            F.sum("n").alias("n"),
            S.rounded(F.sum("novelty_sum") / F.sum("n"), 6).alias("avg_novelty"),
            F.max("longest").alias("max_length"),
            F.min_by("team", F.struct(-F.col("n"), F.col("team"))).alias("top_team"),
        )
        .orderBy(S.rank_in("streak_type", list(STREAK_TYPES)))
    )


# --- baseline curves --------------------------------------------------------------


def compare_steps(baselines: Baselines, teams: Sequence[str] = (), group: str = "ALL") -> DataFrame:
    """League and team tail probabilities side by side as steps of both curves; 0 beyond a curve's end.

    (team, streak_type, from_n, to_n, league_p, team_p), for ``teams`` or all.
    A step ends where one of the two curves steps, so rows grow with the
    breakpoints and not with the lengths. The value of the other curve is that
    of its next breakpoint; a curve has few of them (see ``tail_steps``).
    """
    team = baselines.steps("team").where(F.col("pg") == group).where(S.optional_filters(isin={"team": teams}))
    league = baselines.steps("league").where(F.col("pg") == group)
    curve_teams = team.select("team", "streak_type").distinct()
    value = {"league_p": league.join(curve_teams, "streak_type"), "team_p": team}
    ends = [
        steps.select("team", "streak_type", "to_n", *[(F.col("p") if c == own else F.lit(None).cast("double")).alias(c) for c in value])
        for own, steps in value.items()
    ]
    cuts = ends[0].unionByName(ends[1]).groupBy("team", "streak_type", "to_n").agg(*[F.max(c).alias(c) for c in value])
    ordered = Window.partitionBy("team", "streak_type").orderBy("to_n")
    ahead = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return cuts.select(
        "team",
        "streak_type",
        (F.coalesce(F.lag("to_n").over(ordered), F.lit(0)) + 1).alias("from_n"),
        "to_n",
        *[F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.lit(0.0)).alias(c) for c in value],
    )


def compare_curves(baselines: Baselines, teams: Sequence[str] = (), group: str = "ALL") -> DataFrame:
    """:func:`compare_steps` with one row per length ``n``."""
    values = F.struct("league_p", "team_p").alias("p")
    steps = compare_steps(baselines, teams, group).select("team", "streak_type", "from_n", "to_n", values)
    return step_points(steps).select("team", "streak_type", "n", "p.league_p", "p.team_p")


def tail_heatmap(league: DataFrame, group: str = "ALL") -> DataFrame:
    """Curve cells with their length bucket and the display order of the type; ``league`` by length or by step."""
    return describe(step_points(as_steps(league.where(F.col("pg") == group)))).select(
        "streak_type",
        "label",
        "n",
        S.length_bucket("n").alias("bucket"),
        "p",
        S.rank_in("streak_type", list(STREAK_TYPES)).alias("sort_key"),
    )


def baseline_overview(baselines: Baselines, short: int | None = 10) -> DataFrame:
    """League curves up to a short length (None: whole), with the longest observed length."""
    steps = baselines.steps("league")
    longest = steps.groupBy("pg", "streak_type").agg(F.max("to_n").alias("longest"))
    return step_points(steps, short).join(longest, ["pg", "streak_type"]).select("pg", "streak_type", "n", "p", "longest")


def team_overview(baselines: Baselines, group: str = "ALL", teams: int | None = 5) -> DataFrame:
    """Longest observed length per type for the alphabetically first teams (None: all)."""
    steps = baselines.steps("team")
    chosen = steps.where(F.col("pg") == group)
    if teams is not None:
        chosen = chosen.join(steps.select("team").distinct().orderBy("team").limit(teams), "team", "left_semi")
    return chosen.groupBy("team", "streak_type").agg(F.max("to_n").alias("longest"))
