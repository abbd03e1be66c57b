"""Warehouse reports: totals, coverage, filters and leaderboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions import scalars as S


def current_team(team_seasons: DataFrame) -> DataFrame:
    """Latest team per player; (player, season) is unique, so there are no ties."""
    return team_seasons.groupBy("player_id").agg(
        F.max_by("team_abbr", "season").alias("current_team"), F.max("season").alias("season")
    )


def current_team_view(players: DataFrame, team_seasons: DataFrame) -> DataFrame:
    """Players with their latest team; players without one are left out."""
    return players.select("player_id", "first_name", "last_name", "position").join(
        current_team(team_seasons), "player_id"
    )


def player_info(players: DataFrame, team_seasons: DataFrame, player_id: int | None = None) -> DataFrame:
    """Name, position and latest team (NULL without one), of all players or one."""
    chosen = players if player_id is None else players.where(F.col("player_id") == player_id)
    return (
        chosen.select("player_id", "first_name", "last_name", "position")
        .join(current_team(team_seasons), "player_id", "left")
        .withColumnRenamed("current_team", "team")
        .drop("season")
    )


def player_totals(logs: DataFrame) -> DataFrame:
    return logs.groupBy("player_id").agg(
        *[F.sum(c).alias(c) for c in ("goals", "assists", "points")], F.count("*").alias("games")
    )


def top_scorers(logs: DataFrame, players: DataFrame, team_seasons: DataFrame, n: int = 20) -> DataFrame:
    """Most points over all games.

    Logs are reduced to one row per player before names and teams are joined.
    """
    named = player_totals(logs).join(
        players.select("player_id", S.full_name("first_name", "last_name").alias("player")), "player_id"
    )
    top = named.orderBy(F.desc("points"), "player_id").limit(n)
    return (
        top.join(current_team(team_seasons).drop("season"), "player_id", "left")
        .withColumnRenamed("current_team", "team")
        .orderBy(F.desc("points"), "player_id")
    )


def coverage(logs: DataFrame) -> DataFrame:
    """How many rows carry each optional statistic."""
    return logs.agg(
        *[
            F.count_if(F.col(c) > 0).alias(f"with_{c}")
            for c in ("blocked_shots", "giveaways", "takeaways")
        ],
        F.count("faceoff_pct").alias("with_faceoff_pct"),
        F.count("*").alias("total_records"),
    )


def date_range(logs: DataFrame) -> DataFrame:
    return logs.agg(F.min("game_date").alias("min_date"), F.max("game_date").alias("max_date"))


def game_type_counts(logs: DataFrame) -> DataFrame:
    return (
        logs.groupBy("game_type")
        .agg(F.count("*").alias("n"))
        .withColumn("label", S.game_type_label("game_type"))
        .orderBy("game_type")
    )


def players_by_team(team_seasons: DataFrame) -> DataFrame:
    return (
        current_team(team_seasons)
        .groupBy(F.col("current_team").alias("team"))
        .agg(F.count("*").alias("players"))
        .orderBy(F.desc("players"), "team")
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values of several columns as (field, value) text rows, in one pass."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "field", "value"
    )
    return cells.where(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def players_per_game(df: DataFrame) -> DataFrame:
    return df.groupBy("game_id").agg(F.count_distinct("player_id").alias("players"))


def filtered_log(
    logs: DataFrame,
    players: DataFrame,
    teams: Sequence[str] | None = None,
    seasons: Sequence | None = None,
    game_types: Sequence[int] | None = None,
    dates: tuple | None = None,
) -> DataFrame:
    """All games of known players that pass the filters, with the player's name."""
    chosen = logs.where(
        S.optional_filters(
            isin={"team_abbr": teams, "season": seasons, "game_type": game_types},
            between={"game_date": dates},
        )
    )
    names = players.select("player_id", S.full_name("first_name", "last_name").alias("player"))
    return chosen.join(names, "player_id")


def game_log_report(log: DataFrame, n: int = 500) -> DataFrame:
    """The first ``n`` rows of a filtered log, latest and highest-scoring first."""
    order = (F.desc("game_date"), F.desc("points"), "game_id", "player_id")
    return (
        log.orderBy(*order)
        .limit(n)
        .select(
            "season",
            S.game_type_short("game_type").alias("type"),
            F.col("game_date").alias("date"),
            "player",
            F.col("team_abbr").alias("team"),
            F.col("opponent_abbr").alias("opp"),
            F.col("home_road_flag").alias("h_r"),
            F.col("goals").alias("g"),
            F.col("assists").alias("a"),
            F.col("points").alias("pts"),
            F.col("shots").alias("s"),
            "pim",
            "plus_minus",
            F.col("time_on_ice").alias("toi"),
            "shifts",
            F.col("power_play_goals").alias("ppg"),
            F.col("shorthanded_goals").alias("shg"),
            F.col("game_winning_goals").alias("gwg"),
            F.col("blocked_shots").alias("bs"),
            F.col("giveaways").alias("ga"),
            F.col("takeaways").alias("tk"),
            F.col("faceoff_pct").alias("fo_pct"),
        )
    )


def daily_totals(log: DataFrame) -> DataFrame:
    """Goals and points per date over all rows of a filtered log, not only the listed ones."""
    return (
        log.groupBy(F.col("game_date").alias("date"))
        .agg(F.sum("goals").alias("goals"), F.sum("points").alias("points"))
        .orderBy("date")
    )


def player_log(logs: DataFrame, player_id: int | None = None) -> DataFrame:
    """Game series of one player or of all, oldest first."""
    chosen = logs if player_id is None else logs.where(F.col("player_id") == player_id)
    return chosen.select(
        "player_id",
        F.col("game_id"),
        F.col("game_date").alias("date"),
        F.col("team_abbr").alias("team"),
        F.col("opponent_abbr").alias("opp"),
        F.col("goals").alias("g"),
        F.col("assists").alias("a"),
        F.col("points").alias("pts"),
        F.col("shots").alias("s"),
        "pim",
        "plus_minus",
        F.col("time_on_ice").alias("toi"),
        "shifts",
        F.col("blocked_shots").alias("bs"),
        F.col("giveaways").alias("ga"),
        F.col("takeaways").alias("tk"),
        F.col("faceoff_pct").alias("fo_pct"),
    ).orderBy("player_id", "date", "game_id")


def player_search(players: DataFrame, team_seasons: DataFrame, text: str, n: int | None = None) -> DataFrame:
    """Players whose full name contains ``text``, by last then first name."""
    name = S.full_name("first_name", "last_name")
    found = (
        players.where(S.name_contains(name, text))
        .withColumn("name", name)
        .join(current_team(team_seasons).drop("season"), "player_id", "left")
        .orderBy("last_name", "first_name", "player_id")
        .select(
            "player_id",
            "name",
            F.col("position").alias("pos"),
            F.col("current_team").alias("team"),
            F.col("sweater_number").alias("number"),
            F.col("birth_date").alias("born"),
            F.col("shoots_catches").alias("shoots"),
        )
    )
    return found if n is None else found.limit(n)


def ranked(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their rank; numbered after the limit."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rolled_up(logs: DataFrame) -> DataFrame:
    """Rows, rows of two game types, distinct seasons and distinct players of a log, in one row.

    One fold by (player, season, type) is rolled up: a player's folded rows mark
    one of themselves, so counting marks counts players while rows fall into
    seasons. Nothing is expanded once per distinct count.
    """
    folded = logs.groupBy("player_id", "season", "game_type").agg(F.count("*").alias("n"))
    per_player = folded.groupBy("player_id").agg(F.collect_list(F.struct("season", "game_type", "n")).alias("parts"))
    cells = per_player.select("player_id", F.posexplode("parts").alias("pos", "part")).select("player_id", "pos", "part.*")
    first = F.col("player_id").isNotNull() & (F.col("pos") == 0)

    def of_type(game_type: int) -> Column:
        return F.sum(F.when(F.col("game_type") == game_type, F.col("n")).otherwise(0))

    per_season = cells.groupBy("season").agg(
        F.sum("n").alias("rows"),
        of_type(2).alias("regular_season"),
        of_type(3).alias("playoffs"),
        F.count_if(first).alias("players"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "regular_season", "playoffs", "players")]
    return per_season.agg(*sums, F.count("season").alias("seasons"))


def named_counts(frames: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Counters of several tables as (table, counter, value) rows; one pass per table."""

    def one(table: str, df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
        totals = df.agg(*[c.cast("long").alias(n) for n, c in counters.items()])
        return totals.unpivot([], list(counters), "counter", "value").withColumn("table_name", F.lit(table))

    parts = [one(table, df, counters) for table, (df, counters) in frames.items()]
    return reduce(DataFrame.unionByName, parts).select("table_name", "counter", "value")


def warehouse_state(
    players: DataFrame,
    team_seasons: DataFrame,
    logs: DataFrame,
    events: DataFrame | None = None,
    shifts: DataFrame | None = None,
) -> DataFrame:
    frames = {
        "players": (players, {"rows": F.count("*")}),
        "team_seasons": (team_seasons, {"rows": F.count("*")}),
        "game_logs": (
            rolled_up(logs),
            {c: F.max(c) for c in ("rows", "regular_season", "playoffs", "seasons", "players")},
        ),
    }
    if events is not None:
        per_game = events.groupBy("game_id").agg(F.count("*").alias("n"))
        frames["events"] = (per_game, {"rows": F.coalesce(F.sum("n"), F.lit(0)), "games": F.count("game_id")})
    if shifts is not None:
        frames["shifts"] = (shifts, {"rows": F.count("*")})
    return named_counts(frames)
