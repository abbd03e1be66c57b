"""Landed JSON documents to flat rows.

Readers take a path of one-document-per-line JSON. The flatteners take the
parsed documents, so they also work on JSON held in a column (``from_json``).
Each one is a single pass: one explode, no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline import schemas
from streakline.functions import scalars as S


def read_documents(spark: SparkSession, path: str | Sequence[str], ddl: str) -> DataFrame:
    """Documents with a declared layout; unknown fields are ignored."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(ddl).option("mode", "PERMISSIVE").json(paths)


def parse_column(df: DataFrame, column: str, ddl: str) -> DataFrame:
    return df.select(F.from_json(column, ddl).alias("_doc")).select("_doc.*")


def _items(*arrays: str) -> Column:
    """Concatenation of array columns, a missing one counting as empty."""
    filled = [F.coalesce(F.col(a), F.slice(F.array(F.lit(None)), 1, 0)) for a in arrays]
    return F.concat(*filled) if len(filled) > 1 else filled[0]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def flatten_rosters(docs: DataFrame) -> DataFrame:
    """Player rows over the three position arrays, with team and season."""
    entries = docs.select(
        "teamAbbrev", "season", F.explode(_items("forwards", "defensemen", "goalies")).alias("p")
    )
    return entries.select(
        F.col("p.id").alias("player_id"),
        S.localized("p.firstName").alias("first_name"),
        S.localized("p.lastName").alias("last_name"),
        _text(F.col("p.positionCode")).alias("position"),
        F.col("p.sweaterNumber").alias("sweater_number"),
        _text(F.col("p.shootsCatches")).alias("shoots_catches"),
        _text(F.col("p.birthDate")).alias("birth_date"),
        F.col("teamAbbrev").alias("team_abbr"),
        "season",
    )


def flatten_schedules(docs: DataFrame, game_types: Sequence[int] = ()) -> DataFrame:
    """Game rows of team schedules; a game appears once per listing team."""
    rows = docs.select("teamAbbrev", F.explode(_items("games")).alias("g")).select(
        F.col("teamAbbrev").alias("team_abbr"),
        F.col("g.id").alias("game_id"),
        F.col("g.gameType").alias("game_type"),
        F.col("g.gameDate").alias("game_date"),
        F.col("g.awayTeam.abbrev").alias("away_abbr"),
        F.col("g.homeTeam.abbrev").alias("home_abbr"),
    )
    return rows.where(S.optional_filters(isin={"game_type": game_types}))


def flatten_boxscores(docs: DataFrame) -> DataFrame:
    """One row per player of both sides, in the game-log layout.

    Goalies keep goals, assists, points and penalty minutes only, and are left
    out when their ice time is exactly 0:00.
    """
    away, home = _text(F.col("awayTeam.abbrev")), _text(F.col("homeTeam.abbrev"))
    sides = F.array(
        F.struct(
            F.lit("R").alias("flag"),
            away.alias("team"),
            home.alias("opponent"),
            F.col("playerByGameStats.awayTeam").alias("roster"),
        ),
        F.struct(
            F.lit("H").alias("flag"),
            home.alias("team"),
            away.alias("opponent"),
            F.col("playerByGameStats.homeTeam").alias("roster"),
        ),
    )
    per_side = docs.select(
        _number(F.col("id")).alias("game_id"),
        _text(F.col("season")).alias("season"),
        F.coalesce("gameType", F.lit(2)).alias("game_type"),
        _text(F.col("gameDate")).alias("game_date"),
        F.explode(sides).alias("side"),
    ).where(F.col("side.roster").isNotNull())

    def tagged(array: str, goalie: bool) -> Column:
        return F.transform(
            F.col(f"side.roster.{array}"), lambda p: F.struct(p.alias("p"), F.lit(goalie).alias("goalie"))
        )

    tagged_sides = per_side.withColumns(
        {"_f": tagged("forwards", False), "_d": tagged("defense", False), "_g": tagged("goalies", True)}
    )
    entries = tagged_sides.withColumn("e", F.explode(_items("_f", "_d", "_g"))).where(
        ~(F.col("e.goalie") & F.coalesce(F.col("e.p.toi") == "0:00", F.lit(False)))
    )
    skater = ~F.col("e.goalie")

    def skater_int(field: str) -> Column:
        return F.when(skater, S.int_or(f"e.p.{field}")).otherwise(0)

    return entries.select(
        "game_id",
        _number(F.col("e.p.playerId")).alias("player_id"),
        "season",
        "game_type",
        "game_date",
        F.col("side.team").alias("team_abbr"),
        F.col("side.opponent").alias("opponent_abbr"),
        F.col("side.flag").alias("home_road_flag"),
        S.int_or("e.p.goals").alias("goals"),
        S.int_or("e.p.assists").alias("assists"),
        S.int_or("e.p.points").alias("points"),
        skater_int("sog").alias("shots"),
        S.int_or("e.p.pim").alias("pim"),
        skater_int("plusMinus").alias("plus_minus"),
        _text(F.col("e.p.toi")).alias("time_on_ice"),
        skater_int("shifts").alias("shifts"),
        skater_int("powerPlayGoals").alias("power_play_goals"),
        F.lit(0).alias("power_play_points"),
        F.lit(0).alias("shorthanded_goals"),
        F.lit(0).alias("game_winning_goals"),
        F.lit(0).alias("ot_goals"),
        skater_int("blockedShots").alias("blocked_shots"),
        skater_int("hits").alias("hits"),
        skater_int("giveaways").alias("giveaways"),
        skater_int("takeaways").alias("takeaways"),
        F.when(skater, S.nonzero_double("e.p.faceoffWinningPctg")).alias("faceoff_pct"),
    )


_ENTRY_TEXT = {
    "gameDate": "game_date",
    "teamAbbrev": "team_abbr",
    "opponentAbbrev": "opponent_abbr",
    "homeRoadFlag": "home_road_flag",
    "toi": "time_on_ice",
}
_ENTRY_INT = {
    "goals": "goals",
    "assists": "assists",
    "points": "points",
    "shots": "shots",
    "pim": "pim",
    "plusMinus": "plus_minus",
    "shifts": "shifts",
    "powerPlayGoals": "power_play_goals",
    "powerPlayPoints": "power_play_points",
    "shorthandedGoals": "shorthanded_goals",
    "gameWinningGoals": "game_winning_goals",
    "otGoals": "ot_goals",
}


def _log_entries(docs: DataFrame) -> DataFrame:
    """Entries with the first ``reason`` to reject them, NULL for good ones.

    Required fields must be present and every number a whole number.
    """
    entries = docs.where(S.is_season("season")).select(
        F.col("playerId").alias("player_id"),
        "season",
        F.col("gameType").alias("game_type"),
        F.explode(_items("gameLog")).alias("e"),
    )

    def whole_or_missing(field: str) -> Column:
        value = F.col(f"e.{field}")
        return value.isNull() | value.try_cast("int").isNotNull()

    checks = {
        "gameId": F.col("e.gameId").try_cast("bigint").isNotNull(),
        "gameDate": F.col("e.gameDate").isNotNull(),
        "teamAbbrev": F.col("e.teamAbbrev").isNotNull(),
        **{field: whole_or_missing(field) for field in _ENTRY_INT},
    }
    failed = [F.when(~good, F.lit(field)) for field, good in checks.items()]
    return entries.withColumn("reason", F.coalesce(*failed))


def route_game_logs(docs: DataFrame) -> DataFrame:
    """All entries from one pass: typed, missing fields defaulted, with ``reason`` and the raw ``entry`` of bad ones."""
    return _log_entries(docs).select(
        F.col("e.gameId").try_cast("bigint").alias("game_id"),
        "player_id",
        "season",
        "game_type",
        *[_text(F.col(f"e.{f}")).alias(name) for f, name in _ENTRY_TEXT.items()],
        *[S.int_or(f"e.{f}").alias(name) for f, name in _ENTRY_INT.items()],
        "reason",
        F.when(F.col("reason").isNotNull(), F.to_json("e")).alias("entry"),
    )


def good_game_logs(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reason").isNull()).drop("reason", "entry")


def bad_game_logs(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reason").isNotNull()).select("player_id", "season", "game_type", "reason", "entry")


def flatten_game_logs(docs: DataFrame) -> DataFrame:
    """Valid game-log entries, typed, missing fields defaulted."""
    return good_game_logs(route_game_logs(docs))


def rejected_game_logs(docs: DataFrame) -> DataFrame:
    """Entries that fail validation, with the first field at fault and as JSON text next to their request."""
    return bad_game_logs(route_game_logs(docs))


def rejection_counts(docs: DataFrame) -> DataFrame:
    """Entries per season by the field at fault; good ones under ``ok``."""
    reason = F.coalesce("reason", F.lit("ok")).alias("reason")
    return route_game_logs(docs).groupBy("season", reason).agg(F.count("*").alias("n"))


def flatten_play_by_play(docs: DataFrame) -> DataFrame:
    """Events of play-by-play documents in the declared 28-column layout."""
    rows = docs.select(F.col("id").alias("game_id"), F.explode(_items("plays")).alias("e"))

    def text(field: str, name: str) -> Column:
        return _text(F.col(f"e.{field}")).alias(name)

    def number(field: str, name: str) -> Column:
        return _number(F.col(f"e.{field}")).alias(name)

    def optional(field: str, name: str) -> Column:
        return F.col(f"e.details.{field}").alias(name)

    return rows.select(
        "game_id",
        number("eventId", "event_id"),
        number("periodDescriptor.number", "period"),
        text("timeInPeriod", "time_in_period"),
        text("timeRemaining", "time_remaining"),
        number("sortOrder", "sort_order"),
        number("typeCode", "type_code"),
        text("typeDescKey", "type_desc_key"),
        text("situationCode", "situation_code"),
        text("homeTeamDefendingSide", "home_team_defending_side"),
        optional("xCoord", "x_coord"),
        optional("yCoord", "y_coord"),
        text("details.zoneCode", "zone_code"),
        text("details.shotType", "shot_type"),
        optional("shootingPlayerId", "shooting_player_id"),
        optional("goalieInNetId", "goalie_in_net_id"),
        optional("eventOwnerTeamId", "event_owner_team_id"),
        optional("blockingPlayerId", "blocking_player_id"),
        optional("scoringPlayerId", "scoring_player_id"),
        optional("scoringPlayerTotal", "scoring_player_total"),
        optional("assist1PlayerId", "assist1_player_id"),
        optional("assist1PlayerTotal", "assist1_player_total"),
        optional("assist2PlayerId", "assist2_player_id"),
        optional("assist2PlayerTotal", "assist2_player_total"),
        optional("awayScore", "away_score"),
        optional("homeScore", "home_score"),
        optional("awaySOG", "away_sog"),
        optional("homeSOG", "home_sog"),
    )


def flatten_shift_charts(docs: DataFrame) -> DataFrame:
    """Shift rows in the declared 16-column layout."""
    rows = docs.select(F.col("gameId").alias("game_id"), F.explode(_items("data")).alias("s"))
    name = F.concat_ws(" ", _text(F.col("s.firstName")), _text(F.col("s.lastName")))
    texts = {
        "startTime": "start_time",
        "endTime": "end_time",
        "duration": "duration",
    }
    return rows.select(
        "game_id",
        _number(F.col("s.id")).alias("shift_id"),
        _number(F.col("s.playerId")).alias("player_id"),
        F.trim(name).alias("player_name"),
        _text(F.col("s.teamAbbrev")).alias("team_abbr"),
        _number(F.col("s.period")).alias("period"),
        _number(F.col("s.shiftNumber")).alias("shift_number"),
        *[_text(F.col(f"s.{f}")).alias(n) for f, n in texts.items()],
        _number(F.col("s.detailCode")).alias("detail_code"),
        _number(F.col("s.eventNumber")).alias("event_number"),
        _text(F.col("s.hexValue")).alias("hex_value"),
        _number(F.col("s.teamId")).alias("team_id"),
        _text(F.col("s.teamName")).alias("team_name"),
        _number(F.col("s.typeCode")).alias("type_code"),
    )
