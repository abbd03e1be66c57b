"""Views that let the sample tables play the part of the warehouse tables.

Every view reads its whole table and only renames or recomputes columns, so the
work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD_SECONDS = 28_800
GAME_TYPES = (2, 2, 2, 2, 2, 2, 2, 2, 1, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _clock(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60), seconds % 60
    return F.concat_ws(":", minutes.cast("string"), F.lpad(rest.cast("string"), 2, "0"))


def _season_text(index: Column) -> Column:
    return F.concat((2020 + index).cast("string"), (2021 + index).cast("string"))


def _int(c: Column) -> Column:
    return c.cast("int")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as game logs: one row per player and game."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    goals = _int(F.floor(F.col("value") / 60))
    assists = k % 2
    return e.select(
        F.col("event_id").alias("game_id"),
        F.col("user_id").alias("player_id"),
        _season_text(_int(F.floor((F.dayofmonth("ts") - 1) / 10)) + 1).alias("season"),
        # names k once: a filter on the type is pushed down and parses the JSON for every mention
        F.coalesce(F.get(F.array(*map(F.lit, GAME_TYPES)), k % 10), F.lit(2)).alias("game_type"),
        F.col("ts").alias("game_date"),
        F.col("event_type").alias("team_abbr"),
        F.when(F.col("event_type") == "click", "view").otherwise("click").alias("opponent_abbr"),
        F.when(k % 2 == 0, "H").otherwise("R").alias("home_road_flag"),
        goals.alias("goals"),
        assists.alias("assists"),
        (goals + assists).alias("points"),
        (k % 6).alias("shots"),
        ((k % 3) * 2).alias("pim"),
        (k % 7 - 3).alias("plus_minus"),
        F.concat_ws(":", (k % 20).cast("string"), F.lpad((k % 60).cast("string"), 2, "0")).alias(
            "time_on_ice"
        ),
        (15 + k % 10).alias("shifts"),
        _int(F.floor((k % 4) / 3)).alias("power_play_goals"),
        _int(F.floor((k % 5) / 4)).alias("shorthanded_goals"),
        _int(F.floor((k % 9) / 8)).alias("game_winning_goals"),
        (k % 4).alias("blocked_shots"),
        (k % 8).alias("hits"),
        (k % 5).alias("giveaways"),
        (k % 3).alias("takeaways"),
        F.nullif(k / F.lit(100.0), F.lit(0.0)).alias("faceoff_pct"),
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as players; the market segment stands for the position."""
    c = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    position = (
        F.when(segment == "AUTOMOBILE", "C")
        .when(segment == "FURNITURE", "L")
        .when(segment == "MACHINERY", "R")
        .when(segment == "BUILDING", "D")
        .when(segment == "HOUSEHOLD", "G")
    )
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1985-01-01").cast("date"), _int(key % 5000))
    return c.select(
        key.alias("player_id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        position.alias("position"),
        _int(key % 99).alias("sweater_number"),
        F.when(key % 2 == 0, "L").otherwise("R").alias("shoots_catches"),
        born.cast("string").alias("birth_date"),
    )


def team_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team of the latest game per player and season."""
    return logs(spark, sf_dir).groupBy("player_id", "season").agg(
        F.max_by("team_abbr", F.struct("game_date", "game_id")).alias("team_abbr")
    )


def _ice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.hour("ts")
    second = (hour % 8) * 3600 + F.minute("ts") * 60 + _int(F.floor(F.second("ts")))
    return e.withColumns(
        {
            "game_id": F.dayofmonth("ts") * F.lit(1_000_000).cast("long")
            + F.floor(F.col("user_id") / 30),
            "period": 1 + _int(F.floor(hour / 8)),
            "sec": second,
        }
    )


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as shifts; games hold 30 players, so density stays level with scale."""
    end = _int(F.least(F.lit(PERIOD_SECONDS), F.col("sec") + F.floor(F.col("value") * 60)))
    team = F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")
    return _ice(spark, sf_dir).withColumn("end_sec", end).select(
        "game_id",
        F.col("event_id").alias("shift_id"),
        F.col("user_id").alias("player_id"),
        F.concat(F.lit("Player "), F.col("user_id").cast("string")).alias("player_name"),
        team.alias("team_abbr"),
        "period",
        _clock(F.col("sec")).alias("start_time"),
        _clock(F.col("end_sec")).alias("end_time"),
        _clock(F.col("end_sec") - F.col("sec")).alias("duration"),
    )


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as play-by-play; every seventh shooter is a neighbour who may be off the ice."""
    kind = F.col("event_type")
    desc = (
        F.when(kind == "click", "shot-on-goal")
        .when(kind == "view", "missed-shot")
        .when(kind == "error", "blocked-shot")
        .when(kind == "purchase", "goal")
        .otherwise("faceoff")
    )
    shooter = F.when(F.col("event_id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    return _ice(spark, sf_dir).withColumns({"desc": desc, "shooter": shooter}).select(
        "game_id",
        "event_id",
        "period",
        _clock(F.col("sec")).alias("time_in_period"),
        F.col("desc").alias("type_desc_key"),
        F.when(F.col("event_id") % 5 < 4, "1551").otherwise("1541").alias("situation_code"),
        F.when(F.col("desc") != "goal", F.col("shooter")).alias("shooting_player_id"),
        F.when(F.col("desc") == "goal", F.col("shooter")).alias("scoring_player_id"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game dimension of :func:`shifts` and :func:`shots`."""
    return (
        _ice(spark, sf_dir)
        .groupBy("game_id")
        .agg(_season_text(_int(F.floor((F.dayofmonth(F.min("ts")) - 1) / 10)) + 1).alias("season"))
        .withColumn("game_type", F.lit(2))
    )


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as forecasts, with untidy names: the priority is the source."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("projection_id"),
        F.lit(" CUSTOMER ").alias("first_name"),
        F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("  ")).alias("last_name"),
        F.concat(F.lit("Customer "), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("player_name"),
        F.col("o_orderstatus").alias("team"),
        F.col("o_orderpriority").alias("source"),
        (year * 10000 + year + 1).alias("season_id"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("projected_points"),
    )


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` totals per order as outcomes.

    Summed as whole 1/10000 units, so both engines get the same number.
    """
    item = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    kept = F.lit(100).cast("long") - F.round(F.col("l_discount") * 100).cast("long")
    per_order = item.groupBy("l_orderkey").agg(
        F.sum(cents * kept).alias("units"), F.count("*").alias("games_played")
    )
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    return per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("entry_id"),
        F.lit("Customer").alias("first_name"),
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("last_name"),
        F.col("o_orderstatus").alias("team"),
        "games_played",
        (F.col("units") / F.lit(10_000_000.0)).alias("points"),
        (year * 10000 + year + 1).alias("season_id"),
    )


def external_model(spark: SparkSession, sf_dir: str, season: str) -> DataFrame:
    """A second model's season table: expected goals from the event attribute."""
    season_logs = logs(spark, sf_dir).where((F.col("season") == season) & (F.col("game_type") == 2))
    chance = F.coalesce(F.round(F.col("faceoff_pct") * 100), F.lit(0.0)).cast("long")
    totals = season_logs.groupBy("player_id").agg(
        F.count("*").alias("games_played"),
        (F.sum(chance) / F.lit(200.0)).alias("xgoals"),
        F.sum("goals").alias("goals"),
        F.sum("points").alias("points"),
        F.max_by("team_abbr", F.struct("game_date", "game_id")).alias("team"),
    )
    names = players(spark, sf_dir).select(
        "player_id",
        F.concat(F.lit("  "), F.upper(F.concat_ws(" ", "first_name", "last_name"))).alias("name"),
        "position",
    )
    return totals.join(names, "player_id")
