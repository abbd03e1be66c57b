"""Named queries over the sample tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline import schemas
from streakline.functions import lookups as K
from streakline.functions import scalars as S
from streakline.operators import (
    distributions,
    features,
    forecast,
    possession,
    rarity,
    reports,
    streaks,
    tables,
)
from streakline.plans import bindings as B
from streakline.plans import jobs, models
from streakline.session import ensure_checkpoint_dir
from streakline.sources import documents, sheets, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEASON = "20232024"
TRAIN_SEASONS = ("20212022", "20222023")
HEAD_TO_HEAD_GAMES = 10
DATES = ("2024-01-22", "2024-01-25")
ONE_PLAYER = 9
ENTRY_TIES = ("team", "entry_id")
REPORT_TITLE, REPORT_TIME = "Streak Anomaly Daily Report", "2026-01-01 00:00 UTC"
CACHED_SEASONS = (19941995, 19961997)
SHEET_HEADERS = ("HM", "ESPN", "PP", "HN", "FT")
SHEET_YEARS = {1996: (2016, "Prenom"), 1997: (2021, "Prénom"), 1998: (2024, "Prénom")}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _skater_runs(spark, d):
    return streaks.of_skaters(streaks.longest_runs(B.logs(spark, d)), B.players(spark, d))


def _baselines(spark, d):
    return streaks.compute_baselines(B.logs(spark, d), B.players(spark, d), stepwise=True)


def _anomalies(spark, d, **options):
    logs, players = B.logs(spark, d), B.players(spark, d)
    baselines = streaks.compute_baselines(logs, players, stepwise=True)
    return rarity.evaluate_players(logs, players, SEASON, baselines, **options)


# --- streaks and baselines ---------------------------------------------------------


@query
def streak_islands(spark, d):
    return streaks.streak_islands(B.logs(spark, d))


@query
def streak_member_games(spark, d):
    """Run length at every game, which tells the member games of each run."""
    runs = [f"run_{name}" for name in streaks.STREAK_TYPES]
    return streaks.run_lengths(B.logs(spark, d)).select("player_id", "season", "game_id", *runs)


@query
def streak_max(spark, d):
    return streaks.longest_runs(B.logs(spark, d))


@query
def streak_tail_league(spark, d):
    return streaks.tail_distribution(_skater_runs(spark, d))


@query
def streak_tail_team(spark, d):
    runs = streaks.longest_runs(B.logs(spark, d), streaks.TEAM_PLAYER_SEASON)
    named = streaks.of_skaters(runs, B.players(spark, d)).withColumnRenamed("team_abbr", "team")
    return streaks.tail_distribution(named, by=["team"])


@query
def streak_career_max(spark, d):
    return streaks.career_best(_skater_runs(spark, d))


@query
def baseline_meta(spark, d):
    wide = streaks.of_skaters(streaks.longest_runs_wide(B.logs(spark, d)), B.players(spark, d))
    return streaks.player_season_counts(wide)


@query
def last_games(spark, d):
    games = streaks.last_games(B.logs(spark, d), 20)
    return games.select("player_id", "game_id", "season", "game_date", "points", "rn")


@query
def active_streaks(spark, d):
    found = streaks.active_streaks(B.logs(spark, d), ("player_id", "season"))
    return found.select(
        "player_id",
        "season",
        "streak_type",
        "length",
        "start_date",
        "end_date",
        F.size("recent_games").cast("long").alias("n_recent"),
        F.col("recent_games")[0]["game_id"].alias("first_game_id"),
    )


@query
def active_scorers(spark, d):
    logs = B.logs(spark, d).where(F.col("season") == SEASON)
    return rarity.active_players(logs, B.players(spark, d), 10)


_ANOMALY_COLUMNS = (
    "player_id",
    "player_name",
    "team",
    "position",
    "season",
    "streak_type",
    "length",
    "start_date",
    "end_date",
    "sign",
    "description",
    "league_p",
    "team_p",
    "player_p",
    "novelty_index",
    "severity",
)


@query
def streak_anomalies(spark, d):
    return rarity.by_novelty(_anomalies(spark, d)).select(*_ANOMALY_COLUMNS)


@query
def streak_one_player(spark, d):
    """Active streaks of one player, scored; the player is filtered before any streak is built."""
    return _anomalies(spark, d, player_id=ONE_PLAYER).select(*_ANOMALY_COLUMNS)


@query
def daily_records(spark, d):
    """The nested records of the daily job, a row for each level score."""
    records = rarity.as_records(rarity.by_novelty(_anomalies(spark, d, min_novelty=0.5)))
    streak = [F.col(f"streak.{c}").alias(c) for c in ("type", "length", "sign", "description")]
    games = F.size("streak.recent_games").alias("n_games")
    return records.select(
        "player_id", "player_name", "team", "position", *streak, games, "novelty_index", "severity",
        F.inline("rarity_scores"),
    ).withColumns({c: S.rounded(c, 6) for c in ("probability", "rarity")})


@query
def anomaly_top10(spark, d):
    return rarity.top_anomalies(_anomalies(spark, d), 10).select(*_ANOMALY_COLUMNS)


@query
def anomaly_filtered(spark, d):
    kept = rarity.filter_anomalies(
        _anomalies(spark, d), 0.4, ("point_streak", "scoreless_drought"), ("click", "view"), "F"
    )
    return kept.select("player_id", "team", "position", "label", "length", "novelty_index", "severity")


@query
def anomaly_by_severity(spark, d):
    return rarity.severity_counts(_anomalies(spark, d))


@query
def anomaly_by_type_sign(spark, d):
    return rarity.type_sign_counts(_anomalies(spark, d))


@query
def anomaly_type_summary(spark, d):
    return rarity.type_summary(_anomalies(spark, d, min_novelty=0.3))


@query
def anomaly_kpis(spark, d):
    return rarity.anomaly_kpis(_anomalies(spark, d))


@query
def anomaly_novelty_hist(spark, d):
    return distributions.histogram(_anomalies(spark, d), "novelty_index", 0.05)


@query
def tail_curve_vs_league(spark, d):
    return rarity.compare_curves(_baselines(spark, d))


@query
def tail_steps_vs_league(spark, d):
    """Both curves of every team, one row per step."""
    return rarity.compare_steps(_baselines(spark, d))


@query
def tail_heatmap(spark, d):
    return rarity.tail_heatmap(_baselines(spark, d).league)


@query
def tail_summary(spark, d):
    return rarity.baseline_overview(_baselines(spark, d))


@query
def tail_summary_all(spark, d):
    """Every length of every league curve."""
    return rarity.baseline_overview(_baselines(spark, d), short=None)


@query
def tail_team_overview_all(spark, d):
    return rarity.team_overview(_baselines(spark, d), teams=None)


@query
def tail_team_overview(spark, d):
    return rarity.team_overview(_baselines(spark, d))


@query
def career_best_hist(spark, d):
    best = streaks.career_best(_skater_runs(spark, d))
    return distributions.histogram(best, "career_max", 2.0, keys=["streak_type"])


@query
def career_best_summary(spark, d):
    best = streaks.career_best(_skater_runs(spark, d))
    return distributions.spread(best, ["streak_type"], "career_max")


# --- possession ----------------------------------------------------------------------


def _ice(spark, d):
    return possession.timed_events(B.shots(spark, d)), possession.timed_shifts(B.shifts(spark, d))


def _season_possession(spark, d, min_games=0):
    return possession.season_possession(possession.game_possession(*_ice(spark, d)), min_games)


@query
def on_ice_events(spark, d):
    return possession.on_ice_counts(*_ice(spark, d))


@query
def on_ice_at_time(spark, d):
    return possession.on_ice_at(_ice(spark, d)[1], 2, 3600)


@query
def possession_game(spark, d):
    return possession.game_possession(*_ice(spark, d))


@query
def possession_drilldown(spark, d):
    per_game = possession.game_possession(*_ice(spark, d))
    return possession.drill_down(per_game, ["game_id", "player_id", "team"])


@query
def possession_season(spark, d):
    return _season_possession(spark, d)


@query
def possession_one_season(spark, d):
    return possession.player_possession(
        B.shots(spark, d), B.shifts(spark, d), B.games(spark, d), season=SEASON, game_types=[2]
    )


@query
def possession_leaderboard(spark, d):
    season = _season_possession(spark, d, min_games=10)
    return possession.leaderboard(season, B.players(spark, d), ("C", "L", "R", "D"))


@query
def possession_team(spark, d):
    return possession.team_possession(_season_possession(spark, d))


@query
def possession_hist(spark, d):
    return possession.share_histograms(_season_possession(spark, d))


@query
def possession_summary(spark, d):
    return possession.share_summary(_season_possession(spark, d))


@query
def toi_totals(spark, d):
    shifts = _ice(spark, d)[1]
    return shifts.groupBy("player_id").agg(
        F.sum("duration_sec").alias("toi_seconds"), F.count("*").alias("n_shifts")
    )


# --- features --------------------------------------------------------------------------


def _season_stats(spark, d):
    return features.season_stats(B.logs(spark, d).where(F.col("game_type") == 2))


@query
def base_logs(spark, d):
    base = features.base_logs(B.logs(spark, d), B.players(spark, d))
    return base.select(
        "game_id", "player_id", "season", "team_abbr", "points", "position", "shoots_catches", "birth_date"
    )


@query
def prior_season_features(spark, d):
    return features.prior_season_features(_season_stats(spark, d), SEASON)


@query
def momentum(spark, d):
    return features.momentum_features(B.logs(spark, d), SEASON)


@query
def career_features(spark, d):
    return features.career_features(_season_stats(spark, d), SEASON)


@query
def team_strength(spark, d):
    return features.team_strength(B.logs(spark, d), B.players(spark, d), SEASON)


@query
def target_labels(spark, d):
    return features.target_labels(_season_stats(spark, d), SEASON)


def _matrix(spark, d, **options):
    return features.feature_matrix(B.logs(spark, d), B.players(spark, d), SEASON, **options)


@query
def feature_matrix(spark, d):
    return _matrix(spark, d, min_games=10)


@query
def feature_matrix_future(spark, d):
    """Features of a season without any games yet: labels stay empty."""
    matrix = features.feature_matrix(
        B.logs(spark, d), B.players(spark, d), "20242025", require_target=False
    )
    return matrix.select(
        "player_id",
        "season",
        "position",
        "age",
        "target_team",
        "prior_season_used",
        "prior_points_per_game",
        "momentum_pts_per_game",
        "career_games",
        "team_offense",
        "pts_per_game",
    )


# --- forecast back-test -------------------------------------------------------------------


def _matched(spark, d):
    return forecast.match_actuals(B.projections(spark, d), B.actuals(spark, d), ENTRY_TIES)


def _source_metrics(spark, d):
    return forecast.source_metrics(_matched(spark, d))


def _sources():
    return ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query
def best_actuals(spark, d):
    return forecast.best_actuals(B.actuals(spark, d), ENTRY_TIES)


@query
def forecast_matched(spark, d):
    return _matched(spark, d).drop("first_name", "last_name")


@query
def forecast_metrics(spark, d):
    return _source_metrics(spark, d)


@query
def forecast_ranking(spark, d):
    return forecast.source_ranking(_source_metrics(spark, d))


@query
def forecast_error_stats(spark, d):
    return forecast.error_stats(_matched(spark, d))


@query
def forecast_box(spark, d):
    known = _matched(spark, d).where(F.col("abs_error").isNotNull())
    return distributions.box_stats(known, ["source"], "abs_error").select(
        "source", *[S.rounded(c, 4).alias(c) for c in ("lowest", "q1", "mid", "q3", "highest")]
    )


@query
def forecast_hist(spark, d):
    return forecast.error_histogram(_matched(spark, d), 25.0)


@query
def forecast_pivot(spark, d):
    return forecast.season_source_pivot(_matched(spark, d), _sources())


@query
def forecast_with_actual(spark, d):
    return forecast.with_actual_source(_matched(spark, d))


@query
def match_rate(spark, d):
    return forecast.match_rate(B.projections(spark, d), _matched(spark, d))


@query
def unpivot_sources(spark, d):
    """A wide sheet per player and season, one column per source, back to rows."""
    headers = dict(zip(_sources(), ["HM", "pp", "FOR", "Fantrax", "MOY"]))
    wide = (
        B.projections(spark, d)
        .groupBy("player_name", "season_id")
        .agg(*[
            F.max(F.when(F.col("source") == s, F.col("projected_points") - 50)).cast("string").alias(h)
            for s, h in headers.items()
        ])
    )
    chosen = sheets.source_headers(spark, list(headers.values()))
    return forecast.unpivot_sources(wide, ["player_name", "season_id"], chosen)


# --- two models ------------------------------------------------------------------------------


def _comparison(spark, d):
    """Last season's rate as our projection against the second model."""
    stats = _season_stats(spark, d)
    labels = features.target_labels(stats, SEASON, HEAD_TO_HEAD_GAMES)
    prior = features.prior_season_features(stats, SEASON).select(
        "player_id", F.col("prior_points_per_game").alias("projected_pts_per_game")
    )
    names = B.players(spark, d).select("player_id", "first_name", "last_name")
    ours = labels.join(prior, "player_id", "left").join(names, "player_id", "left")
    return forecast.head_to_head(ours, B.external_model(spark, d, SEASON), HEAD_TO_HEAD_GAMES)


@query
def head_to_head(spark, d):
    return _comparison(spark, d)


@query
def model_metrics(spark, d):
    return forecast.model_metrics(_comparison(spark, d))


@query
def win_counts(spark, d):
    return forecast.win_counts(_comparison(spark, d))


@query
def model_error_stats(spark, d):
    return forecast.model_error_stats(_comparison(spark, d))


@query
def model_error_hist(spark, d):
    return distributions.histogram(forecast.errors_long(_comparison(spark, d)), "error", 0.1, keys=["model"])


@query
def top_disagreement(spark, d):
    return forecast.top_disagreement(_comparison(spark, d)).select(
        "player_name", "team", "position", "our_pts_per_game", "external_xgoals_per_game", "disagreement"
    )


@query
def most_accurate(spark, d):
    forwards = forecast.by_position(_comparison(spark, d), "F")
    return forecast.most_accurate(forwards, "external_abs_error").select(
        "player_name", "team", "position", "our_abs_error", "external_abs_error", "more_accurate"
    )


@query
def residual_percentiles(spark, d):
    return distributions.residual_summary(
        _comparison(spark, d), "actual_pts_per_game", "our_pts_per_game"
    )


@query
def fit_by_position(spark, d):
    groups = _comparison(spark, d).withColumn("pg", S.position_group("position"))
    return distributions.error_metrics(groups, ["pg"], "actual_pts_per_game", "our_pts_per_game")


# --- warehouse reports ------------------------------------------------------------------------


@query
def current_team(spark, d):
    return reports.current_team_view(B.players(spark, d), B.team_seasons(spark, d))


@query
def player_info(spark, d):
    return reports.player_info(B.players(spark, d), B.team_seasons(spark, d))


@query
def player_totals(spark, d):
    return reports.player_totals(B.logs(spark, d))


@query
def player_log(spark, d):
    return reports.player_log(B.logs(spark, d))


@query
def top_scorers(spark, d):
    return reports.top_scorers(B.logs(spark, d), B.players(spark, d), B.team_seasons(spark, d))


def _game_log(spark, d):
    """The filtered log of which the report lists the first rows."""
    return reports.filtered_log(
        B.logs(spark, d),
        B.players(spark, d),
        teams=["click", "purchase", "view"],
        seasons=["20222023", "20232024"],
        game_types=[2, 3],
    )


@query
def game_log_filtered(spark, d):
    return reports.game_log_report(_game_log(spark, d))


@query
def game_log_by_date(spark, d):
    """The filtered log of a stretch of dates, both ends included."""
    dates = tuple(F.to_date(F.lit(day)) for day in DATES)
    logs = B.logs(spark, d).withColumn("game_date", F.to_date("game_date"))
    chosen = reports.filtered_log(logs, B.players(spark, d), dates=dates, seasons=[SEASON])
    return chosen.select("game_id", "player_id", "player", "season", "game_date", "team_abbr", "points")


@query
def daily_totals(spark, d):
    return reports.daily_totals(_game_log(spark, d).withColumn("game_date", F.to_date("game_date")))


@query
def player_search(spark, d):
    return reports.player_search(B.players(spark, d), B.team_seasons(spark, d), "ER 00000001")


@query
def player_search_first(spark, d):
    """The first ten players of a search, by name."""
    return reports.player_search(B.players(spark, d), B.team_seasons(spark, d), "er", 10)


@query
def stat_coverage(spark, d):
    return reports.coverage(B.logs(spark, d))


@query
def date_range(spark, d):
    return reports.date_range(B.logs(spark, d))


@query
def type_counts(spark, d):
    return reports.game_type_counts(B.logs(spark, d))


@query
def players_by_team(spark, d):
    return reports.players_by_team(B.team_seasons(spark, d))


@query
def distinct_lists(spark, d):
    return reports.distinct_values(B.logs(spark, d), ["season", "team_abbr", "game_type"])


@query
def games_distinct_players(spark, d):
    return reports.players_per_game(B.shifts(spark, d))


@query
def warehouse_state(spark, d):
    return reports.warehouse_state(
        B.players(spark, d),
        B.team_seasons(spark, d),
        B.logs(spark, d),
        B.shots(spark, d),
        B.shifts(spark, d),
    )


# --- table maintenance --------------------------------------------------------------------------


def _items(spark, d):
    return B.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        "l_shipdate",
    )


@query
def upsert_latest(spark, d):
    """Items shipped up to the end of 1998 as the table, later ones as the new batch."""
    items = _items(spark, d)
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    keys = ["l_orderkey", "l_linenumber"]
    order = [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey")]
    existing = tables.latest_per_key(items.where(F.col("l_shipdate") < cut), keys, order)
    incoming = items.where(F.col("l_shipdate") >= cut).drop("l_returnflag")
    return tables.upsert(existing, incoming, keys, order, {"l_returnflag": "-"})


@query
def known_only(spark, d):
    orders = B.table(spark, d, "orders").where(F.col("o_orderstatus") == "F")
    return tables.known_only(_items(spark, d), orders, "l_orderkey", "o_orderkey")


@query
def orphans(spark, d):
    buyers = B.table(spark, d, "customer").where(F.col("c_acctbal") > 0)
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return tables.orphans(orders, buyers, "o_custkey", "c_custkey")


@query
def skip_existing(spark, d):
    logs = B.logs(spark, d)
    loaded = logs.where(F.col("game_type") == 3).select("player_id", "season")
    return tables.skip_existing(
        logs.select("game_id", "player_id", "season", "points"), loaded, ["player_id", "season"]
    )


@query
def first_seen_games(spark, d):
    """Every game once, as listed by the first team to name it."""
    listed = B.shifts(spark, d).select("game_id", "team_abbr", "shift_id")
    return tables.first_seen(listed, ["game_id"], ["team_abbr", "shift_id"])


@query
def distinct_games(spark, d):
    return tables.distinct_ids([B.shots(spark, d), B.shifts(spark, d)], "game_id")


@query
def missing_seasons(spark, d):
    return tables.missing_ids(B.projections(spark, d), B.actuals(spark, d).where(F.col("season_id") < 19982000), "season_id")


@query
def games_in_both(spark, d):
    even = B.shots(spark, d).where(F.col("situation_code") == K.EVEN_STRENGTH)
    long_shifts = possession.timed_shifts(B.shifts(spark, d)).where(F.col("duration_sec") > 1200)
    return tables.ids_in_both(even, long_shifts, "game_id")


@query
def evolved_logs(spark, d):
    """An older log layout brought to the declared one; the season comes from the date."""
    old = B.logs(spark, d).select(
        "game_id",
        "player_id",
        F.to_date("game_date").cast("string").alias("game_date"),
        "team_abbr",
        "goals",
        "points",
    )
    return tables.evolve(old, schemas.schema(schemas.GAME_LOGS), schemas.LOG_DEFAULTS)


# --- scalar rules ------------------------------------------------------------------------------------


def _cycled(column: str, values: list[str]):
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int")
    )


RAW_TEAMS = ["FLO", "tb ", " SJ", "la", "WIN", "clb", "EDM", ""]
RAW_SOURCES = ["HM", " pp", "FOR", "hn", "Mystery", "the athletic "]
RAW_HEADERS = [
    "HM",
    "HM.1",
    "Rang",
    "MOY",
    "Unnamed: 3",
    "Colonne7",
    "Age",
    "ESPN2",
    "ESPN",
    "moy.2",
    "Lepool.com",
    "Ville",
]


@query
def normalise_codes(spark, d):
    c = B.table(spark, d, "customer").select(
        "c_custkey",
        _cycled("c_custkey", RAW_TEAMS).alias("raw_team"),
        _cycled("c_custkey", RAW_SOURCES).alias("raw_source"),
    )
    return c.withColumns({"team": S.team_code("raw_team"), "source": S.source_name("raw_source")})


@query
def source_columns(spark, d):
    headers = B.table(spark, d, "customer").select(
        "c_custkey", _cycled("c_custkey", RAW_HEADERS).alias("header")
    )
    return headers.withColumn("is_source", S.is_source_header("header"))


@query
def split_names(spark, d):
    parts = B.table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" "), "p_type").alias("name")
    )
    segments = B.table(spark, d, "customer").select(
        F.col("c_custkey").alias("p_partkey"), F.col("c_mktsegment").alias("name")
    )
    named = parts.withColumn("origin", F.lit("part")).unionByName(
        segments.withColumn("origin", F.lit("customer"))
    )
    return named.select(
        "origin",
        "p_partkey",
        S.first_name("name").alias("first_name"),
        S.last_name("name").alias("last_name"),
        S.match_key(S.first_name("name"), S.last_name("name")).alias("match_key"),
    )


@query
def safe_casts(spark, d):
    k = F.get_json_object("props", "$.k")
    raw = (
        F.when(k.cast("int") % 5 == 0, F.lit("n/a"))
        .when(k.cast("int") % 5 == 1, F.lit(None).cast("string"))
        .otherwise(k)
    )
    e = B.table(spark, d, "events").select("event_id", raw.alias("raw"), k.alias("k"))
    return e.select(
        "event_id",
        S.int_or("raw").alias("as_int"),
        S.int_or("raw", -1).alias("as_int_or"),
        S.nonzero_double("k").alias("as_double"),
        S.count_or_zero("raw").alias("as_count"),
        S.is_season(F.concat(F.lit("202320"), "k")).alias("season_ok"),
    )


@query
def clock_and_age(spark, d):
    """Durations, ages and season labels."""
    players = B.players(spark, d)
    at = F.lit("2023-10-01").cast("date")
    clock = F.concat_ws(":", F.col("sweater_number").cast("string"), F.lpad((F.col("player_id") % 70).cast("string"), 2, "0"))
    text = F.when(F.col("player_id") % 7 == 0, F.lit("12")).when(F.col("player_id") % 7 == 1, F.lit(":30")).otherwise(clock)
    return players.select(
        "player_id",
        S.clock_seconds(text).alias("seconds"),
        S.age_at("birth_date", at).alias("age"),
        S.season_of_date("birth_date").alias("birth_season"),
        S.length_bucket(F.col("player_id") % 60 + 1).alias("bucket"),
    )


@query
def regex_records(spark, d):
    """Two records per text cell, built from customers and parsed back."""

    def record(shift: int):
        key = F.col("c_custkey") + shift
        return F.concat_ws(
            " ",
            key.cast("string"),
            F.lit("Éric St-Jean"),
            F.substring("c_mktsegment", 1, 3),
            *[(key % m).cast("string") for m in (97, 89, 83, 79)],
            F.lit("41,5"),
        )

    cells = B.table(spark, d, "customer").select(
        "c_custkey", F.concat_ws("  ", record(0), record(100_000)).alias("value")
    )
    return sheets.text_records(cells, "value", ["c_custkey"]).select(
        "c_custkey",
        "rank",
        "first_name",
        "last_name",
        "team",
        *[F.col("values")[i].alias(f"value_{i + 1}") for i in range(4)],
        "mean",
    )


# --- nested documents ------------------------------------------------------------------------------------


def _doc(df: DataFrame, ids: list[str], doc) -> DataFrame:
    return df.select(*ids, F.to_json(doc).alias("_json"))


@query
def boxscore_flatten(spark, d):
    """A boxscore document per game row, as JSON text, flattened back.

    The row's player sits on its own side, next to a goalie of the other side
    who did not play.
    """
    logs = B.logs(spark, d)
    player = F.struct(
        F.col("player_id").alias("playerId"),
        "goals",
        "assists",
        "points",
        F.col("shots").alias("sog"),
        "pim",
        F.col("plus_minus").alias("plusMinus"),
        F.col("time_on_ice").alias("toi"),
        "shifts",
        F.col("power_play_goals").alias("powerPlayGoals"),
        F.when(F.col("blocked_shots") > 0, F.col("blocked_shots").cast("string"))
        .otherwise("none")
        .alias("blockedShots"),
        "hits",
        "giveaways",
        "takeaways",
        F.col("faceoff_pct").alias("faceoffWinningPctg"),
    )
    def goalie(shift: int, toi: str):
        return F.struct(
            (F.col("player_id") + shift).alias("playerId"),
            F.lit(toi).alias("toi"),
            F.lit(30).alias("sog"),
            F.lit(2).alias("pim"),
        )

    spare, starter = goalie(1_000_000, "0:00"), goalie(2_000_000, "60:00")
    home = F.col("home_road_flag") == "H"
    forward = F.col("player_id") % 2 == 0
    own = F.struct(
        F.when(forward, F.array(player)).alias("forwards"),
        F.when(~forward, F.array(player)).alias("defense"),
    )
    other = F.struct(F.array(spare, starter).alias("goalies"))

    def abbrev(c):
        return F.struct(c.alias("abbrev"))

    doc = F.struct(
        F.col("game_id").alias("id"),
        "season",
        F.col("game_type").alias("gameType"),
        F.to_date("game_date").cast("string").alias("gameDate"),
        F.when(home, abbrev(F.col("opponent_abbr"))).otherwise(abbrev(F.col("team_abbr"))).alias("awayTeam"),
        F.when(home, abbrev(F.col("team_abbr"))).otherwise(abbrev(F.col("opponent_abbr"))).alias("homeTeam"),
        F.when(home, F.to_json(F.struct(other.alias("awayTeam"), own.alias("homeTeam"))))
        .otherwise(F.to_json(F.struct(own.alias("awayTeam"), other.alias("homeTeam"))))
        .alias("stats"),
    )
    text = F.regexp_replace(F.to_json(doc.dropFields("stats")), r"\}$", ',"playerByGameStats":')
    built = logs.select(F.concat(text, doc["stats"], F.lit("}")).alias("_json"))
    return documents.flatten_boxscores(documents.parse_column(built, "_json", schemas.BOXSCORE_DOC))


@query
def roster_flatten(spark, d):
    """A roster document per player row: one listed player and one goalie."""
    p = B.players(spark, d)
    listed = F.struct(
        F.col("player_id").alias("id"),
        F.struct(F.col("first_name").alias("default")).alias("firstName"),
        F.struct(F.col("last_name").alias("default")).alias("lastName"),
        F.col("position").alias("positionCode"),
        F.col("sweater_number").alias("sweaterNumber"),
        F.col("shoots_catches").alias("shootsCatches"),
        F.col("birth_date").alias("birthDate"),
    )
    goalie = F.struct((F.col("player_id") + 1_000_000).alias("id"), F.lit("Plain").alias("lastName"))
    doc = F.struct(
        F.col("position").alias("teamAbbrev"),
        F.lit(SEASON).alias("season"),
        F.when(F.col("position") != "D", F.array(listed)).alias("forwards"),
        F.when(F.col("position") == "D", F.array(listed)).alias("defensemen"),
        F.array(goalie).alias("goalies"),
    )
    return documents.flatten_rosters(documents.parse_column(_doc(p, [], doc), "_json", schemas.ROSTER_DOC))


@query
def schedule_flatten(spark, d):
    """A schedule document per shift row; games are listed by both teams."""
    s = B.shifts(spark, d)
    game = F.struct(
        F.col("game_id").alias("id"),
        F.lit(2).alias("gameType"),
        F.lit("2024-01-01").alias("gameDate"),
        F.struct(F.lit("A").alias("abbrev")).alias("awayTeam"),
        F.struct(F.lit("B").alias("abbrev")).alias("homeTeam"),
    )
    preseason = game.withField("gameType", F.lit(1))
    doc = F.struct(
        F.col("team_abbr").alias("teamAbbrev"), F.lit(SEASON).alias("season"), F.array(game, preseason).alias("games")
    )
    docs = documents.parse_column(_doc(s, [], doc), "_json", schemas.SCHEDULE_DOC)
    games = documents.flatten_schedules(docs, [2, 3])
    return tables.first_seen(games, ["game_id"], ["team_abbr"])


def _game_log_docs(spark, d):
    """A game-log document per row: one entry with its game id and one without."""
    logs = B.logs(spark, d)

    def entry(game_id):
        return F.struct(
            game_id.alias("gameId"),
            F.to_date("game_date").cast("string").alias("gameDate"),
            F.col("team_abbr").alias("teamAbbrev"),
            F.when(F.col("shots") > 2, F.col("opponent_abbr")).alias("opponentAbbrev"),
            "goals",
            "assists",
            "points",
            F.when(F.col("shots") == 5, F.lit("many")).otherwise(F.col("shots").cast("string")).alias("shots"),
            F.col("time_on_ice").alias("toi"),
        )

    doc = F.struct(
        F.col("player_id").alias("playerId"),
        "season",
        F.col("game_type").alias("gameType"),
        F.array(entry(F.col("game_id")), entry(F.lit(None).cast("long"))).alias("gameLog"),
    )
    return documents.parse_column(_doc(logs, [], doc), "_json", schemas.GAME_LOG_DOC)


@query
def game_log_flatten(spark, d):
    return documents.flatten_game_logs(_game_log_docs(spark, d))


@query
def game_log_rejected(spark, d):
    """The other side of the routing; of the raw entry one field is read back."""
    bad = documents.rejected_game_logs(_game_log_docs(spark, d))
    return bad.select(
        "player_id", "season", "game_type", "reason", F.get_json_object("entry", "$.teamAbbrev").alias("team_abbr")
    )


@query
def game_log_rejection_counts(spark, d):
    return documents.rejection_counts(_game_log_docs(spark, d))


@query
def pbp_flatten(spark, d):
    """A play-by-play document per event, flattened to the 28-column layout."""
    e = B.shots(spark, d)
    play = F.struct(
        F.col("event_id").alias("eventId"),
        F.struct(F.col("period").alias("number")).alias("periodDescriptor"),
        F.col("time_in_period").alias("timeInPeriod"),
        F.col("type_desc_key").alias("typeDescKey"),
        F.col("situation_code").alias("situationCode"),
        F.when(
            F.col("type_desc_key") != "faceoff",
            F.struct(
                F.col("shooting_player_id").alias("shootingPlayerId"),
                F.col("scoring_player_id").alias("scoringPlayerId"),
                (F.col("event_id") % 100).alias("xCoord"),
            ),
        ).alias("details"),
    )
    doc = F.struct(F.col("game_id").alias("id"), F.array(play).alias("plays"))
    docs = documents.parse_column(_doc(e, [], doc), "_json", schemas.PLAY_BY_PLAY_DOC)
    return documents.flatten_play_by_play(docs)


@query
def shifts_flatten(spark, d):
    """A shift-chart document per shift, flattened to the 16-column layout."""
    s = B.shifts(spark, d)
    row = F.struct(
        F.col("shift_id").alias("id"),
        F.col("player_id").alias("playerId"),
        F.split_part("player_name", F.lit(" "), F.lit(1)).alias("firstName"),
        F.when(F.col("player_id") % 2 == 0, F.split_part("player_name", F.lit(" "), F.lit(2))).alias("lastName"),
        F.col("team_abbr").alias("teamAbbrev"),
        "period",
        F.col("start_time").alias("startTime"),
        F.col("end_time").alias("endTime"),
        "duration",
    )
    doc = F.struct(F.col("game_id").alias("gameId"), F.array(row).alias("data"))
    docs = documents.parse_column(_doc(s, [], doc), "_json", schemas.SHIFT_CHART_DOC)
    return documents.flatten_shift_charts(docs)


# --- what the sinks write, read back ------------------------------------------------------------------------------


def _written(spark) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark)}/written/{uuid4().hex}"


@query
def written_records(spark, d):
    """The JSON lines of all anomalies."""
    folder = _written(spark)
    sinks.write_jsonl(_anomalies(spark, d), folder)
    records = spark.read.schema(
        "player_id long, player_name string, team string, streak struct<type:string, length:long, sign:string, recent_games:array<struct<game_id:long>>>,"
        " rarity_scores array<struct<level:string, probability:double, rarity:double>>, novelty_index double, severity string"
    ).json(folder)
    streak = [F.col(f"streak.{c}").alias(c) for c in ("type", "length", "sign")]
    games = F.size("streak.recent_games").alias("n_games")
    ids = ("player_id", "player_name", "team")
    return records.select(*ids, *streak, games, "novelty_index", "severity", F.inline("rarity_scores")).withColumns(
        {c: S.rounded(c, 6) for c in ("probability", "rarity")}
    )


@query
def written_summary(spark, d):
    """The lines of the daily text report."""
    folder = _written(spark)
    sinks.write_summary(_anomalies(spark, d), folder, REPORT_TITLE, REPORT_TIME)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query
def written_baselines(spark, d):
    """Curves of both levels by length and career bests, from the stored baselines."""
    folder = _written(spark)
    sinks.save_baselines(_baselines(spark, d), folder)
    stored = sinks.load_baselines(spark, folder)
    levels = (
        stored.league.withColumn("level", F.lit("league")),
        stored.team.withColumn("level", F.lit("team")),
        stored.player.withColumn("level", F.lit("player")),
    )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)


@query
def exported_curves(spark, d):
    folder = _written(spark)
    sinks.export_curves(streaks.tail_distribution(_skater_runs(spark, d)), folder)
    return sinks.import_curves(spark, folder)


@query
def cached_seasons(spark, d):
    """Outcomes of two seasons out of a cache of all."""
    folder = _written(spark)
    sinks.cache_results(B.actuals(spark, d), folder)
    return sinks.cached_results(spark, folder, CACHED_SEASONS).select("season_id", "entry_id", "games_played", "points")


@query
def written_csv(spark, d):
    """Forecasts with their outcomes as a CSV table."""
    folder = _written(spark)
    columns = "projection_id long, player_name string, source string, season_id int, projected_points double, actual_points double"
    names = [c.split()[0] for c in columns.split(", ")]
    sinks.write_csv(_matched(spark, d).select(*names), folder)
    return spark.read.schema(columns).csv(folder, header=True)


def _sheet(spark, d, calendar_year: int, first_name: str) -> DataFrame:
    """One year's orders as a forecast sheet: a column per source, with ranks, means and nameless rows between."""
    o = B.table(spark, d, "orders").where(F.year("o_orderdate") == calendar_year)
    value = F.col("o_totalprice") / F.lit(1000.0)
    nameless = F.col("o_orderkey") % 50 == 0
    cells = [F.when(F.col("o_orderpriority") == s, value).alias(h) for s, h in zip(_sources(), SHEET_HEADERS)]
    return o.select(
        F.col("o_orderkey").alias("Rang"),
        F.lit("Customer").alias(first_name),
        F.when(~nameless, F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("Nom"),
        *cells,
        value.alias("MOY"),
    )


def _results(spark, d, calendar_year: int) -> DataFrame:
    """One year's outcomes as a results table, with header lines and total rows between."""
    a = B.actuals(spark, d).where(F.floor(F.col("season_id") / 10000) == calendar_year)
    total, head = F.col("entry_id") % 11 == 0, F.col("entry_id") % 13 == 0
    return a.select(
        F.when(head, "Rk").otherwise(F.concat_ws(" ", "first_name", "last_name")).alias("Player"),
        F.when(total, "TOT").otherwise(F.col("team")).alias("Tm"),
        F.col("games_played").cast("string").alias("GP"),
        F.lit("x").alias("G"),
        F.lit(None).cast("string").alias("A"),
        F.floor("points").cast("string").alias("PTS"),
    )


def _backtest(spark, d):
    folder, paths, results = _written(spark), {}, []
    for calendar_year, (year, first_name) in SHEET_YEARS.items():
        paths[year] = f"{folder}/{year}"
        sinks.write_csv(_sheet(spark, d, calendar_year, first_name), paths[year])
        results.append(sheets.season_results(_results(spark, d, calendar_year), year * 10000 + year + 1))
    return jobs.backtest(spark, paths, reduce(DataFrame.unionByName, results))


@query
def sheet_projections(spark, d):
    """Forecast rows of three written sheets, each with its own layout."""
    return _backtest(spark, d)["projections"]


@query
def results_table(spark, d):
    """Player rows of a results table: no header lines, no total rows."""
    return sheets.season_results(_results(spark, d, 1996), 20162017)


@query
def backtest_metrics(spark, d):
    """The whole back-test: sheets read, matched with results tables, and measured."""
    return _backtest(spark, d)["metrics"]


@query
def backtest_match_rate(spark, d):
    return _backtest(spark, d)["match_rate"]


# --- models: the table they learn from, and a naive forecast through all that follows a model --------------------


def _rows(spark, d):
    return models.split_seasons(B.logs(spark, d), B.players(spark, d), TRAIN_SEASONS, SEASON, min_games=10)


def _naive(spark, d):
    return models.recent_form(_matrix(spark, d, min_games=10))


@query
def training_table(spark, d):
    """Feature rows of all seasons that a model sees, from one pass for all of them."""
    return _rows(spark, d)


@query
def training_counts(spark, d):
    return models.training_counts(_rows(spark, d))


@query
def category_codes(spark, d):
    return models.category_codes(_rows(spark, d), features.categorical_columns())


@query
def feature_relevance(spark, d):
    rows = _rows(spark, d)
    return models.relevance(rows, features.feature_columns(rows), 15)


@query
def naive_projection(spark, d):
    return models.project(_naive(spark, d), B.players(spark, d), B.team_seasons(spark, d), "recent form")


@query
def naive_leaderboard(spark, d):
    return models.projection_leaderboard(naive_projection(spark, d), 30, "F")


@query
def naive_actual_vs_predicted(spark, d):
    scored = models.actual_vs_predicted(_naive(spark, d))
    return scored.select("player_id", "position", "pts_per_game", "prediction", "residual")


@query
def naive_metrics(spark, d):
    return models.fit_metrics(_naive(spark, d))


@query
def naive_residuals(spark, d):
    return distributions.residual_summary(_naive(spark, d), models.LABEL, "prediction")


@query
def naive_rate_hist(spark, d):
    return distributions.histogram(naive_projection(spark, d), "projected_pts_per_game", 0.1)


def _mean_rate(projections):
    return projections.agg(
        S.rounded(F.avg("projected_pts_per_game"), 6).alias("mean_rate"), F.count("*").alias("players")
    )


@query
def naive_rate_mean(spark, d):
    return _mean_rate(naive_projection(spark, d))


# --- boosted trees (scores differ between libraries, so no SQL twin) ---------------------------------------------

_STORED: dict[tuple[str, str], str] = {}


def _model_folder(spark, d) -> str:
    """Folder of the model over these tables: stored by the first query that asks, loaded by all."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        folder = f"{ensure_checkpoint_dir(spark)}/models/{uuid4().hex}"
        models.run_training(
            B.logs(spark, d), B.players(spark, d), TRAIN_SEASONS, SEASON, folder, min_games=10
        )
        _STORED[key] = folder
    return _STORED[key]


def _trained(spark, d):
    return models.load_model(spark, _model_folder(spark, d))


@query
def gbt_projection(spark, d):
    trained = _trained(spark, d)
    scored = trained.score(_matrix(spark, d, min_games=10))
    return models.project(
        scored, B.players(spark, d), B.team_seasons(spark, d), trained.version, trained.mae
    )


@query
def projection_leaderboard(spark, d):
    return models.projection_leaderboard(gbt_projection(spark, d), 30, "F")


@query
def gbt_metrics(spark, d):
    return _trained(spark, d).metrics.drop("feature_columns", "categorical_columns")


@query
def gbt_residuals(spark, d):
    return _trained(spark, d).residuals


@query
def importance_top(spark, d):
    return models.load_importance(spark, _model_folder(spark, d)).limit(15)


@query
def actual_vs_predicted(spark, d):
    scored = models.actual_vs_predicted(_trained(spark, d).score(_matrix(spark, d, min_games=10)))
    return scored.select("player_id", "position", "pts_per_game", "prediction", "residual")


@query
def projected_rate_hist(spark, d):
    return distributions.histogram(gbt_projection(spark, d), "projected_pts_per_game", 0.1)


@query
def projected_rate_mean(spark, d):
    return _mean_rate(gbt_projection(spark, d))
