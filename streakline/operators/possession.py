"""Credit of shot attempts to the players on the ice.

A shot at time t counts for every player with a shift ``start <= t <= end`` in
the same game and period. Joining shots with shifts would emit every (shot,
player) pair. Instead, shots and shift ends are read in time order once: a
player's share is the running shot count at the end of a shift minus the count
just before its start. The work grows with shots plus shifts, not with their
product, and the running counts cope with a period of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.functions import lookups as K
from streakline.functions import scalars as S
from streakline.operators.distributions import histogram, spread
from streakline.operators.ordered import OrderedGroups, block_of, last_rows, order_groups

SIDE = ("game_id", "period", "team_abbr")
SKATER = ("game_id", "period", "player_id")
#: ``ref`` holds all that a row carries along, so that order and values need the same columns.
TIME_ORDER = ("t", "mark", "ref")
BEFORE, AT, AFTER = 0, 1, 2
CHUNK_SEC = 600


def timed_shifts(shifts: DataFrame) -> DataFrame:
    """Shifts with start, end and duration in seconds."""
    return shifts.select(
        "game_id",
        "shift_id",
        "period",
        "player_id",
        "player_name",
        "team_abbr",
        S.clock_seconds("start_time").alias("start_sec"),
        S.clock_seconds("end_time").alias("end_sec"),
        S.clock_seconds("duration").alias("duration_sec"),
    )


def timed_events(events: DataFrame) -> DataFrame:
    """Events with their second and the acting player (scorer when there is no shooter)."""
    shooter = F.coalesce(F.nullif("shooting_player_id", F.lit(0)), "scoring_player_id")
    return events.select(
        "game_id",
        "event_id",
        "period",
        "type_desc_key",
        "situation_code",
        S.clock_seconds("time_in_period").alias("t"),
        shooter.alias("shooter_id"),
    )


def qualifying_games(events: DataFrame, shifts: DataFrame, strength: str = K.EVEN_STRENGTH) -> DataFrame:
    """Games with an event at this strength and shifts of two teams, and those teams.

    The two teams are the first ones to appear by shift id.
    """
    per_team = shifts.groupBy("game_id", "team_abbr").agg(F.min("shift_id").alias("first_shift"))
    first_two = last_rows(per_team, ["game_id"], [F.asc("first_shift")], 2, "_rank")
    pairs = (
        first_two.groupBy("game_id")
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col("team_abbr"))).alias("team_1"),
            F.max(F.when(F.col("_rank") == 2, F.col("team_abbr"))).alias("team_2"),
        )
        .where(F.col("team_2").isNotNull())
    )
    at_strength = events.where(F.col("situation_code") == strength).select("game_id").distinct()
    return pairs.join(at_strength, "game_id", "left_semi")


def _ref(**values: Column) -> Column:
    """What a row of a timeline carries: its id, player, end, team, kind of shot and the two teams of the game."""
    kinds = {"id": "long", "player_id": "long", "end_sec": "int", **dict.fromkeys(("team", "type_desc_key", "team_1", "team_2"), "string")}
    return F.struct(*[values.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()])


def _skater_timeline(events: DataFrame, shifts: DataFrame, games: DataFrame, strength: str, chunk_sec: int) -> DataFrame:
    """Shift starts and shots of each player in time order, with ``_upto_1`` and ``_upto_2``: the latest shift end before, by team.

    These tell two things. A shift start is moved behind its team's, so that no
    second of a player counts twice. A shot finds its shooter on the ice, and on
    which side, when one reaches the shot. Shifts of other teams than the
    game's two do not count.
    """
    attempts = events.where(
        (F.col("situation_code") == strength)
        & F.col("type_desc_key").isin(*K.SHOT_ATTEMPTS)
        & F.col("shooter_id").isNotNull()
    )
    # a shift that ends before it starts covers no second and drops out later
    starts = shifts.select(
        *SKATER, F.col("start_sec").alias("t"), F.lit(BEFORE).alias("mark"), F.col("shift_id").alias("id"), "end_sec", "team_abbr"
    )
    shots = attempts.select(
        "game_id",
        "period",
        F.col("shooter_id").alias("player_id"),
        "t",
        F.lit(AT).alias("mark"),
        F.col("event_id").alias("id"),
        "type_desc_key",
    )
    rows = starts.unionByName(shots, allowMissingColumns=True).join(games, "game_id")
    ref = _ref(**{c: F.col(c) for c in ("id", "end_sec", "type_desc_key", "team_1", "team_2")}, team=F.col("team_abbr"))
    groups = order_groups(rows.select(*SKATER, "t", "mark", ref.alias("ref")), SKATER, TIME_ORDER, block_of("t", chunk_sec))
    ends = {f"_upto_{k}": F.when(F.col("ref.team") == F.col(f"ref.team_{k}"), F.col("ref.end_sec")) for k in (1, 2)}
    return groups.running(maxes=ends, exclusive=True).rows()


def _side_timeline(seen: DataFrame, chunk_sec: int) -> OrderedGroups:
    """Shots (seen from both teams) and both ends of every shift per side, in time order; ``is_for`` tells whose shot it is."""
    t, ref = F.col("t"), F.col("ref")
    end = ref["end_sec"]
    own = F.when(ref["team"] == ref["team_1"], F.col("_upto_1")).when(ref["team"] == ref["team_2"], F.col("_upto_2"))
    start = F.greatest(t, own + 1)
    on = [F.coalesce(F.col(f"_upto_{k}") >= t, F.lit(False)) for k in (1, 2)]
    # a shooter on the ice for both counts for the first by name
    first = on[0] & (~on[1] | (ref["team_1"] <= ref["team_2"]))
    shooters, opponents = (F.when(first, ref[x]).otherwise(ref[y]) for x, y in (("team_1", "team_2"), ("team_2", "team_1")))

    def row(team: Column, t: Column, mark: int, is_for: Column, **carried: Column) -> Column:
        fields = {"team_abbr": team, "t": t, "mark": F.lit(mark), "ref": F.struct(is_for.alias("is_for"), _ref(**carried).alias("of"))}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    none, shift = F.lit(None).cast("int"), {"id": ref["id"], "player_id": F.col("player_id")}
    shot = {"id": ref["id"], "type_desc_key": ref["type_desc_key"]}
    ends = F.array(row(ref["team"], start, BEFORE, none, **shift), row(ref["team"], end, AFTER, none, **shift))
    sides = F.array(row(shooters, t, AT, F.lit(1), **shot), row(opponents, t, AT, F.lit(0), **shot))
    counts = ((ref["team"] == ref["team_1"]) | (ref["team"] == ref["team_2"])) & (start <= end)
    shown = F.when((F.col("mark") == AT) & (on[0] | on[1]), sides).when((F.col("mark") == BEFORE) & counts, ends)
    rows = seen.select("game_id", "period", F.explode(shown).alias("_x")).select("game_id", "period", "_x.*")
    return order_groups(rows, SIDE, TIME_ORDER, block_of("t", chunk_sec))


def on_ice_counts(
    events: DataFrame, shifts: DataFrame, strength: str = K.EVEN_STRENGTH, chunk_sec: int = CHUNK_SEC
) -> DataFrame:
    """Per shot attempt: the two teams and how many players each had on the ice.

    ``events`` and ``shifts`` come from :func:`timed_events` and :func:`timed_shifts`;
    ``chunk_sec`` is the length of the blocks that are read on their own.
    """
    games = qualifying_games(events, shifts, strength)
    timeline = _side_timeline(_skater_timeline(events, shifts, games, strength, chunk_sec), chunk_sec)
    skaters = timeline.running(sums={"on_ice": 1 - F.col("mark")}).rows()

    def side(is_for: int, value: str) -> Column:
        return F.max(F.when(F.col("ref.is_for") == is_for, F.col(value)))

    return (
        skaters.where(F.col("mark") == AT)
        .groupBy("game_id", F.col("ref.of.id").alias("event_id"), "period", "t", F.col("ref.of.type_desc_key").alias("type_desc_key"))
        .agg(
            side(1, "team_abbr").alias("shooter_team"),
            side(0, "team_abbr").alias("opposing_team"),
            side(1, "on_ice").alias("n_for"),
            side(0, "on_ice").alias("n_against"),
        )
    )


def on_ice_at(shifts: DataFrame, period: int, second: int) -> DataFrame:
    """Players on the ice at one moment, per game and team."""
    at = (
        (F.col("period") == period)
        & (F.col("start_sec") <= second)
        & (F.col("end_sec") >= second)
    )
    return shifts.where(at).select("game_id", "team_abbr", "player_id").distinct()


def game_possession(
    events: DataFrame, shifts: DataFrame, strength: str = K.EVEN_STRENGTH, chunk_sec: int = CHUNK_SEC
) -> DataFrame:
    """Shot attempts for and against, all and unblocked, per player and game.

    Ice time sums every shift of the game at any strength; games without two
    teams or without an event at ``strength`` give no rows.
    """
    games = qualifying_games(events, shifts, strength)
    timeline = _side_timeline(_skater_timeline(events, shifts, games, strength, chunk_sec), chunk_sec)

    def counted(is_for: int, only_unblocked: bool) -> Column:
        hit = F.col("ref.is_for") == is_for
        if only_unblocked:
            hit = hit & F.col("ref.of.type_desc_key").isin(*K.UNBLOCKED_ATTEMPTS)
        return F.when(hit, 1).otherwise(0)

    counters = {"cf": (1, False), "ca": (0, False), "ff": (1, True), "fa": (0, True)}
    running = timeline.running(sums={c: counted(*spec) for c, spec in counters.items()}).rows()
    # what was counted up to a shift's end less what was counted before its start
    credits = running.where(F.col("mark") != AT).select(
        "game_id", F.col("ref.of.player_id").alias("player_id"), *[((F.col("mark") - AT) * F.col(c)).alias(c) for c in counters]
    )
    played = shifts.join(games.select("game_id"), "game_id", "left_semi").select(
        "game_id", "player_id", "shift_id", "team_abbr", "player_name", "duration_sec"
    )

    def first(value: str) -> Column:
        return F.min_by(value, F.when(F.col(value).isNotNull(), F.col("shift_id")))

    # one aggregate over shifts and credits; a player without shifts has no credits
    both = played.unionByName(credits, allowMissingColumns=True).groupBy("game_id", "player_id").agg(
        first("team_abbr").alias("team"),
        first("player_name").alias("player_name"),
        F.sum("duration_sec").alias("toi_seconds"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters],
        F.count("shift_id").alias("_shifts"),
    )
    return both.where("_shifts > 0").drop("_shifts").withColumns(
        {"cf_pct": S.percent("cf", "ca"), "ff_pct": S.percent("ff", "fa")}
    )


def season_possession(per_game: DataFrame, min_games: int = 0) -> DataFrame:
    """Season totals, shares and hourly rates; name and team of the latest game."""
    latest = "game_id"
    totals = per_game.groupBy("player_id").agg(
        F.max_by("player_name", latest).alias("player_name"),
        F.max_by("team", latest).alias("team"),
        F.count("*").alias("gp"),
        *[F.sum(c).alias(c) for c in ("cf", "ca", "ff", "fa", "toi_seconds")],
    )
    return totals.where(F.col("gp") >= min_games).withColumns(
        {
            "cf_pct": S.percent("cf", "ca"),
            "ff_pct": S.percent("ff", "fa"),
            "cf_per_60": S.per_hour("cf", "toi_seconds"),
            "ff_per_60": S.per_hour("ff", "toi_seconds"),
        }
    )


def player_possession(
    events: DataFrame,
    shifts: DataFrame,
    games: DataFrame | None = None,
    season=None,
    game_types: Sequence[int] = (),
    strength: str = K.EVEN_STRENGTH,
    min_games: int = 0,
) -> DataFrame:
    """Season roll-up from raw events and shifts.

    With a ``games`` dimension (game_id, season, game_type) the season and type
    filters apply to both inputs before anything else.
    """
    e, s = timed_events(events), timed_shifts(shifts)
    if games is not None and (season is not None or game_types):
        wanted = games.where(
            S.optional_filters(isin={"season": [] if season is None else [season], "game_type": game_types})
        ).select("game_id")
        e, s = e.join(wanted, "game_id", "left_semi"), s.join(wanted, "game_id", "left_semi")
    return season_possession(game_possession(e, s, strength), min_games)


def team_possession(season: DataFrame) -> DataFrame:
    totals = season.groupBy("team").agg(
        *[F.sum(c).alias(c) for c in ("cf", "ca", "ff", "fa", "toi_seconds")],
        S.rounded(F.avg("gp"), 0).cast("int").alias("gp"),
        F.count("player_id").alias("players_count"),
    )
    return totals.withColumns({"cf_pct": S.percent("cf", "ca"), "ff_pct": S.percent("ff", "fa")})


def leaderboard(season: DataFrame, players: DataFrame, positions: Sequence[str] = ()) -> DataFrame:
    """Season rows with position and minutes, best share first."""
    named = season.join(players.select("player_id", "position"), "player_id", "left").where(
        S.optional_filters(isin={"position": positions})
    )
    return named.withColumn("toi_min", S.rounded(F.col("toi_seconds") / 60, 1)).orderBy(
        F.desc("cf_pct"), "player_id"
    )


def drill_down(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per player and labelled count."""
    labels = {"cf": "Corsi For", "ca": "Corsi Against", "ff": "Fenwick For", "fa": "Fenwick Against"}
    long = rows.unpivot(list(ids), list(labels), "counter", "count")
    return long.withColumns(
        {
            "event": S.lookup(F.col("counter"), labels),
            "kind": F.when(F.col("counter").isin("cf", "ca"), "Corsi").otherwise("Fenwick"),
        }
    ).drop("counter")


def share_histograms(season: DataFrame, width: float = 2.0) -> DataFrame:
    """Histograms of both shares, labelled by measure."""
    long = season.unpivot(["player_id"], ["cf_pct", "ff_pct"], "measure", "share")
    return histogram(long, "share", width, keys=["measure"])


def share_summary(season: DataFrame, **limits) -> DataFrame:
    """Mean, median and deviation of both shares."""
    long = season.unpivot(["player_id"], ["cf_pct", "ff_pct"], "measure", "share")
    return spread(long, ["measure"], "share", **limits)
