"""Runs of consecutive games that satisfy a predicate, and how rare they are.

All predicates share one ordered pass. With ``idx`` the position of a game in
its group and ``brk`` the position of the latest game that fails a predicate,
the run ending at a game is ``idx - brk`` games long. Both are running
aggregates, so one sort serves any number of predicates and no row is emitted
per predicate before it is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions import scalars as S
from streakline.operators.ordered import OrderedGroups, last_rows, month_of, order_groups


@dataclass(frozen=True)
class StreakType:
    predicate: str
    sign: str
    description: str
    label: str

    def holds(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))


# --- fixed values: predicates, signs and wording -------------------------------

STREAK_TYPES: dict[str, StreakType] = {
    "point_streak": StreakType(
        "points >= 1", "positive", "Consecutive games with 1+ points", "Point Streak (1+ pts)"
    ),
    "goal_streak": StreakType(
        "goals >= 1", "positive", "Consecutive games with 1+ goals", "Goal Streak (1+ G)"
    ),
    "multi_point": StreakType(
        "points >= 2", "positive", "Consecutive games with 2+ points", "Multi-Point (2+ pts)"
    ),
    "hat_trick": StreakType("goals >= 3", "positive", "Games with 3+ goals", "Hat Trick (3+ G)"),
    "takeaway_streak": StreakType(
        "takeaways >= 1", "positive", "Consecutive games with 1+ takeaways", "Takeaway Streak (1+ TK)"
    ),
    "scoreless_drought": StreakType(
        "goals = 0", "negative", "Consecutive games with 0 goals", "Scoreless Drought (0 G)"
    ),
    "pointless_drought": StreakType(
        "points = 0", "negative", "Consecutive games with 0 points", "Pointless Drought (0 pts)"
    ),
    "shot_drought": StreakType(
        "shots <= 1", "negative", "Consecutive games with 1 or fewer shots", "Shot Drought (<=1 SOG)"
    ),
    "minus_streak": StreakType(
        "plus_minus < 0", "negative", "Consecutive games with negative plus/minus", "Minus Streak (-/-)"
    ),
}

PLAYER_SEASON = ("player_id", "season")
TEAM_PLAYER_SEASON = ("team_abbr", "player_id", "season")
GAME_ORDER = ("game_date", "game_id")


def default_predicates() -> dict[str, Column]:
    return {name: t.holds() for name, t in STREAK_TYPES.items()}


def describe(df: DataFrame, types: Mapping[str, StreakType] = STREAK_TYPES) -> DataFrame:
    """Add sign, description and label of ``streak_type`` from the small fixed table."""

    def mapped(field: str) -> Column:
        pairs = [F.lit(x) for name, t in types.items() for x in (name, getattr(t, field))]
        return F.try_element_at(F.create_map(*pairs), F.col("streak_type"))

    return df.withColumns(
        {
            "sign": mapped("sign"),
            "description": mapped("description"),
            "label": F.coalesce(mapped("label"), F.col("streak_type")),
        }
    )


def _break(name: str) -> str:
    return f"_brk_{name}"


def _run_positions(
    logs: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    predicates: Mapping[str, Column],
    chunk: Column | None,
    last: str | None = None,
) -> OrderedGroups:
    """``_idx`` and the break positions; without a chunk the first order column is a date and its month is taken.

    Other columns of ``logs`` than key, order and predicates cost a read of their own.
    """
    groups = order_groups(logs, keys, order, month_of(order[0]) if chunk is None else chunk)
    totals = {} if last is None else {"_games": F.lit(1)}
    return groups.running(totals=totals, index="_idx", marks={_break(n): ~p for n, p in predicates.items()}, last=last)


def run_lengths(
    logs: DataFrame,
    keys: Sequence[str] = PLAYER_SEASON,
    order: Sequence[str] = GAME_ORDER,
    predicates: Mapping[str, Column] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Every row with ``run_<type>``: how many games the run ending here has (0: none).

    Together with the order columns this tells which games belong to a run.
    """
    predicates = default_predicates() if predicates is None else predicates
    found = _run_positions(logs, keys, order, predicates, chunk).rows()
    return found.withColumns(
        {f"run_{n}": F.col("_idx") - F.coalesce(_break(n), F.lit(0)) for n in predicates}
    ).drop("_idx", *[_break(n) for n in predicates])


def streak_islands(
    logs: DataFrame,
    keys: Sequence[str] = PLAYER_SEASON,
    order: Sequence[str] = GAME_ORDER,
    predicates: Mapping[str, Column] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """One row per maximal run: keys, streak_type, island, length, start and end date.

    ``island`` is the position after which the run starts. The first order
    column gives the dates.
    """
    predicates = default_predicates() if predicates is None else predicates
    date = order[0]
    placed = _run_positions(
        logs.select(*keys, *order, *[p.alias(f"_hit_{n}") for n, p in predicates.items()]),
        keys,
        order,
        {n: F.col(f"_hit_{n}") for n in predicates},
        chunk,
    ).rows()
    pairs = ", ".join(f"'{n}', coalesce({_break(n)}, 0)" for n in predicates)
    long = placed.selectExpr(
        *keys, date, "_idx", f"stack({len(predicates)}, {pairs}) as (streak_type, island)"
    ).where(F.col("island") < F.col("_idx"))
    return long.groupBy(*keys, "streak_type", "island").agg(
        F.count("*").alias("length"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
    )


def longest_runs_wide(
    logs: DataFrame,
    keys: Sequence[str] = PLAYER_SEASON,
    order: Sequence[str] = GAME_ORDER,
    predicates: Mapping[str, Column] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """One row per key with the longest run of each type, 0 where there is none."""
    predicates = default_predicates() if predicates is None else predicates
    hits = logs.select(*keys, *order, *[p.alias(f"_hit_{n}") for n, p in predicates.items()])
    placed = _run_positions(
        hits, keys, order, {n: F.col(f"_hit_{n}") for n in predicates}, chunk
    ).rows()
    return placed.groupBy(*keys).agg(
        *[F.max(F.col("_idx") - F.coalesce(_break(n), F.lit(0))).alias(n) for n in predicates]
    )


def longest_runs(logs: DataFrame, keys: Sequence[str] = PLAYER_SEASON, **options) -> DataFrame:
    """Long form of :func:`longest_runs_wide`: keys, streak_type, max_len."""
    wide = longest_runs_wide(logs, keys, **options)
    types = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), types, "streak_type", "max_len")


def of_skaters(runs: DataFrame, players: DataFrame) -> DataFrame:
    """Keep known non-goalies and add their position group.

    Joined after the aggregate: one row per player-season instead of per game.
    """
    known = players.where(S.is_skater("position")).select(
        "player_id", S.position_group("position").alias("pg")
    )
    return runs.join(known, "player_id")


def with_all_group(counts: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Re-aggregate counts so that group ALL stands next to F and D."""
    spread = counts.withColumn("pg", F.explode(F.array_distinct(F.array("pg", F.lit("ALL")))))
    return spread.groupBy("pg", *keys).agg(F.sum(count).alias(count))


def tail_steps(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """P(longest run >= n) per group and type as a step function: ``p`` for all n from ``from_n`` to ``to_n``.

    ``runs`` has pg, streak_type and max_len, plus the ``by`` columns. It is
    reduced to a histogram first, and every observed length is one step. A
    histogram over N rows of run lengths has at most sqrt(2N) distinct lengths,
    so the window over it stays small whatever the skew and however long a run.
    """
    keys = [*by, "streak_type"]
    counted = runs.groupBy("pg", *keys, "max_len").agg(F.count("*").alias("cnt"))
    hist = with_all_group(counted, [*keys, "max_len"], "cnt")

    group = Window.partitionBy("pg", *keys)
    ordered = group.orderBy("max_len")
    below = F.coalesce(
        F.sum("cnt").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    steps = hist.select(
        "pg",
        *keys,
        (F.coalesce(F.lag("max_len").over(ordered), F.lit(0)) + 1).alias("from_n"),
        F.col("max_len").alias("to_n"),
        ((F.sum("cnt").over(group) - below) / F.sum("cnt").over(group)).alias("p"),
    )
    return steps.where(F.col("to_n") >= 1)


#: Lengths that one row may be spread to at once.
SPREAD = 4_096


def step_points(steps: DataFrame, upto: int | None = None) -> DataFrame:
    """One row per length of each step, ``n`` in place of ``from_n`` and ``to_n``; none beyond ``upto``.

    A long step is spread in two stages, so that no row holds all its lengths.
    """
    end = F.col("to_n") if upto is None else F.least("to_n", F.lit(upto))
    rest = [c for c in steps.columns if c not in ("from_n", "to_n", "p")]
    cut = steps.withColumn("_end", end).where(F.col("from_n") <= F.col("_end"))
    parts = cut.select(*rest, "p", "_end", F.explode(F.sequence("from_n", "_end", F.lit(SPREAD).cast("long"))).alias("_from"))
    stop = F.least(F.col("_end"), F.col("_from") + SPREAD - 1)
    return parts.select(*rest, F.explode(F.sequence("_from", stop)).alias("n"), "p")


def as_steps(curves: DataFrame) -> DataFrame:
    """Curves given by length as steps of one length each; steps as they are."""
    if "n" not in curves.columns:
        return curves
    length = F.col("n").cast("long")
    return curves.select(*[c for c in curves.columns if c not in ("n", "p")], length.alias("from_n"), length.alias("to_n"), "p")


def _band(n: Column) -> Column:
    """A number that never falls while ``n`` rises and stands for at most a sixteenth of its size; one length each below 32."""
    shift = F.greatest(F.length(F.bin(n)) - 5, F.lit(0))
    return shift * 32 + F.floor(n / F.pow(F.lit(2.0), shift)).cast("int")


def look_up_steps(rows: DataFrame, steps: DataFrame, keys: Sequence[str], length: str, name: str) -> DataFrame:
    """``rows`` with the value of their curve at ``length`` as ``name``, NULL beyond the curve's end.

    An equi-join by bands of lengths: a step lies in all bands that it touches,
    a few hundred at most. So the join is split or broadcast as any other, and
    the few steps of one band are told apart by their ends.
    """
    first, last = _band(F.col("from_n")), _band(F.col("to_n"))
    posted = steps.select(*keys, F.col("from_n").alias("_from"), F.col("to_n").alias("_to"), F.col("p").alias(name), F.explode(F.sequence(first, last)).alias("_band"))
    banded = rows.withColumn("_band", _band(F.col(length)))
    same = [banded[c] == posted[c] for c in (*keys, "_band")]
    inside = (posted["_from"] <= banded[length]) & (banded[length] <= posted["_to"])
    found = banded.join(posted, reduce(and_, [*same, inside]), "left")
    return found.select(*[banded[c] for c in rows.columns], posted[name])


def tail_distribution(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """P(longest run >= n) for n = 1 .. longest observed, per group and type, one row each."""
    return step_points(tail_steps(runs, by)).select("pg", *by, "streak_type", "n", "p")


def career_best(runs: DataFrame) -> DataFrame:
    """Longest run over all seasons per player and type; absent when there is none."""
    return (
        runs.groupBy("player_id", "streak_type")
        .agg(F.max("max_len").alias("career_max"))
        .where(F.col("career_max") > 0)
    )


@dataclass(frozen=True)
class Baselines:
    """Reference distributions: league, team and player level, plus the counts behind them.

    ``league`` and ``team`` have one row per length or one per step.
    """

    league: DataFrame
    team: DataFrame
    player: DataFrame
    meta: DataFrame

    def steps(self, level: str) -> DataFrame:
        return as_steps(getattr(self, level))

    def points(self, level: str, upto: int | None = None) -> DataFrame:
        return step_points(self.steps(level), upto)

    def stepwise(self) -> Baselines:
        """The same with one row per step."""
        return replace(self, league=self.steps("league"), team=self.steps("team"))


def player_season_counts(wide: DataFrame) -> DataFrame:
    """Player-seasons per position group and in total; ``wide`` has one row each."""
    counted = wide.groupBy("pg").agg(F.count("*").alias("player_seasons"))
    return with_all_group(counted, [], "player_seasons")


def compute_baselines(
    logs: DataFrame, players: DataFrame, chunk: Column | None = None, stepwise: bool = False
) -> Baselines:
    """All baselines; league, player and counts come from the same per-season runs.

    ``stepwise`` leaves the curves as steps, which is what lookups and comparisons need.
    """
    wide = of_skaters(longest_runs_wide(logs, PLAYER_SEASON, chunk=chunk), players)
    ids = ["player_id", "season", "pg"]
    runs = wide.unpivot(ids, list(STREAK_TYPES), "streak_type", "max_len")
    team_runs = of_skaters(
        longest_runs(logs, TEAM_PLAYER_SEASON, chunk=chunk), players
    ).withColumnRenamed("team_abbr", "team")
    curve = tail_steps if stepwise else tail_distribution
    return Baselines(
        league=curve(runs),
        team=curve(team_runs, by=["team"]),
        player=career_best(runs),
        meta=player_season_counts(wide),
    )


def last_games(
    logs: DataFrame,
    n: int = 20,
    keys: Sequence[str] = ("player_id",),
    order: Sequence[str] = GAME_ORDER,
) -> DataFrame:
    """The last ``n`` games per key with ``rn`` = 1 for the latest."""
    return last_rows(logs, keys, [F.col(c).desc() for c in order], n, "rn")


def active_streaks(
    logs: DataFrame,
    keys: Sequence[str] = ("player_id",),
    min_length: int = 2,
    recent: int = 40,
    order: Sequence[str] = GAME_ORDER,
    predicates: Mapping[str, Column] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Runs that reach the latest game, at least ``min_length`` long, however long they are.

    ``recent`` bounds only the ``recent_games`` array: the latest member games,
    oldest first.
    """
    predicates = default_predicates() if predicates is None else predicates
    date, tie = order[0], order[-1]
    hits = logs.select(*keys, *order, *[p.alias(f"_hit_{n}") for n, p in predicates.items()])
    placed = _run_positions(hits, keys, order, {n: F.col(f"_hit_{n}") for n in predicates}, chunk, last="_last").rows()
    # a game belongs to the active run of a type if no later game of the whole key breaks it
    pairs = ", ".join(f"'{n}', coalesce(`{_break(n)}`, 0), coalesce(`{_break(n)}_last`, 0)" for n in predicates)
    members = placed.selectExpr(
        *keys, *dict.fromkeys((date, tie)), "_idx", "_games", f"stack({len(predicates)}, {pairs}) as (streak_type, _own, _stop)"
    ).where((F.col("_own") == F.col("_stop")) & (F.col("_stop") < F.col("_idx")) & (F.col("_games") - F.col("_stop") >= min_length))
    game = F.struct("_idx", F.col(tie).alias(tie), F.col(date).alias(date))
    active = members.groupBy(*keys, "streak_type").agg(
        F.count("*").alias("length"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.array_sort(F.collect_list(F.when(F.col("_games") - F.col("_idx") < recent, game))).alias("_shown"),
    )
    return active.select(
        *keys,
        "streak_type",
        "length",
        "start_date",
        "end_date",
        F.transform("_shown", lambda g: F.struct(g[tie].alias(tie), g[date].alias(date))).alias("recent_games"),
    )
