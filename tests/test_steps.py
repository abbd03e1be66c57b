"""Step curves, lookups in them, comparisons, and how often plans read their input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from streakline.operators import possession, rarity, streaks
from streakline.operators.ordered import block_of, order_groups
from streakline.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
RUNS = "pg string, streak_type string, team string, max_len long"
STEPS = "pg string, streak_type string, from_n long, to_n long, p double"


def tail(lengths, n):
    return sum(x >= n for x in lengths) / len(lengths)


def test_a_very_long_run_is_few_steps(spark):
    lengths = [3_000_000, 2, 2, 0]
    runs = spark.createDataFrame([("F", "t", "x", n) for n in lengths], RUNS)
    steps = streaks.tail_steps(runs).where("pg = 'F'").orderBy("to_n").collect()
    assert [(r.from_n, r.to_n, r.p) for r in steps] == [(1, 2, 0.75), (3, 3_000_000, 0.25)]
    points = streaks.tail_distribution(runs).where("pg = 'F'")
    found = points.agg(F.count("*").alias("n"), F.count_distinct("n").alias("d"), F.max("n").alias("m"), F.sum("p").alias("s")).first()
    assert (found.n, found.d, found.m) == (3_000_000, 3_000_000, 3_000_000) and found.s == pytest.approx(1.5 + 0.25 * 2_999_998)
    assert streaks.step_points(streaks.tail_steps(runs), 3).where("pg = 'F'").count() == 3
    assert streaks.tail_steps(runs.limit(0)).count() == 0


def test_bands_never_fall_and_are_narrow(spark):
    rows = spark.range(1, 70_000).select("id", streaks._band(F.col("id")).alias("band")).orderBy("id").collect()
    bands = [r.band for r in rows]
    assert bands == sorted(bands) and bands[:31] == list(range(1, 32))
    widths = {}
    for r in rows:
        widths.setdefault(r.band, []).append(r.id)
    assert all(len(ids) <= max(1, ids[0] // 16) for ids in widths.values())


def test_lookups_match_the_definition(spark):
    rng = random.Random(3)
    lengths = {k: [rng.choice([0, 1, 2, 3, rng.randrange(5_000), rng.randrange(2_000_000)]) for _ in range(60)] for k in ("F", "D")}
    runs = spark.createDataFrame([(k, "t", "x", n) for k, ns in lengths.items() for n in ns], RUNS)
    steps = streaks.tail_steps(runs)
    asked = [(k, "t", rng.choice([1, 2, 31, 32, 33, rng.randrange(1, 3_000_000), max(lengths["F"]), max(lengths["F"]) + 1])) for k in ("F", "D", "Q") for _ in range(60)]
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(asked)], "i int, pg string, streak_type string, length long")
    got = {r.i: r.v for r in streaks.look_up_steps(rows, steps, ["pg", "streak_type"], "length", "v").collect()}
    assert len(got) == len(asked)
    for i, (k, _, n) in enumerate(asked):
        known = k in lengths and n <= max(lengths[k])
        assert got[i] == (pytest.approx(tail(lengths[k], n)) if known else None)
    points = streaks.step_points(steps).where("n < 100")
    assert streaks.look_up_steps(rows.where("length < 100"), streaks.as_steps(points), ["pg", "streak_type"], "length", "v").where("v is null and pg <> 'Q'").count() == 0


def test_compared_steps_are_the_curves(spark):
    rng = random.Random(9)
    runs = spark.createDataFrame([("F", t, team, rng.choice([0, 1, 4, 9, rng.randrange(40)])) for t in "st" for team in "xyz" for _ in range(12)], RUNS)
    b = streaks.Baselines(streaks.tail_steps(runs), streaks.tail_steps(runs, by=["team"]), None, None)
    league = {(r.streak_type, r.n): r.p for r in b.points("league").where("pg = 'ALL'").collect()}
    team = {(r.team, r.streak_type, r.n): r.p for r in b.points("team").where("pg = 'ALL'").collect()}
    rows = rarity.compare_steps(b).collect()
    assert len(rows) < len({(t, *k) for t in "xyz" for k in league})
    covered = set()
    for r in rows:
        for n in range(r.from_n, r.to_n + 1):
            covered.add((r.team, r.streak_type, n))
            assert r.league_p == league.get((r.streak_type, n), 0.0) and r.team_p == team.get((r.team, r.streak_type, n), 0.0)
    assert covered == {(t, *k) for t in "xyz" for k in league} | set(team)
    assert {r.team for r in rarity.compare_steps(b, teams=["y"]).collect()} == {"y"}
    assert rarity.compare_curves(b).count() == len(covered)
    assert rarity.team_overview(b, teams=None).select("team").distinct().count() == 3
    assert rarity.baseline_overview(b, short=None).count() == b.points("league").count()


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def counts(plan):
    exchanges = re.findall(r"(?<!Broadcast)Exchange (?:hash|single|range)", plan)
    return plan.count("FileScan"), len(exchanges)


@pytest.mark.parametrize("name,scans,shuffles", [("streak_islands", 1, 5), ("active_streaks", 1, 5), ("streak_max", 1, 5)])
def test_runs_read_their_log_once(spark, name, scans, shuffles):
    found = counts(final_plan(QUERIES[name](spark, SF_DIR)))
    assert found[0] == scans and found[1] <= shuffles


def test_possession_reads_one_timeline(spark):
    found = counts(final_plan(QUERIES["on_ice_events"](spark, SF_DIR)))
    assert found[0] <= 4 and found[1] <= 10


@pytest.mark.parametrize("width", [1, 7, 10**6])
def test_marks_match_brute_force(spark, width):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "k", None]), rng.randrange(30), i, rng.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, i int, hit boolean")
    groups = order_groups(df, ["k"], ["t", "i"], block_of("t", width))
    out = groups.running(index="at", marks={"m": F.col("hit")}, last="_last", totals={"n": F.lit(1)}).rows()
    assert set(out.columns) == {"k", "t", "i", "hit", "at", "m", "m_last", "n"}
    got = {r.i: (r["at"], r.m, r.m_last, r.n) for r in out.collect()}
    for key in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        hits = [at for at, r in enumerate(members, 1) if r[3]]
        for at, r in enumerate(members, 1):
            before = [h for h in hits if h <= at]
            assert got[r[2]] == (at, before[-1] if before else None, hits[-1] if hits else None, len(members))


def test_shots_of_a_shooter_with_shifts_of_both_teams(spark):
    shifts = spark.createDataFrame(
        [(1, 1, 1, 5, "P", "A", 0, 50, 50), (1, 2, 1, 5, "P", "B", 10, 90, 80), (1, 3, 1, 6, "Q", "B", 0, 100, 100)],
        "game_id long, shift_id long, period int, player_id long, player_name string, team_abbr string, start_sec int, end_sec int, duration_sec int",
    )
    events = spark.createDataFrame(
        [(1, 11, 1, "goal", "1551", 20, 5), (1, 12, 1, "goal", "1551", 70, 5), (1, 13, 1, "goal", "1551", 95, 5)],
        "game_id long, event_id long, period int, type_desc_key string, situation_code string, t int, shooter_id long",
    )
    rows = {r.event_id: (r.shooter_team, r.n_for, r.n_against) for r in possession.on_ice_counts(events, shifts).collect()}
    assert rows == {11: ("A", 1, 2), 12: ("B", 2, 0)}
