"""Interval credit: fixture game, bounds, brute force and the chunked way."""

import random

import pytest
from pyspark.sql import functions as F

from streakline.operators import possession as P

SHIFT = (
    "game_id bigint, shift_id bigint, period int, player_id bigint, player_name string,"
    " team_abbr string, start_time string, end_time string, duration string"
)
EVENT = (
    "game_id bigint, event_id bigint, period int, type_desc_key string, situation_code string,"
    " time_in_period string, shooting_player_id bigint, scoring_player_id bigint"
)


def clock(seconds):
    return f"{seconds // 60}:{seconds % 60:02d}"


def shift(game, sid, player, team, start=0, end=1200, period=1):
    return (game, sid, period, player, f"P{player}", team, clock(start), clock(end), clock(end - start))


def event(game, eid, kind, t, shooter=None, scorer=None, period=1, state="1551"):
    return (game, eid, period, kind, state, clock(t), shooter, scorer)


def simple_game():
    shifts = [shift(1, i, 100 + i, "FLA") for i in range(5)]
    shifts += [shift(1, 10 + i, 200 + i, "CHI") for i in range(5)]
    events = [
        event(1, 1, "shot-on-goal", 600, 100),
        event(1, 2, "shot-on-goal", 605, 200),
        event(1, 3, "blocked-shot", 610, 101),
        event(1, 4, "goal", 660, 201),
        event(1, 5, "faceoff", 700),
        event(1, 6, "hit", 710),
    ]
    return shifts, events


def frames(spark, shifts, events):
    return (
        P.timed_events(spark.createDataFrame(events, EVENT)),
        P.timed_shifts(spark.createDataFrame(shifts, SHIFT)),
    )


@pytest.mark.parametrize("limit", [10**6, 7])
def test_simple_game(spark, limit):
    e, s = frames(spark, *simple_game())
    rows = P.game_possession(e, s, chunk_sec=limit).collect()
    assert len(rows) == 10
    for r in rows:
        expected = (2, 2, 50.0, 1, 2, 33.3) if r.team == "FLA" else (2, 2, 50.0, 2, 1, 66.7)
        assert (r.cf, r.ca, r.cf_pct, r.ff, r.fa, r.ff_pct) == expected
        assert r.toi_seconds == 1200
    counts = P.on_ice_counts(e, s, chunk_sec=limit).collect()
    assert {(r.event_id, r.n_for, r.n_against) for r in counts} == {(i, 5, 5) for i in (1, 2, 3, 4)}


def test_goal_with_scorer_only(spark):
    shifts, events = simple_game()
    events[3] = event(1, 4, "goal", 660, None, 201)
    e, s = frames(spark, shifts, events)
    assert {r.cf for r in P.game_possession(e, s).where("team = 'CHI'").collect()} == {2}


@pytest.mark.parametrize("second,on", [(59, False), (60, True), (90, True), (120, True), (121, False)])
def test_closed_bounds(spark, second, on):
    shifts = [shift(1, 1, 100, "A", 60, 120), shift(1, 2, 200, "B")]
    e, s = frames(spark, shifts, [event(1, 1, "goal", second, 100), event(1, 2, "goal", 10, 200)])
    at = {r.player_id for r in P.on_ice_at(s, 1, second).collect()}
    assert at == ({100, 200} if on else {200})
    row = P.game_possession(e, s).where("player_id = 200").first()
    assert (row.cf, row.ca) == (1, 1 if on else 0)


def test_wrong_period(spark):
    shifts = [shift(1, 1, 100, "A"), shift(1, 2, 200, "B")]
    e, s = frames(spark, shifts, [event(1, 1, "goal", 10, 100, period=2)])
    assert {(r.cf, r.ca) for r in P.game_possession(e, s).collect()} == {(0, 0)}


def test_overlapping_shifts_count_once(spark):
    shifts = [shift(1, 1, 100, "A", 0, 50), shift(1, 2, 100, "A", 10, 30), shift(1, 3, 100, "A", 50, 80)]
    shifts += [shift(1, 4, 200, "B")]
    events = [event(1, i, "shot-on-goal", t, 100) for i, t in enumerate((20, 50, 80))]
    e, s = frames(spark, shifts, events)
    rows = {r.player_id: r for r in P.game_possession(e, s).collect()}
    assert rows[100].cf == 3 and rows[200].ca == 3
    assert rows[100].toi_seconds == 50 + 20 + 30


@pytest.mark.parametrize(
    "shifts,events",
    [
        ([shift(1, 1, 100, "A")], [event(1, 1, "goal", 1, 100)]),
        ([], [event(1, 1, "goal", 1, 100)]),
        ([shift(1, 1, 100, "A"), shift(1, 2, 200, "B")], [event(1, 1, "goal", 1, 100, state="1541")]),
    ],
)
def test_games_that_do_not_qualify(spark, shifts, events):
    e, s = frames(spark, shifts, events)
    assert P.game_possession(e, s).count() == 0


def brute(shifts, events):
    """The definition, pair by pair."""
    credit = {}
    teams = {}
    for sh in sorted(shifts, key=lambda r: r[1]):
        teams.setdefault(sh[0], [])
        if sh[5] not in teams[sh[0]]:
            teams[sh[0]].append(sh[5])

    def sec(text):
        m, s = text.split(":")
        return int(m) * 60 + int(s)

    for g, _, period, kind, state, at, shooter, scorer in events:
        who = shooter or scorer
        if state != "1551" or kind not in ("goal", "shot-on-goal", "missed-shot", "blocked-shot") or who is None:
            continue
        t = sec(at)
        on = {(s[5], s[3]) for s in shifts if s[0] == g and s[2] == period and sec(s[6]) <= t <= sec(s[7])}
        own = sorted(team for team, p in on if p == who)
        if not own or len(teams[g]) < 2:
            continue
        other = [x for x in teams[g][:2] if x != own[0]][0]
        for team, p in on:
            c = credit.setdefault((g, p), [0, 0, 0, 0])
            if team == own[0]:
                c[0] += 1
                c[2] += kind != "blocked-shot"
            elif team == other:
                c[1] += 1
                c[3] += kind != "blocked-shot"
    return credit


def random_game(seed=7):
    """Game 1 holds most rows, one second of it a large share of the shots."""
    rnd = random.Random(seed)
    shifts, events = [], []
    for i in range(260):
        g = 1 if i < 200 else rnd.randrange(2, 4)
        p = rnd.randrange(12)
        start = rnd.randrange(0, 300)
        team = "AB"[p % 2] if p < 11 else rnd.choice("AB")
        shifts.append(shift(g, i, 100 + p, team, start, start + rnd.randrange(0, 60), rnd.randrange(1, 3)))
    kinds = ["goal", "shot-on-goal", "missed-shot", "blocked-shot", "faceoff"]
    for i in range(300):
        g = 1 if i < 220 else rnd.randrange(2, 4)
        t = 150 if i % 3 == 0 else rnd.randrange(0, 330)
        events.append(
            event(g, 1000 + i, rnd.choice(kinds), t, 100 + rnd.randrange(12), None, rnd.randrange(1, 3),
                  rnd.choice(["1551", "1551", "1541"]))
        )
    return shifts, events


@pytest.mark.parametrize("limit", [10**6, 30])
def test_matches_pairwise_definition(spark, limit):
    shifts, events = random_game()
    e, s = frames(spark, shifts, events)
    got = P.game_possession(e, s, chunk_sec=limit).collect()
    assert {(r.game_id, r.player_id): [r.cf, r.ca, r.ff, r.fa] for r in got if r.cf + r.ca} == brute(shifts, events)
    assert all(r.ff <= r.cf and r.fa <= r.ca for r in got)
    assert sum(r.toi_seconds for r in got) == s.agg(F.sum("duration_sec")).first()[0]


def test_plan_has_no_pairwise_join(spark):
    e, s = frames(spark, *simple_game())
    plan = P.game_possession(e, s)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_season_team_and_drill_down(spark):
    shifts, events = random_game()
    e, s = frames(spark, shifts, events)
    per_game = P.game_possession(e, s)
    season = P.season_possession(per_game)
    total = per_game.agg(F.sum("cf"), F.count("*")).first()
    assert season.agg(F.sum("cf"), F.sum("gp")).first() == total
    assert season.where("cf_pct < 0 or cf_pct > 100").count() == 0
    teams = P.team_possession(season)
    assert teams.agg(F.sum("cf")).first()[0] == total[0]
    long = P.drill_down(season, ["player_id"])
    assert long.count() == season.count() * 4
    assert long.where("event = 'Corsi For'").agg(F.sum("count")).first()[0] == total[0]
    assert P.season_possession(per_game, min_games=3).where("gp < 3").count() == 0


def test_season_filter_uses_the_game_dimension(spark):
    shifts, events = random_game()
    games = spark.createDataFrame([(1, "S1", 2), (2, "S2", 2), (3, "S2", 3)], "game_id bigint, season string, game_type int")
    raw_e, raw_s = spark.createDataFrame(events, EVENT), spark.createDataFrame(shifts, SHIFT)
    one = P.player_possession(raw_e, raw_s, games, season="S1")
    assert one.agg(F.max("gp")).first()[0] == 1
    typed = P.player_possession(raw_e, raw_s, games, season="S2", game_types=[3])
    assert typed.agg(F.max("gp")).first()[0] == 1
