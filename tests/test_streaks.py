"""Runs, tail distributions, rarity and severity."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from streakline.operators import rarity, streaks
from streakline.operators.streaks import Baselines

LOG = (
    "game_id bigint, player_id bigint, season string, game_date date, team_abbr string,"
    " goals int, points int, shots int, takeaways int, plus_minus int, game_type int"
)


def game_rows(points, player=1, season="20252026", team="EDM", start=1000, dates=None):
    day = datetime.date(2026, 1, 1)
    dates = dates or [day + datetime.timedelta(days=i) for i in range(len(points))]
    return [
        (start + i, player, season, dates[i], team, 0, p, 2, 1, 0, 2) for i, p in enumerate(points)
    ]


def logs_of(spark, points, **kw):
    return spark.createDataFrame(game_rows(points, **kw), LOG)


CHUNKS = [None, "weekofyear(game_date) * 0", "game_date"]
JAN = [datetime.date(2026, 1, d) for d in (1, 3, 10)]
CASES = {
    "empty": ([], []),
    "single": ([1], [1]),
    "consecutive": ([1] * 5, [5]),
    "broken": ([1, 1, 1, 0, 1, 1], [3, 2]),
    "none match": ([0] * 5, []),
    "at end": ([0, 1, 1, 1, 1], [4]),
    "alternating": ([1, 0, 1, 0, 1], [1, 1, 1]),
}


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("name", CASES)
def test_point_streaks(spark, name, chunk):
    points, lengths = CASES[name]
    found = (
        streaks.streak_islands(logs_of(spark, points), chunk=chunk and F.expr(chunk))
        .where("streak_type = 'point_streak'")
        .orderBy("start_date")
    )
    assert [r.length for r in found.collect()] == lengths


def test_date_gaps_do_not_break_a_streak(spark):
    found = streaks.streak_islands(logs_of(spark, [1, 1, 1], dates=JAN)).where("streak_type = 'point_streak'")
    row = found.first()
    assert (row.length, row.start_date, row.end_date) == (3, JAN[0], JAN[2])


def random_logs(spark, seed=1):
    rnd = random.Random(seed)
    rows, game = [], 0
    for player in range(6):
        for season in ("20232024", "20242025"):
            n = 160 if player == 0 else rnd.randrange(5, 30)
            for i in range(n):
                game += 1
                goals = rnd.choice([0, 0, 0, 1, 2, 3])
                date = datetime.date(2023, 10, 1) + datetime.timedelta(days=i)
                rows.append(
                    (game, player, season, date, rnd.choice(["A", "B"]), goals, goals + rnd.randrange(2),
                     rnd.randrange(4), rnd.randrange(2), rnd.randrange(-1, 2), 2)
                )
    return spark.createDataFrame(rows, LOG), rows


def players_of(spark):
    positions = ["C", "D", "G", "R", None, "X"]
    rows = [(i, "F", f"L{i}", p) for i, p in enumerate(positions)]
    return spark.createDataFrame(rows, "player_id bigint, first_name string, last_name string, position string")


def brute_longest(rows, keys):
    tests = {
        "point_streak": lambda r: r[6] >= 1,
        "goal_streak": lambda r: r[5] >= 1,
        "multi_point": lambda r: r[6] >= 2,
        "hat_trick": lambda r: r[5] >= 3,
        "takeaway_streak": lambda r: r[8] >= 1,
        "scoreless_drought": lambda r: r[5] == 0,
        "pointless_drought": lambda r: r[6] == 0,
        "shot_drought": lambda r: r[7] <= 1,
        "minus_streak": lambda r: r[9] < 0,
    }
    groups = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    longest, total = {}, {}
    for key, games in groups.items():
        for name, test in tests.items():
            run = best = hits = 0
            for g in games:
                run = run + 1 if test(g) else 0
                hits += test(g)
                best = max(best, run)
            longest[(*key, name)], total[(*key, name)] = best, hits
    return longest, total


@pytest.mark.parametrize("chunk", CHUNKS)
def test_longest_runs_and_islands_match_brute_force(spark, chunk):
    logs, rows = random_logs(spark)
    longest, total = brute_longest(rows, (1, 2))
    got = streaks.longest_runs(logs, chunk=chunk and F.expr(chunk)).collect()
    assert {(r.player_id, r.season, r.streak_type): r.max_len for r in got} == longest
    islands = streaks.streak_islands(logs, chunk=chunk and F.expr(chunk))
    sums = islands.groupBy("player_id", "season", "streak_type").agg(F.sum("length").alias("n")).collect()
    assert {(r.player_id, r.season, r.streak_type): r.n for r in sums} == {k: v for k, v in total.items() if v}
    at_game = streaks.run_lengths(logs, chunk=chunk and F.expr(chunk))
    assert at_game.count() == len(rows)
    best = at_game.groupBy("player_id", "season").agg(F.max("run_point_streak").alias("n")).collect()
    assert all(longest[(r.player_id, r.season, "point_streak")] == r.n for r in best)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_tail_distributions(spark, chunk):
    logs, rows = random_logs(spark)
    b = streaks.compute_baselines(logs, players_of(spark), chunk and F.expr(chunk))
    longest, _ = brute_longest(rows, (1, 2))
    groups = {0: "F", 1: "D", 3: "F", 5: "ALL"}  # 2 is a goalie, 4 has no position
    league = {(r.pg, r.streak_type, r.n): r.p for r in b.league.collect()}
    expected = {}
    for pg in ("F", "D", "ALL"):
        for name in streaks.STREAK_TYPES:
            lens = [
                v for (p, _, t), v in longest.items()
                if t == name and p in groups and pg in (groups[p], "ALL")
            ]
            for n in range(1, max(lens) + 1):
                expected[(pg, name, n)] = sum(v >= n for v in lens) / len(lens)
    assert league == pytest.approx(expected)
    for (pg, name, n), p in league.items():
        assert p <= league.get((pg, name, n - 1), 1.0)
    career = {(r.player_id, r.streak_type): r.career_max for r in b.player.collect()}
    assert all(v > 0 for v in career.values()) and not any(p in (2, 4) for p, _ in career)
    assert {r.pg: r.player_seasons for r in b.meta.collect()} == {"F": 4, "D": 2, "ALL": 8}


def test_traded_player_splits_team_streaks(spark):
    rows = game_rows([1, 1, 1], team="EDM") + game_rows([1, 1], team="TOR", start=2000,
        dates=[datetime.date(2026, 2, 1), datetime.date(2026, 2, 2)])
    logs = spark.createDataFrame(rows, LOG)
    per_team = streaks.longest_runs(logs, streaks.TEAM_PLAYER_SEASON).where("streak_type = 'point_streak'")
    assert {r.team_abbr: r.max_len for r in per_team.collect()} == {"EDM": 3, "TOR": 2}
    overall = streaks.longest_runs(logs).where("streak_type = 'point_streak'").first()
    assert overall.max_len == 5


@pytest.mark.parametrize(
    "points,min_length,expected",
    [([0, 1, 1, 1], 2, 3), ([0, 1, 1], 3, None), ([1, 1], 2, 2), ([1, 1, 0], 2, None), ([1], 2, None)],
)
def test_active_streaks(spark, points, min_length, expected):
    found = streaks.active_streaks(logs_of(spark, points), min_length=min_length)
    rows = found.where("streak_type = 'point_streak'").collect()
    assert [r.length for r in rows] == ([] if expected is None else [expected])
    for r in rows:
        assert len(r.recent_games) == r.length
        assert r.recent_games[0].game_date == r.start_date and r.recent_games[-1].game_date == r.end_date


def test_a_long_active_streak_is_not_cut(spark):
    logs = logs_of(spark, [0] + [1] * 60)
    row = streaks.active_streaks(logs, recent=20).where("streak_type = 'point_streak'").first()
    assert row.length == 60 and len(row.recent_games) == 20
    assert row.start_date == datetime.date(2026, 1, 2) and row.recent_games[-1].game_date == row.end_date
    players = players_of(spark)
    scored = rarity.evaluate_players(logs, players, "20252026", streaks.compute_baselines(logs, players)).where("streak_type = 'point_streak'").first()
    # the only run there is: everyone has it, and it equals the personal best
    assert (scored.length, scored.league_p, scored.team_p, scored.player_p) == (60, 1.0, 1.0, 0.10)


def test_custom_predicate(spark):
    logs = logs_of(spark, [2, 3, 0, 4])
    wide = streaks.longest_runs_wide(logs, predicates={"two_plus": F.col("points") >= 2})
    assert wide.first().two_plus == 2


def fixture_baselines(spark):
    league = spark.createDataFrame(
        [("F", "point_streak", n, p) for n, p in enumerate([0.95, 0.8, 0.6, 0.4, 0.2], 1)],
        "pg string, streak_type string, n bigint, p double",
    )
    team = spark.createDataFrame(
        [("EDM", "F", "goal_streak", 2, 0.55), ("EDM", "F", "point_streak", 3, 0.65)],
        "team string, pg string, streak_type string, n bigint, p double",
    )
    player = spark.createDataFrame(
        [(8478402, "point_streak", 5), (8478402, "goal_streak", 3), (8478402, "scoreless_drought", 8)],
        "player_id bigint, streak_type string, career_max bigint",
    )
    meta = spark.createDataFrame([("F", 1), ("ALL", 1)], "pg string, player_seasons bigint")
    return Baselines(league, team, player, meta)


@pytest.mark.parametrize(
    "player,team,kind,length,expected",
    [
        (8478402, "EDM", "point_streak", 3, (0.60, 0.65, 0.6)),
        (8478402, "EDM", "point_streak", 5, (0.2, 0.0, 0.10)),
        (8478402, "EDM", "point_streak", 7, (0.0, 0.0, 0.01)),
        (8478402, "EDM", "goal_streak", 2, (0.0, 0.55, 2 / 3)),
        (9999999, "XYZ", "point_streak", 3, (0.60, 0.0, 0.5)),
        (8478402, "EDM", "point_streak", 100, (0.0, 0.0, 0.01)),
    ],
)
def test_rarity_lookups(spark, player, team, kind, length, expected):
    row = spark.createDataFrame(
        [(player, team, "C", kind, length)],
        "player_id bigint, team string, position string, streak_type string, length bigint",
    )
    r = rarity.score_streaks(row, fixture_baselines(spark)).first()
    assert (r.league_p, r.team_p, r.player_p) == pytest.approx(expected)
    novelty = 0.4 * (1 - expected[0]) + 0.35 * (1 - expected[1]) + 0.25 * (1 - expected[2])
    assert r.novelty == pytest.approx(novelty)
    assert r.novelty_index == pytest.approx(novelty, abs=1e-4)


@pytest.mark.parametrize(
    "levels,name",
    [
        ((1, 1, 1), "EXTREMELY RARE"),
        ((0.9, 0.8, 0.8), "VERY RARE"),
        ((0.6, 0.5, 0.5), "RARE"),
        ((0.3, 0.25, 0.25), "UNCOMMON"),
        ((0, 0, 0), "COMMON"),
    ],
)
def test_severity(spark, levels, name):
    df = spark.createDataFrame([tuple(1.0 - x for x in levels)], "l double, t double, p double")
    n = rarity.novelty(F.col("l"), F.col("t"), F.col("p"))
    assert df.select(rarity.severity(n).alias("s")).first().s == name


def test_weights(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0)], "l double, t double, p double")
    assert df.select(rarity.novelty(F.col("l"), F.col("t"), F.col("p"))).first()[0] == pytest.approx(0.40)


def test_evaluate_players_end_to_end(spark):
    logs, _ = random_logs(spark)
    players = players_of(spark)
    b = streaks.compute_baselines(logs, players)
    found = rarity.evaluate_players(logs, players, "20242025", b, min_games=5)
    rows = rarity.by_novelty(found).collect()
    assert rows and all(r.length >= 2 for r in rows)
    assert [r.novelty for r in rows] == sorted((r.novelty for r in rows), reverse=True)
    one = rarity.evaluate_players(logs, players, "20242025", b, min_games=5, player_id=rows[0].player_id)
    assert {r.player_id for r in one.collect()} == {rows[0].player_id}
    top = rarity.top_anomalies(found, 3).collect()
    assert [(r.player_id, r.streak_type) for r in top] == [(r.player_id, r.streak_type) for r in rows[:3]]
    high = rarity.filter_anomalies(found, min_novelty=0.5, group="F").collect()
    assert all(r.novelty >= 0.5 and r.position in "CLR" for r in high)
    kpis = rarity.anomaly_kpis(found.where("false")).first()
    assert kpis.total == 0 and kpis.avg_novelty == 0.0
