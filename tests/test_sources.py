"""Landed files, sinks, table maintenance, jobs and incremental loading."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from streakline import schemas
from streakline.operators import rarity, reports, streaks, tables
from streakline.plans import jobs
from streakline.sources import documents, sheets, sinks
from streakline.streaming.incremental import load_new_files


def land(path, docs):
    path.mkdir(parents=True, exist_ok=True)
    n = len(list(path.iterdir()))
    (path / f"part-{n}.json").write_text("\n".join(json.dumps(d) for d in docs), encoding="utf-8")
    return str(path)


def roster(team, season, ids):
    def person(i, code):
        return {"id": i, "firstName": {"default": f"F{i}"}, "lastName": {"default": f"L{i}"}, "positionCode": code}

    return {
        "teamAbbrev": team,
        "season": season,
        "forwards": [{**person(i, "C"), "sweaterNumber": i, "birthDate": "2000-01-01"} for i in ids[:-1]],
        "goalies": [person(ids[-1], "G")],
    }


def boxscore(game, date, season="20252026"):
    def skater(i, **kw):
        return {"playerId": i, "goals": 1, "assists": 0, "points": 1, "sog": 3, "toi": "15:00", "faceoffWinningPctg": 0.0, **kw}

    return {
        "id": game,
        "season": season,
        "gameType": 2,
        "gameDate": date,
        "awayTeam": {"abbrev": "AAA"},
        "homeTeam": {"abbrev": "HHH"},
        "playerByGameStats": {
            "awayTeam": {
                "forwards": [skater(1, blockedShots="x", faceoffWinningPctg=0.5), skater(2)],
                "defense": [skater(3, plusMinus=-2)],
                "goalies": [{"playerId": 9, "toi": "0:00"}, {"playerId": 10, "toi": "60:00", "pim": 2, "sog": 5}],
            },
            "homeTeam": {"forwards": [skater(11)], "goalies": [{"playerId": 12}]},
        },
    }


def test_boxscores(spark, tmp_path):
    docs = documents.read_documents(spark, land(tmp_path / "box", [boxscore(1, "2025-10-08")]), schemas.BOXSCORE_DOC)
    rows = {r.player_id: r for r in documents.flatten_boxscores(docs).collect()}
    assert set(rows) == {1, 2, 3, 10, 11, 12}  # the goalie with 0:00 is out, one without ice time stays
    assert (rows[1].home_road_flag, rows[1].team_abbr, rows[1].opponent_abbr) == ("R", "AAA", "HHH")
    assert (rows[11].home_road_flag, rows[11].team_abbr) == ("H", "HHH")
    assert rows[1].blocked_shots == 0 and rows[1].faceoff_pct == 0.5 and rows[2].faceoff_pct is None
    assert rows[3].plus_minus == -2
    assert (rows[10].shots, rows[10].pim, rows[10].time_on_ice) == (0, 2, "60:00")
    assert set(rows[1].asDict()) == {f.name for f in schemas.schema(schemas.GAME_LOGS)}


def test_rosters_and_schedules(spark, tmp_path):
    docs = documents.read_documents(spark, land(tmp_path / "r", [roster("AAA", "20252026", [1, 2, 9]), {"teamAbbrev": "E"}]), schemas.ROSTER_DOC)
    rows = documents.flatten_rosters(docs).orderBy("player_id").collect()
    assert [(r.player_id, r.first_name, r.position, r.birth_date) for r in rows] == [
        (1, "F1", "C", "2000-01-01"), (2, "F2", "C", "2000-01-01"), (9, "F9", "G", "")]
    games = [{"id": i, "gameType": 1 + i % 3, "gameDate": "2025-10-01"} for i in range(6)]
    sched = documents.read_documents(
        spark, land(tmp_path / "s", [{"teamAbbrev": t, "games": games} for t in "AB"]), schemas.SCHEDULE_DOC
    )
    listed = documents.flatten_schedules(sched, [2, 3])
    assert listed.count() == 8
    assert [r.game_id for r in tables.distinct_ids([listed], "game_id").collect()] == [1, 2, 4, 5]
    assert {r.team_abbr for r in tables.first_seen(listed, ["game_id"], ["team_abbr"]).collect()} == {"A"}


def test_game_logs_validate_entries(spark, tmp_path):
    good = {"gameId": 5, "gameDate": "2025-10-08", "teamAbbrev": "AAA", "goals": 2, "toi": "10:00"}
    entries = [good, {**good, "gameId": None}, {**good, "gameId": 6, "goals": "many"}, {"gameId": 7}]
    docs = [{"playerId": 1, "season": "20252026", "gameType": 2, "gameLog": entries}, {"playerId": 2, "season": "bad", "gameLog": [good]}]
    parsed = documents.read_documents(spark, land(tmp_path / "g", docs), schemas.GAME_LOG_DOC)
    rows = documents.flatten_game_logs(parsed).collect()
    assert [(r.game_id, r.player_id, r.goals, r.assists, r.opponent_abbr) for r in rows] == [(5, 1, 2, 0, "")]
    bad = documents.rejected_game_logs(parsed).collect()
    assert sorted(r.reason for r in bad) == ["gameDate", "gameId", "goals"]
    assert json.loads(next(r.entry for r in bad if r.reason == "goals"))["goals"] == "many"
    counts = {r.reason: r.n for r in documents.rejection_counts(parsed).collect()}
    assert counts == {"ok": 1, "gameDate": 1, "gameId": 1, "goals": 1}


def test_game_logs_load_in_one_pass(spark, tmp_path):
    w = jobs.Warehouse(spark, str(tmp_path / "wh"))

    def load(name, entries, **options):
        docs = [{"playerId": 1, "season": "20252026", "gameType": 2, "gameLog": entries}]
        parsed = documents.read_documents(spark, land(tmp_path / name, docs), schemas.GAME_LOG_DOC)
        return jobs.load_game_logs(w, parsed, **options)

    good = {"gameId": 2025020005, "gameDate": "2025-10-08", "teamAbbrev": "AAA", "goals": 2}
    report = load("a", [good, {**good, "goals": "many"}])
    assert (report.entries, report.n_rejected) == (2, 1)
    assert [r.reason for r in report.rejected.collect()] == ["goals"]
    assert [(r.game_id, r.goals) for r in w.table("player_game_logs").collect()] == [(2025020005, 2)]
    only_good = load("b", [{**good, "goals": 3}])
    assert (only_good.entries, only_good.n_rejected, only_good.rejected.count()) == (1, 0, 0)
    assert [r.goals for r in w.table("player_game_logs").collect()] == [3]
    load("c", [{**good, "gameId": 2025020006}], skip_existing=True)
    assert w.table("player_game_logs").count() == 1
    only_bad = load("d", [{**good, "gameId": None}])
    assert (only_bad.entries, only_bad.n_rejected, only_bad.rejected.count()) == (1, 1, 1)
    empty = load("e", [])
    assert (empty.entries, empty.n_rejected, empty.rejected.count()) == (0, 0, 0)
    assert w.table("player_game_logs").count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "b", c', 0.5, None), (2, None, None, "x\ty"), (3, "ünïcode", -1.0, "z")]
    ddl = "id int, name string, rate double, note string"
    path = str(tmp_path / "csv")
    sinks.write_csv(spark.createDataFrame(rows, ddl), path)
    sinks.write_csv(spark.createDataFrame(rows, ddl), path)  # overwrites
    back = spark.read.option("escape", "\\").schema(ddl).csv(path, header=True)
    assert sorted(map(tuple, back.collect())) == rows


def test_plays_and_shifts(spark, tmp_path):
    play = {"eventId": 3, "periodDescriptor": {"number": 2}, "typeDescKey": "goal", "details": {"scoringPlayerId": 7, "xCoord": -5}}
    pbp = documents.read_documents(spark, land(tmp_path / "p", [{"id": 1, "plays": [play, {"eventId": 4}]}, {"id": 2}]), schemas.PLAY_BY_PLAY_DOC)
    rows = {r.event_id: r for r in documents.flatten_play_by_play(pbp).collect()}
    assert (rows[3].period, rows[3].scoring_player_id, rows[3].x_coord, rows[3].zone_code) == (2, 7, -5, "")
    assert (rows[4].period, rows[4].shooting_player_id, rows[4].situation_code) == (0, None, "")
    assert documents.flatten_play_by_play(pbp).columns == [f.name for f in schemas.schema(schemas.PLAY_BY_PLAY)]
    chart = {"gameId": 1, "data": [{"id": 1, "playerId": 2, "firstName": "A", "startTime": "0:10"}]}
    flat = documents.flatten_shift_charts(documents.read_documents(spark, land(tmp_path / "c", [chart]), schemas.SHIFT_CHART_DOC))
    assert flat.columns == [f.name for f in schemas.schema(schemas.SHIFTS)]
    assert flat.first().player_name == "A"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_sheets(spark, tmp_path):
    files = {
        2016: write(tmp_path / "a.csv", "Prenom,Nom,HM,ESPN,MOY\nAl,Bo,80,70.9,75\nCy,,1,1,1\n,Di,5,0,2\n"),
        2017: write(tmp_path / "b.csv", "banner,,,\nPrenom,Nom,PP,Rang\nAl,Bo,60,1\nEm,nan,3,1\n"),
        2018: write(tmp_path / "c.csv", "RG,HM,NOM,,EQUIPE,HM,MOY,HN\n1,1,Al,Bo,TB,90,80,70\n"),
        2019: write(tmp_path / "d.txt", "1 Al St-Bo TB 90 91 92 93\n91,5 2 Cy Éd WIN 10 11\r\n12 13 11,5\n"),
        2020: write(tmp_path / "e.csv", "Rang,Nom,Équipe,ath,Moyenne\n1,Al van Bo,sj,88,80\n"),
        2021: write(tmp_path / "f.csv", "Rang,Prénom,Nom,Équipe,HM,ATH,MOY\n1,Al,Bo,LA,77,x,1\n"),
        2022: write(tmp_path / "g.csv", "RG,NOM,Équipe,HM,ESPN,MOY,Autre\n1,Al Bo,FLO,66,65,1,9\n"),
        2024: write(tmp_path / "h.csv", "Rang,Prénom,Nom,Position,Équipe,Fantrax,Pool Expert,Moyenne\n1,Al,Bo,C,EDM,55,54,1\n"),
        2025: str(tmp_path / "absent.csv"),
    }
    rows = sheets.read_projections(spark, files).collect()
    got = {(r.file_year, r.player_name, r.team, r.source, r.projected_points) for r in rows}
    assert got == {
        (2016, "Al Bo", "", "Hockey Le Magazine", 80), (2016, "Al Bo", "", "ESPN", 70), (2016, " Di", "", "Hockey Le Magazine", 5),
        (2017, "Al Bo", "", "PoolPro", 60),
        (2018, "Al Bo", "TBL", "Hockey Le Magazine", 90), (2018, "Al Bo", "TBL", "Hockey News", 70),
        (2019, "Al St-Bo", "TBL", "Hockey News", 90), (2019, "Al St-Bo", "TBL", "Hockey Le Magazine", 91),
        (2019, "Al St-Bo", "TBL", "PoolPro", 92), (2019, "Al St-Bo", "TBL", "Sports Forecaster", 93),
        (2019, "Cy Éd", "WPG", "Hockey News", 10), (2019, "Cy Éd", "WPG", "Hockey Le Magazine", 11),
        (2019, "Cy Éd", "WPG", "PoolPro", 12), (2019, "Cy Éd", "WPG", "Sports Forecaster", 13),
        (2020, "Al van Bo", "SJS", "The Athletic", 88),
        (2021, "Al Bo", "LAK", "Hockey Le Magazine", 77),
        (2022, "Al Bo", "FLA", "Hockey Le Magazine", 66), (2022, "Al Bo", "FLA", "ESPN", 65),
        (2024, "Al Bo", "EDM", "Fantrax", 55), (2024, "Al Bo", "EDM", "PoolExpert", 54),
    }
    assert {r.season_id for r in rows if r.file_year == 2019} == {20192020}
    assert {r.file_year for r in sheets.read_projections(spark, files, [2017, 2021]).collect()} == {2017, 2021}
    with pytest.raises(FileNotFoundError):
        sheets.read_projections(spark, files, [2025])


def test_only_whole_head_lines_are_dropped(spark, tmp_path):
    text = "Liste,,\nPrenom,Nom,HM\nAl,Bo,80\nPrenom,Nom,70\nPrenom,Nom,HM\n"
    folder = tmp_path / "sheet"
    folder.mkdir()
    write(folder / "a.csv", text)
    write(folder / "b.csv", text.replace("Al,Bo", "Cy,Di"))
    rows = sheets.read_sheet(spark, str(folder), header_row=1).collect()
    assert sorted(tuple(r) for r in rows) == [("Al", "Bo", "80"), ("Cy", "Di", "80"), ("Prenom", "Nom", "70"), ("Prenom", "Nom", "70")]
    unnamed = write(tmp_path / "u.csv", ",Nom,HM\nAl,Bo,80\n,Di,5\n")
    rows = sheets.read_sheet(spark, unnamed).collect()
    assert [tuple(r) for r in rows] == [("Al", "Bo", "80"), (None, "Di", "5")]


def test_results_table_and_backtest(spark, tmp_path):
    text = "Rk,Player,Tm,Pos,GP,G,A,PTS\n1,Al Bo,EDM,C,82,30,50,80\nRk,Rk,Tm,Pos,GP,G,A,PTS\n2,Cy de Di,TOT,D,60,1,2,3\n2,Cy de Di,AAA,D,x,1,2,2\n"
    raw = spark.read.csv(write(tmp_path / "r.csv", text), header=True)
    rows = {r.player_name: r for r in sheets.season_results(raw, 20162017).collect()}
    assert set(rows) == {"Al Bo", "Cy de Di"}
    assert rows["Al Bo"].points_per_game == 0.976
    assert (rows["Cy de Di"].last_name, rows["Cy de Di"].games_played, rows["Cy de Di"].points_per_game) == ("de Di", 0, 2.0)
    sheet = {2016: write(tmp_path / "a.csv", "Prenom,Nom,HM\nAl,Bo,70\nXx,Yy,10\n")}
    out = jobs.backtest(spark, sheet, sheets.season_results(raw, 20162017))
    assert {r.player_name: r.error for r in out["matched"].collect()} == {"Al Bo": -10, "Xx Yy": None}
    assert out["match_rate"].first().match_rate == 50.0
    assert out["metrics"].count() == 0


def test_season_summary(spark, tmp_path):
    text = "playerId,season,name,team,position,situation,games_played,I_F_xGoals,extra\n1,2025,Al Bo,EDM,C,all,80,20.5,q\n1,2025,Al Bo,EDM,C,5on5,80,15,q\n"
    rows = sheets.read_season_summary(spark, write(tmp_path / "m.csv", text)).collect()
    assert [(r.name, r.I_F_xGoals) for r in rows] == [("Al Bo", 20.5)]
    assert sheets.read_season_summary(spark, str(tmp_path / "none.csv")) is None


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, hits int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, name string, batch int")
    merged = tables.upsert(old, new.drop("batch").withColumn("batch", F.lit(1)).select("id", "name"), ["id"], [F.desc("name")], {"hits": 0})
    assert {tuple(r) for r in merged.collect()} == {(1, "a", 5), (2, "d", 0), (3, "e", 0)}
    again = tables.upsert(merged, new.select("id", "name"), ["id"], [F.desc("name")], {"hits": 0})
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in merged.collect()}


KEYED = ["id", "season"]


def by_season():
    return {"season": F.col("season")}


def test_partitioned_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "id int, v int, season string"
    first = spark.createDataFrame([(1, 1, "A"), (2, 1, "B")], ddl)
    sinks.upsert_table(spark, path, first, KEYED, by_season(), ddl=ddl)
    before = sorted(p.name for p in (tmp_path / "t" / "season=B").iterdir())
    more = spark.createDataFrame([(1, 2, "A"), (3, 2, "A")], ddl)
    sinks.upsert_table(spark, path, more, KEYED, by_season(), ddl=ddl)
    rows = {(r.id, r.v, r.season) for r in spark.read.schema(ddl).parquet(path).collect()}
    assert rows == {(1, 2, "A"), (3, 2, "A"), (2, 1, "B")}
    assert sorted(p.name for p in (tmp_path / "t" / "season=B").iterdir()) == before


def test_touched_partitions_prune_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "id int, v int, season string"
    rows = spark.createDataFrame([(1, 1, "A"), (2, 1, "B"), (3, 1, None)], ddl)
    sinks.upsert_table(spark, path, rows, KEYED, by_season(), ddl=ddl)
    more = spark.createDataFrame([(4, 1, "A"), (5, 1, None)], ddl)
    pruned = spark.read.schema(ddl).parquet(path).where(sinks.touched_partitions(more, ["season"]))
    assert len(pruned._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [(")) == 2
    assert {r.id for r in pruned.collect()} == {1, 3}


def test_a_changed_season_leaves_one_row(spark, tmp_path):
    warehouse = jobs.Warehouse(spark, str(tmp_path / "w"))
    ddl = schemas.GAME_LOGS

    def row(season, goals):
        base = spark.createDataFrame([(2023020001, 10, season, goals)], "game_id long, player_id long, season string, goals int")
        return tables.evolve(base, schemas.schema(ddl), schemas.LOG_DEFAULTS)

    warehouse.store("player_game_logs", row("", 1))
    warehouse.store("player_game_logs", row("20232024", 2))
    assert [(r.season, r.goals) for r in warehouse.table("player_game_logs").collect()] == [("20232024", 2)]
    with pytest.raises(ValueError):
        sinks.upsert_table(spark, str(tmp_path / "x"), row("", 1), ["game_id", "player_id"], by_season())


def test_schema_evolution(spark):
    old = spark.createDataFrame([(1, 2, "2025-10-08", 3, "x")], "game_id int, player_id int, game_date string, goals int, current_team string")
    new = tables.evolve(old, schemas.schema(schemas.GAME_LOGS), schemas.LOG_DEFAULTS)
    assert new.columns == [f.name for f in schemas.schema(schemas.GAME_LOGS)]
    r = new.first()
    assert (r.season, r.game_type, r.hits, r.faceoff_pct, r.goals) == ("20252026", 2, 0, None, 3)


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    assert [r.id for r in tables.distinct_ids([a, b], "id").collect()] == [1, 2, 3]
    assert [r.id for r in tables.missing_ids(a, b, "id").collect()] == [1]
    assert [r.id for r in tables.ids_in_both(a, b, "id").collect()] == [2]
    assert tables.known_only(a, b, "id").count() == 2 and tables.orphans(a, b, "id").count() == 1


def test_state_counts_with_nulls(spark):
    rows = [(1, "A", 2), (1, "A", 3), (1, "B", 2), (2, "B", 2), (None, "C", 2), (3, None, 1), (3, None, 1)]
    logs = spark.createDataFrame(rows, "player_id int, season string, game_type int")
    expected = {"rows": 7, "regular_season": 4, "playoffs": 1, "seasons": 3, "players": 3}
    assert reports.rolled_up(logs).first().asDict() == expected
    assert reports.rolled_up(logs.limit(0)).first().asDict() == dict.fromkeys(expected, 0)
    plan = reports.rolled_up(logs)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_baselines_round_trip(spark, tmp_path):
    league = spark.createDataFrame([("F", "point_streak", 1, 0.5), ("F", "point_streak", 2, 0.25)], "pg string, streak_type string, n bigint, p double")
    b = streaks.Baselines(league, league.withColumn("team", F.lit("X")), spark.createDataFrame([(1, "point_streak", 3)], "player_id bigint, streak_type string, career_max bigint"), spark.createDataFrame([("F", 1)], "pg string, player_seasons bigint"))
    sinks.save_baselines(b, str(tmp_path / "b"))
    back = sinks.load_baselines(spark, str(tmp_path / "b"))
    assert {tuple(r) for r in back.league.collect()} == {tuple(r) for r in league.collect()}
    sinks.export_curves(league, str(tmp_path / "c"))
    assert {tuple(r) for r in sinks.import_curves(spark, str(tmp_path / "c")).collect()} == {tuple(r) for r in league.collect()}
    sinks.cache_results(spark.createDataFrame([(1, 10), (2, 20)], "season_id int, v int"), str(tmp_path / "k"))
    sinks.cache_results(spark.createDataFrame([(2, 21)], "season_id int, v int"), str(tmp_path / "k"))
    cached = {(r.season_id, r.v) for r in sinks.cached_results(spark, str(tmp_path / "k")).collect()}
    assert cached == {(1, 10), (2, 21)}
    assert sinks.cached_results(spark, str(tmp_path / "k"), [1]).count() == 1


def test_warehouse_end_to_end(spark, tmp_path):
    w = jobs.Warehouse(spark, str(tmp_path / "wh"))
    rosters = [roster("AAA", "20252026", [1, 2, 3, 10]), roster("HHH", "20252026", [11, 12])]
    jobs.load_rosters(w, documents.read_documents(spark, land(tmp_path / "r", rosters), schemas.ROSTER_DOC))
    days = [datetime.date(2025, 10, 8) + datetime.timedelta(days=i) for i in range(12)]
    games = [boxscore(2025020001 + i, str(d)) for i, d in enumerate(days)]
    docs = documents.read_documents(spark, land(tmp_path / "g", games), schemas.BOXSCORE_DOC)
    jobs.load_boxscores(w, docs)
    logs = w.table("player_game_logs")
    n = logs.count()
    assert n == 12 * 6
    assert tables.orphans(logs, w.table("players"), "player_id").count() == 0
    assert logs.select("season").distinct().count() == 1
    jobs.load_boxscores(w, docs, skip_existing=True)
    jobs.load_boxscores(w, docs)
    assert w.table("player_game_logs").count() == n
    w.register()
    found = jobs.query(spark, "SELECT count(*) AS n FROM player_game_logs WHERE season = :s", s="20252026")
    assert found.first().n == n
    assert spark.table("v_player_current_team").count() == 6

    anomalies = jobs.daily_report(w, "20252026", str(tmp_path / "b"), str(tmp_path / "out"), "2026-01-01 00:00 UTC", refresh=True, min_novelty=0.0)
    rows = anomalies.collect()
    assert rows and all(r.length == 12 for r in rows if r.streak_type == "point_streak")
    records = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "anomalies")).collect()]
    assert len(records) == len(rows)
    assert [r["novelty_index"] for r in records] == sorted((r["novelty_index"] for r in records), reverse=True)
    assert {s["level"] for s in records[0]["rarity_scores"]} == {"league", "team", "player"}
    assert len(records[0]["streak"]["recent_games"]) == records[0]["streak"]["length"]
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "summary")).collect()]
    assert lines[0] == "=" * 72 and lines[3] == f"  Total anomalies: {len(rows)}"
    top = [line for line in lines if line.startswith("  1. [")]
    assert len(top) == 1 and any(line.startswith("    league: P=") for line in lines)
    assert reports.coverage(w.table("player_game_logs")).first().total_records == n
    info = reports.player_info(w.table("players"), w.table("player_team_seasons"), 1).first()
    assert (info.team, info.last_name) == ("AAA", "L1")
    assert rarity.active_players(w.table("player_game_logs"), w.table("players"), 10).count() == 4


def test_events_and_shifts_load_once(spark, tmp_path):
    w = jobs.Warehouse(spark, str(tmp_path / "wh"))
    pbp = {"id": 2025020001, "plays": [{"eventId": 1, "typeDescKey": "goal"}, {"eventId": 2}]}
    docs = documents.read_documents(spark, land(tmp_path / "p", [pbp]), schemas.PLAY_BY_PLAY_DOC)
    jobs.load_events(w, docs)
    jobs.load_events(w, docs)
    assert w.table("play_by_play").count() == 2
    assert w.table("play_by_play").first().season == "20252026"
    chart = {"gameId": 2025020001, "data": [{"id": 1, "playerId": 2, "startTime": "0:10"}]}
    charts = documents.read_documents(spark, land(tmp_path / "c", [chart]), schemas.SHIFT_CHART_DOC)
    jobs.load_shifts(w, charts)
    jobs.load_shifts(w, charts, skip_existing=False)
    assert w.table("player_shifts").count() == 1


def test_incremental_loading_reads_each_file_once(spark, tmp_path):
    w = jobs.Warehouse(spark, str(tmp_path / "wh"))
    seen = []

    def load(docs):
        seen.append(docs.count())
        jobs.load_events(w, docs, skip_existing=False)

    def pbp(game):
        return {"id": game, "plays": [{"eventId": 1}, {"eventId": 2}]}

    landing = land(tmp_path / "in", [pbp(2025020001)])
    args = (landing, schemas.PLAY_BY_PLAY_DOC, load, str(tmp_path / "ck"))
    load_new_files(spark, *args)
    land(tmp_path / "in", [pbp(2025020002), pbp(2025020003)])
    load_new_files(spark, *args)
    load_new_files(spark, *args)
    assert seen == [1, 2]
    assert w.table("play_by_play").count() == 6
