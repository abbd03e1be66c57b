"""Declared schemas of the warehouse tables and of the landed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# --- fixed values: table schemas --------------------------------------------------

PLAYERS = (
    "player_id bigint, first_name string, last_name string, position string,"
    " sweater_number int, shoots_catches string, birth_date string"
)
TEAM_SEASONS = "player_id bigint, season string, team_abbr string"
GAME_LOGS = (
    "game_id bigint, player_id bigint, season string, game_type int, game_date string,"
    " team_abbr string, opponent_abbr string, home_road_flag string, goals int, assists int,"
    " points int, shots int, pim int, plus_minus int, time_on_ice string, shifts int,"
    " power_play_goals int, power_play_points int, shorthanded_goals int, game_winning_goals int,"
    " ot_goals int, blocked_shots int, hits int, giveaways int, takeaways int, faceoff_pct double"
)
PLAY_BY_PLAY = (
    "game_id bigint, event_id bigint, period int, time_in_period string, time_remaining string,"
    " sort_order int, type_code int, type_desc_key string, situation_code string,"
    " home_team_defending_side string, x_coord int, y_coord int, zone_code string, shot_type string,"
    " shooting_player_id bigint, goalie_in_net_id bigint, event_owner_team_id int,"
    " blocking_player_id bigint, scoring_player_id bigint, scoring_player_total int,"
    " assist1_player_id bigint, assist1_player_total int, assist2_player_id bigint,"
    " assist2_player_total int, away_score int, home_score int, away_sog int, home_sog int"
)
SHIFTS = (
    "game_id bigint, shift_id bigint, player_id bigint, player_name string, team_abbr string,"
    " period int, shift_number int, start_time string, end_time string, duration string,"
    " detail_code int, event_number int, hex_value string, team_id int, team_name string,"
    " type_code int"
)

TABLES = {
    "players": PLAYERS,
    "player_team_seasons": TEAM_SEASONS,
    "player_game_logs": GAME_LOGS,
    "play_by_play": PLAY_BY_PLAY,
    "player_shifts": SHIFTS,
}
KEYS = {
    "players": ["player_id"],
    "player_team_seasons": ["player_id", "season"],
    "player_game_logs": ["game_id", "player_id"],
    "play_by_play": ["game_id", "event_id"],
    "player_shifts": ["game_id", "shift_id"],
}
COUNTERS = (
    "goals",
    "assists",
    "points",
    "shots",
    "pim",
    "plus_minus",
    "shifts",
    "power_play_goals",
    "power_play_points",
    "shorthanded_goals",
    "game_winning_goals",
    "ot_goals",
    "blocked_shots",
    "hits",
    "giveaways",
    "takeaways",
)
LOG_DEFAULTS = {"season": "", "game_type": 2, **{c: 0 for c in COUNTERS}}

# --- fixed values: document layouts -----------------------------------------------

_ROSTER_PLAYER = (
    "struct<id:bigint,firstName:string,lastName:string,positionCode:string,sweaterNumber:int,"
    "shootsCatches:string,birthDate:string>"
)
ROSTER_DOC = (
    "teamAbbrev string, season string,"
    f" forwards array<{_ROSTER_PLAYER}>, defensemen array<{_ROSTER_PLAYER}>,"
    f" goalies array<{_ROSTER_PLAYER}>"
)
SCHEDULE_DOC = (
    "teamAbbrev string, season string, games array<struct<id:bigint,gameType:int,gameDate:string,"
    "awayTeam:struct<abbrev:string>,homeTeam:struct<abbrev:string>>>"
)
_BOX_PLAYER = (
    "struct<playerId:bigint,goals:string,assists:string,points:string,sog:string,pim:string,"
    "plusMinus:string,toi:string,shifts:string,powerPlayGoals:string,blockedShots:string,hits:string,"
    "giveaways:string,takeaways:string,faceoffWinningPctg:string>"
)
_BOX_SIDE = (
    f"struct<forwards:array<{_BOX_PLAYER}>,defense:array<{_BOX_PLAYER}>,goalies:array<{_BOX_PLAYER}>>"
)
BOXSCORE_DOC = (
    "id bigint, season string, gameType int, gameDate string,"
    " awayTeam struct<abbrev:string>, homeTeam struct<abbrev:string>,"
    f" playerByGameStats struct<awayTeam:{_BOX_SIDE},homeTeam:{_BOX_SIDE}>"
)
_LOG_ENTRY_FIELDS = (
    "gameId",
    "gameDate",
    "teamAbbrev",
    "opponentAbbrev",
    "homeRoadFlag",
    "goals",
    "assists",
    "points",
    "shots",
    "pim",
    "plusMinus",
    "toi",
    "shifts",
    "powerPlayGoals",
    "powerPlayPoints",
    "shorthandedGoals",
    "gameWinningGoals",
    "otGoals",
)
GAME_LOG_DOC = (
    "playerId bigint, season string, gameType int, gameLog array<struct<"
    + ",".join(f"{f}:string" for f in _LOG_ENTRY_FIELDS)
    + ">>"
)
PLAY_BY_PLAY_DOC = (
    "id bigint, plays array<struct<eventId:bigint,periodDescriptor:struct<number:int>,"
    "timeInPeriod:string,timeRemaining:string,sortOrder:int,typeCode:int,typeDescKey:string,"
    "situationCode:string,homeTeamDefendingSide:string,details:struct<xCoord:int,yCoord:int,"
    "zoneCode:string,shotType:string,shootingPlayerId:bigint,goalieInNetId:bigint,"
    "eventOwnerTeamId:int,blockingPlayerId:bigint,scoringPlayerId:bigint,scoringPlayerTotal:int,"
    "assist1PlayerId:bigint,assist1PlayerTotal:int,assist2PlayerId:bigint,assist2PlayerTotal:int,"
    "awayScore:int,homeScore:int,awaySOG:int,homeSOG:int>>>"
)
SHIFT_CHART_DOC = (
    "gameId bigint, data array<struct<id:bigint,playerId:bigint,firstName:string,lastName:string,"
    "teamAbbrev:string,period:int,shiftNumber:int,startTime:string,endTime:string,duration:string,"
    "detailCode:int,eventNumber:int,hexValue:string,teamId:int,teamName:string,typeCode:int>>"
)


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Expose tables to SQL, plus the latest team per player; safe to repeat."""
    from streakline.operators.reports import current_team_view

    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if "players" in tables and "player_team_seasons" in tables:
        view = current_team_view(tables["players"], tables["player_team_seasons"])
        view.createOrReplaceTempView("v_player_current_team")
