"""The registered queries as DuckDB SQL over the same tables.

Written from the definitions, not from the Spark plans: streaks are classic
islands in long form, possession is a plain interval join, percentiles are the
engine's own.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

SEASON = "'20232024'"

# --- views -----------------------------------------------------------------------

EV = "ev AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"

LOGS = (
    EV
    + """, logs AS (
  SELECT event_id AS game_id, user_id AS player_id,
    CAST(2021 + (day(ts) - 1) // 10 AS VARCHAR) || CAST(2022 + (day(ts) - 1) // 10 AS VARCHAR) AS season,
    CASE WHEN k % 10 = 9 THEN 3 WHEN k % 10 = 8 THEN 1 ELSE 2 END AS game_type,
    ts AS game_date, event_type AS team_abbr,
    CASE WHEN event_type = 'click' THEN 'view' ELSE 'click' END AS opponent_abbr,
    CASE WHEN k % 2 = 0 THEN 'H' ELSE 'R' END AS home_road_flag,
    CAST(floor(value / 60) AS INTEGER) AS goals, k % 2 AS assists,
    CAST(floor(value / 60) AS INTEGER) + k % 2 AS points,
    k % 6 AS shots, (k % 3) * 2 AS pim, k % 7 - 3 AS plus_minus,
    CAST(k % 20 AS VARCHAR) || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') AS time_on_ice,
    (k % 20) * 60 + k % 60 AS toi_sec,
    15 + k % 10 AS shifts, (k % 4) // 3 AS power_play_goals, (k % 5) // 4 AS shorthanded_goals,
    (k % 9) // 8 AS game_winning_goals, k % 4 AS blocked_shots, k % 8 AS hits,
    k % 5 AS giveaways, k % 3 AS takeaways, nullif(k / 100.0, 0.0::DOUBLE) AS faceoff_pct
  FROM ev)"""
)

PLAYERS = """players AS (
  SELECT c_custkey AS player_id, split_part(c_name, '#', 1) AS first_name,
    split_part(c_name, '#', 2) AS last_name,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'C' WHEN 'FURNITURE' THEN 'L' WHEN 'MACHINERY' THEN 'R'
      WHEN 'BUILDING' THEN 'D' WHEN 'HOUSEHOLD' THEN 'G' END AS position,
    CAST(c_custkey % 99 AS INTEGER) AS sweater_number,
    CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'R' END AS shoots_catches,
    CAST(DATE '1985-01-01' + CAST(c_custkey % 5000 AS INTEGER) AS VARCHAR) AS birth_date
  FROM customer),
skaters AS (
  SELECT player_id, position, CASE WHEN position IN ('C', 'L', 'R') THEN 'F' WHEN position = 'D' THEN 'D' ELSE 'ALL' END AS pg
  FROM players WHERE position <> 'G')"""

TEAM_SEASONS = """team_seasons AS (
  SELECT player_id, season, arg_max(team_abbr, (game_date, game_id)) AS team_abbr
  FROM logs GROUP BY player_id, season),
current_team AS (
  SELECT t.player_id, t.team_abbr AS current_team, t.season FROM team_seasons t
  WHERE t.season = (SELECT max(u.season) FROM team_seasons u WHERE u.player_id = t.player_id))"""

# --- fixed values: streak types ----------------------------------------------------

_TYPES = [
    ("point_streak", "points >= 1", "positive", "Consecutive games with 1+ points", "Point Streak (1+ pts)"),
    ("goal_streak", "goals >= 1", "positive", "Consecutive games with 1+ goals", "Goal Streak (1+ G)"),
    ("multi_point", "points >= 2", "positive", "Consecutive games with 2+ points", "Multi-Point (2+ pts)"),
    ("hat_trick", "goals >= 3", "positive", "Games with 3+ goals", "Hat Trick (3+ G)"),
    ("takeaway_streak", "takeaways >= 1", "positive", "Consecutive games with 1+ takeaways", "Takeaway Streak (1+ TK)"),
    ("scoreless_drought", "goals = 0", "negative", "Consecutive games with 0 goals", "Scoreless Drought (0 G)"),
    ("pointless_drought", "points = 0", "negative", "Consecutive games with 0 points", "Pointless Drought (0 pts)"),
    ("shot_drought", "shots <= 1", "negative", "Consecutive games with 1 or fewer shots", "Shot Drought (<=1 SOG)"),
    ("minus_streak", "plus_minus < 0", "negative", "Consecutive games with negative plus/minus", "Minus Streak (-/-)"),
]
_STRUCTS = ", ".join(f"{{'t': '{t}', 'h': {p}}}" for t, p, *_ in _TYPES)
TYPES = "types AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {i}, '{sign}', '{text}', '{label}')" for i, (t, _, sign, text, label) in enumerate(_TYPES, 1)
) + ") v(streak_type, type_rank, sign, description, label))"

HITS = f"""hits AS (
  SELECT player_id, season, team_abbr, game_id, game_date, u.t AS streak_type, u.h AS hit
  FROM (SELECT *, unnest([{_STRUCTS}]) AS u FROM logs))"""


def _islands(name: str, keys: str) -> str:
    return f"""{name}_pos AS (
  SELECT *, row_number() OVER w AS idx, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER w AS misses
  FROM hits WINDOW w AS (PARTITION BY {keys}, streak_type ORDER BY game_date, game_id ROWS UNBOUNDED PRECEDING)),
{name} AS (
  SELECT {keys}, streak_type, min(idx) - 1 AS island, count(*) AS length,
    min(game_date) AS start_date, max(game_date) AS end_date
  FROM {name}_pos WHERE hit GROUP BY {keys}, streak_type, misses),
{name}_max AS (
  SELECT h.*, coalesce(i.max_len, 0) AS max_len
  FROM (SELECT DISTINCT {keys}, streak_type FROM hits) h
  LEFT JOIN (SELECT {keys}, streak_type, max(length) AS max_len FROM {name} GROUP BY ALL) i
  USING ({keys}, streak_type))"""


def _curve(name: str, runs: str, by: str) -> str:
    """Tail curve over ``runs`` (max_len, streak_type, pg and the ``by`` columns)."""
    return f"""{name}_all AS (
  SELECT {by}pg, streak_type, max_len FROM {runs}
  UNION ALL SELECT {by}'ALL', streak_type, max_len FROM {runs} WHERE pg <> 'ALL'),
{name}_top AS (SELECT {by}pg, streak_type, max(max_len) AS top FROM {name}_all GROUP BY {by}pg, streak_type),
{name}_n AS (SELECT {by}pg, streak_type, unnest(range(1, top + 1)) AS n FROM {name}_top),
{name} AS (
  SELECT {by}pg, streak_type, n,
    CAST(sum(CASE WHEN max_len >= n THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS p
  FROM {name}_n JOIN {name}_all USING ({by}pg, streak_type) GROUP BY {by}pg, streak_type, n)"""


ISLANDS = f"{LOGS}, {HITS}, {_islands('isl', 'player_id, season')}"
RUNS = f"{ISLANDS}, {PLAYERS}, runs AS (SELECT m.*, s.pg FROM isl_max m JOIN skaters s USING (player_id))"
LEAGUE = f"{RUNS}, {_curve('league', 'runs', '')}"
TEAM_RUNS = f"""{_islands('tisl', 'team_abbr, player_id, season')},
truns AS (SELECT m.player_id, m.season, m.team_abbr AS team, m.streak_type, m.max_len, s.pg
  FROM tisl_max m JOIN skaters s USING (player_id))"""
TEAM = f"{TEAM_RUNS}, {_curve('team_curve', 'truns', 'team, ')}"
BEST = """best AS (SELECT player_id, streak_type, max(max_len) AS career_max FROM runs GROUP BY ALL HAVING max(max_len) > 0)"""
BASELINES = f"{LEAGUE}, {TEAM}, {BEST}"


def _active(keys: str, where: str = "") -> str:
    return f"""tail AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, streak_type ORDER BY game_date DESC, game_id DESC) AS rn
  FROM hits {where}),
tail_run AS (
  SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY {keys}, streak_type ORDER BY rn ROWS UNBOUNDED PRECEDING) AS misses
  FROM tail),
active AS (
  SELECT {keys}, streak_type, count(*) AS length, min(game_date) AS start_date, max(game_date) AS end_date,
    least(count(*), 40) AS n_recent, arg_min(game_id, game_date) FILTER (rn <= 40) AS first_game_id
  FROM tail_run WHERE misses = 0 GROUP BY ALL HAVING count(*) >= 2)"""


ANOMALIES = f"""{BASELINES}, {TYPES}, {_active('player_id', f'WHERE season = {SEASON}')},
who AS (
  SELECT l.player_id, count(*) AS games_played, arg_max(team_abbr, (game_date, game_id)) AS team
  FROM logs l WHERE season = {SEASON} GROUP BY l.player_id HAVING count(*) >= 10),
scored AS (
  SELECT a.player_id, p.first_name || ' ' || p.last_name AS player_name, w.team, s.position, {SEASON} AS season,
    a.streak_type, a.length, a.start_date, a.end_date, t.sign, t.description, t.label, t.type_rank, s.pg,
    coalesce(lg.p, 0.0::DOUBLE) AS league_p, coalesce(tc.p, 0.0::DOUBLE) AS team_p,
    CASE WHEN b.career_max IS NULL THEN 0.5::DOUBLE WHEN a.length > b.career_max THEN 0.01::DOUBLE
      WHEN a.length = b.career_max THEN 0.10::DOUBLE ELSE a.length / b.career_max END AS player_p
  FROM active a JOIN who w USING (player_id) JOIN skaters s USING (player_id) JOIN players p USING (player_id)
  JOIN types t ON t.streak_type = a.streak_type
  LEFT JOIN best b ON b.player_id = a.player_id AND b.streak_type = a.streak_type
  LEFT JOIN league lg ON lg.pg = s.pg AND lg.streak_type = a.streak_type AND lg.n = a.length
  LEFT JOIN team_curve tc ON tc.team = w.team AND tc.pg = s.pg AND tc.streak_type = a.streak_type AND tc.n = a.length),
nov AS (SELECT *, 0.40::DOUBLE * (1 - league_p) + 0.35::DOUBLE * (1 - team_p) + 0.25::DOUBLE * (1 - player_p) AS novelty FROM scored),
anom AS (
  SELECT *, round_even(novelty, 4) AS novelty_index,
    CASE WHEN novelty >= 0.90::DOUBLE THEN 'EXTREMELY RARE' WHEN novelty >= 0.75::DOUBLE THEN 'VERY RARE'
      WHEN novelty >= 0.50::DOUBLE THEN 'RARE' WHEN novelty >= 0.25::DOUBLE THEN 'UNCOMMON' ELSE 'COMMON' END AS severity
  FROM nov)"""
_ANOMALY = """player_id, player_name, team, position, season, streak_type, length, start_date, end_date,
  sign, description, league_p, team_p, player_p, novelty_index, severity"""


def _hist(source: str, value: str, width: str, keys: str = "", where: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}CAST(floor({value} / {width}) AS BIGINT) AS bin, count(*) AS n,
  CAST(floor({value} / {width}) AS BIGINT) * {width} AS bin_start FROM {source} {where} GROUP BY ALL"""


ORACLE["streak_islands"] = f"WITH {ISLANDS} SELECT * FROM isl"
ORACLE["streak_member_games"] = f"""WITH {LOGS}, {HITS}, pos AS (
  SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY player_id, season, streak_type
    ORDER BY game_date, game_id ROWS UNBOUNDED PRECEDING) AS misses FROM hits),
len AS (SELECT *, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY player_id, season, streak_type, misses
    ORDER BY game_date, game_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM pos)
SELECT player_id, season, game_id, {", ".join(f"max(CASE WHEN streak_type = '{t}' THEN run END) AS run_{t}" for t, *_ in _TYPES)}
FROM len GROUP BY ALL"""
ORACLE["streak_max"] = f"WITH {ISLANDS} SELECT player_id, season, streak_type, max_len FROM isl_max"
ORACLE["streak_tail_league"] = f"WITH {LEAGUE} SELECT * FROM league"
ORACLE["streak_tail_team"] = f"WITH {LOGS}, {HITS}, {PLAYERS}, {TEAM} SELECT * FROM team_curve"
ORACLE["streak_career_max"] = f"WITH {RUNS}, {BEST} SELECT * FROM best"
ORACLE["baseline_meta"] = f"""WITH {LOGS}, {PLAYERS},
ps AS (SELECT DISTINCT player_id, season, pg FROM logs JOIN skaters USING (player_id))
SELECT pg, count(*) AS player_seasons FROM ps WHERE pg <> 'ALL' GROUP BY pg
UNION ALL SELECT 'ALL', count(*) FROM ps"""
ORACLE["last_games"] = f"""WITH {LOGS} SELECT player_id, game_id, season, game_date, points,
  CAST(row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS INTEGER) AS rn
FROM logs QUALIFY rn <= 20"""
ORACLE["active_streaks"] = f"WITH {LOGS}, {HITS}, {_active('player_id, season')} SELECT * FROM active"
ORACLE["active_scorers"] = f"""WITH {LOGS}, {PLAYERS}
SELECT l.player_id, count(*) AS games_played, arg_max(team_abbr, (game_date, game_id)) AS team,
  any_value(p.first_name) AS first_name, any_value(p.last_name) AS last_name, any_value(p.position) AS position
FROM logs l JOIN players p USING (player_id) WHERE season = {SEASON} AND p.position <> 'G'
GROUP BY l.player_id HAVING count(*) >= 10"""
ORACLE["streak_anomalies"] = f"WITH {ANOMALIES} SELECT {_ANOMALY} FROM anom"
ORACLE["anomaly_top10"] = (
    f"WITH {ANOMALIES} SELECT {_ANOMALY} FROM anom ORDER BY novelty DESC, player_id, streak_type LIMIT 10"
)
ORACLE["streak_one_player"] = f"WITH {ANOMALIES} SELECT {_ANOMALY} FROM anom WHERE player_id = 9"
ORACLE["daily_records"] = f"""WITH {ANOMALIES}
SELECT player_id, player_name, team, position, streak_type AS type, length, sign, description, CAST(least(length, 40) AS INTEGER) AS n_games,
  novelty_index, severity, u.l AS level, round_even(u.p, 6) AS probability, round_even(1 - u.p, 6) AS rarity
FROM (SELECT *, unnest([{{'l': 'league', 'p': league_p}}, {{'l': 'team', 'p': team_p}}, {{'l': 'player', 'p': player_p}}]) AS u
  FROM anom WHERE novelty >= 0.5)"""
ORACLE["anomaly_filtered"] = f"""WITH {ANOMALIES}
SELECT player_id, team, position, label, length, novelty_index, severity FROM anom
WHERE novelty >= 0.4 AND streak_type IN ('point_streak', 'scoreless_drought') AND team IN ('click', 'view') AND pg = 'F'"""
ORACLE["anomaly_by_severity"] = f"""WITH {ANOMALIES}
SELECT severity, count(*) AS n, CAST(list_position(['EXTREMELY RARE', 'VERY RARE', 'RARE', 'UNCOMMON', 'COMMON'], severity) AS BIGINT) AS rank
FROM anom GROUP BY severity"""
ORACLE["anomaly_by_type_sign"] = f"""WITH {ANOMALIES}
SELECT streak_type, upper(sign[1]) || sign[2:] AS sign, count(*) AS n FROM anom GROUP BY ALL"""
ORACLE["anomaly_type_summary"] = f"""WITH {ANOMALIES}, kept AS (SELECT * FROM anom WHERE novelty >= 0.3),
top AS (SELECT streak_type, team, row_number() OVER (PARTITION BY streak_type ORDER BY count(*) DESC, team) AS rn
  FROM kept GROUP BY streak_type, team)
SELECT k.streak_type, count(*) AS n, round_even(avg(novelty_index), 6) AS avg_novelty, max(length) AS max_length,
  any_value(top.team) AS top_team
FROM kept k JOIN top ON top.streak_type = k.streak_type AND top.rn = 1 GROUP BY k.streak_type"""
ORACLE["anomaly_kpis"] = f"""WITH {ANOMALIES} SELECT count(*) AS total,
  count(*) FILTER (severity = 'EXTREMELY RARE') AS extremely_rare, count(*) FILTER (severity = 'VERY RARE') AS very_rare,
  count(*) FILTER (severity = 'RARE') AS rare, count(*) FILTER (severity = 'UNCOMMON') AS uncommon,
  count(*) FILTER (severity = 'COMMON') AS common, round_even(coalesce(avg(novelty_index), 0), 6) AS avg_novelty FROM anom"""
ORACLE["anomaly_novelty_hist"] = f"WITH {ANOMALIES} {_hist('anom', 'novelty_index', '0.05::DOUBLE')}"
ORACLE["tail_curve_vs_league"] = f"""WITH {BASELINES},
t AS (SELECT * FROM team_curve WHERE pg = 'ALL'), l AS (SELECT * FROM league WHERE pg = 'ALL'),
lt AS (SELECT DISTINCT t.team, l.streak_type, l.n, l.p FROM l JOIN t USING (streak_type))
SELECT coalesce(lt.team, t.team) AS team, coalesce(lt.streak_type, t.streak_type) AS streak_type,
  coalesce(lt.n, t.n) AS n, coalesce(lt.p, 0.0::DOUBLE) AS league_p, coalesce(t.p, 0.0::DOUBLE) AS team_p
FROM lt FULL JOIN t ON lt.team = t.team AND lt.streak_type = t.streak_type AND lt.n = t.n"""
ORACLE["tail_steps_vs_league"] = f"""WITH by_length AS ({ORACLE["tail_curve_vs_league"]}),
ends AS (
  SELECT team, streak_type, n, league_p, team_p FROM by_length
  QUALIFY (league_p, team_p) IS DISTINCT FROM lead((league_p, team_p)) OVER (PARTITION BY team, streak_type ORDER BY n))
SELECT team, streak_type, coalesce(lag(n) OVER (PARTITION BY team, streak_type ORDER BY n), 0) + 1 AS from_n, n AS to_n,
  league_p, team_p FROM ends"""
ORACLE["tail_heatmap"] = f"""WITH {LEAGUE}, {TYPES}
SELECT streak_type, label, n, CASE WHEN n > 20 THEN CAST(((n - 1) // 5) * 5 + 1 AS VARCHAR) || '-' || CAST(((n - 1) // 5) * 5 + 5 AS VARCHAR)
  ELSE CAST(n AS VARCHAR) END AS bucket, p, CAST(type_rank AS BIGINT) AS sort_key
FROM league JOIN types USING (streak_type) WHERE pg = 'ALL'"""
ORACLE["tail_summary"] = f"""WITH {LEAGUE}
SELECT pg, streak_type, n, p, longest FROM (SELECT *, max(n) OVER (PARTITION BY pg, streak_type) AS longest FROM league) WHERE n <= 10"""
ORACLE["tail_summary_all"] = ORACLE["tail_summary"].removesuffix(" WHERE n <= 10")
ORACLE["tail_team_overview_all"] = f"""WITH {LOGS}, {HITS}, {PLAYERS}, {TEAM}
SELECT team, streak_type, max(n) AS longest FROM team_curve WHERE pg = 'ALL' GROUP BY ALL"""
ORACLE["tail_team_overview"] = f"""WITH {LOGS}, {HITS}, {PLAYERS}, {TEAM}
SELECT team, streak_type, max(n) AS longest FROM team_curve WHERE pg = 'ALL'
  AND team IN (SELECT DISTINCT team FROM team_curve ORDER BY team LIMIT 5) GROUP BY ALL"""
ORACLE["career_best_hist"] = f"WITH {RUNS}, {BEST} {_hist('best', 'career_max', '2.0::DOUBLE', 'streak_type')}"
ORACLE["career_best_summary"] = f"""WITH {RUNS}, {BEST}
SELECT streak_type, round_even(avg(career_max), 6) AS mean, round_even(stddev_samp(career_max), 6) AS std, max(career_max) AS highest,
  count(*) AS n, round_even(quantile_cont(career_max::DOUBLE, 0.5), 6) AS median FROM best GROUP BY streak_type"""

# --- possession ---------------------------------------------------------------------


def _clock(s: str) -> str:
    return f"CAST(({s}) // 60 AS VARCHAR) || ':' || lpad(CAST(({s}) % 60 AS VARCHAR), 2, '0')"


ICE = """ice AS (
  SELECT event_id, ts, user_id, event_type, value, day(ts) * 1000000::BIGINT + user_id // 30 AS game_id,
    CAST(1 + hour(ts) // 8 AS INTEGER) AS period,
    CAST((hour(ts) % 8) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS sec FROM events),
shifts AS (
  SELECT game_id, event_id AS shift_id, user_id AS player_id, 'Player ' || CAST(user_id AS VARCHAR) AS player_name,
    CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS team_abbr, period, sec AS start_sec,
    CAST(least(28800, sec + floor(value * 60)) AS INTEGER) AS end_sec FROM ice),
shots AS (
  SELECT game_id, event_id, period, sec AS t,
    CASE event_type WHEN 'click' THEN 'shot-on-goal' WHEN 'view' THEN 'missed-shot' WHEN 'error' THEN 'blocked-shot'
      WHEN 'purchase' THEN 'goal' ELSE 'faceoff' END AS type_desc_key,
    CASE WHEN event_id % 5 < 4 THEN '1551' ELSE '1541' END AS situation_code,
    CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS shooter_raw,
    CASE WHEN event_type = 'purchase' THEN shooter_raw ELSE nullif(shooter_raw, 0) END AS shooter  -- a shooting id of 0 is missing
  FROM ice),
game_dim AS (SELECT game_id, CAST(2021 + (day(min(ts)) - 1) // 10 AS VARCHAR) || CAST(2022 + (day(min(ts)) - 1) // 10 AS VARCHAR) AS season
  FROM ice GROUP BY game_id)"""


def _possession(where: str = "") -> str:
    return f"""{ICE},
sh AS (SELECT * FROM shifts {where}), ev5 AS (SELECT * FROM shots {where}{' AND' if where else ' WHERE'} situation_code = '1551'),
side AS (SELECT game_id, team_abbr, row_number() OVER (PARTITION BY game_id ORDER BY min(shift_id)) AS rk FROM sh GROUP BY game_id, team_abbr),
gm AS (SELECT a.game_id, a.team_abbr AS team_1, b.team_abbr AS team_2 FROM side a JOIN side b USING (game_id)
  WHERE a.rk = 1 AND b.rk = 2 AND a.game_id IN (SELECT game_id FROM ev5)),
on_ice AS (
  SELECT DISTINCT e.event_id, e.game_id, e.period, e.t, e.type_desc_key, e.shooter, s.team_abbr, s.player_id
  FROM ev5 e JOIN sh s ON s.game_id = e.game_id AND s.period = e.period AND e.t BETWEEN s.start_sec AND s.end_sec
  WHERE e.type_desc_key <> 'faceoff'),
shooting AS (SELECT event_id, min(team_abbr) AS shooter_team FROM on_ice WHERE player_id = shooter GROUP BY event_id),
credit AS (
  SELECT o.*, x.shooter_team, CASE WHEN x.shooter_team = gm.team_1 THEN gm.team_2 ELSE gm.team_1 END AS opposing_team
  FROM on_ice o JOIN shooting x USING (event_id) JOIN gm USING (game_id)),
tally AS (
  SELECT game_id, player_id,
    count(*) FILTER (team_abbr = shooter_team) AS cf, count(*) FILTER (team_abbr = opposing_team) AS ca,
    count(*) FILTER (team_abbr = shooter_team AND type_desc_key <> 'blocked-shot') AS ff,
    count(*) FILTER (team_abbr = opposing_team AND type_desc_key <> 'blocked-shot') AS fa
  FROM credit GROUP BY ALL),
per_game AS (
  SELECT s.game_id, s.player_id, arg_min(team_abbr, shift_id) AS team, arg_min(player_name, shift_id) AS player_name,
    CAST(sum(end_sec - start_sec) AS BIGINT) AS toi_seconds, coalesce(any_value(cf), 0) AS cf, coalesce(any_value(ca), 0) AS ca,
    coalesce(any_value(ff), 0) AS ff, coalesce(any_value(fa), 0) AS fa
  FROM sh s JOIN gm USING (game_id) LEFT JOIN tally USING (game_id, player_id) GROUP BY s.game_id, s.player_id),
season AS (
  SELECT player_id, arg_max(player_name, game_id) AS player_name, arg_max(team, game_id) AS team, count(*) AS gp,
    CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(ff) AS BIGINT) AS ff, CAST(sum(fa) AS BIGINT) AS fa,
    CAST(sum(toi_seconds) AS BIGINT) AS toi_seconds
  FROM per_game GROUP BY player_id),
season_pct AS (
  SELECT *, CASE WHEN cf + ca > 0 THEN round_even(cf / (cf + ca) * 100, 1) ELSE 0 END AS cf_pct,
    CASE WHEN ff + fa > 0 THEN round_even(ff / (ff + fa) * 100, 1) ELSE 0 END AS ff_pct,
    CASE WHEN toi_seconds > 0 THEN round_even(cf / (toi_seconds / 60.0::DOUBLE) * 60, 2) ELSE 0 END AS cf_per_60,
    CASE WHEN toi_seconds > 0 THEN round_even(ff / (toi_seconds / 60.0::DOUBLE) * 60, 2) ELSE 0 END AS ff_per_60 FROM season)"""


POSSESSION = _possession()
ORACLE["on_ice_events"] = f"""WITH {POSSESSION}
SELECT game_id, period, event_id, t, type_desc_key, shooter_team, opposing_team,
  count(*) FILTER (team_abbr = shooter_team) AS n_for, count(*) FILTER (team_abbr = opposing_team) AS n_against
FROM credit GROUP BY ALL"""
ORACLE["on_ice_at_time"] = f"""WITH {ICE} SELECT DISTINCT game_id, team_abbr, player_id FROM shifts
WHERE period = 2 AND 3600 BETWEEN start_sec AND end_sec"""
ORACLE["possession_game"] = f"""WITH {POSSESSION} SELECT *,
  CASE WHEN cf + ca > 0 THEN round_even(cf / (cf + ca) * 100, 1) ELSE 0 END AS cf_pct,
  CASE WHEN ff + fa > 0 THEN round_even(ff / (ff + fa) * 100, 1) ELSE 0 END AS ff_pct FROM per_game"""
ORACLE["possession_drilldown"] = f"""WITH {POSSESSION}
SELECT game_id, player_id, team, u.e AS event, u.k AS kind, u.c AS "count" FROM (
  SELECT *, unnest([{{'e': 'Corsi For', 'k': 'Corsi', 'c': cf}}, {{'e': 'Corsi Against', 'k': 'Corsi', 'c': ca}},
    {{'e': 'Fenwick For', 'k': 'Fenwick', 'c': ff}}, {{'e': 'Fenwick Against', 'k': 'Fenwick', 'c': fa}}]) AS u FROM per_game)"""
ORACLE["possession_season"] = f"WITH {POSSESSION} SELECT * FROM season_pct"
ORACLE["possession_one_season"] = (
    f"WITH {_possession(f'WHERE game_id IN (SELECT game_id FROM game_dim WHERE season = {SEASON})')} SELECT * FROM season_pct"
)
ORACLE["possession_leaderboard"] = f"""WITH {POSSESSION}, {PLAYERS}
SELECT s.*, p.position, round_even(toi_seconds / 60, 1) AS toi_min FROM season_pct s JOIN players p USING (player_id)
WHERE gp >= 10 AND p.position IN ('C', 'L', 'R', 'D')"""
ORACLE["possession_team"] = f"""WITH {POSSESSION}, t AS (
  SELECT team, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(ff) AS BIGINT) AS ff,
    CAST(sum(fa) AS BIGINT) AS fa, CAST(sum(toi_seconds) AS BIGINT) AS toi_seconds, CAST(round_even(avg(gp), 0) AS INTEGER) AS gp,
    count(player_id) AS players_count FROM season GROUP BY team)
SELECT *, CASE WHEN cf + ca > 0 THEN round_even(cf / (cf + ca) * 100, 1) ELSE 0 END AS cf_pct,
  CASE WHEN ff + fa > 0 THEN round_even(ff / (ff + fa) * 100, 1) ELSE 0 END AS ff_pct FROM t"""
_SHARES = """shares AS (SELECT 'cf_pct' AS measure, cf_pct AS share FROM season_pct UNION ALL SELECT 'ff_pct', ff_pct FROM season_pct)"""
ORACLE["possession_hist"] = f"WITH {POSSESSION}, {_SHARES} {_hist('shares', 'share', '2.0::DOUBLE', 'measure')}"
ORACLE["possession_summary"] = f"""WITH {POSSESSION}, {_SHARES}
SELECT measure, round_even(avg(share), 6) AS mean, round_even(stddev_samp(share), 6) AS std, max(share) AS highest, count(*) AS n,
  round_even(quantile_cont(share, 0.5), 6) AS median FROM shares GROUP BY measure"""
ORACLE["toi_totals"] = f"""WITH {ICE} SELECT player_id, CAST(sum(end_sec - start_sec) AS BIGINT) AS toi_seconds, count(*) AS n_shifts
FROM shifts GROUP BY player_id"""

# --- features ------------------------------------------------------------------------

# --- fixed values: statistics in the matrix -------------------------------------------
_STATS = (
    "goals", "assists", "points", "shots", "pim", "plus_minus", "power_play_goals",
    "blocked_shots", "hits", "giveaways", "takeaways", "shifts",
)
REG = f"{LOGS}, reg AS (SELECT * FROM logs WHERE game_type = 2)"


def _prior(season: str) -> str:
    rates = ", ".join(f"CAST(sum({c}) AS BIGINT) / count(*) AS prior_{c}_per_game" for c in _STATS)
    return f"""prior_season AS (SELECT player_id, max(season) AS season FROM reg WHERE season < {season} GROUP BY player_id),
prior AS (
  SELECT r.player_id, r.season AS prior_season_used, {rates},
    CAST(sum(toi_sec) AS BIGINT) / count(*) AS prior_toi_per_game,
    CASE WHEN sum(shots) > 0 THEN CAST(sum(goals) AS BIGINT) / CAST(sum(shots) AS BIGINT) ELSE 0 END AS prior_shoot_pct,
    round_even(avg(faceoff_pct), 6) AS prior_faceoff_pct, CAST(count(*) AS DOUBLE) AS prior_games_played,
    coalesce(avg(points) FILTER (home_road_flag = 'H'), 0) AS prior_home_pts_per_game,
    coalesce(avg(points) FILTER (home_road_flag = 'R'), 0) AS prior_road_pts_per_game
  FROM reg r JOIN prior_season USING (player_id, season) GROUP BY r.player_id, r.season)"""


def _momentum(season: str, source: str) -> str:
    return f"""mom_season AS (SELECT player_id, max(season) AS season FROM (
    SELECT player_id, season FROM {source} WHERE season < {season} GROUP BY ALL HAVING count(*) >= 10) GROUP BY player_id),
mom_rows AS (SELECT r.* FROM {source} r JOIN mom_season USING (player_id, season)
  QUALIFY row_number() OVER (PARTITION BY r.player_id ORDER BY game_date DESC, game_id DESC) <= 20),
momentum AS (SELECT player_id, CAST(sum(points) AS BIGINT) / count(*) AS momentum_pts_per_game,
  CAST(sum(goals) AS BIGINT) / count(*) AS momentum_goals_per_game, CAST(sum(shots) AS BIGINT) / count(*) AS momentum_shots_per_game
  FROM mom_rows GROUP BY player_id)"""


def _career(season: str) -> str:
    return f"""career AS (SELECT player_id, CAST(count(*) AS DOUBLE) AS career_games, CAST(sum(points) AS BIGINT) / count(*) AS career_pts_per_game,
  CAST(sum(goals) AS BIGINT) / count(*) AS career_goals_per_game, CAST(count(DISTINCT season) AS DOUBLE) AS career_seasons
  FROM reg WHERE season < {season} GROUP BY player_id)"""


def _strength(season: str, source: str) -> str:
    return f"""strength AS (SELECT team_abbr AS team, CAST(sum(goals) AS BIGINT) / count(*) AS team_offense,
  CAST(sum(plus_minus) AS BIGINT) / count(*) AS team_defense, CAST(sum(shots) AS BIGINT) / count(*) AS team_shots
  FROM {source} JOIN skaters USING (player_id)
  WHERE season = (SELECT max(season) FROM {source} JOIN skaters USING (player_id) WHERE season < {season}) GROUP BY team_abbr)"""


def _labels(season: str, min_games: int) -> str:
    return f"""labels AS (SELECT player_id, CAST(sum(points) AS BIGINT) AS target_pts, CAST(sum(goals) AS BIGINT) AS target_goals,
  count(*) AS target_games, arg_max(team_abbr, (game_date, game_id)) AS target_team,
  CAST(sum(points) AS BIGINT) / count(*) AS pts_per_game, CAST(sum(goals) AS BIGINT) / count(*) AS goals_per_game
  FROM reg WHERE season = {season} GROUP BY player_id HAVING count(*) >= {min_games})"""


ORACLE["base_logs"] = f"""WITH {LOGS}, {PLAYERS}
SELECT game_id, player_id, season, team_abbr, points, position, shoots_catches, birth_date
FROM logs JOIN players USING (player_id) WHERE game_type = 2 AND position <> 'G'"""
ORACLE["prior_season_features"] = f"WITH {REG}, {_prior(SEASON)} SELECT * FROM prior"
ORACLE["momentum"] = f"WITH {LOGS}, {_momentum(SEASON, 'logs')} SELECT * FROM momentum"
ORACLE["career_features"] = f"WITH {REG}, {_career(SEASON)} SELECT * FROM career"
ORACLE["team_strength"] = f"WITH {LOGS}, {PLAYERS}, {_strength(SEASON, 'logs')} SELECT * FROM strength"
ORACLE["target_labels"] = f"WITH {REG}, {_labels(SEASON, 20)} SELECT * FROM labels"


def _rows_of(season: str) -> str:
    return f"""(WITH {_prior(season)}, {_momentum(season, 'reg')}, {_career(season)}, {_strength(season, 'reg')}, {_labels(season, 10)}
SELECT l.player_id, {season} AS season, p.position, s.pg AS position_group, p.shoots_catches,
  CAST(date_diff('year', CAST(birth_date AS DATE), DATE '{season[1:5]}-10-01')
    - CASE WHEN month(CAST(birth_date AS DATE)) * 100 + day(CAST(birth_date AS DATE)) > 1001 THEN 1 ELSE 0 END AS DOUBLE) AS age,
  prior.* EXCLUDE (player_id), momentum.* EXCLUDE (player_id), coalesce(career_games, 0) AS career_games,
  coalesce(career_pts_per_game, 0) AS career_pts_per_game, coalesce(career_goals_per_game, 0) AS career_goals_per_game,
  coalesce(career_seasons, 0) AS career_seasons, team_offense, team_defense, team_shots, l.pts_per_game, l.goals_per_game,
  l.target_games, l.target_team
FROM labels l JOIN players p USING (player_id) JOIN skaters s USING (player_id)
LEFT JOIN prior USING (player_id) LEFT JOIN momentum USING (player_id) LEFT JOIN career USING (player_id)
LEFT JOIN strength ON strength.team = l.target_team)"""


ORACLE["feature_matrix"] = f"WITH {REG}, {PLAYERS} SELECT * FROM {_rows_of(SEASON)}"
_NEXT = "'20242025'"
ORACLE["feature_matrix_future"] = f"""WITH {REG}, {PLAYERS}, {_prior(_NEXT)}, {_momentum(_NEXT, 'reg')}, {_career(_NEXT)}, {_strength(_NEXT, 'reg')},
known AS (SELECT player_id, arg_max(team_abbr, (season, game_date, game_id)) AS target_team FROM reg WHERE season < {_NEXT} GROUP BY player_id)
SELECT k.player_id, {_NEXT} AS season, p.position,
  CAST(date_diff('year', CAST(birth_date AS DATE), DATE '2024-10-01')
    - CASE WHEN month(CAST(birth_date AS DATE)) * 100 + day(CAST(birth_date AS DATE)) > 1001 THEN 1 ELSE 0 END AS DOUBLE) AS age,
  k.target_team, prior_season_used, prior_points_per_game, momentum_pts_per_game, coalesce(career_games, 0) AS career_games,
  team_offense, CAST(NULL AS DOUBLE) AS pts_per_game
FROM known k JOIN players p USING (player_id) JOIN skaters USING (player_id)
LEFT JOIN prior USING (player_id) LEFT JOIN momentum USING (player_id) LEFT JOIN career USING (player_id)
LEFT JOIN strength ON strength.team = k.target_team"""

# --- forecasts -------------------------------------------------------------------------

ORDERS = """proj AS (
  SELECT o_orderkey AS projection_id, 'Customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS player_name,
    o_orderstatus AS team, o_orderpriority AS source, CAST(year(o_orderdate) * 10000 + year(o_orderdate) + 1 AS INTEGER) AS season_id,
    o_totalprice / 1000.0::DOUBLE AS projected_points, 'customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS match_key FROM orders),
act AS (
  SELECT o_orderkey AS entry_id, 'Customer' AS first_name, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS last_name,
    o_orderstatus AS team, games_played, units / 10000000.0::DOUBLE AS points,
    CAST(year(o_orderdate) * 10000 + year(o_orderdate) + 1 AS INTEGER) AS season_id, 'customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS match_key
  FROM (SELECT l_orderkey, count(*) AS games_played,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS units
    FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey),
"""
BACKTEST = """best_act AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY season_id, match_key ORDER BY points DESC, team, entry_id) = 1),
matched AS (
  SELECT p.season_id, p.projection_id, p.player_name, p.team, p.source, p.projected_points, b.points AS actual_points,
    b.games_played, b.team AS team_actual, p.projected_points - b.points AS error, abs(p.projected_points - b.points) AS abs_error
  FROM proj p LEFT JOIN best_act b ON b.season_id = p.season_id AND b.match_key = p.match_key
  WHERE p.season_id IN (SELECT season_id FROM act)),
known AS (SELECT * FROM matched WHERE actual_points IS NOT NULL),
metrics AS (
  SELECT source, season_id, count(*) AS n_players, round_even(avg(abs_error), 2) AS mae, round_even(sqrt(avg(error * error)), 2) AS rmse,
    round_even(corr(projected_points, actual_points), 4) AS correlation,
    round_even(count(*) FILTER (abs_error <= 5) / count(*) * 100, 1) AS within_5_pct,
    round_even(count(*) FILTER (abs_error <= 10) / count(*) * 100, 1) AS within_10_pct,
    round_even(count(*) FILTER (abs_error <= 15) / count(*) * 100, 1) AS within_15_pct,
    round_even(avg(error), 2) AS mean_bias, round_even(quantile_cont(abs_error, 0.5), 2) AS median_ae
  FROM known GROUP BY source, season_id HAVING count(*) >= 5)"""
ORDERS += BACKTEST

ORACLE["best_actuals"] = f"WITH {ORDERS} SELECT * FROM best_act"
ORACLE["forecast_matched"] = f"WITH {ORDERS} SELECT * FROM matched"
ORACLE["forecast_metrics"] = f"WITH {ORDERS} SELECT * FROM metrics"
ORACLE["forecast_ranking"] = f"""WITH {ORDERS} SELECT source, {", ".join(
    f"round_even(avg({c}), 4) AS {c}" for c in ("mae", "median_ae", "rmse", "correlation", "within_10_pct", "mean_bias", "n_players"))}
FROM metrics GROUP BY source"""
ORACLE["forecast_error_stats"] = f"""WITH {ORDERS} SELECT source, round_even(avg(error), 4) AS mean, round_even(stddev_samp(error), 4) AS std,
  count(*) AS n, round_even(quantile_cont(error, 0.5), 4) AS median FROM known GROUP BY source"""
ORACLE["forecast_box"] = f"""WITH {ORDERS} SELECT source, round_even(min(abs_error), 4) AS lowest, round_even(quantile_cont(abs_error, 0.25), 4) AS q1,
  round_even(quantile_cont(abs_error, 0.5), 4) AS mid, round_even(quantile_cont(abs_error, 0.75), 4) AS q3, round_even(max(abs_error), 4) AS highest
FROM known GROUP BY source"""
ORACLE["forecast_hist"] = f"WITH {ORDERS} {_hist('known', 'error', '25.0::DOUBLE', 'source')}"
_SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORACLE["forecast_pivot"] = f"""WITH {ORDERS} SELECT player_name, season_id, {", ".join(
    f"min(projected_points) FILTER (source = '{s}') AS \"{s}\"" for s in _SOURCES)},
  max(actual_points) AS "Actual" FROM matched GROUP BY ALL"""
ORACLE["forecast_with_actual"] = f"""WITH {ORDERS}, rows_ AS (
  SELECT player_name, season_id, source, projected_points AS points FROM matched
  UNION ALL SELECT player_name, season_id, 'Actual', max(actual_points) FROM known GROUP BY ALL)
SELECT *, CAST(season_id // 10000 AS VARCHAR) || '-' || CAST(season_id % 10000 AS VARCHAR) AS season_label FROM rows_"""
ORACLE["match_rate"] = f"""WITH {ORDERS} SELECT (SELECT count(*) FROM proj) AS projections, (SELECT count(*) FROM known) AS matched,
  round_even((SELECT count(*) FROM known) * 100 / (SELECT count(*) FROM proj), 1) AS match_rate"""
ORACLE["unpivot_sources"] = f"""WITH {ORDERS}, wide AS (
  SELECT player_name, season_id, source AS s, max(projected_points - 50) AS v FROM proj GROUP BY ALL)
SELECT player_name, season_id, CASE s WHEN '1-URGENT' THEN 'Hockey Le Magazine' WHEN '2-HIGH' THEN 'PoolPro'
  WHEN '3-MEDIUM' THEN 'Sports Forecaster' ELSE 'Fantrax' END AS source, CAST(trunc(v) AS INTEGER) AS projected_points
FROM wide WHERE s <> '5-LOW' AND v > 0"""

# --- two models --------------------------------------------------------------------------

COMPARISON = f"""{REG}, {PLAYERS}, {_prior(SEASON)}, {_labels(SEASON, 10)},
ext AS (
  SELECT player_id, count(*) AS games_played, CAST(sum(k) AS BIGINT) / 200.0::DOUBLE AS xgoals,
    CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(points) AS BIGINT) AS points, arg_max(team_abbr, (game_date, game_id)) AS team
  FROM reg JOIN (SELECT event_id AS game_id, k FROM ev) USING (game_id) WHERE season = {SEASON} GROUP BY player_id HAVING count(*) >= 10),
cmp0 AS (
  SELECT p.first_name || ' ' || p.last_name AS player_name, e.team, x.position, l.target_games AS gp_ours, e.games_played AS gp_external,
    l.pts_per_game AS actual_pts_per_game, l.goals_per_game AS actual_goals_per_game, prior.prior_points_per_game AS our_pts_per_game,
    e.xgoals AS external_xgoals, e.xgoals / e.games_played AS external_xgoals_per_game, e.goals AS external_goals, e.points AS external_points
  FROM labels l JOIN players p USING (player_id) LEFT JOIN prior USING (player_id)
  JOIN players x ON lower(p.first_name || ' ' || p.last_name) = lower(x.first_name || ' ' || x.last_name)
  JOIN ext e ON e.player_id = x.player_id),
cmp AS (
  SELECT *, actual_pts_per_game - our_pts_per_game AS our_error, actual_goals_per_game - external_xgoals_per_game AS external_error,
    abs(actual_pts_per_game - our_pts_per_game) AS our_abs_error, abs(actual_goals_per_game - external_xgoals_per_game) AS external_abs_error,
    CASE WHEN abs(actual_pts_per_game - our_pts_per_game) < abs(actual_goals_per_game - external_xgoals_per_game) THEN 'ours' ELSE 'external' END AS more_accurate
  FROM cmp0)"""


def _fit(source: str, key: str) -> str:
    return f"""SELECT {key}, round_even(avg(abs(a - p)), 6) AS mae, round_even(sqrt(avg((a - p) * (a - p))), 6) AS rmse,
  round_even(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) AS r2, round_even(corr(a, p), 6) AS corr,
  round_even(max(abs(a - p)), 6) AS max_error, count(*) AS n FROM {source} WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY {key}"""


ORACLE["head_to_head"] = f"WITH {COMPARISON} SELECT * FROM cmp"
ORACLE["model_metrics"] = f"""WITH {COMPARISON}, long AS (
  SELECT 'ours' AS model, actual_pts_per_game AS a, our_pts_per_game AS p FROM cmp
  UNION ALL SELECT 'external', actual_goals_per_game, external_xgoals_per_game FROM cmp) {_fit('long', 'model')}"""
ORACLE["win_counts"] = f"""WITH {COMPARISON}, w AS (SELECT count(*) FILTER (more_accurate = 'ours') AS our_wins,
  count(*) FILTER (more_accurate = 'external') AS external_wins, count(*) AS total FROM cmp)
SELECT *, round_even(our_wins * 100 / total, 1) AS our_share, round_even(external_wins * 100 / total, 1) AS external_share FROM w"""
_ERRORS = "errs AS (SELECT 'ours' AS model, our_error AS error FROM cmp UNION ALL SELECT 'external', external_error FROM cmp)"
ORACLE["model_error_stats"] = f"""WITH {COMPARISON}, {_ERRORS}
SELECT model, round_even(avg(error), 6) AS mean_error, round_even(stddev_samp(error), 6) AS std_error FROM errs GROUP BY model"""
ORACLE["model_error_hist"] = f"WITH {COMPARISON}, {_ERRORS} {_hist('errs', 'error', '0.1::DOUBLE', 'model', 'WHERE error IS NOT NULL')}"
ORACLE["top_disagreement"] = f"""WITH {COMPARISON} SELECT player_name, team, position, our_pts_per_game, external_xgoals_per_game,
  abs(our_pts_per_game - external_xgoals_per_game) AS disagreement FROM cmp WHERE our_pts_per_game IS NOT NULL
ORDER BY disagreement DESC, player_name LIMIT 30"""
ORACLE["most_accurate"] = f"""WITH {COMPARISON} SELECT player_name, team, position, our_abs_error, external_abs_error, more_accurate
FROM cmp WHERE position IN ('C', 'L', 'R') AND external_abs_error IS NOT NULL ORDER BY external_abs_error, player_name LIMIT 30"""
ORACLE["residual_percentiles"] = f"""WITH {COMPARISON}, r AS (SELECT our_error AS e FROM cmp WHERE our_error IS NOT NULL)
SELECT round_even(avg(e), 6) AS mean_residual, round_even(stddev_pop(e), 6) AS std_residual, round_even(min(e), 6) AS min_residual,
  round_even(max(e), 6) AS max_residual, {", ".join(f"round_even(quantile_cont(abs(e), 0.{q}), 6) AS p{q}" for q in (50, 75, 90, 95))} FROM r"""
ORACLE["fit_by_position"] = f"""WITH {COMPARISON}, g AS (SELECT CASE WHEN position IN ('C', 'L', 'R') THEN 'F' WHEN position = 'D' THEN 'D' ELSE 'ALL' END AS pg,
  actual_pts_per_game AS a, our_pts_per_game AS p FROM cmp) {_fit('g', 'pg')}"""

# --- reports ------------------------------------------------------------------------------

WAREHOUSE = f"{LOGS}, {PLAYERS}, {TEAM_SEASONS}"
ORACLE["current_team"] = f"""WITH {WAREHOUSE} SELECT player_id, first_name, last_name, position, current_team, season
FROM players JOIN current_team USING (player_id)"""
ORACLE["player_info"] = f"""WITH {WAREHOUSE} SELECT player_id, first_name, last_name, position, current_team AS team
FROM players LEFT JOIN current_team USING (player_id)"""
_TOTALS = """totals AS (SELECT player_id, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists,
  CAST(sum(points) AS BIGINT) AS points, count(*) AS games FROM logs GROUP BY player_id)"""
ORACLE["player_totals"] = f"WITH {LOGS}, {_TOTALS} SELECT * FROM totals"
ORACLE["player_log"] = f"""WITH {LOGS} SELECT player_id, game_id, game_date AS date, team_abbr AS team, opponent_abbr AS opp, goals AS g,
  assists AS a, points AS pts, shots AS s, pim, plus_minus, time_on_ice AS toi, shifts, blocked_shots AS bs, giveaways AS ga,
  takeaways AS tk, faceoff_pct AS fo_pct FROM logs"""
ORACLE["top_scorers"] = f"""WITH {WAREHOUSE}, {_TOTALS}
SELECT t.*, first_name || ' ' || last_name AS player, current_team AS team FROM totals t JOIN players USING (player_id)
LEFT JOIN current_team USING (player_id) ORDER BY points DESC, player_id LIMIT 20"""
_REPORT = """report AS (SELECT season, CASE game_type WHEN 2 THEN 'Reg' WHEN 3 THEN 'PO' ELSE CAST(game_type AS VARCHAR) END AS type,
  game_date AS date, first_name || ' ' || last_name AS player, team_abbr AS team, opponent_abbr AS opp, home_road_flag AS h_r,
  goals AS g, assists AS a, points AS pts, shots AS s, pim, plus_minus, time_on_ice AS toi, shifts, power_play_goals AS ppg,
  shorthanded_goals AS shg, game_winning_goals AS gwg, blocked_shots AS bs, giveaways AS ga, takeaways AS tk, faceoff_pct AS fo_pct
  FROM logs JOIN players USING (player_id) WHERE team_abbr IN ('click', 'purchase', 'view')
    AND season IN ('20222023', '20232024') AND game_type IN (2, 3)
  ORDER BY game_date DESC, points DESC, game_id, player_id)"""
ORACLE["game_log_filtered"] = f"WITH {LOGS}, {PLAYERS}, {_REPORT[:-1]} LIMIT 500) SELECT * FROM report"
ORACLE["game_log_by_date"] = f"""WITH {LOGS}, {PLAYERS}
SELECT game_id, player_id, first_name || ' ' || last_name AS player, season, CAST(game_date AS DATE) AS game_date, team_abbr, points
FROM logs JOIN players USING (player_id)
WHERE CAST(game_date AS DATE) BETWEEN DATE '2024-01-22' AND DATE '2024-01-25' AND season = {SEASON}"""
ORACLE["daily_totals"] = f"""WITH {LOGS}, {PLAYERS}, {_REPORT}
SELECT CAST(date AS DATE) AS date, CAST(sum(g) AS BIGINT) AS goals, CAST(sum(pts) AS BIGINT) AS points FROM report GROUP BY 1"""
ORACLE["player_search"] = f"""WITH {WAREHOUSE} SELECT player_id, first_name || ' ' || last_name AS name, position AS pos, current_team AS team,
  sweater_number AS number, birth_date AS born, shoots_catches AS shoots FROM players LEFT JOIN current_team USING (player_id)
WHERE first_name || ' ' || last_name ILIKE '%ER 00000001%'"""
ORACLE["player_search_first"] = f"""WITH {WAREHOUSE} SELECT player_id, first_name || ' ' || last_name AS name, position AS pos, current_team AS team,
  sweater_number AS number, birth_date AS born, shoots_catches AS shoots FROM players LEFT JOIN current_team USING (player_id)
WHERE first_name || ' ' || last_name ILIKE '%er%' ORDER BY last_name, first_name, player_id LIMIT 10"""
ORACLE["stat_coverage"] = f"""WITH {LOGS} SELECT count(*) FILTER (blocked_shots > 0) AS with_blocked_shots,
  count(*) FILTER (giveaways > 0) AS with_giveaways, count(*) FILTER (takeaways > 0) AS with_takeaways,
  count(faceoff_pct) AS with_faceoff_pct, count(*) AS total_records FROM logs"""
ORACLE["date_range"] = f"WITH {LOGS} SELECT min(game_date) AS min_date, max(game_date) AS max_date FROM logs"
ORACLE["type_counts"] = f"""WITH {LOGS} SELECT game_type, count(*) AS n,
  CASE game_type WHEN 2 THEN 'Regular Season' WHEN 3 THEN 'Playoffs' ELSE 'Other (' || CAST(game_type AS VARCHAR) || ')' END AS label
FROM logs GROUP BY game_type"""
ORACLE["players_by_team"] = f"WITH {LOGS}, {TEAM_SEASONS} SELECT current_team AS team, count(*) AS players FROM current_team GROUP BY 1"
ORACLE["distinct_lists"] = f"""WITH {LOGS} SELECT DISTINCT 'season' AS field, season AS value FROM logs
UNION ALL SELECT DISTINCT 'team_abbr', team_abbr FROM logs UNION ALL SELECT DISTINCT 'game_type', CAST(game_type AS VARCHAR) FROM logs"""
ORACLE["games_distinct_players"] = f"WITH {ICE} SELECT game_id, count(DISTINCT player_id) AS players FROM shifts GROUP BY game_id"
ORACLE["warehouse_state"] = f"""WITH {WAREHOUSE} SELECT 'players' AS table_name, 'rows' AS counter, count(*) AS value FROM players
UNION ALL SELECT 'team_seasons', 'rows', count(*) FROM team_seasons UNION ALL SELECT 'game_logs', 'rows', count(*) FROM logs
UNION ALL SELECT 'game_logs', 'regular_season', count(*) FROM logs WHERE game_type = 2
UNION ALL SELECT 'game_logs', 'playoffs', count(*) FROM logs WHERE game_type = 3
UNION ALL SELECT 'game_logs', 'seasons', count(DISTINCT season) FROM logs
UNION ALL SELECT 'game_logs', 'players', count(DISTINCT player_id) FROM logs
UNION ALL SELECT 'events', 'rows', count(*) FROM events
UNION ALL SELECT 'events', 'games', count(DISTINCT day(ts) * 1000000 + user_id // 30) FROM events
UNION ALL SELECT 'shifts', 'rows', count(*) FROM events"""

# --- table maintenance -----------------------------------------------------------------------

_ITEM = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
ORACLE["upsert_latest"] = f"""WITH b AS (SELECT {_ITEM}, CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN '-' ELSE l_returnflag END AS l_returnflag,
  l_shipdate, l_shipdate >= TIMESTAMP '1999-01-01' AS late FROM lineitem)
SELECT * EXCLUDE (late) FROM b QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY late DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1"""
ORACLE["known_only"] = f"""SELECT {_ITEM}, l_returnflag, l_shipdate FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
ORACLE["orphans"] = """SELECT o_custkey, o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal > 0 AND c.c_custkey = o.o_custkey)"""
ORACLE["skip_existing"] = f"""WITH {LOGS} SELECT player_id, season, game_id, points FROM logs l
WHERE NOT EXISTS (SELECT 1 FROM logs m WHERE m.game_type = 3 AND m.player_id = l.player_id AND m.season = l.season)"""
ORACLE["first_seen_games"] = f"""WITH {ICE} SELECT game_id, team_abbr, shift_id FROM shifts
QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY team_abbr, shift_id) = 1"""
ORACLE["distinct_games"] = f"WITH {ICE} SELECT game_id FROM shots UNION SELECT game_id FROM shifts"
ORACLE["missing_seasons"] = f"WITH {ORDERS} SELECT season_id FROM proj EXCEPT SELECT season_id FROM act WHERE season_id < 19982000"
ORACLE["games_in_both"] = f"""WITH {ICE} SELECT game_id FROM shots WHERE situation_code = '1551'
INTERSECT SELECT game_id FROM shifts WHERE end_sec - start_sec > 1200"""
_ZEROS = (
    "shots", "pim", "plus_minus", "shifts", "power_play_goals", "power_play_points", "shorthanded_goals",
    "game_winning_goals", "ot_goals", "blocked_shots", "hits", "giveaways", "takeaways", "assists",
)
ORACLE["evolved_logs"] = f"""WITH {LOGS} SELECT game_id, player_id, '20232024' AS season, 2 AS game_type,
  CAST(CAST(game_date AS DATE) AS VARCHAR) AS game_date, team_abbr, CAST(NULL AS VARCHAR) AS opponent_abbr,
  CAST(NULL AS VARCHAR) AS home_road_flag, goals, points, CAST(NULL AS VARCHAR) AS time_on_ice,
  CAST(NULL AS DOUBLE) AS faceoff_pct, {", ".join(f"0 AS {c}" for c in _ZEROS)} FROM logs"""

# --- scalar rules --------------------------------------------------------------------------------


def _cycle(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][c_custkey % {len(values)} + 1]"


ORACLE["normalise_codes"] = f"""WITH r AS (SELECT c_custkey, {_cycle(["FLO", "tb ", " SJ", "la", "WIN", "clb", "EDM", ""])} AS raw_team,
  {_cycle(["HM", " pp", "FOR", "hn", "Mystery", "the athletic "])} AS raw_source FROM customer)
SELECT *, CASE upper(trim(raw_team)) WHEN 'FLO' THEN 'FLA' WHEN 'TB' THEN 'TBL' WHEN 'SJ' THEN 'SJS' WHEN 'LA' THEN 'LAK'
    WHEN 'WIN' THEN 'WPG' WHEN 'CLB' THEN 'CBJ' ELSE upper(trim(raw_team)) END AS team,
  CASE lower(trim(raw_source)) WHEN 'hm' THEN 'Hockey Le Magazine' WHEN 'pp' THEN 'PoolPro' WHEN 'for' THEN 'Sports Forecaster'
    WHEN 'hn' THEN 'Hockey News' WHEN 'the athletic' THEN 'The Athletic' ELSE trim(raw_source) END AS source FROM r"""
_HEADERS = ["HM", "HM.1", "Rang", "MOY", "Unnamed: 3", "Colonne7", "Age", "ESPN2", "ESPN", "moy.2", "Lepool.com", "Ville"]
ORACLE["source_columns"] = f"""WITH r AS (SELECT c_custkey, {_cycle(_HEADERS)} AS header FROM customer)
SELECT *, header IN ('HM', 'ESPN', 'Lepool.com', 'Ville') AS is_source FROM r"""
ORACLE["split_names"] = """WITH n AS (SELECT 'part' AS origin, p_partkey, p_name || ' ' || p_type AS name FROM part
  UNION ALL SELECT 'customer', c_custkey, c_mktsegment FROM customer),
s AS (SELECT origin, p_partkey, CASE WHEN name LIKE '% %' THEN split_part(name, ' ', 1) ELSE '' END AS first_name,
  CASE WHEN name LIKE '% %' THEN substr(name, position(' ' IN name) + 1) ELSE name END AS last_name FROM n)
SELECT *, lower(first_name) || ' ' || lower(last_name) AS match_key FROM s"""
ORACLE["safe_casts"] = f"""WITH {EV}, r AS (SELECT event_id, k, CASE WHEN k % 5 < 2 THEN NULL ELSE k END AS v FROM ev)
SELECT event_id, coalesce(v, 0) AS as_int, coalesce(v, -1) AS as_int_or, nullif(CAST(k AS DOUBLE), 0.0::DOUBLE) AS as_double,
  coalesce(v, 0) AS as_count, k BETWEEN 10 AND 99 AS season_ok FROM r"""
ORACLE["clock_and_age"] = f"""WITH {PLAYERS}, b AS (SELECT *, CAST(birth_date AS DATE) AS born FROM players)
SELECT player_id, CAST(CASE WHEN player_id % 7 IN (0, 1) THEN 0 ELSE sweater_number * 60 + player_id % 70 END AS INTEGER) AS seconds,
  CAST(2023 - year(born) - CASE WHEN month(born) * 100 + day(born) > 1001 THEN 1 ELSE 0 END AS DOUBLE) AS age,
  CASE WHEN month(born) >= 7 THEN CAST(year(born) AS VARCHAR) || CAST(year(born) + 1 AS VARCHAR)
    ELSE CAST(year(born) - 1 AS VARCHAR) || CAST(year(born) AS VARCHAR) END AS birth_season,
  CASE WHEN player_id % 60 + 1 > 20 THEN CAST((player_id % 60) // 5 * 5 + 1 AS VARCHAR) || '-' || CAST((player_id % 60) // 5 * 5 + 5 AS VARCHAR)
    ELSE CAST(player_id % 60 + 1 AS VARCHAR) END AS bucket FROM b"""
ORACLE["regex_records"] = """SELECT c_custkey, CAST(c_custkey + s AS INTEGER) AS rank, 'Éric' AS first_name, 'St-Jean' AS last_name,
  substr(c_mktsegment, 1, 3) AS team, CAST((c_custkey + s) % 97 AS INTEGER) AS value_1, CAST((c_custkey + s) % 89 AS INTEGER) AS value_2,
  CAST((c_custkey + s) % 83 AS INTEGER) AS value_3, CAST((c_custkey + s) % 79 AS INTEGER) AS value_4, '41,5' AS mean
FROM customer, (VALUES (0), (100000)) v(s)"""

# --- nested documents: the flat source is the expected result --------------------------------------

ORACLE["boxscore_flatten"] = f"""WITH {LOGS}, own AS (
  SELECT game_id, player_id, season, game_type, CAST(CAST(game_date AS DATE) AS VARCHAR) AS game_date, team_abbr, opponent_abbr,
    home_road_flag, goals, assists, points, shots, pim, plus_minus, time_on_ice, shifts, power_play_goals, 0 AS power_play_points,
    0 AS shorthanded_goals, 0 AS game_winning_goals, 0 AS ot_goals, blocked_shots, hits, giveaways, takeaways, faceoff_pct FROM logs)
SELECT * FROM own UNION ALL SELECT game_id, player_id + 2000000, season, game_type, game_date, opponent_abbr, team_abbr,
  CASE WHEN home_road_flag = 'H' THEN 'R' ELSE 'H' END, 0, 0, 0, 0, 2, 0, '60:00', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, NULL FROM own"""
ORACLE["roster_flatten"] = f"""WITH {PLAYERS} SELECT player_id, first_name, last_name, position, sweater_number, shoots_catches, birth_date,
  position AS team_abbr, {SEASON} AS season FROM players
UNION ALL SELECT player_id + 1000000, '', 'Plain', '', NULL, '', '', position, {SEASON} FROM players"""
ORACLE["schedule_flatten"] = f"""WITH {ICE} SELECT min(team_abbr) AS team_abbr, game_id, 2 AS game_type, '2024-01-01' AS game_date,
  'A' AS away_abbr, 'B' AS home_abbr FROM shifts GROUP BY game_id"""
ORACLE["game_log_flatten"] = f"""WITH {LOGS} SELECT game_id, player_id, season, game_type, CAST(CAST(game_date AS DATE) AS VARCHAR) AS game_date,
  team_abbr, CASE WHEN shots > 2 THEN opponent_abbr ELSE '' END AS opponent_abbr, '' AS home_road_flag, time_on_ice, goals, assists, points,
  shots, 0 AS pim, 0 AS plus_minus, 0 AS shifts, 0 AS power_play_goals, 0 AS power_play_points, 0 AS shorthanded_goals,
  0 AS game_winning_goals, 0 AS ot_goals FROM logs WHERE shots <> 5"""
_ROUTED = f"""{LOGS}, routed AS (
  SELECT player_id, season, game_type, team_abbr, CASE WHEN shots = 5 THEN 'shots' END AS reason FROM logs
  UNION ALL SELECT player_id, season, game_type, team_abbr, 'gameId' FROM logs)"""
ORACLE["game_log_rejected"] = f"WITH {_ROUTED} SELECT * FROM routed WHERE reason IS NOT NULL"
ORACLE["game_log_rejection_counts"] = f"""WITH {_ROUTED}
SELECT season, coalesce(reason, 'ok') AS reason, count(*) AS n FROM routed GROUP BY ALL"""
_BIG = ("goalie_in_net_id", "blocking_player_id", "assist1_player_id", "assist2_player_id")
_SMALL = (
    "y_coord", "event_owner_team_id", "scoring_player_total", "assist1_player_total", "assist2_player_total",
    "away_score", "home_score", "away_sog", "home_sog",
)
ORACLE["pbp_flatten"] = f"""WITH {ICE} SELECT game_id, event_id, period, {_clock('t')} AS time_in_period, '' AS time_remaining, 0 AS sort_order,
  0 AS type_code, type_desc_key, situation_code, '' AS home_team_defending_side,
  CASE WHEN type_desc_key <> 'faceoff' THEN CAST(event_id % 100 AS INTEGER) END AS x_coord, '' AS zone_code, '' AS shot_type,
  CASE WHEN type_desc_key NOT IN ('goal', 'faceoff') THEN shooter_raw END AS shooting_player_id,
  CASE WHEN type_desc_key = 'goal' THEN shooter_raw END AS scoring_player_id,
  {", ".join(f"CAST(NULL AS BIGINT) AS {c}" for c in _BIG)}, {", ".join(f"CAST(NULL AS INTEGER) AS {c}" for c in _SMALL)} FROM shots"""
ORACLE["shifts_flatten"] = f"""WITH {ICE} SELECT game_id, shift_id, player_id, CASE WHEN player_id % 2 = 0 THEN player_name ELSE 'Player' END AS player_name,
  team_abbr, period, 0 AS shift_number, {_clock('start_sec')} AS start_time, {_clock('end_sec')} AS end_time,
  {_clock('end_sec - start_sec')} AS duration, 0 AS detail_code, 0 AS event_number, '' AS hex_value, 0 AS team_id, '' AS team_name,
  0 AS type_code FROM shifts"""


# --- models --------------------------------------------------------------------------------

TRAINING = f"""{REG}, {PLAYERS}, training AS (
  SELECT *, season = {SEASON} AS is_validation FROM (
    SELECT * FROM {_rows_of("'20212022'")} UNION ALL BY NAME SELECT * FROM {_rows_of("'20222023'")}
    UNION ALL BY NAME SELECT * FROM {_rows_of(SEASON)}))"""
ORACLE["training_table"] = f"WITH {TRAINING} SELECT * FROM training"
ORACLE["training_counts"] = f"""WITH {TRAINING}
SELECT count(*) FILTER (NOT is_validation) AS n_train, count(*) FILTER (is_validation) AS n_val FROM training"""
ORACLE["category_codes"] = f"""WITH {TRAINING}, seen AS (SELECT DISTINCT feature, category FROM (
  SELECT u.f AS feature, u.c AS category FROM (SELECT unnest([{{'f': 'position', 'c': position}},
    {{'f': 'position_group', 'c': position_group}}, {{'f': 'shoots_catches', 'c': shoots_catches}}]) AS u
    FROM training WHERE NOT is_validation)) WHERE category IS NOT NULL)
SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS code FROM seen"""
_INPUTS = (
    *(f"prior_{c}_per_game" for c in (*_STATS, "toi")),
    *(f"prior_{c}" for c in ("shoot_pct", "faceoff_pct", "games_played", "home_pts_per_game", "road_pts_per_game")),
    *(f"momentum_{c}_per_game" for c in ("pts", "goals", "shots")),
    "career_games", "career_pts_per_game", "career_goals_per_game", "career_seasons",
    "team_offense", "team_defense", "team_shots", "age",
)
_VALUES = ", ".join(f"{{'f': '{c}', 'v': CAST(coalesce({c}, -999) AS DOUBLE)}}" for c in _INPUTS)
ORACLE["feature_relevance"] = f"""WITH {TRAINING}, long AS (
  SELECT u.f AS feature, u.v AS v, pts_per_game AS y FROM (SELECT pts_per_game, unnest([{_VALUES}]) AS u FROM training WHERE NOT is_validation)),
r AS (SELECT feature, CASE WHEN var_pop(v) * var_pop(y) > 0 THEN covar_pop(v, y) * covar_pop(v, y) / (var_pop(v) * var_pop(y)) ELSE 0 END AS r2
  FROM long GROUP BY feature)
SELECT feature, round_even(r2, 6) AS importance,
  round_even(CASE WHEN (SELECT sum(r2) FROM r) > 0 THEN r2 / (SELECT sum(r2) FROM r) ELSE 0 END * 100, 4) AS importance_pct
FROM r ORDER BY importance DESC, feature LIMIT 15"""
NAIVE = f"""{REG}, {PLAYERS}, {TEAM_SEASONS}, naive AS (
  SELECT *, coalesce(momentum_pts_per_game, prior_points_per_game, 0) AS prediction FROM {_rows_of(SEASON)}),
projected AS (
  SELECT n.player_id, n.position, least(greatest(prediction, 0), 2) AS projected_pts_per_game,
    p.first_name || ' ' || p.last_name AS player_name, c.current_team AS team, least(greatest(prediction, 0), 2) * 82 AS projected_total_pts_82,
    'recent form' AS model_version, CAST(NULL AS DOUBLE) AS model_mae
  FROM naive n LEFT JOIN players p USING (player_id) LEFT JOIN current_team c USING (player_id))"""
ORACLE["naive_projection"] = f"WITH {NAIVE} SELECT * FROM projected"
ORACLE["naive_leaderboard"] = f"""WITH {NAIVE}
SELECT CAST(row_number() OVER (ORDER BY projected_pts_per_game DESC, player_id) AS INTEGER) AS rank, player_id, player_name, team, position,
  projected_pts_per_game, projected_total_pts_82 FROM projected WHERE position IN ('C', 'L', 'R') QUALIFY rank <= 30"""
ORACLE["naive_actual_vs_predicted"] = f"""WITH {NAIVE}
SELECT player_id, position, pts_per_game, prediction, pts_per_game - prediction AS residual FROM naive"""
ORACLE["naive_metrics"] = f"""WITH {NAIVE}, long AS (SELECT 1 AS one, pts_per_game AS a, prediction AS p FROM naive)
SELECT * EXCLUDE (one) FROM ({_fit('long', 'one')})"""
ORACLE["naive_residuals"] = f"""WITH {NAIVE}, e AS (SELECT pts_per_game - prediction AS residual FROM naive)
SELECT round_even(avg(residual), 6) AS mean_residual, round_even(stddev_pop(residual), 6) AS std_residual,
  round_even(min(residual), 6) AS min_residual, round_even(max(residual), 6) AS max_residual,
  {", ".join(f"round_even(quantile_cont(abs(residual), {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95))} FROM e"""
ORACLE["naive_rate_hist"] = f"WITH {NAIVE} {_hist('projected', 'projected_pts_per_game', '0.1::DOUBLE')}"
ORACLE["naive_rate_mean"] = f"""WITH {NAIVE}
SELECT round_even(avg(projected_pts_per_game), 6) AS mean_rate, count(*) AS players FROM projected"""

# --- what the sinks write ------------------------------------------------------------------

ORACLE["written_records"] = f"""WITH {ANOMALIES}
SELECT player_id, player_name, team, streak_type AS type, length, sign, CAST(least(length, 40) AS INTEGER) AS n_games,
  novelty_index, severity, u.l AS level, round_even(u.p, 6) AS probability, round_even(1 - u.p, 6) AS rarity
FROM (SELECT *, unnest([{{'l': 'league', 'p': league_p}}, {{'l': 'team', 'p': team_p}}, {{'l': 'player', 'p': player_p}}]) AS u FROM anom)"""


def _score(name: str) -> str:
    return f"""printf('    %6s: P=%.4f  rarity=%.4f', '{name}', round_even({name}_p, 4), round_even(1 - {name}_p, 4))"""


ORACLE["written_summary"] = f"""WITH {ANOMALIES},
top AS (SELECT *, row_number() OVER (ORDER BY novelty DESC, player_id, streak_type) AS rn FROM anom)
SELECT unnest([repeat('=', 72), '  Streak Anomaly Daily Report', '  Generated: 2026-01-01 00:00 UTC',
  '  Total anomalies: ' || count(*), repeat('=', 72), '', repeat('=', 72), '  TOP 10 NOTABLE STREAKS', repeat('=', 72)]) AS line FROM anom
UNION ALL SELECT unnest(['--- ' || severity || ' (' || count(*) || ' streaks) ---', '']) FROM anom GROUP BY severity
UNION ALL SELECT unnest(['  ' || player_name || ' (' || team || ', ' || position || ') — ' || description,
  '    Length: ' || length || ' games  |  ' || start_date || ' to ' || end_date,
  {_score("league")}, {_score("team")}, {_score("player")}, printf('    novelty_index=%.4f', novelty_index), '']) FROM anom
UNION ALL SELECT printf('  %d. [%s] %s (%s) — %dG %s (NI=%.4f)', rn, severity, player_name, team, length, streak_type, novelty_index)
  FROM top WHERE rn <= 10"""
ORACLE["written_baselines"] = f"""WITH {BASELINES}
SELECT 'league' AS level, NULL AS team, NULL AS player_id, pg, streak_type, n, p, NULL AS career_max FROM league
UNION ALL SELECT 'team', team, NULL, pg, streak_type, n, p, NULL FROM team_curve
UNION ALL SELECT 'player', NULL, player_id, NULL, streak_type, NULL, NULL, career_max FROM best"""
ORACLE["exported_curves"] = ORACLE["streak_tail_league"]
ORACLE["cached_seasons"] = f"""WITH {ORDERS} SELECT season_id, entry_id, games_played, points FROM act WHERE season_id IN (19941995, 19961997)"""
ORACLE["written_csv"] = f"""WITH {ORDERS} SELECT projection_id, player_name, source, season_id, projected_points, actual_points FROM matched"""

# the calendar years of the orders play the years of the sheets
_SHEET_YEAR = "CASE year(o_orderdate) WHEN 1996 THEN 2016 WHEN 1997 THEN 2021 WHEN 1998 THEN 2024 END"
_SHEETS = f"""sheet AS (
  SELECT o_orderkey AS projection_id, {_SHEET_YEAR} AS file_year, 'Customer' AS first_name, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS last_name,
    '' AS team, CASE o_orderpriority WHEN '1-URGENT' THEN 'Hockey Le Magazine' WHEN '2-HIGH' THEN 'ESPN' WHEN '3-MEDIUM' THEN 'PoolPro'
      WHEN '4-NOT SPECIFIED' THEN 'Hockey News' ELSE 'Fantrax' END AS source,
    CAST(trunc(o_totalprice / 1000.0::DOUBLE) AS INTEGER) AS projected_points
  FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderkey % 50 <> 0 AND o_totalprice > 0),
proj AS (SELECT *, first_name || ' ' || last_name AS player_name, CAST(file_year * 10000 + file_year + 1 AS INTEGER) AS season_id,
  lower(first_name || ' ' || last_name) AS match_key FROM sheet),
raw AS (SELECT l_orderkey, count(*) AS gp, CAST(floor(
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) / 10000000.0::DOUBLE) AS INTEGER) AS points
  FROM lineitem GROUP BY l_orderkey),
act AS (
  SELECT o_orderkey AS entry_id, 'Customer' AS first_name, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS last_name, o_orderstatus AS team,
    CAST(gp AS INTEGER) AS games_played, points, CAST({_SHEET_YEAR} * 10000 + {_SHEET_YEAR} + 1 AS INTEGER) AS season_id,
    'customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS match_key
  FROM raw JOIN orders ON l_orderkey = o_orderkey
  WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)"""
ORACLE["sheet_projections"] = f"""WITH {_SHEETS}
SELECT first_name, last_name, player_name, team, source, projected_points, season_id, CAST(file_year AS INTEGER) AS file_year FROM proj"""
ORACLE["results_table"] = f"""WITH {_SHEETS}
SELECT first_name || ' ' || last_name AS player_name, first_name, last_name, team, '' AS position, games_played, 0 AS goals, 0 AS assists, points,
  round_even(points / greatest(games_played, 1), 3) AS points_per_game, season_id FROM act WHERE season_id = 20162017"""
ORACLE["backtest_metrics"] = f"WITH {_SHEETS}, {BACKTEST} SELECT * FROM metrics"
ORACLE["backtest_match_rate"] = f"""WITH {_SHEETS}, {BACKTEST}
SELECT (SELECT count(*) FROM proj) AS projections, count(*) AS matched, round_even(count(*) * 100 / (SELECT count(*) FROM proj), 1) AS match_rate FROM known"""
