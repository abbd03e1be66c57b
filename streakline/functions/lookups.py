"""Codes, aliases and labels that results must agree on."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

FORWARD_POSITIONS = ("C", "L", "R")
DEFENSE_POSITION = "D"
GOALIE_POSITION = "G"

SHOT_ATTEMPTS = ("goal", "shot-on-goal", "missed-shot", "blocked-shot")
UNBLOCKED_ATTEMPTS = ("goal", "shot-on-goal", "missed-shot")
EVEN_STRENGTH = "1551"

SEVERITIES = ("EXTREMELY RARE", "VERY RARE", "RARE", "UNCOMMON", "COMMON")
SEVERITY_FLOORS = (0.90, 0.75, 0.50, 0.25)
NOVELTY_WEIGHTS = {"league": 0.40, "team": 0.35, "player": 0.25}

GAME_TYPE_LABELS = {2: "Regular Season", 3: "Playoffs"}

TEAM_ALIASES = {
    "CLB": "CBJ",
    "FLO": "FLA",
    "LA": "LAK",
    "SJ": "SJS",
    "TB": "TBL",
    "WIN": "WPG",
}

# sheet header -> forecast source
SOURCE_ALIASES = {
    "ath": "The Athletic",
    "the athletic": "The Athletic",
    "cbs": "CBS",
    "espn": "ESPN",
    "fantrax": "Fantrax",
    "ft": "Fantrax",
    "hm": "Hockey Le Magazine",
    "hockey le magazine": "Hockey Le Magazine",
    "hn": "Hockey News",
    "the hockey news": "Hockey News",
    "lepool": "Lepool",
    "lepool.com": "Lepool",
    "pe": "PoolExpert",
    "pool expert": "PoolExpert",
    "pool pro": "PoolPro",
    "poolpro": "PoolPro",
    "pp": "PoolPro",
    "ppfor": "PoolPro",
    "for": "Sports Forecaster",
    "sports forecaster": "Sports Forecaster",
    "the sports forecaster": "Sports Forecaster",
}

# sheet headers that hold names, ranks, averages and other non-forecast values
NON_SOURCE_HEADERS = (
    "age",
    "colonne1",
    "colonne2",
    "colonne3",
    "colonne32",
    "difference",
    "différence",
    "ecart",
    "ecart-type",
    "e\ufffdcart",
    "écart-type",
    "equipe",
    "équipe",
    "final",
    "mj",
    "moy",
    "moy - hm",
    "moy. sans hm",
    "moyenne",
    "nom",
    "prenom",
    "prénom",
    "rang",
    "rg",
)

# the later multi-sheet layout knows only these headers
LATE_SHEET_SOURCES = {
    "espn": "ESPN",
    "fantrax": "Fantrax",
    "ft": "Fantrax",
    "hm": "Hockey Le Magazine",
    "hn": "Hockey News",
    "pe": "PoolExpert",
    "pool expert": "PoolExpert",
    "pool pro": "PoolPro",
    "poolpro": "PoolPro",
    "pp": "PoolPro",
}

# order of the four values in the run-together text layout
RECORD_SOURCES = ("Hockey News", "Hockey Le Magazine", "PoolPro", "Sports Forecaster")

MISSING_FEATURE = -999.0
SEASON_GAMES = 82
