"""Scalar rules and lookups."""

import pytest
from pyspark.sql import functions as F

from streakline.functions import lookups as K
from streakline.functions import scalars as S
from streakline.sources import sheets


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text,seconds",
    [("0:00", 0), ("1:00", 60), ("20:00", 1200), ("12:34", 754), ("", 0), (None, 0), ("1234", 0),
     (":30", 0), ("59:59", 3599), ("a:10", 0), ("1:2:3", 0), ("99999999999:00", 0)],
)
def test_clock(spark, text, seconds):
    assert one(spark, text, S.clock_seconds) == seconds


@pytest.mark.parametrize("text,value", [("3", 3), ("-2", -2), (None, 0), ("x", 0), ("3.7", 0), ("", 0)])
def test_int_or(spark, text, value):
    assert one(spark, text, S.int_or) == value


@pytest.mark.parametrize("text,value", [("0.5", 0.5), ("0", None), ("0.0", None), (None, None), ("x", None)])
def test_nonzero_double(spark, text, value):
    assert one(spark, text, S.nonzero_double) == value


@pytest.mark.parametrize("text,value", [("12", 12), ("12.9", 12), ("x", 0), (None, 0)])
def test_count_or_zero(spark, text, value):
    assert one(spark, text, S.count_or_zero) == value


@pytest.mark.parametrize("text,value", [('{"default":"Max"}', "Max"), ("Max", "Max"), (None, ""), ('{"fr":"M"}', "")])
def test_localized(spark, text, value):
    got = one(spark, text, S.localized)
    assert got == value


@pytest.mark.parametrize("text,ok", [("20252026", True), ("2025", False), ("2025202a", False), (None, False)])
def test_is_season(spark, text, ok):
    assert one(spark, text, S.is_season) is ok


@pytest.mark.parametrize(
    "born,age", [("2000-01-15", 25.0), ("2000-12-15", 24.0), ("2000-10-01", 25.0), (None, None), ("bad", None)]
)
def test_age(spark, born, age):
    assert one(spark, born, lambda c: S.age_at(c, F.lit("2025-10-01").cast("date"))) == age


@pytest.mark.parametrize("day,season", [("2025-10-08", "20252026"), ("2026-03-01", "20252026"), ("2026-07-01", "20262027")])
def test_season_of_date(spark, day, season):
    assert one(spark, day, S.season_of_date) == season


def test_season_labels(spark):
    assert one(spark, 20162017, S.season_label, "int") == "2016-2017"
    assert one(spark, 2016, S.season_for_year, "int") == 20162017
    assert one(spark, "20252026", S.season_start_year) == 2025


@pytest.mark.parametrize(
    "name,first,last",
    [("Connor McDavid", "Connor", "McDavid"), ("Ovechkin", "", "Ovechkin"), ("  J  van  Riemsdyk ", "J", "van Riemsdyk"),
     ("", "", "")],
)
def test_names(spark, name, first, last):
    assert one(spark, name, S.first_name) == first
    assert one(spark, name, S.last_name) == last


@pytest.mark.parametrize(
    "raw,code", [("WIN", "WPG"), ("TB", "TBL"), ("flo ", "FLA"), ("SJ", "SJS"), ("XYZ", "XYZ"), (None, ""), ("TBL", "TBL")]
)
def test_team_code(spark, raw, code):
    assert one(spark, raw, S.team_code) == code


@pytest.mark.parametrize(
    "raw,name",
    [("HM", "Hockey Le Magazine"), ("PP", "PoolPro"), ("FOR", "Sports Forecaster"), (" Mystery ", "Mystery")],
)
def test_source_name(spark, raw, name):
    assert one(spark, raw, S.source_name) == name


HEADERS = {
    "HM": True, "ESPN": True, "Fantrax": True, "ppfor": True, "Rang": False, "RG": False, "MOY": False,
    "Unnamed: 4": False, "Colonne9": False, "Âge": False, "age": False, "HM.1": False, "hm2": False,
    "moy.2": False, "Final": False, "Top2": True, "2": True, "écart-type": False,
}


def test_source_headers(spark):
    assert set(sheets.source_headers(spark, list(HEADERS))) == {h for h, is_source in HEADERS.items() if is_source}
    assert sheets.source_headers(spark, ["x", "HM"]) == {"x": "x", "HM": "Hockey Le Magazine"}


@pytest.mark.parametrize("p,g", [("C", "F"), ("L", "F"), ("R", "F"), ("D", "D"), ("G", "ALL"), (None, "ALL")])
def test_position_group(spark, p, g):
    assert one(spark, p, S.position_group) == g


def test_arithmetic(spark):
    df = spark.createDataFrame([(1, 2, 0)], "a int, b int, z int")
    r = df.select(
        S.ratio("a", "b").alias("half"),
        S.ratio("a", "z").alias("zero"),
        S.ratio("a", "z", None).alias("none"),
        S.percent("a", "b").alias("pct"),
        S.percent("z", "z").alias("pct0"),
        S.per_hour("a", F.lit(1800)).alias("rate"),
        S.per_hour("a", "z").alias("rate0"),
        S.clip(F.lit(3.0), 0.0, 2.0).alias("clip"),
        S.closer("a", "b", "x", "y").alias("near"),
        S.closer("a", "a", "x", "y").alias("tie"),
        S.closer(F.lit(None).cast("int"), "a", "x", "y").alias("null"),
        S.rounded(F.lit(0.125), 2).alias("even"),
        S.rounded(F.lit(-2.5), 0).alias("neg"),
    ).first()
    assert tuple(r) == (0.5, 0.0, None, 33.3, 0.0, 2.0, 0.0, 2.0, "x", "y", "y", 0.12, -2.0)


@pytest.mark.parametrize("n,bucket", [(1, "1"), (20, "20"), (21, "21-25"), (25, "21-25"), (26, "26-30")])
def test_length_bucket(spark, n, bucket):
    assert one(spark, n, S.length_bucket, "int") == bucket


@pytest.mark.parametrize("t,label,short", [(2, "Regular Season", "Reg"), (3, "Playoffs", "PO"), (1, "Other (1)", "1")])
def test_game_type_labels(spark, t, label, short):
    assert one(spark, t, S.game_type_label, "int") == label
    assert one(spark, t, S.game_type_short, "int") == short


def test_optional_filters(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "t string, n int")
    assert df.where(S.optional_filters({"t": None}, {"n": None})).count() == 3
    assert df.where(S.optional_filters({"t": ["A", "B"]}, {"n": (2, 9)})).count() == 1


def test_rank_in_orders_fixed_values(spark):
    df = spark.createDataFrame([(s,) for s in reversed(K.SEVERITIES)], "s string")
    assert tuple(r.s for r in df.orderBy(S.rank_in("s", K.SEVERITIES)).collect()) == K.SEVERITIES


def test_name_search_ignores_case(spark):
    assert one(spark, "Connor McDavid", lambda c: S.name_contains(c, "mcd")) is True
