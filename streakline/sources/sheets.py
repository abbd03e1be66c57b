"""Landed CSV files: season summaries, results tables and projection sheets."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.functions import lookups as K
from streakline.functions import scalars as S
from streakline.operators.forecast import unpivot_sources

SUMMARY_SCHEMA = (
    "playerId bigint, season int, name string, team string, position string, situation string,"
    " games_played double, I_F_xGoals double, I_F_points double, I_F_goals double,"
    " I_F_primaryAssists double, I_F_secondaryAssists double, I_F_shotsOnGoal double"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_season_summary(spark: SparkSession, path: str, situation: str = "all") -> DataFrame | None:
    """Season summary rows of one game situation; None when the file is absent."""
    if not path_exists(spark, path):
        return None
    wanted = [f.split()[0] for f in SUMMARY_SCHEMA.split(", ")]
    raw = spark.read.csv(path, header=True)
    types = dict(f.split() for f in SUMMARY_SCHEMA.split(", "))
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) for c in wanted if c in raw.columns]).where(
        F.col("situation") == situation
    )


def season_results(raw: DataFrame, season_id: int) -> DataFrame:
    """Results table to player rows: repeated headers and total rows removed."""
    team = F.col("Team") if "Team" in raw.columns else F.col("Tm")
    position = F.trim("Pos") if "Pos" in raw.columns else F.lit("")
    rows = raw.where(F.col("Player").isNotNull() & ~F.col("Player").startswith("Rk"))
    name = F.trim("Player")
    words = F.split(name, " ")
    return (
        rows.select(
            name.alias("player_name"),
            words[0].alias("first_name"),
            F.array_join(F.slice(words, 2, F.size(words)), " ").alias("last_name"),
            F.trim(team).alias("team"),
            position.alias("position"),
            S.count_or_zero("GP").alias("games_played"),
            S.count_or_zero("G").alias("goals"),
            S.count_or_zero("A").alias("assists"),
            S.count_or_zero("PTS").alias("points"),
        )
        .withColumn(
            "points_per_game", S.rounded(F.col("points") / F.greatest("games_played", F.lit(1)), 3)
        )
        .withColumn("season_id", F.lit(season_id))
        .where(F.col("team") != "TOT")
    )


def source_headers(spark: SparkSession, headers: Sequence[str]) -> dict[str, str]:
    """Header -> source for those of a sheet's few headers that name one, by the column rules."""
    listed = spark.createDataFrame([(h,) for h in headers], "header string")
    named = listed.where(S.is_source_header("header")).select("header", S.source_name("header").alias("source"))
    found = {r["header"]: r["source"] for r in named.collect()}
    return {h: found[h] for h in headers if h in found}


@dataclass(frozen=True)
class SheetLayout:
    """How one year's sheet is laid out.

    ``first``/``last`` or ``full`` name the header candidates of the name
    columns, ``team`` those of the team column. ``fixed`` maps headers to
    sources by hand and ``skip`` leaves headers out.
    """

    full: tuple[str, ...] = ()
    first: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    team: tuple[str, ...] = ()
    header_row: int = 0
    fixed: tuple[tuple[str, str], ...] = ()
    skip: tuple[str, ...] = ()
    late: bool = False
    first_required: bool = True


# --- fixed values: sheet layouts by file year ------------------------------------

_TEAM = ("Équipe", "Equipe", "EQUIPE")
SHEET_LAYOUTS = {
    2016: SheetLayout(first=("Prenom",), last=("Nom",), first_required=False),
    2017: SheetLayout(first=("Prenom",), last=("Nom",), header_row=1),
    2018: SheetLayout(
        first=("NOM",),
        last=("Unnamed: 3", "NOM.1"),
        team=_TEAM,
        fixed=(("HM.1", "Hockey Le Magazine"),),
        skip=("HM",),
    ),
    2020: SheetLayout(full=("Nom",), team=_TEAM, first_required=False),
    2021: SheetLayout(first=("Prénom", "Prenom"), last=("Nom",), team=_TEAM),
    2022: SheetLayout(full=("NOM",), team=_TEAM, late=True),
    2023: SheetLayout(first=("Prénom",), last=("Nom",), team=_TEAM, late=True),
    2024: SheetLayout(first=("Prénom",), last=("Nom",), team=_TEAM, late=True),
    2025: SheetLayout(first=("Prénom",), last=("Nom",), team=_TEAM, late=True),
}
TEXT_LAYOUT_YEAR = 2019


def _unique_headers(names: Sequence[str]) -> list[str]:
    """Repeated headers get .1, .2; empty ones are named by position."""
    seen: dict[str, int] = {}
    unique = []
    for i, raw in enumerate(names):
        name = raw.strip() or f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        unique.append(name if count == 0 else f"{name}.{count}")
    return unique


def read_sheet(spark: SparkSession, path: str, header_row: int = 0) -> DataFrame:
    """CSV sheet as text columns; the header may sit below banner lines.

    Rows that equal the header or a banner line in all cells are left out, in
    every file of a folder. The lines are those of its first file.
    """
    lines = spark.read.text(path)
    first = lines.agg(F.min("_metadata.file_path")).first()[0]
    head = [next(csv.reader([r.value]), []) for r in spark.read.text(first).limit(header_row + 1).collect()]
    names = _unique_headers(head[header_row])
    ddl = ", ".join(f"`{n.replace('`', '')}` string" for n in names)
    rows = spark.read.schema(ddl).csv(path, header=False, quote='"')
    for cells in head:
        padded = [*cells, *[""] * len(names)][: len(names)]
        same = [F.col(f"`{c}`").eqNullSafe(F.lit(cell or None)) for c, cell in zip(rows.columns, padded)]
        rows = rows.where(~S.all_of(same))
    return rows


def sheet_sources(spark: SparkSession, columns: Sequence[str], layout: SheetLayout) -> dict[str, str]:
    """Header -> source of the columns that hold forecasts."""
    known = {} if layout.late else source_headers(spark, columns)
    fixed = dict(layout.fixed)
    names = {*layout.full, *layout.first, *layout.last, *layout.team, *layout.skip}
    found = {}
    for column in columns:
        key = column.strip().lower()
        if column in fixed:
            found[column] = fixed[column]
        elif column in names:
            continue
        elif layout.late:
            if key in K.LATE_SHEET_SOURCES:
                found[column] = K.LATE_SHEET_SOURCES[key]
        elif column in known:
            found[column] = known[column]
    return found


def _pick(sheet: DataFrame, candidates: Sequence[str]) -> Column:
    for name in candidates:
        if name in sheet.columns:
            return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit(""))
    return F.lit("")


def sheet_projections(sheet: DataFrame, year: int) -> DataFrame:
    """Forecast rows of one sheet: names, team, source, projected points and season."""
    layout = SHEET_LAYOUTS[year]
    if layout.full:
        whole = _pick(sheet, layout.full)
        first, last = S.first_name(whole), S.last_name(whole)
    else:
        first, last = _pick(sheet, layout.first), _pick(sheet, layout.last)
    sources = sheet_sources(sheet.sparkSession, sheet.columns, layout)
    named = sheet.select(
        first.alias("first_name"),
        last.alias("last_name"),
        S.team_code(_pick(sheet, layout.team)).alias("team"),
        *[F.col(f"`{c}`") for c in sources],
    ).where(~F.lower("last_name").isin("", "nan"))
    if layout.first_required:
        named = named.where(F.col("first_name") != "")
    rows = unpivot_sources(named, ["first_name", "last_name", "team"], sources)
    return _dated(rows, year)


def _dated(rows: DataFrame, year: int) -> DataFrame:
    return rows.select(
        "first_name",
        "last_name",
        S.full_name("first_name", "last_name").alias("player_name"),
        "team",
        "source",
        "projected_points",
        S.season_for_year(F.lit(year)).alias("season_id"),
        F.lit(year).alias("file_year"),
    )


# --- fixed value: rank, name, team code, four values and their mean ----------------

RECORD_PATTERN = (
    r"(?U)(\d+)\s+([\w\s.\-]+?)\s+([A-Z]{2,4})\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d,]+)"
)


def text_records(lines: DataFrame, column: str = "value", ids: Sequence[str] = ()) -> DataFrame:
    """Repeated records inside text cells: rank, name, team, four values and mean."""
    record = F.explode(F.regexp_extract_all(column, F.lit(RECORD_PATTERN), F.lit(0))).alias("_record")
    found = lines.select(*ids, record)

    def group(i: int) -> Column:
        return F.regexp_extract("_record", RECORD_PATTERN, i)

    return found.select(
        *ids,
        group(1).cast("int").alias("rank"),
        S.first_name(group(2)).alias("first_name"),
        S.last_name(group(2)).alias("last_name"),
        S.team_code(group(3)).alias("team"),
        F.array(*[group(i).cast("int") for i in range(4, 8)]).alias("values"),
        group(8).alias("mean"),
    )


def text_projections(lines: DataFrame, year: int = TEXT_LAYOUT_YEAR) -> DataFrame:
    """Forecast rows of the run-together text layout; ``lines`` holds a sheet's whole text in a row.

    Records may go on in the next line.
    """
    joined = lines.select(F.regexp_replace("value", r"\s*[\r\n]+\s*", " ").alias("value"))
    names = F.array(*[F.lit(s) for s in K.RECORD_SOURCES])
    rows = text_records(joined).select(
        "first_name",
        "last_name",
        "team",
        F.posexplode("values").alias("_i", "projected_points"),
    )
    return _dated(rows.withColumn("source", F.get(names, F.col("_i"))), year)


def read_projections(
    spark: SparkSession, sheets: Mapping[int, str], years: Sequence[int] | None = None
) -> DataFrame:
    """All forecast sheets as one table. ``sheets`` maps a file year to its CSV path.

    Without ``years``, absent files are left out; a year that is asked for and
    has no file is an error.
    """
    there = [year for year, path in sorted(sheets.items()) if path_exists(spark, path)]
    absent = sorted(set(years or ()) - set(there))
    if absent:
        raise FileNotFoundError(f"no projection sheet for {', '.join(map(str, absent))}")
    parts = []
    for year in there:
        path = sheets[year]
        if years and year not in years:
            continue
        if year == TEXT_LAYOUT_YEAR:
            parts.append(text_projections(spark.read.text(path, wholetext=True)))
        else:
            layout = SHEET_LAYOUTS[year]
            parts.append(sheet_projections(read_sheet(spark, path, layout.header_row), year))
    if not parts:
        raise FileNotFoundError("no projection sheet for the years asked for")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
