"""Writers: partitioned upserts, JSON lines, text reports, baselines and caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline import schemas
from streakline.functions import lookups as K
from streakline.functions import scalars as S
from streakline.operators import rarity
from streakline.operators.reports import ranked
from streakline.operators.streaks import Baselines, as_steps, step_points
from streakline.operators.tables import upsert
from streakline.sources.sheets import path_exists


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``.

    Rows are spread by the partition columns, so each partition gets few files;
    adaptive execution splits an oversized one.
    """
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def touched_partitions(incoming: DataFrame, partition_by: Sequence[str]) -> Column:
    """Filter on the partitions present in ``incoming``.

    Literal values, so that the scan lists only those folders. There are at
    most as many as the table has partitions.
    """
    values = incoming.select(*partition_by).distinct().collect()
    matches = [S.all_of([F.col(c).eqNullSafe(F.lit(row[c])) for c in partition_by]) for row in values]
    return reduce(lambda a, b: a | b, matches, F.lit(False))


def partitioned(incoming: DataFrame, keys: Sequence[str], partition_by: Mapping[str, Column]) -> DataFrame:
    """``incoming`` with its partition columns, which must follow from the key alone.

    Otherwise two versions of one row could lie in different partitions, and an
    upsert of one would not find the other.
    """
    try:
        incoming.select(*keys).withColumns(dict(partition_by)).schema
    except AnalysisException as error:
        raise ValueError(f"partition columns {list(partition_by)} do not follow from the key {list(keys)}") from error
    return incoming.withColumns(dict(partition_by))


def upsert_table(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    partition_by: Mapping[str, Column],
    order: Sequence[Column] = (),
    defaults: Mapping[str, object] | None = None,
    ddl: str | None = None,
) -> None:
    """Merge rows into a partitioned table; other partitions are neither read nor written.

    ``partition_by`` has expressions over the key columns, so rows of one key
    always share a partition. Files are staged and swapped at commit, so a lost
    executor leaves the old partition in place.
    """
    names = list(partition_by)
    incoming = partitioned(incoming, keys, partition_by)
    if not path_exists(spark, path):
        declared = spark.createDataFrame([], schemas.schema(ddl)) if ddl else incoming.limit(0)
        write_partitions(upsert(declared, incoming, keys, order, defaults), path, names)
        return
    reader = spark.read.schema(ddl) if ddl else spark.read
    table = reader.parquet(path)
    existing = table.where(touched_partitions(incoming, names))
    write_partitions(upsert(existing, incoming, keys, order, defaults), path, names)


def write_jsonl(anomalies: DataFrame, path: str) -> None:
    """Anomalies as JSON lines with nested streak and rarity scores, most novel first."""
    rarity.as_records(rarity.by_novelty(anomalies)).write.mode("overwrite").json(path)


RULE = "=" * 72
_LINE_KEY = "struct<novelty:double,player_id:bigint,streak_type:string>"


def summary_lines(anomalies: DataFrame, title: str, generated: str) -> DataFrame:
    """The daily text report as ordered lines (section, rank, line).

    Sections: header, one per severity in fixed order, then the ten most
    notable. Only counters and the top ten are aggregated; the body is built
    row by row and ordered with a distributed sort.
    """
    level = F.array_position(F.array(*[F.lit(s) for s in K.SEVERITIES]), F.col("severity")).cast("int")
    order = F.struct(-F.col("novelty"), F.col("player_id"), F.col("streak_type"))

    total = anomalies.agg(F.count("*").alias("n"))
    header = total.select(
        F.lit(0).alias("section"),
        F.lit(None).cast(_LINE_KEY).alias("key"),
        F.array(
            F.lit(RULE),
            F.lit(f"  {title}"),
            F.lit(f"  Generated: {generated}"),
            F.format_string("  Total anomalies: %d", "n"),
            F.lit(RULE),
            F.lit(""),
        ).alias("lines"),
    )
    headings = anomalies.groupBy(level.alias("section"), "severity").agg(F.count("*").alias("n")).select(
        "section",
        F.lit(None).cast(_LINE_KEY).alias("key"),
        F.array(F.format_string("--- %s (%d streaks) ---", "severity", "n"), F.lit("")).alias("lines"),
    )

    def score(name: str, p: str) -> Column:
        figures = [S.rounded(c, 4) for c in (F.col(p), 1 - F.col(p))]  # the format itself would take ties up
        return F.format_string("    %6s: P=%.4f  rarity=%.4f", F.lit(name), *figures)

    body = anomalies.select(
        level.alias("section"),
        order.alias("key"),
        F.array(
            F.format_string(
                "  %s (%s, %s) — %s", "player_name", "team", "position", "description"
            ),
            F.format_string(
                "    Length: %d games  |  %s to %s",
                "length",
                F.col("start_date").cast("string"),
                F.col("end_date").cast("string"),
            ),
            score("league", "league_p"),
            score("team", "team_p"),
            score("player", "player_p"),
            F.format_string("    novelty_index=%.4f", "novelty_index"),
            F.lit(""),
        ).alias("lines"),
    )
    footer_section = len(K.SEVERITIES) + 1
    footer = total.select(
        F.lit(footer_section).alias("section"),
        F.lit(None).cast(_LINE_KEY).alias("key"),
        F.array(F.lit(RULE), F.lit("  TOP 10 NOTABLE STREAKS"), F.lit(RULE)).alias("lines"),
    )
    top = ranked(anomalies, [F.desc("novelty"), F.asc("player_id"), F.asc("streak_type")], 10).select(
        F.lit(footer_section).alias("section"),
        order.alias("key"),
        F.array(
            F.format_string(
                "  %d. [%s] %s (%s) — %dG %s (NI=%.4f)",
                "rank",
                "severity",
                "player_name",
                "team",
                "length",
                "streak_type",
                "novelty_index",
            )
        ).alias("lines"),
    )
    blocks = None
    for part in (header, headings, body, footer, top):
        part = part.select("section", F.col("key").cast(_LINE_KEY), "lines")
        blocks = part if blocks is None else blocks.unionByName(part)
    return blocks.orderBy("section", F.asc_nulls_first("key")).select(F.explode("lines").alias("line"))


def write_summary(anomalies: DataFrame, path: str, title: str, generated: str) -> None:
    summary_lines(anomalies, title, generated).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


LEVELS = ("league", "team", "player", "meta")


def save_baselines(baselines: Baselines, path: str) -> None:
    """Baselines as four Parquet tables below ``path``, curves by step."""
    stepwise = baselines.stepwise()
    for level in LEVELS:
        getattr(stepwise, level).write.mode("overwrite").parquet(f"{path}/{level}")


def load_baselines(spark: SparkSession, path: str, stepwise: bool = False) -> Baselines:
    """Baselines of :func:`save_baselines`, curves by length unless ``stepwise``."""
    loaded = Baselines(**{level: spark.read.parquet(f"{path}/{level}") for level in LEVELS}).stepwise()
    return loaded if stepwise else replace(loaded, league=loaded.points("league"), team=loaded.points("team"))


def export_curves(curves: DataFrame, path: str) -> None:
    """Tail curves as JSON, one line per step: a curve is never one row, however long."""
    as_steps(curves).write.mode("overwrite").json(path)


def import_curves(spark: SparkSession, path: str, ids: Sequence[str] = ("pg", "streak_type"), stepwise: bool = False) -> DataFrame:
    """Curves written by :func:`export_curves`, by length unless ``stepwise``."""
    ddl = ", ".join(f"{c} string" for c in ids) + ", from_n long, to_n long, p double"
    steps = spark.read.schema(ddl).json(path)
    return steps if stepwise else step_points(steps)


def cache_results(results: DataFrame, path: str) -> None:
    """Season results cached per season; other seasons in the cache stay."""
    write_partitions(results, path, ["season_id"])


def cached_results(spark: SparkSession, path: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """Cached seasons; the filter prunes partitions."""
    cached = spark.read.parquet(path)
    return cached.where(F.col("season_id").isin(*seasons)) if seasons else cached
