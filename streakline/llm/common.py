"""What several corpus operators share: stored tables, guarded broadcasts, word counts, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakline.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends there.

    A lost executor costs a reread, not a recomputation, and joins see a plain
    table, whose skewed partitions adaptive execution can split.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` hinted for broadcasting when it has at most ``limit`` rows; else left to a shuffle join.

    ``df`` should be stored: it is counted here. Beyond the limit both sides of
    the join are plain tables and adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.count() <= limit else df


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") / F.lit(float(1 << 53))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every node of the stored ``edges`` (a, b: long).

    Every node takes the smallest label among its neighbours and then its
    label's label, until nothing changes: rounds grow with the logarithm of the
    longest chain. Minima are pre-aggregated, so a node with very many
    neighbours is one row per task after the first step.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("seen"))
        )
        stepped = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("above"))
        moved = stored(
            stepped.join(roots, F.col("label") == F.col("root"), "left").select(
                "node", "old", F.least("label", F.coalesce("above", "label")).alias("label")
            )
        )
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def keyed_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")
