"""Keyed table maintenance: upsert, semi and anti joins, schema evolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streakline.functions import scalars as S
from streakline.operators.ordered import last_rows


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order``."""
    return last_rows(df, keys, order, 1, "_rn").drop("_rn")


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column] = (),
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Whole-row replace: incoming rows win, and the first in ``order`` among them.

    Columns the incoming side lacks are reset to their default (NULL without
    one), as a whole-row replace does.
    """
    defaults = defaults or {}
    types = existing.schema
    missing = [c for c in existing.columns if c not in incoming.columns]
    full = incoming.withColumns({c: F.lit(defaults.get(c)).cast(types[c].dataType) for c in missing})
    newest = latest_per_key(full.select(existing.columns), keys, order) if order else full.select(existing.columns)
    both = existing.withColumn("_batch", F.lit(0)).unionByName(newest.withColumn("_batch", F.lit(1)))
    return latest_per_key(both, keys, [F.desc("_batch")]).drop("_batch")


def known_only(df: DataFrame, reference: DataFrame, key: str, reference_key: str | None = None) -> DataFrame:
    """Rows whose key exists in the reference table."""
    ids = reference.select(F.col(reference_key or key).alias(key))
    return df.join(ids, key, "left_semi")


def orphans(df: DataFrame, reference: DataFrame, key: str, reference_key: str | None = None) -> DataFrame:
    """Rows whose key is missing from the reference table."""
    ids = reference.select(F.col(reference_key or key).alias(key))
    return df.join(ids, key, "left_anti")


def skip_existing(incoming: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows of entities that have not been loaded yet."""
    return incoming.join(loaded.select(*keys), list(keys), "left_anti")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by an explicit order."""
    return latest_per_key(df, keys, [F.asc(c) for c in order])


def distinct_ids(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Sorted distinct ids over several tables."""
    ids = frames[0].select(key)
    for other in frames[1:]:
        ids = ids.unionByName(other.select(key))
    return ids.distinct().orderBy(key)


def missing_ids(requested: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Requested ids that the cache lacks."""
    return requested.select(key).distinct().join(cached.select(key), key, "left_anti")


def ids_in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def evolve(df: DataFrame, schema: StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Bring a table to the declared schema: add, retype and drop columns.

    A missing or empty ``season`` is filled from ``game_date``.
    """
    defaults = defaults or {}
    columns = []
    for field in schema.fields:
        if field.name in df.columns:
            column = F.col(field.name).cast(field.dataType)
        else:
            column = F.lit(defaults.get(field.name)).cast(field.dataType)
        columns.append(column.alias(field.name))
    evolved = df.select(*columns)
    if "season" in evolved.columns and "game_date" in evolved.columns:
        filled = F.when(
            F.coalesce("season", F.lit("")) == "", S.season_of_date("game_date")
        ).otherwise(F.col("season"))
        evolved = evolved.withColumn("season", filled)
    return evolved
