"""Running sums and maxima over ordered groups of any size.

A window sorts each group in one task, which fails when a single key holds a
large share of the table. Groups are therefore cut into chunks by a function of
the first order column that never falls while the order rises (the month of a
date, a block of seconds). Running values are computed within each (key, chunk),
and what the earlier chunks of the key add up to, one row per chunk, is added as
a carry. There is one way for every size: no row is counted beforehand, nothing
is stored on the way, and building a query starts no job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "_cell"


def month_of(date: str) -> Column:
    """Chunk of logs that are ordered by a date."""
    return F.trunc(date, "month")


def block_of(number: str, width: int) -> Column:
    """Chunk of rows that are ordered by a number."""
    return F.floor(F.col(number) / F.lit(width))


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class OrderedGroups:
    """Rows to be read in ``order`` within a key; ``CELL`` is the struct of key and chunk."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    cells: DataFrame

    def running(
        self,
        sums: Mapping[str, Column | str] | None = None,
        maxes: Mapping[str, Column | str] | None = None,
        totals: Mapping[str, Column] | None = None,
        exclusive: bool = False,
        index: str | None = None,
        marks: Mapping[str, Column] | None = None,
        last: str | None = None,
    ) -> OrderedGroups:
        """Add running values over the whole key, up to the current row or (``exclusive``) the one before.

        ``sums`` and ``maxes`` are running aggregates (0 and NULL over no rows),
        ``totals`` sums over the whole key. ``index`` names the row's position
        from 1 on; a mark is the position of the latest row, the current one
        included, for which its condition holds (NULL for none). With ``last``,
        column ``<mark><last>`` is the latest such position in the whole key.

        Position and marks of a cell are one composed value: with the number of
        rows before the cell, a local position becomes one of the key, so all
        running values come from one ordered pass. A cell's totals are taken
        from its last row behind the same sort, and values are worked out before
        the shuffle, so that both sides of the join read one shuffle. That holds
        as long as the rows have no columns but key, order and values: a column
        that is wanted later goes into a struct at the end of the order, and a
        value that is a column is given by its name.
        """
        sums, maxes, totals, marks = dict(sums or {}), dict(maxes or {}), dict(totals or {}), dict(marks or {})
        ordered = Window.partitionBy(CELL).orderBy(*self.order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        shown = ordered.rowsBetween(Window.unboundedPreceding, -1) if exclusive else upto

        given = {**sums, **maxes, **marks}
        value = {n: F.col(c if isinstance(c, str) else f"_v_{n}") for n, c in given.items()}

        def over(frame, prefix: str = "") -> dict[str, Column]:
            added = {f"{prefix}{n}": F.coalesce(F.sum(value[n]).over(frame), F.lit(0)) for n in sums}
            return added | {f"{prefix}{n}": F.max(value[n]).over(frame) for n in maxes}

        at = F.col("_at")
        valued = self.cells.withColumns({f"_v_{n}": c for n, c in given.items() if not isinstance(c, str)})
        local = valued.withColumn("_at", F.row_number().over(ordered).cast("long")).withColumns(
            over(shown) | over(upto, "_u_") | {f"_u_{n}": F.max(F.when(value[n], at)).over(upto) for n in marks}
        )
        inner = [f"_u_{n}" for n in (*sums, *maxes, *marks)]
        per_cell = local.groupBy(CELL).agg(
            F.max_by(F.struct("_at", *inner), "_at").alias("_end"), *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()]
        )
        whole = Window.partitionBy(f"{CELL}.key")
        earlier = whole.orderBy(f"{CELL}.chunk").rowsBetween(Window.unboundedPreceding, -1)

        def of(n: str) -> Column:
            return F.col(f"_end._u_{n}")

        based = per_cell.withColumn("_base", F.coalesce(F.sum("_end._at").over(earlier), F.lit(0)))
        carry = based.select(
            CELL,
            "_base",
            *[F.sum(f"_t_{n}").over(whole).alias(n) for n in totals],
            *[F.coalesce(F.sum(of(n)).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
            *[F.max(of(n)).over(earlier).alias(f"_c_{n}") for n in maxes],
            *[F.max(F.col("_base") + of(n)).over(earlier).alias(f"_c_{n}") for n in marks],
            *[F.max(F.col("_base") + of(n)).over(whole).alias(f"{n}{last}") for n in marks if last is not None],
        )
        added = {n: F.col(n) + F.col(f"_c_{n}") for n in sums} | {n: F.greatest(n, f"_c_{n}") for n in maxes}
        added |= {n: F.coalesce(F.col("_base") + F.col(f"_u_{n}"), F.col(f"_c_{n}")) for n in marks}
        if index is not None:
            added[index] = F.col("_base") + at
        joined = local.join(carry, CELL).withColumns(added)
        return replace(self, cells=joined.drop("_at", "_base", *inner, *[f"{p}{n}" for n in given for p in ("_c_", "_v_")]))

    def rows(self) -> DataFrame:
        """All rows without the cell; the key's columns are those of the cell."""
        rest = [F.col(f"`{c}`") for c in self.cells.columns if c != CELL and c not in self.keys]
        return self.cells.select(*[F.col(f"{CELL}.key")[k].alias(k) for k in self.keys], *rest)


def order_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> OrderedGroups:
    """``df`` cut into cells; ``order`` should be unique per key and ``chunk`` must not fall along it."""
    cell = F.struct(F.struct(*keys).alias("key"), chunk.alias("chunk"))
    return OrderedGroups(tuple(keys), tuple(order), df.withColumn(CELL, cell))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows per key in ``order`` (pass descending columns for the last).

    The rank filter lets Spark keep only ``n`` rows per key on the map side, so
    a hot key never travels whole.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
