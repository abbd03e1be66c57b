"""Exact percentiles, box-plot figures, histograms and error metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.functions import scalars as S
from streakline.operators.ordered import order_groups

#: Value ranges of a percentile's chunks: so many for each doubling.
RANGES = 16


def value_range(value: str) -> Column:
    """A coarse logarithmic scale that never falls while the value rises."""
    number = F.col(value).cast("double")
    return F.floor(F.signum(number) * F.log2(F.abs(number) + 1) * RANGES)


def profile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    series: Mapping[str, Column] | None = None,
    counts: Mapping[str, Column] | None = None,
    products: Sequence[tuple[str, str]] = (),
    chunk: Column | None = None,
) -> DataFrame:
    """Exact percentiles of ``value`` per key and, from the same read, moments of other columns.

    Percentiles interpolate linearly, one column per entry of ``probs``. ``n`` is
    the number of values, ``max_value`` the largest; a series adds ``<name>_mean``, ``_ss`` (squared
    deviations from the mean, summed), ``_low`` and ``_high``; a pair in
    ``products`` adds ``<a>_<b>_ss`` with both deviations multiplied; ``counts``
    are numbers of rows for which a condition holds. Rows without a value count
    for nothing, a key without any has n = 0; a series must not be NULL beside a
    value.

    Rows are folded to (value, count, moments) on the map side and located by
    rank with running counts over value ranges, so no task holds a whole group
    and the result does not depend on how the values are cut. Moments of the
    folds are combined around the mean of the whole key, which its totals tell.
    """
    keys, series, counts = list(keys), dict(series or {}), dict(counts or {})
    inner = keys or ["_whole"]
    present = F.col(value).isNotNull()
    named = df.withColumn("_whole", F.lit(0)).select(
        *inner,
        value,
        *[F.when(present, c).cast("double").alias(f"_x_{n}") for n, c in series.items()],
        *[F.when(present & c, 1).otherwise(0).alias(f"_k_{n}") for n, c in counts.items()],
    )
    size = F.count(value)
    folded = [F.sum(f"_k_{n}").alias(f"k_{n}") for n in counts]
    for n in series:
        x = F.col(f"_x_{n}")
        folded += [F.sum(x).alias(f"s_{n}"), (F.var_pop(x) * size).alias(f"ss_{n}")]
        folded += [F.min(x).alias(f"low_{n}"), F.max(x).alias(f"high_{n}")]
    folded += [(F.covar_pop(f"_x_{a}", f"_x_{b}") * size).alias(f"ss_{a}_{b}") for a, b in products]
    # what is wanted later goes to the end of the order, so that both sides of the carry read one shuffle
    more = [F.struct(*folded).alias("_more")] if folded else []
    pairs = named.groupBy(*inner, value).agg(size.alias("_cnt"), *more)
    order = [value, "_more"] if folded else [value]
    ranked = order_groups(pairs, inner, order, value_range(value) if chunk is None else chunk)
    totals = {"_n": F.col("_cnt")} | {f"_t_{n}": F.col(f"_more.s_{n}") for n in series}
    located = ranked.running(sums={"_upto": "_cnt"}, totals=totals).rows()

    def at_rank(rank: Column) -> Column:
        return F.max(
            F.when((F.col("_upto") - F.col("_cnt") <= rank) & (rank < F.col("_upto")), F.col(value))
        )

    def position(p: float) -> Column:
        return F.lit(p) * (F.col("_n") - 1)

    def off(n: str) -> Column:
        """Distance of a fold's mean from the mean of its key."""
        return F.try_divide(F.col(f"_more.s_{n}"), F.col("_cnt")) - F.try_divide(F.col(f"_t_{n}"), F.col("_n"))

    picked = [F.max("_n").alias("_n"), F.max(value).alias("max_value"), *[F.sum(f"_more.k_{n}").alias(n) for n in counts]]
    for name, p in probs.items():
        picked += [
            at_rank(F.floor(position(p))).alias(f"_lo_{name}"),
            at_rank(F.ceil(position(p))).alias(f"_hi_{name}"),
        ]
    for n in series:
        picked += [
            F.max(F.try_divide(F.col(f"_t_{n}"), F.col("_n"))).alias(f"{n}_mean"),
            F.sum(F.col(f"_more.ss_{n}") + F.col("_cnt") * off(n) * off(n)).alias(f"{n}_ss"),
            F.min(f"_more.low_{n}").alias(f"{n}_low"),
            F.max(f"_more.high_{n}").alias(f"{n}_high"),
        ]
    for a, b in products:
        both = F.col(f"_more.ss_{a}_{b}") + F.col("_cnt") * off(a) * off(b)
        picked.append(F.sum(both).alias(f"{a}_{b}_ss"))

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        part = position(p) - F.floor(position(p))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    result = located.groupBy(*inner).agg(*picked)
    moments = [c for c in result.columns if c not in inner and not c.startswith("_")]
    found = result.select(
        *keys, *[between(name, p).alias(name) for name, p in probs.items()], F.col("_n").alias("n"), *moments
    )
    if keys:
        return found
    # without keys there is one row, also over no values
    whole = [F.coalesce(F.max(c), F.lit(0)).alias(c) if c in ("n", *counts) else F.max(c).alias(c) for c in found.columns]
    return found.agg(*whole)


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    chunk: Column | None = None,
) -> DataFrame:
    """Exact percentiles per key with linear interpolation; keys without a value have no row."""
    found = profile(df.where(F.col(value).isNotNull()), keys, value, probs, chunk=chunk)
    return found.select(*keys, *probs)


def deviation(ss: str, n: Column) -> Column:
    """Standard deviation from summed squares of deviations, NULL over too few rows."""
    return F.when(n > 0, F.sqrt(F.try_divide(F.col(ss), n)))


def box_stats(df: DataFrame, keys: Sequence[str], value: str, **limits) -> DataFrame:
    """Minimum, quartiles and maximum per key."""
    probs = {"lowest": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "highest": 1.0}
    return percentiles(df, keys, value, probs, **limits)


def histogram(df: DataFrame, value: str, width: float, origin: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per bin ``floor((value - origin) / width)``."""
    binned = df.where(F.col(value).isNotNull()).withColumn(
        "bin", F.floor((F.col(value) - F.lit(origin)) / F.lit(width))
    )
    return (
        binned.groupBy(*keys, "bin")
        .agg(F.count("*").alias("n"))
        .withColumn("bin_start", F.lit(origin) + F.col("bin") * F.lit(width))
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL when either side does not vary.

    The built-in one raises a division error on a constant side in ANSI mode.
    """
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def error_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """MAE, RMSE, R2, Pearson r, largest error and n; rows with a NULL side are left out.

    R2 is 1 - SSE/SST, written with sums so that one aggregate is enough.
    """
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    pairs = df.where(y.isNotNull() & p.isNotNull())
    n = F.count("*")
    sst = F.var_pop(y) * n
    return pairs.groupBy(*keys).agg(
        S.rounded(F.avg(F.abs(e)), digits).alias("mae"),
        S.rounded(F.sqrt(F.avg(e * e)), digits).alias("rmse"),
        S.rounded(1 - F.try_divide(F.sum(e * e), sst), digits).alias("r2"),
        S.rounded(correlation(y, p), digits).alias("corr"),
        S.rounded(F.max(F.abs(e)), digits).alias("max_error"),
        n.alias("n"),
    )


def spread(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6, **limits) -> DataFrame:
    """Mean, median, sample standard deviation, maximum and count per key, from one read."""
    keys = list(keys)
    found = profile(df, keys, value, {"median": 0.5}, {"v": F.col(value)}, **limits)
    return found.select(
        *keys,
        S.rounded("v_mean", digits).alias("mean"),
        S.rounded(deviation("v_ss", F.col("n") - 1), digits).alias("std"),
        F.col("max_value").alias("highest"),
        "n",
        S.rounded("median", digits).alias("median"),
    )


def residual_summary(df: DataFrame, actual: str, predicted: str, digits: int = 6, **limits) -> DataFrame:
    """Mean, population deviation, range and upper percentiles of |residual|, from one read."""
    residual = F.col(actual) - F.col(predicted)
    sizes = df.select(residual.alias("residual"), F.abs(residual).alias("size"))
    probs = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    found = profile(sizes, [], "size", probs, {"residual": F.col("residual")}, **limits)
    figures = {
        "mean_residual": F.col("residual_mean"),
        "std_residual": deviation("residual_ss", F.col("n")),
        "min_residual": F.col("residual_low"),
        "max_residual": F.col("residual_high"),
        **{p: F.col(p) for p in probs},
    }
    return found.select(*[S.rounded(c, digits).alias(name) for name, c in figures.items()])
