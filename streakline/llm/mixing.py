"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words; a document of it is then worth
``target / source_size`` copies. The whole copies are taken at once. The
fractions are rounded by pairs: words are moved at random from one document of
a pair to the other until one of the two fractions is 0 or 1, and the other one
stays open for the next pair. A move keeps the pair's expected words, so a
source misses its target by less than one document. Pairs are folded within
buckets of about ``BRANCH`` documents; the one open document that a bucket
leaves goes up to the next level, a tree whose depth is the logarithm of the
largest source. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm.common import fraction, small, stored, word_count

BRANCH = 128
MOST = 3
SEED = 17
#: Large documents are paired first, so that what stays open at last is a small one.
_OPEN = "struct<words:double,r:double,id:{id},size:bigint,q:double>"


def source_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with weight and target words.

    Sources in code point order, null last, weigh 1, 2, 3 and again 1. Targets
    share the sum of sizes by weight; none exceeds ``most`` times its source,
    and the excess is shared again by weight among the others. That level is
    found in one pass over the sources in the order in which they fill up. One
    row per source, so one task orders them.
    """
    weight = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    filling = Window.orderBy("fills", F.col("source").asc_nulls_last())
    full = (
        sources.withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("fills", F.col("cap") / F.col("weight"))
        .withColumn("spent", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.col("spent")) / F.col("left"))
        .withColumn("capped", F.col("fills") <= F.col("level"))
    )
    # of the sources that do not fill up, the first one's level holds for all
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("fills"))).over(Window.partitionBy())
    return full.withColumn("common", level).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"),
    )


def _fold(items: Column, id_type: str) -> Column:
    """Rounds the items of one bucket; leaves one open and lists the others with 0 or 1."""
    open_type = _OPEN.format(id=id_type)
    done_type = f"array<struct<id:{id_type},size:bigint,extra:int>>"

    def pair(state: Column, b: Column) -> Column:
        a = state["open"]
        rise = F.least(a["words"] * (1 - a["q"]), b["words"] * b["q"])  # words that a can gain from b
        fall = F.least(a["words"] * a["q"], b["words"] * (1 - b["q"]))
        up = b["r"] * (rise + fall) < fall
        moved = F.when(up, rise).otherwise(-fall)
        first_ends = F.when(up, rise >= a["words"] * (1 - a["q"])).otherwise(fall >= a["words"] * a["q"])
        ended = F.when(first_ends, a).otherwise(b)
        stays = F.when(first_ends, b).otherwise(a)
        share = F.when(first_ends, b["q"] - moved / b["words"]).otherwise(a["q"] + moved / a["words"])
        extra = F.when(first_ends == up, F.lit(1)).otherwise(F.lit(0))
        return F.struct(
            F.struct(
                stays["words"].alias("words"),
                stays["r"].alias("r"),
                stays["id"].alias("id"),
                stays["size"].alias("size"),
                F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("q"),
            )
            .cast(open_type)
            .alias("open"),
            F.concat(
                state["done"],
                F.array(F.struct(ended["id"].alias("id"), ended["size"].alias("size"), extra.alias("extra"))).cast(done_type),
            ).alias("done"),
        )

    start = F.struct(F.element_at(items, 1).cast(open_type).alias("open"), F.array().cast(done_type).alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, pair)


def _round(units: DataFrame, most_buckets: int) -> DataFrame:
    """(source, id, size, extra) for every unit (source, bucket, id, size, words, q).

    Bucket 0 of each source is kept as change: it joins the open documents of
    the other buckets at the root, where its small documents end the large ones.
    """
    id_type = units.schema["id"].dataType.simpleString()
    decided, level, others = None, 0, most_buckets - 1
    while True:
        draw = fraction(F.col("id"), F.col("source"), F.col("size"), F.lit(SEED), F.lit(level))
        item = F.struct("words", draw.alias("r"), "id", "size", "q").cast(_OPEN.format(id=id_type))
        folding = units.where("bucket > 0") if others else units
        folded = stored(
            folding.groupBy("source", "bucket")
            .agg(F.reverse(F.array_sort(F.collect_list(item))).alias("items"))
            .select("source", "bucket", _fold(F.col("items"), id_type).alias("state"))
            .select("source", "bucket", "state.open", "state.done")
        )
        here = folded.select("source", F.inline("done"))
        decided = here if decided is None else decided.unionByName(here)
        above = F.ceil(F.col("bucket") / BRANCH) if others > BRANCH else F.lit(0).cast("long")
        opened = folded.select("source", above.alias("bucket"), "open.id", "open.size", "open.words", "open.q")
        if not others:
            last = fraction(F.col("id"), F.col("source"), F.col("size"), F.lit(SEED), F.lit(-1)) < F.col("q")
            return decided.unionByName(opened.select("source", "id", "size", last.cast("int").alias("extra")))
        units = opened.unionByName(units.where("bucket = 0"))
        level, others = level + 1, -(-others // BRANCH) if others > BRANCH else 0


def document_copies(lean: DataFrame) -> DataFrame:
    """How often the mix takes each document: (id, source, size, source_size, target, copies).

    ``lean`` is a stored table (id, source, size), size in words. Rows that
    agree in all three are one unit and get the same number of copies. A
    document without words gets the whole copies only. Sources without words
    have target 0. The result has one row for each distinct unit.
    """
    units = stored(lean.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    totals = stored(totals)
    worth = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round("worth")
    sources = stored(
        source_targets(totals.select("source", "source_size"))
        .withColumn("worth", worth)
        .withColumn("worth", F.when(F.abs(F.col("worth") - near) < 1e-12, near).otherwise(F.col("worth")))
        .withColumn("whole", F.floor("worth").cast("int"))
        .withColumn("q", F.col("worth") - F.col("whole"))
        .alias("s")
        .join(totals.select(F.col("source").alias("name"), "units"), F.col("source").eqNullSafe(F.col("name")))
        .select("source", "source_size", "target", "whole", "q", F.ceil(F.col("units") / BRANCH).alias("buckets"))
    )
    most = sources.agg(F.max("buckets")).first()[0] or 1
    params = small(sources.withColumnRenamed("source", "name"))
    full = units.join(params, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rounding = (F.col("q") > 0) & (F.col("size") > 0)
    extras = _round(
        stored(
            full.where(rounding).select(
                "source",
                F.pmod(F.xxhash64("id", "size", F.lit(SEED)), F.col("buckets")).alias("bucket"),
                "id",
                "size",
                (F.col("size") * F.col("rows")).cast("double").alias("words"),
                "q",
            )
        ),
        int(most),
    )
    none = full.where(~rounding).select("source", "id", "size", F.lit(0).alias("extra"))
    return (
        extras.unionByName(none)
        .join(params, F.col("source").eqNullSafe(F.col("name")))
        .select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))
    )


def _matching(left: DataFrame, copies: DataFrame) -> DataFrame:
    """``left`` (id, source, size, ...) with the columns of ``copies``."""
    theirs = copies.select(
        F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", "copies"
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    return left.join(theirs, same).drop("_id", "_source", "_size")


def mix_sources(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` as the mix takes them: rows dropped, kept or repeated up to ``MOST`` times; same columns.

    Needs columns ``source`` and ``text``; null texts have no words, a null
    source is one of its own, an empty table stays empty. Other columns are
    carried along whatever their names.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{key}`").alias("id"),
        "source",
        word_count(F.col("text")).alias("size"),
    )
    copies = stored(document_copies(stored(packed.select("id", "source", "size"))).where("copies > 0"))
    return _matching(packed, copies).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def mixed_words(docs: DataFrame) -> DataFrame:
    """Digest: for every row its words, its source's words and target, and the words that the mix takes."""
    lean = stored(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")))
    return _matching(lean, document_copies(lean)).select(
        F.col("id").alias("doc_id"),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )
