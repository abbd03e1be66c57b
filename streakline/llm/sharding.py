"""Sharding: balanced label propagation over linked documents.

Documents that share a link key are neighbours; a document may have several kinds
of links. The graph is an edge table (node, hub, n): a hub stands for one key of
one kind, and all documents with it are neighbours through it, so that a group of
a third of all rows is never spelt out in pairs. Every node starts in a shard
given by a hash. In each round labels are joined to the edges, every hub counts
its documents by shard, the counts are joined back, and a node wants the shard
where most of its neighbours over all its hubs are (with a hub larger than a
shard: one of as many shards as that fills). Moves are accepted with a
probability that keeps each shard within its quota of rows. A last step evens the
counts exactly: what a shard holds beyond its quota, documents without links
first, fills the shards below theirs. Only SQL functions are used.

Nodes are cells, the documents with the same links that agree in a hash of their
id, so that a group of equal texts is ``CELLS`` rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm.common import fraction, small, stored

SHARDS = 8
ROUNDS = 3
#: Parts of a group that move on their own, and of a shard that are ranked on their own.
CELLS = 64
RANKED = 64
SPLIT = 16
#: Beyond SPLIT, one more part for so many rows: a part that one task ranks does not grow with the table.
SPLIT_ROWS = 5_000_000


def _per_shard(totals: dict[int, float], shard: Column) -> Column:
    """The number that ``totals`` has for ``shard``."""
    return F.element_at(F.array(*[F.lit(totals[s]) for s in sorted(totals)]), (shard + 1).cast("int"))


def _by_shard(df: DataFrame, shards: int, shard: str, value: Column) -> dict[int, int]:
    """Sums by shard, at most ``shards`` rows."""
    found = {r[0]: r[1] for r in df.groupBy(shard).agg(F.sum(value)).collect()}
    return {s: int(found.get(s) or 0) for s in range(shards)}


def _hubs(links: Sequence[Column]) -> Column:
    """The hubs of a row, one for each kind of link that it has (64-bit hashes: a chance meeting costs a place, no row)."""
    each = [F.when(link.isNotNull(), F.xxhash64(F.lit(i), link.cast("string"))) for i, link in enumerate(links)]
    return F.array_compact(F.array(*each))


def link_edges(nodes: DataFrame) -> DataFrame:
    """Edge table (node, hub, n, total) of ``nodes`` (node, hubs, n); hubs of one document link nothing."""
    edges = stored(nodes.select("node", "n", F.explode(F.array_distinct("hubs")).alias("hub")))
    totals = stored(edges.groupBy("hub").agg(F.sum("n").alias("total")).where("total > 1"))
    return stored(edges.join(totals, "hub").select("node", "hub", "n", "total"))


def propagate_labels(edges: DataFrame, quota: int, shards: int, rounds: int) -> DataFrame:
    """(node, n, lead, shard) of every node of ``edges``; ``lead`` is its largest hub.

    A node of several hubs sees each neighbour once for each hub they share. Of
    shards with equally many neighbours, a hash of (lead, shard) prefers one.
    """
    nodes = stored(
        edges.groupBy("node")
        .agg(F.max("n").alias("n"), F.max(F.struct("total", "hub")).alias("largest"))
        .select("node", "n", F.col("largest.hub").alias("lead"), F.col("largest.total").alias("total"))
        .withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    )
    for turn in range(rounds):
        here = [F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)) for s in range(shards)]
        counts = stored(edges.join(nodes.select("node", "shard"), "node").groupBy("hub").agg(F.array(*here).alias("here")))
        seen = edges.join(counts, "hub").groupBy("node").agg(
            F.array(*[F.sum(F.col("here")[s]) for s in range(shards)]).alias("votes")
        )
        choices = [
            F.struct((-F.col("votes")[s]).alias("votes"), F.xxhash64("lead", F.lit(s)).alias("lean"), F.lit(s).alias("shard"))
            for s in range(shards)
        ]
        filled = F.least(F.ceil(F.col("total") / F.lit(max(1, quota))), F.lit(shards))
        pick = F.pmod(F.xxhash64("node", F.lit(1)), filled).cast("int") + 1
        wanting = stored(
            nodes.join(seen, "node")
            .withColumn("wants", F.element_at(F.array_sort(F.array(*choices)), pick)["shard"])
            .drop("votes")
        )
        staying = _by_shard(wanting.where("wants = shard"), shards, "shard", F.col("n"))
        coming = _by_shard(wanting.where("wants <> shard"), shards, "wants", F.col("n"))
        if not sum(coming.values()):
            return wanting
        odds = {s: min(1.0, max(0, quota - staying[s]) / coming[s]) if coming[s] else 0.0 for s in range(shards)}
        alone = F.when(F.col("total") * 4 > quota, F.col("node")).otherwise(F.lit(-1))  # a group that is large for a shard moves by parts
        accepted = fraction(F.col("lead"), alone, F.lit(turn)) < _per_shard(odds, F.col("wants"))
        nodes = wanting.withColumn("shard", F.when(accepted, F.col("wants")).otherwise(F.col("shard"))).drop("wants")
    return stored(nodes)


def cut_links(placed: DataFrame, links: Column | Sequence[Column]) -> DataFrame:
    """``placed`` (with ``shard``) with ``n_cut``: how many neighbours of a document lie in other shards.

    A neighbour by two kinds of links counts twice; without links it is 0. The
    sum over all documents is twice the number of cut edges. Rows that repeat
    each other are neighbours by their link. A column ``n_cut`` is replaced.
    """
    links = [links] if isinstance(links, Column) else list(links)
    kept = [c for c in placed.columns if c != "n_cut"]
    rows = placed.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col("shard").alias("at"),
        *[F.when(link.isNotNull(), F.xxhash64(F.lit(i), link.cast("string"))).alias(f"hub{i}") for i, link in enumerate(links)],
    )
    for i in range(len(links)):
        hub = F.col(f"hub{i}")
        held = stored(rows.where(hub.isNotNull()).groupBy(hub.alias("hub"), "at").agg(F.count(F.lit(1)).alias("n")))
        # only hubs in two shards or more have cut edges
        whole = held.groupBy("hub").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("places")).where("places > 1")
        cut = stored(held.join(stored(whole), "hub").select(F.col("hub").alias(f"hub{i}"), "at", (F.col("total") - F.col("n")).alias(f"cut{i}")))
        rows = rows.join(cut, [f"hub{i}", "at"], "left")
    n_cut = reduce(lambda a, b: a + b, [F.coalesce(f"cut{i}", F.lit(0)) for i in range(len(links))], F.lit(0))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], n_cut.cast("long").alias("n_cut"))


def propagate_shards(
    docs: DataFrame,
    link: Column | Sequence[Column],
    key: str = "doc_id",
    shards: int = SHARDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``link`` is the key that neighbours share, or a list of such keys, one for
    each kind of link; null means no neighbour. Counts of the shards differ by
    one at most. The result depends on the rows alone: reruns agree. Rows that
    repeat each other are neighbours by their link and take places of their own;
    a null key is a value like any other. An empty table gives an empty result.
    Columns named ``shard`` or ``slot`` are replaced; others stay, whatever
    their names.
    """
    links = [link] if isinstance(link, Column) else list(link)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{key}`").alias("id"), _hubs(links).alias("hubs")
    ).withColumn("node", F.xxhash64("hubs", F.pmod(F.xxhash64("id"), F.lit(CELLS))))
    counted = stored(packed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("hubs").alias("hubs")))
    rows = counted.agg(F.sum("n")).first()[0] or 0
    linked = propagate_labels(link_edges(counted), -(-rows // shards), shards, rounds).select(
        "node", "lead", F.col("shard").alias("group_shard")
    )
    split = max(SPLIT, rows // SPLIT_ROWS)
    placed = packed.drop("hubs").join(linked, "node", "left").withColumns(
        {
            "shard": F.coalesce("group_shard", F.pmod(F.xxhash64("id", F.lit(shards)), F.lit(shards)).cast("int")),
            # documents without links come last and are the first to move
            "part": F.when(F.col("group_shard").isNotNull(), F.pmod("lead", F.lit(RANKED))).otherwise(
                F.pmod(F.xxhash64("id", F.lit(1)), F.lit(RANKED)) + RANKED
            )
            * split
            + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(split)),
        }
    )
    parts = stored(placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")))
    held = _by_shard(parts, shards, "shard", F.col("n"))
    quota = {s: rows // shards + (s < rows % shards) for s in range(shards)}
    over, under, room_from, over_from = 0, 0, {}, {}
    for s in range(shards):
        over_from[s], room_from[s] = over, under
        over += max(0, held[s] - quota[s])
        under += max(0, quota[s] - held[s])
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = small(stored(parts.withColumn("offset", before).select("shard", "part", "offset")))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("lead", "node", "id"))
    ranked = placed.withColumn("within", within).join(offsets, ["shard", "part"]).withColumn(
        "rank", F.col("offset") + F.col("within") - 1
    )
    moving = F.col("rank") - _per_shard(quota, F.col("shard")) + _per_shard(over_from, F.col("shard"))
    open_ = [s for s in range(shards) if held[s] < quota[s]]
    new_shard, new_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in open_:
        fits = F.col("moving") >= room_from[s]
        new_shard = F.when(fits, F.lit(s)).otherwise(new_shard)
        new_slot = F.when(fits, F.col("moving") - room_from[s] + held[s]).otherwise(new_slot)
    stays = F.col("rank") < _per_shard(quota, F.col("shard"))
    return ranked.withColumn("moving", moving).select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.when(stays, F.col("shard")).otherwise(new_shard).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(new_slot).cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame) -> DataFrame:
    """Digest: every document's size, checksum, shard, slot and cut links; equal texts are neighbours.

    ``n_cut`` is the number of rows with an equal text in other shards. Size is the text's UTF-8 bytes plus 1 (null text: 1); a null text has a null
    checksum and no neighbours.
    """
    lean = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    link = F.when(F.col("text_crc32").isNotNull(), F.concat_ws(":", "text_hash", "text_crc32", "size"))
    lean = stored(lean.withColumn("link", link))
    placed = cut_links(propagate_shards(lean, F.col("link")), F.col("link"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "n_cut",
    )
