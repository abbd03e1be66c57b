"""Benchmark decontamination: pigeonhole edit matching.

An item that may differ in at most ``k`` edits is cut into ``k + 1`` pieces; a
text that holds the item within ``k`` edits holds one piece unchanged. All
pieces are looked for at once with an automaton, and the stretch of text around
a hit is verified with Myers' bit-parallel distance, one big integer per row of
the edit matrix. Items and texts are compared in lower case with runs of white
space as one space.

Items are a small table of their own. The driver passes over it once and hands
out blocks of at most ``BLOCK_CHARS`` characters; each block is run against all
rows of the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edits allowed per character of an item.
RATE = 0.05
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """(edit budget, [(offset, piece)]): the budget plus one pieces of nearly equal length."""
    budget = min(int(rate * len(item)), len(item) - 1)
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any part of ``text``, where the first such part ends).

    ``masks`` has for each character the bits of the pattern's places with it.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, at = length, 0
    for place, char in enumerate(text, 1):
        same = masks.get(char, 0)
        cross = same | down
        run = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(run | up) & full, up & run
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = (fall | ~(cross | rise)) & full, rise & cross
        if score < best:
            best, at = score, place
    return best, at


class Matcher:
    """Finds normalised items in texts within their edit budgets."""

    def __init__(self, items: Iterable[str], rate: float = RATE):
        self.items, self.budget, self.masks = list(items), [], []
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(self.items):
            budget, parts = pieces(item, rate)
            masks: dict[str, int] = {}
            for i, char in enumerate(item):
                masks[char] = masks.get(char, 0) | 1 << i
            self.budget.append(budget)
            self.masks.append(masks)
            for offset, part in parts:
                places.setdefault(part, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for part, uses in places.items():
            self.automaton.add_word(part, (len(part), uses))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of each item found, at its best place."""
        if not self.items or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for number, offset in uses:
                starts.setdefault(number, []).append(end + 1 - length - offset)
        found = []
        for number, hits in sorted(starts.items()):
            item, budget = self.items[number], self.budget[number]
            best = None
            for low, high in _stretches(sorted(set(hits)), len(item), budget):
                low, high = max(0, low), min(len(text), high)
                at = text.find(item, low, high)
                got = (0, at + len(item)) if at >= 0 else None
                if got is None:
                    distance, end = myers(self.masks[number], len(item), text[low:high])
                    got = (distance, low + end)
                if got[0] <= budget and (best is None or got < best):
                    best = got
                if best and best[0] == 0:
                    break
            if best:
                found.append((number, *best))
        return found


def _stretches(starts: list[int], length: int, budget: int) -> Iterator[tuple[int, int]]:
    """Parts of the text that hold the item if it begins near one of ``starts``; overlapping ones as one."""
    low = high = None
    for start in starts:
        a, b = start - budget, start + length + budget
        if high is not None and a <= high:
            high = b
        else:
            if high is not None:
                yield low, high
            low, high = a, b
    if high is not None:
        yield low, high


@lru_cache(maxsize=2)
def _matcher(items: tuple[str, ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def _blocks(benchmark: DataFrame, key: str) -> Iterator[tuple[list, tuple[str, ...]]]:
    """(ids, normalised texts) of distinct items that have any text, in blocks."""
    rows = benchmark.select(F.col(f"`{key}`").alias("id"), F.col("text")).where(F.length(F.trim("text")) > 0).dropDuplicates()
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if size and size + len(text) > BLOCK_CHARS:
            yield ids, tuple(texts)
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(text)
        size += len(text)
    if ids:
        yield ids, tuple(texts)


def _finder(ids: list, texts: tuple[str, ...], rate: float, schema: T.DataType):
    @F.pandas_udf(schema)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(texts, rate)
        for batch in batches:
            hits = (matcher.find(normal(text)) for text in batch)
            yield pd.Series([[{"item_id": ids[n], "distance": d, "end": e} for n, d, e in own] for own in hits], dtype=object)

    return found


def _holder(texts: tuple[str, ...], rate: float):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(texts, rate)
        for batch in batches:
            yield pd.Series([bool(matcher.find(normal(text))) for text in batch], dtype=bool)

    return holds


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, item_key: str = "item_id") -> DataFrame:
    """(doc, item_id, distance, end): every benchmark item that a row of ``docs`` holds, ``doc`` being the whole row.

    Null and empty texts hold nothing; items without text are held by nothing.
    Items that repeat each other are reported each with its id, rows that repeat
    each other each for itself. ``end`` counts characters of the normalised text.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("_text"))
    item_type = benchmark.schema[item_key].dataType
    hit = T.StructType(
        [T.StructField("item_id", item_type), T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
    result = None
    for ids, texts in _blocks(benchmark, item_key):
        hits = packed.select("doc", F.inline(_finder(ids, texts, rate, T.ArrayType(hit))("_text")))
        result = hits if result is None else result.unionByName(hits)
    if result is None:
        return packed.select("doc", F.inline(F.array().cast(T.ArrayType(hit))))
    return result


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Report: doc_id, item_id, distance and end of each benchmark item that a document holds."""
    found = find_items(docs.select("doc_id", "text"), benchmark, rate)
    return found.select("doc.doc_id", "item_id", "distance", "end")


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without those that hold a benchmark item; same columns."""
    held = None
    for _, texts in _blocks(benchmark, "item_id"):
        holds = _holder(texts, rate)("text")
        held = holds if held is None else held | holds
    if held is None:
        return docs
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return packed.where(~held).select("doc.*")
