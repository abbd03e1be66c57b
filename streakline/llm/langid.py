"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from training
texts, in lower case. A text, in lower case too, is encoded block by block with
the one dictionary of each language, whatever its length; the language whose
dictionary makes it smallest is the answer, and a text whose smallest size
hardly differs from the second is rejected. So a language with little training
text seldom wins, and never by the number of its dictionaries.

Training texts are a bounded sample: ``PER_LANG`` documents of each language,
chosen by a hash, ``PIECE`` characters of each, fewer where languages are very
many, so that all dictionaries together stay within ``ALL_BYTES``. Prediction
covers every document and its whole text, one dictionary after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
PER_LANG = 64
PIECE = 1_500
#: Bytes that are encoded against the dictionary at once; short enough that the text cannot learn from itself.
BLOCK = 2_048
LEVEL = 6
#: Relative distance of the two smallest sizes below which an answer is rejected.
MARGIN = 0.01
#: Characters of training text of all languages together.
ALL_BYTES = 32 << 20

_SCHEMA = "lang_pred string, score double, margin double, rejected boolean"


def sample_texts(docs: DataFrame, usable: Column, key: str = "doc_id") -> list[tuple[str, bytes]]:
    """(language, dictionary content), most frequent language first; at most ``PER_LANG * PIECE`` characters each.

    ``usable`` selects training rows; rows with null text or language never
    count. Rows are ranked before the shuffle, so a hot language sends
    ``PER_LANG`` rows per task. Pieces start at a place given by the hash.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", F.xxhash64(F.col(f"`{key}`"), F.lit(5)).alias("draw"), "text"
    )
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(
        F.col("place") <= PER_LANG
    )
    start = F.when(F.length("text") > PIECE, F.pmod("draw", F.length("text") - PIECE)).otherwise(F.lit(0)) + 1
    pieces = ranked.select("lang", "place", F.substring("text", start, F.lit(PIECE)).alias("piece"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(1, ALL_BYTES // (PER_LANG * max(1, len(counts))))
    pieces = pieces.withColumn("piece", F.substring("piece", 1, min(PIECE, share)))
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in pieces.collect():
        by_lang.setdefault(r["lang"], []).append((r["place"], r["piece"]))
    # the encoder's nearest, cheapest matches are at the end of a dictionary
    return [
        (lang, "\n".join(p for _, p in sorted(by_lang[lang], reverse=True)).lower().encode())
        for lang in sorted(by_lang, key=lambda x: (-counts[x], x))
    ]


def _encoders(model: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, zstandard.ZstdCompressor]]:
    """(language, encoder) one after the other, so that only one dictionary's tables are in memory."""
    for lang, content in model:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        yield lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False)


def classified(texts: Iterable[str | None], encoders: Iterable[tuple[str, zstandard.ZstdCompressor]]) -> list[tuple[str, float, float, bool]]:
    """(language, score, margin, rejected) of each text.

    Null texts and texts without a letter are ``und``, score 0, rejected. Of
    equal sizes the earlier, more frequent language wins. The score is 0.5 for
    a tie and rises to 1 with the margin, the relative distance of the two
    smallest sizes; a single language has margin 1.
    """
    data = [t.lower().encode("utf-8", "replace") if t is not None and any(map(str.isalpha, t)) else None for t in texts]
    best: list[tuple[int, str] | None] = [None] * len(data)
    second = [0] * len(data)
    for lang, encoder in encoders:
        for i, own in enumerate(data):
            if own is None:
                continue
            size = sum(len(encoder.compress(own[at : at + BLOCK])) for at in range(0, len(own), BLOCK))
            if best[i] is None:
                best[i] = (size, lang)
            elif size < best[i][0]:
                second[i], best[i] = best[i][0], (size, lang)
            elif not second[i] or size < second[i]:
                second[i] = size
    found = []
    for one, other in zip(best, second):
        if one is None:
            found.append((UNKNOWN, 0.0, 0.0, True))
            continue
        margin = (other - one[0]) / other if other else 1.0
        found.append((one[1], min(1.0, 0.5 + 4 * margin), margin, margin < MARGIN))
    return found


def classify(text: str | None, encoders: Iterable[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, float, bool]:
    """:func:`classified` of one text."""
    return classified([text], encoders)[0]


def identify(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected, which replace columns of those names.

    Reads ``text`` only. With an empty model (no training rows) every answer is
    ``und``. Other columns are carried along, whatever their names.
    """
    model_ = tuple(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "rejected")]

    @F.pandas_udf(_SCHEMA)
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = classified(texts, _encoders(model_))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "rejected"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), answer("text").alias("answer"))
    return packed.select("row.*", "answer.*")


def held_out(key: str = "doc_id") -> Column:
    """Rows that no training uses: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """Digest: predicted language of every document, learned from those that are not held out.

    A null id is not held out.
    """
    model = sample_texts(docs, ~held_out())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def confident_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is rejected; same columns.

    Null and empty texts, texts without a letter and, where no row is labelled,
    all texts are rejected. Rows that repeat each other stay or go together.
    """
    answered = identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"), sample_texts(docs, ~held_out()))
    return answered.where(~F.col("rejected")).select("doc.*")
