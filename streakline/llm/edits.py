"""Document fingerprints by randomised edit embedding.

All texts take the same random walk: at output place ``j`` the walk writes the
current character and moves on in the text if a shared random bit of (place,
character) says so. Two texts that differ in few edits fall into step again
soon after each, so their outputs differ in few places: edit distance becomes
Hamming distance. A fingerprint samples bits of the output at places that all
texts share. Places are drawn by powers of two, fewer for lower ones, so that
texts of different length are compared at common places.

Near copies are searched by bands of sampled bits and verified by edit
distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm.common import components, stored

SEED = 11
#: The shared bits repeat after so many places; characters share them by class.
PERIOD = 1_024
CLASSES = 256
#: Bits sampled between the highest power of two in a text's output and its end; half as many in each power below.
SAMPLES = 256
LEVELS = 9
EMPTY = "0" * 16
BAND_BITS = 16
BANDS = 4


@lru_cache(maxsize=1)
def _steps() -> list[list]:
    """By place: the place after each character as a reference to its own list, and last the place's number."""
    bits = np.random.default_rng(SEED).integers(0, 2, (PERIOD, CLASSES), np.int8)
    following = np.empty((PERIOD, CLASSES), np.int64)
    ahead = np.argmax(bits, axis=0)  # the first moving place, one period on
    later = ahead + PERIOD
    for place in range(PERIOD - 1, -1, -1):
        later = np.where(bits[place] == 1, place, later)
        following[place] = (later + 1) % PERIOD
    rows: list[list] = [[] for _ in range(PERIOD)]
    for place, row in enumerate(rows):
        row.extend(map(rows.__getitem__, following[place].tolist()))
        row.append(place)
    return rows


@lru_cache(maxsize=64)
def _places(level: int) -> np.ndarray:
    """The sampled places in [2^level, 2^(level + 1))."""
    draws = np.random.default_rng([SEED, level]).random(SAMPLES)
    return ((1 << level) * (1 + draws)).astype(np.int64)


def _codes(text: str) -> bytes:
    """One byte per code point: itself below 256, else a hash."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(points < 256, points, (points * np.uint32(2654435761)) >> np.uint32(17)).astype(np.uint8).tobytes()


class Walk:
    """The walk over a text: ``places[i]`` is where output begins for character ``i``; one more for the end."""

    def __init__(self, codes: bytes, places: np.ndarray):
        self.codes, self.places = codes, places

    @classmethod
    def over(cls, text: str) -> Walk:
        codes = _codes(text)
        return cls(codes, _walked(codes, 0))

    def edited(self, keep: int, tail: bytes) -> Walk:
        """The walk of this text's first ``keep`` characters followed by ``tail``: the common part is not walked again."""
        more = _walked(tail, int(self.places[keep]))
        return Walk(self.codes[:keep] + tail, np.concatenate([self.places[:keep], more]))

    def fingerprint(self) -> str:
        """Output length (16 digits) and sampled bits, in hexadecimal; of an empty text 16 zeros."""
        length = int(self.places[-1])
        if not length:
            return EMPTY
        top = length.bit_length() - 1
        at = np.concatenate([_places(m)[: SAMPLES >> (top - m)] for m in range(top, max(-1, top - LEVELS), -1)])
        inside = at < length
        chars = np.frombuffer(self.codes, np.uint8)[np.searchsorted(self.places, at[inside], "right") - 1]
        mixed = (at[inside].astype(np.uint64) * np.uint64(CLASSES) + chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = np.zeros(len(at), np.uint8)
        bits[inside] = (mixed >> np.uint64(47)) & np.uint64(1)
        return f"{length:016x}{np.packbits(bits).tobytes().hex()}"


def _walked(codes: bytes, start: int) -> np.ndarray:
    rows = _steps()
    state = np.fromiter(map(itemgetter(CLASSES), accumulate(codes, getitem, initial=rows[start % PERIOD])), np.int64, len(codes) + 1)
    places = np.empty(len(state), np.int64)
    places[0] = start
    np.cumsum((state[1:] - state[:-1]) % PERIOD, out=places[1:])
    places[1:] += start
    return places


def _levels(print_: str) -> tuple[int, int, dict[int, np.ndarray]]:
    """(length, top level, bits by level)."""
    length, body = int(print_[:16], 16), print_[16:]
    if not length:
        return 0, -1, {}
    top, at, found = length.bit_length() - 1, 0, {}
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(body), np.uint8))
    for m in range(top, max(-1, top - LEVELS), -1):
        found[m] = bits[at : at + (SAMPLES >> (top - m))]
        at += SAMPLES >> (top - m)
    return length, top, found


def likeness(one: str, other: str) -> float:
    """Estimated share of equal output of two fingerprints, 0 to 1; equal fingerprints 1, an empty text and another 0.

    Unrelated texts agree in half of their bits; that counts as 0.
    """
    if one == other:
        return 1.0
    (len_a, top_a, a), (len_b, top_b, b) = _levels(one), _levels(other)
    top, score, total = max(top_a, top_b), 0, 0
    for m in range(top, max(-1, top - LEVELS), -1):
        at = _places(m)[: SAMPLES >> (top - m)]
        in_a, in_b = at < len_a, at < len_b
        total += int((in_a | in_b).sum())
        both = in_a & in_b
        if both.any() and m in a and m in b:
            same = a[m][: len(at)][both] == b[m][: len(at)][both]
            score += 2 * int(same.sum()) - len(same)
    return max(0.0, score / total) if total else 0.0


def _described(text: str, walk: Walk, next_text: str, next_walk: Walk) -> tuple:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of a text and the next."""
    replaced = len(text) // 2
    keep = len(text) - replaced
    edited = text[:keep] + next_text[:replaced]
    own, theirs = walk.fingerprint(), walk.edited(keep, next_walk.codes[:replaced]).fingerprint()
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    near = likeness(own, theirs), likeness(own, next_walk.fingerprint())
    return len(text), sha, bytes.fromhex(own), bytes.fromhex(theirs), *near


_MADE = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_MADE_TYPES = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, each with what follows from the next. A partition's first text comes as ``head``, its last row unfinished with ``tail``."""
    part = TaskContext.get().partitionId()
    columns = ["id", *_MADE, "part", "head", "tail"]
    before, first = None, None
    for batch in batches:
        made = []
        for id_, text in zip(batch["id"], batch["text"]):
            text = text or ""
            walk = Walk.over(text)
            if before is None:
                first = text
            else:
                made.append((before[0], *_described(*before[1:], text, walk), part, None, None))
            before = (id_, text, walk)
        yield pd.DataFrame(made, columns=columns).astype({"id": batch["id"].dtype})
    if before is not None:
        yield pd.DataFrame([(before[0], *[None] * len(_MADE), part, first, before[1])], columns=columns)


def _finish(tails: pd.Series, heads: pd.Series) -> pd.DataFrame:
    rows = [_described(tail, Walk.over(tail), head, Walk.over(head)) for tail, head in zip(tails, heads)]
    return pd.DataFrame(rows, columns=_MADE)


def edit_fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest: fingerprints of every text, of its edited text, and how alike they and the next document's are.

    The next document follows in ascending order of the key, null keys first;
    rows with equal keys are ordered by text. The last row's next is the first
    row, of a single row the row itself. A null text is empty. Texts are moved
    once, sorted by range; only the texts at the borders of partitions move
    again, two for each partition.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    spread = F.xxhash64("text")
    id_type = rows.schema["id"].dataType.simpleString()
    made = stored(
        rows.repartitionByRange(F.col("id").asc_nulls_first(), spread)
        .sortWithinPartitions(F.col("id").asc_nulls_first(), spread, "text")
        .mapInPandas(_stream, f"id {id_type}, {_MADE_TYPES}, part int, head string, tail string")
    )
    borders = stored(made.where("tail is not null").select("id", "part", "head", "tail"))
    # one row per partition, without its texts
    order = Window.orderBy("part")
    before = borders.select(
        F.col("part").alias("next_part"),
        F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("part"),
    )
    heads = borders.select(F.col("part").alias("next_part"), F.col("head").alias("next_head"))
    last = borders.join(before, "part").join(heads, "next_part")
    finished = last.select("id", F.pandas_udf(_finish, f"struct<{_MADE_TYPES.replace(' ', ':').replace(',:', ',')}>")("tail", "next_head").alias("x"))
    whole = made.where("tail is null").select("id", *_MADE).unionByName(finished.select("id", "x.*"))
    texts = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}  # stored as bytes, half as long
    return whole.withColumns(texts).withColumnRenamed("id", key)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance with one big integer per row (Myers, Hyyro)."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, char in enumerate(a):
        masks[char] = masks.get(char, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for char in b:
        same = masks.get(char, 0)
        cross = same | down
        run = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(run | up) & full, up & run
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = (fall | ~(cross | rise)) & full, rise & cross
    return score


def _bands(print_: str) -> list[str]:
    """Keys of bands of sampled bits; texts on both sides of a power of two share a level."""
    _, top, bits = _levels(print_)
    if top < 8:
        return [f"short:{print_}"]
    size = BAND_BITS
    return [f"{m}:{k}:{np.packbits(bits[m][k * size : (k + 1) * size]).tobytes().hex()}" for m in (top - 1, top - 2) for k in range(BANDS)]


def edit_near_copies(docs: DataFrame, rate: float = 0.1, key: str = "doc_id") -> DataFrame:
    """(key, class_id): texts within ``rate`` edits per character of the smallest row of a shared band are one class.

    Texts that share a band of sampled bits are compared with the band's
    smallest key, a star instead of pairs; verified links are closed
    transitively and ``class_id`` is the smallest key. Null texts are empty;
    empty texts are one class. Keys are whole numbers; equal keys are one row.
    """

    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([_bands(Walk.over(t or "").fingerprint()) for t in texts], dtype=object)

    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            limit = int(rate * max(len(x), len(y)))
            return x == y or (abs(len(x) - len(y)) <= limit and edit_distance(x, y) <= limit)

        return pd.Series([one(x or "", y or "") for x, y in zip(a, b)], dtype=bool)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"])
    same = stored(rows.select("id", F.md5("text").alias("digest")))
    first = stored(same.groupBy("digest").agg(F.min("id").alias("kept")))
    kept = rows.join(first, rows["id"] == first["kept"], "left_semi")
    banded = stored(kept.select("id", F.explode(F.pandas_udf(printed, "array<string>")("text")).alias("band")))
    leads = stored(banded.groupBy("band").agg(F.min("id").alias("lead")))
    pairs = stored(banded.join(leads, "band").where("id <> lead").select("id", "lead").distinct())
    texts = {c: kept.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text")) for c in ("id", "lead")}
    links = pairs.join(texts["id"], "id").join(texts["lead"], "lead").where(F.pandas_udf(near, "boolean")("id_text", "lead_text"))
    homes = stored(components(stored(links.select(F.col("lead").alias("a"), F.col("id").alias("b")))))
    return (
        same.join(first, "digest")
        .join(homes, F.col("kept") == F.col("node"), "left")
        .select(F.col("id").alias(key), F.coalesce("component", "kept").alias("class_id"))
    )
