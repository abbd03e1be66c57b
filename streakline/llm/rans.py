"""Token ids in files, entropy-coded by a range asymmetric numeral system with static tables.

A file holds whole documents in order of their keys. One frequency table is
shared by all of its blocks; each block is coded on its own in interleaved
lanes (lane ``i`` takes tokens ``i``, ``i + lanes``, ...), which numpy advances
together. Within a block the decoder's state is written down at checkpoints, so
a reader can begin at any of them; every stretch between two checkpoints has a
checksum of its ids, and so has everything else in the file.

File, little-endian: magic, sizes, table, documents (Arrow stream of key and
n_tokens), block index, checksum of all this, blocks. Block: n, lanes, stretches,
words; per stretch its first word and the checksum of its ids; states of all
lanes at each stretch; checksum of all this; words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm.common import small, stored
from streakline.llm.vocabulary import byte_bpe_encoder, encoded_texts, text_slices

MAGIC = b"TOKRANS1"
_SIZES = struct.Struct("<QIIII")  # tokens, bytes of table, of documents, blocks, bits of the table's sum
_BLOCK = struct.Struct("<IIII")
#: States lie in [2^31, 2^63) and move 32 bits at a time.
LOW = 31
_PLACE = (1 << 21) - 1
#: Tokens after which a file is closed (with the document that passes it), of a block, and between checkpoints.
FILE_TOKENS, BLOCK_TOKENS, STRETCH_TOKENS = 1 << 22, 1 << 20, 1 << 19
LANES = 4_096


class BadFile(ValueError):
    """A file that is cut short, altered or not of this format."""


@dataclass
class Table:
    """Frequencies of ids that add up to ``2 ** bits``; every id has at least 1."""

    ids: np.ndarray
    counts: np.ndarray
    bits: int

    @classmethod
    def of(cls, tokens: np.ndarray) -> Table:
        """By how often ids occur; what rounding leaves goes to the most frequent."""
        seen = np.bincount(tokens, minlength=1)
        ids = np.flatnonzero(seen)
        bits = max(12, min(21, int(len(ids)).bit_length() + 5))
        room = (1 << bits) - len(ids)
        counts = 1 + (seen[ids].astype(object) * room // max(1, len(tokens))).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        if len(ids):
            counts[np.argmax(counts)] += (1 << bits) - counts.sum()
        return cls(ids.astype(np.uint32), counts, bits)

    def to_bytes(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=np.uint32(0)).astype("<u4").tobytes() + self.counts.astype("<u4").tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes, bits: int) -> Table:
        both = np.frombuffer(zlib.decompress(data), "<u4")
        half = len(both) // 2
        return cls(np.cumsum(both[:half], dtype=np.uint32), both[half:].astype(np.int64), bits)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


class Encoder:
    def __init__(self, table: Table):
        size = int(table.ids[-1]) + 1 if len(table.ids) else 1
        self.count, self.start = np.ones(size, np.int64), np.zeros(size, np.int64)
        self.count[table.ids] = table.counts
        self.start[table.ids] = table.starts()
        self.bits = table.bits

    def block(self, tokens: np.ndarray) -> bytes:
        """``tokens`` as one block; coded backwards, so that reading goes forwards."""
        n = len(tokens)
        lanes = max(1, min(LANES, n >> 8))
        steps, per = -(-n // lanes), max(1, STRETCH_TOKENS // lanes)
        count, start = self.count[tokens], self.start[tokens]
        # a count of the whole sum leaves the state as it is and never overflows
        limit = np.where(count >> self.bits, np.int64((1 << 63) - 1), count << (32 + LOW - self.bits))
        state = np.full(lanes, 1 << LOW, np.int64)
        words, at = np.empty(2 * n + lanes, np.uint32), 2 * n + lanes
        places, states = [], []
        for step in range(steps - 1, -1, -1):
            row = slice(step * lanes, min(n, step * lanes + lanes))
            x = state[: row.stop - row.start]
            full = np.flatnonzero(x >= limit[row])
            out = x[full]
            at -= len(out)
            words[at : at + len(out)] = out.astype(np.uint32)  # the low half
            x[full] = out >> 32
            f = count[row]
            times = x // f
            x += (times << self.bits) - times * f + start[row]
            if step % per == 0:
                places.append(at)
                states.append(state.copy())
        words = words[at:]
        places, states = [p - at for p in reversed(places)], states[::-1]
        checks = [zlib.crc32(tokens[i : i + per * lanes].astype("<u4").tobytes()) for i in range(0, n, per * lanes)]
        head = _BLOCK.pack(n, lanes, len(places), len(words))
        head += np.array([places, checks], "<u4").T.tobytes() + np.array(states, "<i8").tobytes()
        return head + struct.pack("<I", zlib.crc32(head)) + words.astype("<u4").tobytes()


class Decoder:
    def __init__(self, table: Table):
        self.bits, self.mask, self.ids = table.bits, (1 << table.bits) - 1, table.ids
        place = np.repeat(np.arange(len(table.ids)), table.counts)
        # by slot in one number: the id's count less 1, the slot's distance from the id's first, the id's place
        inside = np.arange(len(place)) - table.starts()[place]
        self.slots = (table.counts[place] - 1) << 42 | inside << 21 | place

    def stretches(self, block: bytes, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        """Ids of stretches ``first`` to ``last`` (exclusive) of a block; each may be read without the others."""
        n, lanes, many, n_words = _BLOCK.unpack_from(block)
        at = _BLOCK.size + 8 * many + 8 * lanes * many
        if len(block) != at + 4 + 4 * n_words or struct.unpack_from("<I", block, at)[0] != zlib.crc32(block[:at]):
            raise BadFile("head of a block")
        marks = np.frombuffer(block, "<u4", 2 * many, _BLOCK.size).reshape(many, 2)
        states = np.frombuffer(block, "<i8", lanes * many, _BLOCK.size + 8 * many).reshape(many, lanes)
        words = np.frombuffer(block, "<u4", n_words, at + 4).astype(np.int64)
        per = max(1, STRETCH_TOKENS // lanes) * lanes
        for k in range(first, many if last is None else last):
            size = min(per, n - k * per)
            found, place = np.empty(size, np.uint32), int(marks[k, 0])
            state = states[k].copy()
            for i in range(0, size, lanes):
                x = state[: min(lanes, size - i)]
                slot = self.slots[x & self.mask]
                found[i : i + len(x)] = slot & _PLACE
                x >>= self.bits
                x *= (slot >> 42) + 1
                x += slot >> 21 & _PLACE
                low = np.flatnonzero(x < 1 << LOW)
                if place + len(low) > n_words:
                    raise BadFile("words of a block")
                x[low] = (x[low] << 32) | words[place : place + len(low)]
                place += len(low)
            found = self.ids[found]
            if zlib.crc32(found.astype("<u4", copy=False).tobytes()) != int(marks[k, 1]):
                raise BadFile("ids of a stretch")
            yield found


def write_file(keys: pa.Array, counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """Documents ``keys`` with ``counts`` tokens each, ``tokens`` all of them in a row."""
    table = Table.of(tokens)
    encoder = Encoder(table)
    blocks = [encoder.block(tokens[i : i + BLOCK_TOKENS]) for i in range(0, len(tokens), BLOCK_TOKENS)]
    sink = pa.BufferOutputStream()
    documents = pa.record_batch([keys, pa.array(counts, pa.int64())], ["key", "n_tokens"])
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(documents)
    listed = sink.getvalue().to_pybytes()
    told = table.to_bytes()
    head = MAGIC + _SIZES.pack(len(tokens), len(told), len(listed), len(blocks), table.bits) + told + listed
    head += np.array([len(b) for b in blocks], "<u4").tobytes()
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *blocks])


class TokenFile:
    """A file of :func:`write_file`, checked as it is read."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC or len(content) < 8 + _SIZES.size:
            raise BadFile("magic")
        self.n_tokens, table, listed, blocks, bits = _SIZES.unpack_from(content, 8)
        at = 8 + _SIZES.size
        end = at + table + listed + 4 * blocks
        if len(content) < end + 4 or struct.unpack_from("<I", content, end)[0] != zlib.crc32(content[:end]):
            raise BadFile("head of a file")
        self.decoder = Decoder(Table.from_bytes(content[at : at + table], bits))
        documents = pa.ipc.open_stream(content[at + table : at + table + listed]).read_all().combine_chunks()
        self.keys = pc.take(documents["key"], pa.array(range(documents.num_rows))).combine_chunks()
        self.counts = documents["n_tokens"].to_numpy()
        sizes = np.frombuffer(content, "<u4", blocks, end - 4 * blocks)
        self.blocks, place = [], end + 4
        for size in sizes.tolist():
            self.blocks.append(content[place : place + size])
            place += size
        if place != len(content) or self.counts.sum() != self.n_tokens:
            raise BadFile("length of a file")

    def tokens(self) -> np.ndarray:
        parts = [s for block in self.blocks for s in self.decoder.stretches(block)]
        found = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if len(found) != self.n_tokens:
            raise BadFile("number of tokens")
        return found

    def between(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop`` (exclusive): only the stretches that hold them are decoded."""
        parts, at, first = [], 0, None
        for block in self.blocks:
            n, lanes, many, _ = _BLOCK.unpack_from(block)
            per = max(1, STRETCH_TOKENS // lanes) * lanes
            low, high = max(start, at) - at, min(stop, at + n) - at
            if low < high:
                a, b = low // per, -(-high // per)
                first = at + a * per if first is None else first
                parts += self.decoder.stretches(block, a, b)
            at += n
        return np.concatenate(parts)[start - first : stop - first] if parts else np.zeros(0, np.uint32)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", plain: bool = False) -> DataFrame:
    """(part, seq, n_tokens, content): files of all documents in ascending order of ``key``, null keys first.

    Parts are ranges of keys and files of a part follow each other; rows with
    equal keys go by text. A null text is empty; every document ends with
    ``end_id``. ``tokenizer`` is the path of the vocabulary, the same on every
    machine. Texts move once; a document is never split over files, so a file
    is bounded by ``FILE_TOKENS`` and the longest document.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encoder = byte_bpe_encoder(tokenizer, plain)
        keys: list[pa.Array] = []
        counts: list[np.ndarray] = []
        tokens: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            ids = np.concatenate(tokens)
            content = write_file(pa.concat_arrays(keys), np.concatenate(counts), ids)
            columns = [[part], [seq], [len(ids)], [content]]
            seq += 1
            for x in (keys, counts, tokens):
                x.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "seq", "n_tokens", "content"])

        for batch in batches:
            for some in text_slices(batch):
                offsets, ids = encoded_texts(some.column("text"), encoder)
                size = offsets[1:] - offsets[:-1] + 1
                ends = np.cumsum(size)
                whole = np.full(int(ends[-1]), end_id, np.uint32)
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = ids
                at, held = 0, sum(map(len, tokens))
                while at < len(size):
                    before = int(ends[at - 1]) if at else 0
                    to = min(len(size), int(np.searchsorted(ends, before + FILE_TOKENS - held)) + 1)
                    keys.append(some.column("key").slice(at, to - at))
                    counts.append(size[at:to])
                    tokens.append(whole[before : int(ends[to - 1])])
                    held += len(tokens[-1])
                    at = to
                    if held >= FILE_TOKENS:
                        yield close()
                        held = 0
        if keys:
            yield close()

    spread = F.xxhash64("text")
    order = [F.col("key").asc_nulls_first(), spread, F.col("text")]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return ordered.mapInArrow(write, "part int, seq int, n_tokens long, content binary")


def read_documents(files: DataFrame, key: str = "doc_id", key_type: str = "long") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document of ``files``, read back from their contents.

    ``files`` should be stored: it is read twice, once for the number of tokens
    of each part, of which there are as many as partitions wrote files.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, content in zip(*(batch.column(c) for c in ("part", "before", "content"))):
                file = TokenFile(content.as_py())
                ids = memoryview(file.tokens().astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(file.counts)
                starts = ends - file.counts
                checks = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [file.keys, pa.array(starts + before.as_py()), pa.array(file.counts), pa.array(checks, pa.int64())],
                    [key, "start", "n_tokens", "ids_crc32"],
                )

    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base")))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside"))
    before = stored(places.join(small(parts), "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("before")))
    placed = files.join(small(before), ["part", "seq"])
    return placed.select("part", "before", "content").mapInArrow(read, f"`{key}` {key_type}, start long, n_tokens long, ids_crc32 long")


def token_positions(docs: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """Digest: place, number and checksum of each document's ids, from files that were written and read back.

    Null and empty texts have the end id alone. Documents with equal keys are
    documents of their own, in order of their texts; a null key comes first.
    """
    key_type = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    files = stored(token_files(docs, tokenizer, key=key))
    return read_documents(files, key, key_type)
