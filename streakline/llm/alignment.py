"""Alignment of two tokenizers over whole texts, in Arrow.

The ids of a slice of documents lie in list columns. Flattened, with parent
indices and running sums of token lengths that start anew at each document,
every token gets the key (document, byte at which it ends). A hash join on that
key tells which ends both tokenizers share: those cut the tokens into groups.
Between two neighbouring ends of either tokenizer lies exactly one pair of
overlapping tokens, so the ordered outer join, filled backwards, lists all
links without forming pairs.

Links are counted by id pair within a bundle of documents; Spark merges these
partial counts, and every bundle gets the totals of its own pairs back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm.common import stored
from streakline.llm.vocabulary import (
    PieceEncoder,
    Pieces,
    byte_bpe_encoder,
    byte_bpe_tokens,
    gathered,
    piece_bpe_encoder,
    piece_bpe_tokens,
    text_slices,
)

#: Bytes of text in a slice that is aligned at once, and slices in a bundle.
SLICE_BYTES, SLICES = 2 << 20, 8
#: Words of each tokenizer that a worker remembers.
REMEMBERED = 200_000
#: A pair of ids in one number, and a key (document, end) in one.
LOW = (1 << 32) - 1
_OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Vocabulary:
    """Bytes of all ids: their lengths, their bytes in a row and their numbers as text."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = pa.array([str(i) for i in range(len(tokens))])


@lru_cache(maxsize=2)
def _vocabularies(a_path: str, b_path: str) -> tuple[Vocabulary, Vocabulary]:
    return Vocabulary(byte_bpe_tokens(a_path)), Vocabulary(piece_bpe_tokens(b_path))


class Side:
    """Ids of one tokenizer for all texts of a slice, in a row; ``offsets`` by text."""

    def __init__(self, cut: Pieces, pieces: list[str], encoder: PieceEncoder, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.piece_ends, self.piece_ids = encoder.ids(pieces)  # of the distinct pieces
        out, self.ids = gathered(self.piece_ends, self.piece_ids, cut.index)
        self.offsets = out[cut.offsets]

    def true_pieces(self, wanted: pa.Array) -> np.ndarray:
        """Whether the tokens' bytes of each distinct piece are those of ``wanted``."""
        if not len(wanted):
            return np.zeros(0, bool)
        offsets = np.frombuffer(wanted.buffers()[1], np.int64, len(wanted) + 1)
        data = np.frombuffer(wanted.buffers()[2] or b"", np.uint8)
        sizes = np.concatenate([[0], np.cumsum(self.vocabulary.sizes[self.piece_ids])])[self.piece_ends]
        good = (sizes[1:] - sizes[:-1]) == (offsets[1:] - offsets[:-1])
        _, made = gathered(self.vocabulary.offsets, self.vocabulary.bytes, self.piece_ids)
        if good.all() and np.array_equal(made, data[offsets[0] : offsets[-1]]):
            return good
        at = np.flatnonzero(good)
        _, ours = gathered(sizes, made, at)
        ends, theirs = gathered(offsets, data, at)
        wrong = np.concatenate([[0], np.cumsum(ours != theirs)])
        good[at] = wrong[ends[1:]] == wrong[ends[:-1]]
        return good

    def spells(self, row: int, text: str) -> bool:
        """Whether the joined bytes of the text's tokens are a space and the text."""
        ids = self.ids[self.offsets[row] : self.offsets[row + 1]]
        return b"".join(self.vocabulary.tokens[i] for i in ids.tolist()) == f" {text}".encode()

    def column(self, rows: np.ndarray) -> pa.LargeListArray:
        offsets, ids = gathered(self.offsets, self.ids, rows)
        return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids))


def _ends(column: pa.LargeListArray, sizes: np.ndarray) -> pa.Array:
    """The key (document, end) of every token: running sums of lengths that start anew with each list."""
    parent = pc.list_parent_indices(column)
    running = pc.cumulative_sum(pa.array(sizes).take(pc.list_flatten(column)))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running])
    base = before.take(column.offsets[:-1])
    return pc.add(pc.shift_left(parent, pa.scalar(32, pa.int64())), pc.subtract(running, base.take(parent)))


def _joined(ids: pa.Array, names: pa.Array, last: np.ndarray) -> pa.Array:
    """Numbers of each group's ids, joined by commas; ``last`` marks the last id of a group."""
    offsets = np.concatenate([[0], np.flatnonzero(last) + 1])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(ids)), ",")


class Aligned:
    """Links and groups of a slice of texts."""

    def __init__(self, texts: pa.Array, a_path: str, b_path: str):
        a_words, b_words = _vocabularies(a_path, b_path)
        cut = Pieces(texts)
        spaced = [" " + v for v in cut.values]
        a = Side(cut, spaced, byte_bpe_encoder(a_path, True, REMEMBERED), a_words)
        b = Side(cut, cut.values, piece_bpe_encoder(b_path, REMEMBERED), b_words)
        wanted = pa.array(spaced, pa.large_string())
        true = a.true_pieces(wanted) & b.true_pieces(wanted)
        false = np.concatenate([[0], np.cumsum(~true[cut.index])])[cut.offsets]
        filled = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        usable = filled & (false[1:] == false[:-1])
        for row in np.flatnonzero(filled & ~usable).tolist():
            text = texts[row].as_py()
            usable[row] = a.spells(row, text) and b.spells(row, text)
        self.rows, self.n = np.flatnonzero(usable), len(texts)
        columns = {"a": a.column(self.rows), "b": b.column(self.rows)}
        self.n_a, self.n_b = (pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in columns.values())
        sides = [
            pa.table({"key": _ends(columns[name], words.sizes), name: pc.list_flatten(columns[name])})
            for name, words in (("a", a_words), ("b", b_words))
        ]
        ends = sides[0].join(sides[1], "key", join_type="full outer", use_threads=False).combine_chunks().sort_by("key")
        key, ids_a, ids_b = (ends.column(c).combine_chunks() for c in ("key", "a", "b"))
        in_a, in_b = (pc.is_valid(x).to_numpy(zero_copy_only=False) for x in (ids_a, ids_b))
        shared = in_a & in_b
        self.doc = key.to_numpy() >> 32
        self.shared = shared
        self.pair = (pc.fill_null_backward(ids_a).to_numpy().astype(np.int64) << 32) | pc.fill_null_backward(ids_b).to_numpy()
        self._groups = pc.binary_join_element_wise(
            _joined(ids_a.drop_null(), a_words.names, shared[in_a]), _joined(ids_b.drop_null(), b_words.names, shared[in_b]), "|"
        )

    def documents(self, keys: pa.Array) -> pa.RecordBatch:
        """Per document of the slice: key, counts and the digest of its groups; zeros and '' without tokens."""
        per_doc = len(self.rows)
        n_groups = np.bincount(self.doc[self.shared], minlength=per_doc)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32())
        strings = pc.binary_join(pa.ListArray.from_arrays(offsets, self._groups), ";")
        digests = [hashlib.sha256(s.as_buffer()).hexdigest() for s in strings]
        counts = {"n_a": self.n_a, "n_b": self.n_b, "n_groups": n_groups, "n_links": np.bincount(self.doc, minlength=per_doc)}
        columns = []
        for values in counts.values():
            whole = np.zeros(self.n, np.int64)
            whole[self.rows] = values
            columns.append(pa.array(whole))
        texts = np.full(self.n, "", object)
        texts[self.rows] = digests
        return pa.record_batch([keys, *columns, pa.array(texts, pa.string())], ["key", *counts, "groups_sha256"])

    def counted(self) -> pa.Table:
        """(row, pair, n): how often each document of the slice has each pair of ids."""
        links = pa.table({"row": self.rows[self.doc], "pair": self.pair})
        return links.group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["row", "pair", "n"])


def _packed(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def _bundle(number: int, documents: list[pa.RecordBatch], entries: list[pa.Table]) -> pa.RecordBatch:
    """One row: distinct pairs with their counts in the bundle, its documents, and their pairs by place in that list."""
    held = pa.Table.from_batches(documents)
    counted = pa.concat_tables(entries).combine_chunks()
    partial = counted.group_by("pair", use_threads=False).aggregate([("n", "sum")])
    place = pc.index_in(counted["pair"], value_set=partial["pair"].combine_chunks())
    listed = pa.table({"row": counted["row"].cast(pa.uint32()), "place": place.cast(pa.uint32()), "n": counted["n"].cast(pa.uint32())})
    lists = [pa.array([partial[c].to_numpy()], pa.list_(pa.int64())) for c in ("pair", "n_sum")]
    return pa.record_batch(
        [pa.array([number]), *lists, pa.array([_packed(held)], pa.binary()), pa.array([_packed(listed)], pa.binary())],
        ["bundle", "pair", "n", "documents", "entries"],
    )


def aligned_bundles(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """(bundle, pair, n, documents, entries): aligned documents in bundles of about 16 MB of text.

    A document is never split, so a bundle is bounded by that and one document.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        documents: list[pa.RecordBatch] = []
        entries: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for some in text_slices(batch, limit=SLICE_BYTES):
                slice_ = Aligned(some.column("text"), a_path, b_path)
                documents.append(slice_.documents(some.column("key")))
                counted = slice_.counted()
                entries.append(counted.set_column(0, "row", pc.add(counted["row"], pa.scalar(rows, pa.int64()))))
                rows += some.num_rows
                if len(documents) == SLICES:
                    yield _bundle(number, documents, entries)
                    number, documents, entries, rows = number + 1, [], [], 0
        if documents:
            yield _bundle(number, documents, entries)

    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col("text"))
    return texts.mapInArrow(align, "bundle long, pair array<long>, n array<long>, documents binary, entries binary")


def pair_counts(bundles: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids in all documents, and whether no other pair of its B id has more.

    Pairs of one B id are at most as many as A has ids.
    """
    pairs = bundles.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n"))
    same = Window.partitionBy(F.col("pair").bitwiseAND(LOW))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(same))


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """Digest of each document's groups and links between the tokens of two public tokenizers.

    ``a_path`` is a byte-level vocabulary, ``b_path`` a sentence-piece model;
    both read a space before the text. Null and empty texts, and texts whose
    tokens do not spell them, have no tokens: zeros and ''. Every row stands
    for itself, whatever its key.
    """
    key_type = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    bundles = stored(aligned_bundles(docs, a_path, b_path, key))
    counts = stored(pair_counts(bundles))
    pairs = bundles.select(F.col("bundle").alias("of"), F.posexplode("pair").alias("place", "pair")).join(counts, "pair")

    def finish(bundle: pa.Table, totals: pa.Table) -> pa.Table:
        held, listed = (pa.ipc.open_stream(bundle[c][0].as_py()).read_all() for c in ("documents", "entries"))
        row, place, n = (listed[c].to_numpy().astype(np.int64) for c in ("row", "place", "n"))
        total, best = np.zeros((2, totals.num_rows), np.int64)
        at = totals["place"].to_numpy()
        total[at], best[at] = totals["n"].to_numpy(), totals["best"].to_numpy()
        made = {"n_best": n * best[place], "count_sum": n * total[place]}
        for name, values in made.items():
            sums = np.zeros(held.num_rows, np.int64)
            np.add.at(sums, row, values)
            held = held.append_column(name, pa.array(sums))
        return held.select(["key", *_OUT, "groups_sha256"]).rename_columns([key, *_OUT, "groups_sha256"])

    schema = f"`{key}` {key_type}, {', '.join(f'{c} long' for c in _OUT)}, groups_sha256 string"
    left = bundles.select("bundle", "documents", "entries").groupBy("bundle")
    return left.cogroup(pairs.select("of", "place", "n", "best").groupBy("of")).applyInArrow(finish, schema)
