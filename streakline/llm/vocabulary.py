"""Token ids of whole text columns by public tokenizers.

Both vocabularies cut a text before every space that follows something other
than white space, whatever comes next: no token holds a space behind another
character, and white-space rules look no further than a run and the character
after it. A column is therefore cut there in Arrow, every distinct piece is
encoded once by the tokenizers' own library, and the ids are gathered by piece.
The result equals encoding every text whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A piece that is empty or ends in anything a library might take for white space goes on in the next one.
_OPEN = re.compile("[\\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u2581\u3000\ufeff]")
#: Pieces that a worker remembers, and ids for each on average.
REMEMBERED, LONGEST = 900_000, 16
#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def _byte_signs() -> dict[int, str]:
    """The character of a byte-level vocabulary for every byte: itself where it can be shown, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Fixed value: the pattern by which byte-level vocabularies cut text before they merge.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_bpe(path: str, plain: bool) -> Callable[[Sequence[str]], list[list[int]]]:
    """Encoder of a tokenizer file; ``plain`` takes strings of special tokens in a text for ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def byte_bpe_words(path: str, plain: bool) -> tuple[Callable[[str], list[str]], Callable[[Sequence[str]], list[list[int]]]] | None:
    """(cut, encode) of a plain byte-level vocabulary: words that merge on their own, and the ids of such words by its model.

    Strings of special tokens are not cut, unless ``plain``. None for any other kind of tokenizer.
    """
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    told = json.loads(tokenizer.to_str())
    kind = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if told["normalizer"] is not None or (told["pre_tokenizer"] or {}).items() & kind.items() != kind.items():
        return None
    added = [] if plain else [token["content"] for token in told["added_tokens"]]
    words, signs, model, whole = regex.compile(_WORDS), _byte_signs(), tokenizer.model, byte_bpe(path, plain)

    def cut(piece: str) -> list[str]:
        return [piece] if any(t in piece for t in added) else words.findall(piece)

    def encode(pieces: Sequence[str]) -> list[list[int]]:
        if any(any(t in p for t in added) for p in pieces):
            return whole(pieces)
        return [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(signs))] for p in pieces]

    return cut, encode


def piece_bpe(path: str) -> Callable[[Sequence[str]], list[list[int]]]:
    """Encoder of a sentence-piece model, which puts a space before every text; before an empty piece too."""
    model = _processor(path)
    space = [model.piece_to_id("\u2581")]
    return lambda texts: [ids or space for ids in model.encode(list(texts), num_threads=1)]


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def byte_bpe_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary; added tokens by their text."""
    from tokenizers import Tokenizer

    back = {sign: byte for byte, sign in _byte_signs().items()}
    found: dict[str, int] = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    tokens = [b""] * (1 + max(found.values()))
    for entry, number in found.items():
        tokens[number] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return tokens


def piece_bpe_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a sentence-piece model: its mark is a space, <0xHH> a byte, control pieces nothing."""
    model = _processor(path)

    def one(number: int) -> bytes:
        if model.is_byte(number):
            return bytes([int(model.id_to_piece(number)[3:5], 16)])
        return b"" if model.is_control(number) else model.id_to_piece(number).replace("▁", " ").encode()

    return [one(number) for number in range(model.get_piece_size())]


class PieceEncoder:
    """Encodes pieces word by word and remembers words in one flat buffer; when that is full, those of the last call stay.

    ``cut`` divides a piece into words that merge on their own; without it a piece is a word.
    """

    def __init__(
        self,
        encode: Callable[[Sequence[str]], list[list[int]]],
        cut: Callable[[str], list[str]] | None = None,
        remembered: int | None = None,
    ):
        self.encode, self.cut, self.remembered = encode, cut or (lambda piece: [piece]), remembered or REMEMBERED
        self.known: dict[str, int] = {}
        self.ends, self.flat, self.last = array("q", [0]), array("i"), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words of the last call only."""
        kept = np.unique(self.last)
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(kept.tolist())}
        ends, flat = gathered(np.array(self.ends), np.array(self.flat), kept)
        self.ends, self.flat = array("q", ends.tobytes()), array("i", flat.astype(np.int32).tobytes())

    def ids(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all pieces in a row."""
        if len(self.known) > self.remembered or len(self.flat) > LONGEST * self.remembered:
            self._forget()
        known, get, missing = self.known, self.known.get, repeat(-1)
        places = np.fromiter(map(get, pieces, missing), np.int64, len(pieces))
        rest = np.flatnonzero(places < 0)
        cut = [self.cut(pieces[i]) for i in rest.tolist()]
        new = list(dict.fromkeys(w for words in cut for w in words if w not in known))
        for word, ids in zip(new, self.encode(new) if new else ()):
            known[word] = len(known)
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
        counts = np.ones(len(pieces), np.int64)
        counts[rest] = np.fromiter(map(len, cut), np.int64, len(cut))
        words = np.repeat(places, counts)
        words[np.repeat(places < 0, counts)] = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts[rest].sum()))
        self.last = words
        out, ids = gathered(np.array(self.ends), np.array(self.flat), words)
        return out[np.concatenate([[0], np.cumsum(counts)])], ids


class Pieces:
    """A text column cut into pieces: ``values`` are distinct pieces, ``index`` those of all texts in a row.

    ``offsets`` tells where each text's pieces begin. A piece comes without the
    space before it; the first piece of a text has none. A null text has no
    piece, an empty one the empty piece.
    """

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        values: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = coded.indices.to_numpy()
        counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        ends = {v[-1:] for v in values}
        open_end = {e for e in ends if not e or _OPEN.match(e)}
        open_value = np.fromiter((v[-1:] in open_end for v in values), bool, len(values))
        starts = np.ones(len(index), bool)
        starts[1:] = ~open_value[index[:-1]]
        starts[offsets[:-1][counts > 0]] = True
        if not starts.all():
            at = np.flatnonzero(starts)
            ends = np.append(at[1:], len(index))
            merged = np.flatnonzero(ends - at > 1)
            place: dict[str, int] = {}
            joined = [
                place.setdefault(" ".join([values[i] for i in index[a:b].tolist()]), len(values) + len(place))
                for a, b in zip(at[merged].tolist(), ends[merged].tolist())
            ]
            index = index[at]
            index[merged] = joined
            values += place
            offsets = np.concatenate([[0], np.cumsum(starts)])[offsets]
        self.values, self.index, self.offsets = values, index.astype(np.int64), offsets


def gathered(offsets: np.ndarray, items: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, items) of the lists ``index`` points at, in a row."""
    sizes = (offsets[1:] - offsets[:-1])[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1][index] - out[:-1], sizes)
    return out, items[at]


@lru_cache(maxsize=4)
def byte_bpe_encoder(path: str, plain: bool, remembered: int | None = None) -> PieceEncoder:
    """The worker's own encoder: what it remembers serves all its tasks."""
    words = byte_bpe_words(path, plain)
    return PieceEncoder(words[1], words[0], remembered) if words else PieceEncoder(byte_bpe(path, plain), None, remembered)


@lru_cache(maxsize=4)
def piece_bpe_encoder(path: str, remembered: int | None = None) -> PieceEncoder:
    return PieceEncoder(piece_bpe(path), None, remembered)


def encoded_texts(texts: pa.Array, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of whole texts; null and empty texts have none."""
    cut = Pieces(texts)
    filled = cut.offsets[1:] > cut.offsets[:-1]
    heads = cut.offsets[:-1][filled]
    first = [cut.values[i] for i in cut.index[heads].tolist()]
    offsets, ids = encoder.ids([" " + v for v in cut.values] + first)
    index = cut.index.copy()
    index[heads] = len(cut.values) + np.arange(len(first))
    out, ids = gathered(offsets, ids, index)
    return out[cut.offsets], ids


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of text; no row is split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, more in enumerate(sizes.tolist()):
        if i > at and size + more > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += more
    if at < batch.num_rows:
        yield batch.slice(at)
