"""Token files, alignment of tokenizers and periodic runs, each against a plain version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streakline.llm import alignment, rans, runs, vocabulary
from streakline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "B", "é", "7", "!", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "\xa0", "<|endoftext|>", "'s", "▁", "中", "﻿", "​", "\x0b", "😀", "<s>"]
ODD = [None, "", " ", "a", "a", "x  y \n z", "ends with a space ", "▁marked", "<|endoftext|> and </s>", "\x00", "word " * 30_000, "ü" * 40_000, "no-space" * 5_000]


def docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    extra = {c: F.lit(1) for c in ("key", "start", "part", "bundle", "n_a", "runs", "row", "pair", "content")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)


def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(A_PATH)


# --- ids by pieces ---


@pytest.mark.parametrize("plain", [False, True])
def test_pieces_give_the_ids_of_whole_texts(tokenizer, plain):
    rng = random.Random(3)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 12))) for _ in range(5_000)] + ODD
    offsets, ids = vocabulary.encoded_texts(pa.array(texts, pa.string()), vocabulary.byte_bpe_encoder(A_PATH, plain))
    whole = vocabulary.byte_bpe(A_PATH, plain)([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == whole


def test_remembered_words_stay_right_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(vocabulary, "REMEMBERED", 50)
    words = vocabulary.byte_bpe_words(A_PATH, False)
    encoder, whole = vocabulary.PieceEncoder(words[1], words[0]), vocabulary.byte_bpe(A_PATH, False)
    rng = random.Random(4)
    for _ in range(30):
        pieces = [f" {rng.choice(['the', 'of', 'x'])}{rng.randint(0, 99)}." for _ in range(40)]
        offsets, ids = encoder.ids(pieces)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == whole(pieces)


# --- token files ---


@pytest.mark.parametrize("n", [0, 1, 255, 256, 5_000, 70_000])
def test_files_round_trip(n, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 30_000)
    monkeypatch.setattr(rans, "STRETCH_TOKENS", 4_096)
    tokens = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_256).astype(np.uint32)
    content = rans.write_file(pa.array(["a", None]), np.array([n // 3, n - n // 3]), tokens)
    file = rans.TokenFile(content)
    assert np.array_equal(file.tokens(), tokens) and file.keys.to_pylist() == ["a", None] and file.counts.tolist() == [n // 3, n - n // 3]
    for start, stop in ((0, n), (n // 3, n // 2), (n - 1, n), (29_999, 30_001), (5, 5)):
        assert np.array_equal(file.between(max(0, start), stop), tokens[max(0, start) : stop])
    same = np.zeros(n, np.uint32)
    assert np.array_equal(rans.TokenFile(rans.write_file(pa.array([1]), np.array([n]), same)).tokens(), same)


def test_coded_size_is_near_the_entropy():
    tokens = np.minimum(np.random.default_rng(1).zipf(1.3, 1_000_000), 50_256).astype(np.uint32)
    share = np.bincount(tokens)[np.unique(tokens)] / len(tokens)
    least = -(share * np.log2(share)).sum() / 8 * len(tokens)
    assert len(rans.write_file(pa.array([1]), np.array([len(tokens)]), tokens)) < 1.15 * least  # states at the checkpoints are 8 %


def test_damaged_files_are_found():
    tokens = np.arange(20_000, dtype=np.uint32) % 997
    content = rans.write_file(pa.array([1]), np.array([20_000]), tokens)
    rng = random.Random(2)
    for at in [0, 9, 40, len(content) - 1, *rng.sample(range(len(content)), 60)]:
        broken = bytearray(content)
        broken[at] ^= 0x10
        with pytest.raises(rans.BadFile):
            rans.TokenFile(bytes(broken)).tokens()
    for size in (0, 7, 50, len(content) - 1):
        with pytest.raises(rans.BadFile):
            rans.TokenFile(content[:size]).tokens()


def plain_positions(rows, tokenizer):
    at, found = 0, []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        found.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return found


def test_positions_equal_plain_encoding(spark, tokenizer):
    got = sorted(map(tuple, QUERIES["op11_rans_tokens"](spark, SF_DIR).collect()))
    assert got == plain_positions(sample(spark), tokenizer)


def test_positions_of_odd_rows(spark, tokenizer, monkeypatch):
    table = docs(spark, ODD)
    got = sorted(map(tuple, rans.token_positions(table, A_PATH).collect()))
    assert got == plain_positions(list(enumerate(ODD)), tokenizer)
    assert rans.token_positions(docs(spark, []), A_PATH).count() == 0
    same = spark.createDataFrame([(None, "b"), (7, "x y"), (7, "x y"), (None, None)], "doc_id long, text string")
    rows = rans.token_positions(same, A_PATH).collect()
    assert len(rows) == 4 and min(r.start for r in rows if r.doc_id is None) == 0 and max(r.start for r in rows if r.doc_id is None) < 3
    assert sorted(r.start for r in rows)[0] == 0 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


# --- alignment ---


def plain_alignment(rows):
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_bytes, b_bytes = vocabulary.byte_bpe_tokens(A_PATH), vocabulary.piece_bpe_tokens(B_PATH)

    def spans(ids, table):
        at = 0
        for i in ids:
            yield i, at, at + len(table[i])
            at += len(table[i])

    links, made = {}, {}
    for key, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(a_bytes[i] for i in x) != f" {text}".encode() or b"".join(b_bytes[i] for i in y) != f" {text}".encode():
            x, y = [], []
        left, right = list(spans(x, a_bytes)), list(spans(y, b_bytes))
        links[key], j = [], 0
        for i, s, e in left:
            while j < len(right) and right[j][2] <= s:
                j += 1
            k = j
            while k < len(right) and right[k][1] < e:
                links[key].append((i, right[k][0]))
                k += 1
        ends = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, p, q = [], 0, 0
        for end in ends:
            ga, gb = [], []
            while p < len(left) and left[p][2] <= end:
                ga.append(left[p][0])
                p += 1
            while q < len(right) and right[q][2] <= end:
                gb.append(right[q][0])
                q += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        made[key] = (len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
    count = Counter(link for found in links.values() for link in found)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return sorted(
        (key, *made[key][:3], len(found), sum(count[x] == best[x[1]] for x in found), sum(count[x] for x in found), made[key][3])
        for key, found in links.items()
    )


def test_alignment_equals_the_plain_one(spark):
    got = sorted(map(tuple, QUERIES["op12_token_alignment"](spark, SF_DIR).collect()))
    assert got == plain_alignment(sample(spark)) and sum(r[1] for r in got) > 10_000


def test_alignment_of_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choices(SIGNS, k=rng.randint(0, 12))) for _ in range(300)]
    got = sorted(map(tuple, alignment.aligned_tokens(docs(spark, texts), A_PATH, B_PATH).collect()))
    assert got == plain_alignment(list(enumerate(texts)))
    assert got[7][1:] == (0, 0, 0, 0, 0, 0, "")  # its mark reads as a space
    assert alignment.aligned_tokens(docs(spark, []), A_PATH, B_PATH).count() == 0
    nothing = alignment.aligned_tokens(docs(spark, [None, ""]), A_PATH, B_PATH).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2
    twice = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "two")], "doc_id long, text string")
    assert alignment.aligned_tokens(twice, A_PATH, B_PATH).count() == 3


# --- runs ---


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part, length = words[start : i + q], i + q - start
            if length >= max(12, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        n = rng.randint(0, 90)
        words = [b"%d" % rng.randint(0, rng.choice([1, 2, 3, 5, 30])) for _ in range(n)]
        if n > 20:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            b = rng.randrange(n)
            words[b:b] = words[max(0, b - 9) : b] * rng.randint(0, 3)
        assert runs.word_runs(words) == plain_runs(words)


def test_all_runs_of_a_tree_need_no_hint():
    rng = random.Random(8)
    for _ in range(300):
        signs = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 40))]
        got = [(s, e - s, q) for s, e, q in runs.tree_runs(signs).tolist() if e - s >= 12]
        assert sorted(got, key=lambda r: (r[0], r[2])) == plain_runs(signs)


def plain_digest(key, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    longest = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return (key, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_run_digests_equal_the_plain_ones(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_word_runs"](spark, SF_DIR).collect()}
    rows = [(key, text) for key, text in sample(spark) if len((text or "").split()) < 600]
    assert len(rows) > 100 and all(got[key] == plain_digest(key, text) for key, text in rows)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \x1c ", "a " * 11, "a " * 12, "a b " * 50_000, "x y " * 12, "same " * 12 + "x", "same " * 12 + "x"]
    table = docs(spark, texts)
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.find_runs(table).collect()}
    assert [got[i] for i in range(4)] == [[]] * 4 and got[4] == [(0, 12, 1)] and got[5] == [(0, 100_000, 2)]
    assert got[6] == [(0, 12, 1)] and got[7] == got[8] == [(0, 12, 1)]
    collapsed = {r.doc_id: r.text for r in runs.collapse_runs(table).collect()}
    assert collapsed[0] == "" and collapsed[3] == ("a " * 11).strip() and collapsed[5] == "a b" and collapsed[7] == "same x"
    digests = {r.doc_id: tuple(r) for r in runs.run_digests(table).collect()}
    assert all(digests[i] == plain_digest(i, texts[i]) for i in range(len(texts)) if i != 5)
    assert runs.run_digests(docs(spark, [])).count() == 0
    assert runs.run_digests(spark.createDataFrame([(None, "a " * 40)], "doc_id long, text string")).first().start == 0
