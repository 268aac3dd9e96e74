import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, tokenbin, tokens

BYTE, WORD = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")


def by_library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_library_s(path):
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x250)] + list(" \n\t'sdremlv 12aZé") * 20 + ["日", "🙂", "İ", "ſ", " ", "́"]
    texts = [a + chr(c) + b for c in range(0x250) for a, b in (("", ""), ("a", "b"), (" ", " "), ("'", "s"))]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["<|endoftext|> x", ""]
    own, want = tokens.Encoder(path), by_library(path)
    assert own.split is not None
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == want(t), t


@pytest.mark.parametrize("path, end", [(BYTE, 0), (WORD, 2)])
def test_added_tokens_are_the_library_s(spark, tmp_path, path, end):
    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = ["x <|endoftext|> y", "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "a<|endoftext|", "é <|startoftext|>日", "plain"]
    texts += [f"{a}{t}{b}" for t in added for a, b in (("", ""), ("\u212a ", "\n"), ("İ", "'s"))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert any(i in library.get_added_tokens_decoder() for i in want[0])
    assert [np.frombuffer(tokens.encoder(path).ids(t), "<u4").tolist() for t in texts] == want
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(bytes)
    for r in sorted(packing.pack(frame, path, end).collect(), key=lambda r: r.start):
        got[r.doc_id] += r.ids
    assert [np.frombuffer(got[k], "<u4").tolist() for k in range(len(texts))] == [w + [end] for w in want]
    tokenbin.write_ids(frame, str(tmp_path / "ids"), path)
    rows = sorted(tokenbin.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.doc_id)
    assert [np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0, *(len(w) + 1 for w in want[:-1])]).tolist()


def test_packing(docs, corpus):
    rows = packing.pack(docs, BYTE).collect()
    want, got = by_library(BYTE), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        assert len(r.ids) == 4 * r.length
    whole = defaultdict(list)
    for doc_id, text in corpus:
        whole[doc_id].append(want(text) + [0])
    for doc_id, documents in whole.items():
        pieces = sorted(got[doc_id], key=lambda r: (r.doc_tokens, r.start))
        if len(documents) == 1:
            ids = [i for r in pieces for i in struct.unpack(f"<{r.length}I", r.ids)]
            assert ids == documents[0] and [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist()
        assert sum(r.length for r in pieces) == sum(map(len, documents))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    part = len({r.sequence_id >> 40 for r in rows})
    short = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist()
        short += sum(r.length for r in s) != s[0].tier
    assert short <= part
    assert len({(r.step_group, r.tier) for r in rows}) == len({r.step_group for r in rows})


@pytest.mark.parametrize("tiers", [(1024, 512, 256, 128), (1024, 128), (64,)])
@pytest.mark.parametrize("lengths", [(100,), (1, 2, 3), (600,), (600, 50, 700), (1024, 600, 300), (127, 128, 129, 513, 5000)])
def test_rounds_carry_less_than_a_sequence(tiers, lengths):
    pool, n, got = [], 0, defaultdict(list)
    for turn in range(4):
        for length in lengths * 300:
            pool.append(packing._Piece(n, 0, struct.pack(f"<{length}I", *range(length)), length))
            n += 1
        sequences, pool = packing.pack_pieces(pool, tiers, turn == 3)
        short = [t for t, window in sequences if sum(map(len, window)) < t]
        assert len(short) <= (turn == 3) and sum(map(len, pool)) < tiers[0] * (turn < 3) + 1
        for _, window in sequences:
            for p in window:
                got[p.doc_id].append((p.start, p.ids))
    for k in range(n):
        length = lengths[k % len(lengths)]
        assert b"".join(ids for _, ids in sorted(got[k])) == struct.pack(f"<{length}I", *range(length))


def test_short_pieces_fill_the_lowest_tier():
    pieces = [packing._Piece(k, 0, bytes(4 * 100), 100) for k in range(1000)]
    sequences, left = packing.pack_pieces(pieces, (1024, 512, 256, 128), False)
    assert {t for t, _ in sequences} == {128} and len(sequences) == 100_000 // 128 and sum(map(len, left)) == 100_000 % 128


def test_packing_of_nothing(nothing, docs):
    assert packing.pack(nothing, BYTE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BYTE, tiers=(1000, 10))


def test_elias_fano():
    rng = random.Random(3)
    for n, most in ((0, 1), (1, 0), (1, 5), (300, 3), (1000, 10**9), (700, 700)):
        values = sorted(rng.randrange(most + 1) for _ in range(n))
        e = tokenbin.EliasFano.of(np.array(values, np.uint64))
        back, end = tokenbin.EliasFano.read(memoryview(e.tobytes()), 0)
        assert end == len(e.tobytes()) and back.all().tolist() == values
        assert [back.select(i) for i in range(n)] == values
    big = tokenbin.EliasFano.of(np.arange(0, 10**6, 100, dtype=np.uint64))
    assert len(big.tobytes()) < 10_000 * 1.6


def test_id_files(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "ids")
    tokenbin.write_ids(docs, path, WORD)
    got = sorted(tokenbin.read_ids(spark, path).collect(), key=lambda r: r.start)
    want = by_library(WORD)
    rows = sorted(((d, want(t) + [2]) for d, t in corpus), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert sorted((r.doc_id or -1, zlib.crc32(r.ids)) for r in got) == sorted((d or -1, zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in rows)
    blob = spark.read.parquet(path).where("n_docs > 2").first().blob
    shard = tokenbin.Shard(blob)
    _, start, ids = shard.document(1)
    assert start == len(shard.document(0)[2]) and len(ids) == shard.ends.select(1) - start


def test_id_files_of_nothing(spark, nothing, tmp_path):
    tokenbin.write_ids(nothing, str(tmp_path / "ids"), WORD)
    assert tokenbin.read_ids(spark, str(tmp_path / "ids")).count() == 0
