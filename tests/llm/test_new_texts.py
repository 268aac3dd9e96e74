"""SentencePiece rounds, source divergence and fill-in-the-middle against the library and plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from millrace.llm import divergence, fill_middle, pieces
from millrace.llm.tokens import public_path
from tests.llm.conftest import EXTRA

PIECE_MODEL = public_path("piece_bpe_32k.model")
PARTS = ["a", "e", "t", "h", "in", "er", " ", "  ", "\n", "▁", "1", "é", "日", "🙂", "\x00", "<s>", "<0x41>", "\t", "the", "ing", ".", "\r\n", "中", "ß", "�", "ation", "▁▁▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture
def model():
    return pieces.Model(PIECE_MODEL)


# ---- sentencepiece


def _same(model, library, texts):
    for text, got in zip(texts, model.encode(texts), strict=True):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert model.decode(got) == library.decode(want)


def test_ids_are_the_librarys(model, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(200))) for _ in range(200)]
    _same(model, library, texts)


def test_ties_spaces_and_long_words(model, library):
    _same(model, library, ["", None, " ", "  ", " a", "▁", "a ", "\n", "<s>", "</s> x", " " * 100, " " * 3000, "a" * 700, "ab" * 2000, "thethe" * 300, "x" + " " * 600 + "y"])


def test_heap_and_rounds_agree(model, library, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(400)]
    monkeypatch.setattr(pieces, "LONG_WORD", 2)
    _same(model, library, texts)


def test_long_texts_and_forgotten_words(model, library, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(pieces, "RUN_CHARS", 300)
    monkeypatch.setattr(pieces, "RUN_WORDS", 50)
    monkeypatch.setattr(pieces, "TABLE_BYTES", 20_000)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 5, 40, 900]))) for _ in range(60)]
    _same(model, library, texts)
    _same(model, library, texts[::-1])


def test_decoding_any_ids(model, library):
    rng = random.Random(4)
    for _ in range(1000):
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32_000) for _ in range(rng.randrange(20))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)
    with pytest.raises(IndexError):
        model.decode(np.array([32_000], "<u4").tobytes())


def test_pieces_of_documents(docs, corpus, nothing, library):
    ids = pieces.encode(docs, PIECE_MODEL, keep=("doc_id", *EXTRA))
    assert ids.columns == ["ids", "n_tokens", "doc_id", *EXTRA]
    back = pieces.decode(ids, PIECE_MODEL, keep=("doc_id", "ids", "n_tokens", "score"))
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.text, r.score) for r in back.collect())
    want = Counter()
    for d, t in corpus:
        i = library.encode(t or "", add_bos=True, add_eos=True)
        want[d, len(i), np.array(i, "<u4").tobytes(), library.decode(i), "x"] += 1
    assert got == want
    assert pieces.decode(pieces.encode(nothing, PIECE_MODEL), PIECE_MODEL).count() == 0
    assert {bytes(r.ids) for r in pieces.encode(docs.where("text is null"), PIECE_MODEL, bos=False, eos=False).collect()} == {b""}
    with pytest.raises(ValueError):
        pieces.encode(docs.selectExpr("doc_id", "text", "1 as IDS"), PIECE_MODEL, keep=("IDS",))


# ---- divergence


def _plain_audit(rows, least, top):
    """All terms of all groups, one by one, in Python's integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)] for _, _, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        df = Counter(w for r, ws in zip(rows, words) if r[0] == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = {s: Counter(w for r, ws in zip(rows, words) if r[:2] == (lang, s) for w in ws if df[w] >= least) for s in {r[1] for r in rows if r[0] == lang}}
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            return {w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pair = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            term = sorted(((-f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]), key=lambda x: (x[0], x[1].encode()))[:top]
            out |= {(lang, s, part, item, -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block,held", [(1 << 15, 200_000), (7, 30)])
def test_audit_is_the_plain_one(spark, monkeypatch, block, held):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(5)
    vocabulary = ["Ärger", "cödé", "日本", "it", "IT", "x", "e", "É"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for _ in range(160):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", "ü", None])
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 30])) + rng.choices([f"only{source}"], k=rng.randrange(4))
        rows.append((lang, source, rng.choice([" ", "1", "-", "\n"]).join(words) or None))
    rows += [("fr", "a", "rare words only"), ("fr", "b", None), ("fr", "c", "123"), ("it", "a", "x"), rows[0], rows[0]]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4).selectExpr("*", "1 as n", "'z' as term", "2 as block")
    got = [tuple(r) for r in divergence.audit(frame, min_documents=5, top=3).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_audit(rows, 5, 3)


def test_audit_of_nothing(spark, nothing):
    rows = nothing.selectExpr("'a' as lang", "'b' as source", "text")
    assert divergence.audit(rows).count() == 0
    one = spark.createDataFrame([("a", "b", "x")], "lang string, source string, text string")
    assert divergence.audit(one).count() == 0 and divergence.audit(one, min_documents=1).count() == 0


def test_intersection_gallops():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, rng.choice([5, 100, 10_000]), rng.choice([0, 1, 5, 300]))) for _ in range(2))
        i, j = divergence.intersection(a, b)
        want = np.intersect1d(a, b, return_indices=True)
        assert i.tolist() == want[1].tolist() and j.tolist() == want[2].tolist()


def test_prices_are_exact(spark):
    rng = random.Random(7)
    for _ in range(300):
        v = rng.choice([1, 10, 10**6])
        total = rng.choice([0, 5, 10**9, 4 * 10**15])
        c = rng.randrange(total + 1)
        want = 1 + 10**9 * (c + 2) // (total + 2 * v)
        assert divergence.prices(np.array([c]), total, v).tolist() == [want]
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence.price(F.lit(3 * 10**15), F.lit(4 * 10**15), F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + 10**9 * (3 * 10**15 + 2) // (4 * 10**15 + 2 * 10**6)


# ---- fill in the middle


def _plain_fill(text, doc_id):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    spm = h4 % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_rotations_and_back():
    rng = random.Random(8)
    forms = Counter()
    for k in range(3000):
        text = "".join(rng.choice(["ab", "C", " ", "é", "日", "🙂", "\n", "1", "<", "P>", "M>", "<P>" if rng.random() < 0.05 else "x"]) for _ in range(rng.randrange(40)))
        n, form, before, inside, out = fill_middle.transform(text.encode(), k)
        assert (n, form, before, inside, out.decode()) == _plain_fill(text, k)
        assert fill_middle.restore(bytes(out), form).decode() == text
        forms[form] += 1
    assert len(forms) == 3
    for output, form in ((b"<P>a<S>b", "psm"), (b"a<P><S><M>", "psm"), (b"<P><S><M>", "spm"), (b"x", "other")):
        with pytest.raises(ValueError):
            fill_middle.restore(output, form)


def test_fill_of_documents(docs, corpus, nothing):
    outputs = fill_middle.transformed(docs, keep=("score", "part"))
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "score")
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text, r.score) for r in fill_middle.restored(outputs, keep=names).collect())
    assert got == Counter((d, *_plain_fill(t or "", d), t or "", "x") for d, t in corpus)
    assert fill_middle.restored(fill_middle.transformed(nothing)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.transformed(docs.selectExpr("doc_id", "text", "1 as Form"), keep=("Form",))
