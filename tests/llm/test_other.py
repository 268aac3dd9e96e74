import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import decontaminate, html, license_scan, media, sharding, toxicity


# ---- media


def test_media_round_trip(docs, corpus):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.digests(media.to_media(docs)).collect())
    want = Counter()
    for d, t in corpus:
        n, p = media.payload_of(t)
        want[(d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert got == want


def test_packets(docs):
    files = media.to_media(docs.where("doc_id = 406"))
    packets = media.packets(files).orderBy("packet").collect()
    data = files.first().media
    assert b"".join(data[p.first_byte : p.first_byte + p.n_bytes] for p in packets) == media.features(data)[0]
    assert packets[-1].cluster > 1 and [p.timestamp for p in packets] == sorted(p.timestamp for p in packets)
    assert media.seek(data, packets[-1].timestamp) == max(at for _, _, at in media.parse(data)[1])


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing(lacing):
    frames = {0: [b"q" * 33], 2: [b"a" * 50, b"b" * 50]}.get(lacing, [bytes([65 + i]) * n for i, n in enumerate((300, 10, 700, 255, 80))])
    block = b"\x81\0\5" + bytes([0x80 | lacing << 1])
    if lacing:
        block += bytes([len(frames) - 1])
    if lacing == media.XIPH:
        for f in frames[:-1]:
            block += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    if lacing == media.EBML_LACING:
        block += media.vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            block += (len(b) - len(a) + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big")
    block += b"".join(frames)
    content = media.element(media.TIMESTAMP, b"\x64") + media.element(media.SIMPLE_BLOCK, block) + media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block))
    unknown = b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + content
    data = media.element(media.SEGMENT, unknown + unknown)
    packets, _ = media.parse(data)
    assert [data[p.first_byte : p.first_byte + p.n_bytes] for p in packets] == frames * 4
    assert {p.timestamp for p in packets} == {105_000_000} and packets[-1].cluster == 1
    info = media.element(media.INFO, media.element(media.SCALE, b"\x03\xe8")) + media.element(media.TRACKS, media.element(media.ENTRY, media.element(media.NUMBER, b"\1") + media.element(media.FRAME_TIME, b"\7")))
    packets, _ = media.parse(media.element(media.SEGMENT, info + unknown))
    assert [p.timestamp for p in packets] == [105_000 + 7 * i for i in range(len(frames))] * 2


def test_broken_media(spark):
    whole = media.write_pcm(bytes(range(192)) * 30)
    with pytest.raises(ValueError):
        media.parse(whole[:-5])
    rng = random.Random(9)
    broken = [whole[:k] for k in range(0, 400, 7)] + [b"", b"\0", b"junk" * 50, b"\x1a", bytes(rng.randrange(256) for _ in range(500))]
    for _ in range(300):
        data = bytearray(whole)
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        broken.append(bytes(data))
    rows = [(i, 5760, bytearray(b)) for i, b in enumerate(broken)] + [(None, None, None), (7777, 5760, bytearray(whole)), (7777, 5760, bytearray(whole))]
    frame = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").withColumn("problem", F.lit(1))
    read = media.digests(frame).collect()
    assert len(read) == len(rows) and [r.payload_bytes for r in read if r.doc_id == 7777] == [5760] * 2
    assert all((r.problem is None) == (r.payload_sha256 is not None) == (r.feature is not None) for r in read)
    found = media.packets(frame).collect()
    assert {r.doc_id for r in found if r.problem} == {r.doc_id for r in read if r.problem and r.doc_id is not None}
    assert sum(r.doc_id == 7777 for r in found) == 60 and all(r.packet is None for r in found if r.problem)


# ---- decontamination


def brute_hits(text, items, window):
    w, gone, found = decontaminate.words_of(text), set(), set()
    for item_id, t in items:
        x = decontaminate.words_of(t)
        m = min(window, len(x))
        for k in range(len(x) - m + 1) if x else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == x[k : k + m]:
                    gone |= set(range(i, i + m))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(w), len(gone), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(gone)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, corpus, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    text = dict((d, t) for d, t in corpus if d is not None)
    items = [(1, text[0][:120].upper()), (2, text[1][30:200]), (10, "one two"), (11, "don't"), (12, None), (13, "--"), (None, text[2][:90]), (2, text[9][:80]), (14, "w1 w1 w1")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.hits(decontaminate.mark(docs, tests, 10)).collect())
    assert got == Counter((d, *brute_hits(t, items, 10)) for d, t in corpus)


def test_wu_manber_overlaps(monkeypatch):
    rng = random.Random(8)
    for turn in range(200):
        monkeypatch.setattr(decontaminate, "SEGMENT", 1 + turn % 7)
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(40))] for _ in range(3)]
        m = rng.randrange(1, 6)
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(m + rng.randrange(3))]) for i in range(4)]
        search = decontaminate.WuManber(m, items)
        [(_, h, offsets)] = list(decontaminate.word_batches([b" ".join(t).decode() for t in texts]))
        got = {(i, k): search.owners_of({w}) for i, k, w in search.search(h, offsets, lambda i: texts[i])}
        want = {}
        for i, words in enumerate(texts):
            for k in range(len(words) - m + 1):
                if mine := {o for o, x in items if any(x[j : j + m] == words[k : k + m] for j in range(len(x) - m + 1))}:
                    want[i, k] = mine
        assert got == want


def test_items_with_one_passage_are_compared_once():
    rng = random.Random(9)
    prompt = " ".join(f"p{k}" for k in range(12))
    took = []
    for n in (500, 4000):
        [search] = decontaminate.searchers([(str(i), f"{prompt} q{i}") for i in range(n)], 10)
        assert len(search.bucket) == n + 3  # the prompt's three windows, and one for each item
        texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(50)) + " " + prompt for _ in range(50)]
        [(_, h, offsets)] = list(decontaminate.word_batches(texts))
        began = time.perf_counter()
        found = list(search.search(h, offsets, lambda i, texts=texts: decontaminate.words_of(texts[i])))
        took.append(time.perf_counter() - began)
        assert len(found) == 150 and {k for _, k, _ in found} == {50, 51, 52}
        assert search.owners_of({w for _, _, w in found}) == {str(i) for i in range(n)}
    assert took[1] < 4 * took[0] + 0.1


def test_search_tables_stay_small():
    rng = random.Random(4)
    items = [(str(i), " ".join(f"w{rng.randrange(30_000)}" for _ in range(200))) for i in range(500)]
    [search] = decontaminate.searchers(items, 10)
    arrays = (search.byte, search.keys, search.shift, search.bucket, search.starts, search.runs, search.owner)
    assert sum(a.nbytes for a in arrays) + len(search.buffer) < 60 * 100_000


def test_clean(spark, docs, nothing):
    tests = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = decontaminate.clean(docs, tests)
    assert kept.columns == docs.columns and {403, 404} & {r.doc_id for r in kept.collect()} == set() and kept.count() == docs.count() - 2
    assert kept.where("spans = 'x' and n_words = 'x'").count() == kept.count()
    assert decontaminate.clean(docs, tests.where("false")).count() == docs.count() and decontaminate.mark(nothing, tests).count() == 0
    with pytest.raises(ValueError):
        decontaminate.mark(docs, tests, keep=("Spans",))


# ---- html


def test_structure():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><a>Home</a></nav><div class="cookie-notice">ok?</div>
    <article><h1>A &amp; B</h1><p>One <b>bo</b>ld<br>two<p>three &#8212; 1 < 2<div class="ad">buy</div><form>f</form></article><section id="comments"><p>me</p></section><aside>x</aside><footer>f</footer></body></html>"""
    assert " ".join(x.text for x in html.lines(page) if x.article) == "A & B One bold two three — 1 < 2"
    assert html.lines(None) == [] and html.lines("") == [] and html.lines("<p") != None  # noqa: E711


def test_longest_common_subsequence():
    rng = random.Random(1)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row[0] = 0, 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        c = html.common(a, b)
        assert c == sorted(set(c)) and len(c) == length(a, b)
        it = iter(b)
        assert all(x in it for x in (a[i] for i in c))


def test_common_lines_that_repeat():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randrange(1, 4) if rng.random() < 0.4 else 0 for _ in range(rng.randrange(150, 260))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            last, row[0] = 0, 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        c, it = html.common(a, b), iter(b)
        assert len(c) == row[-1] and c == sorted(set(c)) and all(x in it for x in (a[i] for i in c))
    start = time.process_time()
    assert len(html.common([1] + [0] * 20_000, [2] + [0] * 15_000 + [3])) == 15_000
    assert time.process_time() - start < 1


def test_names_that_leave_it_open(spark):
    """Blocks of an article named by a furniture word among others stay, unless a neighbour shares their lines."""
    page = lambda k, own: f"""<html><body><nav>Menu</nav><article><h1>Title {k}</h1><p>First words of {k} <span class="share-price">at {k}</span>.</p>{own}
<div class="share-tools">Send this page to a friend</div><div class="cookie-banner-wrap">We use cookies {k}</div><div class="comments">Reader {k} says</div><p>Last words of {k} and many more that no other page has, {k * 'x'}</p></article></body></html>"""  # noqa: E731
    own = ['<section class="related-work"><p>Earlier papers</p></section>', '<p id="search-results">We found</p>', '<div class="share-price">Shares rose</div>', '<div class="adSlot">Buy</div>']
    pages = [(k, f"http://h.org/a/{k}", page(k, own[k - 1])) for k in range(1, 5)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, middle in enumerate((" Earlier papers", " We found", " Shares rose", ""), 1):
        assert got[k] == f"Title {k} First words of {k} at {k}.{middle} Last words of {k} and many more that no other page has, {k * 'x'}"


@pytest.mark.parametrize("part", ["<a ", "<a \"", "<a '>", "<", "<![CDATA[", "<!x", "</script ", "<!--", "<div>", "<li></li>", "<td>x", "</b>", "<a b=\"c\"", "&", "&#", "<div x='>' \">"])
def test_pages_are_read_in_linear_time(part):
    times = []
    for size in (1 << 17, 1 << 20):
        start = time.process_time()
        html.lines("<div>" * 1000 + part * (size // len(part)))
        times.append(time.process_time() - start)
    assert times[1] < 40 * times[0] + 0.2 and times[1] < 6


def test_unclosed_markup_loses_no_text():
    for page in ("a <b c", "x < y > z", "<p>one <a href='x>two</a> three", "<p>one<![CDATA[ two & ]]> three", "1 <2> 3"):
        text = " ".join(x.text for x in html.lines(page))
        assert text.startswith(page.split("<")[0].strip() or "one")
    assert [x.text for x in html.lines("<p>one <a href='x>two</a> three")] == ["one two three"]
    assert [x.text for x in html.lines("<article><math>x</math><fieldset>y</fieldset><object>z</object></article>")]


def plain_article(page):
    """The article of a page of the given tables, by another way: a parser of the standard library."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.depth, self.skip = [""], 0, []

        def handle_starttag(self, tag, attrs):
            names = set(re.split(r"[^a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id"))))
            if self.skip or self.depth and (tag in ("form", "aside", "nav", "script", "style") or names & {"ad", "comments", "comment", "share", "related"}):
                self.skip += [tag] if tag not in ("br", "img", "p", "li") else []
            elif tag == "article":
                self.depth += 1
            if tag not in ("b", "i", "a", "em", "strong", "span"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            if self.skip:
                if tag in self.skip:
                    del self.skip[self.skip.index(tag) :]
            elif tag == "article":
                self.depth -= 1
            if tag not in ("b", "i", "a", "em", "strong", "span"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    return " ".join(" ".join(b.split()) for b in reader.blocks if b.split())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_main_text_against_a_plain_parser(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert got == want and all(want.values())


def test_differencing(spark):
    page = lambda i: f"<body><div>Site menu</div><div>Welcome all</div><div>story {i} is long enough to count as text {'z' * i}</div><div>All rights reserved</div></body>"
    rows = [(i, f"https://a.example/news/{i}.html", page(i)) for i in range(9)] + [(20, "https://b.example/", page(3)), (21, None, None), (22, "::bad[", ""), (23, "https://c.example/x", page(5)), (24, "https://c.example/y", page(5))]
    rows += [(0, "https://a.example/news/0.html", page(0))] * 3 + [(30 + i, f"https://d.example/s/{i}", page(7)) for i in range(6)] + [(40, "https://d.example/s/far", page(8)), (None, "https://e.example/", "y" * 300_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for name in ("key", "hashes", "bare", "host", "text", "part"):
        frame = frame.withColumn(name, F.lit("x"))
    found = html.main_text(frame).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and sum(r.page_id == 0 for r in found) == 4
    for i in range(9):
        assert got[i] == f"story {i} is long enough to count as text {'z' * i}".strip()
    assert got[20].startswith("Site menu") and got[21] == got[22] == "" and len(got[None]) == 300_000
    assert got[23] == got[24] != ""  # copies tell nothing about furniture
    assert all(got[30 + i] == f"story 7 is long enough to count as text {'z' * 7}" for i in range(6))  # beyond copies, the next page does
    assert html.main_text(frame.where("false")).count() == 0


# ---- sharding


def plain_shard(doc_id, shards, seed):
    """The shard with the highest hash, as Spark hashes: column by column, nulls skipped."""

    def h(*values):
        state = 42
        for pack, v in zip(("<q", "<i", "<i"), values):
            state = state if v is None else xxhash.xxh64_intdigest(struct.pack(pack, v), state)
        return state - (1 << 64) if state >> 63 else state

    return max((h(doc_id, s, seed), s) for s in range(shards))[1]


def test_shuffle(docs, corpus, nothing):
    got = sharding.external_shuffle(docs, 5, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text, r.size) for r in got) == Counter((d, t, len((t or "").encode()) + 8) for d, t in corpus)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all((r.shard, r.grown_shard) == (plain_shard(r.doc_id, 5, sharding.SEED), plain_shard(r.doc_id, 6, sharding.SEED)) for r in got)
    assert all(r.grown_shard in (r.shard, 5) for r in got) and any(r.grown_shard == 5 for r in got)
    assert sharding.external_shuffle(nothing).count() == 0


def test_slots_depend_on_records_and_seed_only(spark, docs, monkeypatch):
    frame = spark.range(3000).selectExpr("id as doc_id", "concat('t', id % 7) as text")
    place = lambda f, **k: {(r.doc_id, r.text, r.shard, r.slot) for r in sharding.external_shuffle(f, 4, bucket_bytes=3000, **k).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        first = place(frame)
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert place(frame.repartition(n)) == first
        monkeypatch.setattr(sharding, "PARTITIONS", 3)
        spark.conf.set("spark.sql.shuffle.partitions", 5)
        few = place(frame)
        assert few == place(frame.repartition(2)) and len(few) == 3000
        assert place(frame, seed=1) != first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 50)
    frame = spark.range(2000).selectExpr("5L as doc_id", "'the same' as text").unionByName(spark.range(100).selectExpr("id as doc_id", "'u' as text")).unionByName(spark.range(100).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text"))
    rows = sharding.external_shuffle(frame.repartition(3), 2, bucket_bytes=1000).collect()
    hot = sorted(r.slot for r in rows if r.text == "the same")
    shard = {r.shard for r in rows if r.text == "the same"}
    own = [r for r in rows if r.shard in shard]
    assert len(hot) == 2000 and len(shard) == 1 and sorted(r.slot for r in own) == list(range(len(own))) and len(rows) == 2200
    others = [r.slot for r in own if r.text != "the same"]
    assert max(others) - min(others) > len(own) / 2  # among the equal rows, not beside one bucket of them


def test_shuffle_mixes(spark):
    frame = spark.range(2000).selectExpr("id as doc_id", "'t' as text")
    rows = sharding.external_shuffle(frame, 4, bucket_bytes=3000).collect()
    sizes = Counter(r.shard for r in rows)
    assert min(sizes.values()) > 400 and {s for s, _ in {(r.grown_shard, 0) for r in rows}} == set(range(5))
    for s in range(4):
        own = [r for r in rows if r.shard == s]
        assert abs(np.corrcoef([r.doc_id for r in own], [r.slot for r in own])[0, 1]) < 0.15


def test_write_shards(spark, docs, corpus, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), shards=3)
    back = sharding.read_shards(spark, str(tmp_path / "s")).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in back) == Counter((d, t, plain_shard(d, 3, sharding.SEED)) for d, t in corpus)


# ---- licenses


def test_licenses(spark, nothing):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts = [None, "", "Released under the MIT License."]
    for name, t in license_scan.TEMPLATES:
        texts.append(f"{filler(rng.randrange(300))} {t.upper()}! {filler(rng.randrange(300))}")
        words = t.split()
        texts.append(f"{filler(50)} {' '.join(words[: len(words) // 3])} {filler(50)}")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(m.template, m.containment, m.first_word, m.end_word, m.places) for m in r.matches] for r in license_scan.scan(frame).collect()}
    index = license_scan.Index(license_scan.TEMPLATES)
    for i, (_, h) in enumerate(license_scan.shingles(texts)):
        want = [(o, *v) for o in range(len(index.names)) if (v := index.verified(h, o)) is not None]
        assert sorted(got[i]) == sorted(want)
    assert all(any(m[0] == k for m in got[3 + 2 * k]) for k in range(len(license_scan.TEMPLATES)))
    assert license_scan.licenses(license_scan.scan(frame)).where("licenses like '%MIT%'").count() >= 3
    assert license_scan.scan(nothing).count() == 0


def test_licenses_and_their_relatives(spark):
    gnu = "modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    free = "This program is free software: you can redistribute it and/or "
    conditions = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    source = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    binary = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    neither = "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    as_is = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    cases = [
        *((f"This work is licensed under the GNU {k}General Public License, version {v}.", n) for k, v, n in (("", 3, "GPL-3.0"), ("", 2, "GPL-2.0"), ("Lesser ", 3, "LGPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Affero ", 3, "AGPL-3.0"), ("Lesser ", 4, ""), ("Affero ", 1, ""), ("", 1, ""), ("Other ", 3, ""))),
        *((free + gnu.format(k, v), n) for k, v, n in (("General Public License", 3, "GPL-3.0"), ("General Public License", 2, "GPL-2.0"), ("Lesser General Public License", 3, "LGPL-3.0"), ("Lesser General Public License", "2.1", "LGPL-2.1"), ("Affero General Public License", 3, "AGPL-3.0"), ("General Public License", 1, ""))),
        (f"{conditions} {source} {binary} {as_is}", "BSD-2-Clause"),
        (f"{conditions} {source} {binary} 3. {neither} {as_is}", "BSD-3-Clause"),
        (f"{conditions} * {source[3:]} * {binary[3:]} * {neither} {as_is}", "BSD-3-Clause"),
        (f"{conditions} {source} {binary} {advert} 4. {neither} {as_is}", "BSD-4-Clause"),
        (conditions, "BSD"),
        (f"{isc}, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED", "ISC"),
        (f"{isc}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES", "0BSD"),
        *((f"This work is licensed under a Creative Commons Attribution{k} 4.0 International License.", n) for k, n in (("", "CC-BY-4.0"), ("-ShareAlike", "CC-BY-SA-4.0"), ("-NonCommercial", "CC-BY-NC-4.0"), ("-NonCommercial-ShareAlike", "CC-BY-NC-SA-4.0"), ("-NoDerivatives", "CC-BY-ND-4.0"))),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", ""),
        *((f"Licensed under CC {k}.", f"CC-{k.replace(' ', '-')}" if k.endswith("4.0") else "") for k in ("BY 4.0", "BY-NC 4.0", "BY-SA 4.0", "BY-NC-SA 4.0", "BY-NC 3.0", "BY-NC 4.1")),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
        *((f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v} which is available at", n) for v, n in (("2.0", "EPL-2.0"), ("v. 2.0", "EPL-2.0"), ("v1.0", "EPL-1.0"))),
        *((f"{verb} under the Apache License, Version 2.0", "Apache-2.0") for verb in ("Licensed", "Released", "Distributed")),
        *((f"{verb} under the MIT License", "MIT") for verb in ("Licensed", "Released", "Distributed")),
    ]
    cases += [(t, name) for name, t in license_scan.TEMPLATES]
    rng = random.Random(11)
    texts = [f"{' '.join(f'x{rng.randrange(999)}' for _ in range(20))} {t} {' '.join(f'y{rng.randrange(999)}' for _ in range(60))}" for t, _ in cases]
    got = license_scan.licenses(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert [(cases[r.doc_id][0], r.licenses) for r in sorted(got, key=lambda r: r.doc_id)] == cases


def test_identifier_lines(spark):
    rng = random.Random(12)
    filler = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows = [(i, f"{filler(rng.randrange(60))}\n// SPDX-License-Identifier: {name}\n{filler(rng.randrange(60))}") for i, name in enumerate(license_scan.SPDX)]
    rows += [(100, "SPDX-License-Identifier: MIT"), (101, "# spdx-license-identifier: GPL-2.0-or-later WITH x"), (102, "SPDX-License-Identifier: Other-1.0"), (103, "the license identifier MIT"), (104, "SPDX-License-Identifier: (MIT OR Apache-2.0)")]
    got = {r.doc_id: r.licenses for r in license_scan.licenses(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == dict(enumerate(license_scan.SPDX)) | {100: "MIT", 101: "GPL-2.0", 102: "", 103: "", 104: "MIT"}


def test_band_recall_at_the_threshold():
    """Texts that hold 0.8 of a template's shingles, in a place of their own: the bands retrieve all of them."""
    rng = random.Random(13)
    index = license_scan.Index(license_scan.TEMPLATES)
    asked = missed = 0
    for t, (_, text) in enumerate(license_scan.TEMPLATES):
        words = license_scan.plain(text).split()
        n = len(words) - license_scan.SHINGLE + 1
        for _ in range(5):
            lost = list(words)
            for at in rng.sample(range(len(words)), len(words)):
                trial = [*lost[:at], f"x{at}", *lost[at + 1 :]]
                [(_, h, _)] = list(license_scan.shingle_batches([" ".join(trial)]))
                if len(np.intersect1d(h, index.sets[t])) >= license_scan.THRESHOLD * len(index.sets[t]):
                    lost = trial
            around = " ".join([*(f"a{rng.randrange(999)}" for _ in range(rng.randrange(40))), *lost, *(f"b{rng.randrange(999)}" for _ in range(rng.randrange(40)))])
            [(_, h, ends)] = list(license_scan.shingle_batches([around]))
            asked, missed = asked + 1, missed + (t not in index.candidates(h, ends).get(0, ()))
            if n > 60:
                break
    assert asked > 200 and missed == 0


def test_licenses_in_parts_and_other_order(spark):
    """Whole texts with a clause lost, sentences in another order, words changed here and there."""
    rng = random.Random(4)
    mit = license_scan._MIT.split(". ")
    scattered = license_scan._MIT.split()
    for k in range(20, len(scattered), 40):
        scattered[k] = "xx"
    cases = [
        (". ".join(mit[:-1]), "MIT"), (". ".join(mit[::-1]), "MIT"), (" ".join(scattered), "MIT"), (" ".join(license_scan._MIT.split()[24:54]), ""), (license_scan._APACHE.replace("this file", "this work"), "Apache-2.0"),
        (license_scan._BSD_AS_IS, ""), (license_scan._ISC_AS_IS, ""), (license_scan._MPL.replace("https://mozilla.org/MPL/2.0/", "the site"), "MPL-2.0"),
    ]
    filler = lambda: " ".join(f"z{rng.randrange(500)}" for _ in range(40))
    frame = spark.createDataFrame([(i, f"{filler()} {t} {filler()}") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.licenses(license_scan.scan(frame)).collect()}
    assert [got[i] for i in range(len(cases))] == [n for _, n in cases]


def test_licenses_of_odd_rows(spark):
    phrase = "Released under the MIT License"
    rows = [(1, None), (None, phrase), (2, ""), (3, "word " * 200_000 + phrase + " word" * 50_000), (4, phrase), (4, phrase), (5, f"{phrase} {phrase}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit("x")).withColumn("n_words", F.lit(None).cast("int"))
    got = sorted((r.doc_id or -1, r.licenses, r.n_places) for r in license_scan.licenses(license_scan.scan(frame)).collect())
    assert got == [(-1, "MIT", 1), (1, "", 0), (2, "", 0), (3, "MIT", 1), (4, "MIT", 1), (4, "MIT", 1), (5, "MIT", 2)]


# ---- toxicity


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(docs, labels)
    known = labels.join(docs, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text", "toxic").toPandas()
    scores, truth = np.array(model.scores(known["text"].tolist())), known["toxic"].to_numpy()
    rank = scores.argsort().argsort()
    pos = truth == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.93 and ((scores >= 0.5) == pos).mean() > 0.96 and (scores[~pos] >= 0.5).mean() < 0.02


def test_risk_and_its_slope():
    rng = np.random.default_rng(0)
    below = set()
    for turn in range(40):
        g, positive = rng.normal(0, 2, 30) + (3 if turn % 2 else -3) * (np.arange(30) < 10), np.arange(30) < 10
        prior = 0.6 if turn % 2 else 0.1
        above, negative, d = toxicity.risk(g, positive, prior)
        loss = lambda y, x: np.mean(np.log1p(np.exp(-y * x)))
        assert np.isclose(above, prior * loss(1, g[positive])) and np.isclose(negative, loss(-1, g[~positive]) - prior * loss(-1, g[positive]))
        below.add(negative < 0)
        for i in range(0, 30, 3):
            e = np.where(np.arange(30) == i, 1e-5, 0.0)
            (a1, n1, _), (a0, n0, _) = toxicity.risk(g + e, positive, prior), toxicity.risk(g - e, positive, prior)
            want = (a1 + n1 - a0 - n0) if negative >= 0 else -(n1 - n0)
            assert np.isclose(d[i], want / 2e-5, atol=1e-6)
    assert below == {True, False}


def test_training_takes_the_non_negative_branch(monkeypatch):
    """Positives told apart so well that the negative risk would go below 0: it is held about 0."""
    seen, plain = [], toxicity.risk
    monkeypatch.setattr(toxicity, "risk", lambda *a: seen.append(plain(*a)[1]) or plain(*a))
    documents = [np.array([0], np.int64)] * 20 + [np.zeros(0, np.int64)] * 40
    model = toxicity.fit(documents, np.arange(60) < 20, 0.5, [11])
    assert min(seen) < 0 and abs(np.mean(seen[-50:])) < 0.05 and model.weights[11] > 0


def test_the_risk_does_the_work(monkeypatch):
    """Hidden positives outnumber the confirmed ones: the corrected risk scores their feature toxic, the plain one from the same start does not."""
    documents = [np.array([0], "<i4")] * 20 + [np.array([0], "<i4")] * 60 + [np.array([1], "<i4")] * 140
    positive = np.arange(220) < 20
    model = toxicity.fit(documents, positive, 0.3, [0, 1])
    logit = lambda m, k: m.bias + m.weights[k]
    assert logit(model, 0) > 0 > logit(model, 1)

    def plain(g, positive, prior):
        s = 1 / (1 + np.exp(-g))
        return 1.0, 0.0, np.where(positive, s - 1, s) / len(g)

    monkeypatch.setattr(toxicity, "risk", plain)
    assert logit(toxicity.fit(documents, positive, 0.3, [0, 1]), 0) < 0


def _plain_training(rows, labels):
    """The whole training in lists and sums: features, choice, and the descent."""
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    known = {d: t for d, t in labels if not held(d)}
    prior = sum(known.values()) / len(known)
    of = {d: set().union(*(toxicity.features_of(w.encode()) for w in re.findall("[0-9a-z]+", t.lower()))) for d, t in rows}
    sample = [(of[d], True) for d in sorted(known) if known[d] == 1] + [(of[d], False) for d in sorted(of) if not held(d)]
    n_pos = sum(p for _, p in sample)
    n_unl = len(sample) - n_pos
    chosen = []
    for f in sorted(set().union(*(x for x, _ in sample))):
        pos, unl = (sum(f in x for x, p in sample if p == side) for side in (True, False))
        expected = unl * n_pos / n_unl
        if pos >= 3 and (pos - expected) / (expected + 1) ** 0.5 >= 3.5 and pos >= (1 / (4 * prior) if prior < 0.2 else 1.5) * expected:
            chosen.append(f)
    w, b = dict.fromkeys(chosen, 2.0), float(np.log(prior / (1 - prior)))
    m, v = dict.fromkeys([*chosen, "b"], 0.0), dict.fromkeys([*chosen, "b"], 0.0)
    for t in range(1, 401):
        g = [b + sum(w[f] for f in x if f in w) for x, _ in sample]
        s = [1 / (1 + np.exp(-x)) for x in g]
        below = [np.log1p(np.exp(x)) for x in g]
        negative = sum(y for y, (_, p) in zip(below, sample) if not p) / n_unl - prior * sum(y for y, (_, p) in zip(below, sample) if p) / n_pos
        pull = [-prior * y / n_pos if p else y / n_unl for y, (_, p) in zip(s, sample)]
        push = [-prior * (1 - y) / n_pos if p else 0.0 for y, (_, p) in zip(s, sample)]
        d = [x + y for x, y in zip(pull, push)] if negative >= 0 else [-x for x in pull]
        slope = {f: sum(y for y, (x, _) in zip(d, sample) if f in x) + 1e-3 * w[f] for f in chosen} | {"b": sum(d)}
        for k, y in slope.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * y, 0.999 * v[k] + 0.001 * y * y
            step = 0.05 * (m[k] / (1 - 0.9**t)) / ((v[k] / (1 - 0.999**t)) ** 0.5 + 1e-8)
            if k == "b":
                b -= step
            else:
                w[k] -= step
    return w, b, of


def test_model_and_scores_against_a_plain_recomputation(spark):
    rng = random.Random(11)
    rows = [(d, " ".join([f"c{rng.randrange(40)}" for _ in range(12)] + (["vile", "nasty"] if d % 6 == 0 else []))) for d in range(150)]
    labels = [(d, int(d % 6 == 0)) for d in range(0, 150, 2)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    weights, bias, of = _plain_training(rows, labels)
    assert set(model.weights) == set(weights) != set() and np.isclose(model.bias, bias, atol=1e-6)
    assert all(np.isclose(model.weights[f], weights[f], atol=1e-6) for f in weights)
    for r in toxicity.score(docs, model, keep=("doc_id",)).collect():
        hit = of[r.doc_id] & set(weights)
        want = 1 / (1 + np.exp(-(bias + sum(weights[f] for f in hit))))
        assert np.isclose(r.score, want if hit else min(want, toxicity.UNKNOWN), atol=1e-6)


def test_a_corpus_without_learnt_features_loses_no_row(spark):
    rows = spark.createDataFrame([(i, f"clean words {i}") for i in range(42)] + [(None, None), (50, "")], "doc_id long, text string")
    for labels in ([(1, 1), (2, 0)], [(1, 1), (2, 1)], [(1, 1)], [(1, 0)], []):
        model = toxicity.train(rows, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.without_toxic(rows, model).count() == 44
    assert toxicity.without_toxic(rows, toxicity.Model(3.0, {1: 1.0})).count() == 44


def test_repeated_ids_are_used_once(spark):
    rows = [(i, "bad words here" if i % 3 == 0 else "good words there") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.scores(["bad words here"])[0] > 0.5 > max(model.scores(["good words there", "", None]))


def test_scores_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, keep=("doc_id", "label")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(docs, labels.where("false")).weights == {} and toxicity.train(nothing, labels).weights == {}
    assert toxicity.score(nothing, model).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(docs, model, keep=("Score",))
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("score = 'x'").count() == kept.count() > 0


def test_every_page_is_compared(spark):
    """Pages whose article markup settles are compared with their neighbours, too: shared lines are found, and stay."""
    page = lambda k: f"<nav>Menu</nav><article><p>Story {k} in words that only it has {'z' * 9 * k}</p><p>A quotation</p></article>"
    frame = spark.createDataFrame([(k, f"http://h.org/{k}", page(k)) for k in range(1, 5)], "page_id long, url string, html string")
    found = html.differences(html.parsed(frame)).collect()
    assert [(r.n_shared, r.gone) for r in found] == [(1, [])] * 4
    assert all(r.text.endswith("z A quotation") for r in html.main_text(frame).collect())
    assert html.shared([1, 2, 3, 4], [0, -9, 5, 40], [[2, 3, 4], [1, 2, 3]]) == (2, [1])
