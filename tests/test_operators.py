"""Hand-made cases for what the driver's tables do not hold."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.access import contains, public_config, secret_keys, visible
from millrace.functions.text import Clause, matches, parse_websearch, simple_tokens, stem
from millrace.functions import display
from millrace.operators import chunking, context, datasets, evaluation, index, ingest, jobs, mentions, search, state
from millrace.sources import connectors
from millrace.streaming import streams


# ---- search language


def test_parse_websearch():
    assert parse_websearch('blue -sky or "red sea"') == [[Clause(("blue",)), Clause(("sky",), True)], [Clause(("red", "sea"))]]
    assert parse_websearch("") == [] and parse_websearch(None) == []
    assert parse_websearch("the of", english=True) == []
    assert parse_websearch('"state of art"', english=True) == [[Clause(("state", None, "art"))]]


# the algorithm's published sample of words and stems, and cases of each of its rules
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoped hope luxuriated luxuri falling fall cry cri by by say say happy happi skies sky dying die news news proceed proceed inning inning
generate generat generalization general communication communic arsenal arsenal relational relat conditional condit rational ration geologi geolog hopefulness hope sensibilities sensibl adjustment adjust adoption adopt controlling control roll roll yes yes youth youth boyish boyish café café cafés café"""


def test_stem():
    words = STEMS.split()
    assert [(w, stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2]))
    assert [stem(w) for w in ("running", "ponies", "hopping", "relational", "cats", "caress", "", "a", "ss", "日本s")] == ["run", "poni", "hop", "relat", "cat", "caress", "", "a", "ss", "日本s"]


def test_matches(spark):
    d = spark.createDataFrame([(1, "the blue sea"), (2, "blue sky"), (3, "red sea"), (4, None), (5, "sea red")], "id int, t string").withColumn("k", simple_tokens(F.col("t")))
    hit = lambda q: [r.id for r in d.where(matches(F.col("k"), parse_websearch(q))).orderBy("id").collect()]
    assert hit("blue") == [1, 2]
    assert hit("blue -sky") == [1]
    assert hit('"red sea" or sky') == [2, 3]
    assert hit("sea red") == [3, 5]
    assert hit("-blue") == [3, 4, 5]


def test_access(spark):
    rows = [(1, True, []), (2, False, ["hr"]), (3, False, ["eng", None]), (4, None, None), (5, False, [])]
    d = spark.createDataFrame(rows, "id int, acl_public boolean, acl_groups array<string>")
    seen = lambda groups, admin=False: [r.id for r in d.where(visible(groups, admin)).orderBy("id").collect()]
    assert seen([]) == [1] and seen(["hr"]) == [1, 2] and seen(["hr", "eng"]) == [1, 2, 3] and seen([], True) == [1, 2, 3, 4, 5]


def test_containment(spark):
    docs = [{"a": 1, "b": {"c": ["x", "y"]}}, {"a": "1"}, {"b": {"c": []}}, {"a": None, "t": True}]
    d = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "id int, j string").withColumn("v", F.parse_json("j"))
    hit = lambda w: [r.id for r in d.where(contains(F.col("v"), w)).orderBy("id").collect()]
    assert hit({"a": 1}) == [0] and hit({"a": "1"}) == [1] and hit({"b": {"c": ["y"]}}) == [0] and hit({"b": {"c": []}}) == [0, 2]
    assert hit({}) == [0, 1, 2, 3] and hit({"a": None}) == [3] and hit({"t": True}) == [3] and hit({"zz": 1}) == []


def test_secrets(spark):
    d = spark.createDataFrame([({"api_token": "x", "repo": "r", "Password": ""},)], "c map<string,string>")
    r = d.select(public_config(F.col("c")).alias("p"), secret_keys(F.col("c")).alias("s")).first()
    assert r.p == {"repo": "r"} and r.s == ["api_token"]


def _index(spark):
    rows = [(1, "apple apple pear", [1.0, 0.0], True, []), (2, "apple", [0.0, 1.0], False, ["hr"]), (3, "pear plum", None, True, []), (4, "", [0.6, 0.8], True, []), (5, None, [0.6, 0.8], True, None)]
    return index.index_of(spark.createDataFrame(rows, "chunk_id long, content string, embedding array<float>, acl_public boolean, acl_groups array<string>").withColumn("tenant_id", F.lit("t")))


def test_alpha_ends_and_access(spark):
    queries = [search.Query(1, "apple", (0.0, 1.0)), search.Query(2, "  ", (1.0, 0.0))]
    stranger, admin = search.Principal("t"), search.Principal("t", (), True)
    dense = [r.chunk_id for r in search.hybrid_search(_index(spark), queries, admin, search.Params(alpha=1.0)).orderBy("fused_rank").collect() if r.dense_rank]
    assert dense == [2, 4, 5, 1]
    words = search.hybrid_search(_index(spark), queries, admin, search.Params(alpha=0.0)).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in words if r.sparse_rank] == [2, 1] or [r.chunk_id for r in words if r.sparse_rank] == [1, 2]
    assert {r.query_id for r in words} == {1}
    few = {r.chunk_id for r in search.hybrid_search(_index(spark), queries, stranger).collect()}
    assert few < {r.chunk_id for r in words} and 2 not in few


def test_params():
    p = search.Params(top_k=99, candidates=1, alpha=3, rrf_k=0, min_score=-1).clamped()
    assert (p.top_k, p.candidates, p.alpha, p.rrf_k, p.min_score) == (50, 50, 1.0, 1, 0.0)


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.2), (2, 3, 0.5)], "query_id long, chunk_id long, fused double")
    ratings = spark.createDataFrame([(1, 1, 2.0), (1, 2, 9.0)], "query_id long, chunk_id long, rating double")
    assert [(r.query_id, r.chunk_id) for r in search.reranked(hits, ratings).orderBy("query_id", "final_rank").collect()] == [(1, 2), (1, 1), (2, 3)]


@pytest.mark.parametrize("needle", ["100%", "a_b", "x.y*", "aa"])
def test_mentions_are_literal(spark, needle):
    texts = ["100% sure", "a_b aXb", "x.y* and x.y*", "aaaa AA", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").withColumns({"source_kind": F.lit("web"), "title": F.lit("t"), "ordinal": F.lit(0)})
    got = {r.chunk_id: (r.match_offset, r.occurrences) for r in mentions.find_mentions(d, needle, F.lit(True)).collect()}
    low = needle.lower()
    assert got == {i: (t.lower().find(low), t.lower().count(low)) for i, t in enumerate(texts) if t and low in t.lower()}


# ---- ingest


def test_strip_html(spark):
    html = "<h2>Head</h2><script>x</script><p>a &amp;lt; b&nbsp;&#8212;&#39;</p><!-- c --><br/>z"
    assert spark.createDataFrame([(html,)], "h string").select(ingest.strip_html(F.col("h"))).first()[0] == "## Head\n\na &lt; b —'\n\nz"


def test_kinds(spark):
    d = spark.createDataFrame([("a/b.PY",), ("x.md",), ("Makefile",), ("y.bin",), (None,)], "p string")
    assert [tuple(r) for r in d.select(ingest.kind_of(F.col("p")), ingest.language_of(F.col("p"))).collect()] == [("code", "python"), ("md", None), (None, None), (None, None), (None, None)]


def test_prose_chunks():
    text = "# Title\nIntro text.\n\n## Part\n" + " ".join(f"Sentence number {i} says something." for i in range(120)) + "\n\n## Empty\n\nShort."
    got = chunking.chunk_prose("Title", [(None, text)])
    assert got[0].heading == "Title" and got[0].content == "Intro text."
    assert all(len(c.content) <= chunking.MOST for c in got)
    assert {c.heading for c in got} == {"Title", "Title › Part", "Title › Empty"}
    assert all(f"number {i} says" in " ".join(c.content for c in got) for i in range(120))
    assert chunking.chunk_prose("t", [(1, "a" * 5000)]) and chunking.chunk_prose("t", [(1, "")]) == []
    pages = chunking.chunk_prose("t", [(1, "One."), (2, "Two.")])
    assert pages[0].page == 1


def test_code_chunks():
    body = "\n\n".join(f"    def m{i}(self):\n" + "        x = 1\n" * 40 for i in range(4))
    code = "import os\n" * 40 + "class A:\n" + body + "\ndef tail():\n    return 1\n"
    got = chunking.chunk_code("f.py", [(None, code)], "python")
    assert [c.heading for c in got][:3] == ["f.py › imports", "f.py › A › m0", "f.py › A › m1"] and got[-1].heading == "f.py › tail"
    assert got[-1].metadata["start_line"] == code[: code.index("def tail")].count("\n") + 1
    assert chunking.symbols(["func (r *T) Go() {", "type X struct {"], "go")[0][0] == "Go"
    assert len(chunking.chunk_code("c.yml", [(None, "k: v\n" * 1000)], "yaml")) == 4


def test_conversation_chunks(spark):
    pages = ["# thread\n" + "\n".join(f"m{i} " + "x" * 300 for i in range(10)), "no title\nline\n \n", None, "#\n" + "y" * 3000]
    none = F.lit(None).cast("string")
    d = spark.createDataFrame([(1, pages), (2, ["one"]), (3, None)], "document_id long, pages array<string>").withColumns({"kind": F.lit("conversation"), "title": F.lit("chat"), "language": none, "path": none})
    got = chunking.chunk_documents(d).orderBy("document_id", "ordinal").collect()
    said = [json.loads(r.metadata) for r in got]
    first = [r for r in got if r.document_id == 1]
    assert [r.ordinal for r in first] == list(range(len(first))) and first[0].heading == "chat › thread" and first[-1].heading == "chat" and got[-1].page is None
    assert sum(m["message_count"] for m in said) == 14 and said[0]["thread"] == "thread" and "thread" not in said[-1]
    assert all(len(r.content) <= chunking.TARGET or r.content == "y" * 3000 for r in got) and {r.page for r in first} == {1, 2, 4}
    assert got[0].context_text == f"chat › thread\n\n{got[0].content}" and got[0].token_count == -(-len(got[0].context_text) // 4)
    sums = {r.document_id: (r.chunks, r.tokens) for r in chunking.totals(chunking.chunk_documents(d)).collect()}
    assert sums == {k: (sum(r.document_id == k for r in got), sum(r.token_count for r in got if r.document_id == k)) for k in (1, 2)}


def plain_cover(sizes, limit, gap):
    groups = []
    for k, size in enumerate(sizes):
        if groups and sum(sizes[i] for i in groups[-1]) + gap * len(groups[-1]) + size <= limit:
            groups[-1].append(k)
        else:
            groups.append([k])
    return [(g[0], g[-1] + 1) for g in groups]


def test_cover_and_pieces():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(12))]
        assert chunking.cover(sizes, 40, 2) == plain_cover(sizes, 40, 2)
    words = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma."]) for _ in range(n))
    for _ in range(40):
        text = words(rng.randrange(1, 900)) + rng.choice(["", " " + "z" * 4500 + ". More here."])
        spans = chunking.piece_spans(text)
        assert all(0 < e - s <= chunking.MOST for s, e in spans) and "".join(text[s:e] for s, e in spans).replace(" ", "") == text.replace(" ", "")
        tail = chunking.overlap(text)
        assert text.endswith(tail) and (len(tail) <= 2 * chunking.OVERLAP) and (tail == text or not tail or len(tail) >= chunking.OVERLAP or len(chunking.sentence_spans(text[-2 * chunking.OVERLAP :])) >= 1)


def test_chunks_of_few_documents_are_held_at_once():
    import pyarrow as pa

    n = 2 * chunking.DOCUMENTS + 1
    texts = [[f"Text {i}."] if i % 5 else [None] for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), *(pa.array(c, pa.string()) for c in (["txt"] * n, ["t"] * n, [None] * n, [None] * n)), pa.array(texts, pa.list_(pa.string()))], ["document_id", "kind", "title", "language", "path", "pages"])
    found = list(chunking.chunk_batches(iter([batch])))
    assert len(found) == 3 and max(b.num_rows for b in found) <= chunking.DOCUMENTS
    assert [r["document_id"] for b in found for r in b.to_pylist()] == [i for i in range(n) if i % 5]


def test_prose_windows_hold_every_sentence_in_order():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randrange(1, 150)
        sentences = [f"Sentence {i} has {'word ' * rng.randrange(1, 25)}end." for i in range(n)]
        blocks, at = [], 0
        while at < n:
            size = rng.randrange(1, 30)
            blocks.append(" ".join(sentences[at : at + size]))
            at += size
        got = chunking.chunk_prose("t", [(None, "\n\n".join(blocks))])
        whole, place = " ".join(c.content.replace("\n\n", " ") for c in got), -1
        for i, x in enumerate(sentences):
            assert (place := whole.find(x, place + 1)) >= 0
        assert all(c.heading == "t" for c in got) and max(len(c.content) for c in got) <= chunking.MOST + chunking.OVERLAP * 2


@pytest.mark.parametrize(
    "language, line, name",
    [
        ("python", "    async def go(x):", "go"), ("python", "class A(B):", "A"), ("python", "defx y", None), ("go", "func (r *T) Go() {", "Go"), ("go", "type X struct {", "X"), ("rust", "pub async fn run<T>() {", "run<T>"),
        ("rust", "impl Foo {", "Foo"), ("sql", "CREATE OR REPLACE view v.x as", "v.x"), ("sql", "create table if not exists t (", "t"), ("sql", "select table x", None), (None, "export default async function f() {", "f"), (None, "const $x = 1", "$x"),
        ("ruby", "module A::B", "A::B"), (None, "return const", None), ("unknown", "  private static class Q {", "Q"),
    ],
)
def test_declarations(language, line, name):
    found = chunking.symbols([line], language)
    assert (found[0][0] if found else None) == name


def test_reindex(spark):
    v = "document_id long, content_hash string, extractor_version int, chunker_version int, embedding_version string"
    now = spark.createDataFrame([(1, "a", 1, 1, "e"), (2, "b", 1, 1, "e"), (3, "c", 2, 1, "e"), (4, "d", 1, 1, "f"), (5, "e", 1, 1, "e")], v)
    old = spark.createDataFrame([(1, "a", 1, 1, "e"), (2, "x", 1, 1, "e"), (3, "c", 1, 1, "e"), (4, "d", 1, 1, "e")], v)
    assert dict(map(tuple, ingest.reindex_scope(now, old).collect())) == {1: "none", 2: "full", 3: "full", 4: "embed", 5: "full"}


def test_state(spark):
    c = "document_id long, ordinal int, content string"
    old, new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], c), spark.createDataFrame([(1, 0, "z")], c)
    assert sorted(map(tuple, state.replace_chunks(old, new).collect())) == [(1, 0, "z"), (2, 0, "c")]
    assert sorted(map(tuple, state.delete_documents(old, new.select("document_id")).collect())) == [(2, 0, "c")]


# ---- jobs


def test_jobs(spark):
    from millrace.plans.tables import jobs as table

    now = F.expr("timestamp_ntz'2024-01-20 12:00:00'")
    j = table(spark, "/root/testdata/sf0.001").where("id < 40")
    claimed = jobs.claim(j, "me", now, batch=3)
    mine = [r.id for r in claimed.where("locked_by = 'me'").collect()]
    assert len(mine) == 3
    assert jobs.heartbeat(claimed, mine[0], "other", now).exceptAll(claimed).count() == 0
    done = jobs.complete(claimed, mine[0], "me", now)
    assert done.where(F.col("id") == mine[0]).first().status == "succeeded"
    assert jobs.fail(claimed, F.col("id") == mine[1], F.lit("e"), now, retryable=False).where(F.col("id") == mine[1]).first().status == "dead"


# ---- evaluation


def test_citations_and_lead(spark):
    d = spark.createDataFrame([("see [2][9][2] and [1]", 3), ("none", 3), (None, 3)], "a string, n int")
    assert [r[0] for r in d.select(context.citations(F.col("a"), F.col("n"))).collect()] == [[1, 2], [], None]
    long = "Short one. Second sentence here. Third."
    assert spark.createDataFrame([(long,)], "t string").select(context.lead(F.col("t"))).first()[0] == "Short one. Second sentence here."


def test_bootstrap_is_exact(spark, monkeypatch):
    deltas = [0.1, -0.2, 0.4, 0.0, 0.3]
    pairs = spark.createDataFrame([("m", i, d) for i, d in enumerate(deltas)], "metric string, question_id long, delta double")
    rng = random.Random(evaluation.SEED)
    means = sorted(sum(deltas[rng.randrange(5)] for _ in range(5)) / 5 for _ in range(500))
    r = evaluation.bootstrap(pairs, resamples=500).first()
    assert (r.ci_low, r.ci_high) == pytest.approx((means[12], means[487]), abs=1e-12)
    for n, most in ((5, 40), (1, 4_000_000), (64, 1000), (100, 10**7)):
        monkeypatch.setattr(evaluation, "DRAWS", most)
        rng = random.Random(evaluation.SEED)
        assert np.concatenate(list(evaluation._draws(n, 300, evaluation.SEED))).tolist() == [[rng.randrange(n) for _ in range(n)] for _ in range(300)]


def test_bootstrap_in_blocks_is_the_same(spark, monkeypatch):
    rng = random.Random(5)
    pairs = spark.createDataFrame([(m, i, rng.random() - 0.4) for m, n in (("a", 5), ("b", 40), ("c", 40), ("d", 1)) for i in range(n)], "metric string, question_id long, delta double")
    whole = sorted(map(repr, evaluation.bootstrap(pairs, resamples=300).collect()))
    monkeypatch.setattr(evaluation, "BLOCK_DRAWS", 1_000)
    assert sorted(map(repr, evaluation.bootstrap(pairs, resamples=300).collect())) == whole
    deltas = np.array([rng.random() for _ in range(17)])
    many = evaluation._means(deltas, 0, 300, 300, 1)
    monkeypatch.setattr(evaluation, "DRAWS", 100)
    assert np.concatenate([evaluation._means(deltas, a, b, 300, 1) for a, b in ((0, 7), (7, 150), (150, 300))]).tolist() == many.tolist()


def test_listings(spark):
    from millrace.operators import listings

    at = lambda n: dt.datetime(2024, 1, n)
    docs = spark.createDataFrame([(1, "t", "s", at(1)), (2, "t", "s", at(3)), (3, "t", "r", at(2)), (4, "u", "s", at(4))], "document_id long, tenant_id string, source_id string, created_at timestamp")
    sources = spark.createDataFrame([("s", "web", "Site"), ("r", "slack", "Chat")], "source_id string, kind string, name string")
    assert [(r.document_id, r.source_name) for r in listings.documents_of(docs, sources, "t").collect()] == [(2, "Site"), (3, "Chat"), (1, "Site")]
    assert [r.document_id for r in listings.documents_of(docs, sources, "t", "s", 1).collect()] == [2]
    users = spark.createDataFrame([(1, "t", "A@x", True, at(2)), (2, "t", "b@x", True, at(1)), (3, "u", "a@x", False, at(1))], "user_id long, tenant_id string, email string, is_admin boolean, created_at timestamp")
    tenants = spark.createDataFrame([("t", "tee", "T"), ("u", "you", "U")], "tenant_id string, slug string, name string")
    assert {r.user_id for r in listings.accounts(users, tenants, " a@X").collect()} == {1, 3}
    assert {r.user_id for r in listings.accounts(users, tenants, "a@x", "you").collect()} == {3}
    assert [tuple(r) for r in listings.first_admins(users, tenants).collect()] == [("tee", "b@x")]


def test_answers_checks(spark):
    d = spark.createDataFrame([("We could NOT find it", ["find", "x"], ["not"])], "a string, w array<string>, u array<string>")
    r = d.select(evaluation.missing_phrases(F.col("a"), F.col("w")), evaluation.forbidden_phrases(F.col("a"), F.col("u")), evaluation.abstained(F.col("a"))).first()
    assert tuple(r) == (["x"], ["not"], True)


# ---- connectors and streams


def test_channel_documents(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("c", t(0), None, "u1", "first &amp; <@U2> <https://x.y|link>", None), ("c", t(10), t(0), "u2", "reply here", None), ("c", t(20), None, "u1", "alone today", None), ("c", t(30), t(5), "u1", "stray reply", None), ("c", t(40), None, "u1", "joined", "channel_join"), ("c", t(50), None, "u1", "x", None)]
    d = spark.createDataFrame(rows, "channel string, ts timestamp, thread_ts timestamp, user string, text string, subtype string")
    got = {r.title: r.text for r in connectors.channel_documents(d, {"U2": "bo"}).collect()}
    assert set(got) == {"#c · first & @bo link", "#c · 2024-01-01"}
    assert got["#c · 2024-01-01"].split("\n")[1:] == ["[2024-01-01 00:00] u1: alone today"]


def test_renderers():
    rich = lambda s, **k: {"rich_text": [{"plain_text": s, "annotations": k}]}
    blocks = [{"type": "heading_2", "heading_2": rich("H")}, {"type": "to_do", "to_do": rich("t") | {"checked": True}}, {"type": "bulleted_list_item", "bulleted_list_item": rich("b", bold=True), "children": [{"type": "paragraph", "paragraph": rich("in")}]}]
    assert connectors.blocks_markdown(blocks) == "## H\n- [x] t\n- **b**\n  in"
    adf = {"type": "doc", "content": [{"type": "heading", "attrs": {"level": 3}, "content": [{"type": "text", "text": "H"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "p"}]}]}
    assert connectors.adf_text(adf).strip() == "### H\n\np"


def test_files(spark):
    d = spark.createDataFrame([("a/x.py", 10, "code"), ("node_modules/y.py", 10, "c"), ("z.min.js", 5, "c"), ("big.py", 500_000, "c"), ("nul.py", 4, "a\0b"), ("r.xyz", 1, "c")], "path string, size long, content string")
    assert [r.external_id for r in connectors.repository_files(d).collect()] == ["a/x.py"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out: list[pd.DataFrame] = []
    stream = streams.daily_documents(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    streams.run_available(stream, str(tmp_path / "ck"), lambda df, _: out.append(df.toPandas()), "complete")
    want = streams.daily_documents(events).toPandas()
    key = ["day", "event_type"]
    assert out[-1].sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))


def test_office_files(spark):
    import io
    import zipfile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = para("Head", "Heading2") + para("Body text") + f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    d = spark.createDataFrame([(bytearray(out.getvalue()),), (bytearray(b"junk"),), (None,)], "b binary")
    assert [r[0] for r in d.select(connectors.office_text(F.col("b"))).collect()] == ["## Head\n\nBody text\n\na | b", None, None]


def test_titles_and_traces(spark):
    docs = spark.createDataFrame([("t", "A", 1, 1), ("t", "A", 2, 5), ("t", "B", 3, 1)], "tenant_id string, title string, document_id long, created_at int")
    found, warned = datasets.resolve_titles(spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "question_id long, title string"), docs)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3)]
    assert sorted(map(tuple, warned.collect())) == [("A", "several documents"), ("C", "no such document")]
    traced = search.hybrid_search(_index(spark), [search.Query(1, "apple", (0.0, 1.0))], search.Principal("t", (), True))
    rows = datasets.trace_chunks(traced)
    assert {r.stage for r in rows.collect()} == {"dense", "sparse", "fused"} and rows.where("stage = 'fused'").count() == traced.count()


def test_reindex_jobs(spark):
    now = F.expr("timestamp_ntz'2024-01-20 12:00:00'")
    docs = spark.createDataFrame([(1, "e1"), (2, "e2"), (3, None)], "document_id long, embedding_version string")
    new = jobs.reindex_jobs(docs, "e2", 1000, now)
    assert sorted(r.id for r in new.collect()) == [1001, 1003]
    from millrace.plans.tables import jobs as table

    queue = jobs.enqueue(table(spark, "/root/testdata/sf0.001"), new)
    assert jobs.enqueue(queue, new.withColumn("id", F.col("id") + 5000)).count() == queue.count()


def test_display(spark):
    d = spark.createDataFrame([(1, None, 4.0, 2048, "A b--C!"), (None, None, 1e9, 3, None)], "d int, s int, x double, n long, t string")
    r = d.select(display.channel_bias(F.col("d"), F.col("s")), display.bar_width(F.col("x")), display.found_by_both(F.col("d"), F.col("s")), display.file_size(F.col("n")), display.slug(F.col("t"))).collect()
    assert tuple(r[0]) == (1.0, 62.0, False, "2.0 KB", "a-b-c") and tuple(r[1]) == (None, 100.0, False, "3 B", None)


# ---- what the queries do not reach


def test_filters_and_orders(spark):
    found = spark.createDataFrame([(1, "web", "b", 0, 2), (2, "upload", "z", 0, 1), (3, "web", "a", 1, 2), (4, "web", "a", 0, 2)], "chunk_id long, source_kind string, title string, ordinal int, kind_order int")
    assert [r.chunk_id for r in mentions.ordered(found, 3).collect()] == [2, 4, 3]
    d = spark.createDataFrame([(1, "short", "  a longer query  "), (2, "x", "y" * 200), (3, "q", "  ")], "document_id long, q string, r string")
    assert [r[0] for r in d.select(search.rewrite_accepted(F.col("q"), F.col("r"))).collect()] == ["a longer query", "x", "q"]
    assert [r[0] for r in d.where(search.in_documents([1, 3])).select("document_id").collect()] == [1, 3] and d.where(search.in_documents(None)).count() == 3
    runs = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01"), (3, None)], "run_id long, started_at string")
    assert [r.run_id for r in evaluation.newest_first(runs).collect()] == [2, 1, 3]
    results = spark.createDataFrame([(1, None, 0.5), (2, "e", 1.0), (3, None, None), (4, None, 0.1)], "question_id long, error string, recall double")
    assert [r.question_id for r in evaluation.worst(results).collect()] == [2, 3, 4, 1]
    held, took = search.timed({"one": d})
    assert held["one"].count() == 3 and took["one"] > 0


def _same_index(one, other):
    """Equal postings with positions, frequencies, statistics and lengths."""
    for name, key in (("postings", ["term", "chunk_id", "class_id", "tf", "n_terms", "gaps"]), ("frequencies", ["term", "class_id", "df", "occurrences"]), ("classes", ["class_id", "tenant_id", "acl_public", "acl_groups", "chunks", "terms"]), ("lengths", ["chunk_id", "class_id", "n_terms"]), ("stats", ["tenant_id", "chunk_count", "avg_len"])):
        a, b = (sorted(map(repr, getattr(i, name).select(key).collect())) for i in (one, other))
        assert a == b, name


def test_stored_index_equals_an_unstored_one(spark, tmp_path):
    plain = _index(spark)
    index.write_index(plain.chunks, str(tmp_path / "i"), buckets=5)
    stored = index.read_index(plain.chunks, str(tmp_path / "i"))
    _same_index(stored, plain)
    queries = [search.Query(1, "apple or plum"), search.Query(2, "pear -plum"), search.Query(3, '"apple pear"'), search.Query(4, "nothing")]
    rank = lambda i: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in search.lexical(i, queries, search.Principal("t", (), True), 9).collect())
    assert rank(stored) == rank(plain) and {(q, c) for q, c, _ in rank(plain)} == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)}
    embedded = search.hybrid_search(stored, [search.Query(7, "apple")], search.Principal("t", (), True), embed=lambda texts: [(0.0, 1.0) for _ in texts])
    assert {r.chunk_id for r in embedded.where("dense_rank = 1").collect()} == {2}


def test_index_of_a_cleared_folder_is_written_again(spark):
    import shutil

    from millrace.plans import tables

    first = tables.stored_index(spark, "/root/testdata/sf0.001")
    path = dict(tables._stored)
    assert tables.stored_index(spark, "/root/testdata/sf0.001").postings.count() == first.postings.count() and tables._stored == path
    for p in path.values():
        shutil.rmtree(p.removeprefix("file://"), ignore_errors=True)
    assert tables.stored_index(spark, "/root/testdata/sf0.001").stats.count() == 2 and tables._stored != path


def test_vectors(spark):
    c = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, None)], "document_id long, ordinal int, embedding array<double>")
    v = spark.createDataFrame([(1, 1, [9.0]), (2, 0, [8.0]), (3, 0, [7.0])], "document_id long, ordinal int, embedding array<double>")
    assert sorted((r.document_id, r.ordinal, r.embedding) for r in state.update_vectors(c, v).collect()) == [(1, 0, [1.0]), (1, 1, [9.0]), (2, 0, [8.0])]
    assert sorted(map(tuple, state.vectors_fit(c, v).collect())) == [(1, 2, 1), (3, 0, 1)]
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in d.select(ingest.normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_members(spark):
    m = spark.createDataFrame([(1, 1), (1, 2)], "user_id long, group_id long")
    assert sorted(map(tuple, state.add_members(m, m.where("group_id = 2").unionByName(spark.createDataFrame([(2, 2), (2, 2)], m.schema))).collect())) == [(1, 1), (1, 2), (2, 2)]


def test_context_and_replies(spark):
    packed = context.pack_context(spark.createDataFrame([(1, 1, "s", "aa"), (1, 2, "s", "bb"), (2, 1, None, None)], "query_id long, rank int, source string, content string"))
    assert {r.query_id: (r.context, r.tokens) for r in context.context_text(packed).collect()} == {1: ("[1] s\naa\n\n---\n\n[2] s\nbb", 5), 2: ("[1] \n", 1)}
    asked = spark.createDataFrame([(1, "who?"), (3, None)], "query_id long, text string")
    assert {r.query_id: (r.prompt, r.tokens) for r in context.prompts(asked, packed).collect()} == {1: ("Context passages:\n\n[1] s\naa\n\n---\n\n[2] s\nbb\n\n---\n\nQuestion: who?", 5), 3: ("Context passages:\n\n\n\n---\n\nQuestion: ", 1)}
    said = spark.createDataFrame([(" be kind ", True), ("x", False)], "own string, strict boolean").select(context.system_text(F.col("own"), F.col("strict")).alias("t")).collect()
    assert said[0].t.startswith("be kind\n\nRules:\n- ") and said[0].t.endswith(context.RULES[5]) and said[1].t.endswith(context.RULES[4]) and said[0].t.count("\n- ") == 5
    lines = spark.createDataFrame([("h", "t", 3), ("", "t", None), (None, None, 2), (None, "t", 0)], "h string, t string, p int").select(context.source_line(F.col("h"), F.col("t"), F.col("p")).alias("s")).collect()
    assert [r.s for r in lines] == ["h · p.3", "t", "p.2", "t"]
    texts = ['{"a": 1}', 'Sure:\n```json\n{"a": 1}\n``` ok', "so {\"a\": 1}.", "nothing", None, "{broken"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(F.try_variant_get(context.json_reply(F.col("t")), "$.a", "int")).collect()] == [1, 1, 1, None, None, None]


def test_answer_measures(spark):
    lists = "c array<string>, r array<string>, t array<string>"
    d = spark.createDataFrame([(["a", "b"], ["a", "b"], ["a"]), (["a", "x"], ["a"], []), ([], ["a"], ["a"])], lists)
    assert [r[0] for r in d.select(evaluation.citation_accuracy(F.col("c"), F.col("r"), F.col("t"))).collect()] == [0.5, 0.5, None]
    assert [r[0] for r in d.select(evaluation.truth_level(F.col("t"), F.col("r"), F.col("c"))).collect()] == ["chunk", "document", "chunk"]
    n = spark.createDataFrame([(3, 4), (9, 4), (0, 0)], "s int, n int")
    assert [r[0] for r in n.select(evaluation.faithfulness(F.col("s"), F.col("n"))).collect()] == [0.75, 1.0, None]
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "question_id long, label string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "z")], "question_id long, label string")
    assert {r.label: r["rank"] for r in evaluation.ranks_of(ranked, truth).collect()} == {"b": 2, "z": None}
    m = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "9", "d": "4"})], "x map<string,string>, y map<string,string>")
    assert m.select(evaluation.config_changes(F.col("x"), F.col("y"))).first()[0] == ["b", "c", "d"]
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.1, -0.1, 0.2), (30, 0.6, 0.5, 0.7), (2, -0.5, -0.6, -0.4)], "n int, d double, l double, h double")
    assert [r[0] for r in v.select(evaluation.verdict_text(*map(F.col, "ndlh"))).collect()] == ["no questions in common", "inconclusive on 1 question — the interval spans zero", "better by 0.600 (+0.500 to +0.700)", "worse by 0.500 (-0.600 to -0.400)"]


def test_invalid_questions(spark):
    uuid = "01234567-89ab-cdef-0123-456789abcdef"
    rows = [(1, "q", "temporal", [uuid], [], [], ["question"]), (2, "q", "odd", ["x"], [], [], ["question", "zz"]), (3, " ", None, None, None, None, None), (4, "u", "unanswerable", [], [], ["t"], []), (5, "v", "unanswerable", [], None, [], [])]
    d = spark.createDataFrame(rows, "question_id long, question string, difficulty string, expected_chunk_ids array<string>, expected_document_ids array<string>, expected_documents array<string>, fields array<string>")
    got = {}
    for r in evaluation.invalid_questions(d, F.col("fields")).collect():
        got.setdefault(r.question_id, set()).add(r.problem)
    assert got == {2: {"duplicates an earlier question", "unknown difficulty odd", "expected_chunk_ids contains no UUID: x", "unknown fields: zz"}, 3: {"no question"}, 4: {"unanswerable, but names expected documents"}}


def test_connectors_of_services(spark, tmp_path):
    assert connectors.changed_paths(None) is None
    few, many = (spark.range(n).selectExpr("concat('f', id, '.py') as path") for n in (3, 300))
    assert connectors.changed_paths(few).count() == 3 and connectors.changed_paths(many) is None
    files = spark.createDataFrame([("f1.py", 3, "a=1"), ("g.py", 3, "b=1")], "path string, size long, content string")
    assert [r.external_id for r in connectors.repository_files(files, connectors.changed_paths(few)).collect()] == ["f1.py"]
    times = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 5)), (2, dt.datetime(2024, 1, 1, 1))], "id int, updated_at timestamp")
    cursor = F.lit(dt.datetime(2024, 1, 2, 12))
    assert [r.id for r in connectors.since(times, cursor, "12 hours").collect()] == [1] and connectors.since(times, None, "1 hour").count() == 2
    assert connectors.since(times, cursor, "26 hours").count() == 2
    one = spark.range(1)
    assert one.select(connectors.next_cursor(times)).first()[0] == dt.datetime(2024, 1, 2, 5) and connectors.next_cursor(times.where("false")) is None
    assert one.select(connectors.next_cursor(times, F.lit(dt.datetime(2025, 1, 1)))).first()[0] == dt.datetime(2025, 1, 1)
    for name, data in (("a.md", b"# hi"), ("e.txt", b""), ("z.bin", b"x")):
        (tmp_path / name).write_bytes(data)
    assert {r.title: (r.kind, r.problem) for r in connectors.uploads(spark, str(tmp_path)).collect()} == {"a.md": ("md", None), "z.bin": (None, "unknown kind")}
    issues = spark.createDataFrame([("K-1", "Sum", "Open", "Bug", "Ann", None, ["x"], "text"), ("K-2", None, None, None, None, "Bo", [], None)], "key string, summary string, status string, issue_type string, assignee string, reporter string, labels array<string>, description string")
    said = spark.createDataFrame([("K-1", "Cy", dt.datetime(2024, 1, 1, 9, 30), '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"ok"}]}]}')], "key string, author string, created timestamp, body string")
    got = {r.external_id: r.text for r in connectors.issue_documents(issues, said).collect()}
    assert got["K-1"].startswith("# K-1 · Sum\n\nBug · Open · assigned to Ann · reported by unknown · labels: x\n\n## Description\ntext") and "**Cy** · 2024-01-01 09:30\nok" in got["K-1"]
    assert got["K-2"] == "# K-2 · Untitled\n\nissue · unknown · assigned to unassigned · reported by Bo · labels: none\n\n## Description\n_No description._"
    blocks = json.dumps([{"type": "image", "image": {"external": {"url": "u"}}}, {"type": "equation", "equation": {"expression": "x"}}, {"type": "callout", "callout": {"icon": {"emoji": "!"}, "rich_text": [{"plain_text": "c"}]}}, {"type": "child_page", "child_page": {}}])
    assert spark.createDataFrame([(blocks,), (None,)], "b string").select(connectors.page_markdown(F.col("b"))).collect()[0][0] == "[image](u)\n$$ x $$\n> ! c\n- Untitled"


def test_document_trees():
    text = lambda s: {"type": "text", "text": s}
    tree = {"type": "doc", "content": [{"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [text("a"), {"type": "hardBreak"}, text("b")]}]}]}, {"type": "rule"}, {"type": "codeBlock", "content": [text("x = 1")]}, {"type": "blockquote", "content": [{"type": "paragraph", "content": [text("q")]}]}, {"type": "unknown", "content": [text("u"), "stray"]}]}
    assert connectors.adf_text(tree) == "- a\nb\n\n---\n\n```\nx = 1\n```\n\n> q\nu"
    deep = {"type": "text", "text": "end"}
    for _ in range(5000):
        deep = {"type": "paragraph", "content": [deep]}
    assert connectors.adf_text(deep).strip() == "end"


def test_enqueue_documents(spark):
    from millrace.plans.tables import jobs as table

    queue = table(spark, "/root/testdata/sf0.001").where("id < 3").withColumn("payload", F.lit(None).cast("string"))
    known = spark.createDataFrame([(1, "acme", "s", "e1", "old", "txt", False, ["x"])], "document_id long, tenant_id string, source_id string, external_id string, title string, kind string, acl_public boolean, acl_groups array<string>")
    source = spark.createDataFrame([("s", "acme", True, ["hr"])], "source_id string, tenant_id string, default_acl_public boolean, default_acl_groups array<string>")
    fetched = spark.createDataFrame([(1, "s", "e1", "new", "txt", "body", None), (2, "s", "e2", "b", "pdf", None, bytearray(b"%"))], "document_id long, source_id string, external_id string, title string, kind string, text string, data binary")
    now = F.expr("timestamp_ntz'2024-01-20 12:00:00'")
    docs, jobs_after, blobs = connectors.enqueue_documents(known, queue, fetched, source, now, 1000)
    assert sorted((r.document_id, r.title, r.acl_public, r.acl_groups) for r in docs.collect()) == [(1, "new", False, ["x"]), (2, "b", True, ["hr"])]
    new = {r.dedupe_key: json.loads(r.payload) for r in jobs_after.where("id >= 1000").collect()}
    assert new["ingest:1"]["text"] == "body" and "text" not in new["ingest:2"] and [r.document_id for r in blobs.collect()] == [2]
    assert connectors.enqueue_documents(docs, jobs_after, fetched, source, now, 5000)[1].count() == jobs_after.count()


def test_attempts():
    a = streams.Attempts(3, 300)
    steps = [(0, False), (10, True), (20, False), (30, False), (299, False), (400, True), (598, False), (600, False), (601, True)]
    assert [a.outcome(t, ok) for t, ok in steps] == ["failed", "ok", "failed", "failed", "lockout", "locked", "locked", "failed", "ok"]


def test_login_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type in ('error', 'purchase')").selectExpr("user_id", "cast(ts as timestamp) as ts", "event_id as attempt_id", "event_type = 'purchase' as ok")
    rows.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    out: list[pd.DataFrame] = []
    stream = streams.login_outcomes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 2, 86400)
    streams.run_available(stream, str(tmp_path / "ck"), lambda df, _: out.append(df.toPandas()))
    got = {r.attempt_id: r.outcome for f in out for r in f.itertuples()}
    assert got == {r.attempt_id: r.outcome for r in streams.login_outcomes(rows, 2, 86400).collect()} and set(got.values()) >= {"ok", "failed", "lockout", "locked"}


def test_numeric_references(spark):
    texts = ["a &#65; b", "&#8212;&#128512;", "&#0;x", "&#55296;", "&#1114112;", "&#;", "&#12", "&#1234567890;", None, "", "&#39;&#39;", "x&#x41;"]
    want = ["a A b", "—😀", "\0x", "&#55296;", "&#1114112;", "&#;", "&#12", "&#1234567890;", None, "", "''", "x&#x41;"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(ingest.numeric_references(F.col("t"))).collect()] == want


def test_extracted(spark):
    d = spark.createDataFrame([("html", "<p>a</p>"), ("html", "<script>x</script>"), ("code", "a\r\n\r\n\r\n\tb "), ("code", " \n\t"), ("txt", "a  \n\n\n\nb "), ("txt", None), ("pdf", "x")], "k string, t string")
    rows = d.withColumn("e", ingest.extracted(F.col("k"), F.col("t")))
    got = [(r[0], r[1]) for r in rows.select("e", ingest.extraction_problem(F.col("k"), F.col("e"))).collect()]
    assert got[:6] == [("a", None), (None, "The HTML contained no readable text."), ("a\n\n\n\tb ", None), (None, "The file is empty."), ("a\n\nb", None), (None, "The file is empty.")] and got[6][1]


def test_embedding_batches(spark):
    def provider(texts):
        if len(texts) > 3 or "odd" in texts and len(texts) > 1:
            raise OSError("too many")
        return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(["a", "bb", "odd", "", None, "cccc", "d"])], "document_id long, ordinal int, context_text string").coalesce(1)
    got = {r.document_id: [round(x, 6) for x in r.embedding] for r in ingest.embedded(rows, provider, 2, wait=0).collect()}
    assert got == {i: [0.0, 0.0] if i in (3, 4) else [0.6, 0.8] for i in range(7)}
    with pytest.raises(Exception):
        ingest.embedded(rows, provider, 3, wait=0).collect()
    calls = []
    with pytest.raises(OSError):
        ingest._provided(["x"], lambda t: calls.append(t) or (_ for _ in ()).throw(OSError()), 4, 0)
    assert len(calls) == 4


def test_group_list(spark):
    d = spark.createDataFrame([("a, b,,",), ('["x", " y ", ""]',), ("",), (None,), ("[broken",)], "t string")
    assert [r[0] for r in d.select(ingest.group_list(F.col("t"))).collect()] == [["a", "b"], ["x", "y"], [], [], []]


def test_truth_of_short_passages(spark):
    passages = [(1, "alpha beta"), (2, "alpha"), (3, "a b c d e"), (4, None), (5, ""), (6, "lph"), (7, "x  y\nz w v")]
    documents = [(10, "an alpha beta gamma"), (11, "alpha\nbeta"), (12, "aa b c d ee"), (13, None), (14, "x  y\nz w vv"), (15, "")]
    p, d = spark.createDataFrame(passages, "question_id long, passage string"), spark.createDataFrame(documents, "label long, text string")
    want = {(q, n) for q, x in passages for n, t in documents if x is not None and t is not None and x in t}
    assert {tuple(r) for r in evaluation.passage_truth(p, d).select("question_id", "label").collect()} == want


def test_many_names_in_messages(spark):
    names = {f"U{i}": f"n{i}" for i in range(1000)} | {"x y": "$1 & co"}
    d = spark.createDataFrame([("<@U7> and <@U999|old>, <@U5000|who> <@nobody> <@x y>",), (None,), ("<@U1><@U2>",), ("plain",)], "t string")
    assert [r[0] for r in d.select(connectors.clean_message(F.col("t"), names)).collect()] == ["@n7 and @n999, @U5000 <@nobody> @$1 & co", "", "@n1@n2", "plain"]


def test_cursors_never_go_back(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    rows = spark.createDataFrame([("a", at(2)), ("a", at(5)), ("b", at(1)), ("c", None)], "source_id string, updated_at timestamp")
    stored = spark.createDataFrame([("a", at(3)), ("b", at(4)), ("d", at(9))], "source_id string, cursor timestamp")
    assert {tuple(r) for r in connectors.next_cursors(rows, stored).collect()} == {("a", at(5)), ("b", at(4)), ("c", None), ("d", at(9))}


def test_sketches_merge_and_stay_close(spark):
    from millrace.operators import rollups

    rng = random.Random(3)
    rows = [(rng.choice("ab"), dt.datetime(2024, 1, 1 + i % 2, i % 24), rng.choice([None, 0.0, -1.0]) if i % 50 == 0 else math.exp(rng.gauss(3, 2)), 0.5, "x" if i % 9 == 0 else None) for i in range(4000)]
    rows += [("c", dt.datetime(2024, 1, 1), v, 1.0, None) for v in (5.0, 1.0, 3.0)] + [("d", dt.datetime(2024, 1, 1), None, 1.0, None)]
    traces = spark.createDataFrame(rows, "tenant_id string, created_at timestamp, total_ms double, cost_usd double, error string")
    whole = rollups.latency_sketches(traces, "day")
    parts = [rollups.latency_sketches(traces.where(F.crc32(F.col("created_at").cast("string").cast("binary")) % 3 == k)) for k in range(3)]
    merged = rollups.merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    columns = ["tenant_id", "at", "bucket", "n", "low", "high", "errors"]
    assert sorted(map(repr, merged.select(columns).collect())) == sorted(map(repr, whole.select(columns).collect()))
    exact = {(r.tenant_id, r.day): r for r in rollups.query_stats_daily(traces).collect()}
    got = {(r.tenant_id, r.day): r for r in rollups.sketched_stats(merged).collect()}
    assert got.keys() == exact.keys()
    for key, r in got.items():
        assert (r.queries, r.errors) == (exact[key].queries, exact[key].errors)
        for p in ("p50_ms", "p95_ms", "p99_ms"):
            assert r[p] == exact[key][p] or abs(r[p] - exact[key][p]) <= 2.1 * rollups.ERROR * exact[key][p]
    assert got["c", dt.datetime(2024, 1, 1)].p50_ms == 3.0 and got["d", dt.datetime(2024, 1, 1)].p50_ms is None
