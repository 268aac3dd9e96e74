"""All queries of the package by name, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions.access import contains
from millrace.functions.text import bag_of_words, query_terms
from millrace.operators import buckets, chunking, context, datasets, evaluation, index, ingest, jobs as queue, listings, mentions, pipeline, rollups, search, state, vectors
from millrace.plans.tables import ADMIN, MEMBER, NOW, STRANGER, chunks, jobs, questions, shared_folder, stored_index, stored_lists, stored_vectors, table
from millrace.sources.connectors import conversation_threads, drive_files, next_cursors, repository_files, web_pages
from millrace.streaming.streams import accepted_requests, daily_documents, live_jobs, login_outcomes, skip_unchanged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 9 THEN 'other' ELSE 'acme' END AS tenant_id, source AS source_id,
    (['upload', 'web', 'github', 'slack', 'notion', 'gdrive', 'jira'])[CAST(substr(source, 4) AS INT) % 7 + 1] AS source_kind,
    source || '/' || doc_id AS title, text AS content, lang, doc_id % 3 = 0 AS acl_public,
    CASE doc_id % 4 WHEN 0 THEN ['engineering'] WHEN 1 THEN ['hr'] WHEN 2 THEN ['engineering', 'hr'] ELSE CAST([] AS VARCHAR[]) END AS acl_groups
  FROM documents)"""
_SEES = {"member": "(acl_public OR list_contains(acl_groups, 'engineering'))", "admin": "TRUE", "stranger": "acl_public"}
_PRINCIPALS = {"member": MEMBER, "admin": ADMIN, "stranger": STRANGER}
_TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- hybrid search

_TF = f"""tok AS (SELECT chunk_id, unnest({_TERMS.format('content')}) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT chunk_id, count(*) AS n_terms FROM tf GROUP BY ALL),
stats AS (SELECT tenant_id, count(*) AS n, greatest(avg(coalesce(n_terms, 0)), 1) AS avg_len FROM chunks LEFT JOIN len USING (chunk_id) GROUP BY ALL)"""


_STOP = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"


def _endings(ends: list[tuple[str, str, str]]) -> str:
    """CASE of endings, the first that fits: (ending, what takes its place, condition on the region or the letters before)."""
    return "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {c.format(n=len(e))} THEN w[1:length(w) - {len(e)}] || '{put}' ELSE w END" for e, put, c in sorted(ends, key=lambda x: -len(x[0]))) + " ELSE w END"


_R1, _R2 = "length(w) - {n} >= p1", "length(w) - {n} >= p2"
_TWO = "ational ate,tional tion,enci ence,anci ance,abli able,entli ent,izer ize,ization ize,ation ate,ator ate,alism al,aliti al,alli al,fulness ful,ousli ous,ousness ous,iveness ive,iviti ive,biliti ble,bli ble,fulli ful,lessli less"
_THREE = "ational ate,tional tion,alize al,icate ic,iciti ic,ical ic"
_STEMS = f"""st0 AS (SELECT DISTINCT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM words),
st1 AS (SELECT *, length(coalesce(nullif(regexp_extract(w, '^(gener|commun|arsen)'), ''), nullif(regexp_extract(w, '^.*?[aeiouy][^aeiouy]'), ''), w)) AS p1 FROM st0),
st2 AS (
  SELECT term, p1, p1 + length(coalesce(nullif(regexp_extract(w[p1 + 1:], '^.*?[aeiouy][^aeiouy]'), ''), w[p1 + 1:])) AS p2,
    CASE WHEN ends_with(w, 'sses') THEN w[1:length(w) - 2] WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN w[1:length(w) - 2] ELSE w[1:length(w) - 1] END
      WHEN regexp_matches(w, '[aeiouy].+s$') AND NOT regexp_matches(w, '[us]s$') THEN w[1:length(w) - 1] ELSE w END AS w FROM st1),
st3 AS (SELECT *, list_contains(['inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed'], w) AS done, regexp_replace(w, '(ed|ing)(ly)?$', '') AS b FROM st2),
st4 AS (
  SELECT term, p1, p2, done, CASE WHEN done THEN w WHEN regexp_matches(w, 'eed(ly)?$') THEN CASE WHEN length(regexp_replace(w, 'eed(ly)?$', '')) >= p1 THEN regexp_replace(w, 'eed(ly)?$', 'ee') ELSE w END
    WHEN b <> w AND regexp_matches(b, '[aeiouy]') THEN CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN b[1:length(b) - 1]
      WHEN p1 >= length(b) AND regexp_matches(b, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$') THEN b || 'e' ELSE b END
    ELSE w END AS w FROM st3),
st5 AS (SELECT term, p1, p2, done, CASE WHEN NOT done AND regexp_matches(w, '.[^aeiouy][yY]$') THEN w[1:length(w) - 1] || 'i' ELSE w END AS w FROM st4),
st6 AS (SELECT term, p1, p2, done, CASE WHEN done THEN w ELSE {_endings([(*x.split(), _R1) for x in _TWO.split(',')] + [('ogi', 'og', _R1 + " AND ends_with(w, 'logi')"), ('li', '', _R1 + " AND regexp_matches(w, '[cdeghkmnrt]li$')")])} END AS w FROM st5),
st7 AS (SELECT term, p1, p2, done, CASE WHEN done THEN w ELSE {_endings([(*x.split(), _R1) for x in _THREE.split(',')] + [('ful', '', _R1), ('ness', '', _R1), ('ative', '', _R2)])} END AS w FROM st6),
st8 AS (SELECT term, p1, p2, done, CASE WHEN done THEN w ELSE {_endings([(x, '', _R2) for x in 'al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize'.split()] + [('ion', '', _R2 + " AND regexp_matches(w, '[st]ion$')")])} END AS w FROM st7),
st9 AS (
  SELECT term, CASE WHEN NOT done AND ends_with(w, 'e') AND (length(w) - 1 >= p2 OR length(w) - 1 >= p1 AND NOT regexp_matches(w[1:length(w) - 1], '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')) THEN w[1:length(w) - 1]
    WHEN NOT done AND ends_with(w, 'll') AND length(w) - 1 >= p2 THEN w[1:length(w) - 1] ELSE w END AS w FROM st8),
irregular(term, w) AS (VALUES ('skis', 'ski'), ('skies', 'sky'), ('dying', 'die'), ('lying', 'lie'), ('tying', 'tie'), ('idly', 'idl'), ('gently', 'gentl'), ('ugly', 'ugli'), ('early', 'earli'), ('only', 'onli'), ('singly', 'singl'), ('sky', 'sky'), ('news', 'news'), ('howe', 'howe'), ('cosmos', 'cosmos'), ('bias', 'bias'), ('andes', 'andes')),
stems AS (
  SELECT s.term, CASE WHEN length(s.term) < 3 THEN s.term ELSE coalesce(i.w, replace(s.w, 'Y', 'y')) END AS stem FROM st9 s LEFT JOIN irregular i USING (term)
  WHERE NOT list_contains(string_split('{_STOP}', ' '), s.term))"""
_TF_ENGLISH = f"""raw AS (SELECT chunk_id, unnest({_TERMS.format('content')}) AS term FROM chunks),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
words AS (SELECT DISTINCT term FROM raw UNION SELECT DISTINCT term FROM asked),
{_STEMS},
tok AS (SELECT chunk_id, stem AS term FROM raw JOIN stems USING (term)),
{_TF.partition('FROM chunks),')[2].strip()}"""


def _lexical(sees: str, english: bool = False) -> str:
    q = "q AS (SELECT DISTINCT query_id, stem AS term FROM asked JOIN stems USING (term))" if english else f"q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE item_id % 20 = 0)"
    return f"""{_TF_ENGLISH if english else _TF},
{q},
seen AS (SELECT chunk_id FROM chunks WHERE tenant_id = 'acme' AND {sees}),
df AS (SELECT term, count(*) AS df FROM tf SEMI JOIN seen USING (chunk_id) GROUP BY ALL),
idf AS (SELECT query_id, term, ln(1 + ((SELECT n FROM stats WHERE tenant_id = 'acme') - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM q LEFT JOIN df USING (term)),
bm AS (
  SELECT query_id, chunk_id, sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / (SELECT avg_len FROM stats WHERE tenant_id = 'acme')))) AS score
  FROM tf JOIN idf USING (term) JOIN len USING (chunk_id) SEMI JOIN seen USING (chunk_id) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm) WHERE rank <= 60)"""


def _dense(sees: str) -> str:
    return f"""de AS (
  SELECT b.item_id AS query_id, c.chunk_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(qe.embedding AS DOUBLE[])) AS score
  FROM benchmark b JOIN embeddings qe ON qe.vec_id = b.item_id CROSS JOIN chunks c JOIN embeddings e ON e.vec_id = c.chunk_id
  WHERE b.item_id % 20 = 0 AND c.tenant_id = 'acme' AND {sees}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM de) WHERE rank <= 60)"""


def _fused(sees: str, alpha: float = 0.5) -> str:
    return f"""WITH {_CHUNKS}, {_lexical(sees)}, {_dense(sees)},
fused AS (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.score AS ds, s.score AS ss, d.rank AS dr, s.rank AS sr,
    coalesce({alpha} / (60 + d.rank), 0) + coalesce({1 - alpha} / (60 + s.rank), 0) AS fs
  FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
traced AS (SELECT *, fs / max(fs) OVER (PARTITION BY query_id) AS nm, row_number() OVER (PARTITION BY query_id ORDER BY round(fs, 9) DESC, chunk_id) AS fr FROM fused)"""


_TRACED_SQL = "SELECT query_id, chunk_id, round(coalesce(ds, 0), 6) AS dense_score, round(coalesce(ss, 0), 6) AS sparse_score, coalesce(dr, 0) AS dense_rank, coalesce(sr, 0) AS sparse_rank, round(fs, 9) AS fused, round(nm, 6) AS normalised, fr AS fused_rank FROM traced"


def _traced(spark: SparkSession, sf_dir: str, who: str, params: search.Params = search.Params()) -> DataFrame:
    return search.hybrid_search(stored_index(spark, sf_dir), questions(spark, sf_dir), _PRINCIPALS[who], params, any_term=True, vectors=chunks(spark, sf_dir, embedded=True))


def _scored(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


def _shown(traced: DataFrame) -> DataFrame:
    scores = (F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("dense_score", "sparse_score"))
    ranks = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("dense_rank", "sparse_rank"))
    return traced.select("query_id", "chunk_id", *scores, *ranks, F.round("fused", 9).alias("fused"), F.round("normalised", 6).alias("normalised"), F.col("fused_rank").cast("long").alias("fused_rank"))


@_query(f"WITH {_CHUNKS}, {_dense(_SEES['member'])} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense")
def h_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir, embedded=True).where(MEMBER.sees())
    return _scored(search.dense(rows, questions(spark, sf_dir), 60))


@_query(f"WITH {_CHUNKS}, {_dense(_SEES['member'])} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense")
def h_dense_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact answer from the stored vector index, all cells read."""
    stored = stored_vectors(spark, sf_dir)
    return _scored(search.dense_of_cells(stored, questions(spark, sf_dir), MEMBER, 60, probes=len(stored.centres)))


@_query()
def h_dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From as many cells as find 0.95 of the nearest neighbours of stored vectors."""
    stored = stored_vectors(spark, sf_dir)
    return _scored(search.dense_of_cells(stored, questions(spark, sf_dir), MEMBER, 60, probes=vectors.probes_for(stored, recall=0.95, k=60)))


@_query(f"WITH {_CHUNKS}, {_lexical(_SEES['member'])} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse")
def h_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(search.lexical(stored_index(spark, sf_dir), questions(spark, sf_dir), MEMBER, 60, any_term=True))


_REQUESTS = ((1, "the and"), (2, "que la"), (3, "der -die"), (4, '"in the" license or "de la"'))


@_query(
    f"""WITH {_CHUNKS}, {_TF},
q(query_id, term) AS (VALUES (1, 'the'), (1, 'and'), (2, 'que'), (2, 'la'), (3, 'der'), (3, 'die'), (4, 'in'), (4, 'the'), (4, 'license'), (4, 'de'), (4, 'la')),
seen AS (SELECT chunk_id, {_TERMS.format('content')} AS k FROM chunks WHERE tenant_id = 'acme' AND {_SEES['member']}),
padded AS (SELECT chunk_id, k, ' ' || array_to_string(k, ' ') || ' ' AS s FROM seen),
found AS (
  SELECT 1 AS query_id, chunk_id FROM padded WHERE list_contains(k, 'the') AND list_contains(k, 'and')
  UNION ALL SELECT 2, chunk_id FROM padded WHERE list_contains(k, 'que') AND list_contains(k, 'la')
  UNION ALL SELECT 3, chunk_id FROM padded WHERE list_contains(k, 'der') AND NOT list_contains(k, 'die')
  UNION ALL SELECT 4, chunk_id FROM padded WHERE contains(s, ' in the ') AND list_contains(k, 'license') OR contains(s, ' de la ')),
df AS (SELECT term, count(*) AS df FROM tf SEMI JOIN seen USING (chunk_id) GROUP BY ALL),
bm AS (
  SELECT query_id, chunk_id, sum(ln(1 + ((SELECT n FROM stats WHERE tenant_id = 'acme') - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / (SELECT avg_len FROM stats WHERE tenant_id = 'acme')))) AS score
  FROM found JOIN q USING (query_id) JOIN tf USING (chunk_id, term) JOIN df USING (term) JOIN len USING (chunk_id) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm) WHERE rank <= 60"""
)
def h_bm25_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(search.lexical(stored_index(spark, sf_dir), [search.Query(i, q) for i, q in _REQUESTS], MEMBER, 60))


_CLOSE = ((1, "the license"), (2, "que la"), (3, "der und"))


@_query(
    f"""WITH {_CHUNKS}, {_TF},
q(query_id, term) AS (VALUES (1, 'the'), (1, 'license'), (2, 'que'), (2, 'la'), (3, 'der'), (3, 'und')),
seen AS (SELECT chunk_id, {_TERMS.format('content')} AS k FROM chunks WHERE tenant_id = 'acme' AND {_SEES['member']}),
spots AS (SELECT chunk_id, k[i] AS term, i FROM (SELECT chunk_id, k, unnest(range(1, len(k) + 1)) AS i FROM seen) WHERE k[i] IN (SELECT term FROM q)),
near AS (SELECT query_id, chunk_id, i, term, lag(i) OVER p AS i0, lag(term) OVER p AS term0 FROM spots JOIN q USING (term) WINDOW p AS (PARTITION BY query_id, chunk_id ORDER BY i)),
density AS (SELECT query_id, chunk_id, sum(0.1::DOUBLE / (i - i0)) AS d FROM near WHERE term <> term0 GROUP BY ALL),
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9) DESC, chunk_id) AS place FROM density) WHERE place <= 10),
df AS (SELECT term, count(*) AS df FROM tf SEMI JOIN seen USING (chunk_id) GROUP BY ALL),
bm AS (
  SELECT query_id, chunk_id, sum(ln(1 + ((SELECT n FROM stats WHERE tenant_id = 'acme') - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / (SELECT avg_len FROM stats WHERE tenant_id = 'acme')))) AS score
  FROM short JOIN q USING (query_id) JOIN tf USING (chunk_id, term) JOIN df USING (term) JOIN len USING (chunk_id) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm) WHERE rank <= 2"""
)
def h_bm25_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best of the ten chunks in which the terms of a request stand closest together."""
    return _scored(search.lexical(stored_index(spark, sf_dir), [search.Query(i, q) for i, q in _CLOSE], MEMBER, 2, prefilter=search.PREFILTER))


@_query(f"WITH {_CHUNKS}, {_lexical(_SEES['member'], english=True)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse")
def h_bm25_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(search.lexical(stored_index(spark, sf_dir, english=True), questions(spark, sf_dir), MEMBER, 60, any_term=True))


@_query(f"WITH {_CHUNKS}, {_lexical(_SEES['member'], english=True)} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM tf GROUP BY ALL")
def h_index_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored English index, stem by stem."""
    return stored_index(spark, sf_dir, english=True).frequencies.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))


@_query(f"{_fused(_SEES['member'])} {_TRACED_SQL}")
def h_hybrid_acl_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_traced(spark, sf_dir, "member"))


@_query(f"{_fused(_SEES['admin'])} {_TRACED_SQL}")
def h_hybrid_acl_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_traced(spark, sf_dir, "admin"))


@_query(f"{_fused(_SEES['stranger'])} {_TRACED_SQL}")
def h_hybrid_acl_stranger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_traced(spark, sf_dir, "stranger"))


@_query(f"{_fused(_SEES['member'], 0.9)} {_TRACED_SQL}")
def h_alpha_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_traced(spark, sf_dir, "member", search.Params(alpha=0.9)))


@_query(f"{_fused(_SEES['member'])} {_TRACED_SQL} WHERE nm >= 0.25 AND fr <= 8")
def h_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.Params(min_score=0.25)
    return _shown(search.answers(_traced(spark, sf_dir, "member", p), p))


@_query(f"WITH {_CHUNKS}, {_lexical(_SEES['member'])} SELECT DISTINCT term, coalesce(df, 0) AS df, round(w, 6) AS idf FROM idf LEFT JOIN df USING (term)")
def h_idf_by_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = sorted({t for q in questions(spark, sf_dir) for t in query_terms(bag_of_words(q.text))})
    return search.idf(stored_index(spark, sf_dir), terms, MEMBER).withColumn("idf", F.round("idf", 6))


@_query(f"WITH {_CHUNKS}, {_TF} SELECT tenant_id, n AS chunk_count, round(avg_len, 6) AS avg_len FROM stats")
def h_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).stats.withColumn("avg_len", F.round("avg_len", 6))


@_query(f"WITH {_CHUNKS}, {_TF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM tf GROUP BY ALL")
def h_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index term by term; it is written by the first query of a session that needs it."""
    return stored_index(spark, sf_dir).frequencies.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))


@_query(
    f"""WITH {_CHUNKS.replace('text AS content', "CASE WHEN doc_id % 100 = 3 THEN text || ' zebra zebra' ELSE text END AS content").replace('FROM documents)', 'FROM documents WHERE doc_id % 100 <> 7)')}, {_TF}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM tf GROUP BY ALL"""
)
def h_index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index after a change of two hundredths: one segment beside the first; frequencies are sums of both."""
    rows, path = chunks(spark, sf_dir), f"{shared_folder(spark)}/millrace-index-{uuid.uuid4().hex}"
    index.write_index(rows, path)
    changed = rows.where("chunk_id % 100 = 3").withColumn("content", F.concat("content", F.lit(" zebra zebra")))
    index.update_index(path, rows.where("chunk_id % 100 in (3, 7)"), changed, batch="1")
    now = index.read_index(rows.where("chunk_id % 100 <> 7"), path)
    return now.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@_query(f"{_fused(_SEES['member'])}, t AS ({_TRACED_SQL}) SELECT query_id, chunk_id, 'dense' AS stage, dense_rank AS rank, dense_score AS score FROM t WHERE dense_rank BETWEEN 1 AND 10 UNION ALL SELECT query_id, chunk_id, 'sparse', sparse_rank, sparse_score FROM t WHERE sparse_rank BETWEEN 1 AND 10 UNION ALL SELECT query_id, chunk_id, 'fused', fused_rank, normalised FROM t WHERE fused_rank <= 8")
def h_trace_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.trace_lists(_traced(spark, sf_dir, "member")).withColumn("score", F.round("score", 6))


@_query(f"WITH {_CHUNKS}, {_lexical(_SEES['member'])} SELECT query_id, s.chunk_id, rank, c.source_id, c.title, c.lang, u.documents FROM sparse s JOIN chunks c USING (chunk_id) JOIN (SELECT source AS source_id, count(*) AS documents FROM documents GROUP BY ALL) u ON u.source_id = c.source_id")
def h_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    hits = search.lexical(stored_index(spark, sf_dir), questions(spark, sf_dir), MEMBER, 60, any_term=True)
    sources = rows.groupBy("source_id").agg(F.count("*").alias("documents"))
    found = search.enriched(hits, rows.select("chunk_id", "document_id"), rows.select("document_id", "source_id", "title", "lang"), sources)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "source_id", "title", "lang", "documents")


# ---- mentions

_NEEDLE = "License"
_MENTIONS = f"""WITH {_CHUNKS}, found AS (
  SELECT chunk_id, title, source_kind, instr(lower(content), 'license') - 1 AS match_offset,
    CAST((length(content) - length(replace(lower(content), 'license', ''))) / 7 AS INT) AS occurrences,
    regexp_replace(substr(content, greatest(1, instr(lower(content), 'license') - 120), 247), '\\s+', ' ', 'g') AS snippet
  FROM chunks WHERE tenant_id = 'acme' AND {_SEES['member']} AND contains(lower(content), 'license'))"""


@_query(f"{_MENTIONS} SELECT chunk_id, title, source_kind, match_offset, occurrences, snippet FROM found")
def m_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.find_mentions(chunks(spark, sf_dir), _NEEDLE, MEMBER.sees()).select("chunk_id", "title", "source_kind", F.col("match_offset").cast("long").alias("match_offset"), "occurrences", "snippet")


@_query(f"{_MENTIONS} SELECT source_kind, count(*) AS chunks, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM found GROUP BY ALL")
def m_mentions_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.by_source(mentions.find_mentions(chunks(spark, sf_dir), _NEEDLE, MEMBER.sees())).drop("kind_order")


@_query(f"{_MENTIONS} SELECT chunk_id, title, source_kind, match_offset, occurrences, snippet FROM found")
def m_mentions_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mentions from the chunks that hold the needle's rarest trigrams."""
    return mentions.indexed_mentions(stored_lists(spark, sf_dir), _NEEDLE, MEMBER.sees()).select("chunk_id", "title", "source_kind", F.col("match_offset").cast("long").alias("match_offset"), "occurrences", "snippet")


@_query(f"WITH {_CHUNKS} SELECT chunk_id, title FROM chunks WHERE tenant_id = 'acme' AND {_SEES['member']} AND contains(lower(title), 'rc1/1')")
def m_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.titled(stored_lists(spark, sf_dir), "RC1/1", MEMBER.sees()).select("chunk_id", "title")


# ---- predicates, aggregates, state


@_query(f"WITH {_CHUNKS} SELECT chunk_id FROM chunks JOIN labels ON doc_id = chunk_id WHERE toxic = 1 AND lang = 'en'")
def p_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
    described = rows.withColumn("metadata", F.parse_json(F.to_json(F.struct("lang", F.struct("toxic", "quality").alias("labels")))))
    return described.where(contains(F.col("metadata"), {"lang": "en", "labels": {"toxic": 1}})).select("chunk_id")


@_query(f"WITH {_CHUNKS} SELECT chunk_id FROM chunks JOIN labels ON doc_id = chunk_id WHERE toxic = 1 AND lang = 'en' AND tenant_id = 'acme' AND {_SEES['member']}")
def p_metadata_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter by lists of values at paths, before any JSON is parsed."""
    return mentions.with_metadata(stored_lists(spark, sf_dir), {"lang": "en", "labels": {"toxic": 1}}, MEMBER.sees()).select("chunk_id")


@_query(f"WITH {_CHUNKS}, wanted AS (SELECT DISTINCT source_id FROM chunks WHERE source_kind IN ('slack', 'jira')) SELECT chunk_id, source_id FROM chunks SEMI JOIN wanted USING (source_id)")
def p_source_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return rows.join(rows.where(F.col("source_kind").isin("slack", "jira")).select("source_id").distinct(), "source_id", "left_semi").select("chunk_id", "source_id")


@_query(
    """SELECT c_custkey AS user_id, 't' || c_nationkey AS tenant_id, lower(c_name) AS email, c_acctbal < 0 AS is_admin,
  coalesce(array_to_string(list_sort(list(DISTINCT lower(o_orderpriority)) FILTER (o_orderpriority IS NOT NULL)), ','), '') AS groups
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""
)
def a_principal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("tenant_id"), F.lower("c_name").alias("email"), (F.col("c_acctbal") < 0).alias("is_admin"))
    orders = table(spark, sf_dir, "orders")
    members = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("group_id"))
    groups = orders.select(F.col("o_orderpriority").alias("group_id")).distinct().withColumn("key", F.lower("group_id"))
    return state.principals(users, members, groups).withColumn("groups", F.array_join("groups", ","))


@_query(
    """SELECT 't' || (user_id % 3) AS tenant_id, date_trunc('day', ts) AS day, count(*) AS queries,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50_ms, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95_ms, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY value), 6) AS p99_ms,
  round(sum(value / 1000), 6) AS cost_usd, round(avg(value / 1000), 9) AS cost_per_query, count(*) FILTER (event_type = 'error') AS errors
FROM events GROUP BY ALL"""
)
def a_query_stats_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("ts").alias("created_at"), F.col("value").alias("total_ms"), (F.col("value") / 1000).alias("cost_usd"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return rollups.query_stats_daily(traces)


@_query(
    """WITH e AS (SELECT 't' || (user_id % 3) AS tenant_id, date_trunc('day', ts) AS day, value AS ms, event_type = 'error' AS bad, CAST(ceil(round(ln(value) / ln(1 + 0.1 / 0.95), 9)) AS BIGINT) AS bucket FROM events),
b AS (SELECT tenant_id, day, bucket, count(*) AS n, min(ms) AS low, max(ms) AS high FROM e GROUP BY ALL),
c AS (SELECT *, sum(n) OVER p - n AS before, sum(n) OVER (PARTITION BY tenant_id, day) AS total FROM b WINDOW p AS (PARTITION BY tenant_id, day ORDER BY bucket)),
r AS (SELECT *, unnest(range(n)) AS k FROM c),
v AS (SELECT tenant_id, day, total, before + k AS rank, CASE WHEN k = 0 THEN low WHEN k = n - 1 THEN high ELSE low + (high - low) * k / (n - 1) END AS ms FROM r),
q AS (
  SELECT tenant_id, day, p, max(ms) FILTER (rank = floor(p * (total - 1))) AS a, max(ms) FILTER (rank = ceil(p * (total - 1))) AS z, max(p * (total - 1)) AS place
  FROM v CROSS JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) x(p) GROUP BY ALL),
s AS (SELECT tenant_id, day, p, round(a + (z - a) * (place - floor(place)), 6) AS ms FROM q),
t AS (SELECT tenant_id, day, count(*) AS queries, round(sum(ms / 1000), 6) AS cost_usd, round(avg(ms / 1000), 9) AS cost_per_query, count(*) FILTER (bad) AS errors FROM e GROUP BY ALL)
SELECT tenant_id, day, queries, max(ms) FILTER (p = 0.5) AS p50_ms, max(ms) FILTER (p = 0.95) AS p95_ms, max(ms) FILTER (p = 0.99) AS p99_ms, cost_usd, cost_per_query, errors FROM t JOIN s USING (tenant_id, day) GROUP BY ALL"""
)
def a_query_stats_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rollup from hourly sketches of two halves."""
    traces = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("ts").alias("created_at"), F.col("value").alias("total_ms"), (F.col("value") / 1000).alias("cost_usd"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    halves = [rollups.latency_sketches(traces.where(F.col("event_id") % 2 == k), error=0.05) for k in (0, 1)]
    return rollups.sketched_stats(halves[0].unionByName(halves[1]))


_JOBS = """jobs AS (
  SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 4 < 2 THEN 'queued' WHEN event_id % 4 = 2 THEN 'running' ELSE 'succeeded' END AS status, CAST(user_id % 5 AS INT) AS priority,
    CAST(event_id % 6 AS INT) AS attempts, ts, user_id FROM events)"""
_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


@_query(f"WITH {_JOBS} SELECT kind, status, count(*) AS n, min(ts) AS oldest_runnable, max(attempts) AS max_attempts_seen, CAST(floor(epoch({_NOW}) - epoch(min(ts))) AS BIGINT) AS oldest_age_s FROM jobs GROUP BY ALL")
def a_queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.queue_health(jobs(spark, sf_dir), F.expr(NOW))


@_query(f"WITH {_CHUNKS} SELECT tenant_id, count(*) AS documents, count(*) FILTER (chunk_id % 7 > 0) AS ready, count(*) FILTER (chunk_id % 7 = 0) AS failed, count(*) AS chunks FROM chunks GROUP BY ALL")
def a_corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return rollups.corpus_counts(rows.withColumn("stage", F.when(F.col("document_id") % 7 == 0, "failed").otherwise("ready")), rows)


@_query(f"WITH {_CHUNKS} SELECT tenant_id, lang || '/' || source_id AS title, max(chunk_id) AS document_id FROM chunks GROUP BY ALL")
def w_latest_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("document_id", "tenant_id", F.concat_ws("/", "lang", "source_id").alias("title"), F.timestamp_seconds("document_id").alias("created_at"))
    return state.latest_by_title(rows).select("tenant_id", "title", "document_id")


@_query(f"WITH {_CHUNKS} SELECT tenant_id, lang || '/' || source_id AS title, count(*) AS n FROM chunks GROUP BY ALL HAVING count(*) > 1")
def a_title_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.title_collisions(chunks(spark, sf_dir).withColumn("title", F.concat_ws("/", "lang", "source_id")))


@_query(
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'old' WHEN doc_id % 3 = 1 THEN 'old' ELSE 'new' END AS stage,
  CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE md5(text || '!') END AS content_hash FROM documents"""
)
def d_upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    stored = d.where("document_id % 3 < 2").select("document_id", F.lit("old").alias("stage"), F.md5("text").alias("content_hash"))
    new = d.where("document_id % 3 > 0").select("document_id", F.lit("new").alias("stage"), F.md5(F.concat("text", F.lit("!"))).alias("content_hash"))
    return state.upsert(stored, new, ["document_id"], ["content_hash"])


@_query(f"WITH {_CHUNKS} SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN FALSE ELSE acl_public END AS acl_public, CASE WHEN chunk_id % 2 = 0 THEN 'ops' ELSE array_to_string(acl_groups, ',') END AS acl_groups FROM chunks")
def d_acl_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    changed = rows.where("document_id % 2 = 0").select("document_id", F.lit(False).alias("acl_public"), F.array(F.lit("ops")).alias("acl_groups"))
    return state.sync_chunk_access(rows, changed).select("chunk_id", "acl_public", F.array_join("acl_groups", ",").alias("acl_groups"))


@_query(
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 100 = 3 THEN md5(text || '!') ELSE md5(text) END AS content_hash FROM documents WHERE doc_id % 100 <> 7
UNION ALL SELECT -1 - doc_id, md5(text) FROM documents WHERE doc_id % 100 = 4"""
)
def d_replace_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after three changes of a hundredth each (new texts, gone, added), of which one is applied twice."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("content_hash"), "text")
    stored = buckets.write_buckets(d.select("document_id", "content_hash"), f"{shared_folder(spark)}/millrace-buckets-{uuid.uuid4().hex}")
    new = d.where("document_id % 100 = 3").select("document_id", F.md5(F.concat("text", F.lit("!"))).alias("content_hash"))
    gone = d.where("document_id % 100 = 7").select("document_id")
    added = d.where("document_id % 100 = 4").select((-1 - F.col("document_id")).alias("document_id"), "content_hash")
    for keys, rows in ((new, new), (gone, new.where("false")), (added, added), (new, new)):
        stored.replace(keys, rows)
    return stored.rows()


@_query(
    f"""WITH {_JOBS}, taken AS (SELECT id FROM jobs WHERE status = 'queued' AND ts <= {_NOW} AND kind IN ('click', 'view') ORDER BY priority, ts, id LIMIT 25)
SELECT id, CASE WHEN t.id IS NULL THEN status ELSE 'running' END AS status, CASE WHEN t.id IS NULL THEN attempts ELSE attempts + 1 END AS attempts,
  CASE WHEN t.id IS NULL THEN CASE WHEN status = 'running' THEN 'w' || (user_id % 3) END ELSE 'w9' END AS locked_by,
  CASE WHEN t.id IS NULL THEN CASE WHEN status = 'running' THEN ts + INTERVAL 5 MINUTE END ELSE {_NOW} + INTERVAL 300 SECOND END AS lease_expires_at
FROM jobs LEFT JOIN taken t USING (id)"""
)
def d_claim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim(jobs(spark, sf_dir), "w9", F.expr(NOW), batch=25, kinds=["click", "view"]).select("id", "status", "attempts", "locked_by", "lease_expires_at")


@_query(
    f"""WITH {_JOBS}, f AS (SELECT *, status = 'running' AND kind = 'error' AS hit,
  floor(least(3600, 5 * power(2, attempts)) * (0.75 + 0.5 * (CAST('0x' || substr(md5(id || '/' || attempts), 1, 8) AS BIGINT) / 4294967296.0)) * 1000) AS ms FROM jobs)
SELECT id, CASE WHEN hit THEN CASE WHEN attempts >= 5 THEN 'dead' ELSE 'queued' END ELSE status END AS status,
  CASE WHEN hit AND attempts < 5 THEN {_NOW} + to_milliseconds(CAST(ms AS BIGINT)) ELSE ts END AS run_after, CASE WHEN hit THEN 'boom' END AS last_error FROM f"""
)
def d_fail_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.fail(jobs(spark, sf_dir), F.col("kind") == "error", F.lit("boom"), F.expr(NOW)).select("id", "status", "run_after", "last_error")


@_query(f"WITH {_JOBS}, r AS (SELECT *, status = 'running' AND ts + INTERVAL 5 MINUTE < {_NOW} AS hit FROM jobs) SELECT id, CASE WHEN hit THEN 'queued' ELSE status END AS status, attempts, CASE WHEN hit THEN {_NOW} ELSE ts END AS run_after FROM r")
def d_reclaim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.reclaim(jobs(spark, sf_dir), F.expr(NOW)).select("id", "status", "attempts", "run_after")


@_query(f"WITH {_JOBS}, live AS (SELECT DISTINCT kind || '/' || user_id AS k FROM jobs WHERE status IN ('queued', 'running') AND id % 2 = 0) SELECT kind || '/' || user_id AS dedupe_key, min(id) AS id FROM jobs WHERE id % 2 = 1 AND kind || '/' || user_id NOT IN (FROM live) GROUP BY ALL")
def d_enqueue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs = jobs(spark, sf_dir)
    return queue.enqueue(all_jobs.where("id % 2 = 0"), all_jobs.where("id % 2 = 1")).where("id % 2 = 1").select("dedupe_key", "id")


# ---- ingest


@_query("SELECT doc_id, sha256(text || chr(31) || lang || chr(31)) AS content_hash FROM documents")
def i_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ingest.content_hash(F.array("text", "lang")).alias("content_hash"))


@_query("SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'full' WHEN doc_id % 5 = 1 THEN 'full' WHEN doc_id % 5 = 2 THEN 'full' WHEN doc_id % 5 = 3 THEN 'embed' ELSE 'none' END AS scope FROM documents")
def i_reindex_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("content_hash"), F.lit(1).alias("extractor_version"), F.lit(1).alias("chunker_version"), F.lit("e2").alias("embedding_version"))
    r = F.col("document_id") % 5
    stored = now.where(r > 0).select("document_id", F.when(r == 1, "x").otherwise(F.col("content_hash")).alias("content_hash"), "extractor_version", F.when(r == 2, 0).otherwise(1).alias("chunker_version"), F.when(r == 3, "e1").otherwise("e2").alias("embedding_version"))
    return ingest.reindex_scope(now, stored)


def _strip_sql() -> str:
    out = "html"
    for pattern, put, flags in ((r"<script.*?</script>", "", "gsi"), (r"<style.*?</style>", "", "gsi"), (r"<!--.*?-->", "", "gs"), *((rf"<h{n}[^>]*>", "\n\n" + "#" * n + " ", "gi") for n in range(1, 7)), (r"</(p|div|section|article|li|tr|h[1-6])>", "\n\n", "gi"), (r"<br\s*/?>", "\n", "gi"), (r"<[^>]+>", "", "g")):
        out = f"regexp_replace({out}, '{pattern}', '{put}', '{flags}')"
    for old, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{old}', '{put}')"
    out = f"replace(replace(replace({out}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ')"
    out = f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g')"
    return f"SELECT page_id, regexp_replace({out}, '^\\s+|\\s+$', '', 'g') AS text FROM pages"


@_query(_strip_sql())
def i_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ingest.strip_html(F.col("html")).alias("text"))


@_query("SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS tokens FROM documents")
def i_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ingest.token_estimate(F.col("text")).alias("tokens"))


@_query()
def i_chunk_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return chunking.chunk_documents(d.select(F.col("doc_id").alias("document_id"), F.lit("txt").alias("kind"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("path"), F.array("text").alias("pages")))


@_query()
def i_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    texts = web_pages(p.select("url", "html")).select("external_id", "title", "text")
    return chunking.chunk_documents(texts.select(F.xxhash64("external_id").alias("document_id"), F.lit("html").alias("kind"), "title", F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("path"), F.array("text").alias("pages")))


@_query()
def i_chunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conversation_threads(table(spark, sf_dir, "conversations"))
    return chunking.chunk_documents(t.select(F.col("conv_id").alias("document_id"), F.lit("conversation").alias("kind"), F.lit("chat").alias("title"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("path"), F.array("text").alias("pages")))


def _clean_sql(c: str) -> str:
    for pattern, put in ((r"<@([A-Z0-9]+)(\|[^>]*)?>", r"@\1"), (r"<#[A-Z0-9]+\|([^>]+)>", r"#\1"), (r"<#([A-Z0-9]+)\|?>", r"#\1"), (r"<(?:https?:|mailto:)[^|>]+\|([^>]+)>", r"\1"), (r"<((?:https?:|mailto:)[^|>]+)>", r"\1")):
        c = f"regexp_replace({c}, '{pattern}', '{put}', 'g')"
    return f"trim(regexp_replace(replace(replace(replace({c}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"


@_query(
    f"""WITH m AS (SELECT conv_id, turn, role || ': ' || {_clean_sql('text')} AS line, {_clean_sql('text')} AS clean FROM conversations WHERE length(trim(text)) >= 3),
t AS (SELECT conv_id, count(*) AS message_count, string_agg(line, chr(10) ORDER BY turn, line, clean) AS body, first(clean ORDER BY turn, line, clean) AS c FROM m GROUP BY ALL HAVING count(*) >= 2)
SELECT conv_id, message_count, md5('# ' || CASE WHEN c = '' THEN 'thread' WHEN length(c) <= 70 THEN c ELSE rtrim(substr(c, 1, 69)) || '…' END || chr(10) || body) AS text_md5 FROM t"""
)
def c_conversation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_threads(table(spark, sf_dir, "conversations")).select("conv_id", F.col("message_count").cast("long").alias("message_count"), F.md5("text").alias("text_md5"))


@_query(
    f"""WITH s AS ({_strip_sql()}), t AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS t FROM pages)
SELECT url AS external_id, CASE WHEN t = '' THEN url ELSE t END AS title, md5(text) AS text_md5 FROM t JOIN s USING (page_id)"""
)
def c_web_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_pages(table(spark, sf_dir, "pages")).select("external_id", "title", F.md5("text").alias("text_md5"))


@_query("SELECT doc_id, sha256(text) AS text_hash, doc_id % 5 < 4 AS needs_reindex FROM documents")
def i_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = i_reindex_scope(spark, sf_dir).select(F.col("document_id").alias("doc_id"), ingest.needs_reindex(F.col("scope")).alias("needs_reindex"))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.text_hash(F.col("text")).alias("text_hash")).join(scopes, "doc_id")


_EXTENSIONS = "['md', 'markdown', 'txt', 'text', 'html', 'py', 'cc', 'cjs', 'sh', 'bin', 'PDF']"


@_query(
    f"""WITH f AS (SELECT doc_id, ({_EXTENSIONS})[CAST(doc_id % 11 AS INT) + 1] AS e FROM documents)
SELECT doc_id, CASE WHEN e IN ('md', 'markdown') THEN 'md' WHEN e IN ('txt', 'text') THEN 'txt' WHEN e = 'html' THEN 'html' WHEN e IN ('py', 'cc', 'cjs', 'sh') THEN 'code' WHEN e = 'PDF' THEN 'pdf' ELSE 'none' END AS kind,
  CASE e WHEN 'py' THEN 'python' WHEN 'cc' THEN 'cpp' WHEN 'cjs' THEN 'javascript' WHEN 'sh' THEN 'shell' ELSE 'none' END AS language FROM f"""
)
def i_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("a.b/f"), F.col("doc_id").cast("string"), F.lit("."), F.get(F.array(*map(F.lit, "md markdown txt text html py cc cjs sh bin PDF".split())), (F.col("doc_id") % 11).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(ingest.kind_of(path), F.lit("none")).alias("kind"), F.coalesce(ingest.language_of(path), F.lit("none")).alias("language"))


_TIDY = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^[\s\x0b\x1c-\x1f\x85]+|[\s\x0b\x1c-\x1f\x85]+$', '', 'g')"
# white space that strip() takes off a block of prose; a block that is a heading alone is no text
_BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@_query(
    rf"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 THEN replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) ELSE {_TIDY.format('text')} END AS body FROM documents),
t AS (SELECT doc_id, CASE WHEN body IS NULL OR doc_id % 2 = 0 AND regexp_full_match(body, '[ \t\n\f\x0b]*') THEN '' ELSE body END AS body FROM b),
k AS (SELECT doc_id, unnest(regexp_split_to_array(body, '\n{{2,}}')) AS block FROM t WHERE doc_id % 2 = 1),
l AS (SELECT doc_id, regexp_replace(block, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS block FROM k),
h AS (SELECT doc_id, block, regexp_replace(split_part(block, chr(10), 1), '[{_BLANK}]+$', '') AS line FROM l WHERE block <> ''),
p AS (SELECT DISTINCT doc_id FROM h WHERE CASE WHEN regexp_full_match(line, '#{{1,6}}[{_BLANK}]+[^\n]+') THEN contains(block, chr(10)) ELSE contains(block, chr(10)) OR NOT regexp_full_match(line, '((\p{{Nd}}+\.){{1,3}}\p{{Nd}}*|[IVX]+\.)[{_BLANK}]+[^{_BLANK}][^\n]{{0,78}}') END
  UNION SELECT doc_id FROM t WHERE doc_id % 2 = 0 AND regexp_matches(body, '[^{_BLANK}]')),
r AS (SELECT doc_id, body, CASE WHEN body = '' THEN 'The file is empty.' WHEN doc_id % 3 < 2 AND p.doc_id IS NULL THEN 'Extraction produced no chunks' END AS error FROM t LEFT JOIN p USING (doc_id))
SELECT doc_id AS document_id, CASE WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS stage, CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END AS progress, error,
  CASE WHEN error IS NOT NULL THEN CASE WHEN doc_id % 3 = 1 THEN 'x' WHEN doc_id % 3 = 2 THEN sha256(body || chr(31)) END ELSE sha256(body || chr(31)) END AS content_hash, error IS NULL AS has_chunks,
  CASE WHEN error IS NOT NULL THEN CASE WHEN doc_id % 3 > 0 THEN 'e1' END ELSE 'e2' END AS embedding_version
FROM r"""
)
def i_ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked for again: a third is new, a third has changed, a third has another embedding version; a seventh is empty.

    A text that is headings alone gives no chunks, so its document has failed
    unless it only asks for vectors.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 2 == 0, "code").otherwise("txt").alias("kind"))
    requests = d.withColumns({"tenant_id": F.lit("acme"), "title": F.lit("t"), "path": F.lit("f.txt"), "acl_public": F.lit(True), "acl_groups": F.array().cast("array<string>")})
    third, known = F.col("document_id") % 3, ingest.content_hash(F.array(F.coalesce(ingest.extracted(F.col("kind"), F.col("text")), F.lit(""))))
    stored = d.select(
        "document_id", F.lit("ready").alias("stage"), F.lit(1.0).alias("progress"), F.lit(None).cast("string").alias("error"), F.when(third == 1, "x").when(third == 2, known).alias("content_hash"),
        F.lit(1).alias("extractor_version"), F.lit(1).alias("chunker_version"), F.when(third > 0, "e1").alias("embedding_version"), F.lit(None).cast("long").alias("chunk_count"), F.lit(None).cast("long").alias("token_count"),
    )
    old = d.where("document_id % 3 = 2").select("document_id", F.lit(0).alias("ordinal"), F.lit("t").alias("heading"), F.lit("c").alias("content"), F.lit("t c").alias("context_text"), F.lit(1).cast("long").alias("token_count"), F.array(F.lit(0.0)).alias("embedding"), F.lit("e1").alias("embedding_version"))
    embed = lambda rows: rows.select("document_id", "ordinal", F.array(F.length("context_text").cast("double")).alias("embedding"))
    documents, after = pipeline.ingest_batch(requests, stored, old, pipeline.Versions(1, 1, "e2"), embed, F.expr(NOW))
    counts = after.where("embedding_version = 'e2'").groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.join(counts, "document_id", "left").select("document_id", "stage", "progress", "error", "content_hash", (F.coalesce("n", F.lit(0)) > 0).alias("has_chunks"), "embedding_version")


@_query(
    """WITH m AS (SELECT conv_id, turn, replace(role || ': ' || text, chr(10), ' ') AS line FROM conversations WHERE length(trim(text)) > 0), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS k FROM m),
r AS (WITH RECURSIVE g AS (
  SELECT conv_id, k, 0 AS run, length(line) + 1 AS held, 1 AS n FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.k, CASE WHEN held + length(line) > 1400 THEN run + 1 ELSE run END, CASE WHEN held + length(line) > 1400 THEN 0 ELSE held END + length(line) + 1, 1 FROM g JOIN o ON o.conv_id = g.conv_id AND o.k = g.k + 1) SELECT * FROM g)
SELECT conv_id AS document_id, CAST(run AS INT) AS ordinal, md5(string_agg(line, chr(10) ORDER BY r.k)) AS content_md5, count(*) AS messages FROM r JOIN o USING (conv_id, k) GROUP BY ALL"""
)
def i_chunk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("length(trim(text)) > 0").select("conv_id", F.struct("turn", F.regexp_replace(F.concat("role", F.lit(": "), "text"), "\n", " ").alias("line")).alias("m"))
    t = t.groupBy("conv_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"])).alias("text"))
    none = F.lit(None).cast("string")
    rows = chunking.chunk_documents(t.select(F.col("conv_id").alias("document_id"), F.lit("conversation").alias("kind"), F.lit("chat").alias("title"), none.alias("language"), none.alias("path"), F.array("text").alias("pages")))
    return rows.select("document_id", "ordinal", F.md5("content").alias("content_md5"), F.get_json_object("metadata", "$.message_count").cast("long").alias("messages"))


@_query(
    """SELECT page_id AS external_id, CASE WHEN page_id % 3 = 0 THEN 'too large to download' END AS problem, CASE page_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'html' WHEN 2 THEN 'code' ELSE 'pdf' END AS kind, CASE WHEN page_id % 3 > 0 AND page_id % 5 < 3 THEN md5(html) END AS text_md5
FROM pages WHERE page_id % 5 < 4 AND page_id % 11 > 0"""
)
def c_drive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    mime = F.when(k == 0, "text/plain").when(k == 1, "text/html").when(k == 2, "application/x-python").when(k == 3, "application/pdf").otherwise("image/png")
    files = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.when(k == 2, "a.py").otherwise("a.bin").alias("name"), mime.alias("mime_type"), F.when(F.col("page_id") % 3 == 0, 30 << 20).otherwise(100).alias("size"), F.timestamp_seconds("page_id").alias("modified_at"),
        (F.col("page_id") % 11 == 0).alias("trashed"), F.array(F.lit("f")).alias("parents"), F.lit("o").alias("owner"), F.col("url").alias("link"), F.col("html").cast("binary").alias("data"),
    )
    return drive_files(files, None, "f").select("external_id", "problem", "kind", F.md5("text").alias("text_md5"))


# ---- documents, jobs and users


@_query("SELECT doc_id AS document_id, CASE doc_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' ELSE 'chunking' END AS stage, CASE doc_id % 3 WHEN 1 THEN 'bad' WHEN 2 THEN 'old' END AS error, CASE doc_id % 3 WHEN 2 THEN 0.5 ELSE 0.15 END AS progress, doc_id % 3 = 0 AS indexed, doc_id % 3 < 2 AS touched FROM documents")
def d_set_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("chunking").alias("stage"), F.lit("old").alias("error"), F.lit(0.5).alias("progress"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    k = F.col("document_id") % 3
    changes = d.where(k < 2).select("document_id", F.when(k == 0, "ready").otherwise("failed").alias("stage"), F.when(k == 1, "bad").alias("error"), F.lit(0.15).alias("progress"))
    after = state.set_stage(d, changes, F.expr(NOW))
    return after.select("document_id", "stage", "error", "progress", F.col("indexed_at").isNotNull().alias("indexed"), F.col("updated_at").isNotNull().alias("touched"))


@_query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 OR doc_id % 4 = 3 THEN TIMESTAMP '2024-01-20 12:00:00' ELSE TIMESTAMP '2020-01-01' END AS updated_at FROM documents")
def d_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 1, "new").otherwise(F.col("lang")).alias("lang"), F.expr("timestamp_ntz'2020-01-01'").alias("updated_at"))
    before = table(spark, sf_dir, "documents").where("doc_id % 4 <> 3").select("doc_id", "lang", F.expr("timestamp_ntz'2020-01-01'").alias("updated_at"))
    return state.touched(before, after, "doc_id", F.expr(NOW)).select("doc_id", "updated_at")


@_query("SELECT s_suppkey AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'error' ELSE 'syncing' END AS status, CASE s_suppkey % 3 WHEN 1 THEN 'no' END AS last_error, s_suppkey % 3 = 0 AS synced FROM supplier")
def d_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.lit("syncing").alias("status"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp_ntz").alias("last_sync_at"))
    k = F.col("source_id") % 3
    after = state.set_source_status(s, s.where(k < 2).select("source_id", F.when(k == 0, "idle").otherwise("error").alias("status"), F.when(k == 1, "no").alias("error")), F.expr(NOW))
    return after.select("source_id", "status", "last_error", F.col("last_sync_at").isNotNull().alias("synced"))


@_query("SELECT 't' || (c_nationkey % 2) AS tenant_id, lower(c_name) AS email, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS name FROM customer")
def d_upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("tenant_id", F.concat(F.lit("t"), (F.col("c_nationkey") % 2).cast("string")))
    users = c.where("c_custkey % 3 > 0").select("tenant_id", F.col("c_name").alias("email"), F.col("c_mktsegment").alias("name"))
    new = c.where("c_custkey % 2 = 0 or c_custkey % 3 = 0 or c_custkey % 5 = 0").select("tenant_id", F.upper("c_name").alias("email"), F.when((F.col("c_custkey") % 2 == 0) | (F.col("c_custkey") % 3 == 0), "new").alias("name"))
    return state.upsert_users(users, new).select("tenant_id", "email", "name")


@_query("SELECT c_custkey AS user_id FROM customer WHERE lower(c_name) = 'customer#000000007'")
def p_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return state.by_email(users, "CUSTOMER#000000007").select("user_id")


@_query("SELECT doc_id AS question_id FROM documents WHERE lang = 'de' OR source IN ('src1', 'src2')")
def p_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.array("lang", "source").alias("tags"))
    return evaluation.tagged(q, ["de", "src1", "src2"]).select("question_id")


@_query(f"WITH {_JOBS}, live AS (SELECT id FROM jobs WHERE status IN ('queued', 'running')), low AS (SELECT event_id AS id FROM events WHERE value / 100 < 0.8) SELECT 'live' AS of, count(*) AS n FROM live UNION ALL SELECT 'low' AS of, count(*) AS n FROM low")
def p_partial_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = table(spark, sf_dir, "events").withColumn("groundedness", F.col("value") / 100)
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("of"), "n")
    return count(queue.live(jobs(spark, sf_dir)), "live").unionByName(count(rollups.low_groundedness(traces), "low"))


@_query(f"WITH {_JOBS} SELECT count(*) AS n FROM jobs WHERE status = 'running' AND ts + INTERVAL 5 MINUTE < {_NOW}")
def a_reclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = jobs(spark, sf_dir)
    return queue.changed(before, queue.reclaim(before, F.expr(NOW)))


@_query("SELECT event_type AS model, count(*) AS calls, CAST(sum(user_id * 10) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS cached_tokens, CAST(sum(user_id * 3) AS BIGINT) AS output_tokens, round(sum(value), 6) AS cost_usd FROM events GROUP BY ALL")
def a_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("user_id") * 10).alias("input_tokens"), F.col("user_id").alias("cached_tokens"), (F.col("user_id") * 3).alias("output_tokens"), F.col("value").alias("cost_usd"))
    return rollups.usage(calls, "model")


@_query(
    """SELECT source AS source_id, max(CASE WHEN doc_id % 3 > 0 OR source = 'src3' THEN TIMESTAMP '2024-01-01' + to_seconds(CASE WHEN doc_id % 3 > 0 THEN doc_id ELSE 10 * doc_id END) END) AS cursor
FROM documents WHERE source <> 'src5' OR doc_id % 3 > 0 GROUP BY ALL"""
)
def a_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors after a read of two thirds of the documents; one source's cursor is ahead of them."""
    at = lambda n: F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, {n})")
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "source_id")
    fetched = d.where("doc_id % 3 > 0").select("source_id", at("doc_id").alias("updated_at"))
    stored = d.where("doc_id % 3 = 0 and source_id <> 'src5'").groupBy("source_id").agg(F.max(F.when(F.col("source_id") == "src3", at("10 * doc_id"))).alias("cursor"))
    return next_cursors(fetched, stored)


@_query("WITH e AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY first, role) AS roles FROM e GROUP BY ALL")
def a_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("role")).alias("roles"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "roles"))).alias("turns"))
    return lists.select("conv_id", F.array_join(evaluation.flat_distinct(F.col("turns.roles")), ",").alias("roles"))


@_query("SELECT o_orderkey AS run_id, o_custkey AS dataset_id, c_name AS dataset, round(CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 7 END, 6) AS ndcg, CAST(o_orderkey AS DOUBLE) AS p95_ms, CAST(NULL AS DOUBLE) AS mrr FROM orders JOIN customer ON c_custkey = o_custkey")
def e_run_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = F.to_json(F.struct(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice") / 7).alias("ndcg"), F.col("o_orderkey").cast("double").alias("p95_ms"), F.lit("no number").alias("mrr")))
    none = F.lit(None).cast("string")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset_id"), none.alias("label"), none.alias("git_sha"), none.alias("status"), F.lit(1).alias("question_count"), metrics.alias("metrics"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"))
    datasets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("name"))
    return evaluation.run_view(runs, datasets).select("run_id", "dataset_id", "dataset", F.round("ndcg", 6).alias("ndcg"), "p95_ms", "mrr")


# ---- evaluation

_RANKED = """truth AS (SELECT item_id AS question_id, doc_id AS label FROM benchmark JOIN documents d ON contains(d.text, benchmark.text)),
ranked AS (SELECT * FROM (SELECT question_id, label, row_number() OVER (PARTITION BY question_id ORDER BY (label * 7919 + question_id) % 10007, label) AS rank FROM truth) WHERE (question_id + rank) % 3 > 0),
firsts AS (SELECT question_id, label, row_number() OVER (PARTITION BY question_id ORDER BY rank, label) AS rank FROM ranked)"""
_METRICS = f"""{_RANKED},
m AS (
  SELECT q.item_id AS question_id, t.n IS NOT NULL AS labelled, least(coalesce(r.n, 0), 3) AS got, t.n AS n, coalesce(h.hits, 0) AS hits, h.best, h.gain
  FROM benchmark q LEFT JOIN (SELECT question_id, count(*) AS n FROM truth GROUP BY ALL) t ON t.question_id = q.item_id
  LEFT JOIN (SELECT question_id, count(*) AS n FROM firsts GROUP BY ALL) r ON r.question_id = q.item_id
  LEFT JOIN (SELECT question_id, count(*) FILTER (rank <= 3) AS hits, min(rank) AS best, sum(1 / log2(rank + 1)) FILTER (rank <= 3) AS gain FROM firsts JOIN truth USING (question_id, label) GROUP BY ALL) h ON h.question_id = q.item_id),
metrics AS (
  SELECT question_id, labelled, CASE WHEN labelled THEN hits / n END AS recall, CASE WHEN labelled THEN CASE WHEN got > 0 THEN hits / got ELSE 0 END END AS precision,
    CASE WHEN labelled THEN coalesce(1 / best, 0) END AS reciprocal_rank,
    CASE WHEN labelled THEN coalesce(gain, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 3) + 1) x(i)) END AS ndcg, CASE WHEN labelled THEN hits > 0 END AS hit FROM m)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at 3 of a made-up ranking of the documents that hold each benchmark passage."""
    items, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    truth = evaluation.passage_truth(items.select(F.col("item_id").alias("question_id"), F.col("text").alias("passage")), d.select(F.col("doc_id").alias("label"), "text"))
    order = Window.partitionBy("question_id").orderBy((F.col("label") * 7919 + F.col("question_id")) % 10007, "label")
    ranked = truth.withColumn("rank", F.row_number().over(order)).where("(question_id + rank) % 3 > 0")
    return evaluation.question_metrics(items.select(F.col("item_id").alias("question_id")), ranked, truth, 3)


_ROUNDED = ("recall", "precision", "reciprocal_rank", "ndcg")


@_query(f"WITH {_METRICS} SELECT question_id, labelled, coalesce(hit, FALSE) AS hit, {', '.join(f'round(coalesce({m}, -1), 6) AS {m}' for m in _ROUNDED)} FROM metrics")
def e_question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("question_id", "labelled", F.coalesce("hit", F.lit(False)).alias("hit"), *(F.round(F.coalesce(m, F.lit(-1.0)), 6).alias(m) for m in _ROUNDED))


@_query(
    f"""WITH {_METRICS} SELECT 'run' AS run_id, count(*) AS questions, count(*) FILTER (labelled) AS labelled, {', '.join(f'round(avg({m}), 6) AS mean_{m}' for m in _ROUNDED)},
  round(avg(CASE WHEN question_id % 2 = 0 THEN (question_id % 10) / 10 END), 6) AS mean_citation_accuracy, round(avg((question_id % 4) / 4), 6) AS mean_faithfulness,
  round(avg(CASE WHEN question_id % 3 = 0 THEN CAST(question_id % 2 = 0 AS INT) END), 6) AS must_include_rate, round(avg(CAST(question_id % 5 > 0 AS INT)), 6) AS must_not_include_rate, CAST(NULL AS DOUBLE) AS abstention_accuracy,
  round(sum(question_id / 1000), 6) AS total_cost_usd, round(avg(question_id / 1000), 6) AS cost_per_query,
  round(avg(CASE WHEN labelled THEN CAST(hit AS INT) END), 6) AS hit_rate, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(question_id AS DOUBLE)) AS p50_ms, percentile_disc(0.95) WITHIN GROUP (ORDER BY CAST(question_id AS DOUBLE)) AS p95_ms, count(*) FILTER (question_id % 7 = 0) AS errors FROM metrics"""
)
def e_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluated(spark, sf_dir).withColumns({"run_id": F.lit("run"), "latency_ms": F.col("question_id").cast("double"), "cost_usd": F.col("question_id") / 1000, "citation_accuracy": F.when(F.col("question_id") % 2 == 0, F.col("question_id") % 10 / 10).otherwise(float("nan")), "faithfulness": F.col("question_id") % 4 / 4, "includes_ok": F.when(F.col("question_id") % 3 == 0, F.col("question_id") % 2 == 0), "excludes_ok": F.col("question_id") % 5 > 0, "error": F.when(F.col("question_id") % 7 == 0, "failed")})
    return evaluation.summary(rows)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("question_id"), "event_type", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("score"))
    before = e.where("question_id % 2 = 0").select((F.col("question_id") / 2).cast("long").alias("question_id"), "score")
    after = e.where("question_id % 2 = 1").select(((F.col("question_id") - 1) / 2).cast("long").alias("question_id"), "score")
    return evaluation.paired(before, after, "score")


_PAIRS = "pairs AS (SELECT b.event_id // 2 AS question_id, b.value AS before, a.value AS after, a.value - b.value AS delta FROM events b JOIN events a ON a.event_id = b.event_id + 1 WHERE b.event_id % 2 = 0 AND b.event_type <> 'error' AND a.event_type <> 'error')"


@_query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(before), 6) AS mean_before, round(avg(after), 6) AS mean_after, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < 0) AS regressed, count(*) FILTER (delta = 0) AS unchanged FROM pairs")
def e_pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.comparison(_runs(spark, sf_dir))


@_query(f"WITH {_PAIRS} (SELECT question_id, round(delta, 6) AS delta, 'gain' AS side FROM pairs WHERE delta > 0 ORDER BY pairs.delta DESC, question_id LIMIT 3) UNION ALL (SELECT question_id, round(delta, 6) AS delta, 'loss' AS side FROM pairs WHERE delta < 0 ORDER BY pairs.delta, question_id LIMIT 3)")
def e_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.extremes(_runs(spark, sf_dir)).select("question_id", F.round("delta", 6).alias("delta"), "side")


@_query()
def e_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 100 questions each, 10,000 resamples."""
    pairs = _runs(spark, sf_dir).withColumn("metric", F.concat(F.lit("m"), F.floor(F.col("question_id") / 100).cast("string")))
    return evaluation.bootstrap(pairs)


@_query(
    r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(a, '\[([0-9]{1,2})\]', 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1 AND 8))), ',') AS markers
FROM (SELECT conv_id, turn, text || ' [' || (conv_id % 12) || '] [3][' || turn || '] [3]' AS a FROM conversations)"""
)
def e_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat("text", F.lit(" ["), (F.col("conv_id") % 12).cast("string"), F.lit("] [3]["), F.col("turn").cast("string"), F.lit("] [3]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(context.citations(answer, F.lit(8)), ",").alias("markers"))


@_query(
    """SELECT event_id, round((greatest(0, user_id * 10 - user_id) * r.i + user_id * r.i * 0.1 + user_id * 3 * r.o) / 1e6, 9) AS cost_usd, r.i IS NULL AS unknown_model
FROM events LEFT JOIN (VALUES ('click', 5.0, 25.0), ('view', 0.3, 2.5), ('purchase', 1.0, 5.0)) r(model, i, o) ON r.model = event_type"""
)
def e_llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.sql("select * from values ('click', 5.0D, 25.0D), ('view', 0.3D, 2.5D), ('purchase', 1.0D, 5.0D) as t(model, input_rate, output_rate)")
    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("user_id") * 10).alias("input_tokens"), F.col("user_id").alias("cached_tokens"), (F.col("user_id") * 3).alias("output_tokens"))
    return context.cost(calls, prices).select("event_id", F.round("cost_usd", 9).alias("cost_usd"), "unknown_model")


@_query(
    """WITH e AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS marker, lang, text FROM documents),
u AS (SELECT *, sum(length('[' || marker || '] ' || lang || chr(10) || text)) OVER (PARTITION BY query_id ORDER BY marker) AS used_chars FROM e)
SELECT query_id, marker, CAST(used_chars AS BIGINT) AS used_chars FROM u WHERE used_chars <= 60000 OR marker = 1"""
)
def w_context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("lang").alias("source"), F.col("text").alias("content"))
    return context.pack_context(hits).select("query_id", F.col("marker").cast("long").alias("marker"), "used_chars")


# ---- streams (as batches of the same functions)


@_query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def t_daily_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_documents(table(spark, sf_dir, "events"))


@_query("SELECT DISTINCT event_type, user_id FROM events")
def t_live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_jobs(table(spark, sf_dir, "events"), ["event_type", "user_id"]).select("event_type", "user_id")


@_query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_key, ts, event_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'ask' END AS what FROM events),
o AS (SELECT *, lag(what) OVER k AS was, lag(ts) OVER k AS asked_at FROM e WINDOW k AS (PARTITION BY job_key ORDER BY ts, event_id))
SELECT job_key, event_id FROM o WHERE what = 'ask' AND (was IS NULL OR was = 'done' OR epoch_ms(ts) - epoch_ms(asked_at) > 86400000)"""
)
def t_accepted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of a user asks for a job of theirs, but for a purchase, which ends it."""
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_key"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("ask").alias("what"))
    return accepted_requests(asked, 86_400).select("job_key", "event_id")


@_query(
    """WITH RECURSIVE a AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS ok, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('error', 'purchase')),
r AS (
  SELECT user_id, 0::BIGINT AS k, 0 AS hits, 0.0::DOUBLE AS until, NULL::BIGINT AS attempt_id, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL
  SELECT user_id, k, CASE WHEN locked THEN hits WHEN ok THEN 0 ELSE n + 1 END, CASE WHEN locked THEN until WHEN NOT ok AND n + 1 >= 3 THEN sec + 86400 ELSE 0 END, event_id,
    CASE WHEN locked THEN 'locked' WHEN ok THEN 'ok' WHEN n + 1 >= 3 THEN 'lockout' ELSE 'failed' END
  FROM (SELECT a.user_id, a.k, a.ok, a.sec, a.event_id, r.hits, r.until, r.until > a.sec AS locked, CASE WHEN r.until > 0 THEN 0 ELSE r.hits END AS n FROM r JOIN a ON a.user_id = r.user_id AND a.k = r.k + 1))
SELECT user_id, attempt_id, outcome FROM r WHERE k > 0"""
)
def t_lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select("user_id", "ts", F.col("event_id").alias("attempt_id"), (F.col("event_type") == "purchase").alias("ok"))
    return login_outcomes(attempts, failures=3, seconds=86400).select("user_id", "attempt_id", "outcome")


@_query("SELECT doc_id AS document_id FROM documents WHERE doc_id % 3 > 0 OR text IS NULL")
def t_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    stored = d.where("document_id % 3 = 0").select("document_id", ingest.content_hash(F.array("text")).alias("content_hash"))
    return skip_unchanged(d, stored).select("document_id")


# ---- listings, datasets, connectors and answers


@_query("SELECT o_orderkey AS document_id, c_name AS source_name, c_mktsegment AS source_kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def j_documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 of a tenant (a status), from one source's kind; customers are the sources."""
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("tenant_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("created_at"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"))
    return listings.documents_of(rows, sources, "F").select("document_id", "source_name", "source_kind")


@_query(
    """WITH a AS (SELECT n_name AS tenant_slug, lower(c_name) AS email, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING')
SELECT tenant_slug, email FROM a WHERE k = 1"""
)
def j_first_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("tenant_id"), F.lower("c_name").alias("email"), (F.col("c_mktsegment") == "BUILDING").alias("is_admin"), F.col("c_acctbal").alias("created_at"))
    tenants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("slug"), F.col("n_comment" if "n_comment" in table(spark, sf_dir, "nation").columns else "n_name").alias("name"))
    return listings.first_admins(users, tenants)


@_query(
    """WITH e AS (SELECT conv_id AS question_id, role || '/' || (conv_id % 40) AS title FROM conversations GROUP BY ALL), d AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'user' ELSE 'assistant' END || '/' || (doc_id % 37) AS title FROM documents),
n AS (SELECT title, max(doc_id) AS document_id FROM d GROUP BY ALL)
SELECT question_id, document_id FROM e JOIN n USING (title)"""
)
def j_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of expected documents as the newest document of each."""
    expected = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.concat_ws("/", "role", (F.col("conv_id") % 40).cast("string")).alias("title")).distinct()
    title = F.concat_ws("/", F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant"), (F.col("doc_id") % 37).cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.lit("t").alias("tenant_id"), title.alias("title"), F.col("doc_id").alias("document_id"), F.timestamp_seconds("doc_id").alias("created_at"))
    return datasets.resolve_titles(expected, rows)[0]


@_query("SELECT 1000000 + doc_id AS id, 'reindex/' || doc_id AS dedupe_key, CAST(500 AS INT) AS priority FROM documents WHERE lang <> 'en'")
def d_reindex_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of another embedding version (here: language) ask for work once each."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("embedding_version"))
    return queue.reindex_jobs(rows.unionByName(rows), "en", 1_000_000, F.expr(NOW)).select("id", "dedupe_key", "priority")


@_query(
    """WITH f AS (SELECT doc_id, source || '/' || CASE doc_id % 6 WHEN 0 THEN 'node_modules/a.js' WHEN 1 THEN 'a.min.js' WHEN 2 THEN 'b.py' WHEN 3 THEN 'c.md' WHEN 4 THEN 'yarn.lock' ELSE 'd.go' END AS path, text FROM documents)
SELECT doc_id || '/' || path AS external_id, CASE doc_id % 6 WHEN 3 THEN 'md' ELSE 'code' END AS kind, md5(text) AS text_md5 FROM f WHERE doc_id % 6 IN (2, 3, 5) AND doc_id % 4 > 0 AND strlen(text) <= 400000"""
)
def c_repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of repositories that a comparison of two commits names, without built and vendored ones."""
    name = F.element_at(F.array(*map(F.lit, ("node_modules/a.js", "a.min.js", "b.py", "c.md", "yarn.lock", "d.go"))), (F.col("doc_id") % 6 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), "source", name).alias("path"), F.octet_length("text").alias("size"), F.col("text").alias("content"))
    return repository_files(files.drop("doc_id"), files.where("doc_id % 4 > 0").select("path")).select("external_id", "kind", F.md5("text").alias("text_md5"))


@_query(
    """WITH a AS (SELECT doc_id, [doc_id % 7, doc_id % 5, 9] AS cited, [doc_id % 5, 1, 2] AS retrieved, CASE WHEN doc_id % 3 = 0 THEN [CAST(9 AS BIGINT)] ELSE [] END AS relevant FROM documents)
SELECT doc_id, round(len(list_filter(cited, lambda c: list_contains(CASE WHEN len(relevant) > 0 THEN relevant ELSE retrieved END, c))) / 3.0::DOUBLE, 9) AS accuracy FROM a"""
)
def e_citation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.lit
    cited, retrieved = F.array(F.col("doc_id") % 7, F.col("doc_id") % 5, n(9).cast("long")), F.array(F.col("doc_id") % 5, n(1).cast("long"), n(2).cast("long"))
    relevant = F.when(F.col("doc_id") % 3 == 0, F.array(n(9).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return d.select("doc_id", F.round(evaluation.citation_accuracy(cited, retrieved, relevant), 9).alias("accuracy"))


@_query(
    """WITH h AS (SELECT source AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, doc_id % 13 AS rating FROM documents),
u AS (SELECT *, count(*) FILTER (source_missing) OVER (PARTITION BY query_id) AS missing FROM (SELECT *, query_id = 'src3' AND place = 2 AS source_missing FROM h))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN missing = 0 THEN least(rating / 10, 1) END DESC NULLS LAST, place) AS final_rank FROM u"""
)
def h_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source by their rating of 0..10; one source lacks a rating and keeps its order."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), place.alias("place")).withColumn("fused", 1 / F.col("place"))
    ratings = hits.where("not (query_id = 'src3' and place = 2)").select("query_id", "chunk_id", (F.col("chunk_id") % 13).cast("double").alias("rating"))
    return search.reranked(hits, ratings).select("query_id", "chunk_id", F.col("final_rank").cast("long").alias("final_rank"))


@_query(
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents), p AS (SELECT doc_id, string_split_regex(regexp_replace(flat, '([.!?])\s', '\1' || chr(1), 'g'), chr(1)) AS parts FROM f),
o AS (SELECT doc_id, CASE WHEN length(parts[1]) < 90 AND len(parts) > 1 THEN parts[1] || ' ' || parts[2] ELSE parts[1] END AS t FROM p)
SELECT doc_id, CASE WHEN length(t) > 240 THEN regexp_replace(t[1:240], '\s+\S*$', '') || '…' ELSE t END AS lead FROM o"""
)
def e_snippet_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", context.lead(F.col("text")).alias("lead"))


@_query(
    """WITH e AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS marker, lang, text FROM documents),
n AS (SELECT *, '[' || marker || '] ' || lang || chr(10) || text AS entry FROM e), u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY marker) AS used FROM n),
c AS (SELECT query_id, string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY marker) AS context FROM u WHERE used <= 60000 OR marker = 1 GROUP BY ALL)
SELECT query_id, md5('Context passages:' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || 'What of ' || query_id || '?') AS prompt_md5, greatest(1, length(context) // 4) AS tokens FROM c"""
)
def e_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("lang").alias("source"), F.col("text").alias("content"))
    asked = hits.select("query_id").distinct().withColumn("text", F.concat(F.lit("What of "), "query_id", F.lit("?")))
    return context.prompts(asked, context.pack_context(hits)).select("query_id", F.md5("prompt").alias("prompt_md5"), "tokens")
