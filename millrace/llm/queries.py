"""The registered queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import decontaminate, divergence, fill_middle, html, jaccard_join, license_scan, media, packing, pieces, sharding, substring_dedup, tokenbin, toxicity
from millrace.llm.scratch import scratch_path
from millrace.llm.tokens import public_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    media.to_media(_documents(spark, sf_dir)).write.option("compression", "zstd").parquet(path)
    return media.digests(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path))


def op3_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(decontaminate.mark(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10))


def op4_html_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    tokenbin.write_ids(_documents(spark, sf_dir), path, public_path("word_bpe_49k.json"))
    return tokenbin.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=("doc_id",))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(_documents(spark, sf_dir), n=4, num=85, den=100)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_documents(spark, sf_dir), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    sharding.write_shards(_documents(spark, sf_dir), path)
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return sharding.read_shards(spark, path).select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(license_scan.scan(_documents(spark, sf_dir)))


def op11_sentencepiece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_path("piece_bpe_32k.model")
    ids = pieces.encode(_documents(spark, sf_dir), path)
    texts = pieces.decode(ids, path, keep=("doc_id", "n_tokens", "ids"))
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir), min_documents=10, top=10)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = fill_middle.transformed(_documents(spark, sf_dir))
    texts = fill_middle.restored(outputs, keep=("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return texts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


QUERIES = {
    "op1_hierarchical_packing": op1_hierarchical_packing,
    "op2_matroska_media": op2_matroska_media,
    "op3_wu_manber_decontamination": op3_wu_manber_decontamination,
    "op4_html_page_difference": op4_html_page_difference,
    "op5_elias_fano_ids": op5_elias_fano_ids,
    "op6_toxicity_pu": op6_toxicity_pu,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_external_shuffle": op9_external_shuffle,
    "op10_license_scan": op10_license_scan,
    "op11_sentencepiece_rounds": op11_sentencepiece_rounds,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_middle": op13_fill_middle,
}

#: Words of op3's texts; ASCII letters only change their case.
_WORDS3 = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: len(x) > 0)"""
#: Terms of op12.
_WORDS12 = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: len(x) > 0)"""
_WORDS7 = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: len(x) > 0)"""
_WORDS8 = r"""list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: len(x) > 0)"""

ORACLE_SQL: dict[str, str] = {
    "op3_wu_manber_decontamination": f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS3} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS3} AS w FROM documents),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN lengths WHERE len(w) >= m)),
found AS (SELECT p.doc_id, p.i, p.m, x.item_id FROM places p JOIN windows x ON p.m = x.m AND p.s = x.s),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
""",
    "op8_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN firsts USING (h) WHERE f < win.doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ks IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, k: NOT list_contains(ks, k)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
""",
    "op12_source_divergence": f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_WORDS12} AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
one AS (SELECT lang, source, row_number() OVER () AS doc, w FROM d),
occ AS (SELECT lang, source, doc, unnest(w) AS term FROM one),
df AS (SELECT lang, term FROM occ GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY ALL),
n AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN df USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM n GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, df.term, coalesce(n.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 2) // (gn.total + 2 * v.v) AS p
  FROM gn JOIN df USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = gn.lang AND n.source = gn.source AND n.term = df.term),
q AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 2) // (max(ln.total) + 2 * max(v.v)) AS q
  FROM n JOIN ln USING (lang) JOIN v USING (lang) GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op13_fill_middle": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda x: len(x) > 0) AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:n], '') AS suf FROM d),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(out) AS output_sha256, sha256(text) AS restored_sha256
FROM o
""",
}
