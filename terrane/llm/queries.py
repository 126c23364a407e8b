"""The registered queries of the text operators, over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, hard_negatives, importance, language_id, line_dedup, near_dups, packing, passages, quality_rules, sentencepiece_lattice, sharding, url_filter, warc


#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.quality(_read(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept")


def _op3_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    rules = " AND ".join(r.sql() for r in quality_rules.RULES)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM w, unnest(generate_series(1, len(words) - 4)) AS u(i)),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2, 3, 4]) AS u(k) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
       NOT base_failed AND {rules} AS kept
FROM judged"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations: the best one's ids and score, and each other's score and changes."""
    coded = sentencepiece_lattice.encode(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", n=4)
    return coded.select("doc_id", F.size("ids").alias("n_ids"), "ids", "score", F.get("others", 0)["score"].alias("second_score"), "others", "restored")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def _op6_sql() -> str:
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda x, pattern: f"coalesce(regexp_extract({x}, '(?s)^{pattern}', 1), '')"
    host = lambda x: lower(part(x, ".*?://([^/?#]*)"))
    path = lambda x: part(x, ".*?://[^/?#]*([^?#]*)")
    rest = lambda x: part(x, ".*?://[^/?#]*([^#]*)")
    node = lambda x: f"CASE WHEN contains({x}, '://') THEN {host(x)} || CASE WHEN starts_with({rest(x)}, '/') THEN '' ELSE '/' END || {rest(x)} END"
    origin, folder = part("url", "(.*?://[^/?#]*)"), part("url", "(.*?://[^/?#]*(?:/[^?#]*/|/)?)")
    rules = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)
    tags, canonical, refresh = (x.replace("'", "''") for x in (url_filter.TAGS, url_filter.CANONICAL, url_filter.REFRESH))
    fits = lambda h, p: f"({h} = r.host OR ends_with({h}, '.' || r.host)) AND starts_with({p}, r.path)"
    return f"""
WITH RECURSIVE r(rule, host, path, verdict) AS (VALUES {rules}),
t AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '{tags}')) AS tag FROM pages),
h AS (SELECT url, CASE WHEN starts_with(lower(tag), '<meta') THEN regexp_extract(tag, '(?i)url\\s*=\\s*[''"]?([^''">\\s]+)', 1) ELSE regexp_extract(tag, '(?i)href\\s*=\\s*[''"]?([^''">\\s]+)', 1) END AS href_ FROM t
  WHERE CASE WHEN starts_with(lower(tag), '<meta') THEN regexp_matches(tag, '{refresh}') ELSE regexp_matches(tag, '{canonical}') END),
k AS (SELECT url, replace(href_, '&amp;', '&') AS href FROM h),
g AS (SELECT {node("url")} AS src, CASE WHEN href = '' THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href
  WHEN starts_with(href, '/') THEN {origin} || href ELSE {folder} || CASE WHEN ends_with({folder}, '/') THEN '' ELSE '/' END || href END AS target FROM k),
e AS (SELECT src, {node("target")} AS dst FROM g WHERE src IS NOT NULL AND target IS NOT NULL),
s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT a AS id, a AS other FROM s UNION SELECT reach.id, s.b FROM reach JOIN s ON s.a = reach.other),
nodes AS (SELECT DISTINCT other AS node, {host("'x://' || other")} AS nh, {path("'x://' || other")} AS np FROM reach),
judged AS (SELECT node, arg_max(r.verdict, length(r.rule)) AS v FROM nodes JOIN r ON {fits("nh", "np")} GROUP BY node),
alias AS (SELECT id, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS shared FROM reach JOIN judged ON node = other GROUP BY id),
p AS (SELECT page_id, {host("url")} AS host, {path("url")} AS path, {node("url")} AS node FROM pages),
own AS (SELECT host, path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM (SELECT DISTINCT host, path FROM p) q JOIN r ON {fits("q.host", "q.path")} GROUP BY 1, 2)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, shared, 'allow') AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN shared IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM p LEFT JOIN own ON own.host = p.host AND own.path = p.path LEFT JOIN alias ON alias.id = p.node""".replace("SELECT host, path, arg_max", "SELECT q.host, q.path, arg_max")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"), "text")


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i - 1 AS line, string_split(text, chr(10))[u.i] AS t
  FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(i)),
s AS (
  SELECT doc_id, line, t, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS words FROM lines),
w AS (SELECT doc_id, line, len(words) AS n, unnest(words) AS word FROM s WHERE len(words) >= 1),
df AS (SELECT word, count(*) AS c FROM w GROUP BY word),
r AS (SELECT doc_id, line, n, word, row_number() OVER (PARTITION BY doc_id, line ORDER BY c, word) AS i FROM w JOIN df USING (word)),
p AS (SELECT * FROM r WHERE 5 * (n - i + 1) >= 4 * n),
pairs AS (
  SELECT DISTINCT a.doc_id AS ad, a.line AS al, b.doc_id AS bd, b.line AS bl, a.n AS an, b.n AS bn
  FROM p a JOIN p b ON a.word = b.word AND (b.doc_id, b.line) < (a.doc_id, a.line) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
late AS (
  SELECT DISTINCT ad, al FROM pairs JOIN s x ON x.doc_id = ad AND x.line = al JOIN s y ON y.doc_id = bd AND y.line = bl
  WHERE 9 * len(list_intersect(x.words, y.words)) >= 4 * (an + bn))
SELECT s.doc_id, count(*) FILTER (len(words) > 0)::BIGINT AS n_lines, count(ad)::BIGINT AS n_removed,
       coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (ad IS NULL), '') AS text
FROM s LEFT JOIN late ON ad = s.doc_id AND al = s.line GROUP BY s.doc_id"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.deduplicate(_read(spark, sf_dir, "pages"))
    full = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    digest = F.coalesce(F.sha2("payload", 256), F.col("payload_digest"))
    return back.select("page_id", full.alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM q"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.dedup_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS t FROM d, unnest(generate_series(1, len(words) - 12)) AS u(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first_id FROM w),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM f, unnest(generate_series(0, 12)) AS v(k) WHERE first_id < doc_id),
g AS (SELECT doc_id, list(i) AS places, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN g.n IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(g.places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("__n_features").alias("n_features"), F.col("__weight").alias("weight"), F.col("__score").alias("score"), F.col("__rank").alias("rank"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", relabelled), anchors=F.col("id") % 100 == 0)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT * FROM (
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE rank <= 10"""


QUERIES = {"op1_decontamination": op1_decontamination, "op2_near_dups": op2_near_dups, "op3_quality_rules": op3_quality_rules, "op4_language_id": op4_language_id, "op5_sentencepiece": op5_sentencepiece, "op6_url_filter": op6_url_filter, "op7_packing": op7_packing, "op8_line_dedup": op8_line_dedup, "op9_warc": op9_warc, "op10_sharding": op10_sharding, "op11_substring_dedup": op11_substring_dedup, "op12_importance_resampling": op12_importance_resampling, "op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op3_quality_rules": _op3_sql(), "op6_url_filter": _op6_sql(), "op8_line_dedup": OP8_SQL, "op9_warc": OP9_SQL, "op11_substring_dedup": OP11_SQL, "op13_hard_negatives": OP13_SQL}
