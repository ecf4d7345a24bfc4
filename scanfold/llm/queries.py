"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm import (bpe, chat_format, collocations, decontaminate, exact_dedup, filter_audit, ngram_join, secret_scan,
                          substring_dedup, token_files, toxicity, url_filter, warc)
from scanfold.sources.workspace import stored

QUERIES: dict = {}
ORACLE: dict = {}


def query(key: str, sql: str | None = None):
    def register(function):
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_exact_dedup", r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN groups USING (t)""")
def op5_exact_dedup(spark, d):
    return exact_dedup.exact_groups(table(spark, d, "documents"))


@query("op6_token_files")
def op6_token_files(spark, d):
    return token_files.token_file_digest(table(spark, d, "documents"))


@query("op9_bpe")
def op9_bpe(spark, d):
    return bpe.round_trip_digest(table(spark, d, "documents"))


@query("op1_secret_scan")
def op1_secret_scan(spark, d):
    return secret_scan.secret_digest(table(spark, d, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark, d):
    return toxicity.score_digest(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op7_url_filter")
def op7_url_filter(spark, d):
    return url_filter.judge(table(spark, d, "pages"))


@query("op10_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]|REPLY\]|SYS\]|ROLE[ \]]))', '\1\\\2', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 12 WHEN 'system' THEN 13
      ELSE 16 + length(replace(replace(role, '%', '%25'), ']', '%5D')) END AS size,
    strlen(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]|REPLY\]|SYS\]|ROLE[ \]]))', '\1\\\2', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 12 WHEN 'system' THEN 13
      ELSE 16 + strlen(replace(replace(role, '%', '%25'), ']', '%5D')) END AS bytes FROM turns),
placed AS (
  SELECT *, 3 + coalesce(sum(bytes) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(size))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(ahead) FILTER (role = 'assistant'), 0)::BIGINT AS context_bytes
FROM placed GROUP BY conv_id""")
def op10_chat_format(spark, d):
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.format_digest(stored(chat_format.format_conversations(turns), "chat"))


@query("op3_decontaminate")
def op3_decontaminate(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op2_ngram_jaccard", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""")
def op2_ngram_jaccard(spark, d):
    return ngram_join.near_duplicates(table(spark, d, "documents"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark, d):
    return substring_dedup.repeated_passages(table(spark, d, "documents"))


#: (order, step, own, before) of all orders of the five filters.
STEPS = ", ".join(f"('{order}', {step}, {own}, {before})" for order, step, own, before in filter_audit.steps())


@query("op11_filter_audit", rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM texts JOIN firsts USING (t) LEFT JOIN marked USING (doc_id)),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, mask),
steps(filter_order, step, own, before) AS (VALUES {STEPS})
SELECT part, filter_order, CAST(step AS INT) AS step,
  CAST(coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
FROM masks CROSS JOIN steps GROUP BY part, filter_order, step""")
def op11_filter_audit(spark, d):
    return filter_audit.filter_audit(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op12_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (
  SELECT lang, row_number() OVER () AS piece_id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
placed AS (SELECT lang, piece_id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM words),
following AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM placed WINDOW p AS (PARTITION BY piece_id ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a FROM following GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM following WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM following WHERE w3 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
parts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS left_part, array_to_string(w[2:k], ' ') AS right_part FROM candidates
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE k = 3),
cuts AS (
  SELECT p.lang, p.phrase, p.a, p.cut, l.a AS l, r.a AS r,
    CAST((1000000 :: HUGEINT * p.a * p.a) // (l.a :: HUGEINT * r.a) AS BIGINT) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.left_part JOIN f r ON r.lang = p.lang AND r.phrase = p.right_part),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM scored LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000""")
def op12_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


@query("op13_warc", """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
sized AS (SELECT page_id, octet_length(p) AS payload_bytes, sha256(p) AS payload_digest FROM payloads),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)""")
def op13_warc(spark, d):
    return warc.warc_round_trip(table(spark, d, "pages"))
