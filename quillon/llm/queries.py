"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillon.llm import chat_format, decontaminate, fixity, html_extract, packing, quality_gam, quality_rules, simhash, toxicity, url_filter, url_sql
from quillon.llm.common import table

URL_RULES = [
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
]


def op5_pairwise_gam_quality(spark, sf_dir):
    return quality_gam.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_min_cut_main_text(spark, sf_dir):
    found = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op7_url_template_tree(spark, sf_dir):
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def damaged_payload():
    """What a second replica of the pages holds: some records with another first character, cut in half, or lost."""
    html, key = F.coalesce("html", F.lit("")), F.col("page_id")
    return (
        F.when(key % 97 == 13, F.concat(F.lit("#"), F.substr(html, F.lit(2))))
        .when(key % 577 == 3, F.substr(html, F.lit(1), F.floor(F.char_length(html) / 2).cast("int")))
        .when(key % 389 == 7, F.lit(None))
        .otherwise(html)
    )


def op1_merkle_fixity_audit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity.audit(fixity.archive_records(pages), fixity.archive_records(pages, damage=damaged_payload()))


def op2_bigru_attention_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op3_schema_fingerprint_chat(spark, sf_dir):
    turns = chat_format.turns_of_table(table(spark, sf_dir, "conversations"))
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("bigint").alias("id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return chat_format.digests(chat_format.format_turns(turns.unionByName(probe)))


def op4_golay_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op8_ngram_likelihood_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    ratios = quality_rules.log_ratios(docs, trusted)
    return quality_rules.judge_documents(docs, ratios)


def op9_vector_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_positional_index_decontamination(spark, sf_dir):
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), said AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') || '</turn>' || chr(10) AS piece FROM turns
), grouped AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length(piece)) AS chars
  FROM said GROUP BY conv_id
)
SELECT conv_id, n AS n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars
FROM grouped
"""


OP10_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
  SELECT item_id, w AS words FROM item_words WHERE len(w) BETWEEN 1 AND 9
  UNION ALL
  SELECT item_id, w[i + 1 : i + 10] FROM (SELECT item_id, w, unnest(range(0, len(w) - 9)) AS i FROM item_words WHERE len(w) >= 10)
), distinct_windows AS (SELECT DISTINCT item_id, words, len(words) AS k FROM windows
), lengths AS (SELECT DISTINCT k FROM distinct_windows
), doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), runs AS (
  SELECT doc_id, k, i, w[i + 1 : i + k] AS words
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM doc_words, lengths WHERE len(w) >= k)
), found AS (SELECT r.doc_id, r.i, r.k, d.item_id FROM runs r JOIN distinct_windows d ON r.words = d.words
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
  sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""


OP1_SQL = r"""
WITH payloads AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    CASE WHEN page_id % 97 = 13 THEN '#' || substr(coalesce(html, ''), 2)
      WHEN page_id % 577 = 3 THEN substr(coalesce(html, ''), 1, length(coalesce(html, '')) // 2)
      WHEN page_id % 389 = 7 THEN NULL ELSE coalesce(html, '') END AS found
  FROM pages
), records AS (
  SELECT page_id, page_id // 256 AS archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, found
  FROM payloads
), whole AS (
  SELECT page_id, archive, head || strlen(html) || gap || html || gap AS a, head || strlen(found) || gap || found || gap AS b FROM records
), placed AS (
  SELECT *, coalesce(sum(strlen(a)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM whole
)
SELECT archive, CAST(place AS BIGINT) AS "offset", page_id AS record_id,
  CASE WHEN b IS NULL THEN 'missing' WHEN strlen(b) < strlen(a) THEN 'truncated' ELSE 'altered' END AS fault,
  strlen(a) AS expected_length, coalesce(strlen(b), 0) AS found_length, sha256(a) AS expected_digest,
  coalesce(sha256(b), '') AS found_digest
FROM placed WHERE a IS DISTINCT FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_template_tree": url_sql.sql_of(URL_RULES), "op1_merkle_fixity_audit": OP1_SQL, "op3_schema_fingerprint_chat": OP3_SQL, "op10_positional_index_decontamination": OP10_SQL}
