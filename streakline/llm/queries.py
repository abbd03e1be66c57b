"""Registered corpus queries and their SQL twins."""

from __future__ import annotations

import public_tokenizers

from streakline.llm import alignment, decontamination, edits, html, jaccard, langid, mixing, personal, rans, runs, sharding, urls, warc
from streakline.llm.common import table


def op1_mix_weights(spark, sf_dir):
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op2_zstd_language(spark, sf_dir):
    return langid.predicted_languages(table(spark, sf_dir, "documents"))


def op3_edit_fingerprint(spark, sf_dir):
    return edits.edit_fingerprints(table(spark, sf_dir, "documents"))


def op4_personal_data(spark, sf_dir):
    return personal.personal_data(table(spark, sf_dir, "documents"))


def op5_jaccard_components(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_html_wrapper(spark, sf_dir):
    return html.extract_articles(table(spark, sf_dir, "pages"))


def op7_pigeonhole_leaks(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_shard_propagation(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_url_list(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.blocked_captures(urls.sample_captures(pages), urls.sample_list(pages))


def op10_warc_zstd(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op11_rans_tokens(spark, sf_dir):
    return rans.token_positions(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_token_alignment(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned_tokens(table(spark, sf_dir, "documents"), a, b)


def op13_word_runs(spark, sf_dir):
    return runs.run_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix_weights": op1_mix_weights,
    "op2_zstd_language": op2_zstd_language,
    "op3_edit_fingerprint": op3_edit_fingerprint,
    "op4_personal_data": op4_personal_data,
    "op5_jaccard_components": op5_jaccard_components,
    "op6_html_wrapper": op6_html_wrapper,
    "op7_pigeonhole_leaks": op7_pigeonhole_leaks,
    "op8_shard_propagation": op8_shard_propagation,
    "op9_url_list": op9_url_list,
    "op10_warc_zstd": op10_warc_zstd,
    "op11_rans_tokens": op11_rans_tokens,
    "op12_token_alignment": op12_token_alignment,
    "op13_word_runs": op13_word_runs,
}
_HOST = (
    r"regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1),"
    r" '^.*@', ''), ':[0-9]*$', '')), '\.+$', '')"
)

#: Every capture against every interval whose pattern covers its URL, without keys, stretches or as-of tricks.
_OP9 = rf"""
WITH p AS (
  SELECT page_id, url, {_HOST} AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^/?#]+)/', 1) AS first_segment,
         DATE '2023-01-01' + (page_id * 37 % 730)::INTEGER AS fetched_on
  FROM pages
), patterns AS (
  SELECT pattern, min(reason) AS reason FROM (
    SELECT host AS pattern, 'host' AS reason FROM p
    UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'domain' FROM p
    UNION ALL SELECT host || first_segment || '/', 'path' FROM p WHERE host <> ''
  ) WHERE pattern <> '' GROUP BY pattern
), drawn AS (
  SELECT pattern, reason, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS draw FROM patterns
), entries AS (
  SELECT pattern, reason, 'add' AS action, DATE '2023-01-01' + (draw % 500)::INTEGER AS listed_on FROM drawn
  UNION ALL SELECT pattern, reason, 'remove', DATE '2023-01-01' + (draw % 500)::INTEGER + (draw % 97)::INTEGER + 20 FROM drawn
  UNION ALL SELECT pattern, reason, 'add', DATE '2023-01-01' + (draw % 500)::INTEGER + (draw % 211)::INTEGER + 90 FROM drawn
), days AS (
  SELECT regexp_replace(pattern, '/+$', '') AS pattern, listed_on, max(action) AS action, min(reason) FILTER (action = 'add') AS reason
  FROM entries GROUP BY ALL
), intervals AS (
  SELECT *, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS until FROM days
), hits AS (
  SELECT p.page_id, i.pattern, i.reason,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.pattern) DESC, i.pattern) AS place,
         count(*) OVER (PARTITION BY p.page_id) AS n
  FROM p JOIN intervals i
    ON i.action = 'add' AND p.fetched_on >= i.listed_on AND (i.until IS NULL OR p.fetched_on < i.until)
   AND (p.host = i.pattern OR ends_with(p.host, '.' || i.pattern)
        OR (contains(i.pattern, '/') AND starts_with(p.host || p.path || '/', i.pattern || '/')))
)
SELECT p.page_id, p.url, p.fetched_on, h.pattern AS blocked_by, h.reason AS blocked_reason, coalesce(h.n, 0) AS n_active
FROM p LEFT JOIN hits h ON h.page_id = p.page_id AND h.place = 1
"""

ORACLE: dict[str, str] = {"op9_url_list": _OP9}
