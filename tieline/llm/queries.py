"""Queries of the corpus operators, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tieline.llm import decontam, html_extract, line_dedup, neardup, packing, quality_rules, secret_scan, sharding, toxicity, warc


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of operator 1, which no learned rule decides."""
    return quality_rules.op1(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base secrets of each kind operator 9 finds."""
    return secret_scan.op9(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_toxic_spans": toxicity.op2,
    "op3_html_extraction": html_extract.op3,
    "op4_warc_derivatives": warc.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_jump_hash_sharding": sharding.op6,
    "op7_minhash_near_dedup": neardup.op7,
    "op8_benchmark_decontamination": decontam.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_best_fit_packing": packing.op10,
    "quality_base_counts": quality_base_counts,
    "secret_base_counts": secret_base_counts,
}

ORACLE = {
    "op7_minhash_near_dedup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as both_n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * both_n >= 75 * (p.n + q.n - both_n)
), reach as (select doc_id as x, doc_id as y from words union select r.x, l.y from reach r join links l on l.x = r.y
), least_id as (select x, min(y) as component_id from reach group by x)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, l.component_id, w.doc_id = l.component_id as kept
from words w left join sizes s on s.doc_id = w.doc_id join least_id l on l.x = w.doc_id
""",
    "op8_benchmark_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents
), b as (
  select item_id::varchar as i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark
), bw as (
  select distinct i, least(len(w), 13) as size, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') as s
  from (select i, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as k from b where len(w) > 0)
), dw as (
  select doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') as s
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d, (select distinct size from bw) where len(w) >= size)
), hit as (select doc_id, k, dw.size, i from dw join bw on dw.s = bw.s and dw.size = bw.size
), n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from hit) group by doc_id
), m as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, i from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (doc_id) left join m using (doc_id)
""",
    "op4_warc_derivatives": r"""
with bare as (
  select distinct cast(page_id as varchar) as source_key, coalesce(url, '') as target_uri, coalesce(html, '') as payload from pages
), named as (
  select *, 'sha256:' || sha256(payload) as payload_digest, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) as http_headers,
    regexp_replace(payload, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<!--.*?-->|<head\b.*?</head\s*>', ' ', 'g') as t0 from bare
), keyed as (
  select *, md5('response' || chr(10) || coalesce(source_key, '') || chr(10) || target_uri || chr(10) || payload_digest) as h,
    regexp_replace(regexp_replace(t0, '(?i)</?(p|div|br|h[1-6]|li|ul|ol|table|tr|section|article|header|footer|nav|aside|blockquote|pre|title|form)\b[^>]*>', chr(10), 'g'), '</?[a-zA-Z!?][^>]*>', '', 'g') as t1 from named
), decoded as (
  select *, replace(replace(replace(replace(replace(replace(replace(replace(replace(t1, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') as t2 from keyed
), texts as (
  select *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' as refers_to,
    trim(regexp_replace(regexp_replace(t2, '[ \t\v\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) as body from decoded
), both_kinds as (
  select source_key, refers_to, target_uri, payload_digest, 'conversion' as warc_type, 'text/plain; charset=utf-8' as mime, body from texts
  union all select source_key, refers_to, target_uri, payload_digest, 'metadata', 'application/warc-fields', 'source-payload-digest: ' || payload_digest || chr(13) || chr(10) || 'source-content-length: ' || strlen(payload) || chr(13) || chr(10)
    || 'text-length: ' || length(body) || chr(13) || chr(10) || 'text-digest: sha256:' || sha256(body) || chr(13) || chr(10) || 'source-http-headers: ' || replace(trim(replace(http_headers, chr(13), ''), ' ' ), chr(10), ' | ') from texts
), own as (
  select *, md5(warc_type || chr(10) || refers_to || chr(10) || body) as g, 'sha256:' || sha256(body) as block_digest from both_kinds
), ids as (
  select *, '<urn:uuid:' || g[1:8] || '-' || g[9:12] || '-' || g[13:16] || '-' || g[17:20] || '-' || g[21:32] || '>' as record_id from own
)
select cast(source_key as bigint) as page_id, warc_type, record_id, refers_to, target_uri, payload_digest as source_digest, block_digest, cast(strlen(body) as bigint) as content_length,
  sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || warc_type || chr(13) || chr(10) || 'WARC-Record-ID: ' || record_id || chr(13) || chr(10) || 'WARC-Refers-To: ' || refers_to || chr(13) || chr(10) || 'WARC-Target-URI: ' || target_uri
    || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Block-Digest: ' || block_digest || chr(13) || chr(10) || 'Content-Type: ' || mime || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)) as headers_sha256 from ids
""",
    "op5_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null and doc_id is not null
), words as (select doc_id, line_no, regexp_extract_all(lower(line), '[^ \t\n\v\f\r]+') as w from lines
), sets as (
  select doc_id, line_no, row_number() over (order by doc_id, line_no) as k, case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as t from words where len(w) > 0
), tokens as (select k, len(t) as n, unnest(t) as x from sets
), pairs as (select a.k as later, a.n as n, b.n as m, b.k as earlier, count(*) as c from tokens a join tokens b on a.x = b.x and a.k > b.k group by all
), gone as (select distinct later as k from pairs where 100 * c >= 75 * (n + m - c)
), counted as (
  select doc_id, count(*) as n_lines, count(g.k) as n_removed, string_agg(cast(line_no as varchar), ',' order by line_no) filter (g.k is not null) as removed_lines from sets left join gone g using (k) group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed_lines, '') as removed_lines from documents d left join counted using (doc_id)
""",
    "quality_base_counts": r"""
with words as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') as w from documents
), triples as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from words
), places as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from triples
), repeated as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from places where n > 1) group by doc_id
), counts as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, len(regexp_extract_all(body, '[#*$%&|<>]')) as n_symbols,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) as lines from words
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(n, 0) as bigint) as n_repeat_words, n_words < 50 or 100 * coalesce(n, 0) > 50 * n_words as base_failed from counts left join repeated using (doc_id)
""",
    "secret_base_counts": r"""
select doc_id, cast(len(list_filter(regexp_extract_all(body, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) as bigint) as n_assign,
  cast(len(list_filter(regexp_extract_all(body, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as bigint) as n_access,
  cast(len(list_filter(regexp_extract_all(body, '[0-9a-f]+'), lambda x: length(x) >= 24)) as bigint) as n_hex from (select doc_id, coalesce(text, '') as body from documents)
""",
}
