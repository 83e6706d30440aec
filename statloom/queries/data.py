"""Queries of the general training-data operators (problem 2) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.operators import orphans
from statloom.session import table


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, d, n)
    refs = orphans.legal_references(t("resolved_edges"), t("raw_taas"), t("legal_chunks"))
    return refs, orphans.orphan_references(refs, orphans.legal_parents(t("legal_documents"), t("legal_chunks")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)[1].select("src_table", "src_key", "src_field", "ref_value").distinct()


def p2_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_orphan_counts)}

_PLAIN = (
    r"trim(regexp_replace(regexp_replace(lower({0}), '[\x{{2010}}-\x{{2015}}\x{{2212}}\x{{00ad}}\x{{fe58}}\x{{fe63}}\x{{ff0d}}]', '-', 'g'), "
    r"'[\s\x0b\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{205f}}\x{{3000}}_]+', ' ', 'g'))"
)
_BARE = r"regexp_replace(regexp_replace({0}, '\(.*$', ''), ' ?- ?', '-', 'g')"
_NUMBER = (
    rf"CASE WHEN regexp_extract({_BARE}, '[0-9][0-9a-z]*(?:[.-][0-9a-z]+)*') <> '' "
    rf"THEN regexp_extract({_BARE}, '[0-9][0-9a-z]*(?:[.-][0-9a-z]+)*') ELSE trim({_BARE}) END"
)


def _plain(c: str) -> str:
    return _PLAIN.format(c)


def _number(c: str) -> str:
    return _NUMBER.replace("{0}", c)


_DOC = (
    f"CASE WHEN p = '' THEN NULL WHEN contains(p, ':') THEN trim(split_part(p, ':', 1)) || ':' || ({_number('substr(p, instr(p, chr(58)) + 1)')}) "
    f"ELSE ({_number('p')}) END"
)

_ORPHANS = f"""
WITH r0 AS (
  SELECT 'resolved_edges' AS src_table, CAST(edge_id AS VARCHAR) AS src_key, 'target_doc_id' AS src_field, target_doc_id AS ref_value,
         extracted_at AS ref_time, 'document' AS kind, {_plain('target_doc_id')} AS p FROM resolved_edges
  UNION ALL SELECT 'raw_taas', CAST(raw_id AS VARCHAR), 'statutes_cited', v, scraped_at, 'statute', {_plain('v')}
    FROM (SELECT raw_id, scraped_at, unnest(metadata.statutes_cited) AS v FROM raw_taas)
  UNION ALL SELECT 'raw_taas', CAST(raw_id AS VARCHAR), 'rules_cited', v, scraped_at, 'rule', {_plain('v')}
    FROM (SELECT raw_id, scraped_at, unnest(metadata.rules_cited) AS v FROM raw_taas)
  UNION ALL SELECT 'legal_chunks', id, 'parent_chunk_id', parent_chunk_id, chunked_at, 'chunk', {_plain('parent_chunk_id')} FROM legal_chunks
), refs AS (
  SELECT *, CASE WHEN p = '' THEN NULL WHEN kind = 'document' THEN {_DOC} WHEN kind = 'chunk' THEN 'c|' || replace(p, ' ', '')
                 ELSE kind || ':' || ({_number('p')}) END AS k FROM r0
), p0 AS (
  SELECT {_plain('id')} AS p, 'document' AS kind, scraped_at AS seen_at, deleted_at FROM legal_documents
  UNION ALL SELECT {_plain('id')}, 'chunk', chunked_at, deleted_at FROM legal_chunks
), p1 AS (
  SELECT CASE WHEN kind = 'chunk' THEN 'c|' || replace(p, ' ', '') ELSE {_DOC} END AS k, seen_at, deleted_at FROM p0 WHERE p <> ''
), parents AS (
  SELECT k, min(seen_at) AS first_seen, bool_or(deleted_at IS NULL) FILTER (seen_at = newest) AS stands
  FROM (SELECT *, max(seen_at) OVER (PARTITION BY k) AS newest FROM p1) GROUP BY k
), marked AS (
  SELECT refs.*, CASE WHEN parents.k IS NULL THEN 'missing' WHEN NOT stands THEN 'deleted' WHEN first_seen > ref_time THEN 'not_yet' END AS reason
  FROM refs LEFT JOIN parents ON refs.k = parents.k WHERE refs.k IS NOT NULL
), orphans AS (
  SELECT DISTINCT src_table, src_key, src_field, ref_value, ref_time, k, reason FROM marked WHERE reason IS NOT NULL
)"""

SQL = {
    "p2_found": _ORPHANS + " SELECT DISTINCT src_table, src_key, src_field, ref_value FROM orphans",
    "p2_orphan_counts": _ORPHANS
    + """, a AS (SELECT src_table, src_field, strftime(ref_time, '%Y-%m') AS month, count(*) AS n_refs FROM refs WHERE k IS NOT NULL GROUP BY ALL),
 b AS (SELECT src_table, src_field, strftime(ref_time, '%Y-%m') AS month, count(*) AS n_orphans, count(*) FILTER (reason = 'missing') AS n_missing,
        count(*) FILTER (reason = 'deleted') AS n_deleted, count(*) FILTER (reason = 'not_yet') AS n_not_yet, count(DISTINCT k) AS n_keys FROM orphans GROUP BY ALL)
 SELECT a.*, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_missing, 0) AS n_missing, coalesce(n_deleted, 0) AS n_deleted,
        coalesce(n_not_yet, 0) AS n_not_yet, coalesce(n_keys, 0) AS n_keys
 FROM a LEFT JOIN b ON a.src_table = b.src_table AND a.src_field = b.src_field AND a.month IS NOT DISTINCT FROM b.month""",
}
