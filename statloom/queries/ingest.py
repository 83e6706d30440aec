"""Queries of ingestion: normalisation, statistics, audits, text functions, chunking, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import text as T
from statloom.operators import chunking, citations, corpus
from statloom.session import table

DAY = "2020-01-01"


def normalize_statutes(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.statutes_to_documents(table(spark, d, "raw_statutes"))
    return docs.select("raw_id", "id", "title", "full_citation", "effective_date", "parent_id")


def normalize_taas(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.taas_to_documents(table(spark, d, "raw_taas"))
    return docs.select("raw_id", "id", "title", "full_citation", "effective_date", F.size("cites_statutes").alias("n_statutes"), F.size("cites_rules").alias("n_rules"))


def consolidated_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.consolidate(corpus.statutes_to_documents(table(spark, d, "raw_statutes")), corpus.taas_to_documents(table(spark, d, "raw_taas")))
    return corpus.corpus_counts(docs)


def consolidated_latest(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.consolidate(corpus.statutes_to_documents(table(spark, d, "raw_statutes")), corpus.taas_to_documents(table(spark, d, "raw_taas")))
    return corpus.latest_by(docs, "id", F.col("scraped_at").desc(), F.col("raw_id").desc()).select("id", "doc_type", "raw_id", "title", "scraped_at")


def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_counts(table(spark, d, "legal_documents"))


def length_by_type(spark: SparkSession, d: str) -> DataFrame:
    return corpus.length_statistics(table(spark, d, "legal_documents"))


def chunk_bins(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunk_statistics(table(spark, d, "legal_chunks"))


def audit_issues(spark: SparkSession, d: str) -> DataFrame:
    return corpus.audit_statutes(table(spark, d, "raw_statutes"))


def chapter_rollup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chapter_sections(table(spark, d, "raw_statutes"))


def ancestry_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "legal_documents")
    path = corpus.ancestry(
        F.col("doc_type"), F.col("full_citation"), F.col("title"), F.coalesce(F.col("metadata")["chapter"], F.lit("")), F.coalesce(F.col("metadata")["tax_type"], F.lit(""))
    )
    return docs.select("id", path.alias("ancestry")).distinct()


def version_in_force(spark: SparkSession, d: str) -> DataFrame:
    return corpus.version_in_force(table(spark, d, "legal_documents"), DAY)


def encoding_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = T.encoding_flags(F.col("text"))
    return table(spark, d, "raw_taas").select(flags.alias("flags")).where("flags <> ''").groupBy("flags").agg(F.count("*").alias("n"))


def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_taas").select("raw_id", F.md5(T.clean_html(F.col("text"))).alias("clean_md5"))


def whitespace_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normal_whitespace(F.col("text"))).alias("clean_md5"))


def dates_extract(spark: SparkSession, d: str) -> DataFrame:
    found = F.transform(T.written_dates(F.col("text")), lambda x: F.date_format(x, "yyyy-MM-dd"))
    return table(spark, d, "raw_taas").select("raw_id", F.array_join(found, ",").alias("dates"))


def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "raw_statutes").select("raw_id", T.iso_date(text).alias("day"))


def cite_statutes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_taas").select("raw_id", F.array_join(T.statute_citations(F.col("text")), "|").alias("cited"))


def cite_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.rule_citations(F.col("text")), "|").alias("cited"))


def cite_cases_chapters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_documents").select(
        "id", F.array_join(T.case_citations(F.col("full_citation")), "|").alias("cases"), F.array_join(T.chapter_mentions(F.col("text")), "|").alias("chapters")
    ).distinct()


def citation_forms(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "raw_taas").select(F.explode(F.col("metadata.statutes_cited")).alias("c")).where("c is not null").distinct()
    c = F.col("c")
    return cited.select("c", T.normal_citation(c).alias("normal"), T.base_citation(c).alias("base"), T.citation_kind(c).alias("kind"), T.section_number(c).alias("section"))


def chunk_subsections(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "raw_statutes")
    return docs.select("raw_id", F.posexplode(chunking.subsections(F.col("text"))).alias("pos", "s")).select("raw_id", "pos", F.col("s.marker").alias("marker"), F.md5("s.content").alias("content_md5"))


def chunk_sections_taa(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "raw_taas")
    return docs.select("raw_id", F.posexplode(chunking.taa_sections(F.col("text"))).alias("pos", "s")).select("raw_id", "pos", F.col("s.marker").alias("marker"), F.md5("s.content").alias("content_md5"))


def chunk_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.latest_by(table(spark, d, "legal_documents"), "id", F.col("scraped_at").desc(), F.col("deleted_at").asc_nulls_last())
    chunks = chunking.chunk_documents(corpus.with_paths(docs, F.col("metadata")["chapter"], F.col("metadata")["tax_type"]))
    return chunks.select("id", "doc_id", "level", "ancestry", "subsection_path", "parent_chunk_id", F.array_join("child_chunk_ids", ",").alias("children"), "citation", "effective_date", "token_count", F.md5("text_with_ancestry").alias("text_md5"))


def citation_graph(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "legal_chunks").dropDuplicates(["id"])
    g = citations.citation_graph(chunks)
    return g.select(F.col("id").alias("source_chunk_id"), F.col("doc_id").alias("source_doc_id"), "kind", "normalized", "relation_type", "target_doc_id", "target_chunk_id", "confidence")


def citation_report(spark: SparkSession, d: str) -> DataFrame:
    return citations.resolution_report(citations.citation_graph(table(spark, d, "legal_chunks").dropDuplicates(["id"])))


def resolve_tiers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    cited = table(spark, d, "raw_taas").select(F.explode(F.col("metadata.statutes_cited")).alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n"))
    keyed = cited.select("c", "n", F.lit("statute").alias("kind"), T.section_number(c).alias("section"), T.normal_citation(c).alias("normalized"))
    index = citations.document_index(table(spark, d, "legal_chunks"))
    return citations.resolve(keyed, index).select("c", "n", "section", "target_doc_id", "target_chunk_id", F.col("confidence").cast("double").alias("confidence"))


def edges_once(spark: SparkSession, d: str) -> DataFrame:
    return citations.delivered_once(table(spark, d, "resolved_edges")).select("edge_id", "source_doc_id", "target_doc_id", "relation_type", "loaded_at")


def edges_dedupe(spark: SparkSession, d: str) -> DataFrame:
    edges = citations.delivered_once(table(spark, d, "resolved_edges")).where("target_doc_id is not null")
    return citations.best_edges(edges).select("source_doc_id", "target_doc_id", "relation_type", "confidence", "edge_id")


def edge_bands(spark: SparkSession, d: str) -> DataFrame:
    return citations.edge_statistics(table(spark, d, "resolved_edges"))


def edges_confident(spark: SparkSession, d: str) -> DataFrame:
    e = citations.confident(table(spark, d, "resolved_edges"))
    return e.groupBy("relation_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


_NAMES = (
    normalize_statutes, normalize_taas, consolidated_counts, consolidated_latest, corpus_counts, length_by_type, chunk_bins, audit_issues, chapter_rollup, ancestry_paths,
    version_in_force, encoding_flags, html_clean, whitespace_norm, dates_extract, iso_dates, cite_statutes, cite_rules, cite_cases_chapters, citation_forms,
    chunk_subsections, chunk_sections_taa, chunk_corpus, citation_graph, citation_report, resolve_tiers, edges_once, edges_dedupe, edge_bands, edges_confident,
)
QUERIES = {f.__name__: f for f in _NAMES}

_ST, _RU = T.STATUTE, T.RULE


def _either(pattern: str, upper: str = "") -> str:
    e = lambda g: f"regexp_extract_all(text, '{pattern}', {g})"
    return (
        f"array_to_string(list_sort(list_distinct(list_transform(list_zip({e(1)}, {e(2)}, {e(3)}, {e(4)}), "
        f"lambda m: {upper}(CASE WHEN m[1] <> '' THEN m[1] ELSE m[3] END) || lower(CASE WHEN m[1] <> '' THEN m[2] ELSE m[4] END)))), '|')"
    )


def _space(c: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), "
        rf"'\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    )


def _html(c: str) -> str:
    for entity, sign in T.ENTITIES:
        c = f"replace({c}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return _space(f"regexp_replace({c}, '<[^>]+>', '', 'g')")


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CITED = "SELECT unnest(metadata.statutes_cited) AS c FROM raw_taas"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(c)), '^(fla\.?\s*stat\.?\s*)?§?\s*', ''), '^(rule\s+|f\.?a\.?c\.?\s*r?\.?\s*)', ''), '\s+', '', 'g')"
_SECTION = (
    r"coalesce(nullif(regexp_extract(c, '(?i)(?:Fla\.?\s*Stat\.?\s*)?§\s*([\d.]+(?:\([^)]+\))*)', 1), ''), "
    r"nullif(regexp_extract(c, '(?i)(?:Rule\s+|F\.?A\.?C\.?\s*R?\.?\s*)([\dA-Za-z.-]+)', 1), ''), nullif(regexp_extract(c, '(\d+\.\d+(?:\([^)]+\))*)', 1), ''))"
)
_STAT_DOCS = "SELECT raw_id, 'statute:' || metadata.section AS id, 'statute' AS doc_type, coalesce(nullif(metadata.section_name, ''), 'Section ' || metadata.section) AS title, scraped_at FROM raw_statutes WHERE metadata.section <> ''"
_TAA_DOCS = "SELECT raw_id, 'taa:' || replace(metadata.taa_number, ' ', '_') AS id, 'taa' AS doc_type, coalesce(nullif(metadata.title, ''), 'TAA ' || metadata.taa_number) AS title, scraped_at FROM raw_taas WHERE metadata.taa_number <> ''"
_ONCE = "SELECT * FROM resolved_edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC NULLS LAST, extracted_at DESC NULLS LAST, target_doc_id ASC NULLS LAST) = 1"
def _sections(rows: str, key: str) -> str:
    """CTE ``sections``: the sections of advisements with two headers at least."""
    at = " UNION ALL ".join(f"SELECT {key}, text, '{h.replace(chr(39), chr(39) * 2)}' AS marker, length(regexp_extract(text, '(?is)^(.*?)\\n{h.replace(chr(39), chr(39) * 2)}\\n', 1)) + 1 AS place FROM {rows} WHERE regexp_matches(text, '(?i)\\n{h.replace(chr(39), chr(39) * 2)}\\n')" for h in chunking.TAA_HEADERS)
    return f"""headers AS ({at}), spread AS (SELECT *, lead(place) OVER (PARTITION BY {key} ORDER BY place) AS nxt, count(*) OVER (PARTITION BY {key}) AS c FROM headers),
 sections AS (SELECT {key}, place, marker, {_STRIP.format("substr(text, place + length(marker) + 2, greatest(coalesce(nxt, length(text) + 1) - place - length(marker) - 2, 0))")} AS content FROM spread WHERE c >= 2)"""


_COUNT = r"len(regexp_extract_all({0}, '[A-Za-z0-9]+|[^A-Za-z0-9\s]'))"
_PATHS = (
    "CASE doc_type WHEN 'statute' THEN concat_ws(' > ', 'Florida Statutes', 'Chapter ' || nullif(metadata['chapter'], ''), replace(full_citation, 'Fla. Stat. ', '')) WHEN 'rule' THEN concat_ws(' > ', 'Florida Administrative Code', 'Chapter ' || nullif(metadata['chapter'], ''), replace(full_citation, 'Fla. Admin. Code R. ', 'Rule ')) "
    "WHEN 'taa' THEN concat_ws(' > ', 'Florida DOR Technical Assistance Advisements', nullif(metadata['tax_type'], ''), replace(full_citation, 'Fla. DOR ', '')) WHEN 'case' THEN concat_ws(' > ', 'Florida Case Law', nullif(metadata['tax_type'], ''), title) ELSE full_citation END"
)


def _chunked(docs: str) -> str:
    """CTEs from the documents to ``chunked``: cut by kind."""
    return rf"""WITH RECURSIVE docs AS ({docs}),
 subs0 AS (SELECT id, regexp_extract_all(text, '\n\((\d+)\)\n', 1) AS m, regexp_split_to_array(text, '\n\(\d+\)\n')[2:] AS p FROM docs WHERE doc_type IN ('statute', 'rule')), subs1 AS (SELECT id, unnest(list_zip(m, p)) AS z, generate_subscripts(m, 1) AS i FROM subs0),
 longs AS (SELECT id, text FROM docs WHERE doc_type = 'taa' AND {_COUNT.format('text')} >= {chunking.TAA_LEAST}), {_sections('longs', 'id')},
 para AS (SELECT id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM docs WHERE doc_type = 'case' AND {_COUNT.format('text')} >= {chunking.CASE_LEAST}),
 walk AS (SELECT id, p, 1 AS i, 1 AS part, {_COUNT.format('p[1]')} AS n FROM para WHERE len(p) > 1 UNION ALL SELECT id, p, i + 1, CASE WHEN n + {_COUNT.format('p[i + 1]')} > {chunking.CASE_TARGET} THEN part + 1 ELSE part END, CASE WHEN n + {_COUNT.format('p[i + 1]')} > {chunking.CASE_TARGET} THEN {_COUNT.format('p[i + 1]')} ELSE n + {_COUNT.format('p[i + 1]')} END FROM walk WHERE i < len(p)),
 kids AS (SELECT id, i AS o, '(' || z[1] || ')' AS marker, {_STRIP.format('z[2]')} AS content FROM subs1 UNION ALL SELECT id, place, marker, content FROM sections UNION ALL SELECT id, part, 'part-' || part, string_agg(p[i], chr(10) || chr(10) ORDER BY i) FROM walk GROUP BY id, part),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o)::INT AS n FROM kids WHERE content <> ''),
 pieces AS (SELECT docs.*, 0 AS n, 'parent' AS level, '' AS subsection_path, text AS body FROM docs UNION ALL SELECT docs.*, n, 'child', marker, content FROM docs JOIN numbered USING (id)),
 chunked AS (SELECT 'chunk:' || id || ':' || n AS id, id AS doc_id, doc_type, level, ancestry, subsection_path, body AS text, CASE WHEN n > 0 THEN 'chunk:' || id || ':0' END AS parent_chunk_id,
  CASE WHEN n = 0 THEN coalesce((SELECT string_agg('chunk:' || k.id || ':' || k.n, ',' ORDER BY k.n) FROM numbered k WHERE k.id = pieces.id), '') ELSE '' END AS children, citation, effective_date,
  {_COUNT.format("(coalesce(ancestry, '') || chr(10) || chr(10) || coalesce(body, ''))")}::INT AS token_count, md5(coalesce(ancestry, '') || chr(10) || chr(10) || coalesce(body, '')) AS text_md5 FROM pieces)"""


_CHUNKED = _chunked(f"SELECT id, doc_type, text, {_PATHS} AS ancestry, full_citation AS citation, effective_date FROM legal_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC, deleted_at ASC NULLS LAST) = 1")
_RAW_DOCS = (
    "SELECT id, doc_type, text, '' AS ancestry, citation, effective_date FROM (SELECT 'statute:' || metadata.section AS id, 'statute' AS doc_type, text, 'Fla. Stat. § ' || metadata.section AS citation, metadata.effective_date AS effective_date, scraped_at, raw_id FROM raw_statutes WHERE metadata.section <> '' "
    "UNION ALL SELECT 'taa:' || replace(metadata.taa_number, ' ', '_'), 'taa', text, 'Fla. DOR ' || metadata.taa_number, metadata.issue_date, scraped_at, raw_id FROM raw_taas WHERE metadata.taa_number <> '') QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC, raw_id DESC) = 1"
)


def _found(kind: str, pattern: str, normal: str, section: str, groups: int, name: str) -> str:
    """CTE ``name``: matches of a pattern in ``clean``, with their places; first of each normal form."""
    quoted = pattern.replace("'", "''")
    g = ", ".join(f"coalesce(regexp_extract_all(t, '{quoted}', {i})[i], '') AS g{i}" for i in range(1, groups + 1))
    return f"""{name}0 AS (SELECT id, t, unnest(regexp_extract_all(t, '{quoted}')) AS raw, generate_subscripts(regexp_extract_all(t, '{quoted}'), 1) AS i FROM clean),
 {name}1 AS (SELECT *, {g}, regexp_split_to_array(t, '{quoted}')[i] AS pre FROM {name}0), {name}2 AS (SELECT *, sum(length(pre)) OVER w + coalesce(sum(length(raw)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM {name}1 WINDOW w AS (PARTITION BY id ORDER BY i)),
 {name} AS (SELECT id, '{kind}' AS kind, {normal} AS normalized, {section} AS section, substr(t, greatest(place - {citations.WINDOW}, 0)::INT + 1, (place + length(raw) + {citations.WINDOW} - greatest(place - {citations.WINDOW}, 0))::INT) AS context FROM {name}2 QUALIFY row_number() OVER (PARTITION BY id, {normal} ORDER BY i) = 1)"""


_TWO = "CASE WHEN g1 <> '' THEN g1 ELSE g3 END", "lower(CASE WHEN g1 <> '' THEN g2 ELSE g4 END)"
_CASE_KEY = "lower(replace(replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '. ', ' '), '.', ''))"
_WHEN = " ".join(f"WHEN {'true' if k is None else f'doc_type = {chr(39)}{k}{chr(39)}'} AND regexp_matches(lower(context), '{w}') THEN '{r}'" for k, w, r in T.RELATIONS)
#: CTEs from ``ch`` (id, doc_id, doc_type, text, citation) to ``graph``.
_GRAPH = f"""clean AS (SELECT id, regexp_replace(text, 's\\.\\s*\\n\\s*', 's. ', 'g') AS t FROM ch WHERE text IS NOT NULL),
 {_found('statute', T.STATUTE, f'{_TWO[0]} || {_TWO[1]}', _TWO[0], 4, 'fs')}, {_found('rule', T.RULE, f'upper({_TWO[0]}) || {_TWO[1]}', f'upper({_TWO[0]})', 4, 'fr')},
 {_found('case', T.CASE + r"(?:\s*,\s*\d+)?(?:\s*\(([^)]+?)\s*(\d{4})\))?", "g1 || ' ' || g2 || ' ' || g3", 'NULL', 3, 'fc')}, {_found('case', T.LEXIS, "g1 || ' ' || g2 || ' ' || g3", 'NULL', 3, 'fl')},
 {_found('chapter', T.CHAPTER + r"(?:\s*[-–]\s*(\d{1,3}))?", "'chapter ' || g1 || CASE WHEN g2 <> '' THEN '-' || g2 ELSE '' END", 'g1', 2, 'fh')},
 every AS (SELECT * FROM fs UNION ALL SELECT * FROM fr UNION ALL SELECT * FROM fc UNION ALL SELECT * FROM fl UNION ALL SELECT * FROM fh),
 own AS (SELECT every.*, doc_id, CASE {_WHEN} ELSE 'cites' END AS relation_type FROM every JOIN ch USING (id) WHERE NOT (kind IN ('statute', 'rule') AND section = regexp_replace(doc_id, '^[^:]*:', ''))),
 idx AS (SELECT doc_id AS target, coalesce(min(id) FILTER (ends_with(id, ':0')), min(id)) AS chunk, max(CASE WHEN doc_type = 'case' AND contains(citation, ',') THEN {_CASE_KEY.format("regexp_extract(citation, '^[^,]*,(.*)$', 1)")} END) AS case_key FROM ch GROUP BY 1),
 cases AS (SELECT case_key, max(target) AS target, max_by(chunk, target) AS chunk FROM idx WHERE case_key IS NOT NULL GROUP BY 1),
 graph AS (SELECT own.id, own.doc_id, kind, normalized, relation_type, context, coalesce(a.target, c.target) AS target_doc_id, coalesce(a.chunk, c.chunk) AS target_chunk_id, CASE WHEN a.target IS NOT NULL THEN 1.0 WHEN c.target IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence
  FROM own LEFT JOIN idx a ON kind IN ('statute', 'rule') AND a.target = kind || ':' || section LEFT JOIN cases c ON kind = 'case' AND c.case_key = {_CASE_KEY.format('normalized')})"""
_T = "token_count"

SQL = {
    "normalize_statutes": "SELECT raw_id, 'statute:' || metadata.section AS id, coalesce(nullif(metadata.section_name, ''), 'Section ' || metadata.section) AS title, 'Fla. Stat. § ' || metadata.section AS full_citation, metadata.effective_date AS effective_date, CASE WHEN metadata.chapter <> 0 THEN 'statute:chapter_' || metadata.chapter END AS parent_id FROM raw_statutes WHERE metadata.section <> ''",
    "normalize_taas": "SELECT raw_id, 'taa:' || replace(metadata.taa_number, ' ', '_') AS id, coalesce(nullif(metadata.title, ''), 'TAA ' || metadata.taa_number) AS title, 'Fla. DOR ' || metadata.taa_number AS full_citation, metadata.issue_date AS effective_date, coalesce(len(metadata.statutes_cited), 0)::INT AS n_statutes, coalesce(len(metadata.rules_cited), 0)::INT AS n_rules FROM raw_taas WHERE metadata.taa_number <> ''",
    "consolidated_counts": f"SELECT doc_type, count(*) AS n FROM ({_STAT_DOCS} UNION ALL {_TAA_DOCS}) GROUP BY ROLLUP (doc_type)",
    "consolidated_latest": f"SELECT id, doc_type, raw_id, title, scraped_at FROM ({_STAT_DOCS} UNION ALL {_TAA_DOCS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC, raw_id DESC) = 1",
    "corpus_counts": "SELECT doc_type, count(*) AS n FROM legal_documents GROUP BY ROLLUP (doc_type)",
    "length_by_type": "SELECT doc_type, count(*) AS n, floor(sum(length(text)) / count(*))::BIGINT AS avg_length, min(length(text))::INT AS min_length, max(length(text))::INT AS max_length, sum(len(cites_statutes))::BIGINT AS n_cites_statutes, sum(len(cites_rules))::BIGINT AS n_cites_rules FROM legal_documents GROUP BY doc_type",
    "chunk_bins": f"SELECT level, doc_type, count(*) AS n, round(avg({_T}), 6) AS avg_tokens, min({_T}) AS min_tokens, max({_T}) AS max_tokens, "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}, floor(count(*) FILTER ({c}) * 100 / greatest(count({_T}), 1))::BIGINT AS pct_{n}" for n, c in (("lt_500", f"{_T} < 500"), ("lt_1000", f"{_T} >= 500 AND {_T} < 1000"), ("lt_2000", f"{_T} >= 1000 AND {_T} < 2000"), ("ge_2000", f"{_T} >= 2000")))
    + " FROM legal_chunks GROUP BY level, doc_type",
    "audit_issues": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY metadata.section ORDER BY raw_id) > 1 AS dup FROM raw_statutes) SELECT issue, chapter, count(*) AS n FROM (SELECT metadata.chapter AS chapter, unnest(list_filter(["
    "CASE WHEN coalesce(metadata.chapter_name, '') = '' THEN 'missing_chapter_name' END, CASE WHEN metadata.effective_date IS NULL THEN 'missing_date' END, "
    "CASE WHEN metadata.effective_date IS NOT NULL AND NOT (year(metadata.effective_date) BETWEEN 1800 AND 2100) THEN 'implausible_date' END, CASE WHEN length(text) < 50 THEN 'short_text' END, "
    "CASE WHEN coalesce(len(metadata.history), 0) = 0 THEN 'missing_history' END, CASE WHEN dup THEN 'duplicate_id' END, CASE WHEN contains(text, chr(65533)) THEN 'replacement_character' END], lambda x: x IS NOT NULL)) AS issue FROM r) GROUP BY issue, chapter",
    "chapter_rollup": r"WITH s AS (SELECT DISTINCT metadata.chapter AS chapter, metadata.section AS section FROM raw_statutes WHERE metadata.section <> '') SELECT chapter, count(*) OVER (PARTITION BY chapter) AS n_sections, row_number() OVER (PARTITION BY chapter ORDER BY list_transform(string_split(section, '.'), lambda x: TRY_CAST(x AS INT)), section)::INT AS position, section FROM s",
    "ancestry_paths": "SELECT DISTINCT id, CASE doc_type WHEN 'statute' THEN concat_ws(' > ', 'Florida Statutes', 'Chapter ' || nullif(metadata['chapter'], ''), replace(full_citation, 'Fla. Stat. ', '')) WHEN 'rule' THEN concat_ws(' > ', 'Florida Administrative Code', 'Chapter ' || nullif(metadata['chapter'], ''), replace(full_citation, 'Fla. Admin. Code R. ', 'Rule ')) WHEN 'taa' THEN concat_ws(' > ', 'Florida DOR Technical Assistance Advisements', nullif(metadata['tax_type'], ''), replace(full_citation, 'Fla. DOR ', '')) WHEN 'case' THEN concat_ws(' > ', 'Florida Case Law', nullif(metadata['tax_type'], ''), title) ELSE full_citation END AS ancestry FROM legal_documents",
    "version_in_force": f"SELECT id, effective_date, scraped_at FROM legal_documents WHERE effective_date <= DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY effective_date DESC, scraped_at DESC NULLS LAST) = 1",
    "encoding_flags": r"SELECT flags, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN contains(text, chr(65533)) THEN 'replacement' END, CASE WHEN regexp_matches(text, '\x00') THEN 'nul' END, CASE WHEN regexp_matches(text, '[\x01-\x08\x0b\x0c\x0e-\x1f]') THEN 'control' END) AS flags FROM raw_taas) WHERE flags <> '' GROUP BY flags",
    "html_clean": f"SELECT raw_id, md5({_html('text')}) AS clean_md5 FROM raw_taas",
    "whitespace_norm": f"SELECT doc_id, md5({_space('text')}) AS clean_md5 FROM documents",
    "dates_extract": "SELECT raw_id, array_to_string(list_transform(list_sort(list_distinct(list_filter(list_concat("
    + f"list_transform(regexp_extract_all(text, '((?:{'|'.join(T.MONTHS)}) \\d{{1,2}}, \\d{{4}})', 1), lambda x: try_strptime(x, '%B %d, %Y')::DATE), "
    + r"list_transform(regexp_extract_all(text, '(\d{4}-\d{2}-\d{2})', 1), lambda x: try_strptime(x, '%Y-%m-%d')::DATE), "
    + r"list_transform(regexp_extract_all(text, '(\d{1,2}/\d{1,2}/\d{4})', 1), lambda x: try_strptime(x, '%m/%d/%Y')::DATE)), lambda x: x IS NOT NULL))), lambda x: strftime(x, '%Y-%m-%d')), ',') AS dates FROM raw_taas",
    "iso_dates": "SELECT raw_id, scraped_at::DATE AS day FROM raw_statutes",
    "cite_statutes": f"SELECT raw_id, {_either(_ST)} AS cited FROM raw_taas",
    "cite_rules": f"SELECT doc_id, {_either(_RU, 'upper')} AS cited FROM documents",
    "cite_cases_chapters": r"SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(full_citation, '(?i)(\d{1,4})\s+(So\.\s*[23]d|Fla\.\s*L\.\s*Weekly(?:\s*Supp\.)?|Fla\.)\s+(\d{1,5})', 1), regexp_extract_all(full_citation, '(?i)(\d{1,4})\s+(So\.\s*[23]d|Fla\.\s*L\.\s*Weekly(?:\s*Supp\.)?|Fla\.)\s+(\d{1,5})', 2), regexp_extract_all(full_citation, '(?i)(\d{1,4})\s+(So\.\s*[23]d|Fla\.\s*L\.\s*Weekly(?:\s*Supp\.)?|Fla\.)\s+(\d{1,5})', 3)), lambda m: m[1] || ' ' || m[2] || ' ' || m[3]))), '|') AS cases, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)(?:chapters?|ch\.)\s+(\d{1,3})', 1))), '|') AS chapters FROM legal_documents",
    "citation_forms": rf"SELECT DISTINCT c, {_NORMAL} AS normal, regexp_replace({_NORMAL}, '\([^)]*\)', '', 'g') AS base, CASE WHEN regexp_matches(c, '(?i)v\.\s+\w+|vs\.\s+\w+') THEN 'case' WHEN contains(lower(c), 'taa') OR contains(lower(c), 'technical assistance') THEN 'taa' WHEN contains(c, '§') OR contains(lower(c), 'statute') THEN 'statute' WHEN regexp_matches(c, '(?i)(?:Rule\s+|F\.?A\.?C\.?\s*R?\.?\s*)[\dA-Za-z.-]+') OR contains(lower(c), 'f.a.c') THEN 'rule' ELSE 'unknown' END AS kind, {_SECTION} AS section FROM ({_CITED}) WHERE c IS NOT NULL",
    "chunk_subsections": rf"WITH x AS (SELECT raw_id, regexp_extract_all(text, '\n\((\d+)\)\n', 1) AS m, regexp_split_to_array(text, '\n\(\d+\)\n')[2:] AS p FROM raw_statutes), y AS (SELECT raw_id, unnest(list_zip(m, p)) AS z, generate_subscripts(m, 1) AS i FROM x), w AS (SELECT raw_id, i, '(' || z[1] || ')' AS marker, {_STRIP.format('z[2]')} AS content FROM y) SELECT raw_id, (row_number() OVER (PARTITION BY raw_id ORDER BY i) - 1)::INT AS pos, marker, md5(content) AS content_md5 FROM w WHERE content <> ''",
    "chunk_sections_taa": f"WITH {_sections('raw_taas', 'raw_id')} SELECT raw_id, (row_number() OVER (PARTITION BY raw_id ORDER BY place) - 1)::INT AS pos, marker, md5(content) AS content_md5 FROM sections WHERE content <> ''",
    "chunk_corpus": _CHUNKED + " SELECT id, doc_id, level, ancestry, subsection_path, parent_chunk_id, children, citation, effective_date, token_count, text_md5 FROM chunked",
    "citation_graph": "WITH ch AS (SELECT id, any_value(doc_id) AS doc_id, any_value(doc_type) AS doc_type, any_value(text) AS text, any_value(citation) AS citation FROM legal_chunks GROUP BY id), " + _GRAPH + " SELECT id AS source_chunk_id, doc_id AS source_doc_id, kind, normalized, relation_type, target_doc_id, target_chunk_id, confidence FROM graph",
    "citation_report": "WITH ch AS (SELECT id, any_value(doc_id) AS doc_id, any_value(doc_type) AS doc_type, any_value(text) AS text, any_value(citation) AS citation FROM legal_chunks GROUP BY id), " + _GRAPH + " SELECT kind, ch.doc_type AS source_doc_type, count(target_doc_id) AS n_resolved, count(*) FILTER (target_doc_id IS NULL) AS n_unresolved FROM graph JOIN ch USING (id) GROUP BY 1, 2",
    "resolve_tiers": f"WITH cited AS (SELECT c, count(*) AS n, {_SECTION} AS section FROM ({_CITED}) WHERE c IS NOT NULL GROUP BY c), idx AS (SELECT doc_id, coalesce(min(id) FILTER (ends_with(id, ':0')), min(id)) AS parent_chunk FROM legal_chunks GROUP BY doc_id) SELECT c, n, section, coalesce(a.doc_id, b.doc_id) AS target_doc_id, coalesce(a.parent_chunk, b.parent_chunk) AS target_chunk_id, CASE WHEN a.doc_id IS NOT NULL THEN 1.0 WHEN b.doc_id IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence FROM cited LEFT JOIN idx a ON a.doc_id = 'statute:' || section LEFT JOIN idx b ON contains(section, '(') AND b.doc_id = 'statute:' || split_part(section, '(', 1)",
    "edges_once": f"SELECT edge_id, source_doc_id, target_doc_id, relation_type, loaded_at FROM ({_ONCE})",
    "edges_dedupe": f"SELECT source_doc_id, target_doc_id, relation_type, confidence, edge_id FROM ({_ONCE}) WHERE target_doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_doc_id, target_doc_id, relation_type ORDER BY confidence DESC, edge_id) = 1",
    "edge_bands": "WITH r AS (SELECT relation_type, lower(trim(split_part(source_doc_id, ':', 1))) AS s, lower(trim(split_part(target_doc_id, ':', 1))) AS t, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS b FROM resolved_edges) SELECT 'relation' AS \"by\", relation_type AS value, count(*) AS n FROM r GROUP BY relation_type UNION ALL SELECT 'source', s, count(*) FROM r GROUP BY s UNION ALL SELECT 'target', t, count(*) FROM r GROUP BY t UNION ALL SELECT 'band', b, count(*) FROM r GROUP BY b",
    "edges_confident": "SELECT relation_type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM resolved_edges WHERE confidence >= 0.5 GROUP BY relation_type",
}

#: SQL of the whole ingestion, for ``plans``.
INGEST_EDGES = (
    _chunked(_RAW_DOCS) + ", ch AS (SELECT id, doc_id, doc_type, text, citation FROM chunked), " + _GRAPH
    + " SELECT doc_id AS source_doc_id, target_doc_id, relation_type, confidence FROM graph WHERE target_doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, target_doc_id, relation_type ORDER BY confidence DESC, id) = 1"
)
