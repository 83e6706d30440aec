"""Queries of acquisition parsing and of answers with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import acquire as Q
from statloom.functions import text as T
from statloom.operators import answers as A
from statloom.operators import evaluation as E
from statloom.session import table


def history_years(spark, d):
    note = Q.body_and_history(F.col("text"))[1]
    return table(spark, d, "raw_statutes").select("raw_id", F.array_join(F.transform(Q.history_years(note), lambda y: y.cast("string")), ",").alias("years"))


def statute_bodies(spark, d):
    body, note = Q.body_and_history(F.col("text"))
    return table(spark, d, "raw_statutes").select("raw_id", F.length(body).alias("body_length"), F.length(note).alias("note_length"))


def taa_fields(spark, d):
    t = table(spark, d, "raw_taas").where("pdf_path is not null")
    n = Q.taa_number(F.col("pdf_path"))
    return t.select("raw_id", n.alias("number"), Q.tax_code(n).alias("code"), Q.tax_name(Q.tax_code(n)).alias("tax_type"), Q.subject(F.col("text")).alias("subject"), F.array_join(Q.topics(Q.subject(F.col("text"))), ",").alias("topics"))


def taa_dates(spark, d):
    return table(spark, d, "raw_taas").select("raw_id", Q.issue_date(F.col("text")).alias("issued"))


def chapter_paths(spark, d):
    c = F.col("metadata.chapter")
    return table(spark, d, "raw_statutes").select(c.alias("chapter"), Q.chapter_path(c).alias("path"), Q.roman(F.col("metadata.title_number")).alias("title")).distinct()


def _answers(spark, d) -> DataFrame:
    cites = F.filter("metadata.statutes_cited", lambda c: c.isNotNull() & (F.trim(c) != ""))
    parts = F.transform(cites, lambda c: F.concat(F.lit("The charge is taxable under that section. [Source: "), F.trim(c), F.lit("]")))
    return table(spark, d, "raw_taas").select("raw_id", F.array_join(parts, " ").alias("answer"))


def answer_sources(spark, d):
    return _answers(spark, d).select("raw_id", F.posexplode(T.cited_sources(F.col("answer"))).alias("position", "source")).select("raw_id", "position", "source", T.citation_kind(F.col("source")).alias("kind"))


def _chunks(spark, d) -> DataFrame:
    docs = table(spark, d, "graph_documents").groupBy("id").agg(F.min("full_citation").alias("citation"), F.min("section").alias("section"))
    cited = table(spark, d, "raw_taas").select("raw_id", F.explode(F.array_distinct(F.transform(F.filter("metadata.statutes_cited", lambda c: c.isNotNull()), lambda c: F.regexp_extract(c, r"(\d+\.\d+)", 1)))).alias("section")).where("section <> ''")
    rows = cited.join(docs.where("section is not null"), "section").select("raw_id", F.col("id").alias("doc_id"), F.concat(F.lit("chunk:"), "id", F.lit(":0")).alias("chunk_id"), "citation")
    from pyspark.sql import Window

    return rows.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("raw_id").orderBy("chunk_id")))


def answer_claims(spark, d):
    found = A.claims(_answers(spark, d), "raw_id")
    return A.source_texts(found, _chunks(spark, d), "raw_id").select("raw_id", "position", "source", "source_chunk_id")


def citation_verify(spark, d):
    cited = _answers(spark, d).select("raw_id", F.posexplode(T.cited_sources(F.col("answer"))).alias("position", "citation_text"))
    return A.verified_citations(cited, _chunks(spark, d), "raw_id").select("raw_id", "position", "citation_text", "chunk_id", "verified")


def simple_corrections(spark, d):
    finding = lambda a, b, s: F.struct(F.lit(a).alias("claim_text"), F.lit(b).alias("suggested_correction"), F.lit(s).alias("severity"))
    h = F.array(finding("taxable", "exempt", 0.2), finding("charge", "fee", 0.7), finding("absent words", "x", 0.1))
    r = A.simple_corrections(F.col("answer"), h)
    return _answers(spark, d).select("raw_id", r.alias("r")).select("raw_id", "r.text", "r.corrected", F.round(A.confidence_change(F.col("r.corrected")), 6).alias("delta"))


def context_lengths(spark, d):
    c = _chunks(spark, d).withColumn("doc_type", F.lit("statute")).withColumn("effective_date", F.lit(None).cast("date")).withColumn("ancestry", F.lit("")).withColumn("text", F.col("doc_id"))
    return A.context_block(c, "raw_id").select("raw_id", F.md5("context").alias("context_md5"))


def model_replies(spark, d):
    r = A.reply(A.offline(F.col("answer")))
    return _answers(spark, d).select("raw_id", r["overall_accuracy"].alias("accuracy"), F.size(r["hallucinations"]).alias("findings"))


def agent_routes(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.pmod("event_id", F.lit(3)).alias("n_results"), (F.pmod("event_id", F.lit(4)) == 0).alias("needs_more"), F.pmod("event_id", F.lit(5)).alias("iteration"), (F.pmod("event_id", F.lit(2)) == 0).alias("passed"),
        (F.pmod("event_id", F.lit(7)) == 0).alias("needs_regeneration"), (F.pmod("event_id", F.lit(3)) == 0).alias("needs_correction"), F.pmod("event_id", F.lit(4)).alias("attempts"), (F.pmod("event_id", F.lit(100)) / 100).alias("confidence"), (F.pmod("event_id", F.lit(6)) == 0).alias("complex"),
    )
    return A.routes(e).groupBy("expand_graph", "after_check", "after_validation", "skip_validation").agg(F.count("*").alias("n"))


def score_classes(spark, d):
    v = F.pmod("event_id", F.lit(100)) / 100
    return table(spark, d, "events").groupBy(E.score_class(v).alias("class"), E.confidence_label(v).alias("label")).agg(F.count("*").alias("n"))


_F = (history_years, statute_bodies, taa_fields, taa_dates, chapter_paths, answer_sources, answer_claims, citation_verify, simple_corrections, context_lengths, model_replies, agent_routes, score_classes)
QUERIES = {f.__name__: f for f in _F}

_MONTHS = "|".join(T.MONTHS)
_NAMES = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.TAX_TYPES.items()) + " WHEN '' THEN 'Unknown' ELSE 'Unknown (' || code || ')' END"
_ANS = "ans AS (SELECT raw_id, list_transform(list_filter(metadata.statutes_cited, lambda c: c IS NOT NULL AND trim(c) <> ''), lambda c: trim(c)) AS src, array_to_string(list_transform(list_filter(metadata.statutes_cited, lambda c: c IS NOT NULL AND trim(c) <> ''), lambda c: 'The charge is taxable under that section. [Source: ' || trim(c) || ']'), ' ') AS answer FROM raw_taas)"
_CHK = r"ck AS (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT c.raw_id, g.id AS doc_id, 'chunk:' || g.id || ':0' AS chunk_id, citation FROM (SELECT raw_id, unnest(list_distinct(list_transform(list_filter(metadata.statutes_cited, lambda c: c IS NOT NULL), lambda c: regexp_extract(c, '(\d+\.\d+)', 1)))) AS section FROM raw_taas) c JOIN (SELECT id, min(full_citation) AS citation, min(section) AS section FROM graph_documents GROUP BY id) g ON g.section = c.section WHERE c.section <> ''))"
_SRC = "s AS (SELECT raw_id, unnest(src) AS source, generate_subscripts(src, 1) - 1 AS position FROM ans)"
_SEC = (
    r"coalesce(nullif(regexp_extract({0}, '(?i)(?:Fla\.?\s*Stat\.?\s*)?§\s*([\d.]+(?:\([^)]+\))*)', 1), ''), "
    r"nullif(regexp_extract({0}, '(?i)(?:Rule\s+|F\.?A\.?C\.?\s*R?\.?\s*)([\dA-Za-z.-]+)', 1), ''), nullif(regexp_extract({0}, '(\d+\.\d+(?:\([^)]+\))*)', 1), ''))"
)
_HIST = "(CASE WHEN contains(text, 'History.') THEN substr(text, instr(text, 'History.')) ELSE '' END)"

SQL = {
    "history_years": rf"SELECT raw_id, array_to_string(list_transform(list_sort(list_distinct(list_filter(list_concat(list_transform(list_concat(regexp_extract_all(h, 'ch\.\s*\d+,\s*(\d{{4}})', 1), list_concat(regexp_extract_all(h, 'ch\.\s*(\d{{4}})-\d+', 1), regexp_extract_all(h, ',\s*(\d{{4}})\.', 1))), lambda y: y::INT), list_transform(regexp_extract_all(h, 'ch\.\s*(\d{{2}})-\d+', 1), lambda y: CASE WHEN y::INT <= 29 THEN 2000 ELSE 1900 END + y::INT)), lambda y: y BETWEEN 1800 AND 2100))), lambda y: y::VARCHAR), ',') AS years FROM (SELECT raw_id, {_HIST} AS h FROM raw_statutes)",
    "statute_bodies": rf"SELECT raw_id, length(regexp_replace(CASE WHEN contains(text, 'History.') THEN substr(text, 1, instr(text, 'History.') - 1) ELSE text END, '\s+$', ''))::INT AS body_length, length({_HIST})::INT AS note_length FROM raw_statutes",
    "taa_fields": rf"WITH a AS (SELECT raw_id, text, 'TAA ' || trim(regexp_replace(replace(regexp_replace(regexp_replace(pdf_path, '^.*/', ''), '(?i)\.pdf$', ''), '%20', ' '), '(?i)^TAA', '')) AS number FROM raw_taas WHERE pdf_path IS NOT NULL), b AS (SELECT *, upper(regexp_extract(number, '(?i)TAA\s*\d{{2}}([A-Z])', 1)) AS code, regexp_replace(trim(coalesce(nullif(regexp_extract(substr(text, 1, 3000), '(?:Re|RE|Subject)[:\s]+([^\n]+)', 1), ''), nullif(regexp_extract(substr(text, 1, 3000), '(?:SUBJECT|MATTER)[:\s]+([^\n]+)', 1), ''), '')), '\s*[-–]\s*TAA.*$', '') AS s0 FROM a), c AS (SELECT *, CASE WHEN length(s0) > 10 THEN s0 ELSE '' END AS subject FROM b) SELECT raw_id, number, code, {_NAMES} AS tax_type, subject, array_to_string(list_transform(list_slice(list_filter([{', '.join(repr(t) for t in Q.TOPICS)}], lambda t: contains(lower(subject), t)), 1, 5), lambda t: array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || w[2:]), ' ')), ',') AS topics FROM c",
    "taa_dates": rf"SELECT raw_id, coalesce(try_strptime(regexp_replace(replace(coalesce(nullif(regexp_extract(h, '(?i)(?:Date|Dated|Issued)[:\s]+((?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})', 1), ''), nullif(regexp_extract(h, '(?i)((?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})', 1), '')), ',', ''), '\s+', ' ', 'g'), '%B %d %Y')::DATE, try_strptime(nullif(regexp_extract(h, '(\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1), ''), '%m/%d/%Y')::DATE) AS issued FROM (SELECT raw_id, substr(text, 1, 2000) AS h FROM raw_taas)",
    "chapter_paths": "SELECT DISTINCT metadata.chapter AS chapter, lpad(((metadata.chapter // 100) * 100)::VARCHAR, 4, '0') || '-' || lpad(((metadata.chapter // 100) * 100 + 99)::VARCHAR, 4, '0') || '/' || lpad(metadata.chapter::VARCHAR, 4, '0') AS path, repeat('X', metadata.title_number // 10) || CASE metadata.title_number % 10 WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' WHEN 9 THEN 'IX' ELSE '' END AS title FROM raw_statutes",
    "answer_sources": rf"WITH {_ANS}, {_SRC} SELECT raw_id, position::INT AS position, source, CASE WHEN regexp_matches(source, '(?i)v\.\s+\w+|vs\.\s+\w+') THEN 'case' WHEN contains(lower(source), 'taa') OR contains(lower(source), 'technical assistance') THEN 'taa' WHEN contains(source, '§') OR contains(lower(source), 'statute') THEN 'statute' WHEN regexp_matches(source, '(?i)(?:Rule\s+|F\.?A\.?C\.?\s*R?\.?\s*)[\dA-Za-z.-]+') OR contains(lower(source), 'f.a.c') THEN 'rule' ELSE 'unknown' END AS kind FROM s",
    "answer_claims": f"WITH {_ANS}, {_SRC}, {_CHK}, nm AS (SELECT raw_id, name, max_by(chunk_id, rank) AS c FROM (SELECT raw_id, unnest(list_distinct([chunk_id, doc_id, citation])) AS name, chunk_id, rank FROM ck) WHERE name <> '' GROUP BY 1, 2), hd AS (SELECT s.raw_id, s.position, min_by(doc_id, rank) AS name FROM s JOIN ck ON ck.raw_id = s.raw_id WHERE contains(citation, source) OR contains(doc_id, source) GROUP BY 1, 2) SELECT s.raw_id, s.position::INT AS position, source, coalesce(a.c, b.c, e.c, h.c) AS source_chunk_id FROM s LEFT JOIN hd ON hd.raw_id = s.raw_id AND hd.position = s.position LEFT JOIN nm h ON h.raw_id = s.raw_id AND h.name = hd.name LEFT JOIN nm a ON a.raw_id = s.raw_id AND a.name = source LEFT JOIN nm b ON b.raw_id = s.raw_id AND b.name = 'statute:' || source LEFT JOIN nm e ON e.raw_id = s.raw_id AND e.name = 'rule:' || source",
    "citation_verify": rf"WITH {_ANS}, {_SRC}, {_CHK}, x AS (SELECT *, {_SEC.format('source')} AS sec FROM s), k AS (SELECT *, {_SEC.format('citation')} AS csec FROM ck), m AS (SELECT x.raw_id, position, min_by(chunk_id, rank) AS chunk_id FROM x JOIN k ON k.raw_id = x.raw_id WHERE contains(lower(citation), lower(source)) OR contains(csec, sec) OR (regexp_extract(sec, '^([\d.]+)', 1) <> '' AND (regexp_extract(sec, '^([\d.]+)', 1) = regexp_extract(csec, '^([\d.]+)', 1) OR contains(chunk_id, regexp_extract(sec, '^([\d.]+)', 1)))) OR contains(chunk_id, sec) GROUP BY 1, 2) SELECT x.raw_id, x.position::INT AS position, source AS citation_text, m.chunk_id, m.chunk_id IS NOT NULL AS verified FROM x LEFT JOIN m ON m.raw_id = x.raw_id AND m.position = x.position",
    "simple_corrections": f"WITH {_ANS} SELECT raw_id, CASE WHEN contains(answer, 'taxable') THEN substr(answer, 1, instr(answer, 'taxable') - 1) || 'exempt' || substr(answer, instr(answer, 'taxable') + 7) ELSE answer END AS text, contains(answer, 'taxable')::INT AS corrected, round(greatest(-0.1 * contains(answer, 'taxable')::INT, -0.3), 6)::DOUBLE AS delta FROM ans",
    "context_lengths": f"WITH {_CHK} SELECT raw_id, md5(string_agg('--- Document ' || rank || ' (STATUTE) ---' || chr(10) || 'Citation: ' || citation || chr(10) || 'Effective Date: Not specified' || chr(10) || 'Ancestry: ' || chr(10) || chr(10) || doc_id, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM ck WHERE rank <= 10 GROUP BY raw_id",
    "model_replies": f"WITH {_ANS} SELECT raw_id, round((length(answer) % 100) / 100, 2)::DOUBLE AS accuracy, 0 AS findings FROM ans",
    "agent_routes": "WITH e AS (SELECT event_id % 3 > 0 AS expand_graph, CASE WHEN event_id % 4 = 0 AND event_id % 5 < 3 THEN 'retrieve' ELSE 'synthesize' END AS after_check, CASE WHEN event_id % 2 = 0 THEN 'end' WHEN event_id % 7 = 0 AND event_id % 4 < 3 THEN 'regenerate' WHEN event_id % 3 = 0 THEN 'correct' ELSE 'end' END AS after_validation, (event_id % 100) / 100 >= 0.85 AND event_id % 6 <> 0 AS skip_validation FROM events) SELECT *, count(*) AS n FROM e GROUP BY ALL",
    "score_classes": "SELECT CASE WHEN v >= 0.9 THEN 'success' WHEN v >= 0.7 THEN 'warning' ELSE 'danger' END AS class, CASE WHEN v >= 0.8 THEN 'High' WHEN v >= 0.5 THEN 'Medium' ELSE 'Low' END AS label, count(*) AS n FROM (SELECT (event_id % 100) / 100 AS v FROM events) GROUP BY 1, 2",
}
