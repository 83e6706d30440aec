"""Queries of audits, report tables, and the steps around a model, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import text as T
from statloom.operators import answers as A
from statloom.operators import evaluation as E
from statloom.operators import generation as G
from statloom.operators import graph, reports
from statloom.operators import observe as O
from statloom.operators import retrieval as R
from statloom.queries.answers import _ANS, _answers
from statloom.queries.evaluation import _RM, _ranked
from statloom.queries.evaluation import SQL as _EVAL
from statloom.queries.graph import _CH, _E, _graph
from statloom.queries.graph import SQL as _GRAPHSQL
from statloom.queries.retrieval import SQL as _RET
from statloom.queries.retrieval import _Q, _bm25
from statloom.session import table


def audit_all(spark, d):
    docs = table(spark, d, "legal_documents")
    return reports.audit_totals(reports.audit_taas(table(spark, d, "raw_taas")), reports.audit_documents(docs, "rule"), reports.audit_documents(docs, "case"))


def count_maps(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = reports.count_map(e, ["day"], "event_type").withColumn("month", F.date_format("day", "yyyy-MM"))
    return reports.sum_maps(days, ["month"]).select("month", reports.map_text(F.col("counts")).alias("counts"))


def json_lines(spark, d):
    docs = table(spark, d, "legal_documents").select("id", "doc_type", "effective_date", "scraped_at").distinct()
    return docs.select(reports.json_rows(docs, ["id", "doc_type", "effective_date", "scraped_at"]).alias("line"))


def ids_as_citations(spark, d):
    return table(spark, d, "graph_documents").select("id", reports.citation_of(F.col("id")).alias("citation")).distinct()


def result_scores(spark, d):
    """Keyword results with a score and vector results with a distance, read as one list."""
    kw = R.bm25(table(spark, d, "documents"), R.questions(spark), "doc_id", 10).select(F.col("query_id").cast("long"), "doc_id", "score", F.lit(None).cast("double").alias("distance"))
    v = table(spark, d, "embeddings")
    vec = R.vector_top_k(v, v.where("vec_id % 20 = 0"), 10).select("query_id", F.col("vec_id").alias("doc_id"), F.lit(None).cast("double").alias("score"), (1 - F.col("score")).alias("distance"))
    both = kw.unionByName(vec)
    return both.select("query_id", "doc_id", R.result_source(F.col("distance")).alias("source"), F.round(R.result_score(F.col("score"), F.col("distance")), 6).alias("score"))


def _chunk_results(spark, d, top=10) -> DataFrame:
    chunks = table(spark, d, "legal_chunks").dropDuplicates(["id"])
    return R.bm25(chunks, R.questions(spark), "id", top)


def result_counts(spark, d):
    docs = table(spark, d, "legal_chunks").select("id", "doc_id").distinct()
    return R.result_counts(_chunk_results(spark, d, 20).join(docs, "id"), ["query_id"], "doc_id", "id")


def expand_results(spark, d):
    v, e = _graph(spark, d)
    chunks = table(spark, d, "legal_chunks").select("id", "doc_id", "level", "parent_chunk_id").distinct()
    return graph.expand_results(_chunk_results(spark, d), chunks, v, e, table(spark, d, "resolved_edges"))


def parent_chunks(spark, d):
    v, e = _graph(spark, d)
    chunks = table(spark, d, "legal_chunks").select("id", "doc_id", "level").distinct()
    return graph.parent_chunks_of(graph.related(e).select("id", "other"), chunks).select("id", "other", "chunk_id")


def structure_edges(spark, d):
    v, _ = _graph(spark, d)
    chunks = table(spark, d, "legal_chunks").select("id", "doc_id", "level", "parent_chunk_id").distinct()
    return graph.structure_edges(chunks, v)


def questions_first(spark, d):
    return R.first_questions(R.questions(spark), 5)


def load_summary(spark, d):
    e = table(spark, d, "events")
    s = O.load_summary(e, ["event_type"], "ts", F.when(F.col("value") > 90, 500).when(F.col("value") > 80, 429).otherwise(200), F.col("value") > 80)
    return s.select("event_type", "n", "per_second", "success_rate", reports.map_text(F.col("by_status")).alias("by_status"))


def errors_by_kind(spark, d):
    e = table(spark, d, "events")
    return O.errors_by_kind(e, ["event_type"], F.when(F.col("value") > 90, "service").otherwise("rate_limited"), F.col("value") > 80)


def correction_funnel(spark, d):
    from statloom.operators.evaluation import correction_action

    issues, fixed, tries = F.pmod("event_id", F.lit(5)), F.pmod("event_id", F.lit(3)), F.pmod("event_id", F.lit(2))
    action = correction_action(F.pmod("event_id", F.lit(4)) != 0, F.least(issues, fixed), F.when(issues > 3, tries).otherwise(0))
    return reports.funnel(table(spark, d, "events").select(action.alias("action")))


def issue_types(spark, d):
    """Of each advisement's topics, as kinds of issue, with their lengths as severities."""
    t = table(spark, d, "raw_taas").select(F.col("metadata.topics").alias("types"), F.transform("metadata.topics", lambda x: F.least(F.length(x), F.lit(20)) / 20).alias("severities"))
    return reports.issues_by_type(t)


def pr_curve(spark, d):
    return reports.precision_recall_curve(*_ranked(spark, d), list(range(1, 21)))


def faithfulness_bins(spark, d):
    v = F.pmod("event_id", F.lit(4))
    verdict = F.when(v == 0, "supported").when(v == 1, "partial").when(v == 2, "contradicted").otherwise("not_supported")
    return reports.score_histogram(E.faithfulness(table(spark, d, "events").select("user_id", verdict.alias("verdict")), "user_id"), "score")


def cache_rules(spark, d):
    t = table(spark, d, "raw_taas")
    keep = O.cacheable(F.col("metadata.answer"), F.length("metadata.answer") / 100)
    return t.select("raw_id", O.cache_key(F.col("metadata.question"), F.col("metadata.tax_type")).alias("cache_key"), keep.alias("keep"))


def _judge(prompt: Column) -> Column:
    """A stand-in for the model: scores from the prompt's length; every 13th finds something made up."""
    n = F.length(prompt)
    made_up = F.when(n % 13 == 0, '["an invented section"]').otherwise("[]")
    return F.when(n % 17 != 0, F.concat(F.lit('```json\n{"overall_score": '), (n % 11).cast("string"), F.lit(', "clarity": '), (n % 7).cast("string"), F.lit(', "hallucinations": '), made_up, F.lit("}\n```")))


def _judged(spark, d) -> DataFrame:
    m = lambda n: F.col(f"metadata.{n}")
    clean = lambda c: F.array_compact(F.coalesce(c, F.array().cast("array<string>")))
    t = table(spark, d, "raw_taas").select("raw_id", m("question").alias("question"), m("answer").alias("answer"), clean(m("topics")).alias("contains"), clean(m("statutes_cited")).alias("statutes"), clean(m("rules_cited")).alias("rules"))
    return G.judged(t, _judge, G.judge_prompt(F.col("question"), F.col("answer"), F.col("contains"), F.col("statutes"), F.col("rules")))


def judge_scores(spark, d):
    return _judged(spark, d).select("raw_id", "overall_score", "clarity", "correctness", F.size("hallucinations").alias("n_hallucinations"), "passed")


def _checker(prompt: Column) -> Column:
    n = F.length(prompt)
    verdict = F.when(n % 5 == 0, "SUPPORTED").when(n % 5 == 1, "PARTIALLY_SUPPORTED").when(n % 5 == 2, "CONTRADICTED").otherwise("UNSURE")
    return F.when(n % 7 == 0, "no idea").when(n % 7 == 1, '{"reasoning": "none"}').otherwise(F.concat(F.lit('Here it is: {"verdict": "'), verdict, F.lit('", "confidence": 0.9}')))


def claim_verdicts(spark, d):
    found = A.claims(_answers(spark, d), "raw_id").withColumn("source_text", F.col("source"))
    return G.claim_verdicts(found, _checker).select("raw_id", "position", "verdict", "confidence")


def _writer(prompt: Column) -> Column:
    first = F.regexp_extract(prompt, r"Citation: ([^\n]+)", 1)
    return F.concat(F.lit("It is taxable. [Source: "), first, F.lit("] It is not. [Source: § 999.99]"))


def answers_synthesized(spark, d):
    chunks = table(spark, d, "legal_chunks").dropDuplicates(["id"])
    hits = _chunk_results(spark, d).join(chunks.select("id", "doc_type", "citation", "effective_date", F.lit("").alias("ancestry"), F.lit("").alias("text")), "id").withColumnRenamed("id", "chunk_id")
    asked = R.questions(spark).unionByName(spark.createDataFrame([(99, "zzz")], "query_id int, query string"))
    return G.synthesized(asked, hits, _writer)


def corrected_answers(spark, d):
    """Findings on the citing answers: none, simple ones, grave ones, and a model that fails at times."""
    a = _answers(spark, d).where("answer <> ''")
    n = F.length("answer")
    finding = F.struct(F.lit("taxable").alias("claim_text"), F.lit("exempt").alias("suggested_correction"), F.when(n % 3 == 1, 0.4).otherwise(0.8).alias("severity"))
    rows = a.select("raw_id", "answer", F.when(n % 3 == 0, F.array().cast("array<struct<claim_text:string,suggested_correction:string,severity:double>>")).otherwise(F.array(finding)).alias("findings"), F.lit("").alias("context"))
    fixed = G.corrected(rows, lambda p: F.when(F.length(p) % 2 == 0, F.lit("A corrected answer.")))
    return fixed.select("raw_id", "how", F.md5("corrected_answer").alias("answer_md5"), "n_corrected", F.round("confidence_change", 6).alias("confidence_change"))


def run_report(spark, d):
    from statloom.queries.evaluation import answer_contains, citation_scores

    j = _judged(spark, d).where("trim(answer) <> ''")
    latency = table(spark, d, "raw_taas").select("raw_id", F.length("text").alias("latency"))
    results = j.join(citation_scores(spark, d), "raw_id").join(answer_contains(spark, d).withColumnRenamed("share", "contains_share"), "raw_id").join(latency, "raw_id").drop("contains").withColumnRenamed("contains_share", "contains")
    return G.run_report(table(spark, d, "raw_taas").select("raw_id"), results, "raw_id")


def parameter_grid(spark, d):
    """Every question with every method and weight."""
    grid = R.questions(spark).select("query_id", F.explode(F.array(*map(F.lit, ("vector", "keyword", "hybrid", "graph")))).alias("method"))
    return grid.select("*", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("alpha"))


def alpha_best(spark, d):
    from statloom.queries.retrieval import alpha_grid

    return E.best_of(alpha_grid(spark, d), "alpha", "mrr", "alpha")


def authority_report(spark, d):
    from statloom.queries.evaluation import authority_metrics
    from statloom.queries.retrieval import _results

    return E.authority_report(authority_metrics(spark, d), _results(spark, d))


def stage_averages(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("ms"))
    maps = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ms"))).alias("stages"))  # five stages
    return O.stage_averages(maps, "stages")


def comparisons(spark, d):
    from statloom.operators import agent
    from statloom.queries.evaluation import by_category_difficulty

    both = by_category_difficulty(spark, d)
    return agent.comparisons(both.where("category is not null").select("category", F.col("mrr").alias("recall")), both.where("difficulty is not null").select("difficulty", F.col("mrr").alias("recall")), -1.0)


def chunk_lookup(spark, d):
    """Two chunks by their ids, as an endpoint asks for them."""
    v, e = _graph(spark, d)
    chunks = table(spark, d, "legal_chunks").select("id", "doc_id", "level", "parent_chunk_id").distinct()
    return graph.chunk_detail(chunks, v, e, ids=LOOKUP)


LOOKUP = ["chunk:statute:212.05:0", "chunk:statute:212.05:1"]
_F = (
    parameter_grid, alpha_best, authority_report, stage_averages, comparisons, chunk_lookup, audit_all, count_maps, json_lines, ids_as_citations, result_scores, result_counts, expand_results, parent_chunks, structure_edges, questions_first, load_summary, errors_by_kind, correction_funnel, issue_types,
    pr_curve, faithfulness_bins, cache_rules, judge_scores, claim_verdicts, answers_synthesized, corrected_answers, run_report,
)
QUERIES = {f.__name__: f for f in _F}

_CKW = _bm25(10).replace("FROM documents", "FROM (SELECT id AS doc_id, any_value(text) AS text FROM legal_chunks GROUP BY id)")
_FLAGS = r"CASE WHEN contains(t, chr(65533)) THEN 'encoding:replacement' END, CASE WHEN regexp_matches(t, '\x00') THEN 'encoding:nul' END, CASE WHEN regexp_matches(t, '[\x01-\x08\x0b\x0c\x0e-\x1f]') THEN 'encoding:control' END"
_BL = lambda c: f"trim(coalesce({c}, '')) = ''"
_DOC_AUDIT = (
    "SELECT doc_type AS kind, unnest(list_filter([CASE WHEN row_number() OVER (PARTITION BY doc_type, id ORDER BY scraped_at) > 1 THEN 'duplicate_id' END, CASE WHEN length(t) < 50 THEN 'empty_or_short_text' END, "
    + ", ".join(f"CASE WHEN {_BL(c)} THEN 'missing_field:{c}' END" for c in ("title", "full_citation", "source_url"))
    + ", CASE WHEN effective_date IS NULL THEN 'no_date' END, CASE WHEN coalesce(len(cites_statutes), 0) = 0 THEN 'no_statutes_cited' END, CASE WHEN coalesce(len(cites_cases), 0) = 0 THEN 'no_cases_cited' END, "
    + _FLAGS + "], lambda x: x IS NOT NULL)) AS issue FROM (SELECT *, coalesce(text, '') AS t FROM legal_documents WHERE doc_type IN ('rule', 'case'))"
)
_LIST = lambda c: f"coalesce(nullif(array_to_string(list_filter({c}, lambda x: x IS NOT NULL), ', '), ''), 'N/A')"
_JN = "length('Question: ' || coalesce(metadata.question, '') || chr(10) || 'Expected: ' || {0} || chr(10) || 'Statutes: ' || {1} || chr(10) || 'Rules: ' || {2} || chr(10) || 'Answer: ' || coalesce(metadata.answer, ''))".format(
    _LIST("metadata.topics"), _LIST("metadata.statutes_cited"), _LIST("metadata.rules_cited")
)
_JUDGE = f"jn AS (SELECT raw_id, metadata.answer AS answer, CASE WHEN trim(coalesce(metadata.answer, '')) <> '' AND {_JN} % 17 <> 0 THEN {_JN} END AS n FROM raw_taas), jd AS (SELECT raw_id, answer, (n % 11)::DOUBLE AS overall_score, (n % 7)::DOUBLE AS clarity, CASE WHEN n IS NOT NULL THEN 0.0::DOUBLE END AS correctness, CASE WHEN n IS NULL THEN NULL WHEN n % 13 = 0 THEN 1 ELSE 0 END AS n_hallucinations FROM jn)"
_PASSED = "CASE WHEN overall_score IS NULL THEN NULL ELSE overall_score >= 7 AND n_hallucinations = 0 END"
_STATUS = "CASE WHEN value > 90 THEN '500' WHEN value > 80 THEN '429' ELSE '200' END"

SQL = {
    "parameter_grid": f"WITH {_Q} SELECT query_id, method, alpha FROM q, (SELECT unnest(['vector', 'keyword', 'hybrid', 'graph']) AS method), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha)",
    "alpha_best": f"SELECT arg_max(alpha, mrr - alpha / 1e9) AS best_alpha, max(mrr) AS best_mrr FROM ({_RET['alpha_grid']})",
    "authority_report": f"WITH m AS ({_EVAL['authority_metrics']}), r AS (WITH {_bm25(20)} SELECT coalesce(doc_type, 'other') AS t FROM kw JOIN documents USING (doc_id)) SELECT round(avg(authority_ndcg), 6) AS avg_authority_ndcg, round(avg(alignment), 6) AS avg_alignment, round(avg(primary_rate), 6) AS avg_primary_rate, " + ", ".join(f"(SELECT count(*) FROM r WHERE t = '{k}') AS n_{k}" for k in E.HIERARCHY) + ", (SELECT count(*) FROM r WHERE t NOT IN ('statute', 'rule', 'case', 'taa')) AS n_other FROM m",
    "stage_averages": "WITH s AS (SELECT user_id, event_type AS stage, sum(value) AS ms FROM events GROUP BY 1, 2) SELECT stage, round(avg(ms), 6) AS avg, count(*) AS n, round(sum(ms) / (SELECT sum(ms) FROM s), 6) AS share FROM s GROUP BY stage",
    "comparisons": f"WITH b AS ({_EVAL['by_category_difficulty']}), c AS (SELECT category, mrr FROM b WHERE category IS NOT NULL) SELECT * FROM (SELECT 'best_category' AS kind, category::VARCHAR AS subject, mrr AS value FROM c ORDER BY mrr DESC, category LIMIT 1) UNION ALL SELECT * FROM (SELECT 'worst_category', category::VARCHAR, mrr FROM c ORDER BY mrr, category LIMIT 1) UNION ALL SELECT 'difficulty_drop', 'hard', round(max(mrr) FILTER (difficulty = 'easy') - max(mrr) FILTER (difficulty = 'hard'), 6) FROM b",
    "chunk_lookup": f"SELECT * FROM ({_GRAPHSQL['chunk_detail']}) WHERE id IN ('{LOOKUP[0]}', '{LOOKUP[1]}')",
    "audit_all": "WITH i AS (SELECT 'taa' AS kind, unnest(list_filter([CASE WHEN row_number() OVER (PARTITION BY replace(coalesce(metadata.taa_number, ''), ' ', '_') ORDER BY raw_id) > 1 THEN 'duplicate_id' END, CASE WHEN length(t) < 50 THEN 'empty_or_short_text' END, "
    + ", ".join(f"CASE WHEN {_BL('metadata.' + c)} THEN 'missing_field:{c}' END" for c in ("taa_number", "title"))
    + ", CASE WHEN coalesce(len(metadata.statutes_cited), 0) = 0 THEN 'no_statutes_cited' END, CASE WHEN coalesce(len(metadata.rules_cited), 0) = 0 THEN 'no_rules_cited' END, "
    + _FLAGS + "], lambda x: x IS NOT NULL)) AS issue FROM (SELECT *, coalesce(text, '') AS t FROM raw_taas) UNION ALL " + _DOC_AUDIT + ") SELECT kind, issue, count(*)::BIGINT AS n FROM i GROUP BY ROLLUP (kind, issue)",
    "count_maps": "WITH c AS (SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT month, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM c GROUP BY month",
    "json_lines": """SELECT DISTINCT '{"id":' || to_json(id) || ',"doc_type":' || to_json(doc_type) || ',"effective_date":' || coalesce('"' || strftime(effective_date, '%Y-%m-%d') || '"', 'null') || ',"scraped_at":"' || strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') || '"}' AS line FROM (SELECT DISTINCT id, doc_type, effective_date, scraped_at FROM legal_documents)""",
    "ids_as_citations": "SELECT DISTINCT id, CASE WHEN contains(id, ':') THEN substr(id, instr(id, ':') + 1) ELSE id END AS citation FROM graph_documents",
    "result_scores": f"WITH {_bm25(10)}, vec AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 10) SELECT query_id, doc_id, 'keyword' AS source, round(score, 6) AS score FROM kw UNION ALL SELECT query_id, doc_id, 'vector', round(score, 6) FROM vec",
    "result_counts": f"WITH {_CKW.replace('rank <= 10', 'rank <= 20')}, d AS (SELECT id, min(doc_id) AS document FROM legal_chunks GROUP BY id) SELECT query_id, count(DISTINCT document) AS n_documents, count(DISTINCT doc_id) AS n_chunks, count(*) AS n_results FROM kw JOIN d ON d.id = kw.doc_id GROUP BY query_id",
    "expand_results": f"WITH {_CKW}, {_E}, {_CH}, r AS (SELECT kw.query_id, kw.rank::INT AS rank, kw.doc_id AS id, ch.doc_id AS document, ch.parent_chunk_id FROM kw JOIN ch ON ch.id = kw.doc_id), near AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other)::INT AS position FROM (SELECT * FROM cited UNION SELECT * FROM citing) QUALIFY position <= 5), pc AS (SELECT doc_id AS other, min(id) AS chunk_id FROM ch WHERE lower(level) = 'parent' GROUP BY 1), cx AS (SELECT DISTINCT source_chunk_id AS id, target_doc_id FROM resolved_edges JOIN v ON v.id = target_doc_id) "
    "SELECT query_id, rank, id, 'parent' AS source, 1 AS position, parent_chunk_id AS item FROM r WHERE parent_chunk_id IN (SELECT id FROM ch) UNION ALL SELECT query_id, rank, r.id, 'context', row_number() OVER (PARTITION BY query_id, rank ORDER BY target_doc_id)::INT, target_doc_id FROM r JOIN cx ON cx.id = r.id UNION ALL SELECT query_id, rank, r.id, 'related', position, chunk_id FROM r JOIN near ON near.id = r.document JOIN pc ON pc.other = near.other",
    "parent_chunks": f"WITH {_E}, {_CH}, near AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS position FROM (SELECT * FROM cited UNION SELECT * FROM citing) QUALIFY position <= 5), pc AS (SELECT doc_id AS other, min(id) AS chunk_id FROM ch WHERE lower(level) = 'parent' GROUP BY 1) SELECT id, near.other, chunk_id FROM near JOIN pc ON pc.other = near.other",
    "structure_edges": f"WITH {_E}, {_CH} SELECT DISTINCT doc_id AS src, id AS dst, 'HAS_CHUNK' AS relation FROM ch WHERE doc_id IN (SELECT id FROM v) UNION ALL SELECT DISTINCT id, parent_chunk_id, 'CHILD_OF' FROM ch WHERE parent_chunk_id IN (SELECT id FROM ch)",
    "questions_first": f"WITH {_Q} SELECT query_id, query FROM q ORDER BY query_id LIMIT 5",
    "load_summary": f"WITH c AS (SELECT event_type, {_STATUS} AS s, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT event_type, string_agg(s || '=' || n, ',' ORDER BY s) AS by_status FROM c GROUP BY 1), g AS (SELECT event_type, count(*) AS n, round(count(*) / greatest(date_diff('microsecond', min(ts), max(ts)) / 1e6, 1), 6) AS per_second, round(1 - count(*) FILTER (value > 80) / count(*), 6) AS success_rate FROM events GROUP BY 1) SELECT g.*, by_status FROM g JOIN m USING (event_type)",
    "errors_by_kind": "WITH c AS (SELECT event_type, CASE WHEN value > 90 THEN 'service' ELSE 'rate_limited' END AS error, count(*) AS n FROM events WHERE value > 80 GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 6)::DOUBLE AS share FROM c",
    "correction_funnel": "WITH e AS (SELECT event_id % 5 AS issues, least(event_id % 5, event_id % 3) AS fixed, CASE WHEN event_id % 5 > 3 THEN event_id % 2 ELSE 0 END AS tries, event_id % 4 <> 0 AS passed FROM events), a AS (SELECT CASE WHEN fixed > 0 THEN 'corrected' WHEN tries > 0 THEN 'regenerated' WHEN passed THEN 'none' ELSE 'failed' END AS action FROM e) SELECT 0 AS position, 'total' AS stage, count(*) AS n FROM a UNION ALL SELECT 1, 'clean', count(*) FILTER (action = 'none') FROM a UNION ALL SELECT 2, 'with_issues', count(*) FILTER (action <> 'none') FROM a UNION ALL SELECT 3, 'corrected', count(*) FILTER (action = 'corrected') FROM a UNION ALL SELECT 4, 'regenerated', count(*) FILTER (action = 'regenerated') FROM a UNION ALL SELECT 5, 'unresolved', count(*) FILTER (action = 'failed') FROM a",
    "issue_types": "WITH x AS (SELECT unnest(metadata.topics) AS t FROM raw_taas) SELECT coalesce(t, 'unknown') AS issue_type, count(*) AS n, round(avg(least(length(t), 20) / 20), 6) AS avg_severity, max(least(length(t), 20) / 20) AS max_severity FROM x GROUP BY 1",
    "pr_curve": f"{_RM}, h AS (SELECT r.query_id, rank, rel.item IS NOT NULL AS hit FROM r LEFT JOIN rel ON rel.query_id = r.query_id AND rel.item = r.item), n AS (SELECT query_id, count(*) AS c FROM rel GROUP BY 1), p AS (SELECT h.query_id, k, count(*) FILTER (hit) AS hits, count(*) AS shown, any_value(c) AS c FROM h JOIN n USING (query_id), range(1, 21) t(k) WHERE rank <= k GROUP BY 1, 2) SELECT k::INT AS k, round(avg(hits / shown), 6) AS precision, round(avg(hits / c), 6) AS recall FROM p GROUP BY k",
    "faithfulness_bins": f"WITH f AS ({_EVAL['faithfulness']}), b AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n FROM f GROUP BY 1) SELECT t.bin::INT AS bin, coalesce(n, 0) AS n FROM range(10) t(bin) LEFT JOIN b USING (bin)",
    "cache_rules": r"SELECT raw_id, sha256(concat_ws('|', trim(regexp_replace(lower(metadata.question), '\s+', ' ', 'g')), metadata.tax_type)) AS cache_key, trim(coalesce(metadata.answer, '')) <> '' AND NOT starts_with(trim(coalesce(metadata.answer, '')), 'Unable') AND coalesce(length(metadata.answer) / 100, 0) >= 0.3 AS keep FROM raw_taas",
    "judge_scores": f"WITH {_JUDGE} SELECT raw_id, overall_score, clarity, correctness, n_hallucinations, {_PASSED} AS passed FROM jd",
    "claim_verdicts": f"WITH {_ANS}, s AS (SELECT raw_id, unnest(src) AS source, generate_subscripts(src, 1) - 1 AS position FROM ans), x AS (SELECT *, length('Claim: The charge is taxable under that section.' || chr(10) || 'Source: ' || source) AS n FROM s) SELECT raw_id, position::INT AS position, CASE WHEN n % 7 IN (0, 1) THEN 'not_supported' WHEN n % 5 = 0 THEN 'supported' WHEN n % 5 = 1 THEN 'partial' WHEN n % 5 = 2 THEN 'contradicted' ELSE 'not_supported' END AS verdict, CASE n % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM x",
    "answers_synthesized": f"WITH {_CKW}, c AS (SELECT id, any_value(citation) AS citation, any_value(doc_type) AS doc_type FROM legal_chunks GROUP BY id), g AS (SELECT query_id, min_by(citation, rank) AS first, 0.6 * avg(CASE doc_type WHEN 'statute' THEN 1.0 WHEN 'rule' THEN 0.9 WHEN 'case' THEN 0.7 WHEN 'taa' THEN 0.6 ELSE 0.5 END) FILTER (rank <= 5) + 0.2 AS sure FROM kw JOIN c ON c.id = kw.doc_id GROUP BY 1), a AS (SELECT query_id FROM q UNION ALL SELECT 99) SELECT a.query_id, CASE WHEN first IS NULL THEN '{G.NO_CONTEXT}' ELSE 'It is taxable. [Source: ' || first || '] It is not. [Source: § 999.99]' END AS answer, CASE WHEN first IS NULL THEN 0 ELSE 2 END AS n_citations, CASE WHEN first IS NULL THEN 0 ELSE 1 END AS n_verified, CASE WHEN first IS NULL THEN 0.0 ELSE round(least(1.0, greatest(0.0, sure)), 6) END::DOUBLE AS confidence, CASE WHEN first IS NULL THEN 'no documents in context' ELSE '1 citation(s) could not be verified' END AS warning FROM a LEFT JOIN g USING (query_id)",
    "corrected_answers": f"WITH {_ANS}, x AS (SELECT raw_id, answer, length(answer) AS n, length('Response: ' || answer || chr(10) || 'Findings:' || chr(10) || '- Claim: \"taxable\", suggestion: exempt' || chr(10) || 'Context: ') AS p FROM ans WHERE answer <> ''), y AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'none' WHEN n % 3 = 1 THEN 'simple' WHEN p % 2 = 0 THEN 'model' ELSE 'failed' END AS how FROM x) SELECT raw_id, how, md5(CASE how WHEN 'none' THEN answer WHEN 'simple' THEN substr(answer, 1, instr(answer, 'taxable') - 1) || 'exempt' || substr(answer, instr(answer, 'taxable') + 7) WHEN 'model' THEN 'A corrected answer.' ELSE answer || '{G.UNVERIFIED.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' END) AS answer_md5, CASE WHEN how IN ('simple', 'model') THEN 1 ELSE 0 END AS n_corrected, CASE how WHEN 'none' THEN 0.0 WHEN 'simple' THEN -0.1 WHEN 'model' THEN -0.44 ELSE -0.3 END::DOUBLE AS confidence_change FROM y",
    "run_report": f"WITH {_JUDGE}, cs AS ({_EVAL['citation_scores']}), ac AS ({_EVAL['answer_contains']}), x AS (SELECT jd.*, {_PASSED} AS passed, precision, recall, share, length(text) AS latency FROM jd JOIN cs USING (raw_id) JOIN ac USING (raw_id) JOIN raw_taas USING (raw_id) WHERE trim(coalesce(answer, '')) <> ''), g AS (SELECT count(*) AS successful, avg(precision) AS p, avg(recall) AS r, round(avg(share), 6) AS avg_contains, round(avg(latency), 6) AS avg_latency, round(avg(overall_score), 6) AS avg_score, round(avg(passed::INT), 6) AS pass_rate, coalesce(sum(n_hallucinations), 0)::BIGINT AS total_hallucinations FROM x) SELECT (SELECT count(*) FROM raw_taas) AS total_questions, successful, (SELECT count(*) FROM raw_taas) - successful AS failed, round(p, 6) AS avg_precision, round(r, 6) AS avg_recall, round(2 * p * r / (p + r), 6) AS avg_f1, avg_contains, avg_latency, avg_score, pass_rate, total_hallucinations FROM g",
}
