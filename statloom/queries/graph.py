"""Queries of the citation graph with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import graph
from statloom.session import table


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    verts = graph.vertices(table(spark, d, "graph_documents"))
    return verts, graph.linked(table(spark, d, "resolved_edges"), verts)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_chunks").select("id", "doc_id", "level", "parent_chunk_id").distinct()


def graph_vertices(spark, d):
    return graph.vertices(table(spark, d, "graph_documents")).groupBy("doc_type").agg(F.count("*").alias("n"))


def graph_load_report(spark, d):
    return graph.load_report(table(spark, d, "resolved_edges"), graph.vertices(table(spark, d, "graph_documents")))


def graph_not_unique(spark, d):
    return graph.not_unique(table(spark, d, "graph_documents"), "id")


def graph_citing(spark, d):
    return graph.citing(_graph(spark, d)[1]).groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("first"))


def graph_cited(spark, d):
    return graph.cited(_graph(spark, d)[1]).groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("first"))


def related_top5(spark, d):
    return graph.related(_graph(spark, d)[1])


def impl_chain(spark, d):
    return graph.interpretation_chain(*_graph(spark, d))


def impl_chain_lists(spark, d):
    c = graph.chain_lists(graph.interpretation_chain(*_graph(spark, d)))
    return c.select("statute", "part", "n", F.array_join("first", ",").alias("first"))


def authority_rules(spark, d):
    return graph.authority_links(*_graph(spark, d))


def chapter_statutes(spark, d):
    return graph.chapter_statutes(_graph(spark, d)[0])


def chunk_parents(spark, d):
    return graph.parents_of(_chunks(spark, d))


def chunk_siblings(spark, d):
    return graph.siblings(_chunks(spark, d))


def doc_with_chunks(spark, d):
    return graph.document_chunks(_graph(spark, d)[0], _chunks(spark, d))


def chunk_detail(spark, d):
    v, e = _graph(spark, d)
    return graph.chunk_detail(_chunks(spark, d), v, e)


def citation_contexts(spark, d):
    return graph.edges_of_chunk(table(spark, d, "resolved_edges"), _graph(spark, d)[0])


def graph_degrees(spark, d):
    return graph.degrees(_graph(spark, d)[1])


def _paths(spark, d):
    v, e = _graph(spark, d)
    return graph.shortest_paths(e, ["statute:212.05", v.agg(F.min("id")).first()[0] or ""]), e


def shortest_paths(spark, d):
    """From the most cited statute and from the first document, within four hops."""
    return _paths(spark, d)[0].select("source", "id", "hops", F.array_join("path", ">").alias("path"))


def path_segments(spark, d):
    return graph.path_segments(*_paths(spark, d))


def expansion_top5(spark, d):
    return graph.expansion(*_graph(spark, d))


_F = (
    graph_vertices, graph_load_report, graph_not_unique, graph_citing, graph_cited, related_top5, impl_chain, impl_chain_lists, authority_rules, chapter_statutes, chunk_parents, chunk_siblings,
    doc_with_chunks, chunk_detail, citation_contexts, graph_degrees, shortest_paths, path_segments, expansion_top5,
)
QUERIES = {f.__name__: f for f in _F}

_V = """v AS (SELECT id, min(CASE WHEN trim(lower(doc_type)) IN ('statute','rule','taa','case') THEN trim(lower(doc_type)) ELSE trim(lower(split_part(id, ':', 1))) END) AS doc_type,
 min(title) AS title, min(full_citation) AS full_citation, min(section) AS section, min(chapter) AS chapter FROM graph_documents GROUP BY id)"""
_E = _V + """, e AS (SELECT DISTINCT source_doc_id AS src, target_doc_id AS dst, lower(relation_type) AS relation FROM resolved_edges
 WHERE target_doc_id IN (SELECT id FROM v) AND source_doc_id IN (SELECT id FROM v)),
 citing AS (SELECT DISTINCT dst AS id, src AS other FROM e WHERE relation IN ('cites','interprets','implements','authority')),
 cited AS (SELECT DISTINCT src AS id, dst AS other FROM e)"""
_CH = "ch AS (SELECT DISTINCT id, doc_id, level, parent_chunk_id FROM legal_chunks)"
_CHAIN = _E + """, ty AS (SELECT e.*, a.doc_type AS st, b.doc_type AS dt FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst),
 ru AS (SELECT DISTINCT dst AS statute, src AS rule FROM ty WHERE st = 'rule' AND dt = 'statute' AND relation IN ('implements','authority')),
 rd AS (SELECT dst AS statute, src AS reader, st FROM ty WHERE st IN ('case','taa') AND dt = 'statute' AND relation IN ('interprets','cites')
   UNION SELECT ru.statute, src, st FROM ty JOIN ru ON ru.rule = dst WHERE st IN ('case','taa') AND dt = 'rule' AND relation IN ('interprets','cites'))"""

SQL = {
    "graph_vertices": f"WITH {_V} SELECT doc_type, count(*) AS n FROM v GROUP BY doc_type",
    "graph_load_report": f"WITH {_E}, g AS (SELECT lower(relation_type) AS relation, count(*) AS n_given, count(DISTINCT CASE WHEN target_doc_id IS NOT NULL THEN (source_doc_id, target_doc_id) END) AS n_distinct FROM resolved_edges GROUP BY 1), h AS (SELECT relation, count(*) AS n_loaded FROM e GROUP BY 1) SELECT coalesce(g.relation, h.relation) AS relation, coalesce(n_given, 0) AS n_given, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_loaded, 0) AS n_loaded FROM g FULL JOIN h ON g.relation = h.relation",
    "graph_not_unique": "SELECT id, count(*) AS n FROM graph_documents GROUP BY id HAVING count(*) > 1",
    "graph_citing": f"WITH {_E} SELECT id, count(*) AS n, min(other) AS first FROM citing GROUP BY id",
    "graph_cited": f"WITH {_E} SELECT id, count(*) AS n, min(other) AS first FROM cited GROUP BY id",
    "related_top5": f"WITH {_E}, b AS (SELECT * FROM cited UNION SELECT * FROM citing) SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other)::INT AS rank FROM b QUALIFY rank <= 5",
    "impl_chain": f"WITH {_CHAIN} SELECT DISTINCT statute, 0 AS part, rule AS other FROM ru UNION ALL SELECT DISTINCT statute, CASE st WHEN 'case' THEN 1 ELSE 2 END, reader FROM rd",
    "impl_chain_lists": f"WITH {_CHAIN}, x AS (SELECT DISTINCT statute, 0 AS part, rule AS other FROM ru UNION ALL SELECT DISTINCT statute, CASE st WHEN 'case' THEN 1 ELSE 2 END, reader FROM rd), y AS (SELECT *, row_number() OVER (PARTITION BY statute, part ORDER BY other) AS n FROM x) SELECT statute, part, count(*) AS n, string_agg(other, ',' ORDER BY n) FILTER (n <= 20) AS first FROM y GROUP BY 1, 2",
    "authority_rules": f"WITH {_E} SELECT rule, statute, row_number() OVER (PARTITION BY rule ORDER BY statute)::INT AS position FROM (SELECT DISTINCT src AS rule, dst AS statute FROM e JOIN v a ON a.id = src AND a.doc_type = 'rule' JOIN v b ON b.id = dst AND b.doc_type = 'statute' WHERE relation = 'authority')",
    "chapter_statutes": f"WITH {_V} SELECT chapter, section, id, row_number() OVER (PARTITION BY chapter ORDER BY section NULLS LAST, id)::INT AS position FROM v WHERE doc_type = 'statute' AND chapter IS NOT NULL",
    "chunk_parents": f"WITH {_CH} SELECT c.id, c.parent_chunk_id, p.id IS NOT NULL AS parent_found FROM ch c LEFT JOIN ch p ON c.parent_chunk_id = p.id WHERE c.level = 'child'",
    "chunk_siblings": f"WITH {_CH} SELECT c.id, coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT p.id AS s FROM ch p WHERE p.parent_chunk_id = c.parent_chunk_id AND p.id <> c.id ORDER BY p.id LIMIT 3)), '') AS siblings FROM ch c WHERE c.parent_chunk_id IS NOT NULL",
    "doc_with_chunks": f"WITH {_V}, c AS (SELECT doc_id, id AS chunk_id, min(parent_chunk_id) AS parent_chunk_id FROM legal_chunks GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id)::INT AS position FROM c) SELECT v.id, position, chunk_id, parent_chunk_id FROM v LEFT JOIN n ON n.doc_id = v.id",
    "chunk_detail": f"WITH {_E}, {_CH}, c AS (SELECT parent_chunk_id AS id, id AS child, row_number() OVER (PARTITION BY parent_chunk_id ORDER BY id) AS i FROM (SELECT DISTINCT id, parent_chunk_id FROM ch WHERE parent_chunk_id IS NOT NULL)), k AS (SELECT id, count(*) AS n_children, string_agg(child, ',' ORDER BY child) FILTER (i <= 10) AS children FROM c GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, other) AS n FROM (SELECT *, 0 AS side FROM citing UNION ALL SELECT *, 1 FROM cited)), r AS (SELECT id, string_agg(other, ',' ORDER BY n) AS related FROM t WHERE n <= 10 GROUP BY 1) SELECT ch.id, ch.doc_id, v.title, ch.parent_chunk_id, coalesce(n_children, 0) AS n_children, coalesce(children, '') AS children, coalesce(related, '') AS related FROM ch LEFT JOIN v ON v.id = ch.doc_id LEFT JOIN k ON k.id = ch.id LEFT JOIN r ON r.id = ch.doc_id",
    "citation_contexts": f"WITH {_V}, d AS (SELECT DISTINCT source_chunk_id, target_doc_id, lower(relation_type) AS relation, citation_text FROM resolved_edges WHERE target_doc_id IS NOT NULL) SELECT d.*, v.full_citation AS target_citation FROM d JOIN v ON v.id = d.target_doc_id",
    "graph_degrees": f"WITH {_E} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id",
    "expansion_top5": f"WITH {_CHAIN}, s AS (SELECT DISTINCT statute AS id, 0 AS side, rule AS other FROM ru UNION SELECT statute, CASE st WHEN 'case' THEN 1 ELSE 2 END, reader FROM rd UNION ALL SELECT id, min(side), other FROM (SELECT src AS id, 0 AS side, dst AS other FROM e WHERE relation IN ('implements','authority') UNION SELECT id, 1, other FROM citing) WHERE id IN (SELECT id FROM v WHERE doc_type = 'rule') GROUP BY id, other UNION ALL SELECT id, 0, other FROM cited WHERE id IN (SELECT id FROM v WHERE doc_type = 'case') UNION ALL SELECT id, 0, other FROM (SELECT * FROM cited UNION SELECT * FROM citing) WHERE id IN (SELECT id FROM v WHERE doc_type = 'taa')) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY side, other) - 1)::INT AS pos, other FROM s QUALIFY pos < 5",
}
_RING = ", h{n} AS (SELECT p.source, u.dst AS id, min(list_append(p.path, u.dst)) AS path FROM h{m} p JOIN u ON u.src = p.id WHERE NOT EXISTS (SELECT 1 FROM r{m} r WHERE r.source = p.source AND r.id = u.dst) GROUP BY p.source, u.dst), r{n} AS (SELECT * FROM r{m} UNION ALL SELECT source, id, {n}, path FROM h{n})"
_PATHS = (
    f"WITH {_E}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT id AS source, id, [id] AS path FROM (SELECT 'statute:212.05' AS id UNION SELECT min(id) FROM v)), r0 AS (SELECT source, id, 0 AS hops, path FROM h0)"
    + "".join(_RING.format(n=n, m=n - 1) for n in (1, 2, 3, 4))
)
SQL["shortest_paths"] = _PATHS + " SELECT source, id, hops::INT AS hops, array_to_string(path, '>') AS path FROM r4"
SQL["path_segments"] = (
    _PATHS + ", st AS (SELECT source, id, unnest(range(1, len(path))) AS step, path FROM r4 WHERE hops > 0), sp AS (SELECT source, id, step::INT AS step, path[step] AS a, path[step + 1] AS b FROM st), ee AS (SELECT src, dst, min(relation) AS relation FROM e GROUP BY 1, 2) "
    "SELECT source, sp.id, step, CASE WHEN f.src IS NOT NULL THEN a ELSE b END AS src, CASE WHEN f.src IS NOT NULL THEN b ELSE a END AS dst, coalesce(f.relation, g.relation) AS relation, f.src IS NOT NULL AS forward FROM sp LEFT JOIN ee f ON f.src = a AND f.dst = b LEFT JOIN ee g ON g.src = b AND g.dst = a"
)
