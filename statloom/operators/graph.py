"""The citation graph as two DataFrames: vertices (documents, chunks) and typed edges.

Every traversal is a set join over all start vertices at once.  Branches of a chain are aggregated
before they are joined, so no product of rules, cases and advisements is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Which relations count in which question.
CITING = ("cites", "interprets", "implements", "authority")
CITED = ("cites", "interprets", "implements", "authority", "amends", "supersedes")
IMPLEMENTING = ("implements", "authority")
INTERPRETING = ("interprets", "cites")


def vertices(documents: DataFrame) -> DataFrame:
    """One row per document: kind from doc_type where usable, else from the id."""
    kinds = ("statute", "rule", "taa", "case")
    t, k = F.trim(F.lower("doc_type")), F.trim(F.lower(F.substring_index("id", ":", 1)))
    kind = F.when(t.isin(*kinds), t).otherwise(k)
    return documents.select("id", kind.alias("doc_type"), "title", "full_citation", "section", "chapter").groupBy("id").agg(
        F.min("doc_type").alias("doc_type"), F.min("title").alias("title"), F.min("full_citation").alias("full_citation"), F.min("section").alias("section"), F.min("chapter").alias("chapter")
    )


def linked(edges: DataFrame, verts: DataFrame) -> DataFrame:
    """Distinct (src, dst, relation) whose two ends exist; others are dropped, as on loading a graph."""
    e = edges.select(F.col("source_doc_id").alias("src"), F.col("target_doc_id").alias("dst"), F.lower("relation_type").alias("relation")).where("dst is not null").distinct()
    ids = verts.select("id")
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def load_report(edges: DataFrame, verts: DataFrame) -> DataFrame:
    """Loaded against delivered edges by relation."""
    given = edges.groupBy(F.lower("relation_type").alias("relation")).agg(F.count("*").alias("n_given"), F.countDistinct("source_doc_id", "target_doc_id").alias("n_distinct"))
    have = linked(edges, verts).groupBy("relation").agg(F.count("*").alias("n_loaded"))
    return given.join(have, "relation", "full").select("relation", F.coalesce("n_given", F.lit(0)).alias("n_given"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("n_loaded", F.lit(0)).alias("n_loaded"))


def not_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that break a uniqueness constraint."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def citing(edges: DataFrame) -> DataFrame:
    """(id, other): documents that cite a document."""
    return edges.where(F.col("relation").isin(*CITING)).select(F.col("dst").alias("id"), F.col("src").alias("other")).distinct()


def cited(edges: DataFrame) -> DataFrame:
    """(id, other): documents that a document cites."""
    return edges.where(F.col("relation").isin(*CITED)).select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()


def related(edges: DataFrame, limit: int | None = 5) -> DataFrame:
    """Cited and citing documents, distinct, in id order; the first few of each."""
    both = cited(edges).union(citing(edges)).distinct()
    if limit is None:
        return both
    w = Window.partitionBy("id").orderBy("other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def interpretation_chain(verts: DataFrame, edges: DataFrame) -> DataFrame:
    """(statute, part, other): of each statute its implementing rules (part 0), and the cases (1) and
    advisements (2) that interpret it or one of those rules.

    One row per link, so a statute that most of the corpus cites is spread over tasks; lists of a
    bounded length are made by :func:`chain_lists`.
    """
    kind = verts.select("id", "doc_type")
    typed = edges.join(kind.withColumnRenamed("id", "src").withColumnRenamed("doc_type", "src_type"), "src").join(
        kind.withColumnRenamed("id", "dst").withColumnRenamed("doc_type", "dst_type"), "dst"
    )
    rules = typed.where((F.col("src_type") == "rule") & (F.col("dst_type") == "statute") & F.col("relation").isin(*IMPLEMENTING)).select(
        F.col("dst").alias("statute"), F.col("src").alias("rule")
    ).distinct()
    reading = typed.where(F.col("src_type").isin("case", "taa") & F.col("relation").isin(*INTERPRETING)).withColumn("part", F.when(F.col("src_type") == "case", 1).otherwise(2))
    direct = reading.where("dst_type = 'statute'").select(F.col("dst").alias("statute"), "part", F.col("src").alias("other"))
    by_rule = reading.where("dst_type = 'rule'").select(F.col("dst").alias("rule"), "part", F.col("src").alias("other")).distinct().join(rules, "rule").select("statute", "part", "other")
    return rules.select("statute", F.lit(0).alias("part"), F.col("rule").alias("other")).union(direct).union(by_rule).distinct()


def chain_lists(chain: DataFrame, most: int = 20) -> DataFrame:
    """Per statute and part: how many links there are and the first ``most`` in id order."""
    w = Window.partitionBy("statute", "part").orderBy("other")
    first = chain.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy("statute", "part").agg(F.array_sort(F.collect_list("other")).alias("first"))
    return chain.groupBy("statute", "part").agg(F.count("*").alias("n")).join(first, ["statute", "part"])


def authority_links(verts: DataFrame, edges: DataFrame) -> DataFrame:
    """Rules with the statutes that give them authority: one row a link, numbered in id order."""
    kind = verts.select("id", "doc_type")
    pairs = edges.where("relation = 'authority'").join(kind.where("doc_type = 'rule'").select(F.col("id").alias("src")), "src", "left_semi").join(
        kind.where("doc_type = 'statute'").select(F.col("id").alias("dst")), "dst", "left_semi"
    )
    w = Window.partitionBy("rule").orderBy("statute")
    return pairs.select(F.col("src").alias("rule"), F.col("dst").alias("statute")).distinct().withColumn("position", F.row_number().over(w))


def chapter_statutes(verts: DataFrame) -> DataFrame:
    """Statutes of each chapter in string order of their sections."""
    w = Window.partitionBy("chapter").orderBy(F.col("section").asc_nulls_last(), "id")
    return verts.where("doc_type = 'statute' and chapter is not null").select("chapter", "section", "id", F.row_number().over(w).alias("position"))


def parents_of(chunks: DataFrame) -> DataFrame:
    """Child to parent chunk, kept where the parent is missing."""
    c, p = chunks.alias("c"), chunks.select("id").alias("p")
    return c.where("level = 'child'").join(p, F.col("c.parent_chunk_id") == F.col("p.id"), "left").select(F.col("c.id").alias("id"), "c.parent_chunk_id", F.col("p.id").isNotNull().alias("parent_found"))


def siblings(chunks: DataFrame, limit: int = 3) -> DataFrame:
    """Up to ``limit`` other chunks of the same parent, in id order.

    The others of a chunk lie next to it in its parent's order, so a sorted list per parent is cut
    to its first limit + 1 entries, which hold every sibling asked for; no pairs are formed.
    """
    w = Window.partitionBy("parent_chunk_id").orderBy("id")
    kids = chunks.where("parent_chunk_id is not null").select("id", "parent_chunk_id")
    first = kids.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit + 1).groupBy("parent_chunk_id").agg(F.array_sort(F.collect_list("id")).alias("first"))
    out = kids.join(first, "parent_chunk_id").select("id", F.slice(F.array_except("first", F.array("id")), 1, limit).alias("siblings"))
    return out.select("id", F.array_join("siblings", ",").alias("siblings"))


def document_chunks(verts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document's chunks with their parents: one row a chunk, numbered in string order; a
    document without chunks has one row of nulls."""
    rows = chunks.groupBy(F.col("doc_id").alias("id"), F.col("id").alias("chunk_id")).agg(F.min("parent_chunk_id").alias("parent_chunk_id"))
    w = Window.partitionBy("id").orderBy("chunk_id")
    return verts.select("id").join(rows.withColumn("position", F.row_number().over(w)), "id", "left").select("id", "position", "chunk_id", "parent_chunk_id")


def chunk_detail(chunks: DataFrame, verts: DataFrame, edges: DataFrame, most: int = 10, ids: list[str] | None = None) -> DataFrame:
    """Chunk (all, or those of ``ids``), its document's title, its parent, the number of its children
    and the first of them, and the first related documents (citing, then cited; a document on both
    sides appears twice).  Lists hold ``most`` entries; all children are in :func:`document_chunks`."""
    asked = chunks if ids is None else chunks.where(F.col("id").isin(*ids))
    w = Window.partitionBy("parent_chunk_id").orderBy("id")
    pairs = chunks.where("parent_chunk_id is not null").select("id", "parent_chunk_id").distinct()
    counts = pairs.groupBy("parent_chunk_id").agg(F.count("*").alias("n_children"))
    first = pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy("parent_chunk_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("children"))
    kids = counts.join(first, "parent_chunk_id").withColumnRenamed("parent_chunk_id", "id")
    tagged = citing(edges).withColumn("side", F.lit(0)).union(cited(edges).withColumn("side", F.lit(1)))
    w = Window.partitionBy("id").orderBy("side", "other")
    rel = tagged.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy(F.col("id").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "other"))), lambda x: x["other"]), ",").alias("related")
    )
    return (
        asked.select("id", "doc_id", "parent_chunk_id")
        .join(verts.select(F.col("id").alias("doc_id"), "title"), "doc_id", "left")
        .join(kids, "id", "left")
        .join(rel, "doc_id", "left")
        .select("id", "doc_id", "title", "parent_chunk_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("children", F.lit("")).alias("children"), F.coalesce("related", F.lit("")).alias("related"))
    )


def structure_edges(chunks: DataFrame, verts: DataFrame) -> DataFrame:
    """(src, dst, relation): HAS_CHUNK from documents to their chunks, CHILD_OF from chunks to their
    parent chunks; only where both ends exist."""
    has = chunks.join(verts.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("id").alias("dst"), F.lit("HAS_CHUNK").alias("relation")).distinct()
    parents = chunks.select(F.col("id").alias("parent_chunk_id")).distinct()
    child = chunks.join(parents, "parent_chunk_id", "left_semi").select(F.col("id").alias("src"), F.col("parent_chunk_id").alias("dst"), F.lit("CHILD_OF").alias("relation")).distinct()
    return has.unionByName(child)


def parent_chunks_of(documents: DataFrame, chunks: DataFrame, limit: int = 1) -> DataFrame:
    """The first ``limit`` parent chunks, in id order, of each document (column ``other``)."""
    w = Window.partitionBy("other").orderBy("chunk_id")
    parents = chunks.where(F.lower("level") == "parent").select(F.col("doc_id").alias("other"), F.col("id").alias("chunk_id")).distinct()
    first = parents.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    return documents.join(first, "other")


def expand_results(results: DataFrame, chunks: DataFrame, verts: DataFrame, edges: DataFrame, raw_edges: DataFrame, most: int = 5) -> DataFrame:
    """What the graph adds to results (query_id, rank, id of a chunk): one row an addition, with its
    ``source`` and ``position``: ``parent`` (the parent chunk, where there is one), ``context`` (the
    documents the chunk cites) and ``related`` (a parent chunk of each of the first ``most`` documents
    that cite the chunk's document or are cited by it)."""
    known = chunks.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("parent_chunk_id").alias("parent_chunk_id"))
    rows = results.select("query_id", "rank", "id").join(known, "id")
    parent = rows.join(known.select(F.col("id").alias("parent_chunk_id")), "parent_chunk_id", "left_semi")
    parent = parent.select("query_id", "rank", "id", F.lit("parent").alias("source"), F.lit(1).alias("position"), F.col("parent_chunk_id").alias("item"))
    cites = edges_of_chunk(raw_edges, verts).select(F.col("source_chunk_id").alias("id"), "target_doc_id").distinct()
    by_result = Window.partitionBy("query_id", "rank").orderBy("target_doc_id")
    context = rows.join(cites, "id").select("query_id", "rank", "id", F.lit("context").alias("source"), F.row_number().over(by_result).alias("position"), F.col("target_doc_id").alias("item"))
    near = related(edges, most).select(F.col("id").alias("doc_id"), "other", F.col("rank").alias("position"))
    chosen = parent_chunks_of(rows.select("query_id", "rank", "id", "doc_id").join(near, "doc_id").withColumnRenamed("position", "nth"), chunks)
    related_ = chosen.select("query_id", "rank", "id", F.lit("related").alias("source"), F.col("nth").alias("position"), F.col("chunk_id").alias("item"))
    return parent.unionByName(context).unionByName(related_)


def edges_of_chunk(edges: DataFrame, verts: DataFrame) -> DataFrame:
    """Citation contexts: the edges of each chunk with the target's citation."""
    return edges.where("target_doc_id is not null").select("source_chunk_id", "target_doc_id", F.lower("relation_type").alias("relation"), "citation_text").distinct().join(
        verts.select(F.col("id").alias("target_doc_id"), F.col("full_citation").alias("target_citation")), "target_doc_id"
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree of every vertex that has an edge."""
    out = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return out.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def shortest_paths(edges: DataFrame, sources: list[str], max_hops: int = 4) -> DataFrame:
    """(source, id, hops, path): shortest undirected paths from each source to all vertices within
    ``max_hops``; of equal paths the lexicographically least.  Breadth first from all sources at once:
    one join per hop against the newest ring only, and each ring is cut off from its lineage by a
    checkpoint, so the plan does not grow with the hops."""
    from statloom.session import ensure_checkpoint_dir

    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = spark.createDataFrame([(s, s, 0, [s]) for s in dict.fromkeys(sources)], "source string, id string, hops int, path array<string>")
    ring = reached
    for hop in range(1, max_hops + 1):
        step = ring.join(both, ring["id"] == both["src"]).select("source", F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        best = step.join(reached.select("source", "id"), ["source", "id"], "left_anti").groupBy("source", "id").agg(F.min("path").alias("path"))
        ring = best.select("source", "id", F.lit(hop).alias("hops"), "path").checkpoint()
        reached = reached.unionByName(ring)
    return reached


def path_segments(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, id, step, src, dst, relation, forward): the edge behind each step of a path, with its
    direction; an edge along the path goes before one against it, then the first relation counts."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("step"), F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))
    each = paths.where("hops > 0").select("source", "id", F.inline(steps))
    e = edges.groupBy("src", "dst").agg(F.min("relation").alias("relation"))
    along = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("forward"), "relation")
    against = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("forward"), "relation")
    one = along.unionAll(against).groupBy("a", "b").agg(F.max_by(F.struct("forward", "relation"), "forward").alias("s"))
    found = each.join(one, ["a", "b"])
    ends = lambda x, y: F.when(F.col("s.forward"), F.col(x)).otherwise(F.col(y))
    return found.select("source", "id", "step", ends("a", "b").alias("src"), ends("b", "a").alias("dst"), F.col("s.relation").alias("relation"), F.col("s.forward").alias("forward"))


def expansion(verts: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Related documents of every document by its kind: a statute's rules, cases and advisements in
    this order; a rule's statutes, then what cites it; a case's cited documents; else both sides."""
    chain = interpretation_chain(verts, edges)
    by_part = Window.partitionBy("statute").orderBy("part", "other")
    statute = chain.withColumn("pos", F.row_number().over(by_part) - 1).where(F.col("pos") < most).select(F.col("statute").alias("id"), "pos", "other")
    kind = verts.select("id", "doc_type")

    def ranked(pairs: DataFrame) -> DataFrame:
        w = Window.partitionBy("id").orderBy("side", "other")
        return pairs.groupBy("id", "other").agg(F.min("side").alias("side")).withColumn("pos", F.row_number().over(w) - 1).select("id", "pos", "other")

    of = lambda k: kind.where(F.col("doc_type") == k).select("id")
    down = edges.where(F.col("relation").isin(*IMPLEMENTING)).select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(0).alias("side"))
    rule = ranked(down.union(citing(edges).withColumn("side", F.lit(1))).join(of("rule"), "id", "left_semi"))
    case = ranked(cited(edges).withColumn("side", F.lit(0)).join(of("case"), "id", "left_semi"))
    taa = ranked(cited(edges).union(citing(edges)).withColumn("side", F.lit(0)).join(of("taa"), "id", "left_semi"))
    return statute.union(rule).union(case).union(taa).where(F.col("pos") < most)


def document_boost(edges: DataFrame, verts: DataFrame) -> DataFrame:
    """(id, graph_boost) of every document with edges: 0.05 for each document that it cites and 0.02
    for each related one, five of each at most."""
    cites = edges.where("target_doc_id is not null").select(F.col("source_doc_id").alias("id"), "target_doc_id").distinct().groupBy("id").agg(F.count("*").alias("n_cites"))
    rel = related(linked(edges, verts)).groupBy("id").agg(F.count("*").alias("n_related"))
    boost = 0.05 * F.least(F.coalesce("n_cites", F.lit(0)), F.lit(5)) + 0.02 * F.least(F.coalesce("n_related", F.lit(0)), F.lit(5))
    return cites.join(rel, "id", "full").select("id", F.round(boost, 6).alias("graph_boost"))
