"""Token budget per source, language and domain.

Counts come from the partitioned prefix tries of :mod:`statloom.llm.tokens` over the distinct pieces
of all texts, joined to the documents; only hashes, numbers and distinct pieces are shuffled.  A text is counted once however many rows hold it (the row of the smallest
key stands for it), a parent chunk counts for its children, and stored counts are only used where
a chunk has no text, and then only if they can be right.

Defined edge cases: null texts have 0 tokens and are no duplicates of one another; respelled
sources and languages are folded; a missing or contradicted language is replaced by the one whose
function words lead clearly, else ``und``; rows without a source or domain are reported under null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.tokens import VOCABULARY, piece_tokens, with_piece_tokens
from statloom.session import ensure_checkpoint_dir

LANGUAGES = ("en", "es", "pt", "fr")
#: A stored count that can be right: at least 1 and at most this many tokens.
MOST_TOKENS = 1_000_000


def folded_source(c: Column) -> Column:
    """``statutes-site``, ``STATUTES_SITE`` and ``statutes_site `` are one source."""
    s = F.regexp_replace(F.trim(F.lower(c)), r"[\s-]+", "_")
    return F.when(s != "", s)


def folded_language(declared: Column, found: Column) -> Column:
    d = F.substring_index(F.regexp_replace(F.trim(F.lower(declared)), "_", "-"), "-", 1)
    d = F.when(d.isin(*LANGUAGES), d)
    return F.coalesce(found, d, F.lit("und"))


#: Salts of joins on a document's id, which may be that of a third of all chunks.
SALTS = 8


def _mark_first(df: DataFrame, hashed: DataFrame, key: str) -> DataFrame:
    """Adds ``first``: is this the row with the least key among those of equal text.

    The least keys are aggregated map-side and joined back on hash and key together, which are
    spread over all tasks however many rows share one text.
    """
    least = hashed.groupBy("text_hash").agg(F.min(key).alias(key)).withColumn("first", F.lit(True))
    return df.join(least, ["text_hash", key], "left").withColumn("first", F.coalesce("first", F.lit(False)))


def pieces_of(*texts: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The written table of pieces of the ``text`` columns."""
    spark = texts[0].sparkSession
    ensure_checkpoint_dir(spark)
    every = texts[0].select("text")
    for t in texts[1:]:
        every = every.unionAll(t.select("text"))
    return piece_tokens(every, path=path).checkpoint()


def document_tokens(documents: DataFrame, path: str = VOCABULARY, pieces: DataFrame | None = None) -> DataFrame:
    """Per document: folded source and language, domain, tokens, and whether it counts."""
    digest = F.coalesce(F.md5("text"), F.concat(F.lit("null:"), F.col("doc_id").cast("string"))).alias("text_hash")
    pieces = pieces_of(documents, path=path) if pieces is None else pieces
    sized = with_piece_tokens(documents.select("doc_id", "source", "lang", "tax_type", "text", digest), pieces)
    rows = sized.select(
        "doc_id",
        folded_source(F.col("source")).alias("source"),
        folded_language(F.col("lang"), F.col("found_lang")).alias("lang"),
        F.nullif(F.trim("tax_type"), F.lit("")).alias("domain"),
        "tokens",
        "text_hash",
    )
    return _mark_first(rows, documents.select("doc_id", digest), "doc_id")


def document_budget(documents: DataFrame, path: str = VOCABULARY, pieces: DataFrame | None = None) -> DataFrame:
    t = document_tokens(documents, path, pieces)
    return t.groupBy("source", "lang", "domain").agg(
        F.count("*").alias("n_rows"),
        F.count_if("first").alias("n_counted"),
        F.sum(F.col("tokens").cast("long")).alias("tokens_all"),
        F.sum(F.when(F.col("first"), F.col("tokens").cast("long")).otherwise(0)).alias("tokens"),
    )


def folded_doc_type(doc_type: Column, doc_id: Column) -> Column:
    """A usable doc_type, else the kind named by the document id."""
    kinds = ("statute", "rule", "taa", "case")
    t, k = F.trim(F.lower(doc_type)), F.trim(F.lower(F.substring_index(doc_id, ":", 1)))
    return F.when(t.isin(*kinds), t).when(k.isin(*kinds), k).otherwise("unknown")


def chunk_tokens(graph_chunks: DataFrame, graph_documents: DataFrame, legal_chunks: DataFrame, path: str = VOCABULARY, pieces: DataFrame | None = None) -> DataFrame:
    """Per chunk of the graph: doc_type, stored and true tokens, verdict on the stored count, and
    whether it counts (``counted``): parents, and children of documents that have no parent left."""
    chunks = graph_chunks.groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.lower("level")).alias("level"), F.max("token_count").alias("stored")
    )
    docs = graph_documents.groupBy("id").agg(
        F.min(F.when(F.trim(F.lower("doc_type")).isin("statute", "rule", "taa", "case"), F.trim(F.lower("doc_type")))).alias("doc_type")
    )
    hashed = legal_chunks.select("id", "text", F.md5("text").alias("text_hash"))
    pieces = pieces_of(legal_chunks, path=path) if pieces is None else pieces
    true = with_piece_tokens(hashed, pieces).groupBy("id").agg(F.max("tokens").alias("true_tokens"), F.max("text_hash").alias("text_hash"))
    # what is known of each document, replicated over the salts
    parents = chunks.where("level = 'parent'").select(F.col("doc_id").alias("id"), F.lit(True).alias("has_parent")).distinct()
    known = docs.join(parents, "id", "full").select(
        F.col("id").alias("doc_id"), "doc_type", "has_parent", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    placed = (
        chunks.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        .join(known, ["doc_id", "salt"], "left")
        .drop("salt")
        .withColumn("doc_type", folded_doc_type(F.col("doc_type"), F.col("doc_id")))
    )
    own = F.coalesce("text_hash", F.concat(F.lit("null:"), F.col("id")))
    joined = placed.join(true, "id", "left").withColumn("text_hash", own)
    usable = F.col("stored").between(1, MOST_TOKENS)
    verdict = (
        F.when(F.col("stored").isNull(), "missing")
        .when(~usable, "impossible")
        .when(F.col("true_tokens").isNull(), "unverified")
        .when(F.col("stored") != F.col("true_tokens"), "differs")
        .otherwise("right")
    )
    marked = joined.withColumn("counted", (F.col("level") == "parent") | F.col("has_parent").isNull()).withColumn("verdict", verdict)
    marked = marked.withColumn("tokens", F.coalesce("true_tokens", F.when(usable, F.col("stored")), F.lit(0)))
    # the texts that stand for themselves, decided without tokenizing anything again
    hashes = legal_chunks.groupBy("id").agg(F.max(F.md5("text")).alias("text_hash"))
    stand = placed.where((F.col("level") == "parent") | F.col("has_parent").isNull()).join(hashes, "id", "left").select("id", own.alias("text_hash"))
    return _mark_first(marked, stand, "id").withColumn("counted", F.col("counted") & F.col("first")).drop("first", "has_parent")


def chunk_budget(graph_chunks: DataFrame, graph_documents: DataFrame, legal_chunks: DataFrame, path: str = VOCABULARY, pieces: DataFrame | None = None) -> DataFrame:
    t = chunk_tokens(graph_chunks, graph_documents, legal_chunks, path, pieces)
    return t.groupBy("doc_type").agg(
        F.count("*").alias("n_rows"),
        F.count_if("counted").alias("n_counted"),
        F.sum(F.col("tokens").cast("long")).alias("tokens_all"),
        F.sum(F.when(F.col("counted"), F.col("tokens").cast("long")).otherwise(0)).alias("tokens"),
        F.count_if(F.col("verdict") == "missing").alias("n_missing"),
        F.count_if(F.col("verdict") == "impossible").alias("n_impossible"),
        F.count_if(F.col("verdict") == "differs").alias("n_differs"),
        F.count_if(F.col("verdict") == "unverified").alias("n_unverified"),
    )


def token_budget(documents: DataFrame, graph_chunks: DataFrame, graph_documents: DataFrame, legal_chunks: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Both budgets in one table: ``part`` is documents or chunks (whose domain is the doc_type)."""
    pieces = pieces_of(documents, legal_chunks, path=path)
    d = document_budget(documents, path, pieces).withColumn("part", F.lit("documents")).withColumn("n_untrusted", F.lit(0).cast("long"))
    c = chunk_budget(graph_chunks, graph_documents, legal_chunks, path, pieces)
    c = c.select(
        F.lit("chunks").alias("part"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("lang"),
        F.col("doc_type").alias("domain"),
        "n_rows",
        "n_counted",
        "tokens_all",
        "tokens",
        (F.col("n_missing") + F.col("n_impossible") + F.col("n_differs")).alias("n_untrusted"),
    )
    return d.select(c.columns).unionByName(c)
