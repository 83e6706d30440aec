"""Readers and sinks: JSON trees, corpus files, vectors, pages, resumable appends, table admin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Schemas of raw records, one per kind; numbers are read as text, since sources write them either way.
_META = {
    "statutes": "title string, title_number string, chapter string, chapter_name string, section string, section_name string, subsection string, effective_date string, history array<string>",
    "admin_code": "chapter string, rule_number string, title string, effective_date string, references_statutes array<string>, rulemaking_authority array<string>, law_implemented array<string>",
    "taa": "taa_number string, title string, issue_date string, tax_type string, tax_type_code string, topics array<string>, question string, answer string, statutes_cited array<string>, rules_cited array<string>",
    "case_law": "case_name string, case_name_full string, citations array<string>, court string, court_id string, date_filed string, docket_number string, judges string, statutes_cited array<string>, cases_cited array<string>, cluster_id string",
}
_REST = {
    "statutes": "text string, html string", "admin_code": "text string, html string", "taa": "text string, pdf_path string", "case_law": "opinion_text string, opinion_html string, pdf_url string",
}
#: Where each kind's files lie below the raw folder.
GLOBS = {"statutes": "statutes/chapter_*/*.json", "admin_code": "admin_code/chapter_*/*.json", "taa": "taa/TAA_*.json", "case_law": "case_law/case_*.json"}


def raw_schema(kind: str) -> str:
    meta = ", ".join(f.replace(" ", ": ", 1) for f in _META[kind].split(", "))
    return f"metadata struct<{meta}>, {_REST[kind]}, source_url string, scraped_at string"


def read_raw(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Raw records of a kind, one per file, in path order; unreadable files are skipped.  Dates and
    times stay text until :func:`typed`, since sources write them in several forms."""
    schema = StructType(spark.createDataFrame([], raw_schema(kind)).schema.fields + [StructField("_corrupt_record", StringType())])
    df = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).json(f"{folder}/{GLOBS[kind]}")
    )
    return df.select("*", F.col("_metadata.file_path").alias("file_path")).where("_corrupt_record is null").drop("_corrupt_record")


def typed(raw: DataFrame, run_ts: str, day_fields: tuple[str, ...] = ("effective_date", "issue_date", "date_filed")) -> DataFrame:
    """Dates and times parsed: the part before ``T`` of a date, times with ``Z``, an offset or none;
    a missing or invalid time becomes ``run_ts``."""
    have = raw.schema["metadata"].dataType.fieldNames()
    m = F.col("metadata")
    for f in day_fields:
        if f in have:
            m = m.withField(f, F.try_to_date(F.substring_index(F.col(f"metadata.{f}"), "T", 1), "yyyy-MM-dd"))
    numbers = {"title_number": "int", "cluster_id": "int", "cases_cited": "array<int>"} | ({"chapter": "int"} if "section" in have else {})
    for f, kind in numbers.items():
        if f in have:
            m = m.withField(f, F.col(f"metadata.{f}").try_cast(kind))
    bare = F.regexp_replace(F.regexp_replace("scraped_at", r"(?:Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    return raw.withColumn("metadata", m).withColumn("scraped_at", F.coalesce(F.try_to_timestamp(bare), F.lit(run_ts).cast("timestamp")))


def write_corpus(df: DataFrame, path: str, by: str = "doc_type") -> None:
    """Parquet partitioned by kind, so that a filter on it prunes folders."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A corpus, chunks or a graph from JSON lines (or a file that is one JSON array); rows that are no
    JSON of the schema are skipped."""
    full = StructType(spark.createDataFrame([], schema).schema.fields + [StructField("_corrupt_record", StringType())])
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", False).json(path)
    return df.select("*", F.col("_metadata.file_name").alias("__f")).where("_corrupt_record is null").drop("_corrupt_record", "__f")


def write_with_statistics(df: DataFrame, path: str, statistics: dict[str, DataFrame]) -> None:
    """A corpus (chunks, a graph) as JSON lines under ``data``, and each of its aggregates, one file
    each, under its own name."""
    write_json(df, f"{path}/data")
    for name, table in statistics.items():
        write_json(table.coalesce(1), f"{path}/{name}")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables, partitioned by label and by relation, so that one label or
    relation is read without the others; replaces what was there."""
    vertices.write.mode("overwrite").partitionBy("doc_type").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def clear_graph(spark: SparkSession, path: str) -> None:
    """Empties both tables of a graph; their columns stay."""
    for name in ("vertices", "edges"):
        df = spark.read.parquet(f"{path}/{name}")
        df.limit(0).write.mode("overwrite").parquet(f"{path}/{name}")


def with_provenance(df: DataFrame, scraper: str, at: str) -> DataFrame:
    return df.withColumn("_scraped_at", F.lit(at).cast("timestamp")).withColumn("_scraper", F.lit(scraper))


def without_provenance(df: DataFrame) -> DataFrame:
    """What :func:`with_provenance` was given."""
    return df.drop("_scraped_at", "_scraper")


def read_vectors(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """(chunk_id, embedding); with ``dimension``, vectors of another length fail the read."""
    df = spark.read.parquet(path).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    if dimension is None:
        return df
    wrong = F.raise_error(F.concat(F.lit("a vector of another dimension: "), F.col("chunk_id"))).cast("array<float>")
    return df.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(wrong))


def write_vectors(df: DataFrame, path: str) -> None:
    df.select(F.col("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the table does not hold; returns what was new.  Running it again
    after a failure adds nothing twice."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        new = df.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001 - no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = df
    new = new.dropDuplicates([key])
    new.write.mode("append").parquet(path)
    return new


def upload(chunks: DataFrame, vectors: DataFrame, path: str, strict: bool = True) -> dict[str, int]:
    """Joins chunks with their vectors and writes them in one run, counted while written.  Chunks
    without a vector are an error, before anything is written (``strict=False`` leaves them out)."""
    from pyspark.sql import Observation

    if strict and (one := chunks.join(vectors, "chunk_id", "left_anti").select("chunk_id").first()):
        raise ValueError(f"no vector for chunk {one[0]}")
    seen = Observation("upload")
    joined = chunks.join(vectors, "chunk_id", "left").observe(seen, F.count("embedding").alias("written"), F.count_if(F.col("embedding").isNull()).alias("missing"))
    joined.where("embedding is not null").write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def send(rows: DataFrame, put, batch: int = 100, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """(batch, n, error) of rows sent to a store: ``put(list of dicts)`` takes a batch, is tried again
    with growing pauses, and a batch that fails is reported with its error and does not stop the rest.
    Batches are numbered ``<partition>-<n>``; sending again after a failure must not harm (upserts)."""
    import time

    import pandas as pd
    from pyspark import TaskContext

    def run(frames):
        part, n = TaskContext.get().partitionId(), 0
        for f in frames:
            out = []
            for lo in range(0, len(f), batch):
                some, error = f.iloc[lo : lo + batch].to_dict("records"), None
                for attempt in range(tries):
                    try:
                        put(some)
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a batch is recorded
                        error = f"{type(e).__name__}: {e}"
                        if attempt + 1 < tries:
                            time.sleep(wait * 2**attempt)
                out.append((f"{part}-{n}", len(some), error))
                n += 1
            yield pd.DataFrame(out, columns=["batch", "n", "error"])

    return rows.mapInPandas(run, "batch string, n long, error string")


def store_rows(chunks: DataFrame) -> DataFrame:
    """Rows as a vector store takes them: renamed id, dates that parse or null, empty defaults."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return chunks.select(
        F.col("id").alias("chunk_id"), text("doc_id"), text("doc_type"), text("level"), text("ancestry"), text("citation"), text("text"), text("text_with_ancestry"),
        F.try_to_date(F.col("effective_date").cast("string")).alias("effective_date"), F.coalesce("token_count", F.lit(0)).alias("token_count"),
    )


def ensure_table(spark: SparkSession, name: str, schema: str) -> bool:
    """Creates a managed table if it is missing; says whether it did."""
    if spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], schema).write.saveAsTable(name)
    return True


def drop_table(spark: SparkSession, name: str) -> bool:
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return there


def table_info(spark: SparkSession, name: str) -> dict:
    df = spark.table(name)
    return {"columns": df.columns, "rows": df.count()}


def schema_differences(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) columns."""
    have = set(df.columns)
    return sorted(set(expected) - have), sorted(have - set(expected))


def pdf_texts(spark: SparkSession, folder: str, parse) -> DataFrame:
    """(path, text) of PDF files through a pluggable parser ``bytes -> str | None`` in Arrow batches."""
    import pandas as pd

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [parse(x) for x in f["content"]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder).select("path", "content").mapInPandas(run, "path string, text string")
