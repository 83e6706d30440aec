"""Steps of answering and judging around a pluggable model, over whole batches of questions.

A ``Completer`` maps a column of prompts to a column of replies; a reply that failed is null.  What a
failed or unusable reply leads to is defined at each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import text as T
from statloom.operators import answers as A
from statloom.operators import evaluation as E
from statloom.operators.answers import Completer

#: The shapes of a judge's and of a claim checker's reply, and the names of verdicts.
JUDGMENT = "struct<correctness:double,completeness:double,clarity:double,citation_accuracy:double,hallucinations:array<string>,missing_concepts:array<string>,overall_score:double,reasoning:string>"
CLAIM_REPLY = "struct<verdict:string,confidence:double,reasoning:string>"
VERDICTS = {"SUPPORTED": "supported", "PARTIALLY_SUPPORTED": "partial", "CONTRADICTED": "contradicted", "NOT_SUPPORTED": "not_supported"}
#: What passes, how much of a source is kept with a verdict, chunks of an answer's context.
PASSING, KEPT_SOURCE, CONTEXT_CHUNKS = 7.0, 500, 10
NO_CONTEXT = "There is not enough context to answer this question."
FAILED = "The answer could not be generated."
UNVERIFIED = "\n\n**Note:** This response could not be checked against the available sources."


def _listed(c: Column) -> Column:
    """A list in a prompt, ``N/A`` where it is empty."""
    joined = F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    return F.when(joined == "", "N/A").otherwise(joined)


def judge_prompt(question: Column, answer: Column, contains: Column, statutes: Column, rules: Column) -> Column:
    return F.concat(
        F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\nExpected: "), _listed(contains), F.lit("\nStatutes: "), _listed(statutes), F.lit("\nRules: "), _listed(rules),
        F.lit("\nAnswer: "), F.coalesce(answer, F.lit("")),
    )


def judged(answers: DataFrame, complete: Completer, prompt: Column) -> DataFrame:
    """Adds a judge's scores (0 to 10; a score the reply lacks is 0), its findings, and ``passed``: at
    least 7 in all and nothing made up.  Answers that are empty, and replies that are no JSON, are
    not judged: their columns are null."""
    asked = answers.withColumn("__reply", F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", complete(prompt)))
    j = A.reply(F.col("__reply"), JUDGMENT)
    usable = F.col("__reply").isNotNull() & F.coalesce(F.col("__reply").contains("{"), F.lit(False))
    none = F.array().cast("array<string>")
    zero = lambda name: F.when(usable, F.coalesce(F.col("__j")[name], F.lit(0.0)))
    out = asked.withColumn("__j", j)
    for name in ("correctness", "completeness", "clarity", "citation_accuracy", "overall_score"):
        out = out.withColumn(name, zero(name))
    for name in ("hallucinations", "missing_concepts"):
        out = out.withColumn(name, F.when(usable, F.coalesce(F.col("__j")[name], none)))
    return out.withColumn("passed", F.when(usable, (F.col("overall_score") >= PASSING) & (F.size("hallucinations") == 0))).drop("__reply", "__j")


def claim_verdicts(claims: DataFrame, complete: Completer) -> DataFrame:
    """(… of claims(claim, source_text), verdict, confidence): a reply without a verdict means not
    supported at 0.5, no reply or no JSON means not supported at 0."""
    said = complete(F.concat(F.lit("Claim: "), F.col("claim"), F.lit("\nSource: "), F.coalesce("source_text", F.lit(""))))
    inner = F.regexp_extract(F.coalesce(said, F.lit("")), r"(?s)\{[^{}]*\}", 0)
    r = claims.withColumn("__r", F.from_json(F.nullif(inner, F.lit("")), CLAIM_REPLY))
    names = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    usable = F.col("__r").isNotNull() & (F.col("__r.verdict").isNotNull() | F.col("__r.confidence").isNotNull() | F.col("__r.reasoning").isNotNull())
    verdict = F.coalesce(F.try_element_at(names, F.coalesce("__r.verdict", F.lit("NOT_SUPPORTED"))), F.lit("not_supported"))
    out = r.withColumn("verdict", F.when(usable, verdict).otherwise("not_supported")).withColumn("confidence", F.when(usable, F.coalesce("__r.confidence", F.lit(0.5))).otherwise(0.0))
    return out.withColumn("source_text", F.substring(F.coalesce("source_text", F.lit("")), 1, KEPT_SOURCE)).drop("__r")


def synthesized(questions: DataFrame, chunks: DataFrame, complete: Completer, key: str = "query_id") -> DataFrame:
    """(key, answer, n_citations, n_verified, confidence, warning) from the first chunks of each
    question.  Without chunks there is a refusal, with a failed reply a note; both have confidence 0."""
    context = A.context_block(chunks, key, CONTEXT_CHUNKS)
    asked = questions.select(key, "query").join(context, key, "left")
    said = complete(F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query")))
    answers = asked.select(key, F.when(F.col("context").isNull(), NO_CONTEXT).otherwise(F.coalesce(said, F.lit(FAILED))).alias("answer"), F.col("context").isNotNull().alias("had_context"))
    cited = answers.select(key, F.posexplode(T.cited_sources(F.col("answer"))).alias("position", "citation_text"))
    checked = A.verified_citations(cited, chunks.where(F.col("rank") <= CONTEXT_CHUNKS), key)
    n = checked.groupBy(key).agg(F.count("*").alias("n_citations"), F.count_if("verified").alias("n_verified"))
    sure = E.answer_confidence(chunks.where(F.col("rank") <= CONTEXT_CHUNKS), checked, key)
    out = answers.join(n, key, "left").join(sure, key, "left").fillna(0, ["n_citations", "n_verified"])
    real = F.col("had_context") & (F.col("answer") != FAILED)
    bad = F.col("n_citations") - F.col("n_verified")
    warning = F.when(~F.col("had_context"), "no documents in context").when(F.col("answer") == FAILED, "model call failed").when(bad > 0, F.concat(bad.cast("string"), F.lit(" citation(s) could not be verified")))
    return out.select(key, "answer", "n_citations", "n_verified", F.when(real, F.col("confidence")).otherwise(0.0).alias("confidence"), warning.alias("warning"))


def corrected(answers: DataFrame, complete: Completer) -> DataFrame:
    """Adds ``how``, ``corrected_answer``, ``n_corrected`` and ``confidence_change`` to answers(answer,
    findings, context): no findings leave the answer as it is; findings that are all simple (a
    suggestion, severity below 0.5, found in the text) are replaced; else the model corrects it, and
    where that fails a note is added."""
    f, n = F.coalesce("findings", F.array().cast(answers.schema["findings"].dataType)), F.size("findings")
    simple = lambda h: h["suggested_correction"].isNotNull() & (h["suggested_correction"] != "") & (h["severity"] < 0.5) & (F.call_function("locate", h["claim_text"], F.col("answer")) > 0)
    base = answers.withColumn("findings", f)
    kind = F.when(n == 0, "none").when(F.forall("findings", simple), "simple").otherwise("model")
    listed = F.array_join(F.transform("findings", lambda h: F.concat(F.lit('- Claim: "'), F.coalesce(h["claim_text"], F.lit("")), F.lit('", suggestion: '), F.coalesce(h["suggested_correction"], F.lit("Remove claim")))), "\n")
    prompt = F.concat(F.lit("Response: "), F.coalesce("answer", F.lit("")), F.lit("\nFindings:\n"), listed, F.lit("\nContext: "), F.coalesce("context", F.lit("")))
    done = base.withColumn("how", kind).withColumn("__s", A.simple_corrections(F.col("answer"), F.col("findings"))).withColumn("__m", F.when(F.col("how") == "model", complete(prompt)))
    mean = F.aggregate("findings", F.lit(0.0), lambda s, h: s + F.coalesce(h["severity"].cast("double"), F.lit(0.0))) / n
    how = F.when((F.col("how") == "model") & F.col("__m").isNull(), "failed").otherwise(F.col("how"))
    return (
        done.withColumn("how", how)
        .withColumn("corrected_answer", F.when(F.col("how") == "simple", F.col("__s.text")).when(F.col("how") == "model", F.col("__m")).when(F.col("how") == "failed", F.concat(F.coalesce("answer", F.lit("")), F.lit(UNVERIFIED))).otherwise(F.col("answer")))
        .withColumn("n_corrected", F.when(F.col("how") == "simple", F.col("__s.corrected")).when(F.col("how") == "model", n).otherwise(0))
        .withColumn(
            "confidence_change",
            F.when(F.col("how") == "simple", A.confidence_change(F.col("__s.corrected"))).when(F.col("how") == "model", F.greatest(F.lit(-0.5), -0.2 - mean * 0.3)).when(F.col("how") == "failed", F.lit(-0.3)).otherwise(F.lit(0.0)),
        )
        .drop("__s", "__m")
    )


def run_report(questions: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row over a run: questions, those with and without a result, averages, F1 of the averages,
    score, pass rate and findings of those judged only.

    ``results(key, answer, precision, recall, contains, latency, overall_score, passed,
    hallucinations)`` has a row for each question that was answered."""
    n = questions.agg(F.count("*").alias("total_questions"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    g = results.join(questions.select(key), key, "left_semi").agg(
        F.count("*").alias("successful"), mean("precision").alias("p"), mean("recall").alias("r"), F.round(mean("contains"), 6).alias("avg_contains"), F.round(mean("latency"), 6).alias("avg_latency"),
        F.round(mean("overall_score"), 6).alias("avg_score"), F.round(mean(F.col("passed").cast("double")), 6).alias("pass_rate"), F.coalesce(F.sum(F.size("hallucinations")).cast("long"), F.lit(0)).alias("total_hallucinations"),
    )
    both = n.join(g)  # one row each
    return both.select(
        "total_questions", "successful", (F.col("total_questions") - F.col("successful")).alias("failed"), F.round("p", 6).alias("avg_precision"), F.round("r", 6).alias("avg_recall"), F.round(E.f1(F.col("p"), F.col("r")), 6).alias("avg_f1"),
        "avg_contains", "avg_latency", "avg_score", "pass_rate", "total_hallucinations",
    )
