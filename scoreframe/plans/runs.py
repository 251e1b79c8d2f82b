"""Whole runs of judges, moderation and retrieval metrics with a provider: ask, store, read, score.

Every function takes the rows, a provider and the path of its response table, and gives the rows with a score column. Rows
that lack a needed value are skipped (null). ``key`` names columns that tell rows apart, where rows are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.names import unused
from scoreframe.functions.scalar import EXPECTED_MIN, embedding_score, moderation_score
from scoreframe.functions.score import as_score
from scoreframe.plans import rag
from scoreframe.plans.config import MODERATION
from scoreframe.plans.judge import JudgeSpec, judged, request_key, with_requests
from scoreframe.sources.providers import answer_all


def run_judge(df: DataFrame, spec: JudgeSpec, provider, table: str, on_error: str = "null", **options) -> DataFrame:
    """A judge's score column; each distinct prompt is sent once."""
    asked = with_requests(df, spec, **options)
    return judged(asked, answer_all(asked, provider, table), spec, on_error).drop("prompt", "request", "request_key")


def _answered(asked: DataFrame, provider, table: str, value, out: str) -> DataFrame:
    key, response = unused([*asked.columns, out], "_key", "_response")
    told = answer_all(asked.where(F.col("request").isNotNull()), provider, table).select(F.col("request_key").alias(key), F.col("response").alias(response))
    joined = asked.join(told, F.col("request_key") == F.col(key), "left")
    return joined.withColumn(out, value(F.col(response))).drop("request", "request_key", key, response)


def ask(df: DataFrame, step: str, provider, table: str, out: str = "payload", **options) -> DataFrame:
    """Add a metric step's payload to every row."""
    return _answered(rag.with_question(df, step, **options), provider, table, lambda r: rag.payload(r, step), out)


def embed(df: DataFrame, text: str, provider, table: str, out: str, model: str | None = None, prefix: str = "") -> DataFrame:
    """Add the embedding of a text column; each distinct text is sent once, keyed by model and prefixed text."""
    [other] = unused([*df.columns, out], "_text")
    asked = rag.embedding_requests(df, text, model, prefix).withColumnRenamed(text, other)
    vectors = _answered(asked, provider, table, rag.vector_of, out)
    return df.join(vectors, F.col(text) == F.col(other), "left").drop(other)


def run_moderation(df: DataFrame, provider, table: str, text: str = "output", threshold: float | None = None, model: str = MODERATION) -> DataFrame:
    """The Moderation score column."""
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.col(text).alias("moderate")))
    asked = df.withColumn("request", F.when(F.col(text).isNotNull(), body)).withColumn("request_key", request_key(F.col("request")))
    [m] = unused(asked.columns, "_m")
    told = _answered(asked, provider, table, rag.moderation_of, m)
    score = moderation_score(F.col(f"{m}.flagged"), F.col(f"{m}.category_scores"), threshold)
    kept = {"threshold": F.lit(threshold).cast("double"), "category_scores": F.col(f"{m}.category_scores")}
    return told.withColumn("Moderation", as_score("Moderation", score, kept)).drop(m)


def embedding_similarity(df: DataFrame, provider, table: str, name: str = "EmbeddingSimilarity", output: str = "output", expected: str = "expected", model: str | None = None, prefix: str = "", expected_min: float = EXPECTED_MIN) -> DataFrame:
    """The scaled cosine of two texts' embeddings."""
    o, e = unused(df.columns, "_o", "_e")
    both = embed(embed(df, output, provider, table, o, model, prefix), expected, provider, table, e, model, prefix)
    return both.withColumn(name, as_score("EmbeddingSimilarity", embedding_score(F.col(o), F.col(e), expected_min))).drop(o, e)


def _with_text_context(df: DataFrame) -> Column:
    return F.array_join("context", "\n") if df.schema["context"].dataType.typeName() == "array" else F.col("context")


def context_relevancy(df: DataFrame, provider, table: str, **options) -> DataFrame:
    told = ask(df, "ContextRelevancy", provider, table, **options)
    score = rag.context_relevancy(F.col("payload.sentences"), _with_text_context(told))
    return told.withColumn("ContextRelevancy", as_score("ContextRelevancy", score, {"relevant_sentences": F.col("payload.sentences")})).drop("payload")


def context_recall(df: DataFrame, provider, table: str, **options) -> DataFrame:
    told = ask(df, "ContextRecall", provider, table, **options)
    score = rag.context_recall(F.col("payload.statements"))
    return told.withColumn("ContextRecall", as_score("ContextRecall", score, {"statements": F.col("payload.statements"), "recall": score})).drop("payload")


def context_precision(df: DataFrame, provider, table: str, **options) -> DataFrame:
    told = ask(df, "ContextPrecision", provider, table, **options)
    return told.withColumn("ContextPrecision", as_score("ContextPrecision", F.col("payload.verdict"), {"precision": F.col("payload")})).drop("payload")


def faithfulness(df: DataFrame, provider, table: str, **options) -> DataFrame:
    """Two steps: the answer's statements, then a verdict on each."""
    first = ask(df, "Faithfulness.statements", provider, table, **options).withColumn("statements", F.col("payload.statements")).drop("payload")
    told = ask(first, "Faithfulness.verdicts", provider, table, **options)
    kept = {"statements": F.col("statements"), "faithfulness": F.col("payload.faithfulness")}
    return told.withColumn("Faithfulness", as_score("Faithfulness", rag.faithfulness(F.col("payload.faithfulness")), kept)).drop("payload", "statements")


def answer_correctness(df: DataFrame, provider, table: str, factuality_weight: float = 0.75, similarity_weight: float = 0.25, expected_min: float = EXPECTED_MIN, **options) -> DataFrame:
    """Statements sorted into true and false, and, unless its weight is 0, the similarity of the answers."""
    told = ask(df, "AnswerCorrectness", provider, table, **options)
    if similarity_weight:
        told = embedding_similarity(told, provider, table, "_s", expected_min=expected_min)
    score = rag.answer_correctness(F.col("payload"), F.col("_s.score") if similarity_weight else None, factuality_weight, similarity_weight)
    f1 = rag.answer_correctness(F.col("payload"), None, 1.0, 0.0)
    kept = {"factuality": F.col("payload"), "factuality_score": f1}
    if similarity_weight:
        kept |= {"answer_similarity": F.col("_s"), "answer_similarity_score": F.col("_s.score")}
    return told.withColumn("AnswerCorrectness", as_score("AnswerCorrectness", score, kept)).drop("payload", "_s")


def answer_relevancy(df: DataFrame, key: list[str], provider, table: str, strictness: int = 3, temperature: float = 0.5, expected_min: float = EXPECTED_MIN, **options) -> DataFrame:
    """Questions generated from each answer, compared with the input; rows are told apart by key."""
    told = ask(df, "AnswerRelevancy", provider, table, temperature=temperature, repeats=strictness, **options)
    told = told.withColumn("_question", F.col("payload.question")).withColumn("_evasive", F.col("payload.noncommittal"))
    told = embed(embed(told, "_question", provider, table, "_q"), "input", provider, table, "_i")
    return df.join(rag.answer_relevancy(told, key, "_q", "_i", "_evasive", expected_min, "_question", temperature), key, "left")


def context_entity_recall(df: DataFrame, key: list[str], provider, table: str, expected_min: float = EXPECTED_MIN, **options) -> DataFrame:
    """Entities of the context and of the expected answer, matched one to one by their embeddings."""
    told = df
    for side in ("context", "expected"):
        told = ask(told, f"ContextEntityRecall.{side}", provider, table, **options).withColumn(f"_{side}", F.col("payload.entities")).drop("payload")
        each = embed(told.select(*key, F.posexplode(f"_{side}").alias("_place", "_entity")), "_entity", provider, table, "_v")
        vectors = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_v"))), lambda x: x["_v"])
        told = told.join(each.groupBy(*key).agg(vectors.alias(f"_{side}_v")), key, "left")
    none = F.array().cast("array<array<double>>")
    filled = lambda side: F.when(F.size(f"_{side}") == 0, none).otherwise(F.col(f"_{side}_v"))
    kept = {"context_entities": F.col("_context"), "expected_entities": F.col("_expected")}
    scored = rag.entity_recall(told, filled("context"), filled("expected"), expected_min, kept)
    return scored.drop("_context", "_expected", "_context_v", "_expected_v")
