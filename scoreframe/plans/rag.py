"""Retrieval metrics: what each asks of a model, and how its payload becomes a score.

``QUESTIONS`` holds prompts and payload types; ``with_question`` adds a metric's requests to rows; the functions below turn
payload columns into scores by native arithmetic. Payloads are JSON arguments of forced tool calls; since two metrics share
a tool's name, a payload's type goes by metric and step. Zero denominators give null unless a metric defines them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.lists import embedding_pairwise, list_score, with_matrix
from scoreframe.functions.scalar import clamp, embedding_score, f1_score, sum_of
from scoreframe.functions.score import as_score
from scoreframe.functions.template import render
from scoreframe.plans.config import EngineConfig, current
from scoreframe.plans.judge import arguments_of, request_column, request_key


@dataclass(frozen=True)
class Question:
    """One forced tool call: its tool, the payload's type, the prompt and the columns it needs."""

    tool: str
    payload: str
    prompt: str
    needs: tuple[str, ...]


QUESTIONS = {
    "ContextEntityRecall.expected": Question("extract_entities", "entities array<string>", "List every named entity in the text below, each once.\n\nText: {{expected}}", ("expected",)),
    "ContextEntityRecall.context": Question("extract_entities", "entities array<string>", "List every named entity in the text below, each once.\n\nText: {{context}}", ("context",)),
    "ContextRelevancy": Question("extract_sentences", "sentences array<struct<sentence: string, reasons: array<string>>>", "Copy, unchanged, the sentences of the context that are needed to answer the question. Copy none if none is.\n\nQuestion: {{input}}\n\nContext: {{context}}", ("input", "context")),
    "ContextRecall": Question("extract_statements", "statements array<struct<statement: string, attributed: int, reason: string>>", "Split the answer into statements. Mark each with 1 if the context supports it and with 0 if not, with a reason.\n\nQuestion: {{input}}\n\nContext: {{context}}\n\nAnswer: {{expected}}", ("input", "expected", "context")),
    "ContextPrecision": Question("verify", "reason string, verdict int", "Was the context useful in reaching the answer? Give a reason and a verdict of 1 or 0.\n\nQuestion: {{input}}\n\nAnswer: {{expected}}\n\nContext: {{context}}", ("input", "expected", "context")),
    "Faithfulness.statements": Question("extract_statements", "statements array<string>", "Split the answer into short statements that stand on their own.\n\nQuestion: {{input}}\n\nAnswer: {{output}}", ("input", "output", "context")),
    "Faithfulness.verdicts": Question("judge_statements", "faithfulness array<struct<statement: string, verdict: int, reason: string>>", "For each statement, tell whether it follows from the context: a verdict of 1 or 0 and a reason.\n\nContext: {{context}}\n\nStatements: {{statements}}", ("context", "statements")),
    "AnswerRelevancy": Question("generate_question", "question string, noncommittal int", "Write a question that the answer answers, and mark the answer with 1 if it is evasive, else 0.\n\nAnswer: {{output}}\n\nContext: {{context}}", ("input", "output", "context")),
    "AnswerCorrectness": Question("classify_statements", "TP array<string>, FP array<string>, FN array<string>", "Compare an answer with the ground truth, statement by statement. TP: in both. FP: in the answer only. FN: in the ground truth only.\n\nQuestion: {{input}}\n\nAnswer: {{output}}\n\nGround truth: {{expected}}", ("input", "output", "expected")),
}


def schema_of(payload: str) -> dict:
    """The JSON Schema of a payload's type."""
    from pyspark.sql import types as T

    def of(kind: T.DataType) -> dict:
        if isinstance(kind, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in kind.fields}, "required": kind.fieldNames()}
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType)}
        return {"type": "integer" if isinstance(kind, T.IntegerType) else "string"}

    return of(T._parse_datatype_string(payload))


def with_question(df: DataFrame, step: str, config: EngineConfig | None = None, model: str | None = None, temperature: float | None = None, repeats: int = 1) -> DataFrame:
    """Add request and request_key of a metric's step; with ``repeats`` each row is asked so often, told apart by ``turn``.

    Rows that lack a needed column's value get no request, and so a skipped score.
    """
    question = QUESTIONS[step]
    shown = df
    if "context" in df.columns and df.schema["context"].dataType.typeName() == "array":
        shown = df.withColumn("context", F.array_join("context", "\n"))
    tools = [{"type": "function", "function": {"name": question.tool, "parameters": schema_of(question.payload)}}]
    request = request_column(render(shown, question.prompt), (config or current()).rag_model(model), tools, question.tool, {"temperature": temperature})
    complete = F.lit(True)
    for c in question.needs:
        complete = complete & F.col(c).isNotNull()
    asked = shown.withColumn("request", F.when(complete, request))
    if repeats > 1:
        asked = asked.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        head = F.col("request")
        asked = asked.withColumn("request", F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(', "seed": '), F.col("turn").cast("string"), F.lit("}")))
    return asked.withColumn("request_key", request_key(F.col("request")))


def payload(response: Column, step: str) -> Column:
    """A step's payload, read from a response."""
    return F.from_json(arguments_of(response, QUESTIONS[step].tool), QUESTIONS[step].payload)


def context_relevancy(sentences: Column, context: Column) -> Column:
    """The share of the context's characters that the needed sentences make up, 1 at most."""
    return clamp(F.try_divide(sum_of(F.transform(sentences, lambda s: F.length(s["sentence"]))), F.length(context)))


def context_recall(statements: Column) -> Column:
    """The share of statements that the context supports; 0 without statements."""
    return F.when(statements.isNotNull(), F.coalesce(F.try_divide(sum_of(F.transform(statements, lambda s: s["attributed"])), F.size(statements)), F.lit(0.0)))


def faithfulness(verdicts: Column) -> Column:
    """The mean verdict; null without verdicts."""
    return F.try_divide(sum_of(F.transform(verdicts, lambda v: v["verdict"])), F.size(verdicts))


def answer_correctness(found: Column, similarity: Column | None, factuality_weight: float = 0.75, similarity_weight: float = 0.25) -> Column:
    """The weighted mean of the statements' F1 and the answers' similarity, which isn't computed where its weight is 0."""
    if factuality_weight < 0 or similarity_weight < 0 or not factuality_weight + similarity_weight:
        raise ValueError("weights must not be negative, and one must be positive")
    f1 = f1_score(F.size(found["TP"]), F.size(found["FP"]), F.size(found["FN"]))
    if not similarity_weight:
        return f1
    return (factuality_weight * f1 + similarity_weight * similarity) / (factuality_weight + similarity_weight)


def entity_recall(df: DataFrame, context_entities: Column, expected_entities: Column, expected_min: float = 0.7, metadata: dict[str, Column] | None = None) -> DataFrame:
    """Add ContextEntityRecall: how well the context's entities cover the expected ones, both arrays of embeddings; entities
    that weren't expected are free."""
    wide = with_matrix(df, context_entities, expected_entities, embedding_pairwise(expected_min))
    score = list_score(F.size(context_entities), F.size(expected_entities), allow_extra=True)
    return wide.withColumn("ContextEntityRecall", as_score("ContextEntityRecall", score, metadata)).drop("_matrix")


def answer_relevancy(rows: DataFrame, key: list[str], question_vector: str, input_vector: str, noncommittal: str, expected_min: float = 0.7, question: str | None = None, temperature: float | None = None) -> DataFrame:
    """One score per key from one row per generated question: 0 if any is noncommittal, else the mean similarity to the input.

    The metadata hold the questions (where ``question`` names their column), their similarities and the temperature.
    """
    similarity = embedding_score(F.col(question_vector), F.col(input_vector), expected_min)
    mean = F.when(F.max(noncommittal) > 0, F.lit(0.0)).otherwise(F.avg(similarity))
    text = F.col(question) if question else F.lit(None).cast("string")
    each = F.array_sort(F.collect_list(F.struct(text.alias("question"), F.col(noncommittal).alias("noncommittal"), similarity.alias("similarity"))))
    kept = {
        "questions": F.transform(each, lambda q: F.struct(q["question"].alias("question"), q["noncommittal"].alias("noncommittal"))),
        "similarity": F.transform(each, lambda q: q["similarity"]),
        "temperature": F.lit(temperature).cast("double"),
    }
    return rows.groupBy(*key).agg(as_score("AnswerRelevancy", mean, kept).alias("AnswerRelevancy"))


def answer_similarity(a: Column, b: Column, expected_min: float = 0.7) -> Column:
    """Embedding similarity of two answers; its score keeps the name of the embedding scorer."""
    return as_score("EmbeddingSimilarity", embedding_score(a, b, expected_min))


def embedding_requests(texts: DataFrame, text: str, model: str | None = None, prefix: str = "", config: EngineConfig | None = None) -> DataFrame:
    """The distinct embedding requests for a text column, keyed by model and prefixed text."""
    body = F.to_json(F.struct(F.lit(model or (config or current()).embedding_model).alias("model"), F.concat(F.lit(prefix), F.col(text)).alias("embed")))
    keyed = texts.where(F.col(text).isNotNull()).select(F.col(text), body.alias("request"))
    return keyed.dropDuplicates(["request"]).withColumn("request_key", request_key(F.col("request")))


def vector_of(response: Column) -> Column:
    """The vector in an embedding response."""
    return F.try_element_at(F.from_json(response, "data array<struct<embedding: array<double>>>")["data"], F.lit(1))["embedding"]


def moderation_of(response: Column) -> Column:
    """flagged and category_scores of a moderation response."""
    return F.try_element_at(F.from_json(response, "results array<struct<flagged: boolean, category_scores: map<string, double>>>")["results"], F.lit(1))
