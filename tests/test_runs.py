"""Whole runs against a stand-in for a model that answers by rule."""

import json

import pytest
from pyspark.sql import functions as F

from scoreframe.operators.scorers import judge, python_scorer
from scoreframe.plans import runs
from scoreframe.sources.providers import FunctionProvider

ROWS = [(1, "q1", "out one", "out one", ["Hello world.", "More text."]), (2, "q2", "other", "out one", ["Nothing."]), (3, "q3", None, None, None)]


def model():
    def vector(text):
        return [1.0, 0.0] if text in ("out one", "q1", "Paris") else [0.0, 1.0]

    def answer(request):
        body = json.loads(request)
        if "moderate" in body:
            bad = body["moderate"] == "other"
            return json.dumps({"results": [{"flagged": bad, "category_scores": {"x": 0.9 if bad else 0.3}}]})
        if "embed" in body:
            return json.dumps({"data": [{"embedding": vector(body["embed"])}]})
        tool, prompt = body["tool_choice"]["function"]["name"], body["messages"][0]["content"]
        told = {
            "select_choice": {"choice": "C" if "out one" in prompt.split("Submission:")[-1] else "D", "reasons": "r"},
            "extract_entities": {"entities": ["Paris", "Rome"] if "Hello" in prompt else ["Paris"]},
            "extract_sentences": {"sentences": [{"sentence": "Hello world.", "reasons": []}] if "Hello" in prompt else []},
            "extract_statements": {"statements": [{"statement": "a", "attributed": 1, "reason": ""}, {"statement": "b", "attributed": 0, "reason": ""}] if "supports" in prompt else ["s1", "s2"]},
            "judge_statements": {"faithfulness": [{"statement": "s1", "verdict": 1, "reason": ""}, {"statement": "s2", "verdict": int("Hello" in prompt), "reason": ""}]},
            "verify": {"reason": "", "verdict": int("Hello" in prompt)},
            "generate_question": {"question": "q1", "noncommittal": int("other" in prompt)},
            "classify_statements": {"TP": ["a"], "FP": [], "FN": ["b"]},
        }[tool]
        return json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"name": tool, "arguments": json.dumps(told)}}]}}]})

    return FunctionProvider(answer)


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "id long, input string, output string, expected string, context array<string>")


def scores(df, name):
    return [None if r[1] is None else pytest.approx(r[1]) for r in df.select("id", F.col(f"{name}.score")).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("name", "run", "want"),
    [
        ("ContextRelevancy", runs.context_relevancy, [12 / 23, 0.0, None]),
        ("ContextRecall", runs.context_recall, [0.5, 0.5, None]),
        ("ContextPrecision", runs.context_precision, [1.0, 0.0, None]),
        ("Faithfulness", runs.faithfulness, [1.0, 0.5, None]),
        ("AnswerCorrectness", runs.answer_correctness, [0.75 * 2 / 3 + 0.25, 0.75 * 2 / 3, None]),
        ("EmbeddingSimilarity", runs.embedding_similarity, [1.0, 0.0, None]),
        ("Moderation", runs.run_moderation, [1.0, 0.0, None]),
    ],
)
def test_metrics(df, tmp_path, name, run, want):
    assert want == scores(run(df, model(), str(tmp_path / "r")), name)


def test_metadata(df, tmp_path):
    of = lambda scored, name: json.loads(scored.orderBy("id").first()[name].metadata)
    told = of(runs.answer_correctness(df, model(), str(tmp_path / "c")), "AnswerCorrectness")
    assert told["factuality"]["TP"] == ["a"] and told["factuality_score"] == pytest.approx(2 / 3) and told["answer_similarity_score"] == 1.0 and told["answer_similarity"]["name"] == "EmbeddingSimilarity"
    told = of(runs.answer_relevancy(df, ["id"], model(), str(tmp_path / "a"), temperature=0.25), "AnswerRelevancy")
    assert told == {"questions": [{"question": "q1", "noncommittal": 0}] * 3, "similarity": [1.0] * 3, "temperature": 0.25}
    told = of(runs.context_entity_recall(df, ["id"], model(), str(tmp_path / "b")), "ContextEntityRecall")
    assert told == {"context_entities": ["Paris", "Rome"], "expected_entities": ["Paris"]}


def test_keyed_metrics(df, tmp_path):
    assert scores(runs.answer_relevancy(df, ["id"], model(), str(tmp_path / "a")), "AnswerRelevancy")[:2] == [1.0, 0.0]
    assert scores(runs.context_entity_recall(df, ["id"], model(), str(tmp_path / "b")), "ContextEntityRecall") == [1.0, 1.0, None]


def test_moderation_threshold(df, tmp_path):
    assert scores(runs.run_moderation(df, model(), str(tmp_path / "r"), threshold=0.25), "Moderation") == [0.0, 0.0, None]


def test_judge_run(df, tmp_path):
    assert scores(runs.run_judge(df, judge("Factuality"), model(), str(tmp_path / "r")), "Factuality")[:2] == [1.0, 0.0]


def test_python_scorer(df):
    same_length = python_scorer("SameLength", lambda o, e: None if o is None else float(len(o) == len(e)))
    assert scores(same_length.transform(df), "SameLength") == [1.0, 0.0, None]
