"""Files, case generators, dispatch by name and configuration of the session."""

import json

import pytest
from pyspark.sql import functions as F

from scoreframe.operators.scorers import JSONDiff, Levenshtein, ListContains, NumericDiff
from scoreframe.plans import config, evaluate
from scoreframe.sources import cases, files

DOC = {"source": "s", "story": "The cat sat. The dog ran.", "questions": ["Who sat?", "Who ran?"], "answers": {"input_text": ["cat", "dog"], "answer_start": [0, 13], "answer_end": [12, 25]}}


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([DOC, DOC]))
    df = files.read_json_array(spark, str(tmp_path / "a.json"), files.QA_CORPUS)
    assert df.count() == 2
    files.write_json(df, str(tmp_path / "out"))
    assert spark.read.schema(files.QA_CORPUS).json(str(tmp_path / "out")).first() == df.first()
    (tmp_path / "bad.json").write_text('[{"story": {"not": "text"}, "questions": 3}]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_json_array(spark, str(tmp_path / "bad.json"), files.QA_CORPUS).collect()


def test_cases(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([DOC]))
    corpus = files.read_json_array(spark, str(tmp_path / "a.json"), files.QA_CORPUS)
    facts = cases.factuality_cases(corpus).collect()
    assert [(r.input.output, r.expected) for r in facts] == [("cat", 1.0), ("dog", 0.0), ("cat dog", 0.6)]
    spans = cases.relevancy_cases(corpus).collect()
    assert [r.input.context for r in spans] == ["The cat sat.", "The dog ran.", "The cat sat. The dog ran."]
    assert [r.expected for r in spans] == [1.0, 0.0, pytest.approx(12 / 25)]
    closed = cases.closed_qa_cases(corpus).collect()
    assert [(r.input.output, r.expected, r.tags) for r in closed] == [("cat", 1.0, ["closed q a"]), ("dog", 0.0, ["closed q a"])]


def test_cases_hold_the_story_and_three_answers(spark):
    answers = {"input_text": ["cat", "dog", "sun"], "answer_start": [0, 13, 0], "answer_end": [12, 25, 3]}
    corpus = spark.createDataFrame([DOC | {"answers": answers}], files.QA_CORPUS)
    assert cases.factuality_cases(corpus).collect()[2].input.output == "dog cat sun"
    asked = "Story:\nThe cat sat. The dog ran.\n\nWhat is asked about it: Who sat?"
    assert [r.input.input for r in cases.closed_qa_cases(corpus).collect()] == [asked] * 2


def test_dispatch_and_report(spark):
    df = spark.createDataFrame([("lev", "ab", "ac"), ("json", '{"a":1}', '{"a":2}'), ("num", "1", "2")], "scorer string, output string, expected string")
    scored = evaluate.dispatch(df, {"lev": Levenshtein(), "json": JSONDiff(), "num": NumericDiff()}, "scorer")
    assert {r.scorer: round(r.score, 5) for r in scored.collect()} == {"lev": 0.5, "json": 0.66667, "num": 0.66667}
    total = evaluate.report(scored, ["scorer"]).where("scorer IS NULL").first()
    assert total.scored == 3 and total.skipped == 0
    lists = spark.createDataFrame([(["a"], ["a", "b"])], "output array<string>, expected array<string>")
    found = evaluate.evaluate(lists, [ListContains()], {"run": "r1"}).first()
    assert found.run == "r1" and json.loads(found.ListContains.metadata)["pairs"] == [{"output": "a", "expected": "a", "score": 1.0}]


def test_session_configuration():
    assert config.init("m").completion_model == "m" and config.current().embedding_model == config.EMBEDDING
    assert config.init({"embedding": "e"}).completion_model == "m"
    assert config.init().completion_model == config.COMPLETION and F is not None
