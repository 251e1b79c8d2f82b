"""Rendering, requests, responses and retrieval metrics, without a network."""

import json

import pytest
from pyspark.sql import functions as F

from scoreframe.functions import template, thread
from scoreframe.operators.scorers import JUDGES, judge
from scoreframe.plans import config, rag
from scoreframe.plans.judge import JudgeSpec, judged, with_requests
from scoreframe.sources import providers

MESSAGES = [(1, 0, "system", "Be brief."), (1, 1, "user", "Which way is north?"), (1, 2, "assistant", "Fine."), (1, 3, "user", "Good."), (1, 4, "assistant", "Yes")]


@pytest.fixture
def threads(spark):
    return thread.collect_threads(spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string"))


def test_thread_templates(spark, threads):
    df = thread.add_variables(threads)
    shown = lambda t: df.select(template.render(df, t)).first()[0]
    assert shown("{{thread_count}}") == "4"
    assert shown("{{thread.0}}") == "user: Which way is north?"
    assert shown("{{user_messages}}").startswith("User:\n  Which")
    assert "Be brief" in shown("{{thread_with_system}}") and "Be brief" not in shown("{{thread}}")
    assert shown("{{#user_messages}}<{{content}}>{{/user_messages}}") == "<Which way is north?><Good.>"
    assert shown("{{first_message}} {{last_message}}") == "user: Which way is north? assistant: Yes"
    assert thread.uses_thread("a {{ thread_count }}") and not thread.uses_thread("{{input}} thread")


def test_sections_and_escapes():
    assert template.render_text("{{a}} {{{a}}} {{#b}}x{{.}}{{/b}}{{^c}}none{{/c}}{{! note }}", [{"a": "<&>", "b": [1, 2]}]) == "<&> <&> x1x2none"
    assert template.names("{{a.b}} {{#c}}{{d}}{{/c}}") == ["a", "c", "d"]


def test_tool_parts(spark):
    rows = [
        (1, 0, 0, "user", "text", "Go", None, None, None, None),
        (1, 1, 0, "assistant", "reasoning", "r" * 200, None, None, None, None),
        (1, 1, 1, "assistant", "tool_call", None, "id1", "find", '{"type":"valid","value":{"q":1}}', None),
        (1, 1, 2, "assistant", "tool_call", None, "id3", "late", '{"type":"invalid","value":"raw args"}', None),
        (1, 1, 3, "user", "tool_call", None, "id2", "not a caller", "{}", None),
        (1, 2, 0, "tool", "tool_result", None, "id1", None, None, '[{"type":"text","text":"{\\"text\\": \\"deep\\"}"},"two"]'),
        (1, 2, 1, "tool", "tool_result", None, "id1", None, None, "again\nand more"),
        (1, 3, 0, "tool", "tool_result", None, "id2", None, None, "error: 'bad'"),
        (1, 4, 0, "tool", "tool_result", None, "id3", "own", None, "log: Error: 'x' then more"),
        (1, 4, 1, "tool", "text", "left out", None, None, None, None),
        (1, 5, 0, "assistant", "text", "", None, None, None, None),
        (1, 6, 0, "assistant", "text", "one\ntwo", None, None, None, None),
    ]
    parts = spark.createDataFrame(rows, "conv_id long, turn long, place long, role string, type string, text string, tool_call_id string, tool_name string, arguments string, output string")
    out = thread.typed_thread_text(parts).first().text.split("\n\n")
    assert out == [
        "User:\n  Go",
        "Assistant:\n  [thinking: " + "r" * 100 + "...]",
        'Tool (find):\n  Args:\n    {"q": 1}\n  Result:\n    deep\ntwo',
        "Tool (tool):\n  Result:\n    again\nand more",
        "Tool (tool):\n  Result:\n    bad",
        "Tool (own):\n  Args:\n    raw args\n  Error:\n    log: Error: 'x' then more",
        "Assistant:\n  one\n  two",
    ]


def test_shortened(spark):
    df = spark.createDataFrame([("x" * 400,), ("a" * 500 + "b" * 500,)], "t string")
    short, long = (r[0] for r in df.select(thread.shortened(F.col("t"))).collect())
    assert short == "x" * 400 and "[...530 chars truncated...]" in long and len(long) == 500


@pytest.mark.parametrize("name", JUDGES)
def test_spec_files(name):
    spec = judge(name)
    assert spec.name == name and all(0 <= v <= 1 for v in spec.choice_scores.values())


def answers():
    """A stand-in for a model; nested, so that it is sent to workers whole."""

    def answer(request):
        body = json.loads(request)
        tool = body["tool_choice"]["function"]["name"]
        prompt = body["messages"][0]["content"]
        arguments = {"reasons": "because", "choice": " B " if "long answer" in prompt else "Z" if "odd" in prompt else "C"}
        return json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"name": tool, "arguments": json.dumps(arguments)}}]}}]})

    return answer


def test_judge_end_to_end(spark, tmp_path):
    rows = [(1, "q", "a", "e"), (2, "q", "long answer", "e"), (3, "q", "a", "e"), (4, "q", "odd", "e"), (5, "q", None, "e")]
    df = spark.createDataFrame(rows, "id long, input string, output string, expected string")
    spec = judge("Factuality", max_tokens=1, temperature=0.0)
    asked = with_requests(df, spec)
    body = json.loads(asked.first().request)
    assert body["max_tokens"] == 5 and body["temperature"] == 0 and body["model"] == "gpt-5-mini" and "engine" not in body
    table = str(tmp_path / "responses")
    responses = providers.answer_all(asked, providers.FunctionProvider(answers()), table)
    assert responses.count() == 4  # rows 1 and 3 are one request
    again = providers.answer_all(asked, providers.FunctionProvider(None), table)  # nothing is left to send
    assert again.count() == 4
    got = {r.id: r.Factuality for r in judged(asked, responses, spec).collect()}
    assert [got[i].score for i in (1, 2, 3, 4)] == [1.0, 0.6, 1.0, None]
    assert json.loads(got[2].metadata) == {"choice": "B", "rationale": "because"}
    with pytest.raises(Exception, match="unknown choice"):
        judged(asked, responses, spec, on_error="raise").collect()


@pytest.mark.parametrize(
    ("response", "why"),
    [
        ('{"choices": []}', "empty response"),
        ('{"choices": [{"message": {"content": "x"}}]}', "no tool call"),
        ('{"choices": [{"message": {"tool_calls": [{"function": {"name": "other", "arguments": "{}"}}]}}]}', "another tool called: other"),
        ('{"choices": [{"message": {"tool_calls": [{"function": {"name": "select_choice", "arguments": "{}"}}]}}]}', "no choice"),
    ],
)
def test_responses_without_a_choice(spark, response, why):
    spec = judge("Humor")
    df = spark.createDataFrame([("k", 1), ("none", 2)], "request_key string, response long")
    given = spark.createDataFrame([("k", response)], "request_key string, response string")
    got = {r.request_key: r.Humor for r in judged(df, given, spec).collect()}
    assert got["k"].score is None and why in json.loads(got["k"].metadata)["error"] and json.loads(got["none"].metadata) == {}
    with pytest.raises(Exception, match=why):
        judged(df, given, spec, on_error="raise").collect()


def test_failed_requests_do_not_lose_the_others(spark, tmp_path):
    def answer(request):
        if request == "bad":
            raise OSError("no route")
        return request.upper()

    asked = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "fine")], "request_key string, request string")
    table = str(tmp_path / "r")
    with pytest.raises(RuntimeError, match="1 requests failed.*no route"):
        providers.answer_all(asked, providers.FunctionProvider(answer), table)
    kept = {r.request_key: r.response for r in providers.answer_all(asked, providers.FunctionProvider(answer), table, on_error="null").collect()}
    assert kept == {"1": "GOOD", "3": "FINE"}
    later = providers.answer_all(asked, providers.FunctionProvider(str.title), table)
    assert {r.request_key: r.response for r in later.collect()} == {"1": "GOOD", "2": "Bad", "3": "FINE"}


def test_thread_in_judge(spark, threads):
    spec = JudgeSpec("T", "{{thread}} | {{input}}", {"A": 1.0}, use_cot=False)
    df = spark.createDataFrame([(1, "x")], "conv_id long, input string")
    prompt = with_requests(df, spec, threads=threads).first().prompt
    assert prompt.startswith("User:\n  Which way is north?\n\nAssistant:\n  Fine.") and "| x" in prompt


def test_responses_interface():
    chat = {"model": "gpt-5-mini", "messages": [{"role": "user", "content": "x"}], "max_tokens": 9, "reasoning_effort": "low", "tools": [{"type": "function", "function": {"name": "f"}}], "tool_choice": {"type": "function", "function": {"name": "f"}}}
    sent = providers.to_responses_request(chat)
    assert sent == {"model": "gpt-5-mini", "input": chat["messages"], "tools": [{"type": "function", "name": "f"}], "tool_choice": "required", "reasoning": {"effort": "low"}}
    back = providers.from_responses_response({"id": "1", "model": "m", "output": [{"type": "function_call", "call_id": "c", "name": "f", "arguments": "{}"}]})
    assert back["choices"][0]["message"]["tool_calls"][0]["function"] == {"name": "f", "arguments": "{}"}
    mixed = [{"type": "custom_tool_call", "call_id": "d", "name": "g", "input": "raw"}, {"type": "output_text", "text": "a"}, {"type": "message", "content": [{"text": "b"}]}]
    back = providers.from_responses_response({"id": "1", "model": "m", "created": 7, "stop_reason": "length", "output": mixed})
    assert (back["created"], back["choices"][0]["finish_reason"], back["choices"][0]["message"]["content"]) == (7, "length", "ab")
    assert back["choices"][0]["message"]["tool_calls"][0]["function"] == {"name": "g", "arguments": "raw"}
    assert providers.wants_responses_api(chat) and not providers.wants_responses_api({"model": "gpt-4"})


def test_config():
    c = config.EngineConfig().with_models({"completion": "a", "embedding": "b"})
    assert (c.completion_model, c.embedding_model) == ("a", "b")
    assert c.with_models("x").embedding_model == "text-embedding-ada-002" and c.with_models({"embedding": "z"}).completion_model == "a"
    assert c.with_models(None).completion_model == "gpt-5-mini" and c.with_models(None).rag_model() == "gpt-5-nano"


def test_rag_formulas(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    sentences = F.array(F.struct(F.lit("Hello world").alias("sentence")))
    assert value(rag.context_relevancy(sentences, F.lit("x" * 54))) == pytest.approx(11 / 54)
    assert value(rag.context_relevancy(sentences, F.lit("x"))) == 1.0
    nothing = F.from_json(F.lit('{"statements": []}'), rag.QUESTIONS["ContextRecall"].payload)["statements"]
    assert value(rag.context_recall(nothing)) == 0.0
    found = F.from_json(F.lit('{"TP": ["a"], "FP": [], "FN": ["b"]}'), rag.QUESTIONS["AnswerCorrectness"].payload)
    assert value(rag.answer_correctness(found, F.lit(0.5))) == pytest.approx(0.75 * 2 / 3 + 0.125)
    with pytest.raises(ValueError, match="weights"):
        rag.answer_correctness(found, None, 0, 0)


def test_rag_requests(spark):
    df = spark.createDataFrame([("q", "o", "e", ["c1", "c2"]), ("q", None, "e", None)], "input string, output string, expected string, context array<string>")
    asked = rag.with_question(df, "ContextRelevancy").collect()
    assert "c1\nc2" in json.loads(asked[0].request)["messages"][0]["content"] and asked[1].request is None
    repeated = rag.with_question(df, "AnswerRelevancy", repeats=3)
    assert repeated.where("request_key IS NOT NULL").select("request_key").distinct().count() == 3
    vector = F.lit('{"data": [{"embedding": [1.0, 2.0]}]}')
    assert df.select(rag.vector_of(vector)).first()[0] == [1.0, 2.0]
    assert df.select(rag.moderation_of(F.lit('{"results": [{"flagged": true, "category_scores": {"x": 0.5}}]}'))["flagged"]).first()[0]
