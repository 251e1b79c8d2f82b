"""Published example values of the scorers."""

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreframe.functions import jsons, lists, scalar
from scoreframe.functions.score import as_score
from scoreframe.operators.scorers import ExactMatch, JSONDiff, Levenshtein, ListContains, ValidJSON, registry

#: Published pairs of inputs and scores that pin the rules.
TEXTS = [("", "", 1), ("", "a", 0), ("a", "", 0), ("a", "a", 1), ("a", "b", 0), ("ab", "ac", 0.5), ("ac", "bc", 0.5), ("abc", "axc", 0.66667), ("xabxcdxxefxgx", "1ab2cd34ef5g6", 0.53846), ("é", "e", 0)]
NUMBERS = [(0.0, 0.0, 1), (0.0, 1.0, 0), (1.0, 2.0, 0.66667), (-1.0, 2.0, 0)]
LISTS = [
    ([], [], 1), (["0"], [], 0), ([], ["0"], 0), (["a"], ["a"], 1), (["a"], ["a", "b"], 0.5), (["a", "b"], ["a"], 0.5),
    (["bread", "butter"], ["butter", "bred", "jam"], (0.8 + 1 + 0) / 3),
]
EXACT = [('{"a":1,"b":2}', '{"a": 1, "b": 2}', 1), ('{"a":1,"b":2}', '{"a":1,"b":3}', 0), ("[1,2,3]", "[1,2,3]", 1), ("[1,2,3]", "[3,2,1]", 0), ('{"a":1,"b":2}', '{"b":2,"a":1}', 0), ('{"a":1}', '{"a":1,"c":2}', 0)]
DIFFS = [
    ("null", "null", 1), ("null", '""', 0), ("[]", "{}", 0), ("[]", "[]", 1), ("{}", "{}", 1), ('{"a":1}', '{"a":1}', 1), ('{"a":1}', '{"a":2}', 0.66667),
    ('{"a":1}', '["a",1]', 0.57143), ('{"a":1}', '{"b":{"a":1}}', 0), ('{"a":1}', '{"a":null}', 0),
    ('{"names":{"u":"oak","v":"elm"}}', '{"names":{"u":"Oak","v":"Elm"},"more":[1]}', 0.33333),
    ('{"x":1,"y":2}', '{"y":2,"x":1}', 1), ('{"o1":{"x":2,"y":2}}', '{"o1":{"y":2,"x":1}}', 0.83333), ('{"x":1,"y":2}', '{"x":1,"z":2}', 0.33333),
    ("[1,2]", "[1,2]", 1), ("[1,2]", "[2,1]", 0.66667),
]
VALID = [("1", None, 0), ('{"a":1}', None, 1), ("[1]", None, 1), ("[1", None, 0), ("{a: 1}", None, 0), ("[1,2] x", None, 0), ("100", None, 0), ('"100"', None, 0), (None, None, 0)]
SCHEMA = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "number"}}, "required": ["a"]}
UNIQUE = {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/x"}, "$defs": {"x": {"type": "object", "required": ["a"]}}}


def got(df, column):
    return [None if r[0] is None else round(r[0], 5) for r in df.select(column).collect()]


def expected(cases):
    return [pytest.approx(c[2], abs=2e-5) for c in cases]


def test_levenshtein(spark):
    df = spark.createDataFrame(TEXTS, "output string, expected string, s double".replace("s double", "s string"))
    assert got(df, scalar.levenshtein_score(F.col("output"), F.col("expected"))) == expected(TEXTS)
    assert [jsons.edit_similarity(a, b) for a, b, _ in TEXTS] == expected(TEXTS)


def test_numeric(spark):
    df = spark.createDataFrame(NUMBERS, "output double, expected double, s string")
    assert got(df, scalar.numeric_score(F.col("output"), F.col("expected"))) == expected(NUMBERS)


def test_lists(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in LISTS], "output array<string>, expected array<string>")
    assert [None if v is None else round(v, 4) for v in got(ListContains().transform(df), F.col("ListContains.score"))] == [pytest.approx(c[2], abs=1e-4) for c in LISTS]
    back = df.select(F.col("output").alias("expected"), F.col("expected").alias("output"))
    assert got(ListContains().transform(back), F.col("ListContains.score")) == [pytest.approx(c[2], abs=1e-4) for c in LISTS]
    extra = spark.createDataFrame([(["a", "b"], ["a"])], df.schema)
    assert got(ListContains(allow_extra_entities=True).transform(extra), F.col("ListContains.score")) == [1.0]


def test_exact(spark):
    df = spark.createDataFrame([c[:2] for c in EXACT], "output string, expected string")
    assert got(df, jsons.exact_json(F.col("output"), F.col("expected"))) == expected(EXACT)
    plain = spark.createDataFrame([("hello", "hello"), ("hello", "world"), (None, None), (None, "None")], df.schema)
    assert got(ExactMatch().transform(plain), F.col("ExactMatch.score")) == [1, 0, 1, 1]
    struct = spark.createDataFrame([({"a": 1}, '{"a": 1}')], "output map<string,int>, expected string")
    assert got(ExactMatch().transform(struct), F.col("ExactMatch.score")) == [1]


def test_json_diff(spark):
    df = spark.createDataFrame([c[:2] for c in DIFFS], "output string, expected string")
    assert got(JSONDiff().transform(df), F.col("JSONDiff.score")) == expected(DIFFS)
    texts = spark.createDataFrame([c[:2] for c in TEXTS], df.schema)
    assert got(JSONDiff().transform(texts), F.col("JSONDiff.score")) == expected(TEXTS)


def test_typed_diff_is_the_same(spark):
    rows = [(((1.0, "ab"), [1.0, 2.0]), ((2.0, "ac"), [2.0])), (((None, "x"), []), ((None, "x"), [])), (((1.0, None), None), ((None, "y"), [1.0]))]
    df = spark.createDataFrame(rows, "o struct<p: struct<n: double, t: string>, l: array<double>>, e struct<p: struct<n: double, t: string>, l: array<double>>")
    native = got(df, jsons.typed_difference(F.col("o"), F.col("e"), df.schema["o"].dataType))
    text = got(df, jsons.json_difference(F.to_json("o"), F.to_json("e")))
    assert native == pytest.approx(text)


def test_valid_json(spark):
    df = spark.createDataFrame([(c[0],) for c in VALID], "output string")
    assert got(df, jsons.valid_json(F.col("output"))) == expected(VALID)
    rows = spark.createDataFrame([('{"a": "1"}',), ('{"b": "1"}',), ('{"a": "x", "b": "y"}',)], "output string")
    assert got(rows, jsons.valid_json(F.col("output"), SCHEMA)) == [1, 0, 0]
    many = spark.createDataFrame([('[{"a": 1}, {"a": 2}]',), ('[{"a": 1}, {"a": 1}]',), ('[{"b": 1}]',)], "output string")
    assert got(many, jsons.valid_json(F.col("output"), UNIQUE)) == [1, 0, 0]
    with pytest.raises(ValueError, match="unsupported"):
        jsons.valid_json(F.col("output"), {"unknownKeyword": 1})


def test_errors_and_skips(spark):
    df = spark.createDataFrame([("a", None)], "output string, expected string")
    assert got(Levenshtein().transform(df), F.col("Levenshtein.score")) == [None]
    with pytest.raises(Exception, match="required"):
        Levenshtein(on_error="raise").transform(df).collect()
    with pytest.raises(Exception, match="outside 0 to 1"):
        df.select(as_score("x", F.lit(2.0), on_error="raise")).collect()
    assert Levenshtein.partial(output="o")(expected="e") == Levenshtein(output="o", expected="e")


def test_registry(spark):
    counts = {r.label: r["count"] for r in registry(spark).groupBy("label").count().collect()}
    assert counts == {"LLM-as-a-Judge": 10, "RAG": 8, "Composite": 2, "Embeddings": 1, "Heuristic": 4}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 1000))
def test_assignment_is_best(n, m, seed):
    gain = np.random.default_rng(seed).random((n, m)).round(1)
    pairs = lists.best_assignment(gain)
    assert len(pairs) == min(n, m) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    small, large = sorted((n, m))
    of = (lambda r, c: gain[r, c]) if n <= m else (lambda r, c: gain[c, r])
    best = max(sum(of(i, c) for i, c in enumerate(p)) for p in itertools.permutations(range(large), small))
    assert sum(gain[r, c] for r, c in pairs) == pytest.approx(best)


def _value(r, depth=0):
    kind = r.choice("sndla" if depth < 2 else "sn")
    if kind == "s":
        return r.choice(["", "a", "ab", "xyz"])
    if kind == "n":
        return r.choice([None, 0, 1, 2.5, True])
    return {r.choice("abc"): _value(r, depth + 1) for _ in range(r.randint(0, 3))} if kind == "d" else [_value(r, depth + 1) for _ in range(r.randint(0, 3))]


def test_json_diff_properties():
    r = random.Random(1)
    score = lambda a, b: jsons.difference(a, b, jsons.edit_similarity, jsons.number_similarity, False)
    for _ in range(300):
        a, b = _value(r), _value(r)
        assert score(a, a) == 1
        assert 0 <= score(a, b) <= 1
        assert score(a, b) == pytest.approx(score(b, a))
        assert json.dumps(a) is not None


def scored_diff(spark, df, **options):
    return [None if r[0] is None else round(r[0], 5) for r in JSONDiff(**options).transform(df).select("JSONDiff.score").collect()]


def test_typed_values_are_scored_as_their_text(spark):
    """Structs, arrays, maps, unequal types, texts that hold JSON, and scorers of one's own."""
    kind = "struct<a: string, b: array<string>, c: struct<d: double, e: boolean>>"
    rows = [
        (("pear", ["x", "yz"], (1.0, True)), ("peer", ["x"], (2.0, None))),
        ((None, [], None), (None, None, (1.0, False))),
        (('{"k": 1}', ["[1, 2]"], None), ('{"k": 2}', ["[2, 2]", "q"], None)),
        (None, ("a", [], None)),
    ]
    df = spark.createDataFrame(rows, f"output {kind}, expected {kind}")
    as_text = df.select(F.to_json("output").alias("output"), F.to_json("expected").alias("expected"))
    assert scored_diff(spark, df) == scored_diff(spark, as_text)
    assert scored_diff(spark, df, preserve_strings=True) == scored_diff(spark, as_text, preserve_strings=True)
    zero = {"string_scorer": lambda a, b: 0.0, "number_scorer": lambda a, b: 0.25}
    assert scored_diff(spark, df, **zero) == scored_diff(spark, as_text, **zero) != scored_diff(spark, df)
    assert scored_diff(spark, df.withColumn("output", F.to_json("output"))) == scored_diff(spark, as_text)
    maps = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"a": 2.0})], "output map<string, double>, expected map<string, double>")
    assert scored_diff(spark, maps) == [round((2 / 3 + 0) / 2, 5)]
    unlike = spark.createDataFrame([((1,), (1, "x"))], "output struct<a: int>, expected struct<a: int, b: string>")
    assert scored_diff(spark, unlike) == [0.5]


def test_typed_values_are_valid_and_unequal_where_a_field_lacks(spark):
    df = spark.createDataFrame([((None, 1), (1,), [1], 5)], "output struct<a: int, b: int>, expected struct<b: int>, list array<int>, number int")
    valid = lambda **o: ValidJSON(**o).transform(df).first().ValidJSON.score
    assert valid() == 1 and valid(output="list") == 1 and valid(output="number") == 0 and valid(output="number", schema={"type": "integer"}) == 1
    assert valid(schema={"required": ["b"]}) == 1 and valid(schema={"required": ["a"]}) == 0
    assert ExactMatch().transform(df).first().ExactMatch.score == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9))
def test_edit_similarity_by_force(a, b):
    def steps(i, j):
        if not i or not j:
            return i + j
        return min(steps(i - 1, j) + 1, steps(i, j - 1) + 1, steps(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    a, b = a[:5], b[:5]
    assert jsons.edit_similarity(a, b) == pytest.approx(1 - steps(len(a), len(b)) / max(len(a), len(b), 1))
