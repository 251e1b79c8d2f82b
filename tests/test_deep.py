"""JSON difference as tables, native maps, edit distance of long texts, JSON Schema keyword by keyword, and helper names."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.functions import editing, jsons, schema
from scoreframe.operators.scorers import ExactMatch, JSONDiff, Levenshtein, ListContains, NumericDiff, ValidJSON
from scoreframe.plans import evaluate, runs
from scoreframe.plans.jsondiff import difference_table
from scoreframe.sources.providers import FunctionProvider

# --- difference


def values(rng, depth=3):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return rng.choice([None, True, False, 0, 1.5, -3, 12, "", "abc", "abd", "ü", '{"a": 1}', "[1, 2]", '{"a": {"b": "x"}}', 10**25])
    if kind == 6:
        return [values(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: values(rng, depth - 1) for k in rng.sample(["a", "b", "c", "#0", ".", ""], rng.randrange(5))}


def texts_of(n, seed):
    rng = random.Random(seed)
    out = [(None, None), (None, "{}"), ("{", "{"), ("[]", "{}"), ("[null]", "[]"), ('{"a": null}', "{}"), ('{"a": 1}', '["a", 1]'), ("[" * 5000, "[]"), ("NaN", "1"), ("3", "3"), ("{}", "{}"), ("[]", "[]")]
    for _ in range(n):
        a = values(rng)
        b = json.loads(json.dumps(a)) if rng.random() < 0.3 else values(rng)
        if isinstance(b, dict) and b and rng.random() < 0.5:
            b[rng.choice(list(b))] = values(rng, 1)
        out.append((json.dumps(a), json.dumps(b)))
    return [(i, *pair) for i, pair in enumerate(out)]


@pytest.mark.parametrize("preserve", [False, True])
def test_difference_table(spark, preserve):
    rows = texts_of(250, 7)
    df = spark.createDataFrame(rows, "id long, o string, e string").withColumn("score", F.lit("mine"))
    got = {r.id: r.score for r in difference_table(df.repartition(3), ["id"], "o", "e", preserve).collect()}
    want = {r.id: r.s for r in df.select("id", jsons.json_difference(F.col("o"), F.col("e"), preserve_strings=preserve).alias("s")).collect()}
    assert set(got) == set(want)
    for i, o, e in rows:
        nan = want[i] is None or want[i] != want[i]
        assert (got[i] is None or got[i] != got[i]) if nan else got[i] == pytest.approx(want[i], abs=1e-12), (o, e)
    plan = difference_table(df, ["id"], "o", "e")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "FullOuter" in plan and "levenshtein" in plan


def test_difference_table_of_repeated_keys(spark):
    df = spark.createDataFrame([(1, "[1]", "[2]"), (1, "[1]", "[2]"), (1, '"a"', '"b"'), (None, "1", "1")], "id long, o string, e string")
    got = sorted((r.id or 0, round(r.score, 6)) for r in difference_table(df, ["id"], "o", "e").collect())
    assert got == [(0, 1.0), (1, 0.0), (1, 0.666667)]
    assert difference_table(df.limit(0), ["id"], "o", "e").count() == 0


def test_maps_are_native(spark):
    kind = "map<string, struct<n: double, l: array<int>>>"
    rows = [({}, {}), ({"a": (1.0, [1])}, {"a": (2.0, [1, 2])}), ({"a": (1.0, [])}, {"b": (None, [])}), (None, {"a": (1.0, [])}), ({"a": None}, {"a": None}), ({"a": None}, {"b": None, "a": (1.0, [3])}), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, output {kind}, expected {kind}")
    scored = JSONDiff().transform(df)
    plan = scored._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Python" not in plan
    text = df.select("id", jsons.json_difference(F.to_json("output"), F.to_json("expected")).alias("s"))
    assert {r.id: r.JSONDiff.score for r in scored.collect()} == pytest.approx({r.id: r.s for r in text.collect()})
    texts = spark.createDataFrame([({"a": '{"x": 1}'}, {"a": '{"x": 2}'})], "output map<string, string>, expected map<string, string>")
    assert JSONDiff().transform(texts).first().JSONDiff.score == pytest.approx(2 / 3)
    assert not jsons.is_native(T.MapType(T.DoubleType(), T.DoubleType()))


# --- edit distance


def by_force(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abü漢", max_size=50), st.text("abü漢", max_size=50), st.integers(1, 70))
def test_distance(a, b, band):
    old, editing.BAND = editing.BAND, band
    try:
        assert editing.distance(a, b) == editing.distance(b, a) == by_force(a, b)
    finally:
        editing.BAND = old


def test_distance_of_long_texts(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(3000))
    near = list(base)
    for _ in range(90):
        at = rng.randrange(len(near))
        near[at : at + rng.randrange(3)] = rng.choice(["", "x", "yy"])
    pairs = [(base, "".join(near)), (base, base[700:] + base[:650]), (base[:900], "".join(rng.choice("abcdefgh") for _ in range(1200))), ("", base), (None, base), ("x" * 300_000, "x" * 299_000 + "y" * 1500)]
    df = spark.createDataFrame(pairs, "output string, expected string")
    got = [r[0] for r in df.select(editing.edit_distance(F.col("output"), F.col("expected"))).collect()]
    assert got == [None if a is None else 1500 if len(a) > 9000 else by_force(a, b) for a, b in pairs]
    short = df.where("length(output) < 5000")
    assert [r.Levenshtein.score for r in Levenshtein(long_texts=True).transform(short).collect()] == [r.Levenshtein.score for r in Levenshtein().transform(short).collect()]


# --- JSON Schema: keyword, schema, values that fit, values that don't

KEYWORDS = [
    ("type", {"type": ["integer", "null"]}, [1, 2.0, None], [1.5, True, "1"]),
    ("enum", {"enum": [1, "a", [1, {"b": 2.0}]]}, [1.0, "a", [1.0, {"b": 2}]], [True, "1", [1]]),
    ("const", {"const": False}, [False], [0, None, ""]),
    ("const number", {"const": 0}, [0, 0.0, -0.0], [False]),
    ("multipleOf", {"multipleOf": 0.5}, [1, 1.5, "x", 10**400], [0.7]),
    ("minimum", {"minimum": 2, "exclusiveMaximum": 3}, [2, 2.9, "a"], [1, 3]),
    ("lengths", {"minLength": 1, "maxLength": 2}, ["漢", "ab", 5], ["", "abc"]),
    ("pattern", {"pattern": "b.$"}, ["abc", 4], ["b"]),
    ("uniqueItems", {"uniqueItems": True}, [[1, True, "1", [1]], 3], [[1, 1.0], [{"a": 1}, {"a": 1.0}]]),
    ("counts", {"minItems": 1, "maxItems": 2, "minProperties": 1, "maxProperties": 1}, [[1], {"a": 1}, 0], [[], [1, 2, 3], {}, {"a": 1, "b": 2}]),
    ("required", {"required": ["a"]}, [{"a": None}, []], [{}]),
    ("properties", {"properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "number"}}, [{"a": "x", "b": 1}, []], [{"a": 1}, {"b": "x"}]),
    ("patternProperties", {"patternProperties": {"^x": {"type": "number"}, "z$": {"minimum": 3}}, "additionalProperties": False}, [{"x": 1, "z": 5, "xz": 4}], [{"xz": 1}, {"x": "a"}, {"y": 1}]),
    ("propertyNames", {"propertyNames": {"maxLength": 1}}, [{"a": 1}, 4], [{"ab": 1}]),
    ("items", {"items": {"type": "number"}}, [[1, 2], [], {}], [[1, "a"]]),
    ("prefixItems", {"prefixItems": [{"type": "string"}, {"type": "number"}], "items": False}, [["a", 1], ["a"], []], [["a", 1, 2], [1]]),
    ("listed items", {"items": [{"type": "string"}], "additionalItems": {"type": "number"}}, [["a", 1], []], [["a", "b"], [1]]),
    ("contains", {"contains": {"minimum": 5}, "minContains": 2, "maxContains": 3}, [[5, 6, 1], "x"], [[5], [5, 6, 7, 8]]),
    ("contains none", {"contains": {"type": "null"}, "minContains": 0}, [[], [1]], []),
    ("dependentRequired", {"dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 1}, {"b": 1}], [{"a": 1}]),
    ("dependentSchemas", {"dependentSchemas": {"a": {"required": ["b"]}}}, [{"a": 1, "b": 1}, {}], [{"a": 1}]),
    ("dependencies", {"dependencies": {"a": ["b"], "c": {"minProperties": 3}}}, [{"a": 1, "b": 1}], [{"a": 1}, {"c": 1}]),
    ("if", {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 0}}, ["ab", 3], ["a", -1]),
    ("if alone", {"if": {"type": "string"}, "then": {"minLength": 2}}, [-1], ["a"]),
    ("allOf", {"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2], [0, 3]),
    ("anyOf", {"anyOf": [{"type": "string"}, {"minimum": 2}]}, ["a", 2], [1]),
    ("oneOf", {"oneOf": [{"minimum": 2}, {"maximum": 4}]}, [1, 5], [3]),
    ("not", {"not": {"type": "number"}}, ["a"], [1]),
    ("pointer", {"$defs": {"a/b": {"minimum": 1}}, "$ref": "#/$defs/a~1b"}, [1], [0]),
    ("recursion", {"properties": {"next": {"$ref": "#"}, "v": {"type": "number"}}, "required": ["v"]}, [{"v": 1, "next": {"v": 2}}], [{"v": 1, "next": {}}]),
    ("anchor", {"$defs": {"x": {"$anchor": "here", "type": "string"}}, "items": {"$ref": "#here"}}, [["a"]], [[1]]),
    ("id", {"$id": "http://x.org/root", "$defs": {"x": {"$id": "other", "type": "string", "$defs": {"y": {"minimum": 3}}}}, "anyOf": [{"$ref": "other"}, {"$ref": "http://x.org/other#/$defs/y"}]}, ["a", 3], [1]),
    ("beside a reference", {"$defs": {"x": {"minimum": 1}}, "$ref": "#/$defs/x", "maximum": 2}, [1], [0, 3]),
    ("unevaluatedProperties", {"allOf": [{"properties": {"a": True}}], "if": {"required": ["c"]}, "then": {"properties": {"c": True}}, "unevaluatedProperties": False}, [{"a": 1}, {"a": 1, "c": 1}], [{"b": 1}]),
    ("unevaluated by a branch that fails", {"anyOf": [{"properties": {"a": {"type": "string"}}, "required": ["a"]}, {"properties": {"b": True}}], "unevaluatedProperties": False}, [{"a": "x"}, {"b": 1}], [{"a": 1}]),
    ("unevaluated inside", {"properties": {"in": {"properties": {"x": True}}}, "unevaluatedProperties": False}, [{"in": {"y": 1}}], [{"x": 1}]),
    ("unevaluatedItems", {"prefixItems": [{"type": "string"}], "contains": {"type": "null"}, "minContains": 0, "unevaluatedItems": {"type": "number"}}, [["a", 1, None]], [["a", "b"]]),
    ("boolean schemas", {"properties": {"a": False, "b": True}}, [{"b": 1}], [{"a": 1}]),
    ("notes", {"title": "t", "description": "d", "format": "email", "default": 1, "$comment": "c", "examples": []}, ["x", 1], []),
]


@pytest.mark.parametrize("name, rules, good, bad", KEYWORDS, ids=[k[0] for k in KEYWORDS])
def test_keyword(name, rules, good, bad):
    fits = schema.compile_schema(rules)
    assert [v for v in good if not fits(v)] == [] and [v for v in bad if fits(v)] == []


@pytest.mark.parametrize(
    "rules",
    [{"minimum": "1"}, {"properties": {"a": {"mimimum": 1}}}, {"items": {"pattern": "("}}, {"$defs": {"unused": {"type": "strng"}}}, {"allOf": []}, {"anyOf": {}}, {"required": "a"}, {"$ref": "#/$defs/none"}, {"if": {"foo": 1}},
     {"$ref": "http://elsewhere.org/x"}, {"$ref": "#nowhere"}, {"properties": {"a": 3}}, {"then": {"typ": "x"}}, {"not": {"enum": 3}}, {"patternProperties": {"(": {}}}, {"minContains": -1}, {"additionalProperties": {"x": 1}}, [], "x"],
)
def test_malformed_schemas_fail_on_the_driver(rules):
    with pytest.raises(ValueError):
        schema.compile_schema(rules)


def test_deep_texts_are_invalid(spark):
    deep = "[" * 100_000 + "]" * 100_000
    df = spark.createDataFrame([(deep, deep), ("{}", deep)], "output string, expected string")
    assert [r.ValidJSON.score for r in ValidJSON().transform(df).collect()] == [0.0, 1.0]
    assert [r.ValidJSON.score for r in ValidJSON(schema={"type": "object"}).transform(df).collect()] == [0.0, 1.0]
    assert [r.JSONDiff.score for r in JSONDiff().transform(df.limit(1)).collect()] == [1.0]
    assert [r.ExactMatch.score for r in ExactMatch().transform(df).collect()] == [1.0, 0.0]
    nest = {"$defs": {"l": {"items": {"$ref": "#/$defs/l"}}}, "$ref": "#/$defs/l"}
    assert schema.compile_schema(nest)([[[]]]) is True


TYPED = "struct<n: double, i: int, s: string, b: boolean, l: array<string>, o: struct<x: long, y: string>>"
TYPED_RULES = [
    {"type": "object"}, {"type": "array"}, {"required": ["n", "o"]}, {"required": ["zz"]}, {"properties": {"n": {"type": "number", "minimum": 1.5}}}, {"properties": {"n": {"type": "integer"}, "i": {"type": "integer"}}},
    {"properties": {"s": {"enum": ["a", 3, None]}, "b": {"const": True}}}, {"properties": {"l": {"items": {"type": "string", "maxLength": 1}, "minItems": 1}}}, {"properties": {"o": {"required": ["x"], "maxProperties": 1}}},
    {"minProperties": 5}, {"additionalProperties": {"type": ["number", "string"]}, "properties": {"b": True, "l": True, "o": {"type": "object"}}}, {"if": {"required": ["s"]}, "then": {"required": ["n"]}, "else": {"required": ["i"]}},
    {"oneOf": [{"required": ["n"]}, {"required": ["i"]}]}, {"not": {"properties": {"i": {"multipleOf": 2}}}}, {"anyOf": [{"properties": {"i": {"exclusiveMinimum": 3}}}, {"type": "null"}]}, {"$defs": {"a": {}}, "$ref": "#/$defs/a"}, {"type": ["object", "null"]}, True, False,
    {"properties": {"l": {"uniqueItems": True}, "s": {"pattern": "a"}}},
]


@pytest.mark.parametrize("rules", TYPED_RULES, ids=str)
def test_typed_columns_are_judged_as_their_text(spark, rules):
    rows = [(1.5, 2, "a", True, ["a"], (1, None)), (None, None, None, None, None, None), (float("nan"), 4, "b", False, [], (None, "y")), (2.0, None, "aa", None, ["a", "bb", None], (1, "y")), (0.5, 3, None, True, None, None), None]
    df = spark.createDataFrame([(r,) for r in rows], f"output {TYPED}")
    got = [r.ValidJSON.score for r in ValidJSON(schema=rules).transform(df).collect()]
    want = [r[0] for r in df.select(jsons.valid_json(F.to_json("output"), rules)).collect()]
    assert got == want
    expressed = schema.native(F.col("output"), df.schema["output"].dataType, rules) is not None
    assert expressed == all(k not in json.dumps(rules) for k in ("$ref", "uniqueItems", "pattern", "multipleOf"))


# --- helper names


def test_helper_names_clash_with_nothing(spark):
    clash = {c: F.lit(f"mine {c}") for c in ("_matrix", "_text", "_key", "_response", "_m", "_o", "_e", "_thread", "_case", "_s", "_at")}
    lists = spark.createDataFrame([(["a"], ["a", "b"])], "output array<string>, expected array<string>").withColumns(clash)
    got = ListContains().transform(lists)
    assert got.first().ListContains.score == 0.5 and got.first()["_matrix"] == "mine _matrix" and got.columns == [*lists.columns, "ListContains"]
    mixed = evaluate.dispatch(lists.withColumns({"how": F.lit("l"), "ListContains": F.lit("x")}), {"l": ListContains()}, "how")
    assert mixed.first().score == 0.5 and mixed.first().ListContains == "x"


def test_runs_with_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", "b")], "output string, expected string").withColumns({c: F.lit("mine") for c in ("_text", "_key", "_response", "_m", "_o", "_e")})
    vectors = FunctionProvider(lambda request: json.dumps({"data": [{"embedding": [1.0, float(len(json.loads(request)["embed"]))]}]}))
    got = runs.embedding_similarity(df, vectors, str(tmp_path / "e"), expected_min=0.0).first()
    assert got.EmbeddingSimilarity.score == pytest.approx(1.0) and got["_o"] == "mine"
    verdict = FunctionProvider(lambda request: json.dumps({"results": [{"flagged": False, "category_scores": {"x": 0.1}}]}))
    assert runs.run_moderation(df, verdict, str(tmp_path / "m")).first()["_m"] == "mine"


def test_dispatch_keeps_all_rows(spark):
    df = spark.createDataFrame([("n", "1", "2"), (None, "a", "b"), ("zz", "a", "b")], "how string, output string, expected string")
    got = sorted((r.how or "", r.score and round(r.score, 4), r.error) for r in evaluate.dispatch(df, {"n": NumericDiff()}, "how").collect())
    assert got == [("", None, "no such scorer: none is named"), ("n", 0.6667, None), ("zz", None, "no such scorer: zz")]
