"""Scores of JSON: strict parsing, structural difference and validation.

Structs, arrays, maps and numbers of one type are compared by native expressions (``typed_difference``). Free JSON text is
recursive, which no built-in function expresses, so it goes through small Arrow-batched helpers, as do typed values of two types
and rows in which a text holds JSON itself. Spark's own parsers accept text after the value, so validity is told by a strict
parser. A field of a struct that has no value isn't there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.functions.editing import similarity as edit_similarity
from scoreframe.functions.scalar import exact_score, levenshtein_score, numeric_score
from scoreframe.functions.schema import compile_schema, native

Leaf = Callable[[object, object], float | None]
CONTAINERS = (T.StructType, T.MapType, T.ArrayType)


def number_similarity(output: float, expected: float) -> float:
    """The numeric score of two numbers, for leaves inside JSON."""
    total = abs(expected) + abs(output)
    return 1.0 if total == 0 else 1 - abs(expected - output) / total


def parsed_or_text(text: str | None) -> object:
    """What a JSON text says; one that isn't JSON, or is nested too deeply to be read, is a string, null is JSON null."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return text


def opened(text: object) -> object:
    """The object or array that a text is, else the text."""
    if isinstance(text, str):
        value = parsed_or_text(text) if text.lstrip(" \t\n\r")[:1] in ("[", "{") else text
        return value if isinstance(value, dict | list) else text
    return text


def difference(o: object, e: object, string: Leaf, number: Leaf, preserve: bool) -> float | None:
    """The similarity of two JSON values: the mean over the union of keys, or over the longer array's places."""
    if not preserve:
        o, e = opened(o), opened(e)
    if isinstance(o, dict) and isinstance(e, dict):
        parts, count = [difference(o.get(k), e.get(k), string, number, preserve) for k in {**o, **e}], None
    elif isinstance(o, list) and isinstance(e, list):
        parts, count = [difference(a, b, string, number, preserve) for a, b in zip(o, e, strict=False)], max(len(o), len(e))
    elif isinstance(o, str) and isinstance(e, str):
        return string(o, e)
    elif isinstance(o, int | float) and isinstance(e, int | float):
        return number(o, e)
    elif o is None or e is None:
        return float(o is e)
    else:
        text = lambda v: json.dumps(v, separators=(",", ":"), sort_keys=True)
        return string(text(o), text(e))
    known = [p for p in parts if p is not None]
    if not (o or e):
        return 1.0
    return sum(known) / (count or len(known)) if known or count else None


def json_difference(output: Column, expected: Column, string_scorer: Leaf = edit_similarity, number_scorer: Leaf = number_similarity, preserve_strings: bool = False) -> Column:
    """The structural similarity of two columns of JSON text; text that isn't JSON is a string, null is JSON null."""

    def judge(x: str | None, y: str | None) -> float | None:
        try:
            return difference(parsed_or_text(x), parsed_or_text(y), string_scorer, number_scorer, preserve_strings)
        except RecursionError:  # nested too deeply to be compared part by part
            return string_scorer(x or "null", y or "null")

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([judge(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(output, expected)


def typed_difference(output: Column, expected: Column, kind: T.DataType, string=levenshtein_score, number=numeric_score) -> Column:
    """The same for columns of one known type, as a native expression generated from the type."""
    if isinstance(kind, T.StructType):
        parts = [typed_difference(output[f.name], expected[f.name], f.dataType, string, number) for f in kind.fields]
        shown = [output[f.name].isNotNull() | expected[f.name].isNotNull() for f in kind.fields]  # a key that neither has isn't there
        total = reduce(lambda a, b: a + b, [F.when(s, p).otherwise(F.lit(0.0)) for p, s in zip(parts, shown, strict=True)])
        count = reduce(lambda a, b: a + b, [s.cast("int") for s in shown])
        inner = F.coalesce(F.try_divide(total, count), F.lit(1.0))
    elif isinstance(kind, T.ArrayType):
        pairs = F.zip_with(output, expected, lambda a, b: F.coalesce(typed_difference(a, b, kind.elementType, string, number), F.lit(0.0)))
        places = F.greatest(F.size(output), F.size(expected))
        both = F.slice(pairs, 1, F.least(F.size(output), F.size(expected)))
        inner = F.when(places == 0, F.lit(1.0)).otherwise(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / places)
    elif isinstance(kind, T.MapType):
        each = F.map_values(F.map_zip_with(output, expected, lambda _, a, b: typed_difference(a, b, kind.valueType, string, number)))
        known = F.filter(each, lambda x: x.isNotNull())
        none = (F.size(output) == 0) & (F.size(expected) == 0)
        inner = F.when(none, F.lit(1.0)).otherwise(F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known)))
    elif isinstance(kind, T.NumericType | T.BooleanType):
        inner = number(output.cast("double"), expected.cast("double"))
    else:
        inner = string(output, expected)
    return F.when(output.isNull() & expected.isNull(), F.lit(1.0)).when(output.isNull() | expected.isNull(), F.lit(0.0)).otherwise(inner)


def is_native(kind: T.DataType) -> bool:
    """Whether ``typed_difference`` compares values of a type as their JSON text would be."""
    if isinstance(kind, T.StructType):
        return all(is_native(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):  # as JSON text, keys of other types could become equal or be written in several ways
        return isinstance(kind.keyType, T.StringType | T.IntegralType) and is_native(kind.valueType)
    return is_native(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.StringType | T.NumericType | T.BooleanType)


def holds_json(value: Column, kind: T.DataType) -> Column | None:
    """Whether a text inside a typed value may be an object or array itself; None where the type has no texts."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value.rlike(r"^\s*[\[{]"), F.lit(False))
    if isinstance(kind, T.ArrayType):
        inner = holds_json(F.lit(""), kind.elementType)
        return None if inner is None else F.coalesce(F.exists(value, lambda x: holds_json(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        inner = holds_json(F.lit(""), kind.valueType)
        return None if inner is None else F.coalesce(F.exists(F.map_values(value), lambda x: holds_json(x, kind.valueType)), F.lit(False))
    if isinstance(kind, T.StructType):
        found = [h for f in kind.fields if (h := holds_json(value[f.name], f.dataType)) is not None]
        return reduce(lambda a, b: a | b, found) if found else None
    return None


def as_json(value: Column, kind: T.DataType, nulls: bool = False) -> Column:
    """A value of any type as JSON text; texts are JSON text already. ``nulls``: also fields without a value."""
    if isinstance(kind, CONTAINERS):
        return F.to_json(value, {"ignoreNullFields": "false"} if nulls else None)
    return value.cast("string")


def any_difference(output: Column, expected: Column, kinds: tuple[T.DataType, T.DataType], string: Leaf = edit_similarity, number: Leaf = number_similarity, preserve: bool = False) -> Column:
    """The structural similarity of columns of any types, natively where that says the same."""
    kind = kinds[0]
    texts = lambda when: [F.when(when, as_json(c, k)) if when is not None else as_json(c, k) for c, k in zip((output, expected), kinds, strict=True)]
    usual = string is edit_similarity and number is number_similarity
    if not usual or kinds[0] != kinds[1] or isinstance(kind, T.StringType) or not is_native(kind):
        return json_difference(*texts(None), string, number, preserve)
    native, inside = typed_difference(output, expected, kind), None if preserve else holds_json(output, kind)
    if inside is None:
        return native
    inside = inside | holds_json(expected, kind)
    return F.when(inside, json_difference(*texts(inside), string, number, preserve)).otherwise(native)


def exact_json(output: Column, expected: Column) -> Column:
    """Exact match of JSON text, where at least one side is an object or array: both are read and written anew, in the
    order of their keys, and compared as text; text that can't be read stays as it is."""

    def norm(text: str | None) -> str:
        if text is None:
            return "null"
        try:
            return json.dumps(json.loads(text))
        except (ValueError, RecursionError):
            return text

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(norm(x) == norm(y)) for x, y in zip(a, b, strict=True)])

    return run(output, expected)


def exact(output: Column, expected: Column, kinds: tuple[T.DataType, T.DataType] = (T.StringType(), T.StringType())) -> Column:
    """Exact match of columns of any types: containers as JSON text, all else as text."""
    if not any(isinstance(k, CONTAINERS) for k in kinds):
        told = lambda c, k: F.when(c, "True").when(~c, "False") if isinstance(k, T.BooleanType) else c
        return exact_score(told(output, kinds[0]), told(expected, kinds[1]))
    sides = [as_json(c, k, nulls=True) for c, k in zip((output, expected), kinds, strict=True)]
    return exact_json(*sides)


def valid_json(output: Column, schema: str | dict | None = None, parsed: bool = False) -> Column:
    """1 where a text is a JSON object or array or, given a schema, fits it; else 0, also for scalars and for null.

    ``parsed``: the column holds JSON of already parsed values, so that a JSON string is a plain string to be read again.
    """
    rules = json.loads(schema) if isinstance(schema, str) else schema
    fits = compile_schema(rules) if rules is not None else None  # a malformed schema fails here rather than in tasks

    def judge(text: str | None) -> float:
        try:
            value = json.loads(text) if text is not None else None
            if parsed and isinstance(value, str):
                value = json.loads(value)
        except (ValueError, RecursionError):
            return 0.0
        return float(fits(value)) if fits is not None else float(isinstance(value, dict | list))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([judge(t) for t in texts])

    return run(output)


def valid_value(output: Column, kind: T.DataType, schema: str | dict | None = None, parsed: bool = False) -> Column:
    """``valid_json`` of a column of any type: by an expression where the types decide it, else of its JSON text."""
    if schema is not None and (found := native(output, kind, json.loads(schema) if isinstance(schema, str) else schema)) is not None:
        return found.cast("double")
    if schema is None and isinstance(kind, CONTAINERS):
        return output.isNotNull().cast("double")
    return valid_json(as_json(output, kind), schema, parsed)
