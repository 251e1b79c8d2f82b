"""The difference of free JSON as tables: for documents of any size.

Two texts of together at most ``IN_ROW`` characters are paired within their row: a helper lists the pairs of their values,
children before what holds them, native expressions score the pairs and take the means, and nothing moves between tasks but
the rows themselves. Longer ones are as many rows as they have values:

1. Each side becomes one row for each value: its path (names of keys, places in arrays), kind, and text or number.
2. Both sides are joined full outer on row and path. A pair of objects, or of arrays, is open: its score is the mean over its
   children, which are as many as its keys or its longer array's places. Any other pair has a score of its own, by native
   expressions: texts by edit distance, numbers by relative difference, one side missing 0, unlike kinds as JSON text.
3. The pairs' scores, without their values, come together by document, in the order of their paths from the last to the first,
   so that children stand before what holds them, and the means are taken as within a row.

Only parsing, pairing within a row, and writing the values of unlike pairs as text are left to helpers in Python.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.editing import similarity
from scoreframe.functions.jsons import opened, parsed_or_text
from scoreframe.functions.scalar import levenshtein_score, numeric_score

#: Most characters of two texts that are paired within their row: 10,000 rows, which a helper gets at once, then take a few
#: hundred MB even where each character or two is a value.
IN_ROW = 4096
_PAIR = "array<struct<depth:int,open:boolean,score:double,o:string,e:string,x:double,y:double>>"
_NODE = "array<struct<path:array<string>,kind:string,text:string,number:double>>"


def _dump(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True)


def _number(value: float) -> float:
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def _nodes(text: str | None, preserve: bool) -> list[dict]:
    """All values of a JSON text, from the root down. A step is ``.`` and a key, or ``#`` and a place."""
    out, waiting = [], [([], parsed_or_text(text))]
    while waiting:
        path, value = waiting.pop()
        value = value if preserve else opened(value)
        row = {"path": path, "kind": "null", "text": None, "number": None}
        if isinstance(value, dict):
            row["kind"] = "object"
            waiting += [([*path, "." + k], v) for k, v in value.items()]
        elif isinstance(value, list):
            row["kind"] = "array"
            waiting += [([*path, f"#{i}"], v) for i, v in enumerate(value)]
        elif isinstance(value, str):
            row |= {"kind": "text", "text": value}
        elif value is not None:
            row |= {"kind": "number", "text": _dump(value), "number": _number(value)}
        out.append(row)
    return out


def _writable(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode())
    except UnicodeEncodeError:  # half of a surrogate pair, as JSON may escape it
        return False


def _pairs(output: str | None, expected: str | None, preserve: bool) -> list[tuple]:
    """The pairs of values of two JSON texts as (depth, open, score, two texts, two numbers), children before what holds them; a
    pair that isn't open has a score where that is plain, else what is to be compared."""
    out, waiting = [], [(parsed_or_text(output), parsed_or_text(expected), 0, False)]
    while waiting:
        o, e, depth, told = waiting.pop()
        if told:
            out.append((depth, True, None, None, None, None, None))
            continue
        if not preserve:
            o, e = opened(o), opened(e)
        score = a = b = x = y = children = None
        if o is None or e is None:
            score = float(o is e)
        elif isinstance(o, dict) and isinstance(e, dict):
            children = [(o.get(k), e.get(k), depth + 1, False) for k in {**o, **e}]
        elif isinstance(o, list) and isinstance(e, list):
            children = [(c, d, depth + 1, False) for c, d in zip(o, e, strict=False)]
            children += [(None, True, depth + 1, False)] * abs(len(o) - len(e))  # nothing beside something, even beside null
        elif isinstance(o, str) and isinstance(e, str):
            a, b = o, e
        elif isinstance(o, int | float) and isinstance(e, int | float):
            x, y = _number(o), _number(e)
            score = 1.0 if o == e else None
        else:
            a, b = _dump(o), _dump(e)
        if children is not None:
            waiting += [(None, None, depth, True), *reversed(children)]
            continue
        if a is not None and not (_writable(a) and _writable(b)):
            score, a, b = similarity(a, b), None, None
        out.append((depth, False, score, a, b, x, y))
    return out


def _paired(output: Column, expected: Column, preserve: bool) -> Column:
    """The pairs of two columns of JSON text as an array in each row."""
    kinds = [pa.int32(), pa.bool_(), pa.float64(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["depth", "open", "score", "o", "e", "x", "y"]

    @F.arrow_udf(_PAIR)
    def run(o: pa.Array, e: pa.Array) -> pa.Array:
        ends, columns = [0], [[] for _ in names]
        for a, b in zip(o.to_pylist(), e.to_pylist(), strict=True):
            try:
                found = _pairs(a, b, preserve)
            except RecursionError:  # nested too deeply to be written
                found = [(0, False, None, a or "null", b or "null", None, None)]
            for column, values in zip(columns, zip(*found, strict=True), strict=True):
                column.extend(values)
            ends.append(ends[-1] + len(found))
        made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)

    return run(output, expected)


def _mean(pairs: Column) -> Column:
    """The mean of means over pairs with depth, open and score, children before what holds them. By depth it keeps the sum and
    the number of scores; an open pair takes those below it for its score, and any pair drops what was kept below it."""

    def add(kept: Column, p: Column) -> Column:
        at = 2 * p["depth"]
        value = F.when(p["open"], F.coalesce(F.get(kept, at + 2) / F.get(kept, at + 3), F.lit(1.0))).otherwise(p["score"])
        own = [F.coalesce(F.get(kept, at), F.lit(0.0)) + value, F.coalesce(F.get(kept, at + 1), F.lit(0.0)) + 1]
        above = F.slice(kept, F.lit(1), F.least(at, F.size(kept)))
        return F.concat(above, F.array_repeat(F.lit(0.0), at - F.size(above)), F.array(*own))

    return F.get(F.aggregate(pairs, F.array().cast("array<double>"), add), F.lit(0))


def _told(p: Column) -> Column:
    """A pair as ``_pairs`` lists it, with its score."""
    score = F.coalesce(p["score"], F.when(p["o"].isNotNull(), levenshtein_score(p["o"], p["e"])).otherwise(numeric_score(p["x"], p["y"])))
    return F.struct(p["depth"].alias("depth"), p["open"].alias("open"), score.alias("score"))


def _at(value: object, path: list[str], preserve: bool) -> object:
    for step in path:
        value = value if preserve else opened(value)
        value = value[step[1:]] if step[0] == "." else value[int(step[1:])]
    return value if preserve else opened(value)


def _flat(rows: DataFrame, side: str, preserve: bool) -> DataFrame:
    @F.pandas_udf(_NODE)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_nodes(t, preserve) for t in texts])

    each = rows.select("id", F.explode(run(F.col(side))).alias("n"))
    return each.select(F.col("id").alias(f"{side}_id"), *[F.col(f"n.{c}").alias(f"{side}_{c}") for c in ("path", "kind", "text", "number")])


def _written(output: Column, expected: Column, paths: Column, preserve: bool) -> Column:
    """Both values at each path as JSON text, null where a path is null."""

    @F.pandas_udf("array<struct<o:string,e:string>>")
    def run(outputs: pd.Series, expecteds: pd.Series, asked: pd.Series) -> pd.Series:
        made = []
        for o, e, found in zip(outputs, expecteds, asked, strict=True):
            a, b = parsed_or_text(o), parsed_or_text(e)
            made.append(None if found is None else [None if p is None else {"o": _dump(_at(a, list(p), preserve)), "e": _dump(_at(b, list(p), preserve))} for p in found])
        return pd.Series(made, dtype="object")

    return run(output, expected, paths)


def difference_table(df: DataFrame, key: list[str], output: str, expected: str, preserve_strings: bool = False, in_row: int = IN_ROW) -> DataFrame:
    """(key, score) for each distinct row of key, output and expected: the structural similarity of two JSON texts, as
    ``JSONDiff`` gives it. Rows that share a key but not the texts have a score each. Texts of together at most ``in_row``
    characters are paired within their row, longer ones joined as tables of values."""
    keys = [f"k{i}" for i in range(len(key))]
    named = df.select(*[F.col(c).alias(k) for c, k in zip(key, keys, strict=True)], F.col(output).alias("o"), F.col(expected).alias("e")).distinct()
    short = F.coalesce(F.length("o"), F.lit(0)) + F.coalesce(F.length("e"), F.lit(0)) <= in_row
    near = named.where(short).withColumn("score", _mean(F.transform(_paired(F.col("o"), F.col("e"), preserve_strings), _told)))
    far = _joined(named.where(~short).select(F.struct(*[F.col(k) for k in keys]).alias("key"), "o", "e"), preserve_strings)
    parts = [part.select(*[F.col(at + k).alias(c) for c, k in zip(key, keys, strict=True)], "score") for part, at in ((near, ""), (far, "key."))]
    return parts[0].union(parts[1])


def _joined(named: DataFrame, preserve_strings: bool) -> DataFrame:
    """(key, score) of distinct rows of key, o and e, joined as tables of values."""
    digest = F.unhex(F.sha2(F.to_json(F.struct("o", "e"), {"ignoreNullFields": "false"}), 256))
    marked = named.withColumn("id", F.substring(digest, 1, 16))
    rows = marked.select("id", "o", "e").distinct()  # equal texts are compared once
    o, e = _flat(rows, "o", preserve_strings), _flat(rows, "e", preserve_strings)
    both = o.join(e, (F.col("o_id") == F.col("e_id")) & (F.col("o_path") == F.col("e_path")), "full")
    pairs = both.select(F.coalesce("o_id", "e_id").alias("id"), F.coalesce("o_path", "e_path").alias("path"), *[c for c in both.columns if not c.endswith(("_id", "_path"))])
    like = F.col("o_kind") == F.col("e_kind")
    missing = lambda s: F.col(f"{s}_kind").isNull() | (F.col(f"{s}_kind") == "null")
    beyond = F.coalesce(F.try_element_at("path", F.lit(-1)).startswith("#"), F.lit(False)) & (F.col("o_kind").isNull() | F.col("e_kind").isNull())
    score: Column = (
        F.when(beyond, F.lit(0.0)).when(missing("o") & missing("e"), F.lit(1.0)).when(missing("o") | missing("e"), F.lit(0.0))
        .when(like & (F.col("o_kind") == "text"), levenshtein_score(F.col("o_text"), F.col("e_text")))
        .when(like & (F.col("o_text") == F.col("e_text")) & ~F.isnan("o_number"), F.lit(1.0))
        .when(like & (F.col("o_kind") == "number"), numeric_score(F.col("o_number"), F.col("e_number")))
    )
    kept = F.struct("path", score.alias("score"), F.coalesce(like & F.col("o_kind").isin("object", "array"), F.lit(False)).alias("open"), (~missing("o") & ~missing("e") & ~like).alias("unlike"))
    listed = pairs.groupBy("id").agg(F.sort_array(F.collect_list(kept), asc=False).alias("pairs")).withColumnRenamed("id", "i")

    met = rows.join(listed, F.col("id") == F.col("i")).withColumn("some", F.exists("pairs", lambda p: p["unlike"]))
    only = lambda c: F.when(F.col("some"), c)
    paths = F.transform("pairs", lambda p: F.when(p["unlike"], p["path"]))
    written = met.withColumn("texts", _written(only(F.col("o")), only(F.col("e")), only(paths), preserve_strings))
    texts = F.coalesce("texts", F.array().cast("array<struct<o:string,e:string>>"))
    told = lambda p, w: F.struct(F.size(p["path"]).alias("depth"), p["open"].alias("open"), F.when(p["unlike"], levenshtein_score(w["o"], w["e"])).otherwise(p["score"]).alias("score"))
    scored = written.select("i", _mean(F.zip_with("pairs", texts, told)).alias("score"))
    return marked.join(scored, F.col("id") == F.col("i")).select("key", "score")
