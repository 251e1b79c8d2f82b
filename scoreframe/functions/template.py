"""Prompt templates: ``{{name}}``, dotted paths, ``{{#name}}`` and ``{{^name}}`` sections, without HTML escaping.

Templates of plain variables become native concatenations. Those with sections or paths into JSON are rendered by an
Arrow-batched helper from a JSON struct of the columns that they use.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.functions.thread import message_text, thread_text

_TAG = re.compile(r"\{\{\{\s*([^{}]+?)\s*\}\}\}|\{\{\s*([#^/&!]?)\s*([^{}]*?)\s*\}\}")


def tags(template: str) -> list[tuple[str, str]]:
    """(kind, name) of every tag; kind is empty for variables."""
    return [("", m[1]) if m[1] else ("" if m[2] == "&" else m[2], m[3]) for m in _TAG.finditer(template) if m[2] != "!"]


def names(template: str) -> list[str]:
    """The columns that a template uses, in order of first use."""
    return list(dict.fromkeys(name.split(".")[0] for kind, name in tags(template) if kind != "/" and name != "."))


#: Before the name of a column, that of its text.
TEXT_OF = "\0"


def is_plain(template: str) -> bool:
    return all(not kind and "." not in name for kind, name in tags(template))


def _shown(df: DataFrame, name: str) -> Column:
    """A column as text inside a prompt: threads and messages in their own form, other containers as JSON, null as nothing."""
    if name not in df.columns:
        return F.lit("")
    column, kind = F.col(name), df.schema[name].dataType
    fields = lambda t: set(t.fieldNames()) if isinstance(t, T.StructType) else set()
    if isinstance(kind, T.ArrayType) and {"role", "content"} <= fields(kind.elementType):
        text = thread_text(column)
    elif {"role", "content"} <= fields(kind):
        text = message_text(column)
    elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def render(df: DataFrame, template: str) -> Column:
    """The rendered template for every row of df; missing columns and null values are empty."""
    template = template.strip()
    if is_plain(template):
        parts, at = [], 0
        for m in _TAG.finditer(template):
            parts.append(F.lit(template[at : m.start()]))
            if m[1] or m[2] != "!":
                parts.append(_shown(df, m[1] or m[3]))
            at = m.end()
        return F.concat(*parts, F.lit(template[at:]))
    used = [n for n in names(template) if n in df.columns]
    # threads and messages come with their text, as they are shown where a template names them outside of sections
    texts = [_shown(df, n).alias(TEXT_OF + n) for n in used if isinstance(df.schema[n].dataType, T.ArrayType | T.StructType)]
    packed = F.to_json(F.struct(*[F.col(n) for n in used], *texts)) if used else F.lit("{}")

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([render_text(template, [json.loads(r)]) for r in rows], dtype=object)

    return run(packed)


def _find(name: str, stack: list) -> object:
    if name == ".":
        return stack[-1]
    first, *rest = name.split(".")
    value = next((s[first] for s in reversed(stack) if isinstance(s, dict) and first in s), None)
    for part in rest:
        if isinstance(value, list) and part.isdigit():
            value = value[int(part)] if int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def _as_text(value: object) -> str:
    if isinstance(value, dict) and {"role", "content"} <= set(value):
        return f"{value['role']}: {_as_text(value['content'])}"
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def render_text(template: str, stack: list) -> str:
    """One template over a stack of contexts, innermost last."""
    out, at = [], 0
    while m := _TAG.search(template, at):
        out.append(template[at : m.start()])
        kind, name, at = "" if m[1] else m[2], m[1] or m[3], m.end()
        if kind in ("", "&"):
            value = _find(name, stack)
            given = isinstance(stack[0], dict) and TEXT_OF + name in stack[0] and value is stack[0].get(name)
            out.append(stack[0][TEXT_OF + name] if given else _as_text(value))
        elif kind in ("#", "^"):
            depth, end = 1, at
            while depth:
                close = _TAG.search(template, end)
                if close is None:
                    raise ValueError(f"section {name} isn't closed")
                depth += (close[3] == name) * ((close[2] in ("#", "^")) - (close[2] == "/"))
                inner, end = template[at : close.start()], close.end()
            value, at = _find(name, stack), end
            if kind == "^":
                out.append(render_text(inner, stack) if not value else "")
            elif value:
                out += [render_text(inner, [*stack, v]) for v in (value if isinstance(value, list) else [value])]
    return "".join(out) + template[at:]
