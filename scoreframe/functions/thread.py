"""Conversation threads as array columns, and the variables and text that judges' templates take from them.

A thread is an array of messages (role, content), ordered by turn. Typed messages have parts instead: text, reasoning, tool
calls and tool results, one row for each; ``typed_thread_text`` joins results to their calls by id.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions.scalar import stripped

#: Names that a template may use; a template that uses one needs the conversation.
VARIABLES = ("thread", "thread_count", "first_message", "last_message", "user_messages", "assistant_messages", "human_ai_pairs", "thread_with_system")
#: Longest tool text and reasoning that are shown whole.
MOST, THINKING = 500, 100


def uses_thread(template: str) -> bool:
    """Whether a template's tags begin with a thread variable's name."""
    return re.search(r"\{[{%]\s*(" + "|".join(VARIABLES) + ")", template) is not None


def collect_threads(messages: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row per conversation with its whole thread (``all_messages``)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))))
    slim = F.transform(F.col("all_messages"), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return messages.groupBy(key).agg(ordered.alias("all_messages")).withColumn("all_messages", slim)


def without_system(thread: Column) -> Column:
    return F.filter(thread, lambda m: m["role"] != "system")


def of_role(thread: Column, role: str) -> Column:
    return F.filter(thread, lambda m: m["role"] == role)


def human_ai_pairs(thread: Column) -> Column:
    """The i-th user message with the i-th assistant message, as far as there are both."""
    users, answers = of_role(thread, "user"), of_role(thread, "assistant")
    zipped = F.zip_with(users, answers, lambda u, a: F.struct(u.alias("human"), a.alias("assistant")))
    return F.filter(zipped, lambda p: p["human"].isNotNull() & p["assistant"].isNotNull())


def add_variables(threads: DataFrame, whole: str = "all_messages") -> DataFrame:
    """All thread variables as columns; ``thread_count`` and the rest don't count system messages."""
    df = threads.withColumn("thread_with_system", F.col(whole)).withColumn("thread", without_system(F.col(whole)))
    t = F.col("thread")
    return (
        df.withColumn("thread_count", F.size(t))
        .withColumn("first_message", F.try_element_at(t, F.lit(1)))
        .withColumn("last_message", F.try_element_at(t, F.lit(-1)))
        .withColumn("user_messages", of_role(t, "user"))
        .withColumn("assistant_messages", of_role(t, "assistant"))
        .withColumn("human_ai_pairs", human_ai_pairs(t))
    )


def capitalised(role: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(role, 1, 1)), role.substr(F.lit(2), F.length(role)))


def indented(text: Column) -> Column:
    return F.concat(F.lit("  "), F.replace(text, F.lit("\n"), F.lit("\n  ")))


def message_text(message: Column) -> Column:
    """One message on a line of its own: role, colon, content."""
    return F.concat_ws(": ", message["role"], message["content"])


def thread_text(thread: Column) -> Column:
    """The thread as text: role lines with indented contents, an empty line between; blank messages are left out."""
    shown = F.filter(thread, lambda m: stripped(F.coalesce(m["content"], F.lit(""))) != "")
    return F.array_join(F.transform(shown, lambda m: F.concat(capitalised(m["role"]), F.lit(":\n"), indented(m["content"]))), "\n\n")


def shortened(text: Column, most: int = MOST) -> Column:
    """Long texts without their middle: head and tail around a note of how much is left out (its wording is a fixed value)."""
    left_out = F.length(text) - most + 30
    note = F.concat(F.lit(" [..."), left_out.cast("string"), F.lit(" chars truncated...] "))
    room = F.lit(most) - F.length(note)
    head = (room / 2).cast("int")
    tail = (room - head).cast("int")
    cut = F.concat(text.substr(F.lit(1), head), note, text.substr(F.length(text) - tail + 1, tail))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def looks_failed(text: Column) -> Column:
    """Whether a tool's opened result reads like an error."""
    low = F.lower(text)
    return low.contains("error:") | low.contains('"error"') | F.startswith(low, F.lit("error"))


def _opened(value: object) -> str:
    """The text inside a tool's result: JSON texts are read, objects and lists give their texts, a quoted error its message."""
    if isinstance(value, str):
        try:
            return _opened(json.loads(value))
        except (ValueError, RecursionError):
            quoted = re.fullmatch(r"error:\s*'(.+)'\n?", value, re.DOTALL)
            return quoted[1] if quoted else value
    held = value if isinstance(value, list) else [value] if isinstance(value, dict) else []
    found = [x.get("text") if isinstance(x, dict) else x for x in held]
    texts = [_opened(t) for t in found if isinstance(t, str)]
    return "\n".join(texts) if texts else json.dumps(value)


def _arguments(text: str | None) -> str:
    """A call's arguments as text, from an object with a type and a value; nothing from anything else."""
    try:
        given = json.loads(text or "")
    except (ValueError, RecursionError):
        return ""
    if not isinstance(given, dict):
        return ""
    value = given.get("value")
    return value if isinstance(value, str) and given.get("type") != "valid" else json.dumps(value)


def _each(column: Column, function) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else function(t) for t in texts], dtype=object)

    return run(column)


def unwrapped(content: Column) -> Column:
    """The text inside tool results (JSON or plain text)."""
    return _each(content, _opened)


def call_arguments(arguments: Column) -> Column:
    """The arguments of tool calls (JSON of type and value) as text, empty where there are none."""
    return _each(arguments, _arguments)


def tool_results(parts: DataFrame, key: str = "conv_id") -> DataFrame:
    """Tool results as text (key, turn, place, content), each with the call that it answers.

    parts: key, turn, role, place, type, text, tool_call_id, tool_name, arguments and output, one row for each typed part.
    Calls stand in assistants' messages, results in tools'. Of calls with the same id the last counts, and only the first
    result shows it: results are joined to calls by id. A result goes by its own name, else by its call's.
    """
    by_id = Window.partitionBy(key, "tool_call_id")
    calls = parts.where("type = 'tool_call' AND role = 'assistant' AND tool_call_id <> ''")
    calls = calls.withColumn("_n", F.row_number().over(by_id.orderBy(F.desc("turn"), F.desc("place")))).where("_n = 1")
    calls = calls.select(F.col(key).alias("_k"), F.col("tool_call_id").alias("_id"), F.coalesce("tool_name", F.lit("unknown")).alias("called"), call_arguments(F.col("arguments")).alias("given"))
    results = parts.where("type = 'tool_result' AND role = 'tool'").withColumn("_n", F.row_number().over(by_id.orderBy("turn", "place")))
    results = results.select(key, "turn", "place", "tool_call_id", "tool_name", "_n", F.coalesce(unwrapped(F.col("output")), F.lit("null")).alias("result"))
    joined = results.join(calls, (F.col(key) == F.col("_k")) & (F.col("tool_call_id") == F.col("_id")) & (F.col("_n") == 1), "left")
    name = F.coalesce(F.when(F.col("tool_name") != "", F.col("tool_name")), F.when(F.col("called") != "", F.col("called")), F.when(F.col("called").isNull(), F.lit("tool")), F.lit(""))
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("Tool ("), name, F.lit("):")),
            F.when(F.col("given") != "", F.concat(F.lit("  Args:\n    "), shortened(F.col("given")))),
            F.concat(F.when(looks_failed(F.col("result")), F.lit("  Error:\n    ")).otherwise(F.lit("  Result:\n    ")), shortened(F.col("result"))),
        )
    )
    return joined.select(key, "turn", "place", F.array_join(lines, "\n").alias("content"))


def typed_messages(parts: DataFrame, key: str = "conv_id") -> DataFrame:
    """The texts of messages that aren't tools' (key, turn, role, content): texts as they are, reasoning shortened."""
    thinking = F.concat(F.lit("[thinking: "), F.substring("text", 1, THINKING), F.lit("...]"))
    plain = parts.where("role <> 'tool' AND type IN ('text', 'reasoning') AND text IS NOT NULL")
    plain = plain.select(key, "turn", "role", "place", F.when(F.col("type") == "text", F.col("text")).otherwise(thinking).alias("content"))
    pieces = F.array_sort(F.collect_list(F.struct("place", "content")))
    return plain.groupBy(key, "turn").agg(F.first("role").alias("role"), F.array_join(F.transform(pieces, lambda p: p["content"]), "\n").alias("content"))


def typed_thread_text(parts: DataFrame, key: str = "conv_id") -> DataFrame:
    """Typed threads as text (key, text): messages under their roles, tools' results on their own, an empty line between."""
    said = typed_messages(parts, key).where("content <> ''")
    said = said.select(key, "turn", F.lit(0).cast("long").alias("place"), F.concat(capitalised(F.col("role")), F.lit(":\n"), indented(F.col("content"))).alias("content"))
    every = said.unionByName(tool_results(parts, key).withColumn("place", F.col("place").cast("long")))
    pieces = F.array_sort(F.collect_list(F.struct("turn", "place", "content")))
    return every.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["content"]), "\n\n").alias("text"))
