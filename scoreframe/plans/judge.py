"""Model judges as a four-stage plan: render prompts, send each distinct request once, store responses, parse and score.

Rendering, request keys, parsing and scoring are native expressions; only the sending runs outside Spark's own operators.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.names import unused
from scoreframe.functions.scalar import choice_score, stripped
from scoreframe.functions.score import as_score
from scoreframe.functions.template import render
from scoreframe.functions.thread import VARIABLES, add_variables, uses_thread
from scoreframe.plans.config import EngineConfig, current

TOOL = "select_choice"
#: Fewest tokens that an answer may be limited to.
LEAST_TOKENS = 5
STEPS = "\nExplain your reasoning first, step by step, then call `select_choice` with one of these choices: {choices}."
PLAIN = "\nCall `select_choice` with one of these choices and nothing else: {choices}."
CALL = "choices array<struct<message: struct<tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>>"


@dataclass(frozen=True)
class JudgeSpec:
    """A judge: its prompt template, the score of each choice, and request options that are sent only where set."""

    name: str
    prompt: str
    choice_scores: dict[str, float]
    model: str | None = None
    engine: str | None = None
    use_cot: bool = True
    temperature: float | None = None
    max_tokens: int | None = None
    reasoning_effort: str | None = None
    reasoning_enabled: bool | None = None
    reasoning_budget: int | None = None
    use_responses_api: bool | None = None
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, name: str, spec: dict, **options) -> JudgeSpec:
        """A judge from a mapping as it stands in a spec file; unknown keys fail."""
        known = {f.name for f in fields(cls)}
        if unknown := set(spec) - known:
            raise ValueError(f"unknown keys in the spec of {name}: {sorted(unknown)}")
        return cls(name=name, **{**spec, **options})

    @classmethod
    def from_file(cls, name: str, path: str | Path, **options) -> JudgeSpec:
        """A judge from a YAML file."""
        import yaml

        spec = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        spec["choice_scores"] = {str(k): float(v) for k, v in spec["choice_scores"].items()}
        return cls.from_dict(name, spec, **options)

    @property
    def template(self) -> str:
        return self.prompt.strip() + (STEPS if self.use_cot else PLAIN).format(choices=", ".join(self.choice_scores))


def choice_tools(choices: list[str], use_cot: bool) -> list[dict]:
    """The tool that a judge must call: a choice, after its reasons where these are asked for."""
    reasons = {"reasons": {"type": "string", "description": "The reasoning, step by step, before the choice."}} if use_cot else {}
    shape = {"type": "object", "properties": {**reasons, "choice": {"type": "string", "enum": list(choices)}}, "required": [*reasons, "choice"]}
    return [{"type": "function", "function": {"name": TOOL, "description": "Select a choice.", "parameters": shape}}]


def request_column(prompt: Column, model: str, tools: list[dict], tool: str, options: dict | None = None) -> Column:
    """A chat request as JSON text, with the tool forced and only the options that are set."""
    rest = {"tools": tools, "tool_choice": {"type": "function", "function": {"name": tool}}} | {k: v for k, v in (options or {}).items() if v is not None}
    head = F.to_json(F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")))
    return F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(", " + json.dumps(rest)[1:]))


def request_key(request: Column) -> Column:
    return F.sha2(request, 256)


def with_requests(df: DataFrame, spec: JudgeSpec, config: EngineConfig | None = None, threads: DataFrame | None = None, thread_key: str = "conv_id") -> DataFrame:
    """Add prompt, request and request_key. The conversation is joined only where the template uses it; df's own columns of
    those names win over the conversation's."""
    config = config or current()
    used = df
    for name, value in spec.extra.items():
        used = used if name in used.columns else used.withColumn(name, F.lit(value))
    if threads is not None and uses_thread(spec.template):
        [other] = unused([*used.columns, *VARIABLES], "_thread")
        have = add_variables(threads).select(F.col(thread_key).alias(other), *[v for v in VARIABLES if v not in df.columns])
        used = used.join(have, F.col(thread_key) == F.col(other), "left")
    options = {k: getattr(spec, k) for k in ("engine", "temperature", "reasoning_effort", "reasoning_enabled", "reasoning_budget", "use_responses_api")}
    options["max_tokens"] = None if spec.max_tokens is None else max(LEAST_TOKENS, spec.max_tokens)
    tools = choice_tools(list(spec.choice_scores), spec.use_cot)
    prompted = used.withColumn("prompt", render(used, spec.template))
    prompted = prompted.withColumn("request", request_column(F.col("prompt"), spec.model or config.completion_model, tools, TOOL, options))
    return prompted.withColumn("request_key", request_key(F.col("request"))).select(*df.columns, "prompt", "request", "request_key")


def arguments_of(response: Column, tool: str | None = None) -> Column:
    """The JSON arguments of a response's first tool call, null where there is none or it calls another tool."""
    call = F.try_element_at(F.from_json(response, CALL)["choices"], F.lit(1))["message"]["tool_calls"]
    first = F.try_element_at(call, F.lit(1))["function"]
    return first["arguments"] if tool is None else F.when(first["name"] == tool, first["arguments"])


def problem_of(response: Column, tool: str) -> Column:
    """What is wrong with a response, null where nothing is or there is none."""
    choices = F.from_json(response, CALL)["choices"]
    name = F.try_element_at(F.try_element_at(choices, F.lit(1))["message"]["tool_calls"], F.lit(1))["function"]["name"]
    empty = F.coalesce(F.size(choices), F.lit(0)) < 1
    told = F.when(empty, F.lit("empty response")).when(name.isNull(), F.lit("no tool call in the response"))
    return F.when(response.isNotNull(), told.when(name != tool, F.concat(F.lit("another tool called: "), name)))


def judged(df: DataFrame, responses: DataFrame, spec: JudgeSpec, on_error: str = "null") -> DataFrame:
    """Add the judge's score column, by its name, to rows with request_key; rows without a response are skipped.

    A response without a call of the judge's tool, or without a choice in it, fails the job with ``on_error="raise"``;
    otherwise its row is skipped and the metadata say why.
    """
    key, response = unused(df.columns, "_key", "_response")
    right = responses.select(F.col("request_key").alias(key), F.col("response").alias(response))
    joined = df.join(right, F.col("request_key") == F.col(key), "left")
    given = arguments_of(F.col(response), TOOL)
    told = F.from_json(given, "choice string, reasons string")
    listed = F.from_json(given, "reasons array<string>")["reasons"]
    reasons = F.coalesce(F.array_join(listed, "\n"), told["reasons"])
    choice = stripped(told["choice"])
    problem = F.coalesce(problem_of(F.col(response), TOOL), F.when(F.col(response).isNotNull() & choice.isNull(), F.lit("no choice in the call")))
    score = choice_score(choice, spec.choice_scores, on_error)
    if on_error == "raise":
        score = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit(f"{spec.name}: "), problem)).cast("double")).otherwise(score)
    return joined.withColumn(spec.name, as_score(spec.name, score, {"choice": choice, "rationale": reasons, "error": problem}, on_error)).drop(key, response)
