"""Providers answer requests: from stored responses, or over HTTP in bounded batches inside tasks.

Responses are kept in a table by request key and are written before anything joins them, so later plans and reruns send
only what isn't stored; a task that is retried while its batch is written sends its own requests again.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSES = "request_key string, response string, error string"
#: Fixed values of the retry rule: tries, first pause in seconds, growth.
TRIES, PAUSE, GROWTH = 100, 0.1, 1.5


def wants_responses_api(request: dict) -> bool:
    """Whether a request goes to the responses interface: by its model's name or its flag."""
    return bool(request.get("use_responses_api")) or str(request.get("model", "")).startswith("gpt-5")


def to_responses_request(request: dict) -> dict:
    """A chat request in the shape of the responses interface."""
    kept = {k: v for k, v in request.items() if k not in ("messages", "tools", "tool_choice", "max_tokens", "use_responses_api", "reasoning_effort", "reasoning_enabled", "reasoning_budget")}
    kept["input"] = request.get("messages", [])
    if request.get("tools"):
        kept["tools"] = [{"type": "function", **t["function"]} if "function" in t else t for t in request["tools"]]
    if request.get("tool_choice"):
        kept["tool_choice"] = "required" if isinstance(request["tool_choice"], dict) else request["tool_choice"]
    options = {"effort": request.get("reasoning_effort"), "enabled": request.get("reasoning_enabled"), "budget_tokens": request.get("reasoning_budget")}
    if any(v is not None for v in options.values()):
        kept["reasoning"] = {k: v for k, v in options.items() if v is not None}
    return kept


def from_responses_response(response: dict) -> dict:
    """A responses-interface answer in the shape of a chat completion."""
    calls, text = [], []
    for item in response.get("output") or []:
        kind, content = item.get("type"), item.get("content")
        if kind in ("function_call", "custom_tool_call"):
            given = item.get("arguments") if item.get("arguments") is not None else item.get("input")
            calls.append({"id": item.get("call_id"), "type": "function", "function": {"name": item.get("name"), "arguments": given}})
        elif kind in ("output_text", "text"):
            text.append(content or item.get("text") or "")
        elif kind == "message":
            text += [content] if isinstance(content, str) else [c.get("text", "") for c in content or []]
    message = {"role": "assistant", "content": "".join(text) or None} | ({"tool_calls": calls} if calls else {})
    ended = response.get("stop_reason") or ("tool_calls" if calls else "stop")
    made = response.get("created", response.get("created_at"))
    return {"id": response.get("id"), "object": "chat.completion", "created": made, "model": response.get("model"), "choices": [{"index": 0, "message": message, "finish_reason": ended}]}


@dataclass(frozen=True)
class HttpProvider:
    """An OpenAI-compatible endpoint. The key is read from an environment variable of the executors, never from the plan.

    ``azure``: api-key header and an api-version, with the deployment in the address.
    """

    address: str
    key_variable: str = "MODEL_API_KEY"
    parallel: int = 8
    timeout: float = 600.0
    azure_version: str | None = None

    def _send(self, path: str, body: dict) -> dict:
        key = os.environ.get(self.key_variable, "")
        headers = {"Content-Type": "application/json"} | ({"api-key": key} if self.azure_version else {"Authorization": f"Bearer {key}"})
        url = self.address.rstrip("/") + path + (f"?api-version={self.azure_version}" if self.azure_version else "")
        pause = PAUSE
        for attempt in range(TRIES):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=self.timeout) as got:
                    return json.load(got)
            except urllib.error.HTTPError as e:
                if e.code != 429 or attempt == TRIES - 1:
                    raise
                time.sleep(pause)
                pause *= GROWTH
        raise AssertionError

    def answer(self, request: str) -> str:
        """One request's response, both JSON text; chat requests may take the responses interface."""
        body = json.loads(request)
        if "moderate" in body:
            return json.dumps(self._send("/moderations", {"input": body["moderate"], "model": body["model"]}))
        if "embed" in body:
            return json.dumps(self._send("/embeddings", {"input": body["embed"], "model": body["model"]}))
        if wants_responses_api(body):
            return json.dumps(from_responses_response(self._send("/responses", to_responses_request(body))))
        return json.dumps(self._send("/chat/completions", {k: v for k, v in body.items() if k != "use_responses_api"}))


@dataclass(frozen=True)
class FunctionProvider:
    """Answers requests by a function of the request's JSON text; for local models and tests."""

    function: object
    parallel: int = 1

    def answer(self, request: str) -> str:
        return self.function(request)


def fetch(requests: DataFrame, provider, partitions: int | None = None) -> DataFrame:
    """(request_key, response, error) for requests (request_key, request): ``partitions`` (the session's shuffle partitions
    by default) times the provider's parallel calls run at once, whatever the number of rows. A request that fails has an
    error instead of a response, and the others go on."""

    def tried(request: str) -> tuple[str | None, str | None]:
        try:
            return provider.answer(request), None
        except Exception as e:  # whatever a provider raises is that request's own failure
            return None, f"{type(e).__name__}: {e}"

    def run(frames):
        with ThreadPoolExecutor(provider.parallel) as pool:
            for pdf in frames:
                found = list(pool.map(tried, pdf.request))
                yield pd.DataFrame({"request_key": pdf.request_key, "response": [r for r, _ in found], "error": [e for _, e in found]}, dtype=object)

    many = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.select("request_key", "request").repartition(many, "request_key").mapInPandas(run, RESPONSES)


def stored(requests: DataFrame, table: str) -> DataFrame:
    """(request_key, response) that a response table has of the asked keys. The table is a folder of batches, each parted by
    the first digit of the key: only the asked parts are read, and of a key that was answered more than once, the first
    answer counts."""
    spark: SparkSession = requests.sparkSession
    asked = requests.select("request_key").where("request_key IS NOT NULL").distinct()
    try:
        every = _batches(spark, table)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "request_key string, response string")
    parts = [r[0] for r in asked.select(_part().alias("part")).distinct().collect()]  # one for each hexadecimal digit at most
    known = every.where(F.col("part").isin(parts) & F.col("response").isNotNull()).join(asked, "request_key", "left_semi")
    return known.groupBy("request_key").agg(F.min_by("response", F.struct("at", "response")).alias("response"))


def _batches(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(f"{RESPONSES}, at long, batch string, part string").option("basePath", table).parquet(f"{table}/batch=*")


def _part():
    return F.concat(F.lit("p"), F.substring("request_key", 1, 1))


def append(rows: DataFrame, table: str) -> str:
    """Add a batch; each task's answers are there as soon as the task is done, so that a run that is killed keeps them."""
    new = f"{table}/batch={uuid.uuid4().hex}"
    parted = rows.withColumn("part", _part())
    parted.write.partitionBy("part").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(new)
    return new


def compact(spark: SparkSession, table: str, to: str) -> None:
    """Write a response table anew as one batch of another table: first answers only, one file for each part."""
    every = _batches(spark, table).where("response IS NOT NULL")
    first = every.groupBy("request_key").agg(F.min(F.struct("at", "response")).alias("first"))
    rows = first.select("request_key", "first.response", F.lit(None).cast("string").alias("error"), "first.at")
    append(rows.repartition(_part()), to)


def answer_all(requests: DataFrame, provider, table: str, partitions: int | None = None, on_error: str = "raise") -> DataFrame:
    """Answer the distinct requests that the response table lacks, append them, and give the asked keys' responses.

    Responses are kept also where other requests fail; failed ones are sent again by the next call. With ``on_error="raise"``
    a failure then fails this call, otherwise its rows have no response. A call that has nothing to send writes nothing. One
    that does adds a batch, so that reads before and after it name different paths: Spark takes two reads of one path for the
    same data, and would reuse the older one in a plan that holds both.
    """
    spark: SparkSession = requests.sparkSession
    asked = requests.select("request_key", "request").dropDuplicates(["request_key"])
    todo = asked.join(stored(asked, table), "request_key", "left_anti")
    if not todo.isEmpty():
        told = fetch(todo, provider, partitions).withColumn("at", F.lit(time.time_ns()))
        new = append(told, table)
        if on_error == "raise":
            failed = spark.read.schema(RESPONSES).parquet(new).where("error IS NOT NULL").agg(F.count("*"), F.min("error")).first()
            if failed[0]:
                raise RuntimeError(f"{failed[0]} requests failed, among them: {failed[1]}")
    return stored(asked, table)
