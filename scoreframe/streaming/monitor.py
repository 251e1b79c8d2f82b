"""Monitoring of scores over streams in append mode: a row is told once, when no row that is still in time can change it.

Rows may come late (by ``late`` at most, later ones are dropped), twice or out of order: how rows are dealt to micro-batches
doesn't change what is told, and a run that is stopped goes on from its checkpoint. State is bounded by what is open: windows
and sessions until the watermark passes their end, keys until they have been silent for long. Null times belong to no window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.functions.names import unused
from scoreframe.streaming import timed


def session_scores(scored: DataFrame, score: str, by: tuple[str, ...], gap: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Mean score and counts of each session: rows of the same ``by`` that are less than ``gap`` apart. ``start`` is the first
    row's time, ``end`` the last one's plus the gap; rows without a score count among ``rows`` alone."""
    at, df = timed(scored, time, late)
    grouped = df.groupBy(F.session_window(at, gap), *by).agg(F.avg(score).alias("score"), F.count(score).alias("n"), F.count("*").alias("rows"))
    return grouped.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "score", "n", "rows")


def once(requests: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row that comes of each ``keys``; one that comes again within ``late`` of it is dropped, so that a request
    isn't sent twice. A key is forgotten after that, and its next row is told again; a row without a time is
    told, and nothing says for how long its key is known."""
    at, df = timed(requests, time, late)
    return df.dropDuplicatesWithinWatermark(keys).drop(at)


#: What is known of a key: scores in its windows and their sum, both running excesses, the last window's time in microseconds.
_KNOWN = "n long, total double, above double, below double, last long"


def drift(windows: DataFrame, by: str, slack: float = 0.01, silence: str = "7 days") -> DataFrame:
    """How far each key's mean score has drifted, from a stream of closed windows: ``by``, start, score and n, as
    ``windowed_scores`` tells them in append mode and ``settle`` keeps them (Spark allows no Python state after a streaming
    aggregation in the same query).

    A window's mean is compared with the mean of all scores in the key's earlier windows, its ``baseline`` (null for the
    first). ``above`` sums by how much more than ``slack`` it was higher, and starts anew at 0 wherever that sum would fall
    below; ``below`` likewise: both are cumulative sums, large after a shift that lasts. A key that has had no window for
    ``silence`` is told once more, with ``silent`` true and its last window's start, and is forgotten; windows without a
    score count as none. The state meets one row for each key and window, so a key with most rows isn't one task's burden.
    """
    at, micros = unused(windows.columns, "_at", "_micros")
    rows = windows.where((F.col("n") > 0) & F.col("start").isNotNull()).select(F.col(by), F.col("start").alias(at), F.unix_micros("start").alias(micros), "score", "n")
    key_field = T.StructField(by, windows.schema[by].dataType)
    plain = [T.StructField(micros, T.LongType()), T.StructField("silent", T.BooleanType()), T.StructField("n", T.LongType())]
    told = T.StructType([key_field, *plain, *[T.StructField(c, T.DoubleType()) for c in ("score", "baseline", "above", "below")]])
    patience = int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(key, frames, state):
        n, total, above, below, last = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], last, True, None, None, None, None, None)], columns=told.names)
            return
        out = []
        new = pd.concat(list(frames)).sort_values(micros)
        for when, mean, count in zip(new[micros].tolist(), new["score"].tolist(), new["n"].tolist(), strict=True):
            baseline = total / n if n else None
            if n:
                above, below = max(0.0, above + mean - baseline - slack), max(0.0, below + baseline - mean - slack)
            n, total, last = n + count, total + mean * count, when
            out.append((key[0], when, False, count, mean, baseline, above, below))
        state.update((n, total, above, below, last))
        state.setTimeoutTimestamp(max(last // 1000 + patience, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=told.names)

    states = rows.withWatermark(at, "0 seconds").groupBy(by).applyInPandasWithState(step, told, _KNOWN, "append", "EventTimeTimeout")
    return states.select(by, F.timestamp_micros(micros).alias("start"), "silent", "n", "score", "baseline", "above", "below")


def settle(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream in append mode until all that is there is read, and give what it has told so far. ``folder`` holds its
    state and rows; running it again over the same folder reads only what is new."""
    run = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
