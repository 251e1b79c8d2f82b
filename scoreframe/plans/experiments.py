"""Experiments: score only what hasn't been scored before, and compare two runs row by row.

A score belongs to what the scorer read and to the scorer's version, not to a row: a rerun over a changed table scores only
contents that are new, and rows of the same content are scored once. Comparison needs one pass: the bootstrap weighs each
pair by Poisson numbers that are made from its key, so a lost task makes them again just as they were.
"""

from __future__ import annotations

import math
import time
from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.names import unused
from scoreframe.functions.score import SCORE, as_json
from scoreframe.operators.scorers import Scorer
from scoreframe.sources.providers import append, stored

#: Weights that a pair has in four replicates come from one digest; larger weights than this are less likely than a digest's step.
_LARGEST, _EACH = 12, 4


def version_of(scorer: Scorer, version: str = "") -> str:
    """The scorer's name and options, and a version of one's own. Functions among the options have no lasting name, so they
    ask for a version."""
    options = {f.name: getattr(scorer, f.name) for f in fields(scorer)}
    nameless = [k for k, v in options.items() if callable(v)]
    if nameless and not version:
        raise ValueError(f"{scorer.name}: a version is needed, since {', '.join(nameless)} can't be told from an older one")
    shown = {k: v for k, v in options.items() if k not in nameless}
    return f"{type(scorer).__module__}.{type(scorer).__qualname__} {sorted(shown.items())} {version}"


def content_key(df: DataFrame, columns: list[str], version: str) -> Column:
    """A digest of the version and of the columns' types and values, nulls among them."""
    types = [df.schema[c].dataType.simpleString() for c in columns]
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\n", F.lit(version), F.lit(" ".join(types)), content), 256)


def score_changed(df: DataFrame, scorer: Scorer, table: str, version: str = "", reads: list[str] | None = None) -> DataFrame:
    """The scorer's column beside the rows, of which only contents are scored that the table of scores lacks.

    ``reads`` names the columns that the scorer reads, where it reads others than it needs and its two own. Scores are kept as the response
    table keeps answers, parted by key, so a run that is killed keeps those of its finished tasks. Null values are part of
    the content. An empty table is given back as it is, with the column.
    """
    [key, kept] = unused([*df.columns, scorer.name], "_key", "_kept")
    columns = reads or [c for c in dict.fromkeys([*scorer.needs(), scorer.output, scorer.expected]) if c in df.columns]
    keyed = df.withColumn(key, content_key(df, columns, version_of(scorer, version)))
    asked = keyed.select(F.col(key).alias("request_key"))
    lacking = keyed.dropDuplicates([key]).join(stored(asked, table), F.col(key) == F.col("request_key"), "left_anti")
    if not lacking.isEmpty():
        scored = scorer.transform(lacking)
        rows = scored.select(F.col(key).alias("request_key"), as_json(F.col(scorer.name)).alias("response"), F.lit(None).cast("string").alias("error"))
        append(rows.withColumn("at", F.lit(time.time_ns())), table)
    told = stored(asked, table).select(F.col("request_key").alias(kept), F.from_json("response", SCORE).alias(scorer.name))
    return keyed.drop(scorer.name).join(told, F.col(key) == F.col(kept), "left").drop(key, kept)


def paired(before: DataFrame, after: DataFrame, key: list[str], score: str = "score") -> DataFrame:
    """Key columns, before and after: two runs' scores of the same rows. Rows of one run alone have null on the other side."""
    one, two = (d.select(*key, F.col(score).alias(n)) for d, n in ((before, "before"), (after, "after")))
    return one.join(two, key, "full_outer")


def _weights(key: list[str], replicates: int) -> Column:
    """Poisson numbers of mean 1, one for each replicate, from digests of the key."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in key])
    steps, total, share = [], 0.0, math.exp(-1)
    for k in range(_LARGEST):
        total += share
        steps.append(int(total * 2**32))
        share /= k + 1

    def of_digest(block: Column) -> Column:
        digest = F.md5(F.concat_ws("\x1f", text, block.cast("string")))
        parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(_EACH)]
        return F.array(*[sum((p >= F.lit(s)).cast("int") for s in steps) for p in parts])

    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // _EACH)), of_digest)), 1, replicates)


def compare(pairs: DataFrame, key: list[str], by: list[str] | None = None, replicates: int = 100, level: float = 0.95) -> DataFrame:
    """How ``after`` differs from ``before``, by group: pairs, unpaired rows, wins, losses and ties of ``after``, the mean
    difference, its standard error (null for one pair), and a bootstrap interval of the mean at the given level.

    Each task weighs its pairs for all replicates and sums them, so that a group takes one row a task and replicate through
    the shuffle, however many pairs it has. Groups without pairs have nulls.
    """
    by = list(by or [])
    gap, paired_ = F.col("after") - F.col("before"), F.col("before").isNotNull() & F.col("after").isNotNull()
    difference, replicate, weight = unused(pairs.columns, "_difference", "_replicate", "_weight")
    # replicate 0 is the pairs themselves, each weighed once
    weights = F.when(paired_, F.concat(F.array(F.lit(1)), _weights(key, replicates))).otherwise(F.array(F.lit(1)))
    each = pairs.select(*by, gap.alias(difference), F.posexplode(weights).alias(replicate, weight))
    d, w = F.col(difference), F.col(weight)
    counted = lambda c: F.sum(c.cast("long"))
    sums = each.groupBy(*by, replicate).agg(
        F.count(d).alias("pairs"), counted(d.isNull()).alias("unpaired"), counted(d > 0).alias("wins"), counted(d < 0).alias("losses"), counted(d == 0).alias("ties"),
        (F.sum(w * d) / F.nullif(F.sum(F.when(d.isNotNull(), w)), F.lit(0))).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("error"),
    )
    whole, drawn = F.col(replicate) == 0, F.when(F.col(replicate) > 0, F.col("mean"))
    tail = (1 - level) / 2
    own = [F.max(F.when(whole, F.col(c))).alias(c) for c in ("pairs", "unpaired", "wins", "losses", "ties", "mean", "error")]
    own = [F.coalesce(c, F.lit(0)).alias(n) if n in ("wins", "losses", "ties") else c.alias(n) for c, n in zip(own, ("pairs", "unpaired", "wins", "losses", "ties", "mean", "error"), strict=True)]
    return sums.groupBy(*by).agg(*own, F.percentile(drawn, tail).alias("low"), F.percentile(drawn, 1 - tail).alias("high"))
