"""Score summaries that merge: kept by day, shard or run, and added up later over any of their columns.

A summary has a row for each group and bin of the score: count, mean, sum of squared deviations, smallest and largest. Rows
of one group and bin merge to one such row, so partial summaries, whole ones and all grouping sets over them come from the
same sums. Quantiles are told by bin, to within 1 / BINS; everything else is exact but for rounding.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions.names import unused

BINS = 256
MOMENTS = ("n", "mean", "spread", "least", "most")


def summary(scored: DataFrame, by: list[str], score: str = "score", items: str | None = None) -> DataFrame:
    """by, bin, and the moments of the scores in it; rows without a score (null or NaN) are counted in a null bin. With
    ``items``, a sketch of that column's distinct values besides."""
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    s, bin_ = unused(scored.columns, "_score", "_bin")
    inside = F.floor(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.col(s) * BINS))).cast("int")
    placed = scored.withColumn(s, value).withColumn(bin_, F.when(F.col(s).isNotNull(), inside))
    sketch = [F.hll_sketch_agg(items).alias("items")] if items else []
    return placed.groupBy(*by, F.col(bin_).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(s).alias("mean"), (F.var_pop(s) * F.count(s)).alias("spread"), F.min(s).alias("least"), F.max(s).alias("most"), *sketch
    )


def _merged(parts: DataFrame) -> list[Column]:
    """The moments of rows taken together."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    about = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    items = [F.hll_union_agg("items").alias("items")] if "items" in parts.columns else []
    return [n.alias("n"), mean.alias("mean"), (F.sum("spread") + F.greatest(about, F.lit(0.0))).alias("spread"), F.min("least").alias("least"), F.max("most").alias("most"), *items]


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of shards or of finer groups, unioned, as one summary by fewer columns or the same."""
    return parts.groupBy(*by, "bin").agg(*_merged(parts))


def told(parts: DataFrame, by: list[str], quantiles: dict[str, float] | None = None, sets: list[list[str]] | None = None) -> DataFrame:
    """Counts of scored and skipped rows, mean, population variance, extremes and quantiles (the lower edge of the bin that
    the value is in) by all grouping sets of ``by``, or those asked for; ``grouping`` tells subtotals from null keys.

    At most BINS + 1 rows a group leave the first aggregation, whatever it summed up; the window runs over those.
    """
    quantiles = {"median": 0.5} if quantiles is None else quantiles
    wanted = sets if sets is not None else [list(c) for k in range(len(by) + 1) for c in combinations(by, k)]
    grouped = parts.groupingSets([[F.col(c) for c in [*s, "bin"]] for s in wanted], *[F.col(c) for c in [*by, "bin"]])
    [so_far] = unused(parts.columns, "_so_far")
    rows = grouped.agg(F.grouping_id().alias("grouping"), *_merged(parts))
    rows = rows.withColumn("grouping", F.shiftright("grouping", 1))  # the bin is in every set
    scored = F.when(F.col("bin").isNotNull(), F.col("n"))
    group = Window.partitionBy("grouping", *by)
    rows = rows.withColumn(so_far, F.sum(scored).over(group.orderBy(F.col("bin").asc_nulls_first()))).withColumn(f"{so_far}_all", F.sum(scored).over(group))
    edges = [F.min(F.when(F.col("bin").isNotNull() & (F.col(so_far) >= F.ceil(F.lit(q) * F.col(f"{so_far}_all"))), F.col("bin") / BINS)).alias(name) for name, q in quantiles.items()]
    count = F.coalesce(F.sum(scored), F.lit(0))
    mean = F.sum(scored * F.col("mean")) / F.sum(scored)
    about = F.sum(scored * F.col("mean") * F.col("mean")) - F.sum(scored) * mean * mean
    variance = (F.sum("spread") + F.greatest(about, F.lit(0.0))) / F.sum(scored)
    distinct = [F.hll_sketch_estimate(F.hll_union_agg("items")).alias("distinct")] if "items" in parts.columns else []
    skipped = F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0))
    return rows.groupBy(*by, "grouping").agg(count.alias("scored"), skipped.alias("skipped"), mean.alias("mean"), variance.alias("variance"), F.min("least").alias("least"), F.max("most").alias("most"), *edges, *distinct)
