"""Helpers that several operators share: the shared folder, word splitting and distributed running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset, which is
    for local sessions alone."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as tell it from all columns there are."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """How many words a text has, as a long."""
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def running_sums(df: DataFrame, sums: dict[str, str], keys: list[str], order: list[str], highest: dict[str, str] | None = None) -> DataFrame:
    """Add running sums (new column: summed column) and running maxima (``highest``) over the earlier rows, by ``order``, of
    the same ``keys``; sums of no rows are 0, maxima null.

    Rows are range-partitioned by keys and order, so that a key with a third of all rows is spread over many
    partitions; each partition adds up its own rows, and the totals of earlier partitions (one row for each key and
    partition) are added. ``order`` must be total for reruns to agree; nulls come last in it.
    """
    pid, p = unused(df.columns, "_pid", "_p")
    last = lambda names: [F.col(c).asc_nulls_last() for c in names]
    ranged = materialize(df.repartitionByRange(*last([*keys, *order])).withColumn(pid, F.spark_partition_id()), "ranged")
    before = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(pid, *keys).orderBy(*last(order)).rowsBetween(*before)
    across = Window.partitionBy(*keys).orderBy(pid).rowsBetween(*before)
    each = [(out, value, F.sum) for out, value in sums.items()] + [(out, value, F.max) for out, value in (highest or {}).items()]
    local = ranged.withColumns({out: f(value).over(within) for out, value, f in each})
    totals = ranged.groupBy(pid, *keys).agg(*[f(value).alias(f"_t_{out}") for out, value, f in each])
    right = totals.select(F.col(pid).alias(p), *[F.col(k).alias(f"_k_{k}") for k in keys], *[f(f"_t_{out}").over(across).alias(f"_b_{out}") for out, _, f in each])
    on = F.col(pid) == F.col(p)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    zero = F.lit(0)
    joined = local.join(right, on)
    whole = {out: F.coalesce(F.col(out), zero) + F.coalesce(F.col(f"_b_{out}"), zero) if f is F.sum else F.greatest(out, f"_b_{out}") for out, _, f in each}
    return joined.withColumns(whole).select(*df.columns, *whole)


def running_sum(df: DataFrame, value: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    """One running sum."""
    return running_sums(df, {out: value}, keys, order)
