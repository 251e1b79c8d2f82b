"""Training rows for the classifiers: labelled documents outside the held-out fold, bounded by a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """The held-out fold: documents whose CRC-32 of the id's text leaves no remainder by 5 (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, per_class: bool = False) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out fold, in hash order of their ids.

    With ``per_class`` each of the two labels gets half of the bound. Labels given twice count once (the larger), rows
    without a label or an id are left out. Where an id repeats, its text with the least hash counts (null as empty), so that
    there are ``most`` rows at the most. The chosen ids are as many, so they are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("_order", F.xxhash64(F.lit(11), "doc_id"))
    first = lambda df, n: df.orderBy("_order", "doc_id").limit(n).select("doc_id", "label")
    if per_class:
        chosen = first(known.where("label = 1"), most // 2).unionByName(first(known.where("label = 0"), most // 2))
    else:
        chosen = first(known, most)
    chosen = chosen.withColumnRenamed("doc_id", "_id")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")
