"""Mixing sources to target weights with a time-varying curriculum.

Every source has a target (words it gives to the mix) and a weight schedule over training time u in [0, 1], given as
knots joined by straight lines. The integral of the schedule up to u, scaled to the target, is the demand that the
source has met by u. A source's documents are laid end to end in hash order, epoch after epoch; a document's training
position in an epoch is the time at which cumulative demand reaches its offset there, found by inverting the integral.
Documents are then range-sorted by position, once for each epoch that takes them.

Words are counted per document (null text: 0). A null source is a source of its own, after all others. Sources without
words have target 0 and give nothing; documents without words take nothing and get no position. Rows are documents, also
where ids repeat or are null; ties are broken by a hash of the whole row, equal rows being interchangeable. An empty table
gives an empty mix. Sources may be as many as documents: what is computed for each source is spread like the documents.
Extra columns are dropped by the query and kept by ``take``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.llm.common import materialize, n_words, running_sum, running_sums, table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: One schedule for each place in the cycle of weights: fading out, fading in, constant. Knots are (time, weight).
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8)), ((0.0, 1.0), (1.0, 1.0)))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source_size, docs, place in the cycle of weights and target.

    The sources share ``share`` times all words by weight; a target stops at ``cap`` times its source's size and the
    excess is shared anew. In the order of limit/weight the sources that stop come first, so running sums over the
    sources tell which do; only totals over all sources reach the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    per = running_sum(per.withColumn("_one", F.lit(1)), "_one", [], ["source"], "_rank").withColumn("place", (F.col("_rank") % len(weights)).cast("int"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, F.col("place"))).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    per = running_sums(per.withColumn("_ratio", F.col("limit") / F.col("weight")), {"_limits": "limit", "_weights": "weight"}, [], ["_ratio", "source"])
    per = materialize(per, "sources")
    words, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    total = share * words
    per = per.withColumn("stops", F.col("limit") * (F.lit(weight) - F.col("_weights")) <= F.col("weight") * (F.lit(total) - F.col("_limits")))
    stopped = per.where("stops").agg(F.coalesce(F.sum("limit"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (total - stopped[0]) / (weight - stopped[1]) if weight > stopped[1] else 0.0
    target = F.when(F.col("stops"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.lit(level)))
    return per.withColumn("target", target).select("source", "source_size", "docs", "place", "target")


def when_met(share: Column, knots) -> Column:
    """The time at which the integral of a schedule has reached ``share`` of its whole: the inverse of the integral."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        pieces.append((t0, t1, w0, w1, area))
        area += (t1 - t0) * (w0 + w1) / 2
    due, out = share * area, F.lit(float(knots[-1][0]))
    for t0, t1, w0, w1, start in reversed(pieces):
        rest, slope = due - start, (w1 - w0) / (t1 - t0)
        inside = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)) - w0) / slope
        end = start + (t1 - t0) * (w0 + w1) / 2
        out = F.when(due <= end, F.greatest(F.lit(t0), F.least(F.lit(t1), t0 + inside))).otherwise(out)
    return out


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """doc_id, source, size, source_size, target, offset, taken, copies, position and positions of every document.

    ``taken`` is exact: the words of the document that lie below the source's rounded target, over all epochs, so only
    one document of a source is taken in part. ``copies`` rounds that to whole documents. ``positions`` holds the time of
    the document's middle in each epoch that takes words of it, ``position`` the first of them; null where nothing is taken.
    A column ``row_key``, if docs has one, tells rows apart that share an id, and is kept.
    """
    key = F.col("row_key") if "row_key" in docs.columns else F.lit(0)
    sized = docs.select("doc_id", "source", key.alias("row_key"), n_words(F.col("text")).alias("size"))
    sized = materialize(sized.withColumn("_order", F.xxhash64(F.lit(seed), F.col("doc_id"))), "sized")
    targets = source_targets(sized, weights, share, cap)
    laid = running_sum(sized, "size", ["source"], ["_order", "doc_id", "row_key", "size"], "offset")
    right = targets.withColumnRenamed("source", "_source")
    df = laid.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_order")
    due = F.round("target").cast("long")
    taken, places = F.lit(0).cast("long"), []
    for epoch in range(int(-(-cap // 1))):
        offset = F.col("offset") + epoch * F.col("source_size")
        part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), due - offset))
        taken = taken + part
        middle = F.try_divide(offset + F.col("size") / 2, F.col("target"))
        at = F.lit(None).cast("double")
        for place, knots in enumerate(schedules):
            at = F.when(F.col("place") == place, when_met(F.least(F.lit(1.0), middle), knots)).otherwise(at)
        places.append(F.when(part > 0, at))
    df = df.withColumn("positions", F.array_compact(F.array(*places)))
    df = df.withColumn("taken", taken).withColumn("copies", F.coalesce(F.round(F.try_divide("taken", "size")), F.lit(0)).cast("int"))
    df = df.withColumn("positions", F.when(F.col("taken") > 0, F.col("positions"))).withColumn("position", F.get("positions", F.lit(0)))
    return df.select("doc_id", "source", "row_key", "size", "source_size", "target", "offset", "taken", "copies", "position", "positions")


def sort_by_position(mixed: DataFrame) -> DataFrame:
    """The training order: range-sorted by position, ties by id."""
    return mixed.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each as often as its copies say, in training order, with docs' own columns.

    Rows meet their places by two hashes of all their columns (but maps), so neither null nor repeated ids gather in one
    place; of equal rows one goes on, which takes the places of all.
    """
    names = docs.columns
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not _holds_map(f.dataType)]
    key = F.struct(F.xxhash64(*hashed).alias("a"), F.xxhash64(F.lit(1), *hashed).alias("b"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("row_key"))
    mixed = mix(packed.select("row.doc_id", "row.source", "row.text", "row_key"), **options).where("copies > 0")
    places = mixed.select(F.col("row_key").alias("key"), "doc_id", F.explode(F.slice("positions", F.lit(1), F.col("copies"))).alias("position"))
    once = packed.groupBy("row_key").agg(F.first("row").alias("row"))
    taken = once.join(places, F.col("row_key") == F.col("key"))
    order = [F.col("position"), F.col("doc_id"), F.col("key")]
    return taken.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def _holds_map(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(_holds_map(k) for k in inner)


def op1_mixing(spark, sf_dir) -> DataFrame:
    """Every document with its source's target, the words that the mix takes of it and its places in training, one for each epoch."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return sort_by_position(mixed).select("doc_id", "size", "source_size", "target", "taken", "position", "positions")
