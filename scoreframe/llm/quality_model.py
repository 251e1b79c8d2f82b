"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text's features are its tokens (runs of word characters, runs of punctuation) and pairs of neighbouring tokens,
hashed to ``2**bits`` buckets; a token that repeats the one before it makes a pair of its own kind, whatever the token. A
bucket's value is log(1 + count), scaled so that a text's values have length 1; the score is the logistic of a sparse dot
product. Training takes at most ``MOST_TRAINING`` labelled documents outside the held-out fold. Their features are made in
tasks and dealt by hash to ``SHARDS`` shards, to more where a shard would hold over ``SHARD_VALUES`` values, however long
the texts are; each shard runs its own updates over its own rows and the shards' weights are averaged.

Null and empty texts have no features and score the logistic of the bias. Scoring is row by row over whole texts, so repeated
rows and empty tables need no care; equal texts get equal scores. Without any labelled rows all weights are 0 and every
score is 0.5. Other columns pass through, but one with the name of the score is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import materialize, table
from scoreframe.llm.labelled import held_out, training_rows
from scoreframe.llm.texthash import CLASSES, batches, mix64, run_hashes, tokens

BITS = 18
#: Bound of the training sample.
MOST_TRAINING = 16_000
SHARDS, SHARD_VALUES = 4, 8_000_000
#: A shard passes over its rows until it has made about this many updates, 2 to 20 times.
UPDATES = 8_000
ALPHA, BETA, L1, L2 = 1.0, 0.5, 2e-3, 1e-4
THRESHOLD = 0.3


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, bucket, value), distinct and in order of doc."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data, doc, start, end = tokens(raw, CLASSES)
    h = run_hashes(data, start, end)
    with np.errstate(over="ignore"):
        pairs = np.where(h[:-1] == h[1:], np.uint64(1 << 63), mix64(h[:-1] * np.uint64(3) + h[1:]))
    same = doc[:-1] == doc[1:]
    docs = np.concatenate([doc, doc[:-1][same]])
    buckets = np.concatenate([h, pairs[same]]) >> np.uint64(64 - bits)
    key, count = np.unique(docs.astype(np.uint64) << np.uint64(bits) | buckets, return_counts=True)
    doc, value = (key >> np.uint64(bits)).astype(np.int64), np.log1p(count)
    length = np.sqrt(np.bincount(doc, value * value, len(texts)))
    return doc, (key & np.uint64((1 << bits) - 1)).astype(np.int64), value / length[doc]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias after passes of per-coordinate FTRL-proximal updates, one document (buckets, values) at a time.

    The rarer label's updates weigh more, up to 4 times, so that both labels weigh the same together.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    heft = np.clip(0.5 / np.maximum(share, 1e-9), 0, 4)
    for _ in range(int(np.clip(UPDATES // max(1, len(rows)), 2, 20))):
        for (index, x), y in zip(rows, labels, strict=True):
            w = weight(z[index], n[index])
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            g = (1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30))) - y) * heft[int(y)]
            gx = g * x
            z[index] += gx - (np.sqrt(n[index] + gx * gx) - np.sqrt(n[index])) / ALPHA * w
            n[index] += gx * gx
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    return weight(z, n), -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)


def train(rows: DataFrame, bits: int = BITS, shards: int = SHARDS, most: int = SHARD_VALUES) -> tuple[np.ndarray, float]:
    """The average of the shards' models. The driver gets at most one row for each bucket, and the bias (bucket -1)."""

    def spread(frames):
        for pdf in frames:
            for part in batches([len(t) for t in pdf.text]):
                some = pdf.iloc[part]
                doc, bucket, value = features(list(some.text), bits)
                cuts = np.searchsorted(doc, np.arange(1, len(some)))
                yield pd.DataFrame({"doc_id": some.doc_id, "label": some.label, "buckets": np.split(bucket, cuts), "values": np.split(value, cuts)})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable")
        w, bias = ftrl(list(zip(pdf["buckets"], pdf["values"], strict=True)), pdf.label.to_numpy(float), bits)
        used = np.flatnonzero(w)
        return pd.DataFrame({"bucket": np.append(used, -1), "w": np.append(w[used], bias)})

    made = rows.mapInPandas(spread, "doc_id long, label int, buckets array<int>, values array<double>")
    made = materialize(made.withColumn("order", F.xxhash64(F.lit(5), "doc_id")), "features")
    held = made.agg(F.sum(F.size("buckets").cast("long"))).first()[0] or 0
    shards = max(shards, -(-held // most))
    models = made.withColumn("shard", F.pmod("order", F.lit(shards))).groupBy("shard").applyInPandas(fit, "bucket long, w double")
    found = models.groupBy("bucket").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()
    weights = np.zeros(1 << bits, np.float32)
    bias = found[found.bucket == -1]
    count = max(1, int(bias.n.sum()))
    rest = found[found.bucket >= 0]
    weights[rest.bucket.to_numpy(np.int64)] = rest.w.to_numpy() / count
    return weights, float(bias.w.sum()) / count


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """Add the column ``out``: how likely a text is of good quality."""
    weights, bias = model
    bits = int(weights.size - 1).bit_length()
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        whole, found = list(texts), np.zeros(len(texts))
        for part in batches([len(t) for t in whole]):
            doc, bucket, value = features(whole[part], bits)
            dot = np.bincount(doc, sent.value[bucket] * value, part.stop - part.start)
            found[part] = 1 / (1 + np.exp(-np.clip(dot + bias, -30, 30)))
        return pd.Series(found)

    return docs.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def op6_quality_model(spark, sf_dir) -> DataFrame:
    """A quality score for every document, learned from labels.quality outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(training_rows(docs, table(spark, sf_dir, "labels"), "quality", MOST_TRAINING))
    scored = score_quality(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
