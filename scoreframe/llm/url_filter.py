"""URL filter: rules by host and path prefix, and logistic regression on hashed character n-grams for the rest.

The classifier is trained on a small labelled table of URLs, which is a parameter (``url_table`` has the default), and
scores host and path. Rules win over it; they are a list of at most ``MOST_RULES`` that is written into the plan. Null urls
and urls without ``://`` have empty host and path, fit no rule, score 0 and are allowed. Judging is row by row over whole
urls, so ties, repeated rows and empty tables need no care. Other columns pass through; those with the names of results
(host, path, rule, score, verdict) are replaced by these.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import ascii_lower, table
from scoreframe.llm.texthash import batches, mix64
from scoreframe.llm.url_table import labelled_urls

#: (host, path prefix, verdict); the rule's text is host followed by path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MOST_RULES = 1000
SIZES, BITS = (3, 4, 5), 16


def ngrams(urls: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram; each url stands between bytes 1 and 2 and no n-gram crosses urls."""
    framed = [b"\x01" + u + b"\x02" for u in urls]
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    sizes = np.array([len(u) for u in framed], np.int64)
    row = np.repeat(np.arange(len(urls)), sizes)
    rows, buckets = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[k : len(data) - n + 1 + k]
        inside = row[: len(code)] == row[n - 1 :]
        rows.append(row[: len(code)][inside])
        buckets.append((mix64(code[inside] + np.uint64(n) * np.uint64(1 << 48)) >> np.uint64(64 - bits)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _texts(host: pd.Series, path: pd.Series) -> list[bytes]:
    return [f"{h}\t{p}".encode("utf-8", "replace") for h, p in zip(host, path, strict=True)]


def _raw(urls: list[bytes], weights: np.ndarray) -> np.ndarray:
    row, bucket = ngrams(urls, int(weights.size - 1).bit_length())
    count = np.maximum(1, np.bincount(row, minlength=len(urls)))
    return np.bincount(row, weights[bucket], len(urls)) / np.sqrt(count)


def train(labelled: pd.DataFrame, bits: int = BITS, rounds: int = 1000, rate: float = 2.0, decay: float = 1e-4, prior: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights by full-batch gradient descent, and the bias, which is that of ``prior``: a url of which nothing is known is
    unwanted with that probability, whatever the share of such urls in the table. The table is small by contract."""
    urls, y = _texts(labelled.host, labelled.path), labelled.label.to_numpy(float)
    row, bucket = ngrams(urls, bits)
    value = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(urls))))[row]
    w, bias = np.zeros(1 << bits), float(np.log(prior / (1 - prior)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[bucket] * value, len(urls)) + bias)))
        w -= rate / 20 * (np.bincount(bucket, (p - y)[row] * value, 1 << bits) + len(y) * decay * w)
    return w.astype(np.float32), bias


def scores(urls: list[bytes], model: tuple[np.ndarray, float]) -> np.ndarray:
    """How likely each url (host, tab, path) is unwanted."""
    out = np.zeros(len(urls))
    for part in batches([len(u) for u in urls], 1_000_000):
        out[part] = 1 / (1 + np.exp(-(_raw(urls[part], model[0]) + model[1])))
    return out


@functools.lru_cache(1)
def default_model() -> tuple[np.ndarray, float]:
    """The model of the default table's rows outside the held-out part."""
    table = labelled_urls()
    return train(table[~table.held_out])


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash, A-Z lower-cased; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        text, verdict = F.when(fits, rule_host + prefix).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, url: str = "url", model: tuple[np.ndarray, float] | None = None, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, score (of the classifier) and verdict."""
    model = model or default_model()

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(scores(_texts(host, path), model))

    df = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    df = df.withColumn("score", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(score("host", "path")))
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return df.withColumn("rule", text).withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op5_url_filter(spark, sf_dir) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
