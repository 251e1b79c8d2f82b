"""Benchmark decontamination by winnowing: which words of a document stand in a passage that a test item has too.

Words are runs of letters and digits (A-Z lower-cased) and of anything beyond ASCII. A window is WINDOW consecutive words of
an item; an item with fewer words is one window. A document word inside any occurrence of a window is hit.

1. Of the GRAM-grams in every window, the one with the least hash is its fingerprint (the last of equal ones). Documents and
   items choose alike, so that whatever window they share, they share its fingerprint. Items shorter than WINDOW have
   windows of their own length; documents are winnowed once for each length there is, WINDOW of them at the most.
2. A bitmap of the items' fingerprints, of bounded size whatever their number, is tested inside the task that makes the
   documents' fingerprints: what it refuses no item has; what it lets through carries the words around it.
3. Fingerprints of documents and items are joined by hash.
4. Each hit is extended to the windows around it, which are joined with the items' windows word for word, so that hashes
   only choose candidates. Each item window is one row in both joins, however many items have it: nothing is paired.
5. Items are listed once for each distinct set of windows' item sets, not for each document.

Equal texts are found once. Null and empty texts, and texts without words, have no words and no hits. Items without words
match nothing; items without an id mark words but are neither counted nor listed; rows that share an item id are one item.
Documents' rows are judged one by one, so that null and repeated ids don't matter; empty tables give no rows or no hits.
Columns other than doc_id, item_id and text may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreframe.llm.common import ascii_lower, materialize, table
from scoreframe.llm.texthash import batches, mix64, run_hashes, tokens

WINDOW, GRAM = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CLASSES = np.array([int(b >= 128 or 48 <= b <= 57 or 97 <= b <= 122) for b in range(256)], np.uint8)
#: The bitmap has about 16 bits for each fingerprint, as a power of two between these, and PROBES of them are set for each.
LEAST_BITS, MOST_BITS, PROBES = 1 << 16, 1 << 27, 4
CANDIDATES = "array<struct<first:int,length:int,hash:long,around:string>>"


def winnow(doc: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the fingerprints of all windows of ``length`` words that lie within one text."""
    k = min(GRAM, length)
    grams, windows = len(hashes) - k + 1, len(hashes) - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(length)) | np.uint64(1)
    with np.errstate(over="ignore"):
        value = np.zeros(grams, np.uint64)
        for i in range(k):
            value += hashes[i : grams + i] * c[i]
        value = mix64(value)
    least, at = value[:windows].copy(), np.arange(windows)
    for s in range(1, length - k + 1):
        later = value[s : windows + s]
        better = later <= least
        least[better] = later[better]
        at[better] = np.flatnonzero(better) + s
    chosen = np.zeros(grams, bool)
    chosen[at[doc[:windows] == doc[length - 1 :]]] = True
    first = np.flatnonzero(chosen)
    return first, value[first]


def _probes(hashes: np.ndarray, bits: int):
    """PROBES bit numbers for each hash, one array after the other."""
    for i in range(PROBES):
        yield mix64(hashes + np.uint64(i)) & np.uint64(bits - 1)


def window_fingerprints(windows: DataFrame) -> DataFrame:
    """The distinct fingerprints (hash) of windows (text)."""

    def run(found):
        for batch in found:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            data, doc, start, end = tokens(texts, CLASSES)
            h, size = run_hashes(data, start, end), np.bincount(doc, minlength=len(texts))
            each = [winnow(doc[own], h[own], int(n))[1] for n in np.unique(size[size > 0]) for own in [size[doc] == n]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64))], ["hash"])

    return windows.select("window").mapInArrow(run, "hash long").distinct()


def bitmap(fingerprints: DataFrame) -> np.ndarray:
    """The fingerprints as a Bloom filter of at most MOST_BITS bits; tasks OR their bits, the driver gets 64 a row."""
    bits = LEAST_BITS
    n = fingerprints.count()
    while bits < min(MOST_BITS, 16 * n):
        bits *= 2

    def run(found):
        for batch in found:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([*_probes(h, bits), np.zeros(0, np.uint64)]))
            word, one = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(one.view(np.int64))], ["word", "bits"])

    words = fingerprints.select("hash").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out, found = np.zeros(bits // 64, np.int64), words.toPandas()
    out[found.word.to_numpy()] = found.bits.to_numpy()
    return out.view(np.uint64)


def _passing(hashes: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """The numbers of the hashes that a filter may have."""
    alive = np.arange(len(hashes))
    for i in range(PROBES):
        at = mix64(hashes[alive] + np.uint64(i)) & np.uint64(64 * len(filled) - 1)
        alive = alive[(filled[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return alive


def candidates(docs: DataFrame, lengths: list[int], filled: np.ndarray) -> DataFrame:
    """doc_id, n_words, key of the text (null without candidates), and the fingerprints that pass, with words around."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def of(texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
        data, doc, start, end = tokens([t.lower() for t in texts], CLASSES)
        h, size = run_hashes(data, start, end), np.bincount(doc, minlength=len(texts))
        begin = np.cumsum(size) - size
        raw, out = data.tobytes(), [[] for _ in texts]
        for length in lengths:
            first, value = winnow(doc, h, length)
            alive, k = _passing(value, shared.value), min(GRAM, length)
            for p, v in zip(first[alive].tolist(), value[alive].view(np.int64).tolist(), strict=True):
                d = int(doc[p])
                low, high = max(int(begin[d]), p + k - length), min(int(begin[d] + size[d]), p + length)
                around = b" ".join([raw[s:e] for s, e in zip(start[low:high].tolist(), end[low:high].tolist(), strict=True)])
                out[d].append({"first": low - int(begin[d]), "length": length, "hash": v, "around": around.decode()})
        return size, out

    kind = pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32()), ("hash", pa.int64()), ("around", pa.string())]))

    def run(found):
        for batch in found:
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for part in batches([len(t) + 200 for t in raw], 2_000_000):
                texts = raw[part]
                size, out = of(texts)
                keys = [hashlib.blake2b(t, digest_size=16).digest() if c else None for t, c in zip(texts, out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, kind)], ["doc_id", "n_words", "key", "found"])

    kept = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kept}, n_words long, key binary, found {CANDIDATES}")


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct (window, item, length) of items (item_id, text); the item is its id as text."""
    words = items.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    sized = words.withColumn("length", F.least(F.size("w"), F.lit(WINDOW)))
    each = sized.select("item", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("p"))
    return each.select(F.array_join(F.slice("w", F.col("p"), F.col("length")), " ").alias("window"), "item", "length").distinct()


def _set_key(member: str) -> Column:
    """A name for a set of distinct members (nulls left out): their number and two sums of hashes."""
    total = F.coalesce(F.sum(F.when(F.col(member).isNotNull(), F.xxhash64(F.lit(5), member).cast("decimal(38,0)"))), F.lit(0)).cast("string")
    folded = F.coalesce(F.bit_xor(F.when(F.col(member).isNotNull(), F.xxhash64(F.lit(9), member))), F.lit(0)).cast("string")
    return F.concat_ws(":", F.count(member).cast("string"), total, folded)


def _spans(found: DataFrame) -> DataFrame:
    """(key, spans): the union of the windows (key, start, length) of each text as [first, end) runs of words, in order."""
    by = Window.partitionBy("key").orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("key", "run").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("end"))
    return merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))


def find(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_words, spans of hit words (array of first and end), items_key; lists: items_key, items).

    Spans are empty and items_key is null where nothing is hit.
    """
    windows = materialize(item_windows(items), "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most WINDOW
    known = materialize(window_fingerprints(windows.select("window").distinct()), "fingerprints")
    seen = materialize(candidates(docs, lengths, bitmap(known)), "candidates")

    prints = seen.where("key IS NOT NULL").select("key", F.explode("found").alias("f")).select("key", "f.*").distinct()
    hits = prints.join(known.withColumnRenamed("hash", "h"), F.col("hash") == F.col("h"), "left_semi")
    w = F.split("around", " ")
    cut = F.transform(F.sequence(F.lit(1), F.size(w) - F.col("length") + 1), lambda p: F.array_join(F.slice(w, p, F.col("length")), " "))
    near = hits.select("key", "first", "length", F.posexplode(cut).alias("p", "window")).select("key", (F.col("first") + F.col("p")).alias("start"), "length", "window").distinct()
    sets = materialize(windows.groupBy("window").agg(_set_key("item").alias("item_set")), "sets")
    found = materialize(near.join(sets.withColumnRenamed("window", "w"), F.col("window") == F.col("w")).select("key", "start", "length", "item_set"), "hits")

    of_text = found.select("key", "item_set").distinct()
    keyed = of_text.groupBy("key").agg(_set_key("item_set").alias("items_key"))
    by_text = _spans(found).join(keyed.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "spans", "items_key")
    by_text = materialize(by_text, "texts")

    # the items of each distinct set of item sets, from one text and one window that stand for it
    shown = by_text.groupBy("items_key").agg(F.min("key").alias("k"))
    stands = of_text.join(shown, F.col("key") == F.col("k")).select("items_key", "item_set")
    example = sets.groupBy("item_set").agg(F.min("window").alias("w")).withColumnRenamed("item_set", "s")
    members = windows.join(example, F.col("window") == F.col("w")).where("item IS NOT NULL").select("s", "item")
    listed = stands.join(members, F.col("item_set") == F.col("s"), "left").groupBy("items_key").agg(F.array_sort(F.collect_set("item")).alias("items"))

    none = F.array().cast("array<struct<first:int,end:int>>")
    clean = seen.where("key IS NULL").select("doc_id", "n_words", none.alias("spans"), F.lit(None).cast("string").alias("items_key"))
    right = by_text.withColumnRenamed("key", "k")
    judged = seen.where("key IS NOT NULL").select("doc_id", "n_words", "key").join(right, F.col("key") == F.col("k"), "left")
    return clean.unionByName(judged.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), "items_key")), materialize(listed, "items")


def op11_decontaminate(spark, sf_dir) -> DataFrame:
    """The words of all documents that stand in passages of the benchmark, and the items that these are from."""
    found, lists = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    told = lists.select(F.col("items_key").alias("k"), F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("digest"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    joined = found.where("items_key IS NOT NULL").join(told, F.col("items_key") == F.col("k"))
    none = found.where("items_key IS NULL").select("doc_id", "n_words", "spans", F.lit(0).cast("long").alias("n"), F.sha2(F.lit(""), 256).alias("digest"))
    every = joined.select("doc_id", "n_words", "spans", "n", "digest").unionByName(none)
    return every.select("doc_id", "n_words", n_hit.alias("n_hit"), F.col("n").alias("n_items"), F.col("digest").alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: The same from all windows of all documents.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(w) >= n)),
h AS (SELECT dw.r, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON iw.g = dw.g AND iw.n = dw.n),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, coalesce(l.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN l ON l.r = d.r"""
