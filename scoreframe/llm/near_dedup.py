"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set holds the distinct ``WIDTH``-word shingles of its lower-cased text (a shorter text: its whole sequence of
words). Documents with 100 * |intersection| >= 75 * |union| are linked; components are the closure of the links.

1. One pass hashes every shingle once, deals it to one of BANDS * ROWS bins by its leading bits and keeps each bin's
   least; empty bins borrow from filled ones. ROWS bins make a band.
2. Equal word sequences are one class, of which only the smallest id goes on.
3. Classes that share a band meet in a bucket. The bucket's hub is the member that meets most others over all of its
   buckets; only pairs (hub, member) become candidates, so a bucket of m gives m - 1 pairs.
4. Candidates whose sizes allow it are confirmed on their full sets; confirmed links are closed into components.
5. A member that isn't linked with the hub may still be linked with another. Buckets whose other members lie in more than
   one component are compared whole, in blocks of bounded size inside tasks, by signature alone; only the pairs of
   different components whose signatures agree well enough leave the task, and are confirmed on their full sets.

A pair at similarity 0.75 shares no bucket with probability (1 - 0.75**ROWS)**BANDS, about 2e-7; in step 5, one at
0.75 stays below AGREE with a probability of about 1e-4 (3.8 standard deviations of BINS trials), one above it with less.

What is linked are texts. Texts without words (null, empty, blank) are linked with nothing and are their own components.
Rows that share an id are one document in ``link``, whose components hold all that any of its texts is linked with;
``keep_one`` decides text by text, so that a text of a repeated id that is like no other stays. Rows without an id have no
component and are kept. Equal rows get equal results. Other columns don't matter here and may have any names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import materialize, running_sum, table, unused
from scoreframe.llm.components import connected_components
from scoreframe.llm.texthash import SPACED, batches, mix64, run_hashes, tokens

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 80, 6
BINS = BANDS * ROWS
ATTEMPTS = 64
#: The rest of a bucket is compared in blocks of so many members, and its pairs go on if so many bins (of 8 bits) agree.
BLOCK, AGREE = 512, 0.675


def _constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 64-bit shingle), distinct, ordered by both."""
    data, doc, start, end = tokens([t.lower() for t in texts], SPACED)
    h, c = run_hashes(data, start, end), _constants(WIDTH + 1, 1)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - WIDTH + 1)
        value = sum((h[k : n + k] * c[k] for k in range(WIDTH)), np.zeros(n, np.uint64))
        inside = doc[:n] == doc[WIDTH - 1 :] if n else np.zeros(0, bool)
        docs, out = doc[:n][inside], mix64(value[inside])
        size = np.bincount(doc, minlength=len(texts))
        first = np.searchsorted(doc, np.arange(len(texts)))
        short = np.flatnonzero((size > 0) & (size < WIDTH))
        whole = size[short].astype(np.uint64) * c[WIDTH]
        for k in range(WIDTH - 1):
            has = size[short] > k
            whole[has] += h[first[short[has]] + k] * c[k]
    docs, out = np.concatenate([docs, short]), np.concatenate([out, mix64(whole)])
    order = np.lexsort((out, docs))
    docs, out = docs[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (out[1:] != out[:-1])
    return docs[new], out[new]


@functools.lru_cache(1)
def _attempts() -> np.ndarray:
    grid = np.arange(ATTEMPTS * BINS, dtype=np.uint64).reshape(ATTEMPTS, BINS)
    return (mix64(grid + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def signatures(docs: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """One row of BINS minima for each document that has shingles; zeros for those that have none."""
    bins = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    cell = docs * BINS + bins
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out, filled = np.zeros(count * BINS, np.uint64), np.zeros(count * BINS, bool)
    out[cell[first]], filled[cell[first]] = values[first], True
    out, filled = out.reshape(count, BINS), filled.reshape(count, BINS)
    some = filled.any(axis=1)
    row, column = np.nonzero(~filled & some[:, None])
    for step in _attempts():
        if not len(row):
            return out
        source = step[column]
        good = filled[row, source]
        out[row[good], column[good]] = out[row[good], source[good]]
        row, column = row[~good], column[~good]
    for d in np.unique(row):  # few shingles: of the filled bins take the one that a hash of both bins puts first
        have, want = np.flatnonzero(filled[d]), column[row == d]
        rank = mix64(want[:, None].astype(np.uint64) * np.uint64(1 << 20) + have[None, :].astype(np.uint64))
        out[d, want] = out[d, have[rank.argmin(axis=1)]]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each row; a key also depends on its band."""
    c = _constants(ROWS + 1, 2)
    with np.errstate(over="ignore"):
        value = (signature.reshape(-1, BANDS, ROWS) * c[:ROWS]).sum(axis=2, dtype=np.uint64)
        return mix64(value + np.arange(BANDS, dtype=np.uint64) * c[ROWS]).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the word sequence, bucket keys and 8-bit signature (all three null
    without words)."""

    def run(frames):
        for pdf in frames:
            raw = [b"" if t is None else t.encode("utf-8", "replace") for t in pdf.text]
            for part in batches([len(t) + 4000 for t in raw], 2_000_000):
                texts = raw[part]
                doc, values = shingles(texts)
                size = np.bincount(doc, minlength=len(texts))
                signature = signatures(doc, values, len(texts))
                keys, small = bands(signature), (mix64(signature) & np.uint64(255)).astype(np.uint8)
                pick = lambda rows: [r if n else None for r, n in zip(rows, size, strict=True)]  # noqa: E731, B023
                digest = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() if n else None for t, n in zip(texts, size, strict=True)]
                yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[part].array, "text_hash": pdf.text_hash.iloc[part].array, "n_shingles": size, "digest": digest, "keys": pick(keys), "small": pick([r.tobytes() for r in small])})

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>, small binary")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts has (id, text)."""
    one = texts.select(F.col("id").alias("ia"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("ib"), F.col("text").alias("tb"))
    joined = pairs.join(two, F.col("b") == F.col("ib")).join(one, F.col("a") == F.col("ia")).select("a", "b", "ta", "tb")

    def run(frames):
        for pdf in frames:
            good = []
            sizes = [len(x) + len(y) for x, y in zip(pdf.ta, pdf.tb, strict=True)]
            for part in batches(sizes, 3_000_000):
                place: dict[str, int] = {}
                at = [(place.setdefault(x, len(place)), place.setdefault(y, len(place))) for x, y in zip(pdf.ta.iloc[part], pdf.tb.iloc[part], strict=True)]
                doc, values = shingles([t.encode("utf-8", "replace") for t in place])
                sets = np.split(values, np.searchsorted(doc, np.arange(1, len(place))))
                for x, y in at:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    good.append(100 * both >= PERCENT * (len(sets[x]) + len(sets[y]) - both))
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    return joined.mapInPandas(run, "a long, b long")


def compare_rest(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components whose signatures agree, of members (key, band, id, n, component, small, keys) of buckets;
    with m, how many members the bucket has, if that is known.

    A bucket is cut into blocks of BLOCK by a hash of the id, and every pair of blocks is one group of at most about
    2 * BLOCK rows; a bucket of up to BLOCK members is sent once. A pair goes on from the first bucket that it shares only:
    there either one of the two was the hub, and the pair is tested, or both are here. Which bucket is the first is told by
    the bucket keys themselves, since bins of a signature can agree where those differ.
    """
    if "m" not in members.columns:
        members = members.join(members.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m")), F.col("key") == F.col("k")).drop("k")
    dealt = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "band", "id", "n", "component", "small", "keys")
    dealt = dealt.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "p", "q")

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, p, q = group
        ids, n, component = pdf.id.to_numpy(), pdf.n.to_numpy(), pdf.component.to_numpy()
        grid, band = np.frombuffer(b"".join(pdf.small), np.uint8).reshape(-1, BINS), pdf.band.iloc[0]
        keys = np.stack(pdf["keys"].to_list())
        left, right = np.flatnonzero(pdf.block.to_numpy() == p), np.flatnonzero(pdf.block.to_numpy() == q)
        a, b = [], []
        for i in left:
            fits = right[(component[right] != component[i]) & (4 * np.minimum(n[right], n[i]) >= 3 * np.maximum(n[right], n[i]))]
            fits = fits[ids[fits] > ids[i]] if p == q else fits
            fits = fits[np.count_nonzero(grid[fits] == grid[i], axis=1) >= AGREE * BINS]
            fits = fits[(keys[fits] == keys[i]).argmax(axis=1) == band]
            a.append(np.minimum(ids[fits], ids[i]))
            b.append(np.maximum(ids[fits], ids[i]))
        return pd.DataFrame({"a": np.concatenate([*a, ids[:0]]), "b": np.concatenate([*b, ids[:0]])})

    return dealt.groupBy("key", "p", "q").applyInPandas(run, "a long, b long").distinct()


def components_of_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(the sketch of docs (doc_id, text); the classes of equal word sequences: digest, rep and text_hash of the row that
    stands for the class, component (the smallest rep) and whether the class stands for its component; whether ids repeat;
    whether an id has texts of several classes)."""
    sketched = materialize(sketch(docs), "sketch")
    usable = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    per_id = usable.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("mixed"))
    repeated, mixed = per_id.agg(F.coalesce(F.max("n") > 1, F.lit(False)), F.coalesce(F.max("mixed"), F.lit(False))).first()
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = usable.groupBy("digest").agg(first, F.first("n_shingles").cast("int").alias("n"), F.first("keys").alias("keys"), F.first("small").alias("small"))
    classes = classes.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), F.col("first.doc_id").alias("id"), "n", "keys", "small")
    classes = materialize(classes, "classes")
    if mixed:  # an id may stand for several classes: these are numbered in the order of their ids
        numbers = running_sum(classes.select("digest", "rep", F.lit(1).alias("one")), "one", [], ["rep", "digest"], "id").select(F.col("digest").alias("d"), "id")
        classes = materialize(classes.drop("id").join(numbers, F.col("digest") == F.col("d")).drop("d"), "classes")
    rows = classes.select("id", "n", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "k")
    members = materialize(rows.join(shared, F.col("key") == F.col("k")).select("key", "band", "id", "n", "c"), "members")
    meets = members.groupBy("id").agg(F.sum("c").alias("meets")).withColumnRenamed("id", "m")
    named = classes.select("id", F.col("rep").alias("r"), F.col("text_hash").alias("h")).join(members.select("id").distinct(), "id", "left_semi")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(named, (F.col("doc_id") == F.col("r")) & (F.col("text_hash") == F.col("h"))).select("id", "text")
    texts = materialize(texts.dropDuplicates(["id"]) if repeated else texts, "texts")

    best = members.join(meets, F.col("id") == F.col("m")).groupBy("key").agg(F.max(F.struct("meets", (-F.col("id")).alias("minus"), "n")).alias("best"))
    hubs = materialize(best.select(F.col("key").alias("k"), (-F.col("best.minus")).alias("hub"), F.col("best.n").alias("hub_n")), "hubs")
    near = (F.col("id") != F.col("hub")) & (4 * F.least("n", "hub_n") >= 3 * F.greatest("n", "hub_n"))
    pairs = members.join(hubs, F.col("key") == F.col("k")).where(near).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = materialize(confirm(pairs, texts), "links")
    labels = connected_components(links)

    rest = members.join(labels.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("key", "band", "id", "n", F.coalesce("component", "id").alias("component"))
    rest = materialize(rest.join(hubs.select(F.col("k").alias("key"), F.col("hub").alias("id")), ["key", "id"], "left_anti"), "rest")
    split = rest.groupBy(F.col("key").alias("k")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low < high").select("k", "m")
    rest = rest.join(split, F.col("key") == F.col("k")).drop("k").join(classes.select(F.col("id").alias("i"), "small", "keys"), F.col("id") == F.col("i")).drop("i")
    more = materialize(confirm(compare_rest(rest), texts), "links")
    if not more.isEmpty():  # stars already, so that few steps are left
        labels = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = classes.select("digest", "rep", "text_hash", "id").join(labels.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    found = named.select("digest", "rep", "text_hash", F.coalesce("component", "id").alias("lead"), (F.coalesce("component", "id") == F.col("id")).alias("leads"))
    if mixed:
        leads = classes.select(F.col("id").alias("i"), F.col("rep").alias("component"))
        return sketched, found.join(leads, F.col("lead") == F.col("i")).drop("i", "lead"), repeated, mixed
    return sketched, found.withColumnRenamed("lead", "component"), repeated, mixed


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    sketched, classes, repeated, mixed = components_of_texts(docs)
    slim = sketched.select("doc_id", "n_shingles", "digest")
    usable = slim.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    found = usable.join(classes.select(F.col("digest").alias("d"), "component"), F.col("digest") == F.col("d")).select("doc_id", "n_shingles", "component")
    alone = slim.where("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    if repeated or mixed:  # all rows of an id get the least of its components, after these are joined where they share an id
        by_id = materialize(found.groupBy("doc_id", "component").agg(F.count("*").alias("n")), "ids")
        least = by_id.groupBy("doc_id").agg(F.min("component").alias("low"))
        edges = by_id.join(least.withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).select(F.col("component").alias("a"), F.col("low").alias("b"))
        merged = connected_components(edges).select(F.col("id").alias("c"), F.col("component").alias("whole"))
        final = least.join(merged, F.col("low") == F.col("c"), "left").select(F.col("doc_id").alias("i"), F.coalesce("whole", "low").alias("final"))
        every = found.unionByName(alone)
        numbered = every.where("doc_id IS NOT NULL").join(final, F.col("doc_id") == F.col("i"), "left").select("doc_id", "n_shingles", F.coalesce("final", "component").alias("component"))
        found, alone = numbered, every.where("doc_id IS NULL")
    out = found.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs but those whose text is linked with that of a row before them, by id; with all of docs' columns.

    Equal rows (id and text) stay or go together, rows without an id or without words stay.
    """
    sketched, classes, _, _ = components_of_texts(docs.select("doc_id", "text"))
    number, other = unused(docs.columns, "_gone", "_gone_text")
    usable = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL").select("doc_id", "text_hash", "digest")
    stands = classes.select(F.col("digest").alias("d"), F.col("rep"), F.col("text_hash").alias("h"), "leads")
    stays = F.col("leads") & (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("h"))
    gone = usable.join(stands, F.col("digest") == F.col("d")).where(~stays).select(F.col("doc_id").alias(number), F.col("text_hash").alias(other)).distinct()
    return docs.join(materialize(gone, "gone"), (F.col("doc_id") == F.col(number)) & (F.xxhash64("text") == F.col(other)), "left_anti")


def op9_near_dedup(spark, sf_dir) -> DataFrame:
    """The near-duplicate component of every document, and whether it is the one that stays."""
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same links, from all pairs that share a shingle.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
, r AS (WITH RECURSIVE r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b) SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id"""
