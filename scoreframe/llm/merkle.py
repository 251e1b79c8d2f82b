"""Merkle manifest of a dataset: a tree of digests for each source, one over their roots, and a proof for each row.

A leaf is the digest of a row's fields. Within a source leaves ascend by id; every ``arity`` consecutive nodes become their
digest, level by level, until one remains, the source's subroot. Subroots, by source (null first), give the root likewise.

1. One pass over the rows makes leaves; running sums number them within their source, which spreads a source with a third
   of all rows over range partitions. Texts go no further than this.
2. Every level equijoins its nodes with themselves at the indices of their siblings (XOR for pairs, slot offsets within a
   run otherwise). Rows in slot zero emit the parents. A node at index 0 without a sibling is its tree's top.
3. From the tops down, each node joins its parent's path and puts its own siblings before it. A subroot begins with its
   path below the root, so that rows never meet their source by name. A level has a third of the nodes of the one below:
   all joins together shuffle about one and a half times as many rows as there are leaves.

Digests are kept as bytes and hashed as lower-case hex text. Null fields count as ``-``; an empty text differs from null.
Rows without an id come last in their source. Rows that are equal in all fields have equal leaves but places, and so proofs,
of their own. An empty table has no tree and gives no rows. Columns other than the fields don't matter and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import materialize, running_sum, table

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:binary,right:binary>>"


def leaf_of(values: list[Column]) -> Column:
    """The digest of fields, each ``-`` if null, else its number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest(*parts: Column) -> Column:
    """The digest (bytes) of digests (bytes) as hex text, one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*parts))), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and the siblings on its path give."""
    hex_of = lambda c: F.lower(F.hex(c))
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(hex_of(s["left"]), h, hex_of(s["right"])), 256))


def proof_of(path: Column) -> Column:
    """The digest of all siblings on a path, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), ""), 256)


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """nodes (key, idx, h, more) with their run, and their siblings' digests to the left and to the right of them."""
    slot, empty = F.col("idx") % arity, F.unhex(F.lit(""))
    out = nodes
    for o in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + o) % arity
        others = nodes.select(F.col("key").alias("_key"), F.col("idx").alias("_idx"), F.col("h").alias(f"_h{o}"))
        out = out.withColumn("_at", at).join(others, (F.col("key") == F.col("_key")) & (F.col("_at") == F.col("_idx")), "left").drop("_at", "_key", "_idx")
    told = lambda left: F.concat(*[F.when((slot + o >= arity) == F.lit(left), F.coalesce(f"_h{o}", empty)).otherwise(empty) for o in range(1, arity)])
    return out.select(*nodes.columns, F.expr(f"idx div {arity}").alias("run"), told(True).alias("left"), told(False).alias("right"))


def _tops(level: DataFrame) -> DataFrame:
    return level.where("idx = 0 AND octet_length(right) = 0")


def climb(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All levels, from the given nodes (key, idx, h) up to the tops, with siblings; each is written once."""
    size = nodes.agg(F.max("idx")).first()[0]
    size = 0 if size is None else size + 1
    levels = []
    while size:
        level = materialize(with_siblings(nodes, arity), "merkle")
        levels.append(level)
        goes_on = level.where(f"idx % {arity} = 0 AND NOT (idx = 0 AND octet_length(right) = 0)")
        nodes = goes_on.select("key", F.col("run").alias("idx"), digest(F.col("h"), F.col("right")).alias("h"))
        size = -(-size // arity) if size > 1 else 0
    return levels


def descend(levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The lowest level with the path of each node up to the root, and its tree's top; ``above`` has (key, path) of the
    tops, null if they are the root."""
    found = None
    for level in reversed(levels):
        top = _tops(level).withColumn("top", F.col("h"))
        if above is None:
            top = top.withColumn("path", F.array().cast(PATH))
        else:
            top = top.join(above.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).drop("_key")
        here = top
        if found is not None:
            parents = found.select(F.col("key").alias("_key"), F.col("idx").alias("_idx"), F.col("top").alias("top"), F.col("path").alias("_path"))
            own = F.array(F.struct("left", "right")).cast(PATH)
            lower = level.where("NOT (idx = 0 AND octet_length(right) = 0)").join(parents, (F.col("key") == F.col("_key")) & (F.col("run") == F.col("_idx")))
            here = lower.withColumn("path", F.concat(own, "_path")).drop("_key", "_idx", "_path").unionByName(top)
        found = here
    return found


def manifest(leaves: DataFrame, key: str, order: list[str], arity: int = ARITY) -> tuple[DataFrame, str | None]:
    """(leaves with subroot (hex) and path; the root). leaves has ``leaf`` (hex); ``order`` orders them within a key and
    may tie only between rows that are equal. No rows have no root (null)."""
    named = F.when(F.col(f"`{key}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{key}`")))
    packed = leaves.select(F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row"), named.alias("key"), *[F.col(f"`{o}`").alias(f"by{i}") for i, o in enumerate(order)], F.lit(1).alias("one"))
    packed = materialize(packed, "leaves")  # range partitioning samples its input: texts are hashed once only
    numbered = running_sum(packed, "one", ["key"], [f"by{i}" for i in range(len(order))], "idx")
    nodes = materialize(numbered.select("row", "key", F.col("idx").cast("long").alias("idx"), F.unhex("row.leaf").alias("h")), "leaves")
    trees = climb(nodes, arity)
    if not trees:
        return leaves.withColumns({"subroot": F.lit(None).cast("string"), "path": F.array().cast(PATH)}), None
    subroots = _tops(trees[0]).select("key", "h")
    for level in trees[1:]:
        subroots = subroots.unionByName(_tops(level).select("key", "h"))
    ranked = running_sum(materialize(subroots.withColumn("one", F.lit(1)), "subroots"), "one", [], ["key"], "idx")
    crown = climb(ranked.select(F.lit("").alias("key"), F.col("idx").cast("long").alias("idx"), "h", F.col("key").alias("name")), arity)
    root = bytes(_tops(crown[-1]).select("h").first()[0]).hex()
    above = materialize(descend(crown, None).select(F.col("name").alias("key"), "path"), "crown")
    found = descend(trees, above)
    return found.select("row.*", F.lower(F.hex("top")).alias("subroot"), "path"), root


def op12_merkle_manifest(spark, sf_dir) -> DataFrame:
    """The manifest of all documents, and whether each row's leaf still proves the root after line ends go from some texts."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    altered = F.when(tampered, leaf_of([*fields[:-1], F.translate("text", "\n", "")]))
    leaves = docs.select("doc_id", "source", leaf_of(fields).alias("leaf"), altered.alias("altered"))
    found, root = manifest(leaves, "source", ["doc_id", "leaf"])
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_of(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same by recursion over levels. The parity of a CRC-32 comes from folding the bits of the id's digits.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda x: CASE WHEN x IS NULL THEN '-' ELSE concat(strlen(x), ':', x) END), lambda a, b: a || b) AS body,
    list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), replace(text, chr(10), '')], lambda x: CASE WHEN x IS NULL THEN '-' ELSE concat(strlen(x), ':', x) END), lambda a, b: a || b) AS altered,
    list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: CAST((ascii(c) >> CAST(i AS INTEGER)) & 1 AS BIGINT))))),
        lambda c, bit: xor(c >> 1, CASE WHEN (xor(c, bit) & 1) = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)) AS crc FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx FROM
    (SELECT doc_id, coalesce('=' || source, '') AS key, sha256(body) AS leaf, CASE WHEN (xor(crc, 4294967295) & 1) = 0 THEN sha256(altered) ELSE sha256(body) END AS start, source FROM d)),
up(l, key, idx, n, h) AS (SELECT 0, key, CAST(idx AS BIGINT), count(*) OVER (PARTITION BY key), leaf FROM leaves
    UNION ALL SELECT l + 1, key, idx // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY l, key, idx // 3),
subs AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS idx FROM up WHERE n = 1),
crown(l, idx, n, h) AS (SELECT 0, CAST(idx AS BIGINT), count(*) OVER (), h FROM subs
    UNION ALL SELECT l + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY l, idx // 3),
sides AS (SELECT a.l, a.key, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
    FROM up a JOIN up b ON a.l = b.l AND a.key = b.key AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.l, a.key, a.idx),
tall AS (SELECT key, max(l) AS depth FROM up GROUP BY key),
crowned AS (SELECT a.l, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
    FROM crown a JOIN crown b ON a.l = b.l AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.l, a.idx),
steps AS (SELECT l, key, idx, lft, rgt FROM sides
    UNION ALL SELECT depth + c.l, t.key, 0, c.lft, c.rgt FROM tall t JOIN subs s ON s.key = t.key JOIN crowned c ON c.idx = s.idx // CAST(pow(3, c.l) AS BIGINT)),
walk(l, key, place, idx, proof, h) AS (SELECT 0, key, CAST(idx AS BIGINT), CAST(idx AS BIGINT), '', start FROM leaves
    UNION ALL SELECT w.l + 1, w.key, w.place, w.idx // 3, w.proof || s.lft || s.rgt, sha256(s.lft || w.h || s.rgt) FROM walk w JOIN steps s ON s.l = w.l AND s.key = w.key AND s.idx = w.idx),
ends AS (SELECT key, place, max_by(proof, l) AS proof, max_by(h, l) AS h FROM walk GROUP BY key, place)
SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves f JOIN subs s ON s.key = f.key JOIN ends e ON e.key = f.key AND e.place = f.idx CROSS JOIN (SELECT h FROM crown WHERE n = 1) r"""
