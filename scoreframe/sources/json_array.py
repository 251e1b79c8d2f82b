"""Files that hold one JSON array of objects each, read by many tasks.

Spark's text source cuts a file into byte ranges and, with ``}`` as the end of a line, into pieces that end where an object
may end, on any file system that Spark reads. Whether it does depends on all that stands before: on quotes and on depth.

1. Each range is summed up alone: the parity of its quotes, and how far it changes the depth, both for a range that begins
   inside a text and for one that doesn't (what is inside is told by the parity of quotes before it).
2. A prefix scan over the ranges of a file gives each one its state.
3. Each range is read again, from its state, and gives the objects that lie in it. What lies before the first and after the
   last one are fragments; those between two ranges' objects are stitched, in the order of the ranges.

Between objects exactly one comma may stand, and nothing may stand around the array; anything else fails the job, as does a
row that doesn't fit the schema. A state is 17 bytes for each range; MOST_RANGES of them at the most are sent to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_RANGES = 10_000_000
_QUOTE, _ESCAPE = ord('"'), ord("\\")
#: How a byte changes the depth, and whether it is one of those that do, or a comma.
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_MARK = (_STEP != 0) | (np.arange(256) == ord(","))
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def quotes(data: np.ndarray) -> np.ndarray:
    """The places of quotes with an even number of backslashes right before them."""
    at = np.flatnonzero(data == _QUOTE)
    odd, alive, back = np.zeros(len(at), bool), np.arange(len(at)), 1
    while len(alive):
        alive = alive[(at[alive] >= back) & (data[np.maximum(at[alive] - back, 0)] == _ESCAPE)]
        odd[alive] ^= True
        back += 1
    return at[~odd]


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets and commas, parity of the quotes before each, number of quotes)."""
    q, at = quotes(data), np.flatnonzero(_MARK[data])
    return at, np.searchsorted(q, at) & 1, len(q)


def objects(data: np.ndarray, inside: int, depth: int) -> tuple[list[tuple[int, int]], int, int]:
    """([begin, end) of the objects that begin and end here at depth 1, the state after them)."""
    at, parity, n = marks(data)
    at = at[parity == inside]
    step = _STEP[data[at]]
    after = depth + np.cumsum(step.astype(np.int64))
    opens, closes = at[(after == 2) & (step == 1)], at[(after == 1) & (step == -1)] + 1
    if len(opens) and len(closes) and closes[0] <= opens[0]:  # it began before
        closes = closes[1:]
    return list(zip(opens.tolist(), closes.tolist(), strict=False)), (inside + n) & 1, int(after[-1]) if len(after) else depth


def _ranges(batches: Iterator[pa.RecordBatch]):
    """((file, range), bytes of its pieces, size of the file) in order; a range may come in several parts."""
    for batch in batches:
        file, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(file)], strict=True):
            if end > begin:
                yield (int(file[begin]), int(block[begin])), b"}".join(batch.column(2)[begin:end].to_pylist()) + b"}", batch.column(3)[begin].as_py()


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list[int]] = {}  # parity, depth if begun outside, depth if begun inside, bytes, size of the file
    for place, text, size in _ranges(batches):
        state = found.setdefault(place, [0, 0, 0, 0, size])
        data = np.frombuffer(text, np.uint8)
        at, parity, n = marks(data)
        step = _STEP[data[at]].astype(np.int64)
        even, odd = int(step[parity == 0].sum()), int(step[parity == 1].sum())
        if state[0]:
            even, odd = odd, even
        state[:] = [(state[0] + n) & 1, state[1] + even, state[2] + odd, state[3] + len(text), size]
    columns = list(zip(*[(*k, *v) for k, v in found.items()], strict=True)) or [[]] * 7
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["file", "block", "parity", "outside", "inside", "bytes", "size"])


def _checked(gap: bytes, want: bytes) -> None:
    if gap.translate(None, b" \t\r\n") != want:
        raise ValueError(f"not an array of JSON objects: {gap[:200]!r} stands between or around them")


def _cut(text: bytes, inside: int, depth: int) -> tuple[bytes, list[bytes], bytes, int, int]:
    """(what stands before the first object, the objects, what stands after the last, the state there)."""
    found, inside, depth = objects(np.frombuffer(text, np.uint8), inside, depth)
    if not found:
        return text, [], b"", inside, depth
    for (_, a), (b, _) in zip(found, found[1:], strict=False):
        _checked(text[a:b], b",")
    return text[: found[0][0]], [text[a:b] for a, b in found], text[found[-1][1] :], 0, 1


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``value``: each object of the arrays in the files of a path, as text."""
    lines = spark.read.option("lineSep", "}").text(path)
    named = {"file": F.xxhash64("_metadata.file_path"), "block": F.col("_metadata.file_block_start")}
    size = F.when(F.col("_metadata.file_path").rlike(COMPRESSED), F.lit(-1)).otherwise(F.col("_metadata.file_size"))
    pieces = lines.select(*[c.alias(k) for k, c in named.items()], F.col("value").cast("binary").alias("text"), size.cast("long").alias("size"))
    parts = pieces.mapInArrow(_sum_up, "file long, block long, parity long, outside long, inside long, bytes long, size long")
    earlier = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = parts.withColumn("in_text", (earlier("parity") % 2).cast("int"))
    begun = begun.withColumn("depth", earlier(F.when(F.col("in_text") == 1, F.col("inside")).otherwise(F.col("outside"))))
    known = begun.limit(MOST_RANGES + 1).toPandas()
    if len(known) > MOST_RANGES:
        raise ValueError("too many byte ranges: raise spark.sql.files.maxPartitionBytes")
    # pieces and their ends are one byte more than a file, whose last piece has no end, if it doesn't end with an object
    sizes = known.groupby("file").agg(bytes=("bytes", "sum"), size=("size", "first"))
    if ((sizes["size"] >= 0) & (sizes["bytes"] != sizes["size"] + 1)).any():
        raise ValueError("not an array of JSON objects: a file ends with an object")
    known = known.sort_values(["file", "block"])
    at = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("file", "block", "in_text", "depth")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, blocks, inside, depth = at.value

        def rows(kind: int, place: tuple, texts: list[bytes]) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([place[0]] * n, pa.int64()), pa.array([place[1]] * n, pa.int64()), pa.array(texts, pa.binary())], ["kind", "file", "block", "text"])

        now, state, head, rest = None, (0, 0), None, b""

        def ended() -> pa.RecordBatch:
            return rows(0, now, [rest]) if head is None else rows(2, now, [rest])

        for place, text, _ in _ranges(batches):
            if place != now:
                if now is not None:
                    yield ended()
                low, high = np.searchsorted(files, place[0], "left"), np.searchsorted(files, place[0], "right")
                i = low + int(np.searchsorted(blocks[low:high], place[1]))
                now, state, head, rest = place, (int(inside[i]), int(depth[i])), None, b""
            text = rest + text
            before, found, rest, *after = _cut(text, *state)
            if not found:
                rest = before
                continue
            if head is None:
                head = before
                yield rows(0, place, [before])
            else:
                _checked(before, b",")
            state = tuple(after)
            yield rows(1, place, found)
        if now is not None:
            yield ended()

    cut = pieces.mapInArrow(extract, "kind int, file long, block long, text binary")
    return cut.where("kind = 1").select(F.col("text").cast("string").alias("value")).unionByName(_stitched(cut.where("kind <> 1")))


def _stitched(fragments: DataFrame) -> DataFrame:
    """The objects in fragments (kind 0: before or without objects of the range, 2: after them), joined from one range's last
    object to the next one's first."""
    by = Window.partitionBy("file").orderBy("block", "kind")
    placed = fragments.withColumn("region", F.sum((F.col("kind") == 2).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.groupBy("file", "region").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"))
    last = F.max("region").over(Window.partitionBy("file"))
    whole = joined.select(F.array_join(F.transform("parts", lambda p: F.hex(p["text"])), "").alias("text"), (F.col("region") == 0).alias("first"), (F.col("region") == last).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, found, after, *_ = _cut(text, 0, 0 if first else 1)
                if last:  # the last piece's end was added
                    after, before = (after[:-1], before) if found else (after, before[:-1])
                if found:
                    _checked(before, b"[" if first else b",")
                    _checked(after, b"]" if last else b",")
                else:
                    _checked(before, b"[]" if first and last else b"[" if first else b"]" if last else b",")
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["text"])

    texts = whole.select(F.unhex("text").alias("text"), "first", "last").mapInArrow(run, "text binary")
    return texts.select(F.col("text").cast("string").alias("value"))


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of files that hold one JSON array each; a row that doesn't fit the schema fails the job."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return read_objects(spark, path).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_json_array(df: DataFrame, path: str, nulls: bool = False) -> None:
    """Rows as JSON arrays, one in each file, a file for each partition; ``nulls``: also fields without a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = "["
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append(begin + text)
                begin = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if begin == "[" else "]"], pa.string())], ["value"])

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not nulls).lower()}).alias("value"))
    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)
