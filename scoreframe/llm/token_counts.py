"""Token counts by separator scan: the lengths of documents in flat token files that have no index.

A flat token file is a run of fixed-width token ids in which every document ends with one identifier. Files are read in
blocks, each by a task that seeks to it, so a file may be of any size; each block is searched for the identifier with vector
operations, and a prefix scan over the blocks, spread by range also within a file, tells how many documents ended before a
block and where the last one did, which stitches documents that cross blocks.

Blocks without an identifier, and documents over many blocks, need no care of their own. Tokens after a file's last
identifier are a document that isn't complete and are reported as such; an empty document counts its identifier alone. An
empty table has no documents. Writing: null and empty texts are empty documents; rows are kept one by one, whatever
their ids; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import materialize, running_sums, shared_dir, table
from scoreframe.llm.texthash import batches
from scoreframe.llm.tokenize import tokenizer_path, word_tokenizer

#: The identifier at a document's end, tokens in a block, and bytes of the files that one task scans.
END, BLOCK, TASK_BYTES = 49407, 1 << 18, 32 << 20
FOUND = "file string, block_no long, start long, n long, ends array<int>"


#: How the names that Hadoop has for a store are written for pyarrow.
SCHEMES = {r"^file:/+": "/", r"^s3[an]://": "s3://", r"^dbfs:/+": "/dbfs/", r"^wasb(s?)://": r"abfs\1://"}


def _opened(path: str):
    """(file system, path in it) of a path or address, as Hadoop writes it."""
    from pyarrow import fs

    address = path
    for name, other in SCHEMES.items():
        address = re.sub(name, other, address)
    try:
        return fs.FileSystem.from_uri(address)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"flat files need a folder that pyarrow can open, not {path}: {e}") from None


def write_flat_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Write docs (doc_id, text) as flat files of 16-bit ids, one for each partition, and give file (its name), doc_no and doc_id.

    A file's name is new for each attempt of its task, so a lost task leaves at most a file that no row names.
    """
    path = path or tokenizer_path()
    _opened(folder)  # fails here rather than in tasks

    def run(frames):
        encoder, mark = word_tokenizer(path, special=False), np.array([end], "<u2")
        name, number = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{name}") as out:
            for pdf in frames:
                for part in batches([len(t or "") for t in pdf.text]):
                    ids, ends = encoder.encode_flat(list(pdf.text.iloc[part]))
                    out.write(np.insert(ids, ends, mark[0]).tobytes())
                    count = len(ends)
                    yield pd.DataFrame({"file": name, "doc_no": np.arange(number, number + count), "doc_id": pdf.doc_id.iloc[part].array})
                    number += count

    return materialize(docs.select("doc_id", "text").mapInPandas(run, "file string, doc_no long, doc_id long"), "names")


def scan_files(spark: SparkSession, path: str, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """The identifiers' places in every block of the flat files under a path: file, block_no, start, n and ends."""
    step, kind = width * block, f"<u{width}"
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    size = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    blocks = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block_no"))

    def run(frames):
        for pdf in frames:
            for file, some in pdf.sort_values(["file", "block_no"]).groupby("file", sort=False):
                system, at = _opened(file)
                with system.open_input_file(at) as source:
                    for number, length in zip(some.block_no, some.length, strict=True):
                        source.seek(number * step)
                        data = source.read(min(step, length - number * step))
                        ids = np.frombuffer(data[: len(data) // width * width], kind)
                        yield pd.DataFrame({"file": [file], "block_no": [number], "start": [number * block], "n": [len(ids)], "ends": [np.flatnonzero(ids == end).astype(np.int32)]})

    return blocks.repartition(tasks, "file", "block_no").mapInPandas(run, FOUND)


def stitch(found: DataFrame) -> DataFrame:
    """file, doc_no, start, n_tokens (with the identifier) and complete of every document, from the blocks' identifiers."""
    found = materialize(found, "found")
    # just behind the last identifier of a block, counted from the file's start; null where it has none
    slim = found.select("file", "block_no", "start", "n", F.size("ends").alias("here"), (F.col("start") + F.try_element_at("ends", F.lit(-1)) + 1).alias("behind"))
    before = running_sums(slim, {"earlier": "here"}, ["file"], ["block_no"], {"open": "behind"})
    before = before.select(F.col("file").alias("f"), F.col("block_no").alias("b"), "earlier", F.coalesce("open", F.lit(0)).alias("open"))
    joined = found.where(F.size("ends") > 0).join(before, (F.col("file") == F.col("f")) & (F.col("block_no") == F.col("b")))
    per = joined.select("file", F.col("start").alias("offset"), "open", "earlier", "ends", F.posexplode("ends").alias("place", "at"))
    start = F.when(F.col("place") == 0, F.col("open")).otherwise(F.col("offset") + F.get("ends", F.col("place") - 1) + 1)
    whole = per.select("file", (F.col("earlier") + F.col("place")).alias("doc_no"), start.alias("start"), (F.col("offset") + F.col("at") + 1 - start).alias("n_tokens"), F.lit(True).alias("complete"))
    last = slim.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("size"), F.max("behind").alias("behind"), F.sum("here").alias("doc_no"))
    left = last.withColumn("start", F.coalesce("behind", F.lit(0))).where("size > start")
    return whole.unionByName(left.select("file", "doc_no", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete")))


def count_tokens(spark: SparkSession, path: str, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """The token counts of all documents in the flat files under a path."""
    return stitch(scan_files(spark, path, end, width, block))


def op3_token_counts(spark, sf_dir) -> DataFrame:
    """The token count of every document, scanned from flat token files of all documents."""
    folder = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    names = write_flat_files(table(spark, sf_dir, "documents"), folder).withColumnsRenamed({"file": "name", "doc_no": "no"})
    counted = count_tokens(spark, folder).withColumn("file", F.substring_index("file", "/", -1))
    return names.join(counted, (F.col("name") == F.col("file")) & (F.col("no") == F.col("doc_no"))).select("doc_id", "n_tokens", "file", "doc_no", "start")
