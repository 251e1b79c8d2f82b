"""From raw documents to packed training windows: toxicity, quality rules, near-duplicates, mixing and packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm import mixing, near_dedup, packing, quality_rules, toxicity
from scoreframe.llm.common import materialize, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the lexicon is learned from the stage's own documents and the labels.

    Null and empty texts score lowest and stay. Rows are judged one by one, so repeated rows stay or go together; an empty
    table stays empty. All columns go through as they are, whatever their names.
    """
    [score] = unused(docs.columns, "_toxicity")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon, out=score).where(F.col(score) < toxicity.THRESHOLD).select(*_plain(docs))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines; n_chars, where there is one, follows the text.

    Null, empty and blank texts have too few words and go. Rows are judged one by one, so repeated rows stay or go together;
    an empty table stays empty. All other columns go through as they are, whatever their names.
    """
    packed = docs.select(F.struct(*_plain(docs)).alias("row"), F.col("text").alias("text"))
    kept = quality_rules.line_first(packed).where("kept")
    changed = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return kept.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Rows without an id or without words stay. Where an id repeats, each of its texts is decided on its own, so that none is
    lost that is like no other; equal rows stay or go together. An empty table stays empty. All columns go through as they
    are, whatever their names.
    """
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    A null source is a source of its own. Documents without words are never taken. Rows are documents, also where ids are
    null or repeat; equal rows are taken as often as all of them are. An empty table stays empty. All columns go through as
    they are, whatever their names.
    """
    return mixing.take(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows.

    A null or empty text is its end token. Every row is packed, also where ids are null or repeat; an empty table gives no
    pieces. Columns other than doc_id and text are left out.
    """
    return packing.pack(docs.select("doc_id", "text"))


def _plain(docs: DataFrame) -> list:
    """All columns by name, also where a name has dots in it."""
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", clean_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL expresses neither the lexicon of the first stage nor the packing of the last; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
