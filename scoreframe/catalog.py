"""The registered queries of the scorers, and DuckDB SQL that each must agree with.

Model responses in these queries are fixtures: they are built from the tables by rule and replayed through the judges'
own plans, so they test rendering, keys, parsing and scoring, and say nothing about any model.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.functions import jsons, scalar, thread
from scoreframe.functions.template import render
from scoreframe.operators.scorers import JUDGES, EmbeddingSimilarity, ExactJSON, ExactMatch, JSONDiff, Levenshtein, ListContains, Moderation, NumericDiff, ValidJSON, judge
from scoreframe.plans import evaluate, experiments, rag, summaries
from scoreframe.plans.jsondiff import difference_table
from scoreframe.plans.judge import TOOL, judged, with_requests
from scoreframe.sources import cases
from scoreframe.sources.files import read_json_array, shared_folder, write_json_array
from scoreframe.streaming import windowed_scores
from scoreframe.streaming.monitor import drift, once, session_scores, settle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def rounded(value: Column) -> Column:
    """Six digits after the point as SQL over binary numbers has them: the product with a million is rounded, so that a half
    counts as it stands there and not as the number is written (333 / 640, written 0.5203125, becomes 0.520312)."""
    return F.round(value.cast("double") * 1e6) / 1e6


def neighbours(df: DataFrame, key: str, column: str, *kept: str) -> DataFrame:
    """Each row with the next key's value as ``expected``, joined on the key."""
    following = df.select((F.col(key) - 1).alias("_next"), F.col(column).alias("expected"))
    return df.select(key, *kept, F.col(column).alias("output")).join(following, F.col(key) == F.col("_next")).drop("_next")


# --- texts, numbers, vectors


@query("""
SELECT a.p_partkey, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS score
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def levenshtein_part(spark, sf_dir):
    """Edit similarity of neighbouring part names."""
    scored = Levenshtein().transform(neighbours(table(spark, sf_dir, "part"), "p_partkey", "p_name"))
    return scored.select("p_partkey", rounded(F.col("Levenshtein.score")).alias("score"))


#: All letters of the documents beyond ASCII; DuckDB's edit distance is that of bytes, so in its SQL each one
#: becomes a control character that no text holds.
_LETTERS = "ÉßíçÇÑÈêÍéèäÜñÊÄóÓöüÖ"
_BYTES = f"translate(coalesce(text, ''), '{_LETTERS}', '{''.join(chr(c) for c in (*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)))}')"


@query(f"""
WITH d AS (SELECT doc_id, {_BYTES} AS t FROM documents)
SELECT a.doc_id, round(CASE WHEN a.t = b.t THEN 1 ELSE 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) END, 6) AS score
FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def levenshtein_documents(spark, sf_dir):
    """Edit similarity of neighbouring documents, whole."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    scored = Levenshtein(long_texts=True).transform(neighbours(docs, "doc_id", "text"))
    return scored.select("doc_id", rounded(F.col("Levenshtein.score")).alias("score"))


@query("""
SELECT a.p_brand, round(avg(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))), 6) AS score, count(*) AS n
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 GROUP BY 1""")
def levenshtein_by_brand(spark, sf_dir):
    """Average edit similarity of neighbouring part names, by brand."""
    scored = Levenshtein().transform(neighbours(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand"))
    return scored.groupBy("p_brand").agg(rounded(F.avg("Levenshtein.score")).alias("score"), F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN o = 0 AND e = 0 THEN 1 ELSE 1 - abs(e - o) / nullif(abs(e) + abs(o), 0) END, 6) AS score
FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS o, CAST(l_quantity AS DOUBLE) * p_retailprice AS e
      FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def numeric_diff_lineitem(spark, sf_dir):
    """How close a line's price comes to quantity times retail price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_extendedprice").cast("double").alias("output"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    pairs = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("expected", F.col("l_quantity").cast("double") * F.col("p_retailprice"))
    return NumericDiff().transform(pairs).select("l_orderkey", "l_linenumber", rounded(F.col("NumericDiff.score")).alias("score"))


@query("""
SELECT a.event_id, CASE WHEN a.event_type = b.event_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM events a JOIN events b ON b.event_id = a.event_id + 1""")
def exact_match_scalar(spark, sf_dir):
    """Whether neighbouring events are of one type."""
    pairs = neighbours(table(spark, sf_dir, "events"), "event_id", "event_type")
    return pairs.select("event_id", scalar.exact_score(F.col("output"), F.col("expected")).alias("score"))


@query("""
SELECT a.event_id, CASE WHEN (a.value > 50) = (b.value > 50) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
  CASE WHEN a.value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_true
FROM events a JOIN events b ON b.event_id = a.event_id + 1""")
def exact_match_boolean(spark, sf_dir):
    """Booleans with each other, and with the word that stands for true."""
    high = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 50)
    scored = ExactMatch().transform(neighbours(high, "event_id", "high")).withColumn("score", F.col("ExactMatch.score"))
    told = ExactMatch().transform(scored.drop("ExactMatch").withColumn("expected", F.lit("True")))
    return told.select("event_id", "score", F.col("ExactMatch.score").alias("is_true"))


@query("""
SELECT a.event_id, CASE WHEN CAST(json(a.props) AS VARCHAR) = CAST(json(b.props) AS VARCHAR) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM events a JOIN events b ON b.event_id = a.event_id + 1""")
def exact_match_json(spark, sf_dir):
    """Whether neighbouring events have the same properties, white space aside."""
    scored = ExactJSON().transform(neighbours(table(spark, sf_dir, "events"), "event_id", "props"))
    return scored.select("event_id", F.col("ExactMatch.score").alias("score"))


@query("""
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, sf_dir):
    """Cosine of neighbouring vectors."""
    pairs = neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return pairs.select("vec_id", rounded(scalar.cosine(F.col("output"), F.col("expected"))).alias("score"))


@query("""
SELECT a.vec_id, round(greatest(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_similarity(spark, sf_dir):
    """Scaled similarity of neighbouring vectors; with the default minimum all would be 0 here, so it is set to 0."""
    scored = EmbeddingSimilarity(expected_min=0.0).transform(neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return scored.select("vec_id", rounded(F.col("EmbeddingSimilarity.score")).alias("score"))


@query("""
SELECT a.label = b.label AS same_label, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score, count(*) AS n
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1""")
def embedding_same_label_report(spark, sf_dir):
    """Mean cosine of neighbouring vectors, by whether they have one label."""
    vectors = table(spark, sf_dir, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("_next"), F.col("embedding").alias("e"), F.col("label").alias("l"))
    pairs = vectors.join(following, F.col("vec_id") == F.col("_next")).withColumn("same_label", F.col("label") == F.col("l"))
    return pairs.groupBy("same_label").agg(rounded(F.avg(scalar.cosine(F.col("embedding"), F.col("e")))).alias("score"), F.count("*").alias("n"))


# --- JSON and lists


@query("""
SELECT event_id, cut, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) IN ('OBJECT', 'ARRAY') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS score
FROM (SELECT event_id, FALSE AS cut, props AS t FROM events UNION ALL SELECT event_id, TRUE, substr(props, 1, length(props) - 1) FROM events)""")
def valid_json_events(spark, sf_dir):
    """Validity of all properties, whole and without their last character."""
    events = table(spark, sf_dir, "events")
    whole = events.select("event_id", F.lit(False).alias("cut"), F.col("props").alias("output"))
    cut = events.select("event_id", F.lit(True).alias("cut"), F.col("props").substr(F.lit(1), F.length("props") - 1).alias("output"))
    return ValidJSON().transform(whole.unionByName(cut)).select("event_id", "cut", F.col("ValidJSON.score").alias("score"))


@query("SELECT event_id, CASE WHEN CAST(props->>'k' AS DOUBLE) >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events")
def valid_json_schema(spark, sf_dir):
    """Whether an event's properties fit a schema."""
    schema = {"type": "object", "properties": {"k": {"type": "number", "minimum": 50}}, "required": ["k"]}
    return table(spark, sf_dir, "events").select("event_id", jsons.valid_json(F.col("props"), schema).alias("score"))


_JSON_DIFF = """
SELECT event_id, round(CASE WHEN o = 0 AND e = 0 THEN 1 ELSE 1 - abs(e - o) / nullif(abs(e) + abs(o), 0) END, 6) AS score
FROM (SELECT a.event_id, CAST(a.props->>'k' AS DOUBLE) AS o, CAST(b.props->>'k' AS DOUBLE) AS e FROM events a JOIN events b ON b.event_id = a.event_id + 1)"""


@query(_JSON_DIFF)
def json_diff_props(spark, sf_dir):
    """Structural similarity of neighbouring events' properties, from text."""
    scored = JSONDiff().transform(neighbours(table(spark, sf_dir, "events"), "event_id", "props"))
    return scored.select("event_id", rounded(F.col("JSONDiff.score")).alias("score"))


@query(_JSON_DIFF)
def json_diff_typed(spark, sf_dir):
    """The same from typed structs, as a native expression."""
    kind = T.StructType([T.StructField("k", T.DoubleType())])
    events = table(spark, sf_dir, "events").withColumn("typed", F.from_json("props", kind))
    scored = JSONDiff().transform(neighbours(events, "event_id", "typed"))
    return scored.select("event_id", rounded(F.col("JSONDiff.score")).alias("score"))


def nested(spark, sf_dir) -> DataFrame:
    """Events as nested values: a kind, tags of which some rows have one more, numbers inside a struct, a field that may lack."""
    k = F.get_json_object("props", "$.k").cast("double")
    tags = F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array("event_type"))
    inner = F.struct(k.alias("k"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), tags.alias("tags"), inner.alias("inner")).alias("typed"))


_LEV_OF = "(CASE WHEN {0} = {1} THEN 1 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) END)"
_NUM_OF = "(CASE WHEN {0} = 0 AND {1} = 0 THEN 1 ELSE 1 - abs({1} - {0}) / nullif(abs({1}) + abs({0}), 0) END)"
_NESTED = """
n AS (SELECT event_id, event_type AS t, CAST(props->>'k' AS DOUBLE) AS k, CASE WHEN event_id % 3 = 0 THEN CAST(value AS DOUBLE) END AS v, event_id % 2 AS odd FROM events),
p AS (SELECT a.event_id, a.t AS ta, b.t AS tb, a.k AS ak, b.k AS bk, a.v AS av, b.v AS bv, a.odd AS ao, b.odd AS bo FROM n a JOIN n b ON b.event_id = a.event_id + 1),
s AS (SELECT event_id, {lev} AS kind, ({lev} + CASE WHEN ao = 0 AND bo = 0 THEN 1 ELSE 0 END) / greatest(2 - ao, 2 - bo) AS tags,
        CASE WHEN av IS NULL AND bv IS NULL THEN {num_k} WHEN av IS NULL OR bv IS NULL THEN {num_k} / 2 ELSE ({num_k} + {num_v}) / 2 END AS inner_ FROM p)
""".format(lev=_LEV_OF.format("ta", "tb"), num_k=_NUM_OF.format("ak", "bk"), num_v=_NUM_OF.format("av", "bv"))


@query(f"WITH {_NESTED} SELECT event_id, round((kind + tags + inner_) / 3, 6) AS score FROM s")
def json_diff_nested(spark, sf_dir):
    """Structural similarity of neighbouring events as nested values, natively."""
    scored = JSONDiff().transform(neighbours(nested(spark, sf_dir), "event_id", "typed"))
    return scored.select("event_id", rounded(F.col("JSONDiff.score")).alias("score"))


@query(f"WITH {_NESTED} SELECT event_id, round((kind + tags + inner_) / 3, 6) AS score FROM s")
def json_diff_unequal_types(spark, sf_dir):
    """The same with one side as JSON text, in which one field more is null, so that both go through text."""
    pairs = neighbours(nested(spark, sf_dir), "event_id", "typed").withColumn("expected", F.to_json("expected"))
    scored = JSONDiff().transform(pairs)
    return scored.select("event_id", rounded(F.col("JSONDiff.score")).alias("score"))


@query(f"WITH {_NESTED} SELECT event_id, round((kind + tags + inner_) / 3, 6) AS score FROM s")
def json_difference_table(spark, sf_dir):
    """The same from JSON text on both sides, as tables of values."""
    pairs = neighbours(nested(spark, sf_dir).withColumn("typed", F.to_json("typed")), "event_id", "typed")
    return difference_table(pairs, ["event_id"], "output", "expected").withColumn("score", rounded(F.col("score")))


@query(f"WITH {_NESTED} SELECT event_id, round(inner_, 6) AS score FROM s")
def json_diff_maps(spark, sf_dir):
    """Maps of numbers, of which some rows have one key more, natively."""
    inner = nested(spark, sf_dir).select("event_id", "typed.inner.*")
    every = F.create_map(F.lit("k"), F.col("k"), F.lit("v"), F.col("v").cast("double"))
    scored = JSONDiff().transform(neighbours(inner.select("event_id", F.map_filter(every, lambda _, x: x.isNotNull()).alias("typed")), "event_id", "typed"))
    return scored.select("event_id", rounded(F.col("JSONDiff.score")).alias("score"))


@query("""
SELECT event_id, CASE WHEN k < 90 AND (v IS NULL OR k >= 10) AND odd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS typed, CASE WHEN k < 90 AND (v IS NULL OR k >= 10) AND odd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS text
FROM (SELECT event_id, CAST(props->>'k' AS DOUBLE) AS k, CASE WHEN event_id % 3 = 0 THEN value END AS v, event_id % 2 = 1 AS odd FROM events)""")
def valid_json_schema_nested(spark, sf_dir):
    """One rule as a schema that types decide, over structs, and as one with references and what is unevaluated, over text."""
    rows = nested(spark, sf_dir).select("event_id", F.col("typed").alias("output"))
    inner = {"required": ["k"], "properties": {"k": {"type": "number", "exclusiveMaximum": 90}, "v": {"type": "number"}}}
    late = {"properties": {"k": {"minimum": 10}}}
    whole = {"type": "object", "required": ["kind"], "properties": {"kind": {"type": "string"}, "tags": {"items": {"type": "string"}, "maxItems": 1}, "inner": {**inner, "if": {"required": ["v"]}, "then": late}}, "additionalProperties": False}
    asked = {"$defs": {"inner": {**inner, "dependentSchemas": {"v": late}}}, "properties": {"inner": {"$ref": "#/$defs/inner", "unevaluatedProperties": False}},
             "patternProperties": {"^t": {"prefixItems": [{"type": "string"}], "unevaluatedItems": False}}, "allOf": [{"properties": {"kind": {"not": {"const": 1}}}}], "unevaluatedProperties": False}
    scored = ValidJSON(schema=whole).transform(rows).withColumn("typed", F.col("ValidJSON.score"))
    return ValidJSON(schema=asked).transform(scored.withColumn("output", F.to_json("output"))).select("event_id", "typed", F.col("ValidJSON.score").alias("text"))


@query("SELECT event_id, props, CAST(props->>'k' AS DOUBLE) AS k, event_type AS tag FROM events")
def json_array_scan(spark, sf_dir):
    """Events' properties, as text with brackets and quotes and as objects, written as arrays and read again by byte ranges."""
    path = f"{shared_folder(spark)}/array-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    typed = F.struct(F.from_json("props", "k double").alias("props"), F.array("event_type").alias("tags"))
    write_json_array(events.select("event_id", F.concat(F.lit('"}, {\\'), F.col("props"), F.lit("[,")).alias("note"), typed.alias("inner")), path)
    rows = read_json_array(spark, path, "event_id long, note string, inner struct<props: struct<k: double>, tags: array<string>>")
    return rows.select("event_id", F.expr("substr(note, 7, length(note) - 8)").alias("props"), F.col("inner.props.k").alias("k"), F.get("inner.tags", F.lit(0)).alias("tag"))


@query(f"WITH {_NESTED} SELECT event_id, round((0.5 * CASE WHEN ta = tb THEN 2 ELSE 1 END + CASE WHEN ta = tb THEN 1 ELSE 0.5 END) / 2, 6) AS score FROM p")
def json_diff_maps_custom(spark, sf_dir):
    """Maps, and a scorer of texts that tells equal (1) from unequal (0.5) alone."""
    events = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("kind"), F.array("event_type"), F.lit("again"), F.array("event_type")).alias("typed"))
    scored = JSONDiff(string_scorer=lambda a, b: 1.0 if a == b else 0.5).transform(neighbours(events, "event_id", "typed"))
    return scored.select("event_id", rounded(F.col("JSONDiff.score")).alias("score"))


@query("""
SELECT a.event_id, CASE WHEN a.props::JSON->>'k' IS NULL THEN NULL
  ELSE round(CASE WHEN o = 0 AND e = 0 THEN 1 ELSE 1 - abs(e - o) / nullif(abs(e) + abs(o), 0) END, 6) END AS score
FROM (SELECT x.event_id, x.props, CAST(x.props->>'k' AS DOUBLE) AS o, CAST(y.props->>'k' AS DOUBLE) AS e FROM events x JOIN events y ON y.event_id = x.event_id + 1) a""")
def json_diff_text_in_struct(spark, sf_dir):
    """JSON texts inside structs are opened."""
    events = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("props").alias("inside")).alias("typed"))
    scored = JSONDiff().transform(neighbours(events, "event_id", "typed"))
    return scored.select("event_id", rounded(F.col("JSONDiff.score")).alias("score"))


@query("SELECT event_id, 1.0::DOUBLE AS score, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fits FROM events")
def valid_json_parsed(spark, sf_dir):
    """Values that are structs already, without and with a schema that asks for a field which may lack."""
    rows = nested(spark, sf_dir).select("event_id", F.col("typed.inner").alias("output"))
    schema = {"type": "object", "properties": {"v": {"type": "number"}}, "required": ["v"]}
    scored = ValidJSON(schema=schema).transform(rows).withColumn("fits", F.col("ValidJSON.score"))
    return ValidJSON().transform(scored).select("event_id", F.col("ValidJSON.score").alias("score"), "fits")


@query(f"WITH {_NESTED} SELECT event_id, CASE WHEN ak = bk AND av IS NOT DISTINCT FROM bv THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM p")
def exact_match_typed(spark, sf_dir):
    """Equality of structs, in which a field may lack its value."""
    rows = nested(spark, sf_dir).select("event_id", F.col("typed.inner").alias("inner"))
    return ExactMatch().transform(neighbours(rows, "event_id", "inner")).select("event_id", F.col("ExactMatch.score").alias("score"))


_LEV = "(1 - levenshtein(o[{0}], e[{1}]) / greatest(length(o[{0}]), length(e[{1}])))"


@query(f"""
SELECT p_partkey, round(greatest({_LEV.format(1, 1)} + {_LEV.format(2, 2)}, {_LEV.format(1, 2)} + {_LEV.format(2, 1)}) / 2, 6) AS score
FROM (SELECT a.p_partkey, string_split(a.p_name, ' ') AS o, string_split(b.p_name, ' ') AS e FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)""")
def list_contains_names(spark, sf_dir):
    """Overlap of the words of neighbouring part names; every name has two."""
    part = table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    scored = ListContains().transform(neighbours(part, "p_partkey", "words"))
    return scored.select("p_partkey", rounded(F.col("ListContains.score")).alias("score"))


_THREE = [(1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)]
_SQUARE = f"greatest({', '.join(' + '.join(_LEV.format(o, e + 1) for e, o in enumerate(p)) for p in _THREE)})"
_WIDE = f"greatest({', '.join(' + '.join(_LEV.format(o, e + 1) for e, o in enumerate(p[:2])) for p in _THREE)})"


@query(f"""
WITH w AS (SELECT p_partkey, list_append(string_split(p_name, ' '), p_type) AS o FROM part), p AS (SELECT a.p_partkey, a.o, b.o AS e FROM w a JOIN w b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round({_SQUARE} / 3, 6) AS square, round({_WIDE} / 3, 6) AS wide, round({_WIDE} / 2, 6) AS extra FROM p""")
def list_contains_unequal(spark, sf_dir):
    """Lists of three entries against lists of three and of two, with and without leave for the extra entry."""
    part = table(spark, sf_dir, "part").withColumn("words", F.concat(F.split("p_name", " "), F.array("p_type")))
    pairs = neighbours(part, "p_partkey", "words").withColumn("two", F.slice("expected", 1, 2))
    scored = ListContains().transform(pairs).withColumnRenamed("ListContains", "square")
    scored = ListContains(expected="two").transform(scored).withColumnRenamed("ListContains", "wide")
    scored = ListContains(expected="two", allow_extra_entities=True).transform(scored).withColumnRenamed("ListContains", "extra")
    return scored.select("p_partkey", *[rounded(F.col(f"{c}.score")).alias(c) for c in ("square", "wide", "extra")])


# --- threads


@query("""
WITH t AS (SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS thread_count, count(*) FILTER (WHERE role = 'user') AS users,
             count(*) FILTER (WHERE role = 'assistant') AS assistants, count(*) AS messages,
             arg_min(text, turn) FILTER (WHERE role <> 'system') AS first_text, arg_max(text, turn) FILTER (WHERE role <> 'system') AS last_text
           FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(thread_count AS INTEGER) AS thread_count, CAST(users AS INTEGER) AS users, CAST(assistants AS INTEGER) AS assistants, CAST(messages AS INTEGER) AS messages, first_text, last_text FROM t""")
def thread_vars(spark, sf_dir):
    """The thread variables of every conversation."""
    df = thread.add_variables(thread.collect_threads(table(spark, sf_dir, "conversations")))
    sizes = [F.size("user_messages").alias("users"), F.size("assistant_messages").alias("assistants"), F.size("thread_with_system").alias("messages")]
    return df.select("conv_id", "thread_count", *sizes, F.col("first_message.content").alias("first_text"), F.col("last_message.content").alias("last_text"))


@query("""
SELECT conv_id, coalesce(string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ':' || chr(10) || '  ' || replace(text, chr(10), chr(10) || '  '), chr(10) || chr(10) ORDER BY turn)
       FILTER (WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''), '') AS text
FROM conversations GROUP BY conv_id""")
def thread_text(spark, sf_dir):
    """Every conversation as text."""
    df = thread.collect_threads(table(spark, sf_dir, "conversations"))
    return df.select("conv_id", thread.thread_text(F.col("all_messages")).alias("text"))



@query(f"""
SELECT conv_id, coalesce(string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ':' || chr(10) || '  ' || replace(text || chr(10), chr(10), chr(10) || '  '), chr(10) || chr(10) ORDER BY turn)
       FILTER (WHERE turn % 3 <> 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''), '') AS text,
  repeat('.', CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER)) AS marks
FROM conversations GROUP BY conv_id""")
def thread_text_blanks(spark, sf_dir):
    """Conversations in which every third message is nothing but white space, inside a template with sections."""
    said = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.lit("\n\t ")).otherwise(F.concat("text", F.lit("\n"))))
    df = thread.add_variables(thread.collect_threads(said)).withColumn("whole", F.col("all_messages"))
    made = df.select("conv_id", render(df, "{{#user_messages}}.{{/user_messages}}|{{whole}}").alias("made"))
    return made.select("conv_id", F.expr("substr(made, instr(made, '|') + 1)").alias("text"), F.substring_index("made", "|", 1).alias("marks"))


@query("""
WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations)
SELECT u.conv_id, CAST(u.i - 1 AS INTEGER) AS pair, u.text AS human, a.text AS assistant
FROM n u JOIN n a ON a.conv_id = u.conv_id AND a.i = u.i AND u.role = 'user' AND a.role = 'assistant'""")
def human_ai_pairs(spark, sf_dir):
    """The i-th user message with the i-th assistant message of every conversation."""
    df = thread.collect_threads(table(spark, sf_dir, "conversations"))
    pairs = df.select("conv_id", F.posexplode(thread.human_ai_pairs(thread.without_system(F.col("all_messages")))).alias("pair", "p"))
    return pairs.select("conv_id", "pair", F.col("p.human.content").alias("human"), F.col("p.assistant.content").alias("assistant"))


def typed_parts(spark, sf_dir) -> DataFrame:
    """Conversations as typed parts: each message's text; in users' messages reasoning after it; an assistant's message also calls
    a tool, and a tool's message follows with the result, whose form goes by conversation."""
    said = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").withColumn("turn", F.col("turn").cast("long") * 2)
    none = F.lit(None).cast("string")
    part = lambda place, kind, text=none, id_=none, name=none, arguments=none, output=none: F.struct(F.lit(place).alias("place"), F.lit(kind).alias("type"), text.alias("text"), id_.alias("tool_call_id"), name.alias("tool_name"), arguments.alias("arguments"), output.alias("output"))
    text, i = F.coalesce("text", F.lit("")), F.col("turn").cast("string")
    given = F.to_json(F.struct(F.when(F.col("conv_id") % 2 == 0, "valid").otherwise("invalid").alias("type"), F.concat(F.lit("n"), i).alias("value")))
    users, callers = F.array(part(0, "text", text), part(1, "reasoning", text)), F.array(part(0, "text", text), part(1, "tool_call", id_=i, name=F.lit("look"), arguments=given))
    asked = said.select("conv_id", "turn", "role", F.explode(F.when(F.col("role") == "user", users).otherwise(callers)).alias("p"))
    form = F.col("conv_id") % 4
    plain = F.concat(F.lit("found "), i)
    output = F.when(form == 0, plain).when(form == 1, F.to_json(F.array(F.struct(plain.alias("text")), F.struct(F.lit("more").alias("text"))))).when(form == 2, F.concat(F.lit("error: '"), plain, F.lit("'"))).otherwise(F.concat(F.lit("Error "), F.repeat(plain, 100)))
    named = F.when(F.col("conv_id") % 3 == 0, F.lit("own"))
    answered = said.where("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("tool").alias("role"), part(0, "tool_result", id_=i, name=named, output=output).alias("p"))
    return asked.unionByName(answered).select("conv_id", "turn", "role", "p.*")


@query("""
WITH m AS (SELECT conv_id, 2 * turn AS turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')),
said AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || chr(10) || '[thinking: ' || substr(text, 1, 100) || '...]' ELSE text END AS c FROM m),
r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'own' ELSE 'look' END AS name, CASE WHEN conv_id % 2 = 0 THEN '"n' || turn || '"' ELSE 'n' || turn END AS args,
        CASE conv_id % 4 WHEN 0 THEN 'found ' || turn WHEN 1 THEN 'found ' || turn || chr(10) || 'more' WHEN 2 THEN 'found ' || turn ELSE 'Error ' || repeat('found ' || turn, 100) END AS res FROM m WHERE role = 'assistant'),
cut AS (SELECT *, length(res) - 500 + 30 AS out_, ' [...' || (length(res) - 470) || ' chars truncated...] ' AS note FROM r),
z AS (SELECT conv_id, turn, name, args, res, CASE WHEN length(res) <= 500 THEN res
        ELSE substr(res, 1, (500 - length(note)) // 2) || note || substr(res, length(res) - (500 - length(note) - (500 - length(note)) // 2) + 1) END AS shown FROM cut),
every AS (SELECT conv_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) || ':' || chr(10) || '  ' || replace(c, chr(10), chr(10) || '  ') AS piece FROM said WHERE c <> ''
  UNION ALL SELECT conv_id, turn + 1, 'Tool (' || name || '):' || chr(10) || '  Args:' || chr(10) || '    ' || args || chr(10) || CASE WHEN lower(res) LIKE 'error%' THEN '  Error:' ELSE '  Result:' END || chr(10) || '    ' || shown FROM z)
SELECT conv_id, string_agg(piece, chr(10) || chr(10) ORDER BY turn) AS text FROM every GROUP BY conv_id""")
def thread_text_typed(spark, sf_dir):
    """Conversations with reasoning, tool calls and results as text."""
    return thread.typed_thread_text(typed_parts(spark, sf_dir))


# --- judges


def judge_rows(spark, sf_dir) -> DataFrame:
    """One row per conversation: input, output and expected from its messages, and the judges' other inputs."""
    of = lambda f, role: f(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of(F.min_by, "user").alias("input"), of(F.min_by, "assistant").alias("output"), of(F.max_by, "assistant").alias("expected"))
    return rows.withColumns({"instructions": F.col("input"), "criteria": F.lit("It is polite."), "language": F.lit("French")})


_ROWS = """r AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS input,
  coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS output, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS expected
  FROM conversations GROUP BY conv_id)"""
_INPUTS = {"input": "input", "output": "output", "expected": "expected", "instructions": "input", "criteria": "'It is polite.'", "language": "'French'"}


def call_response(arguments: Column, tool: str) -> Column:
    """A stored response that calls a tool; the arguments are JSON text."""
    function = F.struct(F.lit(tool).alias("name"), arguments.alias("arguments"))
    message = F.struct(F.array(F.struct(function.alias("function"))).alias("tool_calls"))
    return F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))


def _add_judge(name: str) -> None:
    spec = judge(name)
    key = name.lower()
    sql = "'" + spec.template.replace("'", "''") + "'"
    for column, value in _INPUTS.items():
        sql = f"replace(replace({sql}, '{{{{{{{column}}}}}}}', {value}), '{{{{{column}}}}}', {value})"
    choices = list(spec.choice_scores)
    cases_sql = " ".join(f"WHEN {i} THEN {spec.choice_scores[c]}::DOUBLE" for i, c in enumerate(choices))

    def prompt(spark, sf_dir):
        return with_requests(judge_rows(spark, sf_dir), spec).select("conv_id", "prompt")

    def score(spark, sf_dir):
        asked = with_requests(judge_rows(spark, sf_dir), spec)
        pick = F.get(F.array(*[F.lit(c) for c in choices]), (F.length(F.coalesce("output", F.lit(""))) % len(choices)).cast("int"))
        replayed = asked.groupBy("request_key").agg(F.first("output").alias("output"))
        replayed = replayed.select("request_key", call_response(F.to_json(F.struct(pick.alias("choice"), F.lit("by rule").alias("reasons"))), TOOL).alias("response"))
        return judged(asked, replayed, spec).select("conv_id", F.col(f"{spec.name}.score").alias("score"))

    prompt.__doc__, score.__doc__ = f"The prompts of {name}.", f"The scores of {name} for replayed choices."
    QUERIES[f"judge_prompt_{key}"], ORACLES[f"judge_prompt_{key}"] = prompt, f"WITH {_ROWS} SELECT conv_id, {sql} AS prompt FROM r"
    QUERIES[f"judge_score_{key}"], ORACLES[f"judge_score_{key}"] = score, f"WITH {_ROWS} SELECT conv_id, CASE length(output) % {len(choices)} {cases_sql} END AS score FROM r"


for _name in JUDGES:
    _add_judge(_name)


@query("""
SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN 1.0::DOUBLE END AS score,
  CASE conv_id % 6 WHEN 1 THEN 'empty response' WHEN 2 THEN 'no tool call in the response' WHEN 3 THEN 'another tool called: other' WHEN 4 THEN 'no choice in the call' END AS error
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def judge_response_errors(spark, sf_dir):
    """What becomes of responses of all forms: a choice, none at all, no call, a call of another tool, no choice, no response."""
    spec = judge("Humor")
    best = max(spec.choice_scores, key=spec.choice_scores.get)
    rows = judge_rows(spark, sf_dir).withColumn("request_key", F.col("conv_id").cast("string"))
    form = F.col("conv_id") % 6
    text = lambda value: F.lit(value)
    response = (
        F.when(form == 0, call_response(F.to_json(F.struct(F.lit(f" {best} ").alias("choice"))), TOOL))
        .when(form == 1, text('{"choices": []}'))
        .when(form == 2, text('{"choices": [{"message": {"content": "no"}}]}'))
        .when(form == 3, call_response(F.to_json(F.struct(F.lit(best).alias("choice"))), "other"))
        .when(form == 4, call_response(text("{}"), TOOL))
    )
    responses = rows.where(form < 5).select("request_key", response.alias("response"))
    scored = judged(rows, responses, spec)
    return scored.select("conv_id", F.col(f"{spec.name}.score").alias("score"), F.get_json_object(f"{spec.name}.metadata", "$.error").alias("error"))


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 3 THEN NULL ELSE 1.0::DOUBLE END AS score FROM (SELECT DISTINCT conv_id FROM conversations)")
def judge_choice_white_space(spark, sf_dir):
    """Choices with line ends, tabs and spaces around them count as without; with a dot they are unknown."""
    spec = judge("Humor")
    best = max(spec.choice_scores, key=spec.choice_scores.get)
    rows = judge_rows(spark, sf_dir).withColumn("request_key", F.col("conv_id").cast("string"))
    choice = F.get(F.array(*[F.lit(x) for x in (f"{best}\n", f"\t{best} ", f"\r\n\u00a0{best}", f"{best}.")]), (F.col("conv_id") % 4).cast("int"))
    responses = rows.select("request_key", call_response(F.to_json(F.struct(choice.alias("choice"))), TOOL).alias("response"))
    return judged(rows, responses, spec).select("conv_id", F.col(f"{spec.name}.score").alias("score"))


@query("""
SELECT conv_id, 'Asked: ' || string_agg(CASE WHEN role = 'user' THEN '(' || text || ')' END, '' ORDER BY turn) || CASE WHEN count(*) FILTER (WHERE role = 'system') = 0 THEN ' no system' ELSE '' END
  || ' first: ' || arg_min(text, turn) FILTER (WHERE role = 'user') AS text
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0""")
def template_sections(spark, sf_dir):
    """A template with sections, an inverted section and a path, over every conversation that a user speaks in."""
    df = thread.add_variables(thread.collect_threads(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))))
    df = df.where(F.size("user_messages") > 0).withColumn("system_messages", thread.of_role(F.col("all_messages"), "system"))
    template = "Asked: {{#user_messages}}({{content}}){{/user_messages}}{{^system_messages}} no system{{/system_messages}} first: {{user_messages.0.content}}"
    return df.select("conv_id", render(df, template).alias("text"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM labels")
def moderation_flagged(spark, sf_dir):
    """Moderation without a threshold; labels stand for verdicts."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flagged"), F.create_map(F.lit("toxic"), F.col("toxic").cast("double")).alias("category_scores"))
    return Moderation().transform(rows).select("doc_id", F.col("Moderation.score").alias("score"))


@query("SELECT doc_id, CASE WHEN (doc_id % 100) / 100.0 > 0.25 OR toxic > 0.25 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM labels")
def moderation_threshold(spark, sf_dir):
    """Moderation with a threshold over two categories."""
    scores = F.create_map(F.lit("toxic"), F.col("toxic").cast("double"), F.lit("other"), (F.col("doc_id") % 100) / 100.0)
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flagged"), scores.alias("category_scores"))
    return Moderation(threshold=0.25).transform(rows).select("doc_id", F.col("Moderation.score").alias("score"))


# --- retrieval metrics, from replayed payloads


def _replayed(arguments: Column, step: str) -> Column:
    """A payload column, sent through a stored response."""
    return rag.payload(call_response(arguments, rag.QUESTIONS[step].tool), step)


_LINES = "SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents"


def lines_of(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("lines", F.split("text", "\n"))


@query(f"""
SELECT doc_id, round(least(1, greatest(0, coalesce(list_sum(list_transform(list_filter(l, lambda x: length(x) % 2 = 0), lambda x: length(x))), 0) / nullif(length(text), 0))), 6) AS score
FROM ({_LINES})""")
def rag_context_relevancy(spark, sf_dir):
    """Each document as a context, its lines of even length as the needed sentences."""
    even = F.transform(F.filter("lines", lambda x: F.length(x) % 2 == 0), lambda x: F.struct(x.alias("sentence"), F.array(F.lit("even")).alias("reasons")))
    rows = lines_of(spark, sf_dir).withColumn("p", _replayed(F.to_json(F.struct(even.alias("sentences"))), "ContextRelevancy"))
    return rows.select("doc_id", rounded(rag.context_relevancy(F.col("p.sentences"), F.col("text"))).alias("score"))


_SHARE = f"""
SELECT doc_id, round(list_sum(list_transform(l, lambda x: length(x) % 2)) / len(l), 6) AS score FROM ({_LINES})"""


@query(_SHARE)
def rag_context_recall(spark, sf_dir):
    """Each document's lines as statements, those of odd length as supported."""
    each = F.transform("lines", lambda x: F.struct(x.alias("statement"), (F.length(x) % 2).alias("attributed"), F.lit("by rule").alias("reason")))
    rows = lines_of(spark, sf_dir).withColumn("p", _replayed(F.to_json(F.struct(each.alias("statements"))), "ContextRecall"))
    return rows.select("doc_id", rounded(rag.context_recall(F.col("p.statements"))).alias("score"))


@query(_SHARE)
def rag_faithfulness(spark, sf_dir):
    """Each document's lines as statements of an answer, first extracted and then judged, those of odd length as true."""
    first = _replayed(F.to_json(F.struct(F.col("lines").alias("statements"))), "Faithfulness.statements")
    rows = lines_of(spark, sf_dir).withColumn("statements", first["statements"])
    each = F.transform("statements", lambda x: F.struct(x.alias("statement"), (F.length(x) % 2).alias("verdict"), F.lit("by rule").alias("reason")))
    rows = rows.withColumn("p", _replayed(F.to_json(F.struct(each.alias("faithfulness"))), "Faithfulness.verdicts"))
    return rows.select("doc_id", rounded(rag.faithfulness(F.col("p.faithfulness"))).alias("score"))


@query("SELECT doc_id, CAST(quality AS DOUBLE) AS score FROM labels")
def rag_context_precision(spark, sf_dir):
    """Quality labels as verdicts."""
    rows = table(spark, sf_dir, "labels").withColumn("p", _replayed(F.to_json(F.struct(F.lit("by rule").alias("reason"), F.col("quality").alias("verdict"))), "ContextPrecision"))
    return rows.select("doc_id", F.col("p.verdict").cast("double").alias("score"))


@query("""
SELECT a.vec_id, round(CASE WHEN max(CASE WHEN b.label = 0 THEN 1 ELSE 0 END) > 0 THEN 0
  ELSE avg(greatest(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0)) END, 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 3 GROUP BY a.vec_id""")
def rag_answer_relevancy(spark, sf_dir):
    """Three following vectors as generated questions; label 0 marks an evasive answer."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.select("vec_id", F.col("embedding").alias("input"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("q"))
    questions = vectors.select(F.col("vec_id").alias("_q"), F.col("embedding").alias("question"), (F.col("label") == 0).cast("int").alias("noncommittal"))
    scored = rag.answer_relevancy(asked.join(questions, F.col("q") == F.col("_q")), ["vec_id"], "question", "input", "noncommittal", expected_min=0.0)
    return scored.select("vec_id", rounded(F.col("AnswerRelevancy.score")).alias("score"))


@query(ORACLES["embedding_similarity"])
def rag_answer_similarity(spark, sf_dir):
    """Neighbouring vectors as two answers' embeddings."""
    pairs = neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return pairs.select("vec_id", rounded(rag.answer_similarity(F.col("output"), F.col("expected"), 0.0)["score"]).alias("score"))


@query("""
WITH c AS (SELECT a.vec_id, greatest(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0) AS s,
             1 + a.vec_id % 4 AS tp, a.vec_id % 3 AS fp, a.vec_id % 5 AS fn FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(0.75 * (tp / (tp + 0.5 * (fp + fn))) + 0.25 * s, 6) AS score FROM c""")
def rag_answer_correctness(spark, sf_dir):
    """Statement counts by rule, similarity of neighbouring vectors."""
    pairs = neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    some = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    i = F.col("vec_id")
    arguments = F.to_json(F.struct(some(1 + i % 4).alias("TP"), some(i % 3).alias("FP"), some(i % 5).alias("FN")))
    rows = pairs.withColumn("p", _replayed(arguments, "AnswerCorrectness"))
    similarity = scalar.embedding_score(F.col("output"), F.col("expected"), 0.0)
    return rows.select("vec_id", rounded(rag.answer_correctness(F.col("p"), similarity)).alias("score"))


_COS = "greatest(list_cosine_similarity(CAST({0}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[])), 0)"


@query(f"""
SELECT a.vec_id, round(least(1, greatest({_COS.format("a", "c")} + {_COS.format("b", "d")}, {_COS.format("a", "d")} + {_COS.format("b", "c")}) / 2), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2 JOIN embeddings d ON d.vec_id = a.vec_id + 3""")
def rag_entity_recall(spark, sf_dir):
    """Two vectors as a context's entities, the two after them as the expected ones."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    placed = vectors.select(F.explode(F.array(*[F.struct((F.col("vec_id") - k).alias("start"), F.lit(k).alias("k")) for k in range(4)])).alias("s"), "embedding")
    four = placed.groupBy("s.start").agg(F.array_sort(F.collect_list(F.struct("s.k", "embedding"))).alias("v")).where("size(v) = 4")
    entity = lambda k: F.get("v", F.lit(k))["embedding"]
    scored = rag.entity_recall(four, F.array(entity(0), entity(1)), F.array(entity(2), entity(3)), expected_min=0.0)
    return scored.select(F.col("start").alias("vec_id"), rounded(F.col("ContextEntityRecall.score")).alias("score"))


# --- evaluation


def qa_corpus(spark, sf_dir) -> DataFrame:
    """Documents as stories with three questions, whose answers are the first, the last and the middle line with their places."""
    rows = lines_of(spark, sf_dir)
    at = F.floor(F.size("lines") / 2).cast("int")
    first, last, middle = F.get("lines", F.lit(0)), F.try_element_at("lines", F.lit(-1)), F.get("lines", at)
    before = F.aggregate(F.slice("lines", F.lit(1), at), F.lit(0), lambda n, x: n + F.length(x) + 1)
    starts = [F.lit(0), F.length("text") - F.length(last), before]
    texts = [first, last, middle]
    places = lambda values: F.array(*[v.cast("bigint") for v in values])
    answers = F.struct(F.array(*texts).alias("input_text"), places(starts).alias("answer_start"), places([s + F.length(t) for s, t in zip(starts, texts, strict=True)]).alias("answer_end"))
    questions = F.array(*[F.lit(f"What is {x}?") for x in ("first", "last", "in the middle")])
    return rows.select("doc_id", F.lit("lines").alias("source"), F.col("text").alias("story"), questions.alias("questions"), answers.alias("answers"))


@query(f"""
WITH d AS (SELECT doc_id, text, l[1] AS a, l[len(l)] AS b, l[len(l) // 2 + 1] AS c FROM ({_LINES})),
c AS (SELECT doc_id, 'factuality' AS tag, 'What is first?' AS asked, a AS given, 1.0 AS expected FROM d UNION ALL SELECT doc_id, 'factuality', 'What is first?', b, 0.0 FROM d
  UNION ALL SELECT doc_id, 'factuality', 'What is first?', b || ' ' || a || ' ' || coalesce(c, b), 0.6 FROM d WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, 'factuality', 'What is first?', a || ' ' || b, 0.6 FROM d WHERE c IS NULL
  UNION ALL SELECT doc_id, 'context relevancy', 'What is first?', a, 1.0 FROM d UNION ALL SELECT doc_id, 'context relevancy', 'What is first?', b, 0.0 FROM d
  UNION ALL SELECT doc_id, 'context relevancy', 'What is first?', a || ' ' || b, length(a) / (length(a) + length(b) + 1) FROM d
  UNION ALL SELECT doc_id, 'closed q a', 'Story:' || chr(10) || text || chr(10) || chr(10) || 'What is asked about it: What is first?', a, 1.0 FROM d
  UNION ALL SELECT doc_id, 'closed q a', 'Story:' || chr(10) || text || chr(10) || chr(10) || 'What is asked about it: What is first?', b, 0.0 FROM d)
SELECT doc_id, tag, asked, given, round(CAST(expected AS DOUBLE), 6) AS expected FROM c""")
def eval_case_generators(spark, sf_dir):
    """All three generators over all documents."""
    corpus = qa_corpus(spark, sf_dir)
    slim = lambda df, field: df.select("doc_id", F.get("tags", F.lit(0)).alias("tag"), F.col("input.input").alias("asked"), F.col(f"input.{field}").alias("given"), rounded(F.col("expected")).alias("expected"))
    parts = [slim(cases.factuality_cases(corpus), "output"), slim(cases.relevancy_cases(corpus), "context"), slim(cases.closed_qa_cases(corpus), "output")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT p_partkey, CASE WHEN a.p_partkey % 2 = 0 THEN 'near' ELSE 'same' END AS how,
  round(CASE WHEN a.p_partkey % 2 = 0 THEN 1 - levenshtein(a.p_name, b.n) / greatest(length(a.p_name), length(b.n)) WHEN a.p_name = b.n THEN 1 ELSE 0 END, 6) AS score
FROM part a JOIN (SELECT p_partkey - 1 AS k, p_name AS n FROM part) b ON b.k = a.p_partkey""")
def eval_dispatch(spark, sf_dir):
    """Each row scored by the scorer that it names."""
    pairs = neighbours(table(spark, sf_dir, "part"), "p_partkey", "p_name").withColumn("how", F.when(F.col("p_partkey") % 2 == 0, "near").otherwise("same"))
    scored = evaluate.dispatch(pairs, {"near": Levenshtein(), "same": ExactMatch()}, "how")
    return scored.select("p_partkey", "how", rounded(F.col("score")).alias("score"))


@query("""
SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN 1 - levenshtein(o, e) / greatest(length(o), length(e)) WHEN 1 THEN CASE WHEN o = e THEN 1 ELSE 0 END END, 6) AS score,
  CASE p_partkey % 4 WHEN 2 THEN 'no such scorer: none is named' WHEN 3 THEN 'no such scorer: other' END AS error
FROM (SELECT a.p_partkey, a.p_name AS o, b.p_name AS e FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)""")
def eval_dispatch_unknown(spark, sf_dir):
    """Rows that name no scorer, or one that isn't there, stay and say so."""
    how = F.get(F.array(F.lit("near"), F.lit("same"), F.lit(None).cast("string"), F.lit("other")), (F.col("p_partkey") % 4).cast("int"))
    pairs = neighbours(table(spark, sf_dir, "part"), "p_partkey", "p_name").withColumn("how", how)
    scored = evaluate.dispatch(pairs, {"near": Levenshtein(), "same": ExactMatch()}, "how")
    return scored.select("p_partkey", rounded(F.col("score")).alias("score"), "error")


@query("""
SELECT d.doc_id, round(CASE WHEN s = 0 AND q = 0 THEN 1 ELSE 1 - abs(q - s) / nullif(abs(q) + abs(s), 0) END, 6) AS score
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE (doc_id % 11) / 10.0 END::DOUBLE AS s, quality::DOUBLE AS q FROM labels) d""")
def eval_meta_score(spark, sf_dir):
    """Judged scores, some failed, against quality labels."""
    rows = table(spark, sf_dir, "labels").withColumn("judged", F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 11) / 10.0))
    return rows.select("doc_id", rounded(evaluate.meta_score(F.col("judged"), F.col("quality").cast("double"))).alias("score"))


@query("""
SELECT p_brand, p_type, round(avg(s), 6) AS mean, count(s) AS scored, CAST(sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped
FROM (SELECT a.p_brand, a.p_type, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS s FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1)
GROUP BY ROLLUP (p_brand, p_type)""")
def score_report_rollup(spark, sf_dir):
    """Mean name similarity with subtotals; the last part has no neighbour and is skipped."""
    part = table(spark, sf_dir, "part")
    following = part.select((F.col("p_partkey") - 1).alias("_next"), F.col("p_name").alias("expected"))
    scored = Levenshtein(output="p_name").transform(part.join(following, F.col("p_partkey") == F.col("_next"), "left"))
    out = evaluate.report(scored.withColumn("score", F.col("Levenshtein.score")), ["p_brand", "p_type"])
    return out.withColumn("mean", rounded(F.col("mean")))


@query("""
SELECT p_brand, p_partkey, place, round(s, 6) AS score FROM (
  SELECT p_brand, p_partkey, s, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY round(s, 9), p_partkey) AS INTEGER) AS place FROM (
    SELECT a.p_brand, a.p_partkey, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS s FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1))
WHERE place <= 3""")
def score_top_k(spark, sf_dir):
    """The three least similar neighbours of each brand."""
    scored = Levenshtein().transform(neighbours(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand")).withColumn("score", F.round("Levenshtein.score", 9))
    return evaluate.lowest(scored, ["p_brand"], ["p_partkey"], 3).select("p_brand", "p_partkey", "place", rounded(F.col("score")).alias("score"))


@query("""
SELECT 'Levenshtein' AS name, a.p_partkey, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
UNION ALL
SELECT 'ExactMatch', a.p_partkey, CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 0.0 END FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def evaluate_many(spark, sf_dir):
    """Two scorers in one pass, in long form."""
    scored = evaluate.evaluate(neighbours(table(spark, sf_dir, "part"), "p_partkey", "p_name"), [Levenshtein(), ExactMatch()])
    long = evaluate.long_form(scored, ["Levenshtein", "ExactMatch"], ["p_partkey"])
    return long.select("name", "p_partkey", rounded(F.col("score")).alias("score"))


_NAMES_AND_TYPES = """
SELECT a.p_partkey, a.p_brand, CASE WHEN a.p_partkey % 10 > 0 THEN 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) END AS before,
  1 - levenshtein(a.p_type, b.p_type) / greatest(length(a.p_type), length(b.p_type)) AS after
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""


@query(f"""
WITH gaps AS (SELECT p_partkey, p_brand, after - before AS d FROM ({_NAMES_AND_TYPES})),
drawn AS (SELECT p_brand, d, r, CAST('0x' || substr(md5(p_partkey || chr(31) || (r // 4)), 1 + 8 * (r % 4), 8) AS BIGINT) AS u FROM gaps, range(40) t(r) WHERE d IS NOT NULL),
weighed AS (SELECT p_brand, d, r, (SELECT count(*) FROM (SELECT sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS c FROM range(12) s(k)) WHERE u >= floor(c * 4294967296)) AS w FROM drawn),
means AS (SELECT p_brand, r, sum(w * d) / nullif(sum(w), 0) AS m FROM weighed GROUP BY p_brand, r),
ends AS (SELECT p_brand, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY p_brand)
SELECT g.p_brand, count(d) AS pairs, count(*) - count(d) AS unpaired, CAST(count(*) FILTER (d > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (d < 0) AS BIGINT) AS losses,
  round(avg(d), 6) AS mean, round(stddev_samp(d) / sqrt(count(d)), 6) AS error, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high
FROM gaps g LEFT JOIN ends e ON e.p_brand = g.p_brand GROUP BY g.p_brand""")
def experiment_compare(spark, sf_dir):
    """Similarity of neighbouring parts' types against that of their names, which a tenth lacks, with bootstrap intervals."""
    part = table(spark, sf_dir, "part")
    names = Levenshtein().transform(neighbours(part, "p_partkey", "p_name", "p_brand")).where("p_partkey % 10 > 0")
    types = Levenshtein().transform(neighbours(part, "p_partkey", "p_type", "p_brand"))
    runs = [d.select("p_partkey", "p_brand", F.col("Levenshtein.score").alias("score")) for d in (names, types)]
    out = experiments.compare(experiments.paired(*runs, ["p_partkey", "p_brand"]), ["p_partkey"], ["p_brand"], 40)
    return out.select("p_brand", "pairs", "unpaired", "wins", "losses", *[rounded(F.col(c)).alias(c) for c in ("mean", "error", "low", "high")])


@query("""
WITH scored AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity = 0 AND l_discount = 0 THEN 1 ELSE 1 - abs(l_quantity / 50 - l_discount) / nullif(abs(l_quantity / 50) + abs(l_discount), 0) END::DOUBLE AS s FROM lineitem)
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping, count(s) AS scored, count(*) - count(s) AS skipped, round(avg(s), 6) AS mean, round(var_pop(s), 6) AS variance,
  round(min(s), 6) AS least, round(max(s), 6) AS most, list_sort(list(least(255, floor(s * 256)) / 256.0) FILTER (s IS NOT NULL))[CAST(ceil(count(s) / 2.0) AS BIGINT)]::DOUBLE AS median
FROM scored GROUP BY CUBE (l_returnflag, l_linestatus)""")
def score_summaries(spark, sf_dir):
    """Closeness of two shares of every line item: kept by ship month, merged, and told by all grouping sets."""
    lines = table(spark, sf_dir, "lineitem").withColumn("score", scalar.numeric_score(F.col("l_quantity") / 50, F.col("l_discount")))
    monthly = summaries.summary(lines.withColumn("month", F.trunc("l_shipdate", "month")), ["month", "l_returnflag", "l_linestatus"])
    out = summaries.told(monthly, ["l_returnflag", "l_linestatus"])
    kept = ["l_returnflag", "l_linestatus", F.col("grouping").cast("long").alias("grouping"), "scored", "skipped", "median"]
    return out.select(*kept, *[rounded(F.col(c)).alias(c) for c in ("mean", "variance", "least", "most")])


_WINDOWS = """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, round(avg(CASE WHEN value = 0 THEN 0 ELSE 1 - abs(50 - value) / (50 + abs(value)) END), 6) AS score, count(*) AS n
FROM events GROUP BY 1"""


@query(_WINDOWS)
def score_batch_window(spark, sf_dir):
    """Daily mean closeness of event values to 50."""
    scored = table(spark, sf_dir, "events").withColumn("s", scalar.numeric_score(F.col("value"), F.lit(50.0)))
    return windowed_scores(scored, "s").select(F.col("start").cast("timestamp_ntz").alias("start"), rounded(F.col("score")).alias("score"), "n")


@query(_WINDOWS)
def score_stream_window(spark, sf_dir):
    """The same over a stream of the events' files, run until all that is there is read."""
    path = f"{sf_dir}/events.parquet"
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"
    out = f"{base}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    scored = windowed_scores(stream.withColumn("s", scalar.numeric_score(F.col("value"), F.lit(50.0))), "s")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    run = scored.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    done = spark.read.parquet(f"{out}/result")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), rounded(F.col("score")).alias("score"), "n")



def _streamed(spark, sf_dir) -> tuple[DataFrame, str]:
    """The events' files as a stream with the closeness of each value to 50, and a new shared folder for its run."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")  # a pattern, since a stream takes no file by name
    return stream.withColumn("s", scalar.numeric_score(F.col("value"), F.lit(50.0))), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _plain_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_SCORED = "SELECT *, CASE WHEN value = 0 THEN 0 ELSE 1 - abs(50 - value) / (50 + abs(value)) END AS s FROM events"


@query(f"""
WITH e AS ({_SCORED}), w AS (SELECT *, unnest(range(0, 4)) AS k FROM e),
  g AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start, event_type, round(avg(s), 6) AS score, count(*) AS n FROM w GROUP BY 1, 2)
SELECT * FROM g WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""")
def score_stream_sliding(spark, sf_dir):
    """Mean closeness by type of event over days that begin every six hours, as a stream tells it once they are over."""
    stream, folder = _streamed(spark, sf_dir)
    told = settle(windowed_scores(stream, "s", late="12 hours", by=("event_type",), slide="6 hours"), folder)
    return _plain_times(told, "start").withColumn("score", rounded(F.col("score")))


@query(f"""
WITH e AS ({_SCORED}), b AS (SELECT *, ts > coalesce(lag(ts) OVER u + INTERVAL 5 HOUR, '-infinity'::TIMESTAMP) AS fresh FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM b),
  g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5 HOUR AS "end", round(avg(s), 6) AS score, count(s) AS n, count(*) AS rows FROM n GROUP BY user_id, session)
SELECT * FROM g WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""")
def score_stream_sessions(spark, sf_dir):
    """Users' sessions, which end after five hours without an event, as a stream tells them once they are over."""
    stream, folder = _streamed(spark, sf_dir)
    told = settle(session_scores(stream, "s", ("user_id",), "5 hours", late="12 hours"), folder)
    return _plain_times(told, "start", "end").withColumn("score", rounded(F.col("score")))


@query("SELECT DISTINCT event_type, props FROM events")
def judge_requests_once(spark, sf_dir):
    """Requests that come again in the stream aren't sent again: types and properties of events, each once."""
    stream, folder = _streamed(spark, sf_dir)
    return settle(once(stream, ["event_type", "props"], late="90 days").select("event_type", "props"), folder)


@query(f"""
WITH e AS ({_SCORED}), w AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(s) AS n, sum(s) AS total FROM e GROUP BY 1, 2),
  c AS (SELECT * FROM w WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR),
  p AS (SELECT *, total / n AS score, sum(total) OVER earlier / sum(n) OVER earlier AS baseline FROM c
        WINDOW earlier AS (PARTITION BY event_type ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, sum(coalesce(score - baseline - 0.01, 0)) OVER t AS up, sum(coalesce(baseline - score - 0.01, 0)) OVER t AS down FROM p WINDOW t AS (PARTITION BY event_type ORDER BY start))
SELECT event_type, start, false AS silent, n, round(score, 6) AS score, round(baseline, 6) AS baseline,
  round(up - min(up) OVER t, 6) AS above, round(down - min(down) OVER t, 6) AS below FROM s WINDOW t AS (PARTITION BY event_type ORDER BY start)""")
def score_stream_drift(spark, sf_dir):
    """Drift of each type's daily mean closeness; in SQL, sums that start anew at 0 are running sums less their lowest."""
    stream, folder = _streamed(spark, sf_dir)
    days = settle(windowed_scores(stream, "s", late="12 hours", by=("event_type",)), f"{folder}/days")
    kept = spark.readStream.schema(days.schema).parquet(f"{folder}/days/rows")
    told = settle(drift(kept, "event_type"), f"{folder}/drift")
    return _plain_times(told, "start").withColumns({c: rounded(F.col(c)) for c in ("score", "baseline", "above", "below")})
