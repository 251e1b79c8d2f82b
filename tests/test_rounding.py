"""Halves in the seventh digit: the queries' rounding against SQL's, to the last bit."""

import duckdb

from scoreframe import catalog

#: (length of the needed line, length of the whole text): shares that are written with a 5 as their seventh and last digit.
HALVES = [(n, whole) for whole in (320, 640, 1280, 3200) for n in range(2, whole, 2) if n * 10**7 % whole == 0 and n * 10**7 // whole % 10 == 5]


def test_context_relevancy_of_halves(spark, tmp_path):
    texts = [(i, "a" * n + "\n" + "b" * (whole - n - 1)) for i, (n, whole) in enumerate(HALVES)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(catalog.ORACLES["rag_context_relevancy"]).fetchall())
    assert len(want) > 100
    assert {r.doc_id: r.score for r in catalog.QUERIES["rag_context_relevancy"](spark, str(tmp_path)).collect()} == want


def test_rounded(spark):
    values = [333 / 640, 0.0015625, 1 / 128, -1 / 128, 2 / 3, 0.0, 1.0, 123456.7890125, 1e300, float("inf"), None]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = dict(con.execute("SELECT i, round(v, 6) FROM t").fetchall())
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert {r.i: r.s for r in df.select("i", catalog.rounded(df.v).alias("s")).collect()} == want
