"""The response table: pruned lookups, first answers, compaction, and what a killed run keeps."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scoreframe.sources.providers import FunctionProvider, answer_all, compact, stored


def noting(folder: str, fatal: str = "") -> FunctionProvider:
    """Notes every request in a folder, and ends its worker at the one that is fatal."""

    def answer(request: str) -> str:
        if request == fatal:
            os._exit(1)
        with open(f"{folder}/{request}", "a") as f:
            f.write(".")
        return f"to {request}"

    return FunctionProvider(answer)


def requests(spark, numbers):
    rows = spark.createDataFrame([(f"r{i}",) for i in numbers], "request string")
    return rows.select(F.sha2("request", 256).alias("request_key"), "request")


def test_only_asked_parts_are_read(spark, tmp_path):
    table = str(tmp_path / "t")
    assert stored(requests(spark, [1]), table).count() == 0
    got = answer_all(requests(spark, range(40)), FunctionProvider(lambda r: f"to {r}"), table)
    assert got.count() == 40
    one = stored(requests(spark, [3]), table)
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan or "PartitionFilters: [part" in plan
    assert [r.response for r in one.collect()] == ["to r3"]
    read = one.inputFiles()
    assert 0 < len(read) < 40


def test_answers_are_given_once_and_the_first_counts(spark, tmp_path):
    table, notes = str(tmp_path / "t"), tmp_path / "notes"
    notes.mkdir()
    answer_all(requests(spark, [1, 2, 2]), noting(str(notes)), table)
    before = len(list(Path(table).glob("batch=*")))
    again = answer_all(requests(spark, [1, 2]), noting(str(notes)), table)
    assert len(list(Path(table).glob("batch=*"))) == before == 1
    assert {p.name: p.read_text() for p in notes.iterdir()} == {"r1": ".", "r2": "."} and again.count() == 2
    late = requests(spark, [1]).withColumns({"response": F.lit("a later answer"), "error": F.lit(None).cast("string"), "at": F.lit(2**62)})
    late.drop("request").withColumn("part", F.concat(F.lit("p"), F.substring("request_key", 1, 1))).write.partitionBy("part").parquet(f"{table}/batch=late")
    assert stored(requests(spark, [1]), table).first().response == "to r1"
    compact(spark, table, f"{table}-compact")
    assert sorted(r.response for r in stored(requests(spark, [1, 2]), f"{table}-compact").collect()) == ["to r1", "to r2"]
    assert len(list(Path(f"{table}-compact").glob("batch=*/part=*/*.parquet"))) <= 2


def test_a_killed_run_keeps_what_it_had(spark, tmp_path):
    table, notes = str(tmp_path / "t"), tmp_path / "notes"
    notes.mkdir()
    asked = requests(spark, range(30))
    with pytest.raises(Exception):  # noqa: B017  the worker is gone
        answer_all(asked, noting(str(notes), fatal="r29"), table, partitions=8)
    kept = {r.response.removeprefix("to ") for r in stored(asked, table).collect()}
    assert answer_all(asked, noting(str(notes)), table, partitions=8).count() == 30
    assert all((notes / name).read_text() == "." for name in kept)
