"""JSON difference tables: pairs within a row against joined ones, what moves between tasks, and means to the last bit."""

import json

import pytest
from test_deep import texts_of

from scoreframe import catalog
from scoreframe.plans.jsondiff import difference_table


def scores(df, **options):
    return {r.id: None if r.score is None or r.score != r.score else r.score for r in difference_table(df, ["id"], "o", "e", **options).collect()}


@pytest.mark.parametrize("preserve", [False, True])
def test_within_a_row_as_joined(spark, preserve):
    df = spark.createDataFrame(texts_of(150, 11), "id long, o string, e string").repartition(3)
    within, joined, both = (scores(df, preserve_strings=preserve, in_row=n) for n in (10**6, -1, 40))
    assert within == pytest.approx(joined, abs=1e-12)
    assert within == pytest.approx(both, abs=1e-12)


def test_long_texts_are_joined(spark):
    long = [json.dumps({"a": ["x" * 50] * 100, "b": {"c": list(range(300)), "d": [{"e": last}]}}) for last in ("y", "z")]
    df = spark.createDataFrame([(1, *long), (2, long[0], long[0]), (3, long[0], None), (4, "[1]", "[2]")], "id long, o string, e string")
    assert scores(df) == pytest.approx({1: 0.75, 2: 1.0, 3: 0.0, 4: 2 / 3})


def test_short_texts_stay_in_their_row(spark):
    df = catalog.QUERIES["json_difference_table"](spark, "/root/testdata/sf0.001")
    assert len(df.collect()) > 500
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    final = plan.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    assert final.count("Exchange") <= 3 and "FullOuter" not in final and "Generate" not in final


def test_means_of_means_to_the_last_bit(spark):
    side = lambda k: json.dumps({"kind": "x", "tags": ["x", "x"], "inner": {"k": k}})
    df = spark.createDataFrame([(k, side(k), side(128 - k)) for k in range(1, 128)], "id long, o string, e string")
    assert scores(df) == {k: (1 + (1 + 1) / 2 + (1 - abs(128 - 2 * k) / 128) / 1) / 3 for k in range(1, 128)}


def test_odd_texts_within_a_row(spark):
    deep = '{"a": ' * 400 + "%s" + "}" * 400
    rows = [(1, '"\\ud800a"', '"\\ud801a"'), (2, '{"\\ud800": 1}', '{"\\ud800": 1}'), (3, deep % 1, deep % 3), (4, "[[], {}, [[]]]", "[[], {}, [[1]]]"), (5, "[1, 2, null]", "[1]"), (6, "Infinity", "Infinity"), (7, "true", "1.0")]
    df = spark.createDataFrame(rows, "id long, o string, e string")
    assert scores(df, in_row=10**5) == pytest.approx({1: 0.5, 2: 1.0, 3: 0.5, 4: 2 / 3, 5: 1 / 3, 6: 1.0, 7: 1.0})


@pytest.mark.parametrize("in_row", [-1, 4096])
def test_keys_a_microsecond_apart(spark, in_row):
    df = spark.sql("SELECT timestamp_micros(i) AS at, '[1, 1]' AS o, '[1, 3]' AS e FROM VALUES (1), (2), (2) AS t(i)")
    got = difference_table(df, ["at"], "o", "e", in_row=in_row).collect()
    assert sorted((r["at"].microsecond, r.score) for r in got) == [(1, 0.75), (2, 0.75)]
