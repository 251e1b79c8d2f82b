"""Incremental runs, paired comparison and summaries that merge, against plain Python."""

import hashlib
import math
import random
from statistics import mean, pvariance, stdev

import pytest
from pyspark.sql import functions as F

from scoreframe.operators.scorers import ExactMatch, Levenshtein, python_scorer
from scoreframe.plans.experiments import compare, paired, score_changed, version_of
from scoreframe.plans.summaries import BINS, merge, summary, told
from scoreframe.sources.providers import _batches


def kept(spark, table):
    return _batches(spark, table).count()


def test_only_changed_rows_are_scored(spark, tmp_path):
    table = str(tmp_path / "scores")
    rows = [(1, "ab", "abc"), (2, "ab", "abc"), (3, None, "x"), (4, "", "")]
    df = spark.createDataFrame(rows, "id int, output string, expected string")
    first = score_changed(df, Levenshtein(), table)
    assert first.columns == ["id", "output", "expected", "Levenshtein"]
    want = {r.id: r.Levenshtein for r in Levenshtein().transform(df).collect()}
    assert {r.id: r.Levenshtein.score for r in first.collect()} == {k: v and v.score for k, v in want.items()}
    assert kept(spark, table) == 3  # two rows of one content
    score_changed(df, Levenshtein(), table).collect()
    assert kept(spark, table) == 3  # a rerun scores nothing
    more = df.where("id > 1").union(spark.createDataFrame([(5, "new", "now")], df.schema))
    assert score_changed(more, Levenshtein(), table).count() == 4 and kept(spark, table) == 4
    score_changed(df, Levenshtein(), table, version="2").count()
    score_changed(df, ExactMatch(), table).count()
    assert kept(spark, table) == 10  # another version, another scorer
    assert score_changed(df.limit(0), Levenshtein(), table).count() == 0


def test_clashing_columns_and_null_are_kept_apart(spark, tmp_path):
    df = spark.createDataFrame([("a", "a", 7, 8), ("null", None, 7, 8)], "output string, expected string, _key int, _kept int")
    got = score_changed(df, Levenshtein(), str(tmp_path / "s")).collect()
    assert [(r._key, r._kept) for r in got] == [(7, 8)] * 2
    assert {r.output: r.Levenshtein.score for r in got} == {"a": 1.0, "null": None}


def test_functions_ask_for_a_version():
    scorer = python_scorer("mine", lambda o, e: 1.0)
    with pytest.raises(ValueError, match="version"):
        version_of(scorer)
    assert version_of(scorer, "1") != version_of(scorer, "2")


def poisson(key: str, replicates: int) -> list[int]:
    out = []
    for block in range(-(-replicates // 4)):
        digest = hashlib.md5(f"{key}\x1f{block}".encode()).hexdigest()
        for i in range(4):
            u, total, k = int(digest[8 * i : 8 * i + 8], 16), 0.0, 0
            while k < 12 and u >= int((total := total + math.exp(-1) / math.factorial(k)) * 2**32):
                k += 1
            out.append(k)
    return out[:replicates]


def test_comparison_by_force(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else "cold", rng.choice([None, 0.0, 0.25, 0.5]) if i % 7 == 0 else rng.randrange(9) / 8, rng.randrange(9) / 8) for i in range(300)]
    rows += [(300, "alone", None, 0.5), (301, "one", 0.5, 0.75), (302, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "id int, g string, before double, after double").repartition(5)
    got = {r.g: r for r in compare(df, ["id"], ["g"], replicates=30).collect()}
    assert set(got) == {"hot", "cold", "alone", "one", None}
    for g, r in got.items():
        mine = [(i, a - b) for i, h, b, a in rows if h == g and None not in (a, b)]
        gaps = [d for _, d in mine]
        assert (r.pairs, r.unpaired) == (len(mine), sum(h == g for _, h, _, _ in rows) - len(mine))
        assert (r.wins, r.losses, r.ties) == (sum(d > 0 for d in gaps), sum(d < 0 for d in gaps), sum(d == 0 for d in gaps))
        if not mine:
            assert r.mean is None and r.low is None
            continue
        assert r.mean == pytest.approx(mean(gaps)) and (r.error == pytest.approx(stdev(gaps) / len(gaps) ** 0.5) if len(gaps) > 1 else not r.error)
        weights = [poisson(str(i), 30) for i, _ in mine]
        means = sorted(sum(w[k] * d for w, d in zip(weights, gaps, strict=True)) / s for k in range(30) if (s := sum(w[k] for w in weights)))
        place = 0.025 * (len(means) - 1)
        assert r.low == pytest.approx(means[int(place)] + (place % 1) * (means[min(int(place) + 1, len(means) - 1)] - means[int(place)]))
        assert r.low <= r.high
    assert compare(df.limit(0), ["id"], ["g"]).count() == 0


def test_pairs_keep_rows_of_one_run(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id int, score double")
    b = spark.createDataFrame([(2, 1.0), (3, 1.0)], "id int, score double")
    assert sorted(map(tuple, paired(a, b, ["id"]).collect())) == [(1, 0.5, None), (2, 0.5, 1.0), (3, None, 1.0)]


def test_merged_summaries_equal_direct_ones(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice([None, float("nan"), 0.0, 1.0, rng.random()]), rng.randrange(40), i % 4) for i in range(800)]
    rows.append(("c", "x", None, 1, 0))
    df = spark.createDataFrame(rows, "g string, h string, score double, item int, day int")
    shards = summary(df, ["day", "g", "h"], items="item")
    got = {(r.grouping, r.g, r.h): r for r in told(merge(shards, ["g", "h"]), ["g", "h"], {"p10": 0.1, "median": 0.5}).collect()}
    keys = {(0, r[0], r[1]) for r in rows} | {(1, r[0], None) for r in rows} | {(2, None, r[1]) for r in rows} | {(3, None, None)}
    assert set(got) == keys
    for (level, g, h), r in got.items():
        mine = [x for x in rows if (level & 2 or x[0] == g) and (level & 1 or x[1] == h)]
        values = sorted(x[2] for x in mine if x[2] is not None and x[2] == x[2])
        assert (r.scored, r.skipped) == (len(values), len(mine) - len(values))
        assert abs(r.distinct - len({x[3] for x in mine})) <= 2
        if not values:
            assert r.mean is None and r.median is None
            continue
        assert (r["mean"], r.variance, r.least, r.most) == pytest.approx((mean(values), pvariance(values), values[0], values[-1]))
        for q, told_ in ((0.1, r.p10), (0.5, r.median)):
            true = values[math.ceil(q * len(values)) - 1]
            assert 0 <= true - told_ <= 1 / BINS
    assert told(summary(df.limit(0), ["g"]), ["g"]).count() == 0
