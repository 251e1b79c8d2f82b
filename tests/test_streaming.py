"""Streams in several batches, each of which starts anew from the checkpoint: late, repeated and unordered rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreframe.streaming import windowed_scores
from scoreframe.streaming.monitor import drift, once, session_scores, settle

DAY = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, k string, s double"


def hour(h):
    return DAY + timedelta(hours=h)


def told(spark, folder, batches, make, schema=SCHEMA, settled=settle):
    """What a stream has told after the batches, each of which is a run of its own over the same folder."""
    out = None
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/batch={n}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/batch=*")
        out = settled(make(stream), f"{folder}/out")
    return sorted(tuple(r) for r in out.collect())


def test_sliding_windows_are_told_once_and_late_rows_dropped(spark, tmp_path):
    first = [(hour(30), "a", 1.0), (hour(1), "a", 0.5), (hour(7), "a", 0.0), (hour(13), "b", None)]
    late = [(hour(2), "a", 0.0), (hour(25), "a", 0.0)]  # the windows of the first are told by now, those of the second aren't
    end = [(hour(200), "a", 1.0)]
    make = lambda s: windowed_scores(s, "s", window="12 hours", slide="6 hours", late="6 hours", by=("k",))
    got = told(spark, str(tmp_path), [first, late, end], make)
    assert got == [
        (hour(-6), "a", 0.5, 1), (hour(0), "a", 0.25, 2), (hour(6), "a", 0.0, 1), (hour(6), "b", None, 0), (hour(12), "b", None, 0),
        (hour(18), "a", 0.0, 1), (hour(24), "a", 0.5, 2), (hour(30), "a", 1.0, 1),
    ]


def brute_sessions(rows, gap):
    out = []
    for k in {r[1] for r in rows}:
        run = []
        for r in [*sorted(r for r in rows if r[1] == k), None]:
            if run and (r is None or r[0] > run[-1][0] + gap):
                scores = [x[2] for x in run if x[2] is not None]
                out.append((k, run[0][0], run[-1][0] + gap, round(sum(scores) / len(scores), 9) if scores else None, len(scores), len(run)))
                run = []
            run.append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_do_not_depend_on_batches(spark, tmp_path, seed):
    dice = random.Random(seed)
    rows = [(DAY + timedelta(seconds=dice.randrange(40 * 3600)), dice.choice("abc"), dice.choice([None, 0.25, 1.0])) for _ in range(60)]
    dealt = list(rows)
    dice.shuffle(dealt)  # out of order, by less than what counts as late
    batches = [dealt[:20], dealt[20:35], dealt[35:], [(hour(500), "z", 1.0)]]
    got = told(spark, str(tmp_path), batches, lambda s: session_scores(s, "s", ("k",), "2 hours", late="48 hours"))
    assert sorted((k, a, b, None if v is None else round(v, 9), n, m) for k, a, b, v, n, m in got) == sorted(brute_sessions(rows, timedelta(hours=2)), key=lambda r: r[:2])


def test_requests_are_told_once(spark, tmp_path):
    batches = [[(hour(1), "a", 0.0), (hour(1), "a", 0.0), (hour(2), "b", 0.0)], [(hour(3), "a", 0.0), (None, "c", 0.0)], [(hour(90), "d", 0.0)], [(hour(91), "a", 0.0)]]
    got = told(spark, str(tmp_path), batches, lambda s: once(s, ["k"], late="1 day").select("k"))
    assert [k for (k,) in got] == ["a", "a", "b", "c", "d"]  # a again after it is forgotten


def brute_drift(days, slack):
    n = total = above = below = 0
    out = []
    for start, score, count in sorted(days):
        base = total / n if n else None
        if n:
            above, below = max(0, above + score - base - slack), max(0, below + base - score - slack)
        out.append((start, False, count, score, base, above, below))
        n, total = n + count, total + score * count
    return out


def test_drift_and_silence(spark, tmp_path):
    schema = "start timestamp, k string, score double, n long"
    a = [(hour(24 * d), "a", 0.5 + 0.05 * (d > 3), 4) for d in range(12)]
    b = [(hour(24 * d), "b", 0.5, 2) for d in range(3)]
    none = [(hour(24), "a", None, 0), (None, "a", 0.5, 1)]
    batches = [[*reversed(a[:2]), *b[:2], *none], [*a[2:5], *b[2:]], a[5:9], a[9:]]
    got = told(spark, str(tmp_path), batches, lambda s: drift(s, "k", silence="5 days"), schema)
    plain = [r[1:] for r in got if r[0] == "a"]
    wanted = brute_drift([(t, s, n) for t, _, s, n in a], 0.01)
    assert [r[:3] for r in plain] == [r[:3] for r in wanted]
    assert all(x == pytest.approx(y) for r, w in zip(plain, wanted, strict=True) for x, y in zip(r[3:], w[3:], strict=True))
    assert plain[-1][5] > 0.1 and plain[-1][6] == 0
    silent = [r for r in got if r[0] == "b" and r[2]]
    assert silent == [("b", hour(48), True, None, None, None, None, None)] and sum(r[0] == "b" for r in got) == 4


def test_names_that_clash_and_an_empty_stream(spark, tmp_path):
    schema = "ts timestamp, _at string, s double"
    got = told(spark, str(tmp_path / "a"), [[]], lambda s: windowed_scores(s, "s", by=("_at",)), schema)
    assert got == []
    got = told(spark, str(tmp_path / "b"), [[(hour(1), "x", 1.0)], [(hour(99), "x", 1.0)]], lambda s: session_scores(s, "s", ("_at",), "1 hour", late="1 hour"), schema)
    assert got == [("x", hour(1), hour(2), 1.0, 1, 1)]
    kept = spark.createDataFrame([(hour(1), "k", 1.0, 1)], "start timestamp, _micros string, score double, n long").withColumn("_at", F.lit(1))
    kept.write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(kept.schema).parquet(str(tmp_path / "c"))
    assert [r[0] for r in settle(drift(stream, "_micros"), str(tmp_path / "d")).collect()] == ["k"]
