"""Arrays of JSON objects read by byte ranges, against the parser that reads a file whole."""

import json
import random

import pytest

from scoreframe.sources.files import read_json_array, write_json_array

KIND = "i long, s string, inner struct<a: array<struct<b: string>>, m: map<string, double>>"


@pytest.fixture
def cut(spark):
    """Byte ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(names, (str(n), "1", "1"), strict=True)]
    for k in names:
        spark.conf.unset(k)


def rows_of(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "ü", "a", "}]", '\\"', "漢"]) for _ in range(rng.randrange(12)))
    return [{"i": i, "s": rng.choice([None, text()]), "inner": {"a": [{"b": text()} for _ in range(rng.randrange(3))], "m": {text(): 1.5} if rng.random() < 0.5 else {}}} for i in range(n)]


def whole(spark, path):
    return sorted(map(str, spark.read.schema(KIND).option("multiLine", True).option("mode", "FAILFAST").json(path).collect()))


def ranged(spark, path):
    return sorted(map(str, read_json_array(spark, path, KIND).collect()))


@pytest.mark.parametrize("size, n, indent", [(1, 1, None), (2, 2, None), (7, 6, 1), (29, 12, None), (64, 40, 1), (257, 60, None), (10_000, 60, 1)])
def test_every_cut(spark, cut, tmp_path, size, n, indent):
    """Quotes, escapes and brackets in texts across cuts; ranges of a byte or two hold no object, of a few one at most."""
    (tmp_path / "a.json").write_text(json.dumps(rows_of(n, size), indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(" \n" + json.dumps(rows_of(n // 2, size + 99), indent=indent, separators=(" ,", ": ")) + "\n ")
    want = whole(spark, str(tmp_path))
    cut(size)
    assert ranged(spark, str(tmp_path)) == want and len(want) == n + n // 2


@pytest.mark.parametrize("text, n", [("[]", 0), (" [ \n ] ", 0), ("[{}]", 1), ("[ {} , {\"i\": 3} ]", 2)])
def test_small_arrays(spark, cut, tmp_path, text, n):
    (tmp_path / "a.json").write_text(text)
    for size in (1, 4, 1000):
        cut(size)
        assert len(ranged(spark, str(tmp_path))) == n


@pytest.mark.parametrize("text", ['[{"i": 1}', '{"i": 1}', '[{"i": 1} {"i": 2}]', '[{"i": 1},, {"i": 2}]', '[,{"i": 1}]', '[{"i": 1},]', "[1, 2]", '[{"i": 1}]}', '[{"i": 1}] x', '[{"i": 1}, 7, {"i": 2}]', '[{"i": 1}][{"i": 2}]', '[{"i": "x"}]', '[{"i": }]', "]", '[{"i": 1}}]'])
def test_malformed_files_fail(spark, cut, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    for size in (5, 1000):
        cut(size)
        with pytest.raises(Exception):  # noqa: B017  the driver's or a task's
            ranged(spark, str(tmp_path))


def test_one_file_gives_many_tasks(spark, cut, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(rows_of(900, 5)))
    want = whole(spark, str(tmp_path))
    cut(4096)
    assert read_json_array(spark, str(tmp_path), KIND).rdd.getNumPartitions() > 20
    assert ranged(spark, str(tmp_path)) == want


def test_compressed_and_sink(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else f'"{i}}}') for i in range(50)], "i long, s string")
    write_json_array(rows.repartition(3), f"{tmp_path}/out")
    write_json_array(rows.limit(0), f"{tmp_path}/none")
    for part in (tmp_path / "out").glob("part-*"):
        assert isinstance(json.loads(part.read_text()), list)
    got = read_json_array(spark, f"{tmp_path}/out", "i long, s string")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    assert read_json_array(spark, f"{tmp_path}/none", "i long, s string").count() == 0
    import gzip

    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.json.gz").write_bytes(gzip.compress(json.dumps(rows_of(30, 1)).encode()))
    assert ranged(spark, f"{tmp_path}/z") == whole(spark, f"{tmp_path}/z")
