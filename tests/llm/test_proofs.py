"""Benchmark decontamination, Merkle manifests and whitening, against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from oracle import assert_agrees
from pyspark.sql import functions as F

from scoreframe.llm import decontaminate, merkle, registry, whitening
from scoreframe.llm.texthash import run_hashes, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_merkle_manifest"])
def test_agrees_with_sql(spark, name):
    assert_agrees(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


# --- decontamination


def words_of(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def hits_by_force(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(item)
    lengths, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[g]
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def check_hits(spark, docs, items, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        clash = {c: F.lit("x") for c in ("key", "found", "hash", "w", "n_words")}
        d, i = d.withColumns(clash), i.withColumns(clash | {"window": F.lit(1), "item": F.lit(2)})
    found, lists = decontaminate.find(d.repartition(3), i)
    by_key = {r.items_key: r["items"] for r in lists.collect()}
    got = []
    for r in found.collect():
        spans = [tuple(s) for s in r.spans]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        got.append((r.doc_id, r.n_words, sum(b - a for a, b in spans), by_key[r.items_key] if r.items_key else []))
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(hits_by_force(docs, items))
    return got


def test_hits_of_random_texts(spark):
    """Few words, so that windows overlap, repeat and nearly match; items of all lengths from none to thirty words."""
    rng = random.Random(5)
    some = lambda n, m=3: " ".join(rng.choice("abcdefg"[:m]) for _ in range(n))
    items = [(i, some(n, 7)) for i, n in enumerate([*range(0, 31), 12, 12, 10, 10])] + [(3, some(14)), (40, "Über, x-1; y2!"), (41, "ein Ä b")]
    docs = []
    for i in range(60):
        parts = [some(rng.randrange(12), 7)]
        for _ in range(rng.randrange(4)):
            w = words_of(rng.choice(items)[1])
            at = rng.randrange(len(w) + 1)
            parts += [" ".join(w[at : at + rng.randrange(18)]), some(rng.randrange(6), 7)]
        docs.append((i, rng.choice([" ", ", ", "\n", "-"]).join(" ".join(parts).split(" "))))
    docs += [(90, "UBER über X 1 Y2 ein ä B"), (91, "ein Äb"), (92, "über-x/1;Y2")]
    check_hits(spark, docs, items)


def test_hits_of_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None), (2, ""), (3, " .,- "), (None, passage), (None, passage), (5, passage.upper()), (5, "other " + passage[:40]), (6, "w1 " * 20_000 + passage), (7, "x" * 300_000), (8, "tiny")]
    items = [(1, passage), (2, passage[7:90]), (2, "tiny"), (None, passage[100:]), (4, None), (5, ""), (6, "!?"), (None, "tiny")]
    got = check_hits(spark, docs, items, extra=True)
    assert sum(r[2] == 60 for r in got) == 4
    check_hits(spark, docs, [(None, "only without an id w1 w2"), (None, "tiny")])
    check_hits(spark, docs, [(4, None)])
    check_hits(spark, docs, [])
    check_hits(spark, [], items)


def test_hot_passage(spark):
    """One passage in half of all documents and items; the answer has a row for each document, pairs are never made."""
    passage = " ".join(f"p{i}" for i in range(55))
    items = [(i, f"item{i} {passage} end{i}" if i % 2 else f"alone {i} " * 6) for i in range(60)]
    docs = [(i, f"doc{i} {passage} rest{i}" if i % 2 else f"clean {i} text") for i in range(300)]
    got = check_hits(spark, docs, items)
    assert sum(r[2] == 55 and len(r[3]) == 30 for r in got) == 150


def test_filter_only_prunes(spark):
    """A filter that lets everything through gives the same fingerprints after the join."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = decontaminate.window_fingerprints(decontaminate.item_windows(spark.read.parquet(f"{SF}/benchmark.parquet")))
    bits = decontaminate.bitmap(known)
    count = lambda filled: decontaminate.candidates(docs, [10], filled).select(F.explode("found.hash").alias("hash")).join(known, "hash", "left_semi").count()
    assert count(bits) == count(np.full(1024, 2**64 - 1, np.uint64)) > 0


@pytest.mark.parametrize("length", [1, 3, 5, 6, 9, 10])
def test_winnowing_guarantee(length):
    """Every window of a text holds a fingerprint that the window alone has too."""
    rng = random.Random(length)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))).encode() for _ in range(50)]

    def prints(texts):
        data, doc, start, end = tokens(texts, decontaminate.CLASSES)
        return doc, decontaminate.winnow(doc, run_hashes(data, start, end), length)

    doc, (first, value) = prints(texts)
    begin = np.searchsorted(doc, np.arange(len(texts)))
    for d, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - length + 1):
            alone = set(prints([b" ".join(w[p : p + length])])[1][1].tolist())
            here = (first >= begin[d] + p) & (first < begin[d] + p + length)
            assert len(alone) == 1 and alone <= set(value[here].tolist())


# --- Merkle manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_by_force(rows, arity):
    """(doc_id, leaf, subroot, root, siblings) of (doc_id, source, lang, n_chars, text)."""

    def tree(nodes):
        paths, at, here = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(here) > 1:
            for i, p in enumerate(paths):
                run = at[i] - at[i] % arity
                p.append(("".join(here[run : at[i]]), "".join(here[at[i] + 1 : run + arity])))
            here, at = [sha("".join(here[i : i + arity])) for i in range(0, len(here), arity)], [a // arity for a in at]
        return here[0], paths

    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    root, crown = tree([t[0] for t in trees])
    out = []
    for name, (subroot, paths), above in zip(names, trees, crown, strict=True):
        for x, path in zip(sorted(groups[name], key=lambda x: x[:3]), paths, strict=True):
            altered = x[3][:4] + (x[3][4].replace("\n", "") if x[3][4] is not None else None,)
            start = leaf(altered) if x[3][0] is not None and zlib.crc32(str(x[3][0]).encode()) % 2 == 0 else x[2]
            for left, right in path + above:
                start = sha(left + start + right)
            out.append((x[3][0], x[2], subroot, root, sha("".join(a + b for a, b in path + above)), start, start == root))
    return out


@pytest.fixture
def manifest_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice(["s", "t", "é", "Z", None, ""]), "en", i * 3, rng.choice(["a\nb", "no end", "", None, "ü\n\n"])) for i in range(70)]
    rows += [(200 + i, "hot", None, None, f"{i}\n") for i in range(83)] + [(500, f"alone{i}", "en", 1, "x\n") for i in range(11)]
    return [*rows, (None, "s", None, None, None), (None, "s", None, None, "y"), (7, "s", "en", 21, "a"), (7, "s", "en", 21, "a"), (-4, "hot", "en", 2, "w\n" * 50_000)]


def run_manifest(spark, rows, tmp_path, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    if extra:
        docs = docs.withColumns({c: F.lit("x") for c in ("key", "idx", "h", "leaf", "left", "path")})
    docs.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_manifest(spark, manifest_rows, tmp_path):
    want = sorted(manifest_by_force(manifest_rows, 3), key=str)
    assert run_manifest(spark, manifest_rows, tmp_path, extra=True) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(2, "a", "en", 1, "x"), (4, "b", "en", 1, "\n")], [(i, "a", "en", 1, "x\n") for i in range(3)], [(i, "a", "en", 1, "x\n") for i in range(4)]])
def test_small_manifests(spark, rows, tmp_path):
    assert run_manifest(spark, rows, tmp_path) == (sorted(manifest_by_force(rows, 3), key=str) if rows else [])


@pytest.mark.parametrize("arity", [2, 4])
def test_other_arities(spark, manifest_rows, arity):
    docs = spark.createDataFrame(manifest_rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = docs.select("doc_id", "source", merkle.leaf_of([F.col(c) for c in docs.columns]).alias("leaf"), F.lit(1).alias("key"))
    found, root = merkle.manifest(leaves, "source", ["doc_id", "leaf"], arity)
    got = found.select("doc_id", "leaf", "subroot", F.lit(root), merkle.proof_of(F.col("path")), merkle.fold(F.col("leaf"), F.col("path")) == root)
    want = [r[:5] + (True,) for r in manifest_by_force(manifest_rows, arity)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# --- whitening


def by_force(vectors, k=4):
    """(x, n, sums, variances and components by numpy, total variance) of the usable vectors."""
    rows = [tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted(set(rows)), np.int64)
    centred = fit - fit.mean(axis=0)
    values, columns = np.linalg.eigh(centred.T @ centred / len(fit))
    return rows, len(fit), fit.sum(axis=0), values[::-1][:k], columns[:, ::-1][:, :k].T, values.sum()


def write_vectors(spark, rows, path, more=()):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in more})
    frame.repartition(3).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return sorted(whitening.op13_whitening(spark, str(path)).collect(), key=str)


def check_whitening(got, rows, distinct_values=True):
    x, n, sums, values, columns, total = by_force([v for _, v in rows])
    ids = [i for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    real = int((values > 1e-9 * total).sum())
    assert len(got) == len(x) * real and {r.n for r in got} == {n}
    assert {r.component for r in got} == set(range(1, real + 1))
    exact = sorted((i is None, i or 0, sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in zip(ids, x, strict=True))
    assert exact == sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got if r.component == 1)
    assert max(r.identity_error for r in got) < 1e-10
    for c in range(real):
        mine = {}
        for r in got:
            if r.component == c + 1:
                mine.setdefault(r.vec_id, []).append(r.whitened)
                assert r.explained == pytest.approx(values[c] / total, rel=1e-9)
        if distinct_values:
            want = {}
            for i, v in zip(ids, x, strict=True):
                want.setdefault(i, []).append(float((np.array(v) - sums / n) @ columns[c] / np.sqrt(values[c])))
            first = max(want, key=lambda i: abs(want[i][0]) if len(want[i]) == 1 else 0)
            sign = np.sign(want[first][0] * mine[first][0])
            for i in want:
                assert np.allclose(sorted(sign * np.array(mine[i])), sorted(want[i]), atol=1e-8)


def test_whitening_of_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(whitening.op13_whitening(spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    some = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]).tolist()) for i in range(80)]
    odd = [(100, None), (101, [None] * 6), (102, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (103, [float("inf")] + [0.0] * 5), (104, [0.0] * 6), (104, [-0.0] * 6), (None, some[0][1]), (None, [1.5] * 6), (3, some[3][1])]
    check_whitening(write_vectors(spark, some + odd, tmp_path, ("x", "block", "n")), some + odd)


def test_whitening_leaves_out_other_lengths(spark, tmp_path):
    rows = [(i, [float(i % 5), float(i % 3), float(i)]) for i in range(12)]
    check_whitening(write_vectors(spark, rows + [(50, [1.0]), (51, []), (52, [1.0, 2.0])], tmp_path), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance(spark, rows, tmp_path):
    assert write_vectors(spark, rows, tmp_path) == []


def test_few_directions(spark, tmp_path):
    """Two directions in five dimensions, and fewer vectors than dimensions."""
    rows = [(i, [i * 1.0, i * 2.0, (i * i % 7) * 1.0, 0.0, 3.0]) for i in range(30)]
    check_whitening(write_vectors(spark, rows, tmp_path), rows)
    few = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [0.0, 1.0, 5.0, 2.0]), (3, [7.0, 0.0, 0.0, 0.0])]
    check_whitening(write_vectors(spark, few, tmp_path), few)


def test_equal_variances_are_found_as_often(spark, tmp_path):
    """The corners along each axis: five equal variances and three smaller equal ones."""
    rows = [(i, [float(s * size * (j == axis)) for j in range(8)]) for i, (axis, s, size) in enumerate((a, s, 3 if a < 5 else 1) for a in range(8) for s in (1, -1))]
    got = write_vectors(spark, rows, tmp_path)
    check_whitening(got, rows, distinct_values=False)
    assert {round(r.explained, 9) for r in got} == {round(9 / 48, 9)}


def test_deviation_beyond_doubles(spark, tmp_path):
    rows = [(i, [2.0**13 + i * 0.3, -(2.0**15) * i, 0.125]) for i in range(9)]
    got = write_vectors(spark, rows, tmp_path)
    x, n, sums, *_ = by_force([v for _, v in rows])
    want = {i: sum((Fraction(n * a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    assert {r.vec_id: r.deviation for r in got} == want and max(want.values()) > 2**53


def test_blocks_and_restarts_agree(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(40) * np.linspace(1, 6, 40)).tolist()) for i in range(300)]
    monkeypatch.setattr(whitening, "BLOCK", 7)
    check_whitening(write_vectors(spark, rows, tmp_path), rows)
    model, _ = whitening.fit(spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", whitening.whole(F.col("embedding")).alias("x")), 2)
    assert model.steps <= 40 and len(model.variances) == 2 and np.allclose(model.components @ model.components.T, np.eye(2), atol=1e-12)
