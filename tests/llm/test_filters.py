"""Quality rules, classifiers and URL filter: SQL, held-out accuracy, brute force and odd rows."""

import math
import random
import re

import numpy as np
import pytest
from oracle import assert_agrees
from pyspark.sql import functions as F

from scoreframe.llm import quality_model, quality_rules, toxicity, url_filter, url_table
from scoreframe.llm.labelled import held_out

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, kept string, score string, _w string"  # columns of the caller that bear names used inside
ODD = [(1, None, "x", "y", "z"), (2, "", None, None, None), (3, " \n\t ", "x", "y", "z"), (3, " \n\t ", "x", "y", "z"), (None, "A word.", "x", "y", "z"), (5, "word " * 30_000, "x", "y", "z"), (6, "x" * 200_000, "x", "y", "z")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def slim(df):
    return df.select("doc_id", "text")


def test_quality_rules_agree(spark):
    assert_agrees(spark, quality_rules.op8_quality_rules, quality_rules.oracle(), SF)


def repeat_words(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)})


def test_repeated_words_by_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(80)]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = {x.doc_id: x.n_repeat_words for x in quality_rules.line_first(got).collect()}
    assert rows == {i: repeat_words(t.split()) for i, t in enumerate(texts)}


def test_quality_rules_odd_rows(spark, odd):
    rows = quality_rules.line_first(odd).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {"y", None} and {r["_w"] for r in rows} == {"z", None}
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].n_words == 0 and by_id[i].base_failed and not by_id[i].kept for i in (1, 2, 3))
    assert by_id[5].n_repeat_words == 30_000 and by_id[5].base_failed
    assert quality_rules.line_first(odd.limit(0)).count() == 0


def test_lines(spark):
    good = "This is a plain sentence of quite a few words, and it ends well."
    text = "\n".join([good, "Home | News | Sport | About", good, "We use cookies.", "BUY THIS NOW OR BE VERY SORRY!!"])
    row = quality_rules.line_first(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.cleaned == f"{good}\n{good}" and row.n_dup_lines == 1


def accuracy(spark, query):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return query(spark, SF).join(labels, "doc_id").where("held_out").toPandas()


def test_quality_model_held_out(spark):
    got = accuracy(spark, quality_model.op6_quality_model)
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (got[got.quality == 1].predicted == 1).mean() > 0.95
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.97


def test_toxicity_held_out(spark):
    got = accuracy(spark, toxicity.op7_toxicity)
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.95
    assert got[got.toxic == 1].score.mean() > 0.5


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"good text {i}" if i % 2 else f"bad idiotic text {i}") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    turned = turned.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    from scoreframe.llm.labelled import training_rows

    one, two = (quality_model.train(training_rows(docs, x, "quality", 100)) for x in (labels, turned))
    assert (one[0] == two[0]).all() and one[1] == two[1]
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, turned)


def test_classifiers_odd_rows(spark, odd):
    docs = slim(odd)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (5, None, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    from scoreframe.llm.labelled import training_rows

    model = quality_model.train(training_rows(docs, labels, "quality", 10))
    scores = [r.score for r in quality_model.score_quality(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    none = quality_model.train(training_rows(docs, labels.limit(0), "quality", 10))
    assert {r.score for r in quality_model.score_quality(docs, none).collect()} == {0.5}
    lexicon = toxicity.learn(docs, labels.limit(0))
    assert lexicon.weights == toxicity.GIVEN
    assert all(0 <= r.score < 0.5 for r in toxicity.score_toxicity(odd, lexicon).collect())
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0


def test_ftrl_by_force():
    """The updates coordinate by coordinate, in plain numbers."""
    r = random.Random(1)
    texts = [" ".join(r.choice("good fine bad awful plain".split()) for _ in range(12)) for _ in range(60)]
    labels = [int(t.count("good") + t.count("fine") >= t.count("bad") + t.count("awful")) for t in texts]
    doc, bucket, value = quality_model.features(texts)
    rows = [[(int(b), float(v)) for d, b, v in zip(doc, bucket, value, strict=True) if d == i] for i in range(60)]
    q = quality_model
    z, n, weight, passes = {}, {}, {}, min(20, max(2, q.UPDATES // 60))
    share = sum(labels) / 60
    for _ in range(passes):
        for row, y in zip(rows, labels, strict=True):
            every = [*row, (-1, 1.0)]
            for b, _ in every:
                zb, nb, first = z.get(b, 0.0), n.get(b, 0.0), 0.0 if b == -1 else q.L1
                weight[b] = 0.0 if abs(zb) <= first else -(zb - (first if zb > 0 else -first)) / ((q.BETA + nb**0.5) / q.ALPHA + (0.0 if b == -1 else q.L2))
            p = 1 / (1 + math.exp(-sum(weight[b] * v for b, v in every)))
            g = (p - y) * min(4.0, 0.5 / (share if y else 1 - share))
            for b, v in every:
                step = ((n.get(b, 0.0) + g * g * v * v) ** 0.5 - n.get(b, 0.0) ** 0.5) / q.ALPHA
                z[b], n[b] = z.get(b, 0.0) + g * v - step * weight[b], n.get(b, 0.0) + g * g * v * v
    w, bias = q.ftrl([(np.array([b for b, _ in row]), np.array([v for _, v in row])) for row in rows], np.array(labels, float))
    for b, zb in z.items():
        first, second = (0.0, 0.0) if b == -1 else (q.L1, q.L2)
        want = 0.0 if abs(zb) <= first else -(zb - (first if zb > 0 else -first)) / ((q.BETA + n[b] ** 0.5) / q.ALPHA + second)
        assert (bias if b == -1 else w[b]) == pytest.approx(want, abs=1e-9)


def test_shards_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20, i % 2) for i in range(60)], "doc_id long, text string, label int")
    model = quality_model.train(docs, most=100)
    assert model[0].any()
    scored = quality_model.score_quality(spark.createDataFrame([], DOCS), model)
    assert scored.count() == 0


def test_hits_by_force():
    """Every word's heaviest entry that it begins with, but for words that begin inside an exception phrase."""
    r = random.Random(2)
    entries = {"ab": 1.0, "abc": 3.0, "bca": 2.0, "CAB": 1.5, "\u0430bb": 2.5, "aa b": 0.5}
    lexicon = toxicity.Lexicon(entries, exceptions=("abc ca", "bca", "aa  b"))
    automaton = lexicon.automaton()
    folded = {}
    for e, w in entries.items():
        folded[toxicity.fold(e)] = max(w, folded.get(toxicity.fold(e), 0))
    for _ in range(400):
        text = toxicity.fold("".join(r.choice("abc ") for _ in range(r.randint(0, 25))))
        starts = [i for i in range(len(text)) if i == 0 or text[i - 1] == " "]
        spared = {k for i in starts for p in lexicon.exceptions if text.startswith(toxicity.fold(p), i) for k in range(i, i + len(toxicity.fold(p)))}
        want = sum(max((w for e, w in folded.items() if text.startswith(e, i)), default=0) for i in starts if i not in spared)
        assert toxicity.hits(automaton, text) == pytest.approx(want), text


def test_scores_may_bear_any_name(spark, odd):
    got = toxicity.score_toxicity(odd, toxicity.Lexicon(toxicity.GIVEN), out="_t").collect()
    assert {r.score for r in got} == {"y", None} and all(0 <= r["_t"] < 0.5 for r in got)


def test_folding_and_exceptions():
    automaton = toxicity.Lexicon({"idiot": 2.0, "trash": 1.0, "idio": 1.0}).automaton()
    hits = lambda t: toxicity.hits(automaton, toxicity.fold(t))
    assert hits("You 1D10T!!") == hits("an іdіоt") == hits("ídïot's") == 2.0
    assert hits("the trash can is full of trash") == 1.0
    assert hits("unidiotic") == 0.0


@pytest.mark.parametrize("mark", [chr(c) for c in (0x201C, 0x201E, 0xAB, 0x2014, 0xA1, 0xBF, 0x2018, 0x3010, 0x20AC, 0x2764)] + ["\u2764\ufe0f"])
def test_words_after_marks_beyond_ascii(mark):
    automaton = toxicity.Lexicon({"idiot": 2.0, "trash": 1.0}).automaton()
    hits = lambda t: toxicity.hits(automaton, toxicity.fold(t))
    assert hits(f"such {mark}Idiot{mark}") == hits(f"{mark}idiot") == hits(f"x{mark}idiot") == 2.0
    assert hits(f"the {mark}trash can{mark}") == hits(f"the trash{mark}can") == 0.0
    assert hits("\u00e9idiot") == hits("\u65e5idiot") == 0.0


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        (None, ("", "", None, "allow")),
        ("no scheme/here", ("", "", None, "allow")),
        ("http://A.Example.ORG/es/x?y#z", ("a.example.org", "/es/x", "example.org/es/", "block")),
        ("http://example.org/en/123", ("example.org", "/en/123", "example.org/en/1", "block")),
        ("http://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("x://org/", ("org", "/", "org/", "allow")),
        ("http://a.com/fr/1", ("a.com", "/fr/1", "com/fr/", "allow")),
        ("http://a.com/de/", ("a.com", "/de/", "com/de/", "block")),
        ("http://best-casino-bets.net/", ("best-casino-bets.net", "/", None, "block")),
        ("http://garden.museum.net/en/1", ("garden.museum.net", "/en/1", None, "allow")),
        ("http://a.b?c://d/e", ("a.b", "", None, "allow")),
    ],
)
def test_urls(spark, url, expected):
    row = url_filter.judge_urls(spark.createDataFrame([(1, url, "clash")], "page_id long, url string, other string")).first()
    assert (row.host, row.path, row["rule"], row.verdict) == expected


def test_urls_by_force(spark):
    got = url_filter.op5_url_filter(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").toPandas())
    for r in got.itertuples():
        m = re.match(r".*?://([^/?#]*)([^?#]*)", r.url or "", re.DOTALL)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=None)
        assert (r.host, r.path) == (host, path)
        assert (r.rule if isinstance(r.rule, str) else None) == (rule[0] if rule else None)
        assert r.verdict == (rule[1] if rule else "block" if r.score >= 0.5 else "allow")


def test_urls_held_out():
    """Of the table's rows outside training, no wanted url is blocked and half of the unwanted ones are."""
    table = url_table.labelled_urls()
    rest = table[table.held_out]
    told = url_filter.scores([f"{h}\t{p}".encode() for h, p in zip(rest.host, rest.path, strict=True)], url_filter.default_model()) >= 0.5
    assert len(rest) >= 30 and not told[rest.label == 0].any() and told[rest.label == 1].mean() >= 0.5


def test_urls_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "http://"), (4, "x://" + "a" * 300_000 + "/" + "b" * 300_000), (5, "http://org/" + "c" * 100_000), (1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({n: F.lit("mine") for n in ("host", "path", "rule", "score", "verdict", "_host")})
    got = sorted(url_filter.judge_urls(pages).collect(), key=lambda r: r.page_id)
    assert [len(r.host) for r in got] == [0, 0, 0, 0, 300_000, 3] and {r["_host"] for r in got} == {"mine"}
    assert {r.verdict for r in got} <= {"allow", "block"} and got[-1]["rule"] == "org/"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# --- bounds of samples, and entries that are whole words


def test_training_rows_are_bounded(spark):
    from scoreframe.llm.labelled import training_rows

    docs = spark.createDataFrame([(1, f"text {i}", "x") for i in range(500)] + [(2, None, "x"), (3, "c", "x"), (4, "d", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")
    for most in (1, 2, 4):
        got = training_rows(docs, labels, "toxic", most).collect()
        assert len(got) <= most and len({r.doc_id for r in got}) == len(got) and all(r.text is not None for r in got)
        assert got == training_rows(docs.repartition(7), labels, "toxic", most).orderBy("doc_id").collect() or len(got) > 1
        assert len(training_rows(docs, labels, "toxic", most, per_class=True).collect()) <= most


def _learned(spark, toxic_words, harmless, n=60):
    docs = [(i, f"{toxic_words[i % len(toxic_words)]} word{i} and more of it", 1) for i in range(n)]
    docs += [(1000 + i, f"{harmless[i % len(harmless)]} word{i} and more of it", 0) for i in range(n * 4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    return lambda *texts: [r.score for r in toxicity.score_toxicity(spark.createDataFrame([(t,) for t in texts], "text string"), lexicon).collect()]


def test_short_entries_are_whole_words(spark):
    score = _learned(spark, ["ugh"], ["fine", "good"])
    bad, harmless = score("an ugh place", "an ughknown place")
    assert bad > 0.5 > harmless
    assert score("ugh")[0] > 0.5 and score("a place, UGH!")[0] > 0.5


def test_long_words_are_told_apart_behind_their_first_letters(spark):
    score = _learned(spark, ["constructahole"], ["constructable", "constructation", "constructament"])
    bad, *good = score("a constructahole here", "a constructable here", "a constructahol here", "a constructaholes here")
    assert bad > 0.5 and all(g < 0.5 for g in good)
