"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

``fold`` lower-cases, strips accents, maps homoglyphs (Cyrillic and Greek look-alikes) and digits or signs standing for
letters, and turns all but letters, digits and other scripts' spacing vowel signs into spaces. Lexicon entries are beginnings
of words or, with a space at their end, whole words; a hit inside an exception phrase does not count. A text's features are the logarithms of the summed weight of its hits and of that sum per 100 words, and the
score is their logistic.

The lexicon is learned from at most ``MOST_TRAINING`` labelled documents outside the held-out fold, on top of a short list
of given entries: word beginnings that are far more frequent in toxic texts are candidates, and of these the ones that
cover toxic documents not yet covered ``COVER`` times are taken one by one, so that the chance words of one often-copied
text don't enter. Beginnings have SHORTEST to LONGEST letters; besides, every word of three letters or more is a candidate as
a whole, however long, and then matches no other word that begins like it. Of a beginning and a whole word that add as much,
the beginning is taken. Nothing bounds the lexicon: every candidate that is frequent enough counts, and entries are taken
until none adds enough.

Null and empty texts have no hits and get the lowest score. Scoring is row by row over whole texts, so ties, repeated rows
and empty tables need no care; other columns pass through, but one with the name of the score is replaced.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import materialize, table
from scoreframe.llm.labelled import held_out, training_rows

#: Bound of the training sample, half of it for each label.
MOST_TRAINING = 8_000
SHORTEST, LONGEST = 4, 10
COVER = 5
#: A candidate's share of toxic documents must be so many times (as a natural logarithm) its share of the others.
LEAST_RATIO = 3.0
#: An entry must be found in, and add to the cover of, one toxic document in so many.
LEAST_SHARE = 200
#: Entries that are known beforehand, with their weights.
GIVEN = {"idiot": 2.0, "moron": 2.0, "stupid": 2.0, "scumbag": 2.0, "imbecile": 2.0, "bastard": 2.0, "dumbass": 2.0}
#: Hits within these phrases don't count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "scum line", "pond scum", "idiot proof", "stupidly simple")
#: Coefficients where nothing can be learned: bias, log of weight, log of weight per 100 words.
PRIOR = (-3.0, 2.0, 1.0)
THRESHOLD = 0.5

#: What look-alike letters and the digits and signs in place of letters are read as.
_LOOKALIKE = dict(zip("авсеһікмнорѕтухјԁԛԝαβεικνορτυχγ", "abcehikmhopstyxjdqwabeiknoptuxy", strict=True))
_DIGITS = dict(zip("013457@$", "oieastas", strict=True))
_FOLD = {ord(k): v for k, v in (_LOOKALIKE | _DIGITS).items()} | {i: None for i in range(0x300, 0x370)} | {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None}
_FOLD |= {i: " " for i in range(128) if not chr(i).isalnum() and chr(i) not in "@$"}


class _Folding(dict):
    """Adds what a character is read as when it is first met: accents as nothing, all but letters and digits as a space."""

    def __missing__(self, code: int) -> str | None:
        kind = unicodedata.category(chr(code))
        self[code] = None if kind in ("Mn", "Me") else chr(code) if kind[0] in "LN" or kind == "Mc" else " "
        return self[code]


_FOLD = _Folding(_FOLD)


def fold(text: str) -> str:
    """The text as the lexicon reads it."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return text.translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """Entries (word beginnings, or whole words with a space behind them) with weights, exception phrases and the coefficients of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = PRIOR

    def automaton(self):
        found = ahocorasick.Automaton()
        heaviest: dict[str, float] = {}
        for entry, weight in self.weights.items():
            key = " " + fold(entry).strip() + " " * (entry[-1:] == " ")
            heaviest[key] = max(weight, heaviest.get(key, weight))
        words: dict[str, tuple] = {key: (len(key), weight, False) for key, weight in heaviest.items()}
        for phrase in self.exceptions:
            key = " " + fold(phrase).strip()
            words[key] = (len(key), heaviest.get(key), True)
        for key, told in words.items():
            if key.strip():
                found.add_word(key, told)
        found.make_automaton()
        return found


def hits(automaton, folded: str) -> float:
    """The summed weight of the hits that begin outside exception phrases; one hit for each word, the heaviest."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight, excepted) in automaton.iter(f" {folded} "):
        start = end - size + 1
        if excepted:
            spared.append((start, end))
        if weight is not None:
            best[start] = max(weight, best.get(start, 0.0))
    return sum(w for at, w in best.items() if not any(a <= at <= b for a, b in spared)) if spared else sum(best.values())


def measure(automaton, texts) -> np.ndarray:
    """Two features for each text."""
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        folded = fold(text)
        if total := hits(automaton, folded):
            out[i] = math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))
    return out


def _entries(folded: str) -> set[str]:
    """What could be an entry in a folded text: its words' beginnings of SHORTEST to LONGEST letters, and its words of three
    letters or more as a whole, with a space behind them."""
    found: set[str] = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            found.add(w + " ")
            found.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return found


def _candidates(rows: DataFrame) -> dict[str, float]:
    """The candidates with their weights, counted over the sample by Spark. Each is found in one of LEAST_SHARE of the toxic
    documents of the sample at the least, so their number is bounded by the sample's words."""

    def spell(frames):
        for pdf in frames:
            sets = [_entries(fold(t)) for t in pdf.text]
            sizes = [len(s) for s in sets]
            yield pd.DataFrame({"entry": list(itertools.chain.from_iterable(sets)), "toxic": np.repeat(pdf.label.to_numpy(), sizes)})

    size = rows.groupBy("label").count().toPandas().set_index("label")["count"]
    n1, n0 = int(size.get(1, 0)), int(size.get(0, 0))
    if not n1 or not n0:
        return {}
    counts = rows.mapInPandas(spell, "entry string, toxic int").groupBy("entry").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    ratio = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    counts = counts.where(F.col("n1") >= max(3, n1 // LEAST_SHARE)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    top = counts.orderBy("entry").toPandas()
    return dict(zip(top.entry, top.ratio, strict=True))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Lexicon:
    """The lexicon and coefficients learned from labels.toxic; the given entries alone where there are no labels."""
    rows = training_rows(docs, labels, "toxic", most, per_class=True)
    rows = materialize(rows.select("doc_id", "text", F.col("label").cast("int").alias("label")), "training")  # read four times
    known = _candidates(rows)
    spelled = set(known)

    def places(frames):
        for pdf in frames:
            sets = [sorted(_entries(fold(t)) & spelled) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "entries": sets})

    chosen: dict[str, float] = {}
    if known:
        where: dict[str, set[int]] = {}
        listed = rows.where("label = 1").mapInPandas(places, "doc_id long, entries array<string>").orderBy("doc_id").toPandas()
        for i, entries in enumerate(listed.entries):
            for entry in entries:
                where.setdefault(entry, set()).add(i)
        covered = np.zeros(len(listed), int)
        least = max(2, len(listed) // LEAST_SHARE)
        while where:
            gain = {e: sum(covered[i] < COVER for i in docs_of) for e, docs_of in where.items()}
            entry = max(gain, key=lambda e: (gain[e], e[-1] != " ", len(e), e))
            if gain[entry] < least:
                break
            chosen[entry] = known[entry]
            covered[list(where.pop(entry))] += 1
            where = {e: d for e, d in where.items() if gain[e] >= least and not e.startswith(entry) and not (entry.startswith(e) and gain[e] <= gain[entry])}
    lexicon = Lexicon(GIVEN | chosen)
    return Lexicon(lexicon.weights, coefficients=_fit(rows, lexicon))


def _fit(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Coefficients by ridge logistic regression on the sample's two features; three numbers a row reach the driver."""

    def features(frames):
        automaton = lexicon.automaton()
        for pdf in frames:
            x = measure(automaton, list(pdf.text))
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": pdf.label})

    got = rows.mapInPandas(features, "a double, b double, label int").toPandas()
    if got.label.nunique() < 2:
        return PRIOR
    x, y = np.column_stack([np.ones(len(got)), got.a, got.b]), got.label.to_numpy(float)
    w, prior = np.array(PRIOR), np.array(PRIOR)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(3)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + (w - prior))
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """Add the column ``out``: how likely a text is toxic."""
    bias, by_weight, by_share = lexicon.coefficients

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in parts:
            x = measure(automaton, list(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(bias + by_weight * x[:, 0] + by_share * x[:, 1], -30, 30))))

    return docs.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def op7_toxicity(spark, sf_dir) -> DataFrame:
    """A toxicity score for every document, learned from labels.toxic outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
