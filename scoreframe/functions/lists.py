"""Overlap of two lists: a similarity for every pair of entries, then the best one-to-one assignment.

The similarities are a native expression over both arrays. Only the assignment, which no built-in function expresses,
runs in an Arrow-batched helper on the finished matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.scalar import clamp, cosine, levenshtein_score, scaled

Pairwise = Callable[[Column, Column], Column]


def similarities(output: Column, expected: Column, pairwise: Pairwise = levenshtein_score) -> Column:
    """A matrix as an array of rows: one row for each output entry, one column for each expected entry; nulls count 0."""
    return F.transform(output, lambda o: F.transform(expected, lambda e: F.coalesce(pairwise(o, e), F.lit(0.0))))


#: Entries of the padded matrices that are solved together.
TOGETHER = 1 << 20


def _solve(gain: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The column of each row in the best assignment of each matrix of a batch (batch, rows, columns), of which the first
    ``rows`` rows count, no more than it has columns: shortest augmenting paths, one row of every matrix at a time, all
    matrices in step."""
    batch, n, m = gain.shape
    every = np.arange(batch)
    by_row, by_column = np.zeros((batch, n)), np.zeros((batch, m))
    owner = np.full((batch, m), -1)
    for row in range(n):
        slack, came = np.full((batch, m), np.inf), np.full((batch, m), -1)
        done = np.zeros((batch, m), bool)
        far = np.zeros(batch)  # how long the path to the row under review is
        current, column = np.full(batch, row), np.full(batch, -1)
        reached = np.full((batch, n), np.nan)  # the rows on the tree, with their distance
        reached[:, row] = 0
        active = started = every[rows > row]
        while len(active):
            r = current[active]
            reduced = far[active, None] - gain[active, r] - by_row[active, r][:, None] - by_column[active]
            better = ~done[active] & (reduced < slack[active])
            slack[active] = np.where(better, reduced, slack[active])
            came[active] = np.where(better, column[active][:, None], came[active])
            nearest = np.where(done[active], np.inf, slack[active]).argmin(1)
            far[active], column[active] = slack[active, nearest], nearest
            done[active, nearest] = True
            holder = owner[active, nearest]
            held = holder >= 0
            active = active[held]
            current[active] = holder[held]
            reached[active, current[active]] = far[active]
        by_row += np.where(np.isnan(reached), 0, far[:, None] - reached)
        by_column -= np.where(done, far[:, None] - np.where(done, slack, 0), 0)
        open_ = started
        while len(open_):  # the path back, along which every column passes to the row that reached it
            before = came[open_, column[open_]]
            first = before < 0
            owner[open_, column[open_]] = np.where(first, row, owner[open_, before])
            open_ = open_[~first]
            column[open_] = before[~first]
    out = np.zeros((batch, n), int)
    at, c = np.nonzero(owner >= 0)
    out[at, owner[at, c]] = c
    return out


def _padded(size: int) -> int:
    """The next size of at most three binary digits."""
    unit = 1 << max(0, size.bit_length() - 3)
    return -(-size // unit) * unit


def _blocks(gain: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected component of the entries above zero."""
    n, m = gain.shape
    linked = gain > 0
    label = np.arange(n)
    while True:
        columns = np.where(linked, label[:, None], n).min(0, initial=n)
        least = np.minimum(label, np.where(linked, columns, n).min(1, initial=n))
        if (least == label).all():
            break
        label = least
    columns = np.where(linked, label[:, None], n).min(0, initial=n)
    return [(np.nonzero(label == part)[0], np.nonzero(columns == part)[0]) for part in np.unique(columns[columns < n])]


def best_assignments(gains: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each matrix the pairs (row, column) of the largest total gain, each row and column used once at most.

    A matrix without negative entries is split into the connected components of its positive ones, since no pair across
    them adds anything; so lists of thousands of which each entry is like few are as dear as their components. Parts of a
    like size are padded to one shape and solved in step. Rows and columns that are left pair up in order.
    """
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []
    pairs: list[list[tuple[int, int]]] = [[] for _ in gains]
    for k, gain in enumerate(gains):
        if 0 in gain.shape:
            continue
        if (gain >= 0).all() and (gain == 0).any():
            parts += [(k, r, c) for r, c in _blocks(gain)]
        else:
            parts.append((k, np.arange(gain.shape[0]), np.arange(gain.shape[1])))
    shaped: dict[tuple[int, int], list[int]] = {}
    for i, (_, r, c) in enumerate(parts):
        small, large = sorted((_padded(len(r)), _padded(len(c))))
        shaped.setdefault((small, large), []).append(i)
    for (n, m), members in shaped.items():
        step = max(1, TOGETHER // (n * m))
        for start in range(0, len(members), step):
            chosen = members[start : start + step]
            stack = np.empty((len(chosen), n, m))
            turned = []
            for at, i in enumerate(chosen):
                k, r, c = parts[i]
                block = gains[k][np.ix_(r, c)]
                turned.append(len(r) > len(c))
                block = block.T if turned[-1] else block
                stack[at] = block.min() - 1  # worse than any entry, so that no row takes a column of the padding
                stack[at, : block.shape[0], : block.shape[1]] = block
            found = _solve(stack, np.array([min(len(parts[i][1]), len(parts[i][2])) for i in chosen]))
            for at, i in enumerate(chosen):
                k, r, c = parts[i]
                for a, b in enumerate(found[at, : min(len(r), len(c))].tolist()):
                    pairs[k].append((int(r[b]), int(c[a])) if turned[at] else (int(r[a]), int(c[b])))
    for k, gain in enumerate(gains):
        left = min(gain.shape) - len(pairs[k])
        if left:
            rows, columns = {r for r, _ in pairs[k]}, {c for _, c in pairs[k]}
            rest = zip((r for r in range(gain.shape[0]) if r not in rows), (c for c in range(gain.shape[1]) if c not in columns), strict=False)
            pairs[k] += list(rest)
        pairs[k].sort()
    return pairs


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The best assignment of one matrix."""
    return best_assignments([gain])[0]


def assignment(matrix: Column) -> Column:
    """The best assignment of each matrix: a struct of its total and the places of its pairs. The matrices of an Arrow batch are
    solved together."""

    @F.pandas_udf("total double, pairs array<struct<o:int,e:int,score:double>>")
    def run(matrices: pd.Series) -> pd.DataFrame:
        gains = [np.array([list(r) for r in m], float) if m is not None and len(m) else np.zeros((0, 0)) for m in matrices]
        rows = []
        for gain, found in zip(gains, best_assignments(gains), strict=True):
            pairs = [{"o": r, "e": c, "score": float(gain[r, c])} for r, c in found]
            rows.append((sum(p["score"] for p in pairs), pairs))
        return pd.DataFrame(rows, columns=["total", "pairs"])

    return run(matrix)


def with_matrix(df: DataFrame, output: Column, expected: Column, pairwise: Pairwise = levenshtein_score, name: str = "_matrix") -> DataFrame:
    """Add the column ``name``, for ``list_score``. It is a projection of its own: Spark 4.1 can't plan a Python function directly
    over nested lambdas."""
    return df.withColumn(name, similarities(output, expected, pairwise))


def best_pairs(name: str = "_matrix") -> Column:
    """The best assignment of the matrix in a column. Naming the column twice keeps Spark from merging the two projections."""
    return F.when(F.size(name) >= 0, assignment(F.col(name)))


def list_score(n_output: Column, n_expected: Column, allow_extra: bool = False, name: str = "_matrix") -> Column:
    """How well one list's entries match the other's, from their matrix in a column and both lengths; entries beyond the expected ones
    lower it unless allow_extra."""
    whole = n_expected if allow_extra else F.greatest(n_output, n_expected)
    score = clamp(F.try_divide(best_pairs(name)["total"], whole))
    return F.when((n_output == 0) & (n_expected == 0), F.lit(1.0)).when((n_output == 0) | (n_expected == 0), F.lit(0.0)).otherwise(score)


def embedding_pairwise(expected_min: float = 0.7) -> Pairwise:
    """Scaled cosine, for lists of vectors."""
    return lambda a, b: scaled(cosine(a, b), expected_min)
