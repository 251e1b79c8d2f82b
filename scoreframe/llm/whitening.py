"""Whitening of embeddings: leading principal components by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become whole numbers, floor(SCALE * c), so that counts, sums and deviations are exact. The fit list is each distinct
vector once, written in blocks. With A the centred rows of the fit list, the bidiagonalisation builds orthonormal v_j and u_j
with A V = U B. A step is one job: tasks take the product A y, a part of a left vector, and at once the product of A
transposed with it, and with all left vectors so far; sums over tasks give the next right vector, on the driver. A left
vector has as many entries as there are rows, so it is never kept: u_j = A y_j, and tasks make it again from y_j, which has
one entry for each dimension. What is held on the driver and sent to tasks is (dimensions + steps) * steps numbers.

Both sides are reorthogonalised in full: v_j against all right vectors (twice), u_j against all left vectors by their inner
products, again in a job of its own where that takes away most of it. A sequence ends when its triplets have converged or
its space is used up; a new one then begins in what is left, so that an eigenvalue that occurs several times is found as
often. It all ends when the leading triplets have converged and what is left shows no larger one, or when there are as
many steps as dimensions. The small matrix's SVD gives components and deviations.

Vectors that are null, or hold null or non-finite entries, are left out, as are those of another length than the most
frequent one (of equally frequent ones the longer). Components of no variance are left out: one distinct vector, or an empty
table, gives no rows. Repeated and null ids are rows of their own. Other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import materialize, table

SCALE, COMPONENTS = 256, 4
#: Residuals that count as converged, against the largest singular value: of the components, and of what is left.
CONVERGED, LEFT = 1e-13, 1e-2
#: A vector shorter than this against what it was made of is rounding error.
NOTHING = 1e-12
#: Vectors in a block.
BLOCK = 4096


def whole(vector: Column) -> Column:
    """The vector in whole numbers, null where it is null or holds a null or non-finite entry."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, exact sums of their entries, total variance, components (one a row) and their variances."""

    n: int
    sums: tuple[int, ...]
    trace: float
    components: np.ndarray
    variances: np.ndarray
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch of lists, one a row."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(blocks: DataFrame, d: int, product, size: int) -> np.ndarray:
    """The sum over all blocks of product(rows of a block), which gives ``size`` numbers."""

    def run(found):
        total = np.zeros(size)
        for batch in found:
            for packed in batch.column(0):
                total += product(np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "x"])

    rows = blocks.select("block").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect()
    out = np.zeros(size)
    for i, x in rows:
        out[i] = x
    return out


def _pack(vectors: DataFrame, d: int) -> DataFrame:
    """Blocks of vectors as bytes, and the exact sums of each block."""

    def run(found):
        for batch in found:
            x = _matrix(batch, d).astype(np.int64)
            for i in range(0, len(x), BLOCK):
                part = x[i : i + BLOCK]
                sums = part.sum(axis=0) if np.abs(part).max(initial=0) < 2**50 else part.astype(object).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()), pa.array([len(part)], pa.int64()), pa.array([[str(s) for s in sums]])], ["block", "n", "sums"])

    return vectors.mapInArrow(run, "block binary, n long, sums array<string>")


def bidiagonalise(blocks: DataFrame, mean: np.ndarray, most: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(right singular vectors, one a row; singular values) of the k largest of the centred rows, and the steps it took.

    ``most`` steps are the most that the rows have directions.
    """
    d, random = len(mean), np.random.default_rng(seed)
    right, left, images, alpha, beta = [], [], [], [], []  # v_j, y_j with u_j = A y_j, A'u_j, and B's two diagonals

    def products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """A'(Ay), the inner products of Ay with all left vectors, and its length."""
        made = np.array(left).reshape(len(left), d).T

        def product(rows):
            a = rows - mean
            u = a @ y
            return np.concatenate([u @ a, (a @ made).T @ u, [u @ u]])

        out = _summed(blocks, d, product, d + len(left) + 1)
        return out[:d], out[d:-1], float(np.sqrt(max(out[-1], 0.0)))

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for q in right:
                v = v - (q @ v) * q
        return v

    def solved() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.diag(alpha) + np.diag(beta[:-1], 1)
        return np.linalg.svd(b)

    fresh, began, scale = True, 0, 0.0
    while len(right) < most:
        if fresh:
            v = apart(random.standard_normal(d))
            fresh, began = False, len(right)
        v = apart(v / np.linalg.norm(v))
        v /= np.linalg.norm(v)
        right.append(v)
        y = v - (beta[-1] * left[-1] if beta else 0)
        image, inner, length = products(y)
        scale = max(scale, length)
        for _ in range(2):
            if not left:
                break
            was = length
            y = y - np.array(left).T @ inner
            if was <= NOTHING * scale:
                break
            image, inner, length = image - np.array(images).T @ inner, np.zeros(len(left)), float(np.sqrt(max(was**2 - inner @ inner, 0.0)))
            if length > 0.7 * was:
                break
            image, inner, length = products(y)
        if length <= NOTHING * scale:  # nothing new on the left: the space is used up
            left.append(np.zeros(d))
            images.append(np.zeros(d))
            alpha.append(0.0)
            beta.append(0.0)
            fresh = True
            continue
        alpha.append(length)
        left.append(y / length)
        images.append(image / length)
        v = apart(images[-1] - length * right[-1])
        beta.append(float(np.linalg.norm(v)))
        p, s, _ = solved()
        residual = beta[-1] * np.abs(p[-1])
        own = np.abs(p[began:]).max(axis=0) > 0.5 if began else np.ones(len(s), bool)  # triplets of the present sequence
        used_up = beta[-1] <= NOTHING * scale
        first = k if began == 0 else 1
        limit = (CONVERGED if began == 0 else LEFT) * s[0]
        told = used_up or (np.flatnonzero(own)[:first].size == first and (residual[np.flatnonzero(own)[:first]] <= limit).all())
        if told:
            if began and len(s) >= k and not own[:k].any() and (residual[:k] <= CONVERGED * s[0]).all() and s[np.flatnonzero(own)[0]] < s[k - 1]:
                break
            if began == 0 or used_up or own[:k].any() and (residual[:k] <= CONVERGED * s[0]).all():
                beta[-1], fresh = 0.0, True
    if not right:
        return np.zeros((0, d)), np.zeros(0), 0
    p, s, q = solved()
    return (q @ np.array(right))[:k], s[:k], len(right)


def fit(vectors: DataFrame, k: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """(the whitening of vectors (x: whole numbers), null if there is none; the blocks of the fit list)."""
    lengths = vectors.where("x IS NOT NULL").groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    if not d:
        return None, vectors.select(F.lit(b"").alias("block")).limit(0)
    distinct = vectors.where(F.size("x") == d).select("x").distinct()
    blocks = materialize(_pack(distinct, d), "vectors")
    n = blocks.agg(F.sum("n")).first()[0]
    each = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = tuple(int(r.s) for r in each.orderBy("i").collect())
    mean = np.array([s / n for s in sums])
    trace = float(_summed(blocks, d, lambda rows: np.array([((rows - mean) ** 2).sum()]), 1)[0]) / n
    components, deviations, steps = bidiagonalise(blocks, mean, min(d, n), k) if trace > 0 else (np.zeros((0, d)), np.zeros(0), 0)
    variances = deviations**2 / n
    real = variances > NOTHING * trace
    return Whitening(n, sums, trace, components[real], variances[real], steps), blocks


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list less the identity."""
    k, d, mean = len(model.variances), len(model.sums), model.mean
    to = (model.components / np.sqrt(model.variances)[:, None]).T
    middle = _summed(blocks, d, lambda rows: ((rows - mean) @ to).sum(axis=0), k) / model.n

    def product(rows):
        w = (rows - mean) @ to - middle
        return (w.T @ w).ravel()

    return float(np.abs(_summed(blocks, d, product, k * k).reshape(k, k) / model.n - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vectors (vec_id, x) with their exact deviation (as decimal) and their whitened entries."""
    n, d, mean = model.n, len(model.sums), model.mean
    sums = np.array(model.sums, object)
    to = (model.components / np.sqrt(model.variances)[:, None]).T

    def run(found):
        for batch in found:
            x = _matrix(batch, d).astype(np.int64)
            bound = max([n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in model.sums), 1])
            exact = n * x - sums.astype(np.int64) if d * bound**2 < 2**63 else n * x.astype(object) - sums
            deviation = [str(v) for v in (exact * exact).sum(axis=1)]
            whitened = (x - mean) @ to
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(deviation), pa.array(whitened.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    made = vectors.where(F.size("x") == d).select("x", "vec_id").mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>")
    return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def op13_whitening(spark, sf_dir) -> DataFrame:
    """All embeddings whitened along the four leading components of their distinct vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    model, blocks = fit(vectors)
    if model is None or not len(model.variances):
        none = "CAST(NULL AS int) AS component", "CAST(NULL AS long) AS n", "CAST(NULL AS long) AS deviation", "CAST(NULL AS double) AS whitened", "CAST(NULL AS double) AS explained", "CAST(NULL AS double) AS identity_error"
        return vectors.where(F.lit(False)).selectExpr("vec_id", *none)
    error = identity_error(blocks, model)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    long = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return long.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", explained[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"),
    )
