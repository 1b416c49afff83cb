"""Embedding whitening by matrix-free block Lanczos.

Each component c of a vector becomes the whole number floor(SCALE * c) + SHIFT. The fit list holds each distinct vector of
such numbers once; its covariance C (divisor n, centred before multiplying) is never formed. A block of vectors Q is
multiplied by it in one pass over the fit list: each task sums centred x (x . Q) over its rows, and Spark adds up the tasks'
sums, one row a dimension. The driver keeps the Lanczos basis, dimensions times its size.

Every new block is made orthogonal to the whole basis twice. Directions that vanish there (breakdown: the basis holds all
that the block can reach) are replaced by random ones, made orthogonal too, so that repeated eigenvalues and the rest of the
spectrum are found. The best vectors of the basis are components once their residuals |C v - e v|, taken from one pass of
their own, are below TOLERANCE * largest eigenvalue and the basis cannot hide a larger one, which a random block that finds
nothing new tells; at the latest when the basis spans the space.

Sums of the numbers and deviations are exact. The trace is summed from the deviations, and gives the explained shares.

Defined cases: vectors that are null, or hold null or non-finite components, are left out; repeated rows and ids stay.
Vectors shorter than the longest one count as if zeros followed. Numbers beyond +-LARGEST stop there. Eigenvalues that are
zero to double precision (ZERO of the largest) have no whitened value: rows then have fewer components, or none where all
vectors are equal. Signs: a component's largest entry is positive. Empty tables give empty tables; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, bounded_batches, table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
TOLERANCE = 1e-12
ZERO = 1e-13
LARGEST = 2**52
SEED = 13

OUT = "row_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row_id and x (long numbers) of the rows that take part, padded to the longest vector's length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("row_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    held = lambda c: F.greatest(F.least(SCALE * c, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    full = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec")))
    return rows.select("row_id", F.transform(full, lambda c: F.floor(held(c)) + SHIFT).alias("x"))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Fit:
    """The fit list: n distinct vectors of whole numbers, their sums, and products with their covariance."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.table = scratch.keep(rows.select("x").distinct(), "fit")
        self.n = self.table.count()
        sums = self.table.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).collect()
        self.sums = [int(r.s) for r in sorted(sums, key=lambda r: r["at"])]
        self.dim = len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times block, in one pass."""
        n, sums, width = self.n, self.sums, block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(block)
            for batch in batches:
                if batch.num_rows:
                    c = centred(_numbers(batch.column(0)), n, sums)
                    total += c.T @ (c @ block)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(total[:, j]) for j in range(width)]], names=["at", *[f"v{j}" for j in range(width)]])

        parts = self.table.mapInArrow(run, ", ".join(["at int", *[f"v{j} double" for j in range(width)]]))
        got = parts.groupBy("at").agg(*[F.sum(f"v{j}") for j in range(width)]).collect()
        return np.array([list(r)[1:] for r in sorted(got, key=lambda r: r["at"])]) / n

    def trace(self) -> float:
        """Sum of the variances, from exact deviations."""
        n, sums = self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(sum(deviations(_numbers(b.column(0)), n, sums)) for b in batches if b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([total / n**3])], names=["t"])

        return self.table.mapInArrow(run, "t double").agg(F.sum("t")).first()[0]


def off_centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as longs if they fit, else as Python's numbers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, "i8")
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return off_centre(x, n, sums).astype("f8") / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum of squares of n * x - sums, for each row."""
    off = off_centre(x, n, sums)
    largest = int(np.abs(off).max(initial=0))
    exact = off if off.dtype == object or largest**2 * max(1, x.shape[1]) < 2**62 else off.astype(object)
    return [int(v) for v in (exact * exact).sum(1)]


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block, orthogonal to the basis, with random directions where the given ones vanish."""
    room = block.shape[0] - basis.shape[1]
    out = np.empty((block.shape[0], 0))
    for v in [*block.T, *[None] * block.shape[1]]:
        if out.shape[1] == min(room, block.shape[1]):
            break
        for _ in range(4):
            w = rng.standard_normal(block.shape[0]) if v is None else v.copy()
            before = np.linalg.norm(w)
            for _ in range(2):
                w -= basis @ (basis.T @ w)
                w -= out @ (out.T @ w)
            if before and np.linalg.norm(w) > 1e-10 * before:
                out = np.column_stack([out, w / np.linalg.norm(w)])
                break
            v = None
    return out


def principal(fit: Fit, k: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The largest k eigenvalues of the covariance and their unit vectors, as columns."""
    rng = np.random.default_rng(SEED)
    basis = images = np.empty((fit.dim, 0))
    block, settled = rng.standard_normal((fit.dim, min(k, fit.dim))), None
    while True:
        block = orthogonal(block, basis, rng)
        after = fit.times(block)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, after])
        small = basis.T @ images
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:k], mix[:, ::-1][:, :k]
        vectors = basis @ mix
        residual = np.linalg.norm(images @ mix - vectors * values, axis=0).max(initial=0)
        whole = basis.shape[1] == fit.dim
        if whole or (settled is not None and len(settled) == len(values) and np.abs(settled - values).max() <= tolerance * values[0]):
            break
        found = residual <= tolerance * max(values[0], 0)
        settled = values if found else None
        block = rng.standard_normal(block.shape) if found else after  # a random block tells whether a larger value is hidden
    return refined(fit, values, vectors, tolerance)


def refined(fit: Fit, values: np.ndarray, vectors: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz once more on the vectors found, from a pass of their own, without zero values; signs are set."""
    vectors, _ = np.linalg.qr(vectors)
    small = vectors.T @ fit.times(vectors)
    values, mix = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], (vectors @ mix)[:, ::-1]
    kept = values > ZERO * max(values.max(initial=0), 0)
    values, vectors = values[kept], vectors[:, kept]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1, 1) if len(values) else vectors


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """row_id, component, n, deviation, whitened, explained and identity_error of each row and component."""
    bounded_batches(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = whole_numbers(vectors, id_col, vec_col)
    fit = Fit(rows, scratch)
    values = np.empty(0)
    if fit.n > 1 and fit.dim:
        values, axes = principal(fit, components)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], OUT)
    scaled = axes / np.sqrt(values)
    n, sums, k = fit.n, fit.sums, len(values)
    error = float(np.abs(scaled.T @ fit.times(scaled) - np.eye(k)).max())
    explained = values / fit.trace()
    scratch.drop("fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column(1))
            held = batch.num_rows
            every = np.repeat(np.arange(held), k)
            spread = pa.array([Decimal(d) for d in deviations(x, n, sums)], pa.decimal128(38, 0)).take(pa.array(every))
            columns = [batch.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), held)), pa.array(np.full(held * k, n)), spread]
            columns += [pa.array((centred(x, n, sums) @ scaled).ravel()), pa.array(np.tile(explained, held)), pa.array(np.full(held * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("row_id", "x").mapInArrow(run, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the whitened components of every vector. A deviation that does not fit a long is null here."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long")).withColumnRenamed("row_id", "vec_id")
