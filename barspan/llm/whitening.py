"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed: it is applied to a block of vectors by one pass of centred products
over the fit list, whose partial sums Spark adds up by row of the block.  The driver holds blocks of
dims x (a few dozen) numbers only.  Correction equations of all open pairs are solved by a few
steps of MINRES in step with each other, so that they share each pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table

SCALE = 64
#: Scaled entries beyond this are clamped to it, so that every step below is exact.
MOST = float(1 << 52)


def valid(vector: Column) -> Column:
    """The vector is not null and has neither null nor non-finite entries."""
    good = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def scaled(vector: Column) -> Column:
    """Entries as floor(64 c); adding the same number (as 1,000,000) to all of them changes no centred value."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("bigint"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


class Fit:
    """The fit list (y: array of long, one row per distinct vector) with its exact sums, and passes over it."""

    def __init__(self, listed: DataFrame, dims: int):
        self.listed, self.dims = listed, dims
        self.n = listed.count()
        self.sums = self._sums() if self.n else np.zeros(dims, object)
        # Whole part and fraction of the means: differences from the first are exact.
        self.whole = np.array([int(s) // max(1, self.n) for s in self.sums], np.int64)
        self.part = np.array([(int(s) - self.n * int(w)) / max(1, self.n) for s, w in zip(self.sums, self.whole, strict=True)])

    def _sums(self) -> np.ndarray:
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
            for batch in batches:
                y = matrix(batch.column("y"), dims)
                high += (y >> 26).sum(axis=0)
                low += (y & ((1 << 26) - 1)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low)], ["j", "high", "low"])

        wide = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
        found = self.listed.mapInArrow(run, "j int, high bigint, low bigint").groupBy("j").agg(wide("high"), wide("low")).collect()
        out = np.zeros(dims, object)
        for r in found:
            out[r["j"]] = (int(r["high"]) << 26) + int(r["low"])
        return out

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, part = self.whole, self.part
        return lambda y: (y - whole).astype(np.float64) - part

    def gather(self, rows: int, width: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over the fit list of make(centred block), a rows x width matrix."""
        dims, centre = self.dims, self.centring()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((rows, width)), False
            for batch in batches:
                y = matrix(batch.column("y"), dims)
                for s in range(0, len(y), 4096):
                    total += make(centre(y[s : s + 4096]))
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *[pa.array(total[:, k]) for k in range(width)]], ["j", *[f"p{k}" for k in range(width)]])

        columns = [f"p{k}" for k in range(width)]
        parts = self.listed.mapInArrow(run, "j int, " + ", ".join(f"{c} double" for c in columns))
        out = np.zeros((rows, width))
        for r in parts.groupBy("j").agg(*[F.sum(c).alias(c) for c in columns]).collect():
            out[r["j"]] = r[1:]
        return out

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance (divisor n) times a dims x b block."""
        return self.gather(self.dims, block.shape[1], lambda c: c.T @ (c @ block)) / self.n


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of block made orthonormal to `against` and each other; dependent ones go."""
    out = np.zeros((block.shape[0], 0))
    for k in range(block.shape[1]):
        v = block[:, k]
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size == 0:
            continue
        v = v / size
        for _ in range(3):
            for basis in (*against, out):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column, all advanced by one `apply` a step."""
    beta = np.linalg.norm(b, axis=0)
    start = np.where(beta > 0, beta, 1)
    v, v_old = b / start, np.zeros_like(b)
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c, c_old = np.ones(b.shape[1]), np.ones(b.shape[1])
    s, s_old = np.zeros(b.shape[1]), np.zeros(b.shape[1])
    eta, beta, live = beta.copy(), np.zeros(b.shape[1]), beta > 0
    for _ in range(steps):
        z = apply(v)
        alpha = (v * z).sum(axis=0)
        z = z - alpha * v - beta * v_old
        after = np.linalg.norm(z, axis=0)
        first = c * alpha - c_old * s * beta
        length = np.hypot(first, after)
        second, third = s * alpha + c_old * c * beta, s_old * beta
        live &= length > 0
        if not live.any():
            break
        safe = np.where(length > 0, length, 1)
        w, w_old = (v - third * w_old - second * w) / safe, w
        c, c_old, s, s_old = first / safe, c, after / safe, s
        x = x + np.where(live, c * eta, 0) * w
        eta = -s * eta
        v, v_old, beta = np.where(after > 0, z / np.where(after > 0, after, 1), 0), v, after
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, *, steps: int = 5, max_rounds: int = 200, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator given by `product`.

    A pair is locked when its residual is within rounding of a product; pairs lock in falling order,
    and all others are kept orthogonal to them.  The basis restarts from its best Ritz vectors.
    """
    wanted = min(wanted, dims)
    none = np.zeros((dims, 0))
    if not wanted:
        return np.zeros(0), none
    most = min(dims, 3 * wanted + 16)
    basis = _orthonormal(np.random.default_rng(seed).normal(size=(dims, min(dims, wanted + 4))))
    image = product(basis)
    locked, values, top = none, np.zeros(0), 0.0
    best, still = np.inf, 0
    for _ in range(max_rounds):
        theta, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        y, theta = y[:, ::-1], theta[::-1]
        basis, image = basis @ y, image @ y
        top = max(top, theta[0]) if len(theta) else top
        rounding = 32 * np.finfo(float).eps * max(top, np.finfo(float).tiny) * np.sqrt(dims)
        open_ = wanted - locked.shape[1]
        residual = image[:, :open_] - basis[:, :open_] * theta[:open_]
        residual = residual - locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        # A residual that no longer falls is as small as the products' rounding lets it be.
        worst = size.max(initial=0)
        still = 0 if worst < best / 2 else still + 1
        best = min(best, worst)
        settled = size <= (rounding * 64 if still >= 4 else rounding)
        lock = len(settled) if settled.all() else int(np.argmin(settled))
        if lock:
            locked, values = np.column_stack([locked, basis[:, :lock]]), np.append(values, theta[:lock])
            basis, image, theta, residual, size = basis[:, lock:], image[:, lock:], theta[lock:], residual[:, lock:], size[lock:]
            best, still = np.inf, 0
        if locked.shape[1] >= wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if basis.shape[1] > most - len(size):
            keep = min(basis.shape[1], len(size) + 8)
            basis, image = basis[:, :keep], image[:, :keep]
        loose = np.flatnonzero(size > rounding)
        u, at = basis[:, loose], theta[loose]

        def away(z: np.ndarray, u=u, locked=locked) -> np.ndarray:
            z = z - locked @ (locked.T @ z)
            return z - u * (u * z).sum(axis=0)

        def corrected(z: np.ndarray, at=at, away=away) -> np.ndarray:
            z = away(z)
            return away(product(z) - z * at)

        room = dims - locked.shape[1] - basis.shape[1]
        if room <= 0:
            continue  # the basis spans all that is left: the Ritz pairs are final
        # Where the corrections fill the space, residuals do as well as solutions.
        solved = -residual[:, loose] if room <= len(loose) else minres(corrected, away(-residual[:, loose]), steps)
        more = _orthonormal(solved, locked, basis)[:, :room]
        if not more.shape[1]:
            more = _orthonormal(np.random.default_rng(seed + basis.shape[1]).normal(size=(dims, 1)), locked, basis)
        basis, image = np.column_stack([basis, more]), np.column_stack([image, product(more)])
    raise RuntimeError("eigenvectors did not settle")


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, steps: int = 5) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped; of the others those
    of the most frequent length (of equally frequent ones the longest; empty ones never) take part.
    Entries count as floor(64 c), clamped at 2**52.  The fit list holds each distinct vector once,
    so repeated rows change no component, yet each gets its rows.  A null id is an id like any
    other; extra columns are not read.  Components whose variance is below rounding of the largest
    cannot be whitened and have no rows: so has a list of equal vectors, or an empty table.
    deviation is null where no long holds it.  The input's whole vectors are read twice, the fit
    list once a product.
    """
    spark = embeddings.sparkSession
    empty = f"{id_col} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(valid(F.col("v")) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    dims = lengths["dims"]
    taken = rows.filter(F.size("v") == dims).select("id", scaled(F.col("v")).alias("y"))
    fit = Fit(cut(taken.select("y").distinct(), "fit-list"), dims)
    values, vectors = jacobi_davidson(fit.product, dims, components, steps=steps)
    alive = values > 1e-13 * max(values.max(initial=0), np.finfo(float).tiny)
    values, vectors = values[alive], vectors[:, alive]
    k, n, sums = len(values), fit.n, [int(s) for s in fit.sums]
    if not k:
        return spark.createDataFrame([], empty)
    weights = vectors / np.sqrt(values)
    # Below the k rows of whitened products: their sums, and the squares of all centred entries.
    def spread(c: np.ndarray) -> np.ndarray:
        z = c @ weights
        return np.vstack([z.T @ z, z.sum(axis=0), np.full(k, np.einsum("ij,ij->", c, c))])

    moments = fit.gather(k + 2, k, spread) / n
    means, trace = moments[k], float(moments[k + 1, 0])
    identity_error = float(np.abs(moments[:k] - np.outer(means, means) - np.eye(k)).max())
    explained, centre = values / trace, fit.centring()
    names = [x.split()[0] for x in empty.split(", ")]

    def deviations(y: np.ndarray, centred: np.ndarray) -> list[int | None]:
        about = (centred * n) ** 2
        about = about.sum(axis=1)
        with np.errstate(over="ignore"):
            exact = ((n * y - np.array([s % (1 << 64) for s in sums], np.uint64).astype(np.int64)) ** 2).sum(axis=1)
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(about > 9e18):
            whole = sum((n * int(v) - s) ** 2 for v, s in zip(y[i], sums, strict=True))
            out[i] = whole if whole < 1 << 63 else None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                y = matrix(part.column("y"), dims)
                c = centre(y)
                size = len(y)
                ids = part.column("id").take(pa.array(np.repeat(np.arange(size), k)))
                far = pa.array(deviations(y, c), pa.int64()).take(pa.array(np.repeat(np.arange(size), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)), far, pa.array((c @ weights).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, identity_error))],
                    names,
                )

    return taken.mapInArrow(run, empty)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
