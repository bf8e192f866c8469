"""PCA whitening of embeddings: exact distributed covariance, eigenvectors refined from single to double precision.

Entries become integers (``floor(SCALE * c) + SHIFT``), so sums and products are exact in whatever order tasks deliver them: a
task centres its rows on the rounded means, multiplies them in limbs small enough for exact float64 matrix products, and hands
on the upper triangle as decimals that Spark adds up. The driver sees one number per pair of dimensions, whatever the rows.

The eigenvectors start in float32 and are corrected by matrix multiplications in extended precision: each round measures how
far the vectors are from orthogonal and from diagonalising the covariance, and moves all of them by a first-order correction
that squares the error. Eigenvalues too close to be told apart by that correction are solved again inside the space that
their vectors span, with the mean of the cluster taken off, before the next round.

Edge cases: a row whose vector is null, empty, or holds null or non-finite entries is left out. Rows of another length than most
are left out too (of equally common lengths the longest counts). Repeated rows count each, a null ``vec_id`` is an id like any
other, extra columns are ignored. A component whose eigenvalue is zero to working precision has no whitened values and is
left out (all of them, if all vectors are equal or there is one row). An empty table gives an empty result. A deviation beyond
64 bits raises an error instead of a wrong number.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb, and bits in which float64 adds integers exactly.
LIMB, EXACT = 22, 53
#: Rounds of refinement; the error squares in each, so a handful does from float32 on.
ROUNDS = 12
#: Gap between eigenvalues, over the matrix's size, below which they always count as a cluster.
CLOSE = 1e-10
#: Rows of a task that are handled at a time.
BLOCK = 1 << 12


def integer_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and ``x`` (array of long) of the rows that can be whitened."""
    kept = rows.select("vec_id", F.col(column).cast("array<double>").alias("v")).where(
        "v IS NOT NULL AND size(v) > 0 AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")
    sizes = kept.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes:
        kept = kept.where(F.size("v") == sizes["size"])
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(batches):
    """Matrices of at most BLOCK rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.column("x").slice(lo, BLOCK))


def _bits(values: np.ndarray) -> int:
    return int(max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))).bit_length()


def exact_gram(d: np.ndarray) -> np.ndarray:
    """d.T @ d of integers as Python integers, by float64 products of limbs that lose nothing."""
    total = np.zeros((d.shape[1], d.shape[1]), object)
    bits = _bits(d)
    n_limbs = max(1, -(-(bits + 1) // LIMB))
    rows = 1 << max(0, EXACT - 2 * min(bits + 1, LIMB))
    for lo in range(0, len(d), rows):
        part, limbs = d[lo: lo + rows], []
        for _ in range(n_limbs - 1):
            low = part & ((1 << LIMB) - 1)
            limbs.append(low.astype(np.float64))
            part = (part - low) >> LIMB
        limbs.append(part.astype(np.float64))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


@dataclass
class Moments:
    """Number of rows, exact sums per dimension and the covariance (divisor n), correctly rounded."""

    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        """Whole and fractional part of the means, so that differences to integers keep all their digits."""
        return np.array([[s // self.n, (s % self.n) / self.n] for s in self.sums]).T


def exact_moments(vectors: DataFrame) -> Moments | None:
    """Moments of the integer vectors ``x``: one pass for the means, one for the products of centred rows."""
    def add(batches):
        n, total = 0, None
        for x in _blocks(batches):
            # sums of the high and low halves of the numbers cannot overflow
            part = [h * (1 << 32) + l for h, l in zip((x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist())]
            n, total = n + len(x), part if total is None else [a + b for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()),
                                              "s": pa.array([str(t) for t in total])})

    got = vectors.mapInArrow(add, "dim int, n long, s string").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    if not got:
        return None
    n, sums = got[0]["n"], [int(r["s"]) for r in got]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    dims = len(sums)
    up = np.triu_indices(dims)

    def multiply(batches):
        total = None
        for x in _blocks(batches):
            part = exact_gram(x - centre)[up]
            total = part if total is None else total + part
        if total is not None:
            for lo in range(0, len(total), 1 << 14):
                yield pa.RecordBatch.from_pydict({"cell": pa.array(range(lo, min(len(total), lo + (1 << 14))), pa.int32()),
                                                  "q": pa.array([str(q) for q in total[lo: lo + (1 << 14)]])})

    cells = vectors.mapInArrow(multiply, "cell int, q string").groupBy("cell").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect()
    rest = [s - n * int(c) for s, c in zip(sums, centre)]              # what the rounded means leave over
    covariance = np.zeros((dims, dims))
    for r in cells:
        i, j = int(up[0][r["cell"]]), int(up[1][r["cell"]])
        covariance[i, j] = covariance[j, i] = (n * int(r["q"]) - rest[i] * rest[j]) / (n * n)
    return Moments(n, sums, covariance)


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Positions of ascending values in runs whose neighbours differ by at most ``near``."""
    return [run for run in np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > near) + 1) if len(run) > 1]


def _even(m: np.ndarray) -> np.ndarray:
    """Rounding errors that differ across the diagonal would be blown up by small gaps and spoil orthogonality."""
    return (m + m.T) / 2


def refine(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of the symmetric ``a`` from approximate eigenvectors ``x``, in extended precision."""
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    unit, before = np.eye(len(a), dtype=np.longdouble), np.inf
    size = np.abs(a).sum(axis=1).max()
    for step in range(rounds):
        skew = _even(unit - x.T @ x)                                    # distance from orthogonal
        turned = _even(x.T @ (a @ x))                                   # diagonal once x is right
        value = np.diag(turned) / (1 - np.diag(skew))
        off = turned - np.diag(value)
        near = max(2 * float(np.sqrt((off ** 2).sum()) + size * np.sqrt((skew ** 2).sum())), CLOSE * float(size))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > near
        move = np.where(apart, (turned + value[None, :] * skew) / np.where(apart, gap, 1), skew / 2)
        x = x + x @ move
        change = float(np.abs(np.where(apart, move, 0)).max(initial=0)) + float(np.abs(skew).max(initial=0))
        order = np.argsort(value, kind="stable")
        x, value = x[:, order], value[order]
        for run in _clusters(value, near):
            x[:, run] = x[:, run] @ _solve_inside(a, x[:, run], value[run].mean())
        if change == 0 or (step > 1 and change >= before and change < 1e-12):
            break
        before = change
    value = np.einsum("ij,ij->j", x, a @ x) / (x * x).sum(axis=0)
    order = np.argsort(value, kind="stable")
    return value[order], (x / np.sqrt((x * x).sum(axis=0)))[:, order]


def _solve_inside(a: np.ndarray, x: np.ndarray, middle) -> np.ndarray:
    """The rotation of a cluster's vectors that diagonalises ``a`` inside their span; what the cluster shares is taken off first."""
    inside = x.T @ (a @ x - middle * x)
    inside = (inside + inside.T) / 2
    scale = np.abs(inside).max()
    if not scale > 0:
        return np.eye(x.shape[1], dtype=np.longdouble)
    return np.linalg.eigh((inside / scale).astype(np.float64))[1].astype(np.longdouble)


@dataclass
class Whitening:
    """A fitted transformation: ``weights`` are eigenvectors (columns) over the roots of their eigenvalues."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return (self.vectors / np.sqrt(self.values)).astype(np.float64)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The largest ``components`` eigenvectors of the covariance of ``x``; the largest entry of each is positive."""
    moments = exact_moments(vectors)
    if moments is None:
        return None
    scale = float(np.trace(moments.covariance))
    if scale == 0:
        return Whitening(moments, np.zeros(0), np.zeros((len(moments.sums), 0)), np.zeros(0))
    a = moments.covariance / scale
    first = np.linalg.eigh(a.astype(np.float32))[1]
    value, x = refine(a, first)
    value, x = value[::-1][:components], x[:, ::-1][:, :components]
    some = value > len(a) * np.finfo(np.float64).eps * max(value[0], 0)
    value, x = value[some], x[:, some]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)
    return Whitening(moments, value * scale, x, value.astype(np.float64))


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return (x - mean[0].astype(np.int64)) - mean[1]


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    mean, weights, n = model.moments.mean, model.weights, model.moments.n
    k = weights.shape[1]
    if not k:
        return 0.0

    def add(batches):
        total = sum((_centred(x, mean) @ weights).sum(axis=0) for x in _blocks(batches))
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(k), pa.int32()), "v": pa.array(total)})

    def totals(function):
        got = vectors.mapInArrow(function, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
        return np.array([r["v"] for r in got])

    centre = totals(add) / n

    def multiply(batches):
        total = 0
        for x in _blocks(batches):
            y = _centred(x, mean) @ weights - centre
            total = total + y.T @ y
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(k * k), pa.int32()), "v": pa.array(total.ravel())})

    return float(np.abs(totals(multiply).reshape(k, k) / n - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, ``deviation`` (sum over dimensions of (n x - sum)^2) and ``whitened`` (array of double) of every row."""
    mean, weights, n = model.moments.mean, model.weights, model.moments.n
    sums = model.moments.sums
    small = [s - n * int(c) for s, c in zip(sums, mean[0])]

    def deviations(x: np.ndarray) -> np.ndarray:
        far = x - mean[0].astype(np.int64)
        # n * far - small; in Python integers where a square sum could pass 63 bits
        if 2 * (_bits(far) + n.bit_length() + 1) + len(sums).bit_length() < 63:
            each = far * n - np.array(small, np.int64)
            return (each * each).sum(axis=1)
        each = far.astype(object) * n - np.array(small, object)
        return np.array([int(s) for s in (each * each).sum(axis=1)], object)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(lo, BLOCK)
                x = _matrix(rows.column("x"))
                y = _centred(x, mean) @ weights
                flat = pa.array(y.ravel())
                yield pa.RecordBatch.from_pydict({
                    "vec_id": rows.column("vec_id"), "deviation": pa.array(deviations(x).tolist(), pa.int64()),
                    "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), flat)})

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, deviation long, whitened array<double>")


def whitened_components(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = integer_vectors(rows)
    model = fit(vectors, components)
    kind = dict(rows.dtypes)["vec_id"]
    if model is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                                     "explained double, identity_error double")
    error = identity_error(vectors, model)
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.moments.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
