"""Whitening of embeddings by their leading covariance components.

Vectors become whole numbers first (``floor(scale * c) + offset``), so that sums
over them are exact, in any order and after any retry.  One scan sums them; a
second sums the products of what is centred on the whole part of the mean, and
the fraction of the mean is taken off exactly on the driver, which only ever
holds matrices of the vectors' dimension.

The components come by FEAST contour integration.  The spectrum is sliced into
intervals of a few eigenvalues; inertia counts (the signs of the pivots of a
symmetric factorisation of ``V - s I``) say how many each must hold.  Every
interval is a row of a DataFrame and is solved in a task of its own: quadrature
over a circle of complex shifted solves ``(z I - V)^-1 Y`` projects a subspace
onto the interval, Rayleigh-Ritz extracts eigenpairs from it, and this is
repeated until their residuals stand at rounding.  An interval that does not
yield as many as inertia counted is an error, never a gap.

A third scan measures the covariance of the whitened rows; the last one yields
them.

Defined results: rows whose vector is null, shorter than the longest, or has a
null, non-finite or too large entry (2**40 or more) are dropped;
rows with a null id and repeated rows are kept and count each; components whose
eigenvalue is zero within rounding have no whitened values and are left out, so
one row, equal rows and an empty table give no rows; of equal eigenvalues any
basis may come, the same for all rows; the largest entry of a component is
positive; a deviation beyond 38 digits is null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Entries from this size on are too large for exact sums of squares.
LIMIT = 2.0**40
#: Eigenvalues an interval may hold before it is sliced again; nodes of the quadrature on half a circle.
SLICE, NODES, ROUNDS = 8, 8, 60
#: Narrower intervals, as a share of the spectrum, are not sliced: vectors from either side of a small gap would not be orthogonal.
NARROW = 1e-4
EPS = float(np.finfo(float).eps)


def vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, x`` of the rows to use, ``x`` as array of doubles."""
    x = F.col(vector).cast("array<double>")
    usable = rows.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where(
        F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)) & ~F.isnan(c))
    )
    return usable


def whole(batch: pa.RecordBatch, scale: int, offset: int, d: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of dimension ``d`` and their vectors in whole numbers."""
    batch = batch.filter(pc.equal(pc.list_value_length(batch.column("x")), d))
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return batch, np.floor(scale * flat).astype(np.int64) + offset


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y' y`` of whole numbers, as Python integers."""
    most = int(np.abs(y).max(initial=0))
    if len(y) * most * most < 2**53:  # every partial sum is a double's whole number
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _pieces(batches, scale: int, offset: int, d: int, rows: int = 8192):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield whole(batch.slice(k, rows), scale, offset, d)


def _summed(usable: DataFrame, scale: int, offset: int, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum per dimension."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for _, x in _pieces(batches, scale, offset, d):
            n += len(x)
            total += x.astype(object).sum(axis=0) if len(x) * (int(np.abs(x).max(initial=0))) >= 2**62 else x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, d), pa.int32()), "s": [str(n), *map(str, total)]})

    got = usable.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).toPandas()
    by = dict(zip(got["i"], got["s"]))
    return int(by.get(-1) or 0), [int(by[i]) for i in range(d)] if by else []


def _multiplied(usable: DataFrame, scale: int, offset: int, centre: np.ndarray) -> np.ndarray:
    """Exact sums of the products of ``x - centre``."""
    d = len(centre)

    def run(batches):
        total = np.zeros((d, d), object)
        for _, x in _pieces(batches, scale, offset, d):
            total += exact_products(x - centre)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": [str(v) for v in total[i, j]]})

    got = usable.select("x").mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).toPandas()
    out = np.zeros((d, d), object)
    for i, j, s in zip(got["i"], got["j"], got["s"]):
        out[i, j] = out[j, i] = int(s)
    return out


def covariance(products: np.ndarray, n: int, rest: np.ndarray) -> np.ndarray:
    """The covariance from products about the whole part of the mean; ``rest`` is n times the mean's fraction."""
    over = products * n - np.outer(rest, rest)
    return np.array([[int(v) / (n * n) for v in row] for row in over])


def inertia(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: the signs of the pivots of its factorisation.

    Pivots of one or two rows are chosen over the whole remaining matrix; one of two always has a sign of each kind.
    """
    a, positive = np.array(a, float), 0
    bound = (1 + 17**0.5) / 8
    while len(a):
        size = np.abs(a)
        i = int(np.argmax(np.diag(size)))
        p, q = np.unravel_index(int(np.argmax(size)), size.shape)
        if size[p, q] == 0:
            break
        pivot = [i] if size[i, i] >= bound * size[p, q] else [int(p), int(q)]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        block, off = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        positive += 1 if len(pivot) == 2 else int(block[0, 0] > 0)
        a = a[np.ix_(rest, rest)] - off @ np.linalg.solve(block, off.T)
        a = (a + a.T) / 2
    return positive


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals with their inertia counts, highest first, that hold the ``wanted`` largest eigenvalues of ``v``.

    Ends are laid where no eigenvalue is near; a dense cluster that leaves no such place stays whole.
    """
    d = len(v)
    reach = float(np.abs(v).sum(axis=1).max())
    above = lambda s: inertia(v - s * np.eye(d))
    found, left = [], [(-1e-3 * reach, 1.001 * reach, d)]
    while left and sum(k for *_, k in found) < wanted:
        low, high, k = left.pop()
        cut = None
        if k > SLICE and high - low > NARROW * reach:
            over = sum(m for *_, m in found)
            for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):
                s, near = low + part * (high - low), 1e-3 * (high - low)
                if (n := above(s - near)) == above(s + near):
                    cut = s, n - over
                    break
        if cut is None:
            found += [(low, high, k)] if k else []
        else:
            s, n = cut
            left += [(low, s, k - n), (s, high, n)]
    return found


def contour(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs of ``v`` between ``low`` and ``high``, which must be ``count``."""
    d = len(v)
    scale = max(float(np.abs(v).sum(axis=1).max()), np.finfo(float).tiny)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 + nodes))
    middle, radius = (low + high) / 2, (high - low) / 2
    m = min(d, count + max(4, count // 2))
    rng = np.random.RandomState(11)
    y = rng.normal(size=(d, m))
    best = np.inf
    for _ in range(ROUNDS):
        q = np.zeros((d, m))
        for t, w in zip(turn, weights):
            q += w / 2 * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - v, y.astype(complex))).real
        q, _ = np.linalg.qr(np.concatenate((q, rng.normal(size=(d, m)) * EPS), axis=1))
        q = q[:, :m]
        e, u = np.linalg.eigh(q.T @ v @ q)
        y = q @ u
        error = np.abs(v @ y - y * e).max(axis=0)
        inside = np.flatnonzero((e > low) & (e < high))
        inside = np.sort(inside[np.argsort(error[inside], kind="stable")][:count])  # others are mixtures from both sides
        worst = float(error[inside].max(initial=0.0)) if len(inside) == count else np.inf
        if worst <= 64 * EPS * scale and worst >= best / 2:
            return e[inside], y[:, inside]  # at rounding, and no longer falling
        best = min(best, worst)
        if len(inside) < count and m < d:
            m = min(d, 2 * m)
            y = np.concatenate((y, rng.normal(size=(d, m - y.shape[1]))), axis=1)
    raise ArithmeticError(f"{len(inside)} eigenvalues found of the {count} that inertia counts between {low} and {high}, residual {worst}")


def components(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of ``v`` that are not zero within rounding, falling, and their unit vectors."""
    d = len(v)
    parts = intervals(v, wanted)
    if not parts:
        return np.zeros(0), np.zeros((d, 0))
    sent = spark.sparkContext.broadcast(v)

    def solve(pdfs):
        for pdf in pdfs:
            for low, high, count in pdf.itertuples(index=False):
                e, u = contour(sent.value, low, high, int(count))
                yield pd.DataFrame({"e": e, "u": list(u.T)})

    rows = spark.createDataFrame(parts, "low double, high double, count int").repartition(len(parts), "low")
    got = rows.mapInPandas(solve, "e double, u array<double>").toPandas().sort_values("e", ascending=False, kind="stable")
    e, u = got["e"].to_numpy()[:wanted], np.stack(got["u"].to_list())[:wanted].T
    some = e > 16 * d * EPS * max(e.max(), 0.0)
    e, u = e[some], u[:, some]
    return e, u * np.sign(u[np.argmax(np.abs(u), axis=0), np.arange(u.shape[1])])


def deviations(y: np.ndarray, n: int, rest: np.ndarray) -> np.ndarray:
    """Per row, the exact sum of ``(n y - rest)^2``."""
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    if most * most * y.shape[1] < 2**63:
        z = n * y - rest.astype(np.int64)
        return (z * z).sum(axis=1).astype(object)
    z = n * y.astype(object) - rest
    return (z * z).sum(axis=1)


def whiten(rows: DataFrame, count: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per usable row and component."""
    spark = rows.sparkSession
    usable = vectors(rows, vec_id, vector)
    d = usable.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    n, total = _summed(usable, scale, offset, d) if d > 0 else (0, [])
    schema = f"vec_id {dict(usable.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    centre = np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], object)
    v = covariance(_multiplied(usable, scale, offset, centre), n, rest)
    e, u = components(spark, v, min(count, d)) if v.any() else (np.zeros(0), np.zeros((d, 0)))
    if not len(e):
        return spark.createDataFrame([], schema)
    fraction, onto = np.array([r / n for r in rest]), u / np.sqrt(e)
    projected = lambda x: ((x - centre) - fraction) @ onto

    def squares(batches):
        sums, products = np.zeros(len(e)), np.zeros((len(e), len(e)))
        for _, x in _pieces(batches, scale, offset, d):
            w = projected(x)
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        i, j = np.indices((len(e) + 1, len(e)))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": np.vstack((products, sums)).ravel()})

    got = usable.select("x").mapInArrow(squares, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    measured = np.zeros((len(e) + 1, len(e)))
    measured[got["i"], got["j"]] = got["s"]
    mean = measured[-1] / n
    error = float(np.abs(measured[:-1] / n - np.outer(mean, mean) - np.eye(len(e))).max())
    explained = e / np.trace(v)

    def rows_of(batches):
        k = len(e)
        for batch, x in _pieces(batches, scale, offset, d, 2048):
            exact = [None if abs(v) >= 10**38 else str(v) for v in deviations(x - centre, n, rest)]
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(exact, pa.string()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(projected(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    out = usable.mapInArrow(rows_of, schema.replace("decimal(38,0)", "string"))
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 leading components; a deviation that no long holds is null."""
    return whiten(C.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
#: Eigenvectors are beyond SQL.
ORACLES: dict[str, str] = {}
