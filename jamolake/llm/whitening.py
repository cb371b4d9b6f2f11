"""Whitening of embeddings by QDWH spectral divide-and-conquer.

The table is read in three aggregating passes (sums, centred second moments, the audit) and a
last one that whitens. Tasks add up whole numbers, exactly, so neither partitions nor lost
executors change a digit of the covariance. What reaches the driver is one covariance for each
vector length, d * d numbers however many rows there are.

Its eigenvectors come from polar decompositions: the unitary polar factor of V - shift * I has
eigenvalues of +1 and -1, so (U + I) / 2 projects onto the invariant subspace above the shift.
Both subspaces are split in turn until they are lines. The projection matrix is then broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shuffles_freed, table

COMPONENTS = 8
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Rows that a task holds as numbers at once.
ROWS = 4096
#: Entries from here on (of SCALE * c) have no exact place in a double; their vectors are dropped.
MOST = 2.0**53
#: Longest vector whose d * d matrix the driver takes.
MOST_DIM = 8192
_LIMB = 40
_WIDE = Context(prec=80)


# --- polar decomposition and spectral divide-and-conquer (driver, d x d) ------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by the dynamically weighted Halley iteration in
    its inverse-free (QR) form; cubic from any condition, at most about seven steps."""
    m = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return np.eye(m)
    x, low, eye = a / norm, 1e-17, np.eye(m)
    for _ in range(20):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wa = math.sqrt(1 + d) + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * math.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:m] @ q[m:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved, x = np.linalg.norm(new - x), new
        if low > 1 - 1e-15 and moved < 1e-10:
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[float, int, np.ndarray] | None:
    """(what couples the two subspaces, size of the upper one, orthonormal basis: upper first)."""
    m = len(a)
    up = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
    k = round(float(np.trace(up)))
    if not 0 < k < m:
        return None
    start = np.random.default_rng(m).standard_normal((m, m))
    v1, v2 = start[:, :k], start[:, k:]
    for _ in range(2):
        v1, v2 = np.linalg.qr(up @ v1)[0], np.linalg.qr(v2 - up @ v2)[0]
    q = np.linalg.qr(np.hstack([v1, v2]))[0]
    return float(np.linalg.norm(q[:, k:].T @ a @ q[:, :k])), k, q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors in columns) of a symmetric matrix. The largest entry of a
    vector (the first of equal ones) is positive. A subspace whose eigenvalues agree to rounding keeps
    any basis of it."""
    m = len(a)
    a = (a + a.T) / 2
    size = np.linalg.norm(a)
    basis, todo, done = np.eye(m), [(0, m)], []
    while todo:
        at, to = todo.pop()
        q = basis[:, at:to]
        b = q.T @ a @ q
        b = (b + b.T) / 2
        middle = float(np.trace(b)) / (to - at)
        spread = np.linalg.norm(b - middle * np.eye(to - at)) / math.sqrt(to - at)
        if to - at == 1 or spread <= 4e-16 * size:
            done.append((at, to))
            continue
        best = None
        # the median halves the work; some eigenvalue lies on each side of the mean; the others serve
        # where an eigenvalue is so near a shift that its side is in doubt
        for shift in (float(np.median(np.diag(b))), *(middle + t * spread for t in (0, 0.31, -0.31, 0.17, -0.17, 0.05, -0.05, 0.6, -0.6, 0.9, -0.9))):
            found = _halves(b, shift)
            if found and (best is None or found[0] < best[0]):
                best = found
            if best and best[0] <= 1e-15 * math.sqrt(m) * size:
                break
        if best is None:
            done.append((at, to))
            continue
        _, k, turn = best
        basis[:, at:to] = q @ turn
        todo += [(at, at + k), (at + k, to)]
    basis = _refined(a, np.linalg.qr(basis)[0])
    values = np.einsum("ij,ij->j", basis, a @ basis)
    order = np.argsort(-values, kind="stable")
    basis = basis[:, order]
    return values[order], basis * np.where(basis[np.argmax(np.abs(basis).round(12), axis=0), np.arange(m)] < 0, -1.0, 1.0)


def _refined(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One first-order correction of all eigenvectors by what still couples them. Directions whose
    eigenvalues agree to rounding are left as they are."""
    b = q.T @ a @ q
    gap = np.diag(b)[None, :] - np.diag(b)[:, None]
    turn = np.where(np.abs(gap) > 1e-12 * np.linalg.norm(a), b, 0.0) / np.where(gap == 0, 1.0, gap)
    np.fill_diagonal(turn, 0)
    if np.abs(turn).max(initial=0) > 1e-3:
        return q
    return np.linalg.qr(q + q @ turn)[0] * np.sign(np.diag(np.linalg.qr(q + q @ turn)[1]))


# --- exact sums in tasks ------------------------------------------------------------------------

def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, entries as doubles), by vector length; only vectors that are not null
    and whose entries are all there, finite and below MOST."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
        values = flat.reshape(len(at), d)
        with np.errstate(invalid="ignore", over="ignore"):
            good = (np.abs(values * SCALE) < MOST).all(axis=1)
        if good.any():
            yield at[good], values[good]


def _whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values * SCALE).astype(np.int64) + OFFSET


def _products(y: np.ndarray) -> np.ndarray:
    """Sum of y_i * y_j over rows, exactly: in doubles as long as all sums stay below 2^53, in limbs
    of 20 bits beyond, added up as Python numbers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    limbs = [y & 0xFFFFF, (y >> 20) & 0xFFFFF, y >> 40]
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for i, u in enumerate(limbs):
        for j, v in enumerate(limbs):
            out += (u.astype(np.float64).T @ v.astype(np.float64)).astype(np.int64).astype(object) << (20 * (i + j))
    return out


def _sums(vectors: DataFrame, what) -> dict[int, tuple[int, list[list[int]]]]:
    """For each vector length: (number of vectors, what(d, x) added up over all of them). A task sends
    one row for each entry; high and low limbs are added apart in decimals, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                for _, values in _vectors(b.column(0).slice(at, ROWS)):
                    d = values.shape[1]
                    got = what(d, _whole(values))
                    have = total.setdefault(d, [0, np.zeros_like(got)])
                    have[0] += len(values)
                    have[1] = have[1] + got
        for d, (n, sums) in total.items():
            flat = [n, *sums.ravel().tolist()]
            for cut in range(0, len(flat), 100_000):
                part = flat[cut : cut + 100_000]
                cols = [[v >> _LIMB for v in part], [v & ((1 << _LIMB) - 1) for v in part]]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(part), pa.int32()), pa.array(range(cut, cut + len(part)), pa.int64()), *(pa.array([Decimal(v) for v in c], pa.decimal128(38, 0)) for c in cols)], ["dim", "place", "high", "low"])

    parts = vectors.mapInArrow(run, "dim int, place long, high decimal(38,0), low decimal(38,0)")
    with shuffles_freed(vectors.sparkSession, ROWS):
        rows = parts.groupBy("dim", "place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toPandas()
    out = {}
    for d, group in rows.groupby("dim"):
        group = group.sort_values("place")
        flat = [(int(h) << _LIMB) + int(low) for h, low in zip(group.high, group.low)]
        out[int(d)] = (flat[0], flat[1:])
    return out


@dataclass
class Whitener:
    """What one vector length was fitted to. mean: sums and n as whole numbers; directions: unit
    eigenvectors in columns; values: their eigenvalues; trace: of the covariance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def middle(self) -> np.ndarray:
        """Means rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def live(self) -> np.ndarray:
        """Components that have a variance (beyond rounding of the largest one's)."""
        return self.values > 1e-13 * max(self.values.max(initial=0.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles; the whole part of the difference is exact."""
        rest = np.array([float(Fraction(s, self.n) - int(m)) for s, m in zip(self.sums, self.middle)])
        return (x - self.middle).astype(np.float64) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; nan where a component has no variance. einsum adds in the same order however
        many rows there are, which a matrix product does not."""
        across = np.einsum("ij,kj->ik", self.centred(x), np.ascontiguousarray(self.directions.T))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, across / np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exactly."""
        y, rest = x - self.middle, np.array([s - self.n * int(m) for s, m in zip(self.sums, self.middle)], dtype=object)
        reach = self.n * int(np.abs(y).max(initial=0)) + self.n
        if reach < 2**62:
            z = self.n * y - rest.astype(np.int64)
            if reach * reach * max(1, x.shape[1]) < 2**62:
                return (z * z).sum(axis=1).tolist()
            limbs = [z & 0x1FFFFF, (z >> 21) & 0x1FFFFF, z >> 42]
            return [sum(v << (21 * k) for v, k in zip(row, _SHIFTS)) for row in zip(*((limbs[i] * limbs[j]).sum(axis=1).tolist() for i, j in _PAIRS))]
        z = self.n * y.astype(object) - rest
        return (z * z).sum(axis=1).tolist()


_PAIRS = [(i, j) for i in range(3) for j in range(3)]
_SHIFTS = [i + j for i, j in _PAIRS]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A Whitener for each vector length of a one-column table. Sums and second moments, centred at the
    whole number next to the mean before they are multiplied, are exact, so V is rounded once."""
    sums = {d: (n, s) for d, (n, s) in _sums(vectors, lambda d, x: x.sum(axis=0).astype(object) if len(x) * int(np.abs(x).max(initial=0)) < 2**62 else x.astype(object).sum(axis=0)).items() if d}
    if max(sums, default=0) > MOST_DIM:
        raise ValueError(f"vectors of more than {MOST_DIM} entries: their covariance is too large for the driver")
    middles = {d: np.array([(2 * v + n) // (2 * n) for v in s], dtype=np.int64) for d, (n, s) in sums.items()}
    moments = _sums(vectors, lambda d, x: _products(x - middles[d]) if d else np.zeros(0, dtype=object))
    out = {}
    for d, (n, s) in sums.items():
        rest = [v - n * int(m) for v, m in zip(s, middles[d])]
        m = moments[d][1]
        v = np.array([[float(Fraction(n * m[i * d + j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
        values, directions = eigen(v)
        k = min(components, d)
        out[d] = Whitener(n, s, directions[:, :k], np.maximum(values[:k], 0.0), float(np.trace(v)))
    shared = vectors.sparkSession.sparkContext.broadcast(out)
    for d, (n, total) in _sums(vectors, lambda d, x: _audit(shared.value[d], x) if d else np.zeros(0, dtype=object)).items():
        if d:
            w, k = out[d], min(components, d)
            cov = np.array([v / (_STEP * n) for v in total[: k * k]]).reshape(k, k) - np.outer(*[[v / (_STEP * n) for v in total[k * k :]]] * 2)
            live = np.flatnonzero(w.live)
            w.identity_error = round(float(np.abs((cov - np.eye(k))[np.ix_(live, live)]).max()), 12) if len(live) else None
    return out


#: The audit's sums are counted in steps this fine, so that their order changes nothing; what batches
#: change in a product's last digits goes with rounding to 12 places.
_STEP = 1 << 40


def _audit(w: Whitener, x: np.ndarray) -> np.ndarray:
    """Products of whitened values, and their sums, in whole steps of a batch's sum."""
    y = np.nan_to_num(w.whiten(x))
    return np.array([round(float(v) * _STEP) for v in [*(y.T @ y).ravel(), *y.sum(axis=0)]], dtype=object)


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """df's usable rows with n, deviation (decimal(38,0), null where it has more digits), whitened and
    explained (arrays by component) and identity_error.

    Rows whose vector is null or has null or non-finite entries (or entries of 2^53 / SCALE and more)
    are dropped. Repeated rows count as often as they are there. Vectors of different lengths are
    fitted apart; empty ones give empty arrays. A component without variance has null whitened values
    and takes no part in identity_error, which is null if no component has any. An empty table gives
    no rows. Columns that clash with the new ones are replaced; all others are kept as they are."""
    spark = df.sparkSession
    model = fit(df.select(F.col(vector)), components)
    shared = spark.sparkContext.broadcast(model)
    new = {"n": "long", "deviation": "decimal(38,0)", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new or c == vector])
    source = kept.columns.index(vector)
    fresh = [c for c in kept.columns if c.lower() not in new]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                piece = b.slice(start, ROWS)
                for at, values in _vectors(piece.column(source)):
                    yield _rows(shared.value, piece.take(pa.array(at)), values, fresh)

    return kept.mapInArrow(run, f"{schema}, " + ", ".join(f"{k} {v}" for k, v in new.items()))


def _rows(model: dict[int, Whitener], rows: pa.RecordBatch, values: np.ndarray, fresh: list[str]) -> pa.RecordBatch:
    m, d = values.shape
    w = model.get(d)
    if w is None:  # empty vectors
        n, deviation, k, whitened, explained, error = None, [0] * m, 0, np.zeros((m, 0)), np.zeros(0), None
    else:
        x = _whole(values)
        n, deviation, whitened, error = w.n, w.deviations(x), w.whiten(x), w.identity_error
        k, explained = whitened.shape[1], w.values / w.trace if w.trace > 0 else np.zeros(whitened.shape[1])
    offsets = pa.array(np.arange(m + 1, dtype=np.int32) * k)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel(), from_pandas=True, type=pa.float64())), pa.ListArray.from_arrays(offsets, pa.array(np.tile(explained, m), pa.float64()))]
    wide = pa.array([_WIDE.create_decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in fresh), pa.array([n] * m, pa.int64()), wide, *lists, pa.array([error] * m, pa.float64())], [*fresh, "n", "deviation", "whitened", "explained", "identity_error"])


def op11_whitening(spark, sf_dir):
    """A row for each usable vector and component; deviation is null beyond 64 bits."""
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
