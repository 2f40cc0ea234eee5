"""Embedding whitening by an incremental eigendecomposition.

Every partition of the distinct vectors keeps one spectrum, the eigenpairs of its scatter matrix, and takes each
vector in as a centred rank-one update: the eigenvalues that the update moves are roots of a secular equation, those
that it does not move are deflated. Two spectra are one by as many rank-one updates as the second has eigenpairs, and
one more for the distance of their means; sixteen at a time, so no task and no driver holds more than sixteen. The last
spectrum is a basis only: a distributed Rayleigh-Ritz step (the covariance in that basis, summed over all partitions)
settles the components to double precision. What the driver sees is as large as the dimension, never as the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm._common import forget, give_back, materialise

EPS = np.finfo(float).eps
#: Spectra or sums that one task merges at a time.
FAN_IN = 16
#: Updates after which a basis is made orthonormal again.
REFRESH = 500
SCALE, SHIFT = 64, 1_000_000
RESULT = "`{id}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(z2 / (d - root)) = 0 for rising poles ``d`` and positive ``z2``, and each pole minus each root.

    A root is kept as its distance from the nearer pole, so that differences from poles are exact to the last bits.
    """
    n = len(d)
    if n == 1:
        return d + z2, -z2[None, :].copy()
    gap = np.append(np.diff(d), z2.sum())
    row = np.arange(n)
    middle = z2 / (d[None, :] - (d + gap / 2)[:, None])
    rest = 1 + middle.sum(1)
    left = rest >= 0
    far = ~left & (row < n - 1)
    near = row + far
    lo = np.where(left, 0.0, np.where(far, -gap / 2, gap / 2))
    hi = np.where(left, gap / 2, np.where(far, 0.0, gap))
    off = d[None, :] - d[near][:, None]
    # a first guess: the two nearest poles as they are, all others as they count in the middle
    z_next = np.append(z2[1:], 0.0)
    c = rest - middle[row, row] - np.append(middle[row[:-1], row[1:]], 0.0)
    a, b = c * gap + z2 + z_next, z2 * gap
    with np.errstate(all="ignore"):
        root = np.sqrt(np.abs(a * a - 4 * b * c))
        guess = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c)) - np.where(far, gap, 0.0)
    tau = np.where((guess > lo) & (guess < hi), guess, (lo + hi) / 2)
    todo = row  # the roots that have not settled
    for _ in range(80):
        away = off[todo] - tau[todo, None]
        part = z2 / away
        total = part.sum(1)
        f = 1 + total
        size = 1 + np.abs(part).sum(1)
        still = np.abs(f) > 4 * EPS * size
        if not still.any():
            break
        todo, away, part, f = todo[still], away[still], part[still], f[still]
        low = np.where(f < 0, tau[todo], lo[todo])
        high = np.where(f < 0, hi[todo], tau[todo])
        lo[todo], hi[todo] = low, high
        slope = part / away
        sums = np.cumsum(slope, axis=1)
        at, place = np.minimum(todo, n - 2), np.arange(len(todo))
        da, db, psi, both = away[place, at], away[place, at + 1], sums[place, at], sums[:, -1]
        a = (da + db) * f - da * db * both
        b = da * db * f
        c = f - da * psi - db * (both - psi)
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            end = todo == n - 1  # beyond both poles: the other solution
            a, b, c, root = np.where(end, -a, a), np.where(end, -b, b), np.where(end, -c, c), root
            new = tau[todo] + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        moved = new != tau[todo]
        tau[todo] = new
        todo = todo[moved]
        if not len(todo):
            break
    return d[near] + tau, off - tau[:, None]


def secular_update(lam: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(lam) + rho z z' for rho > 0, by its secular equation.

    Deflated first: entries of ``z`` too small to move a pole, and one of two poles too close to tell apart, turned so
    that only the other meets the update. The rest of ``z`` is recomputed from the roots, which keeps the vectors
    orthogonal however close the roots are.
    """
    order = np.argsort(lam, kind="stable")
    d, z = lam[order].copy(), z[order].copy()
    n = len(d)
    turn = np.eye(n)[:, order]  # columns: the sorted basis in the old one
    norm = np.linalg.norm(z)
    tol = 8 * EPS * max(np.abs(d).max(initial=0.0), rho * norm * norm)
    keep = rho * np.abs(z) * norm > tol
    held = np.flatnonzero(keep)
    if len(held) > 1:
        za, zb = z[held[:-1]], z[held[1:]]
        if (np.diff(d[held]) * np.abs(za * zb) <= tol * (za * za + zb * zb)).any():
            last = held[0]
            for i in held[1:]:
                h = np.hypot(z[last], z[i])
                c, s = z[i] / h, -z[last] / h
                if abs((d[i] - d[last]) * c * s) <= tol:
                    z[i], z[last], keep[last] = h, 0.0, False
                    x, y = turn[:, last].copy(), turn[:, i].copy()
                    turn[:, last], turn[:, i] = c * x + s * y, c * y - s * x
                    d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                last = i
            held = np.flatnonzero(keep)
    if not len(held):
        return d, turn
    poles = d[held]
    again = np.argsort(poles, kind="stable")
    held, poles = held[again], poles[again]
    root, away = _roots(poles, rho * z[held] ** 2)
    ratio = poles[:, None] - poles[None, :]
    np.fill_diagonal(ratio, 1.0)
    fresh = np.sqrt(np.abs((-away / ratio).prod(0)) / rho) * np.sign(z[held])
    vectors = (fresh[None, :] / away).T
    vectors /= np.linalg.norm(vectors, axis=0)
    d[held] = root
    turn[:, held] = turn[:, held] @ vectors
    return d, turn


class Spectrum:
    """Count, exact sums and the eigenpairs of the scatter matrix of the vectors taken in so far."""

    def __init__(self, dim: int) -> None:
        self.n, self.total = 0, np.zeros(dim, np.int64)
        self.lam, self.basis, self.updates = np.zeros(0), np.zeros((dim, 0)), 0

    def _update(self, v: np.ndarray, rho: float) -> None:
        length = np.linalg.norm(v)
        if not length or rho <= 0:
            return
        z = self.basis.T @ v
        rest = v - self.basis @ z
        more = self.basis.T @ rest
        z, rest = z + more, rest - self.basis @ more
        far = np.linalg.norm(rest)
        if self.basis.shape[1] < len(v) and far > 1e-12 * length:
            self.basis = np.column_stack([self.basis, rest / far])
            self.lam, z = np.append(self.lam, 0.0), np.append(z, far)
        self.lam, turn = secular_update(self.lam, z, rho)
        self.basis = self.basis @ turn
        self.updates += 1
        if self.updates % REFRESH == 0:
            self.basis = orthonormal(self.basis)

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self._update((self.n * x - self.total) / self.n, self.n / (self.n + 1))
        self.n, self.total = self.n + 1, self.total + x

    def merge(self, other: Spectrum) -> None:
        if self.n and other.n:
            apart = other.total / other.n - self.total / self.n
            self._update(apart, self.n * other.n / (self.n + other.n))
        for value, vector in zip(other.lam, other.basis.T, strict=True):
            self._update(vector, value)
        self.n, self.total = self.n + other.n, self.total + other.total

    def row(self) -> dict:
        return {"n": self.n, "total": self.total.tobytes(), "lam": self.lam.tobytes(), "basis": orthonormal(self.basis).tobytes()}

    @classmethod
    def of(cls, row) -> Spectrum:
        out = cls(len(row.total) // 8)
        out.n, out.total, out.lam = int(row.n), np.frombuffer(row.total, np.int64), np.frombuffer(row.lam)
        out.basis = np.frombuffer(row.basis).reshape(len(out.total), len(out.lam))
        return out


def orthonormal(basis: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(basis)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _folded(parts: DataFrame, merge: Callable[[pd.DataFrame], dict], tag: str):
    """The one row that rows of (part, ...) merge into, ``FAN_IN`` neighbours at a time; None without rows."""
    names, parts = parts.columns, materialise(parts, tag)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        return pd.DataFrame([{"part": int(frame["part"].iloc[0]) // FAN_IN, **merge(frame)}])[names]

    while parts.count() > 1:
        fewer = parts.groupBy(F.expr(f"part div {FAN_IN}").alias("g")).applyInPandas(one, parts.schema)
        before, parts = parts, materialise(fewer, tag)
        forget(before)
    row = parts.first()
    forget(parts)
    return row


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): entries as whole numbers, floor(64 c) + 1000000. Vectors that are null, empty or hold a null or non-finite entry go."""
    vec = F.col("v")
    finite = F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    edge = float(1 << 41)  # what lies beyond is refused later, and would not fit a long
    x = F.transform(vec, lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), F.lit(float(SCALE)) * c.cast("double")))) + F.lit(SHIFT).cast("long"))
    kept = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(vec.isNotNull() & (F.size(vec) > 0) & finite)
    return kept.select("id", x.alias("x"))


def fit_spectrum(fit: DataFrame, dim: int):
    """The merged spectrum of the vectors ``x`` of ``fit``; None without rows."""

    def updates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = Spectrum(dim), 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            for x in _matrix(batch.column(1), dim):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_pylist([{"part": part, **own.row()}], schema=schema)
        give_back()

    def merge(frame: pd.DataFrame) -> dict:
        own = Spectrum(dim)
        for row in frame.itertuples():
            own.merge(Spectrum.of(row))
        return own.row()

    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("total", pa.binary()), ("lam", pa.binary()), ("basis", pa.binary())])
    kind = "part bigint, n bigint, total binary, lam binary, basis binary"
    row = _folded(fit.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(updates, kind), merge, "spectra")
    return Spectrum.of(row) if row else None


def projected_covariance(fit: DataFrame, basis: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance (divisor ``n``) of centred ``x`` times ``basis``, and the trace of the whole covariance."""
    dim, k = basis.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, trace, part, rows = np.zeros((k, k)), 0.0, 0, 0
        for batch in batches:
            rows, part = rows + batch.num_rows, batch.column(0)[0].as_py() if batch.num_rows else part
            y = (n * _matrix(batch.column(1), dim) - total) / n
            trace += float((y * y).sum())
            y = y @ basis
            gram += y.T @ y
        if rows:
            yield pa.RecordBatch.from_pylist([{"part": part, "gram": gram.tobytes(), "trace": trace}], schema=schema)

    def merge(frame: pd.DataFrame) -> dict:
        return {"gram": sum(np.frombuffer(g) for g in frame["gram"]).tobytes(), "trace": float(frame["trace"].sum())}

    schema = pa.schema([("part", pa.int64()), ("gram", pa.binary()), ("trace", pa.float64())])
    cut = fit.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(sums, "part bigint, gram binary, trace double")
    row = _folded(cut, merge, "sums")
    return np.frombuffer(row.gram).reshape(k, k) / n, row.trace / n


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """A row for each remaining vector and component, numbered from 1 by falling eigenvalue: whitened entry, share of the trace.

    Vectors are quantised (see :func:`quantised`); the covariance is that of the distinct ones, so copies weigh once, yet
    every row gets its result. ``deviation`` is the exact sum of squares of n x - S. Components with an eigenvalue of nothing
    (rank below ``components``) do not exist: a table of one distinct vector, or an empty one, has no rows in the result.
    Null ids stay null; only the two columns are read. Vectors of different lengths raise a ValueError, entries beyond
    2^40 an OverflowError. Equal eigenvalues have some orthonormal basis of their space, the same for all rows.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vec_col)
    fit = materialise(rows.select("x").distinct(), "vectors")
    short, long, largest, n = fit.agg(
        F.min(F.size("x")), F.max(F.size("x")), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))), F.count("*")
    ).first()
    schema = RESULT.format(id=id_col, kind=df.schema[id_col].dataType.simpleString())
    if short != long:
        raise ValueError(f"vectors have {short} to {long} entries")
    if n and (largest >= 1 << 40 or n * largest >= 1 << 62):
        raise OverflowError("entries are too large for exact sums")
    spectrum = fit_spectrum(fit, long) if n else None
    if spectrum is None or not len(spectrum.lam):
        return spark.createDataFrame([], schema)
    total = spectrum.total
    basis = orthonormal(spectrum.basis[:, np.argsort(-spectrum.lam)])
    ritz, trace = projected_covariance(fit, basis, n, total)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values)[:components]
    order = order[values[order] > 1e-13 * values.max()]
    scaled = (basis @ turn[:, order]) / np.sqrt(values[order])
    identity, _ = projected_covariance(fit, scaled, n, total)
    forget(fit)
    error = float(np.abs(identity - np.eye(len(order))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = n * _matrix(batch.column(1), long) - total
            if not len(apart):
                continue
            if long * float(np.abs(apart).max()) ** 2 < 1 << 62:
                squares = (apart * apart).sum(1)
            else:
                squares = (apart.astype(object) ** 2).sum(1)
            white = (apart / n) @ scaled
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, len(order), dtype=np.int32), white.ravel())
            text = pa.array([str(int(v)) for v in squares])
            yield pa.RecordBatch.from_arrays([batch.column(0), text, lists], ["id", "deviation", "w"])

    kind = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("deviation", T.StringType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    explained = F.array(*[F.lit(float(v)) for v in values[order] / trace])
    out = rows.mapInArrow(project, kind).select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(int(n)).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
