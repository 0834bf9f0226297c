"""Whitening of vectors: distributed covariance, float32 eigenvectors, refined in double precision.

Components of a vector become whole numbers ``floor(scale * c) + shift``, so sums over the fit list, each distinct
vector once, are exact. A second pass centres every vector before multiplying and adds up the covariance by rows,
each row in one place. Its eigenvectors are found in float32 and corrected by the matrix-multiplication iteration
of Ogita and Aishima in double precision: the residuals of orthogonality and of diagonality give every vector's
correction at once, and the error is squared in each round. Eigenvalues that lie closer together than the
residuals can tell are a cluster: there only orthogonality is corrected, and a small eigenvalue problem, shifted by
the cluster's mean, turns its vectors into place before the next round.

Rows whose vector is null, empty, holds a null or non-finite component, or one that leaves the range of a long
after scaling, take no part. All vectors of a fit have one length: the most frequent among usable rows, of equally
frequent ones the longest; other rows take no part. Repeated rows and rows with a null id are whitened like any
other. Components without variance (at most ``RANK`` of the trace) have no direction and are left out, so fewer
than ``components`` rows come for few, short or constant vectors, and none for one vector or an empty table.
``deviation`` is null where it does not fit into a long. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from linkfold.llm.common import written

#: Rows that a task centres and multiplies at once.
ROWS = 4096
#: Share of the trace below which a component counts as having no variance.
RANK = 1e-12
#: |scale * c| and the shift stay below this, so that differences fit into a long.
REACH = 2.0**61
_LOW = 31


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """(id, x) of usable rows, x an array of longs of the most frequent length."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(scale)) < F.lit(REACH)))
    kept = vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(usable, F.lit(False)))
    size = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).first()
    rows = kept.select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(scale)) + F.lit(shift).cast("long")).alias("x"))
    return rows.filter(F.size("x") == (size["d"] if size else 0))


def _chunks(batches):
    """Batches cut to ROWS rows, each with its vectors as a matrix of longs."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield part, part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


@dataclass
class Centre:
    """n, and S = n * whole + rest per dimension, with 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from exact differences."""
        return (x - self.whole).astype(float) - self.rest.astype(float) / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n * x - S)**2; null where it does not fit into a long."""
        y = x - self.whole
        bound = (float(np.abs(y).max(initial=0)) + 1.0) * self.n
        if bound * bound * x.shape[1] < 2.0**62:
            return pa.array((np.square(y * self.n - self.rest)).sum(axis=1), pa.int64())
        exact = [sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, self.rest)) for row in y]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def centre(fit: DataFrame) -> Centre | None:
    """Exact sums of ``x``: halves of each number are added up apart, so no sum overflows."""

    def run(batches):
        total, n = None, 0
        for _, x in _chunks(batches):
            own = np.stack([(x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0)])
            total, n = own if total is None else total + own, n + len(x)
        if n:
            d = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total[0]), pa.array(total[1]), pa.array(np.full(d, n))], names=["i", "high", "low", "n"])

    parts = fit.select("x").mapInArrow(run, "i long, high long, low long, n long")
    exact = "decimal(38,0)"
    sums = parts.groupBy("i").agg(*(F.sum(F.col(c).cast(exact)).alias(c) for c in ("high", "low", "n"))).orderBy("i").collect()  # one row a dimension
    if not sums:
        return None
    n = int(sums[0]["n"])
    split = [divmod((int(r["high"]) << _LOW) + int(r["low"]), n) for r in sums]
    return Centre(n, np.array([q for q, _ in split], np.int64), np.array([r for _, r in split], np.int64))


def second_moments(fit: DataFrame, project) -> np.ndarray:
    """Sum over all rows of y y^T, y = ``project(x)``.

    Every task sends its own sums once, cut into rows of the matrix; each row is added up in one place, which
    holds no more than the rows dealt to it, and the driver gets one matrix.
    """

    def run(batches):
        total = None
        for _, x in _chunks(batches):
            y = project(x)
            own = y.T @ y
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
                own = np.frombuffer(row.as_py())
                held[i] = held[i] + own if i in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], names=["i", "row"])

    parts = fit.select("x").mapInArrow(run, "i long, row binary")
    rows = parts.repartition("i").mapInArrow(add, "i long, row binary").orderBy("i").collect()  # one row a dimension
    return np.stack([np.frombuffer(r["row"]) for r in rows])


# --- eigenvectors ---------------------------------------------------------------------------


def refined(a: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the symmetric ``a`` from approximate vectors ``x``, in a's precision."""
    d = len(a)
    eye = np.eye(d, dtype=a.dtype)
    unit = np.finfo(a.dtype).eps
    last = np.inf
    norm = np.linalg.norm(a.astype(float), 2)
    for turn in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        # Closer than this, eigenvalues cannot be told apart by what is left to correct, or rounding errors of the
        # residuals, divided by the gap, would be too large to square away.
        off = s - np.diag(value)
        near = 2 * (np.linalg.norm(off.astype(float), 2) + norm * np.linalg.norm(r.astype(float), 2))
        near = max(near, 8 * float(np.sqrt(unit)) * norm)
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for at in _clusters(value, near):
            own = x[:, at]
            mean = value[at].mean()
            small = own.T @ (a @ own - mean * own)
            _, turned = np.linalg.eigh((small + small.T) / 2)
            x[:, at] = own @ turned
        size = float(np.abs(e).max())
        if size <= 4 * unit or (turn > 2 and size >= last / 2 and size < 1e-12):
            break
        last = size
    x = x + x @ (eye - x.T @ x) / 2  # what the last corrections left of orthogonality
    x = x / np.sqrt((x * x).sum(axis=0))
    value = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def _clusters(value: np.ndarray, near: float) -> list[np.ndarray]:
    """Positions of eigenvalues that form runs with gaps of at most ``near``; two positions or more each."""
    order = np.argsort(value, kind="stable")
    cuts = np.flatnonzero(np.diff(value[order]) > near) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns: found in float32, corrected in float64."""
    scale = float(np.trace(v)) or 1.0
    a = (v + v.T) / (2 * scale)
    _, rough = np.linalg.eigh(a.astype(np.float32))
    value, x = refined(a, rough.astype(np.float64))
    return value * scale, x


# --- whitening ------------------------------------------------------------------------------


@dataclass
class Whitening:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.of(x) @ (self.vectors / np.sqrt(self.values))


def fit(distinct: DataFrame, components: int) -> Whitening | None:
    """The first components of the distinct vectors ``x``; None for no vectors."""
    mid = centre(distinct)
    if mid is None:
        return None
    v = second_moments(distinct, mid.of) / mid.n
    values, vectors = eigen(v)
    trace = float(np.trace(v))
    some = np.flatnonzero(values > RANK * trace)[:components]
    return Whitening(mid, values[some], vectors[:, some], trace)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all distinct vectors."""

    def with_one(x):
        return np.concatenate([model.project(x), np.ones((len(x), 1))], axis=1)

    moments = second_moments(distinct, with_one) / model.centre.n
    mean = moments[-1, :-1]
    return float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 64.0, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """Each usable row's first whitened components, one row a component, with how much each explains."""
    rows = whole_vectors(vectors, id_col, vector_col, scale, shift)
    kind = dict(vectors.dtypes)[id_col]
    distinct = written(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, components)
    schema = f"`{id_col}` {kind}, {SCHEMA}"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        k = len(model.values)
        explained = model.values / model.trace
        for part, x in _chunks(batches):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.centre.n)),
                    pc.take(model.centre.deviations(x), each),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
