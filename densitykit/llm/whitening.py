"""Whitening of embedding vectors by principal directions (operator 11).

``fit`` reduces the centred rows to one triangular factor R (a QR of each block of rows stacked on the factor so far,
then a tree of QRs over the tasks' factors), brings R to bidiagonal form by Householder reflections, finds the
singular values by dqds and the directions by twisted factorisations (``qd.py``). ``apply`` projects every row.

An entry c counts as the integer ``x = floor(scale * c) + offset``, so sums, ``n * x - S`` and the deviation are exact
and centring loses nothing: a centred entry is the rounded quotient ``(n * x - S) / n``.

Edge cases: null vectors and vectors with a null or non-finite entry, or one of 2^62 / scale or more (its x is no long),
are dropped. Vectors must agree in length; the commonest length counts (ties: the greater), other vectors and empty ones
are dropped. Null and repeated keys are rows as any other. A direction whose singular value is not above rounding
(d * 2^-52 of the greatest) has null ``whitened`` and counts in no identity error; one vector or equal vectors
have only such ones. A deviation beyond a long is null. An empty table gives no rows. Extra columns are ignored.

Scale: three narrow scans of the vector column (sums; factors; covariance of the result) and the one that writes the
rows; nothing is shuffled but one d x d factor a task, ``FAN_IN`` of which meet in one task, level by level. The
driver gets d sums, one factor and one k x k matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.llm.qd import EPS, principal
from densitykit.session import materialize, ship_package

#: Factors (or matrices) that one task joins.
FAN_IN = 16
#: Rows of a block.
ROWS = 4096


@dataclass
class Whitening:
    """What a fit keeps: a few vectors of the dimension."""

    n: int
    dim: int
    sums: list[int]
    #: e and share of the trace for each component; e is 0 where there is no direction.
    values: np.ndarray
    explained: np.ndarray
    #: d x components; zero columns where there is no direction.
    vectors: np.ndarray
    scale: int
    offset: int
    identity_error: float = 0.0


def usable(col: pa.Array, scale: int, offset: int, dim: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and integer entries (one row each) of the vectors that count, for each length (or one length)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    flat = col.flatten()  # leaves out what lies below null rows
    v = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    out = []
    for d in np.unique(lens[lens > 0]) if dim is None else [dim]:
        rows = np.flatnonzero(lens == d)
        for i in range(0, len(rows), ROWS):
            at = rows[i:i + ROWS]
            c = v[(ends[at] - d)[:, None] + np.arange(d)]
            with np.errstate(invalid="ignore", over="ignore"):
                y = np.floor(c * scale)
                good = (np.abs(y) < 2.0**62).all(axis=1)
            if good.any():
                out.append((at[good], y[good].astype(np.int64) + offset))
    return out


def exact_sums(x: np.ndarray) -> list[int]:
    if np.abs(x).max(initial=0) < 1 << 40:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: int64 where that holds it, else Python integers."""
    top = int(np.abs(x).max(initial=0))
    s = max(map(abs, sums), default=0)
    if n * top + s < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null beyond a long."""
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    return [t if t < 1 << 63 else None for t in (sum(int(a) * int(a) for a in row) for row in y)]


def centred(y: np.ndarray, n: int) -> np.ndarray:
    return y.astype(float) / n if y.dtype != object else np.array([[a / n for a in row] for row in y])


def _triangle(rows: np.ndarray) -> np.ndarray:
    """d x d factor of a stack of rows (zero rows below, if there are fewer than d)."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _tree(parts: DataFrame, join) -> np.ndarray:
    """Join one matrix a task (column ``m``, float64 bytes) to one, ``FAN_IN`` at a time."""
    def step(batches):
        held = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                m = np.frombuffer(raw, float)
                held = m if held is None else join(held, m)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([held.tobytes()], pa.binary())})

    here, got = materialize(parts, "factors", n=F.count(F.lit(1)))
    while got["n"] > FAN_IN:
        wide = here.repartition(-(-got["n"] // FAN_IN))
        here, got = materialize(wide.mapInArrow(step, "m binary"), "factors", n=F.count(F.lit(1)))
    held = None
    for r in here.collect():  # at most FAN_IN
        m = np.frombuffer(bytes(r.m), float)
        held = m if held is None else join(held, m)
    return held


def fit(df: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """Directions of the vectors of ``df``; None if no vector counts."""
    spark = df.sparkSession
    ship_package(spark)
    col = df.select(F.col(vector).alias("v"))

    def add(batches):
        held: dict[int, list] = {}
        for b in batches:
            for at, x in usable(b.column(0), scale, offset):
                s = exact_sums(x)
                n, old = held.get(x.shape[1], (0, [0] * x.shape[1]))
                held[x.shape[1]] = (n + len(at), [a + c for a, c in zip(old, s)])
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([list(map(str, s))], pa.list_(pa.string()))], ["d", "n", "s"])

    sums = col.mapInArrow(add, "d int, n long, s array<string>").select("d", "n", F.posexplode("s").alias("i", "s")) \
        .groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")) \
        .groupBy("d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s")) \
        .orderBy(F.desc("n"), F.desc("d")).first()
    if sums is None:
        return None
    n, dim, s = sums.n, sums.d, [int(x.s) for x in sums.s]

    def factor(batches):
        held = np.zeros((0, dim))
        for b in batches:
            for _, x in usable(b.column(0), scale, offset, dim):
                held = _triangle(np.vstack([held, centred(spread(x, n, s), n)]))
        if len(held):
            yield pa.RecordBatch.from_pydict({"m": pa.array([held.tobytes()], pa.binary())})

    both = lambda p, q: _triangle(np.vstack([p.reshape(-1, dim), q.reshape(-1, dim)])).ravel()
    r = _tree(col.mapInArrow(factor, "m binary"), both).reshape(dim, dim)
    k = min(components, dim)
    squares, vectors = principal(r, k)
    real = squares[:k] > squares[0] * (dim * EPS) ** 2 if squares[0] > 0 else np.zeros(k, bool)
    trace = float((r * r).sum()) / n
    values = np.where(real, squares[:k], 0) / n
    out = Whitening(n, dim, s, values, values / trace if trace else np.zeros(k), np.where(real, vectors, 0), scale, offset)

    def gram(batches):
        held = None
        for b in batches:
            for _, x in usable(b.column(0), scale, offset, dim):
                w = np.column_stack([project(out, spread(x, n, s)), np.ones(len(x))])
                held = w.T @ w if held is None else held + w.T @ w
        if held is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([held.tobytes()], pa.binary())})

    g = _tree(col.mapInArrow(gram, "m binary"), np.add).reshape(k + 1, k + 1) / n
    error = np.abs(g[:k, :k] - np.outer(g[k, :k], g[k, :k]) - np.eye(k))[np.ix_(real, real)]
    out.identity_error = float(error.max(initial=0))
    return out


def project(w: Whitening, y: np.ndarray) -> np.ndarray:
    """Whitened rows of ``n * x - S``."""
    root = np.sqrt(np.where(w.values > 0, w.values, 1))
    return centred(y, w.n) @ w.vectors / root


def apply(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector that counts and component: key, component, n, deviation, whitened, explained,
    identity_error."""
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    none = model.values <= 0

    def rows(batches):
        for b in batches:
            for at, x in usable(b.column(1), model.scale, model.offset, model.dim):
                y = spread(x, model.n, model.sums)
                m = len(at)
                per_row = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(at[per_row])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(y), pa.int64()).take(pa.array(per_row)),
                    pa.array(project(model, y).ravel(), mask=np.tile(none, m)),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(F.col(key), F.col(vector)).mapInArrow(_named(rows, key), schema)


def _named(rows, key):
    def run(batches):
        for b in rows(batches):
            yield b.rename_columns([key, *b.schema.names[1:]])
    return run
