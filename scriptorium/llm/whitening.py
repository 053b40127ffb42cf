"""Whitening of embeddings by randomised subspace iteration over all rows.

The range of the covariance is found by a random start with some columns more than components
are wanted, and by repeated power passes over all centred rows. Each pass gives the covariance
times the present basis, so it also gives the Rayleigh-Ritz components inside the basis and
their residuals. Where those are not small after the last pass (flat spectra converge slowly)
the basis is expanded to the full dimension, whose one pass is exact up to rounding.

Entries become whole numbers first. Sums are exact, and rows are centred in whole numbers, so
that nothing is lost to the offset. A task sums its rows to one block of dimension x basis
doubles; blocks are dealt and added by row of the matrix, and only the sum goes to the driver.
Memory is that of a block: the dimension is to be some thousands at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import free_names

SCALE, OFFSET = 64, 1_000_000
COMPONENTS, OVERSAMPLE, PASSES, SEED = 32, 16, 4, 20240229
#: Entries that become greater numbers than this are no entries: sums of them would not be exact.
LARGEST = 2.0**40
#: Residuals, as a share of the greatest eigenvalue, that are small; and eigenvalues that are none.
SMALL, NO_VARIANCE = 1e-12, 1e-11


@dataclass(frozen=True)
class Whitening:
    """What `fit` learned: the number of rows, exact sums, components (one a column) and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    expanded: bool


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part, and their whole numbers."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width)
    flat = pc.fill_null(column.take(pa.array(at)).flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), width)
    fine = (np.isfinite(flat) & (np.abs(SCALE * flat) < LARGEST)).all(axis=1)
    return at[fine], np.floor(SCALE * flat[fine]).astype(np.int64) + OFFSET


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole) - np.array([(s - n * (s // n)) / n for s in sums])


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _numbers(batch.column(0), width)[1]
        if len(x):
            yield x


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, values) with the same i, added."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row = np.asarray(values.values)
            held[i] = held[i] + row if i in held else row
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["i", "v"])


def _matrix(vectors: DataFrame, width: int, of_rows: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of of_rows over all rows: one block a task, added by row of the matrix."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _batches(batches, width):
            total = of_rows(x) if total is None else total + of_rows(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    rows = vectors.mapInArrow(block, "i int, v array<double>").repartition("i").mapInArrow(_added, "i int, v array<double>").collect()
    out = np.zeros(shape)
    for i, values in rows:
        out[i] = values
    return out


def _sums(vectors: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows that take part, and exact sums of their numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for x in _batches(batches, width):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([Decimal(int(s)) for s in [*total, n]], pa.decimal128(38, 0))], names=["i", "s"])

    found = {r["i"]: int(r["s"]) for r in vectors.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(width, 0), tuple(found.get(i, 0) for i in range(width))


def _vectors(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(f"`{column}`").cast("array<double>").alias("v"))


def _width(vectors: DataFrame) -> int:
    """The length of most vectors without nulls; of equally many, the greater."""
    counted = vectors.where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))").groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    return best[0]["w"] if best else 0


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS, *, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> Whitening:
    """Components of the covariance of all vectors that take part (as `whiten` says), with the spread of what they whiten.

    identity_error is measured by one more pass over all rows.
    """
    vectors = _vectors(df, column)
    width = _width(vectors)
    n, sums = _sums(vectors, width)
    if not n or not width:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, False)
    wanted = min(components, width)

    def product(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times the basis, and the covariance's trace."""

        def of_rows(x: np.ndarray) -> np.ndarray:
            z = _centred(x, n, sums)
            squares = np.zeros(basis.shape[1])
            squares[0] = (z * z).sum()
            return np.vstack((z.T @ (z @ basis), squares))

        found = _matrix(vectors, width, of_rows, (width + 1, basis.shape[1])) / n
        return found[:-1], float(found[-1, 0])

    random = np.random.default_rng(seed)
    basis = np.linalg.qr(random.standard_normal((width, min(width, wanted + oversample))))[0]
    for attempt in range(passes + 1):
        image, trace = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
        found = basis @ turn
        residual = np.linalg.norm(image @ turn - found * values, axis=0).max()
        full = basis.shape[1] == width
        if full or residual <= SMALL * max(values[0], 0.0):
            break
        # the next power pass; after the last one, all dimensions
        basis = np.linalg.qr(image)[0] if attempt < passes - 1 else np.linalg.qr(np.hstack((basis, random.standard_normal((width, width - basis.shape[1])))))[0]
    some = values > NO_VARIANCE * max(values[0], 0.0)
    found, values = found[:, some], values[some]
    found = found / np.linalg.norm(found, axis=0) if found.size else found
    k = len(values)
    error = 0.0
    if k:
        factor = found / np.sqrt(values)

        def spread(x: np.ndarray) -> np.ndarray:
            w = _centred(x, n, sums) @ factor
            return np.vstack((w.T @ w, w.sum(axis=0)))

        second = _matrix(vectors, width, spread, (k + 1, k)) / n
        error = float(np.abs(second[:-1] - np.outer(second[-1], second[-1]) - np.eye(k)).max())
    return Whitening(n, sums, found, values, trace, error, full and width > wanted + oversample)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact; None where that is no 64-bit number."""
    if not len(x):
        return []
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest, near = [s - n * (s // n) for s in sums], x - whole
    if x.shape[1] * (n * (int(np.abs(near).max(initial=0)) + 1)) ** 2 < 2**62:
        return ((n * near - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * near.astype(object) - np.array(rest, dtype=object)) ** 2).sum(axis=1)
    return [v if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, model: Whitening, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",), names: tuple[str, str] = ("deviation", "whitened")) -> DataFrame:
    """The columns `keep` of every row that takes part, `deviation` and `whitened` (one double a component of the model).

    Rows whose vector is null, holds null or non-finite entries (or such of 2^40 / 64 or more,
    whose sums would not be exact), or has another length than most are left out. Null and
    repeated ids are rows like others. Directions without variance are no components: one row,
    or equal rows, have none, and their `whitened` is empty. A deviation that is no long is null.
    """
    width, sums, n = len(model.sums), model.sums, model.n
    factor = model.components / np.sqrt(model.values) if len(model.values) else np.zeros((width, 0))
    kept = df.select(*[df[f"`{c}`"] for c in keep])
    names = free_names(kept, *names)
    columns = [*kept.columns, *names]
    schema = StructType([*kept.schema.fields, StructField(names[0], LongType()), StructField(names[1], ArrayType(DoubleType(), False))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _numbers(batch.column(batch.num_columns - 1), width)
            if len(x) and n:
                rows = batch.take(pa.array(at))
                flat = (_centred(x, n, sums) @ factor).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * factor.shape[1], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(_deviations(x, n, sums), pa.int64()), lists], names=columns)

    (place,) = free_names(kept, "v")
    return df.select(*[df[f"`{c}`"] for c in keep], df[f"`{column}`"].cast("array<double>").alias(place)).mapInArrow(apply, schema)


def by_component(df: DataFrame, model: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error), one row for each row that takes part and component."""
    rows = whiten(df, model, column, keep=(key,), names=("deviation", "whitened"))
    deviation, whitened = rows.columns[-2:]
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    each = rows.select(F.col(f"`{key}`"), F.col(deviation).alias("deviation"), F.posexplode(whitened).alias("at", "whitened"))
    return each.select(F.col(f"`{key}`"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(model.identity_error).alias("identity_error"))
