"""Embedding whitening by an exact integer scatter.

Entries become whole numbers; each distinct vector counts once.  A shift, one of the vectors, is subtracted, and tasks
accumulate the sums S and cross-products of what is left without rounding: blocks go through matrix products of 20-bit
limbs, short enough for doubles to be exact, into integers of any length.  ``n * X'X - S S'`` is formed from these integers, and only then
divided and decomposed by ``eigh``.

What leaves a task is one row of d sums and d * d / 2 products; these are added in ``SLOTS`` groups and reach the driver as at most that
many rows, whose size depends on the dimensions alone.  The distinct vectors are packed to the least whole width of bytes each
needs, made distinct map-side first (a vector that a third of the rows share costs one row a task), and stored as a table that all later steps read.

Left out are rows whose vector is null or has null, NaN or infinite entries, and, as they lack entries or have too many, vectors of another
length than most distinct ones have (of equally frequent lengths, the longest).  Entries whose whole number does not fit 64 bits take the nearest that does.
Repeated rows and ids, and null ids, are passed through.  Components whose eigenvalue is zero beside the greatest (times d * 2^-52) cannot be whitened and
are left out, so equal vectors alone, and an empty table, give no rows.  ``deviation`` is null where it exceeds 64 bits;
``deviation_digits`` has it whole.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import frugal, stored

SCALE, MOST, SLOTS = 256.0, 4, 32
#: Bits of a limb, and rows of a block: sums of BLOCK products of two limbs stay below 2^53.
LIMB, BLOCK = 20, 4096
_LONG = np.iinfo(np.int64)


def _longs(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vectors have no null and no non-finite entry, and their whole numbers, grouped in equal lengths."""
    length = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    start = np.cumsum(length) - length
    flat = vectors.flatten()
    entry = np.asarray(pc.fill_null(flat, np.nan), np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entry))))
    good = np.asarray(vectors.is_valid()) & (bad[start + length] == bad[start])
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(SCALE * entry)
    x = np.where(whole >= 2.0**63, _LONG.max, np.where(whole <= -(2.0**63), _LONG.min, np.where(np.abs(whole) < 2.0**63, whole, 0).astype(np.int64)))
    return np.flatnonzero(good), [x[a : a + n] for a, n in zip(start[good], length[good])]


def _pack(x: np.ndarray) -> bytes:
    """The least width of bytes that holds the vector, then its numbers: equal vectors, equal bytes."""
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        info = np.iinfo(kind)
        if not len(x) or (x.min() >= info.min and x.max() <= info.max):
            return kind[-1].encode() + x.astype(kind).tobytes()
    raise AssertionError


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[:1].decode()}", offset=1).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, rows = _longs(batch.column("vector"))
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in rows], pa.int32()), pa.array([_pack(x) for x in rows], pa.binary())], ["d", "x"])


def _shifted(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift, as integers of any length where 64 bits might not do."""
    near = lambda a: not a.size or (a.max() < 1 << 61 and a.min() > -(1 << 61))
    return x - shift if near(x) and near(shift) else x.astype(object) - shift.astype(object)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    out = []
    while y.size and max(y.max(), -y.min()) >= 1 << LIMB:
        out.append(y & ((1 << LIMB) - 1))
        y = y >> LIMB
    return [*out, y]


def cross_products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK):
        limbs = [part.astype(np.float64) for part in _limbs(y[at : at + BLOCK])]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _numbers(values) -> str:
    return " ".join(map(str, values))


def _scatter(shift: bytes):
    origin = _unpack(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d = 0, len(origin)
        upper = np.triu_indices(d)
        sums, products = np.zeros(d, object), np.zeros(len(upper[0]), object)
        for batch in batches:
            packed = batch.column("x").to_pylist()
            if not packed:
                continue
            y = _shifted(np.array([_unpack(p) for p in packed]).reshape(len(packed), d), origin)
            n += len(packed)
            sums = sums + y.astype(object).sum(0)
            products = products + cross_products(y)[upper]
        if n:
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([_numbers(sums)]), pa.array([_numbers(products)])], ["slot", "n", "sums", "products"])

    return run


def _add(rows: list[tuple[int, str, str]]) -> tuple[int, list[int], list[int]]:
    n, sums, products = 0, None, None
    for count, s, p in rows:
        n += count
        s, p = list(map(int, s.split())), list(map(int, p.split()))
        sums = s if sums is None else [a + b for a, b in zip(sums, s)]
        products = p if products is None else [a + b for a, b in zip(products, p)]
    return n, sums or [], products or []


def _added(table: pa.Table) -> pa.Table:
    n, sums, products = _add(list(zip(table["n"].to_pylist(), table["sums"].to_pylist(), table["products"].to_pylist())))
    return pa.table({"n": pa.array([n], pa.int64()), "sums": [_numbers(sums)], "products": [_numbers(products)]})


class Model(NamedTuple):
    shift: bytes  # packed
    n: int
    sums: list[int]  # of the shifted vectors
    axes: np.ndarray  # a row a component
    values: np.ndarray  # eigenvalues
    explained: np.ndarray


def decompose(shift: bytes, n: int, sums: list[int], products: list[int], most: int = MOST) -> Model:
    """The leading components of the exact scatter; integers stay whole up to the one division by n squared."""
    d = len(sums)
    scatter = np.zeros((d, d), object)
    scatter[np.triu_indices(d)] = products
    scatter = n * np.where(np.arange(d)[:, None] <= np.arange(d), scatter, scatter.T) - np.outer(np.array(sums, object), np.array(sums, object))
    square = n * n
    covariance = np.array([[q / square for q in row] for row in scatter], float).reshape(d, d)
    values, vectors = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values, kind="stable")[:most] if values[k] > d * 2.0**-52 * values[-1]]
    trace = sum(scatter[k, k] for k in range(d)) / square
    axes = vectors[:, order].T
    return Model(shift, n, sums, axes, values[order], values[order] / trace if trace else values[order])


def fit(vectors: DataFrame, most: int = MOST) -> tuple[DataFrame, Model | None]:
    """The distinct vectors, packed and stored, and the model; none if there is no vector.  ``vectors`` has ``vector``."""
    distinct = stored(vectors.select("vector").mapInArrow(frugal(_packed), "d int, x binary").distinct())
    lengths = distinct.groupBy("d").agg(F.count("*").alias("n"), F.min("x").alias("shift"))
    top = lengths.agg(F.max(F.struct("n", "d", "shift")).alias("top")).first()["top"]  # one row
    if top is None or not top["d"]:
        return distinct, None
    same, shift = distinct.filter(F.col("d") == top["d"]).select("x"), bytes(top["shift"])
    parts = same.mapInArrow(frugal(_scatter(shift)), "slot int, n long, sums string, products string")
    rows = parts.groupBy("slot").applyInArrow(_added, "n long, sums string, products string").collect()  # SLOTS rows at most
    return same, decompose(shift, *_add([(r["n"], r["sums"], r["products"]) for r in rows]), most)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over the last axis of products, exactly."""
    top = lambda v: max(int(v.max()), -int(v.min()), 1)
    if top(a) * top(b) * a.shape[-1] < 1 << 63:
        return (a.astype(np.int64) * b.astype(np.int64)).sum(-1).astype(object)
    return (a.astype(object) * b.astype(object)).sum(-1)


def project(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whitened components of whole vectors (rows), and their exact deviations."""
    y = _shifted(x, _unpack(model.shift))
    floor = np.array([s // model.n for s in model.sums], object)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    centred = (y.astype(object) - floor if y.dtype == object or max(map(abs, floor)) >= 1 << 62 else y - floor.astype(np.int64)).astype(float) - rest
    s = np.array(model.sums, object)
    deviation = model.n**2 * _dot(y, y) - 2 * model.n * _dot(y, s[None]) + sum(v * v for v in model.sums)
    return centred @ model.axes.T / np.sqrt(model.values), deviation


def _whitened(model: Model):
    """Rows of distinct vectors to their whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("x").to_pylist()
            if packed:
                w, _ = project(model, np.array([_unpack(p) for p in packed]))
                yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.list_(pa.float64()))], ["w"])

    return run


def identity_error(distinct: DataFrame, model: Model) -> float:
    """How far the covariance of the whitened fit list is from the identity; Spark's ``covar_pop`` merges centred moments."""
    k = len(model.values)
    w = distinct.mapInArrow(frugal(_whitened(model)), "w array<double>").select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def _applied(model: Model, error: float):
    k, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = _longs(batch.column("vector"))
            fits = [i for i, x in enumerate(rows) if len(x) == d]
            if not fits:
                continue
            w, deviation = project(model, np.array([rows[i] for i in fits]))
            ids = batch.column("vec_id").take(pa.array(np.repeat(at[fits], k)))
            m = len(ids)
            exact = np.repeat(deviation, k)
            fitting = [v if v <= _LONG.max else None for v in exact]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(fits))), pa.array(np.full(m, model.n)), pa.array(fitting, pa.int64()), pa.array([str(v) for v in exact]),
                 pa.array(w.ravel()), pa.array(np.tile(model.explained, len(fits))), pa.array(np.full(m, error))],
                ["vec_id", "component", "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """``vec_id, component, n, deviation, deviation_digits, whitened, explained, identity_error`` for each row and component."""
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"
    distinct, model = fit(rows, most)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(frugal(_applied(model, identity_error(distinct, model))), schema)
