"""Whitening of embeddings with exact covariances from bit planes.

Entries become integers, x = floor(64 c) + 1 000 000. The covariance needs the sum of x_i x_j for every pair
of dimensions. It is found without multiplying rows:

1. In a block of rows each dimension is shifted by its least value there, so that few bits are left. Each bit
   of each dimension, a bit plane, is packed across the rows into 64-bit words.
2. The number of rows in which bit p of one dimension and bit q of another are both set is the popcount of
   the AND of two planes. Weighted with 2 to the power of p + q these add up to the cross-products.
3. Shifts are undone in integers; a task adds up its blocks and returns one row for each pair of dimensions,
   which Spark adds up. n * sum(x_i x_j) - sum(x_i) * sum(x_j) is exact, whatever the offset of the entries;
   divided by n squared it is the covariance, correctly rounded.

The driver takes one number for each pair of dimensions and decomposes their matrix; vectors are only
streamed, in blocks of an Arrow batch: once for the sums, once to measure what the whitened values'
covariance is, and once for the result. A lost executor costs its tasks' blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Scaled entries from here on do not fit the integers used; they raise OverflowError.
LARGEST = 2.0**62


def vectors(frame: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows whose vector is there and holds finite numbers only."""
    rows = frame.select(
        frame[id_column].cast("long").alias("vec_id"), frame[vector_column].cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return rows.where(F.col("vector").isNotNull() & finite)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x - OFFSET of these rows) for each length of vectors in a batch."""
    column = batch.column("vector")
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        scaled = np.floor(SCALE * flat.reshape(len(rows), int(size)))
        if scaled.size and np.abs(scaled).max() >= LARGEST:
            raise OverflowError(f"an entry of a vector is {LARGEST / SCALE:g} or larger")
        yield rows, scaled.astype(np.int64)


# --- exact sums -----------------------------------------------------------------------------------


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension, bit): rows of 64-bit words, one plane for each bit that a dimension needs."""
    rows = len(shifted)
    width = [int(most).bit_length() for most in shifted.max(axis=0)]
    planes, dimension, bits = [], [], []
    padded = -(-rows // 64) * 8
    for bit in range(max(width)):
        own = np.asarray([d for d, w in enumerate(width) if w > bit])
        packed = np.packbits((shifted[:, own] >> np.uint64(bit)).astype(np.uint8) & 1, axis=0)
        words = np.zeros((len(own), padded), np.uint8)
        words[:, : len(packed)] = packed.T
        planes.append(words.view(np.uint64))
        dimension.append(own)
        bits.append(np.full(len(own), bit))
    if not planes:
        return np.zeros((0, padded // 8), np.uint64), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(planes), np.concatenate(dimension), np.concatenate(bits)


def block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of each dimension, sum of the products of each pair) as Python integers, from bit planes."""
    rows, dims = x.shape
    least = x.min(axis=0)
    planes, dimension, bits = bit_planes((x - least).view(np.uint64))
    together = np.zeros((len(planes), len(planes)), np.int64)
    for at in range(len(planes)):
        together[at, at:] = np.bitwise_count(planes[at] & planes[at:]).sum(axis=1, dtype=np.int64)
    together = np.maximum(together, together.T)
    most = int(bits.max()) + 1 if len(bits) else 0
    kind = np.int64 if 2 * most + rows.bit_length() < 63 else object
    weights = np.zeros((len(planes), dims), kind)
    weights[np.arange(len(planes)), dimension] = [1 << int(bit) for bit in bits]
    own = (np.diagonal(together).astype(kind) @ weights).astype(object)
    products = (weights.T @ together.astype(kind) @ weights).astype(object)
    shift = least.astype(object)
    crossed = np.outer(shift, own)
    return own + rows * shift, products + crossed + crossed.T + rows * np.outer(shift, shift)


_SUMS = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: (i, j) for products, (i, -1) for a dimension, (-1, -1) for the number of rows."""
    held: dict[int, list] = {}
    for batch in batches:
        for rows, x in _matrices(batch):
            counted = held.setdefault(x.shape[1], [0, 0, 0])
            sums, products = block_sums(x) if x.shape[1] else (0, 0)
            for at, value in enumerate((len(rows), sums, products)):
                counted[at] = counted[at] + value
    for dims, (count, sums, products) in held.items():
        i, j = np.triu_indices(dims)
        totals = [count, *(sums if dims else []), *(products[i, j] if dims else [])]
        first, second = np.r_[-1, np.arange(dims), i], np.r_[-1, np.full(dims, -1), j]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(totals), dims), pa.int32()),
                pa.array(first, pa.int32()),
                pa.array(second, pa.int32()),
                pa.array([Decimal(int(t)) for t in totals], pa.decimal128(38, 0)),
            ],
            schema=_SUMS,
        )


@dataclass(frozen=True)
class Fit:
    """What all rows are whitened with; sums are those of x - OFFSET."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # falling eigenvalues, COMPONENTS of them at most
    components: np.ndarray  # one column each
    explained: np.ndarray
    usable: np.ndarray  # whether an eigenvalue is above what rounding makes of 0

    @property
    def dims(self) -> int:
        return len(self.sums)


def fit(rows: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """The fit of all ``rows`` (vec_id, vector) of the most frequent length, of the longer one if two are."""
    sums = stored(
        rows.mapInArrow(_task_sums, "dims int, i int, j int, total decimal(38,0)")
        .groupBy("dims", "i", "j")
        .agg(F.sum("total").alias("total"))
    )
    counts = {r["dims"]: int(r["total"]) for r in sums.where("i = -1").collect() if r["dims"]}
    if not counts:
        return None
    dims = max(counts, key=lambda d: (counts[d], d))
    n = counts[dims]
    total = [0] * dims
    products = np.zeros((dims, dims), object)
    for row in sums.where((F.col("dims") == dims) & (F.col("i") >= 0)).toLocalIterator():
        if row["j"] < 0:
            total[row["i"]] = int(row["total"])
        else:
            products[row["i"], row["j"]] = products[row["j"], row["i"]] = int(row["total"])
    centred = n * products - np.outer(np.asarray(total, object), np.asarray(total, object))
    covariance = (centred / (n * n)).astype(float)  # of integers, so correctly rounded
    values, found = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, found = values[order], found[:, order]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(order))])
    trace = float(sum(int(centred[d, d]) for d in range(dims)) / (n * n))
    usable = values > dims * np.finfo(float).eps * max(values[0], 0.0)
    explained = np.where(usable, values / trace if trace else 0.0, 0.0)
    return Fit(n, tuple(total), values, found * signs, explained, usable)


# --- rows -----------------------------------------------------------------------------------------


def whitened_block(fitted: Fit, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(deviation as integers, whitened) of a block of rows."""
    sums = np.asarray(fitted.sums, object)
    most = max((int(np.abs(x).max()) if x.size else 0) * fitted.n + max(map(abs, fitted.sums)), 1)
    kind = np.int64 if most * most * fitted.dims < 2**63 else object
    away = x.astype(kind) * fitted.n - sums.astype(kind)
    deviation = (away * away).sum(axis=1)
    centred = (away / fitted.n).astype(float)
    scale = np.sqrt(np.where(fitted.usable, fitted.values, 1.0))
    return deviation, np.where(fitted.usable, (centred @ fitted.components) / scale, 0.0)


def _blocks(fitted: Fit, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for rows, x in _matrices(batch):
            if x.shape[1] == fitted.dims:
                yield batch.take(pa.array(rows)), *whitened_block(fitted, x)


def identity_error(rows: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity, over all rows.

    Products are those of values less their task's own mean, by blocks; the means are added in Spark.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, products = 0, 0.0, 0.0
        for _, _, z in _blocks(fitted, batches):
            own = z.mean(axis=0)
            away, apart = z - own, own - mean
            products = products + away.T @ away + np.outer(apart, apart) * (count * len(z) / (count + len(z)))
            mean = mean + apart * (len(z) / (count + len(z)))
            count += len(z)
        if count:
            i, j = np.triu_indices(len(fitted.values))
            total = [count * mean, (products + count * np.outer(mean, mean))[i, j]]
            first, second = np.r_[np.arange(len(mean)), i], np.r_[np.full(len(mean), -1), j]
            yield pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(np.concatenate(total))],
                names=["i", "j", "total"],
            )

    sums = rows.mapInArrow(scatter, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    mean, products = np.zeros(len(fitted.values)), np.zeros((len(fitted.values),) * 2)
    for row in sums.collect():  # components squared
        if row["j"] < 0:
            mean[row["i"]] = row["total"] / fitted.n
        else:
            products[row["i"], row["j"]] = products[row["j"], row["i"]] = row["total"] / fitted.n
    there = np.flatnonzero(fitted.usable)
    error = (products - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(there, there)]
    return float(np.abs(error).max()) if error.size else 0.0


def _whitened(fitted: Fit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, deviation, z in _blocks(fitted, batches):
            exact = pa.array([Decimal(int(d)) for d in deviation], pa.decimal128(38, 0))
            values = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), max(1, z.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), exact, values.cast(pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"],
            )

    return whiten


def whitened(rows: DataFrame, fitted: Fit) -> DataFrame:
    """(vec_id, deviation, whitened): the components of each vector as an array of doubles."""
    return rows.mapInArrow(_whitened(fitted), "vec_id long, deviation decimal(38,0), whitened array<double>")


def whitening(
    embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each component.

    Rows whose vector is null, or holds a null, NaN or infinity, go; so do rows whose vector has another
    length than most have (of two lengths as frequent, the longer stays), and empty vectors. Repeated rows
    and ties each count and each return; a null id stays null; further columns are ignored. A component
    whose variance is 0, as where all vectors are alike or are fewer than their dimensions, has 0.0 as
    ``whitened`` and ``explained`` and is left out of ``identity_error``. ``deviation`` is null where it is
    too large for a long. Entries of 2 to the power of 56 and beyond raise. Without rows left there is no result.
    """
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows = vectors(embeddings, id_column, vector_column)
    fitted = fit(rows, most)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, fitted)
    explained = F.array(*[F.lit(float(share)) for share in fitted.explained])
    return (
        whitened(rows, fitted)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(fitted.n).cast("long").alias("n"),
            F.expr("try_cast(deviation as bigint)").alias("deviation"),
            "whitened",
            F.get(explained, F.col("at")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))
