"""Products of many vectors with a table of others, block by block: neither side is ever held as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermill.functions.storage import shuffle_width

#: Rows of the other table that are held at once; a table of no more goes to every task with the function.
BLOCK_ROWS = 8_192
#: Rows of the first side for each task that meets one block, beyond one block.
STREAM_ROWS = 262_144


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of no length stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 1e-10, length, 1.0)


def block_products(rows: DataFrame, key: str, vector: str, others: DataFrame, other_id: str, other_vector: str, solve: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``solve`` makes of each batch of rows and each block of the others.

    ``solve`` gets the batch with ``key``, the vectors of the batch, and the ids and vectors of the block. ``other_id``
    is a whole number that tells the others apart. All vectors have one length; null ones are left out on both sides.
    """
    own = rows.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>").alias("x"))
    base = others.where(F.col(other_vector).isNotNull()).select(F.col(other_id).cast("bigint").alias("id"), F.col(other_vector).cast("array<double>").alias("x"))
    n = base.count()
    if n <= BLOCK_ROWS:
        held = base.orderBy("id").collect()  # at most BLOCK_ROWS
        ids, y = np.array([r["id"] for r in held], np.int64), np.array([r["x"] for r in held], np.float64)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(ids):
                    yield solve(b, matrix(b.column("x")), ids, y)

        return own.mapInArrow(whole, schema)
    blocks, streams = -(-n // BLOCK_ROWS), max(1, -(-rows.count() // STREAM_ROWS))
    place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    kind = dict(rows.dtypes)[key]
    none = F.lit(None)
    a = base.select(F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("s"), place("id", blocks).alias("b"), "id", "x")
    a = a.select((F.col("s") * blocks + F.col("b")).cast("int").alias("tile"), F.lit(0).alias("side"), none.cast(kind).alias(key), "id", "x")
    q = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), place(key, streams).alias("s"), key, "x")
    q = q.select((F.col("s") * blocks + F.col("b")).cast("int").alias("tile"), F.lit(1).alias("side"), key, none.cast("bigint").alias("id"), "x")
    width = max(shuffle_width(rows.sparkSession), blocks * streams)
    laid = a.unionAll(q).repartitionById(width, F.pmod("tile", F.lit(width)).cast("int")).sortWithinPartitions("tile", "side")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, vectors, y = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            t, side = b.column("tile").to_numpy(), b.column("side").to_numpy()
            cuts = np.r_[0, np.flatnonzero((t[1:] != t[:-1]) | (side[1:] != side[:-1])) + 1, len(t)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                part = b.slice(i, j - i)
                if t[i] != tile:
                    tile, ids, vectors, y = t[i], [], [], None
                if side[i] == 0:
                    ids.append(part.column("id").to_numpy())
                    vectors.append(matrix(part.column("x")))
                elif vectors:
                    y = np.concatenate(vectors) if y is None else y
                    yield solve(part, matrix(part.column("x")), np.concatenate(ids), y)

    return laid.mapInArrow(met, schema)


def top_products(rows: DataFrame, key: str, vector: str, others: DataFrame, other_id: str, other_vector: str, n: int, digits: int = 12) -> DataFrame:
    """``key, top ARRAY<STRUCT<fall DOUBLE, id BIGINT>>``: each row's ``n`` greatest cosines, as their negatives, of equal ones the smaller id first.

    Of each block only the ``n`` best leave.
    """

    def solve(batch: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        s = np.round(unit(x) @ unit(y).T, digits)
        m = min(n, len(ids))
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :m]
        fall, who = -np.take_along_axis(s, order, 1), ids[order]
        pairs = pa.StructArray.from_arrays([pa.array(fall.ravel()), pa.array(who.ravel())], names=["fall", "id"])
        top = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * m + 1, m, dtype=np.int32)), pairs)
        return pa.RecordBatch.from_arrays([batch.column(key), top], names=[key, "top"])

    kind = dict(rows.dtypes)[key]
    parts = block_products(rows, key, vector, others, other_id, other_vector, solve, f"`{key}` {kind}, top array<struct<fall: double, id: bigint>>")
    return parts.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, n).alias("top"))


def all_products(rows: DataFrame, key: str, vector: str, others: DataFrame, other_id: str, other_vector: str) -> DataFrame:
    """``key, n, mean, deviation`` of each row's cosines with all others (population deviation)."""

    def solve(batch: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        s = unit(x) @ unit(y).T
        mean = s.mean(axis=1)
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(len(x), len(ids))), pa.array(mean), pa.array(((s - mean[:, None]) ** 2).sum(axis=1))], names=[key, "n", "m", "q"])

    kind = dict(rows.dtypes)[key]
    parts = block_products(rows, key, vector, others, other_id, other_vector, solve, f"`{key}` {kind}, n bigint, m double, q double")
    n = F.sum("n")
    total = F.sum(F.col("m") * F.col("n"))
    # The squares of all blocks, and those of the blocks' means around the mean of all.
    squares = F.sum("q") + F.sum(F.col("m") * F.col("m") * F.col("n")) - total * total / n
    return parts.groupBy(key).agg(n.alias("n"), (total / n).alias("mean"), F.sqrt(F.greatest(squares, F.lit(0.0)) / n).alias("deviation"))
