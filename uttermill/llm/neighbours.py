"""Most similar vectors for every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uttermill.llm.routing import LOOKUPS, TILE_ROWS, Router, unpacked
from uttermill.llm.tiles import CHUNK, Copies, counts_here, laid_out, part_of_tile, parts_of, routed, sides_of, solved, spots

#: Digits of a cosine that half-precision vectors bear; closer ones are ties.
_DIGITS = 5
#: Columns of which the best one stands for all, where the best of a row are sought.
_STRIDE = 16

_PAIRS = "name string, other string, cosine double"


def candidates(s: np.ndarray, m: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matrix of cosines that hold each row's ``m`` best of at least ``floor``, and few others.

    The ``m``-th best of the bests of groups of columns is a bound that at least ``m`` values of the row reach. Rows in
    which many more do, as copies make them, are sorted out exactly; of equal values the earlier column counts.
    """
    n = s.shape[1]
    m = min(m, n)
    if floor is None:
        k = n // _STRIDE
        if k < m:
            return np.repeat(np.arange(len(s)), n), np.tile(np.arange(n), len(s))
        best = s[:, : k * _STRIDE].reshape(len(s), _STRIDE, k).max(axis=1)
        bound = np.partition(best, k - m, axis=1)[:, k - m] - 2 * 10.0**-_DIGITS
        good = s >= bound[:, None]
    else:
        good = s >= floor
    full = np.flatnonzero(good.sum(axis=1) > 4 * m)
    good[full] = False
    q, b = np.nonzero(good)
    if len(full):
        later = np.arange(n) * 1e-12
        some = np.argpartition(np.round(s[full].astype(np.float64), _DIGITS) - later, n - m, axis=1)[:, n - m :]
        if floor is not None:
            keep = np.take_along_axis(s[full], some, 1).ravel() >= floor
        else:
            keep = np.ones(some.size, bool)
        q, b = np.r_[q, np.repeat(full, m)[keep]], np.r_[b, some.ravel()[keep]]
    return q, b


def _search(k: int, floor: float | None, ask_share: int | None, part_at: np.ndarray | None):
    """Within each tile, the best others of each row that asks. Without ``part_at`` the second side asks the first one only."""

    def solve(tile: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = np.array(t.column("name").to_pylist(), object)
        order = np.argsort(names.astype(str), kind="stable")  # so that of equal cosines the smaller name counts
        names, side = names[order], t.column("side").to_numpy()[order]
        vec = t.column("vec").take(pa.array(order))
        copies = Copies(vec, side)
        x = unpacked(vec.take(pa.array(copies.first)))
        asks = np.ones(len(names), bool) if ask_share is None else spots(names.tolist()) % ask_share == 0
        asked = np.bincount(copies.of_row, asks) > 0
        if part_at is None:
            met = [(np.flatnonzero(side[copies.first] == 2), np.flatnonzero(side[copies.first] == 1))]
        else:
            met, parts = sides_of(side[copies.first]), parts_of(t)[order]
        for own, other in met:
            own, base = own[asked[own]], np.ascontiguousarray(x[other].T)
            for i in range(0, len(own), CHUNK):
                mine = own[i : i + CHUNK]
                if not len(other):
                    continue
                s = x[mine] @ base
                q, b = candidates(s, k + 1, floor)
                near, q, b = np.round(np.minimum(s[q, b].astype(np.float64), 1.0), _DIGITS), mine[q], other[b]
                if part_at is not None:
                    here = counts_here(int(part_at[tile]), parts[copies.first[q]], parts[copies.first[b]])
                    q, b, near = q[here], b[here], near[here]
                # A row may be among the first of its own copies, so one more of them is taken.
                a, c, pair = copies.expanded(q, b, k + 2)
                keep = (names[a] != names[c]) & asks[a]
                a, c, near = a[keep], c[keep], near[pair[keep]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.string()), pa.array(names[c], pa.string()), pa.array(near)], names=["name", "other", "cosine"])

    return solved(solve)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("name").orderBy(F.desc("cosine"), "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(vectors: DataFrame, router: Router, k: int = 10, lookups: int = LOOKUPS, min_cosine: float | None = None, ask_share: int | None = None) -> DataFrame:
    """For every vector the ``k`` most similar others: ``name, other, cosine, place``.

    ``vectors`` has ``name, vec`` as :func:`uttermill.llm.routing.unit_vectors` makes them, one row per name. Each
    vector is sent to its ``lookups`` most probable parts, keeps a place there and asks there, so two vectors meet if
    they have any of these parts in common; what is sent does not grow with the table. A pair that shares several parts
    leaves from one of them only. ``min_cosine`` leaves out less similar pairs before they are sent on; it changes none
    of the others. ``ask_share`` asks only for one name in so many, by hash, against all rows.

    A part holds about ``PART_ROWS`` times ``lookups`` rows in memory; one that is expected to see more than
    ``TILE_ROWS``, as many copies make it, is compared in tiles of so many, in which copies are compared once. Ties go to the smaller name. Fewer than
    ``k`` others give fewer rows; one vector or none gives no rows. Equal vectors are neighbours like any others. Extra
    columns are ignored.
    """
    laid = routed(vectors.select("name", "vec"), router, lookups, unpacked)
    return _first_k(laid.mapInArrow(_search(k, min_cosine, ask_share, part_of_tile(router)), _PAIRS), k)


def nearest_exact(vectors: DataFrame, k: int = 10, ask_share: int = 20) -> DataFrame:
    """The same for one name in ``ask_share``, by hash, against all rows: slices of both sides meet in tiles of bounded size."""
    n = vectors.count()
    slices, chunks = max(1, -(-n // TILE_ROWS)), max(1, -(-n // (ask_share * TILE_ROWS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def laid(out: pa.RecordBatch, tile: np.ndarray, side: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), pa.array(np.full(len(tile), side, np.int8)), *out.columns], names=["tile", "side", "name", "vec"])

        for batch in batches:
            if batch.num_rows:
                spot = spots(batch.column("name").to_pylist())
                for c in range(chunks):
                    yield laid(batch, c * slices + spot // ask_share % slices, 1)
                at = np.flatnonzero(spot % ask_share == 0)
                for j in range(slices):
                    yield laid(batch.take(pa.array(at)), spot[at] // ask_share % chunks * slices + j, 2)

    laid = laid_out(vectors.select("name", "vec").mapInArrow(send, "tile int, side tinyint, name string, vec binary"), slices * chunks)
    return _first_k(laid.mapInArrow(_search(k, None, None, None), _PAIRS), k)


def recall(vectors: DataFrame, router: Router, k: int = 10, lookups: int = LOOKUPS, ask_share: int = 20) -> DataFrame:
    """Share of the true ``k`` nearest that the routed search finds, for one name in ``ask_share`` against all rows."""
    true = nearest_exact(vectors, k, ask_share).select("name", "other")
    found = nearest(vectors, router, k, lookups, None, ask_share).select("name", "other", F.lit(1).alias("hit"))
    return true.join(found, ["name", "other"], "left").agg(
        F.count(F.lit(1)).alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("recall")
    )
