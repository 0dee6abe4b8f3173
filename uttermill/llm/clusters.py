"""Grouping records into similarity clusters by density peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermill.functions.storage import drop_written, shuffle_width, written
from uttermill.llm.routing import Router, router_of, unpacked
from uttermill.llm.tiles import CHUNK, Copies, counts_here, part_of_tile, parts_of, routed, sides_of, solved

#: Most probable parts in which each vector meets others, and in which those that found no denser one meet again.
LOOKUPS, PEAK_LOOKUPS = 3, 6
#: Most typical members that a cluster is described by.
TYPICAL = 3

_COUNTS = "name string, n bigint"
_LINKS = "name string, peak string, cosine double, density bigint, vec binary"
_SUMS = "cluster string, total binary"
_FITS = "cluster string, fit double, name string"


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return unpacked(column, small=True)


def followed(to: np.ndarray) -> np.ndarray:
    """The peak that each pointer chain ends in."""
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def denser(x: np.ndarray, rank: np.ndarray, own: np.ndarray, other: np.ndarray, to: np.ndarray, near: np.ndarray) -> None:
    """For each row of ``own`` the most similar row of ``other`` with a lower ``rank``, into ``to``, and its cosine, into ``near``.

    Ranks are distinct, and 0 is the densest, so pointers to denser rows lead to peaks without cycles.
    """
    other = other[np.argsort(rank[other])]
    base, order = np.ascontiguousarray(x[other].T), rank[other]
    for i in range(0, len(own), CHUNK):
        mine = own[i : i + CHUNK]
        s = x[mine] @ base
        s[rank[mine][:, None] <= order[None, :]] = -2
        best = np.argmax(s, axis=1)
        value = s[np.arange(len(s)), best]
        has = value > near[mine]
        to[mine[has]], near[mine[has]] = other[best[has]], value[has]


def _count(least: float, part_at: np.ndarray):
    """Neighbours of each row within a tile, of pairs that share several parts in one of them only."""

    def solve(tile: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        copies = Copies(t.column("vec"), t.column("side").to_numpy())
        first = pa.array(copies.first)
        x, parts, side = _unpacked(t.column("vec").take(first)), parts_of(t)[copies.first], t.column("side").to_numpy()[copies.first]
        n = np.zeros(len(x), np.int64)
        for own, other in sides_of(side):
            base = np.ascontiguousarray(x[other].T)
            for i in range(0, len(own), CHUNK):
                mine = own[i : i + CHUNK]
                q, b = np.nonzero(x[mine] @ base >= least)
                a, b = mine[q], other[b]
                here = counts_here(int(part_at[tile]), parts[a], parts[b])
                # Of its own copies all but itself count.
                n += np.bincount(a[here], copies.size[b[here]] - (a == b)[here], len(n)).astype(np.int64)
        n = n[copies.of_row]
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([t.column("name").take(pa.array(some)).combine_chunks(), pa.array(n[some])], names=["name", "n"])

    return solved(solve)


def _link(least: float, part_at: np.ndarray):
    """Within a tile, each row's cosine with the nearest denser one, and the peak that such pointers lead to from it.

    Pointers count if their cosine is at least ``least``. A row that has none in its most probable part bears its
    vector, as it may be a peak.
    """

    def solve(tile: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        names, dense = np.array(t.column("name").to_pylist(), object), t.column("density").to_numpy()
        by = np.lexsort((names.astype(str), -dense))
        t = t.take(pa.array(by))
        names, dense, side = names[by], dense[by], t.column("side").to_numpy()
        # Rows lie by rank now, so the first of some copies is the densest.
        copies = Copies(t.column("vec"), side)
        x, place = _unpacked(t.column("vec").take(pa.array(copies.first))), np.arange(len(copies.first))
        goal, value = place.copy(), np.full(len(place), -2.0, np.float32)
        for own, other in sides_of(side[copies.first]):
            denser(x, copies.first, own, other, goal, value)
        to, near = copies.first[goal][copies.of_row], value[copies.of_row]
        again = (copies.first[copies.of_row] != np.arange(len(names))) & (side == 0)
        to[again], near[again] = copies.first[copies.of_row[again]], 1.0
        peak = followed(np.where(near >= least, to, np.arange(len(names))))
        alone = (near < least) & (parts_of(t)[:, 0] == part_at[tile])
        vec = pa.array([v if a else None for v, a in zip(t.column("vec").to_pylist(), alone)], pa.binary())
        cols = [pa.array(names, pa.string()), pa.array(names[peak], pa.string()), pa.array(near.astype(np.float64)), pa.array(dense), vec]
        yield pa.RecordBatch.from_arrays(cols, names=["name", "peak", "cosine", "density", "vec"])

    return solved(solve)


def _linked(rows: DataFrame, router: Router, lookups: int, least: float) -> DataFrame:
    """``name, peak, cosine, density, vec``: of the tiles of each row, what that with the nearest denser row says."""
    links = routed(rows.select("name", "density", "vec"), router, lookups, _unpacked).mapInArrow(_link(least, part_of_tile(router)), _LINKS)
    best = links.groupBy("name").agg(F.max(F.struct("cosine", "peak")).alias("b"), F.max("density").alias("density"), F.max("vec").alias("vec"))
    return best.select("name", F.when(F.col("b.cosine") >= least, F.col("b.peak")).otherwise(F.col("name")).alias("peak"), "b.cosine", "density", "vec")


def _met(peaks: DataFrame, lookups: int, least: float, max_rounds: int = 20) -> DataFrame:
    """``peak, over``: the denser peak within ``least`` that each peak has met, if any.

    Peaks meet in the parts of a partition that is learned from peaks; those that are left meet again in those of
    another one, until a meeting changes nothing. So none is lost for the number of parts.
    """
    left, links = written(peaks.select("name", "density", "vec"), "peaks"), None
    for k in range(max_rounds):
        found = written(_linked(left, router_of(left, seed=100 + k, small=True), lookups, least), "met")
        new = found.where("name <> peak").select(F.col("name").alias("peak"), F.col("peak").alias("over"))
        links = new if links is None else links.unionAll(new)
        drop_written(left)
        if not new.limit(1).count():
            return links
        left = written(found.where("name = peak").select("name", "density", "vec"), "peaks")
    raise RuntimeError(f"peaks still met denser ones after {max_rounds} rounds")


def _roots(pointers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``peak, root``: pointers ``peak, to`` followed to their ends by doubling, a join a round."""
    now = written(pointers.select("peak", F.col("to").alias("root"), (F.col("peak") != F.col("to")).alias("moved")), "pointers")
    for _ in range(max_rounds):
        if not now.where("moved").limit(1).count():
            return now.select("peak", "root")
        ends = now.select(F.col("peak").alias("p"), F.col("root").alias("r"))
        nxt = written(now.join(ends, F.col("root") == F.col("p")).select("peak", F.col("r").alias("root"), (F.col("r") != F.col("root")).alias("moved")), "pointers")
        drop_written(now)
        now = nxt
    raise RuntimeError(f"pointers did not end in {max_rounds} rounds")


def _sum_bytes(x: np.ndarray) -> pa.Array:
    """Rows as single-precision bytes."""
    return pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary())


def _sums(column: pa.Array) -> np.ndarray:
    """The rows of :func:`_sum_bytes`, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each cluster of rows that lie together."""

    def rows(clusters: list[str], sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(clusters, pa.string()), _sum_bytes(sums)], names=["cluster", "total"])

    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.array(batch.column("cluster").to_pylist(), object)
        cuts = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1]
        owners, sums = names[cuts], np.add.reduceat(_sums(batch.column("total")), cuts, axis=0)
        if held is not None:
            if owners[0] == last:
                sums[0] += held
            else:
                yield rows([last], held[None])
        if len(owners) > 1:
            yield rows(owners[:-1].tolist(), sums[:-1])
        last, held = owners[-1], sums[-1]
    if held is not None:
        yield rows([last], held[None])


def _best_fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch and cluster, the members nearest the cluster's centre."""
    for batch in batches:
        if not batch.num_rows:
            continue
        centre = _sums(batch.column("total"))
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        fit = np.round(np.einsum("ij,ij->i", unpacked(batch.column("vec"), small=True), centre), 6)
        _, label = np.unique(np.array(batch.column("cluster").to_pylist(), object).astype(str), return_inverse=True)
        names = np.array(batch.column("name").to_pylist(), object).astype(str)
        by = np.lexsort((names, -fit, label))
        place = np.arange(len(by)) - np.searchsorted(label[by], label[by])
        kept = by[place < TYPICAL]
        yield pa.RecordBatch.from_arrays([batch.column("cluster").take(pa.array(kept)), pa.array(fit[kept]), batch.column("name").take(pa.array(kept))], names=["cluster", "fit", "name"])


def _typical(vectors: DataFrame, local: DataFrame, roots: DataFrame) -> DataFrame:
    """``cluster, typical``: the members of the whole cluster that are nearest the centre of all its members.

    Vectors are summed by the peak that they point to, of which no more come than a few tiles hold, then by cluster.
    Members meet the centre by their peak, and a few of each batch go on.
    """
    width = shuffle_width(local.sparkSession)
    members = written(vectors.join(local.select("name", "peak"), "name").repartition(width, "peak").sortWithinPartitions("peak"), "members")

    def as_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("peak"), _sum_bytes(_unpacked(batch.column("vec")))], names=["cluster", "total"])

    def of_peak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(as_sums(batches))

    sums = members.mapInArrow(of_peak, _SUMS).withColumnRenamed("cluster", "peak").join(roots, "peak").select(F.col("root").alias("cluster"), "total")
    centres = sums.repartition(width, "cluster").sortWithinPartitions("cluster").mapInArrow(_summed, _SUMS)
    at_peak = roots.withColumnRenamed("root", "cluster").join(centres, "cluster")
    fits = members.join(at_peak, "peak").select("cluster", "total", "name", "vec").mapInArrow(_best_fits, _FITS)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("fit")).alias("far"), F.col("name").alias("name")))), 1, TYPICAL)
    return fits.groupBy("cluster").agg(best.alias("best")).select("cluster", F.col("best.name").alias("typical"))


def cluster(vectors: DataFrame, router: Router, least: float = 0.63, lookups: int = LOOKUPS, peak_lookups: int = PEAK_LOOKUPS) -> tuple[DataFrame, DataFrame]:
    """Clusters by density peaks, from neighbours that meet in the parts of a learned partition.

    ``vectors`` has ``name, vec`` as :func:`uttermill.llm.routing.unit_vectors` makes them with one byte for a value,
    one row per name. Returns ``name, cluster, first`` for every vector and ``cluster, size, first, typical`` for every
    cluster: its name is that of its peak, ``first`` its smallest member, ``typical`` up to ``TYPICAL`` members nearest
    the centre of all its members, best first.

    Each vector meets those with which it shares any of its ``lookups`` most probable parts. Its density is the number
    of those within a cosine of ``least``, itself included, over all of these parts; among them, the nearest one of
    higher density is found next. Peaks are the vectors whose distance to a denser one is more than ``least`` allows.
    As a voice's vectors may share no part, peaks then meet each other in ``peak_lookups`` parts of partitions learned
    from peaks, until a meeting changes nothing, and one within ``least`` of a denser one is none. Every other vector points towards its nearest denser one, and pointers are
    followed to labels.

    What is sent per vector is the same at every size, no task holds more than a tile, and only pointers of peaks are
    joined repeatedly. Equal densities go by name. A lone vector is a cluster of one. No rows give no clusters. Extra
    columns are ignored.
    """
    vectors = vectors.select("name", "vec")
    counted = routed(vectors, router, lookups, _unpacked).mapInArrow(_count(least, part_of_tile(router)), _COUNTS)
    density = vectors.join(counted.groupBy("name").agg(F.sum("n").alias("n")), "name", "left")
    ranked = density.select("name", (F.coalesce("n", F.lit(0)) + 1).alias("density"), "vec")
    local = written(_linked(ranked, router, lookups, least), "local")
    met = _met(local.where(F.col("cosine") < least), peak_lookups, least)
    aims = local.select(F.col("peak").alias("p")).distinct()
    pointers = local.select(F.col("name").alias("peak"), F.col("peak").alias("to")).join(aims, F.col("peak") == F.col("p"), "left_semi").join(met, "peak", "left")
    roots = _roots(pointers.select("peak", F.coalesce("over", "to").alias("to")))
    sized = local.groupBy("peak").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("first")).join(roots, "peak")
    groups = written(sized.groupBy(F.col("root").alias("cluster")).agg(F.sum("size").alias("size"), F.min("first").alias("first")), "clusters")
    of_peak = roots.join(groups.select("cluster", "first"), F.col("root") == F.col("cluster")).select("peak", "cluster", "first")
    members = local.select("name", "peak").join(of_peak, "peak").select("name", "cluster", "first")
    return members, groups.join(_typical(vectors, local, roots), "cluster")
