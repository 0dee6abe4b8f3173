"""Rows sent to the parts of a learned partition, where every two that share a part meet once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermill.functions.storage import shuffle_width
from uttermill.llm.routing import Router, Tiles

#: Tiles that one task handles, one after the other.
TILES_PER_TASK = 2
#: Rows that are compared with a tile at once.
CHUNK = 1_024


def spots(names: list[str]) -> np.ndarray:
    """A non-negative hash of each name."""
    return (pd.util.hash_array(np.array(names, object), categorize=False) >> np.uint64(1)).astype(np.int64)


def laid_out(rows: DataFrame, tile_count: int) -> DataFrame:
    """Rows of one ``tile`` next to each other, and tiles spread evenly over the tasks."""
    width = max(shuffle_width(rows.sparkSession), -(-tile_count // TILES_PER_TASK))
    return rows.repartitionById(width, F.pmod("tile", F.lit(width)).cast("int")).sortWithinPartitions("tile")


def routed(vectors: DataFrame, router: Router, lookups: int, unpack: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Each row of ``name, vec`` and other columns once for each of its ``lookups`` most probable parts, laid out in tiles.

    Adds ``tile, side, parts``; the parts, as bytes, tell which tile is the one where two rows that share several parts
    count. A part that is expected to see many rows has several tiles, see :class:`Tiles`.
    """
    tiles = Tiles.of(router)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            top = router.top(unpack(batch.column("vec")), lookups)
            own = np.ascontiguousarray(top, np.int32)
            width = own.shape[1] * 4
            parts = pa.Array.from_buffers(pa.binary(width), len(own), [None, pa.py_buffer(own)]).cast(pa.binary())
            spot = spots(batch.column("name").to_pylist())
            for j in range(top.shape[1]):
                for at, tile, side in tiles.places(top[:, j], spot):
                    take = pa.array(at)
                    out = batch.take(take)
                    cols = [pa.array(tile.astype(np.int32)), pa.array(side.astype(np.int8)), parts.take(take), *out.columns]
                    yield pa.RecordBatch.from_arrays(cols, names=["tile", "side", "parts", *batch.schema.names])

    kinds = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    return laid_out(vectors.mapInArrow(send, f"tile int, side tinyint, parts binary, {kinds}"), tiles.count)


def part_of_tile(router: Router) -> np.ndarray:
    """The part that each tile belongs to."""
    cuts = Tiles.of(router).cuts
    return np.repeat(np.arange(len(cuts)), cuts * (cuts + 1) // 2)


def solved(solve: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]):
    """A function over batches that hands each tile to ``solve`` as a whole; the layout bounds its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tile = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = batch.column("tile").to_numpy()
            cuts = np.r_[0, np.flatnonzero(tiles[1:] != tiles[:-1]) + 1, len(tiles)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if tiles[i] != tile and held:
                    yield from solve(int(tile), pa.Table.from_batches(held))
                    held = []
                tile = tiles[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield from solve(int(tile), pa.Table.from_batches(held))

    return run


def parts_of(t: pa.Table) -> np.ndarray:
    """The column that :func:`routed` adds, as numbers."""
    return np.frombuffer(b"".join(t.column("parts").to_pylist()), np.int32).reshape(t.num_rows, -1)


def counts_here(part: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows, given by their parts, have ``part`` as the smallest one that they share."""
    least = np.full(len(a), np.iinfo(np.int32).max, np.int32)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            np.minimum(least, a[:, i], out=least, where=a[:, i] == b[:, j])
    return least == part


def sides_of(side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows of a tile meet which others."""
    whole = np.flatnonzero(side == 0)
    if len(whole):
        return [(whole, whole)]
    a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    return [(a, b), (b, a)] if len(a) and len(b) else []


class Copies:
    """Rows of a tile by their vectors: exact copies on one side are compared once, by their first row."""

    def __init__(self, vec: pa.ChunkedArray, side: np.ndarray):
        own = vec.combine_chunks().dictionary_encode()
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        code = own.indices.to_numpy().astype(np.int64) * 3 + side
        _, first, self.of_row, self.size = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        # In the order of the first rows.
        order = np.argsort(first)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.first, self.size, self.of_row = first[order], self.size[order], place[self.of_row]
        self.rows = np.argsort(self.of_row, kind="stable")
        self.starts = np.cumsum(self.size) - self.size

    def expanded(self, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of copies' classes as pairs of rows: every row of the one with the first ``most`` rows of the other, and which pair each comes from."""
        right = np.minimum(self.size[b], most)
        n = self.size[a] * right
        pair = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        return self.rows[self.starts[a][pair] + at // right[pair]], self.rows[self.starts[b][pair] + at % right[pair]], pair
