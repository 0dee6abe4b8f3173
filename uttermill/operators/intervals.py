"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

The state that is merged is a sorted list of disjoint intervals. It grows as a tree: batches of rows collapse where they
are read, blocks of one entity's time line collapse next, and only the two outer intervals of each block go on to the
last merge, which joins blocks. No task ever holds an entity as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermill.functions.storage import shuffle_width
from uttermill.functions.times import block_start, time_block

#: Rows that the first level collects before it merges them.
BUFFER_ROWS = 65_536
#: Stands for "no end known".
OPEN_END = 2**62

_PIECES = "entity string, block bigint, begin_ms bigint, end_ms bigint, own_begin bigint, own_end bigint, joined boolean"
_LISTS = f"{_PIECES}, kind string"
_ROWS = "entity string, kind string, begin_ms bigint, end_ms bigint"


class _Runs:
    """Columns of intervals. ``own_*`` is the first interval of a union, ``joined`` whether it holds another one."""

    names = ("begin_ms", "end_ms", "own_begin", "own_end", "joined")

    def __init__(self, group: np.ndarray, cols: dict[str, np.ndarray]):
        self.group, self.cols = group, cols

    @classmethod
    def of(cls, group: np.ndarray, batch: pa.RecordBatch | pa.Table) -> _Runs:
        return cls(group, {c: batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in cls.names})

    def merged(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Unions of overlapping or touching intervals; rows must lie by group, then begin. Also each union's first row."""
        g, c = self.group, self.cols
        if not len(g):
            return np.empty(0, np.int64), c
        begin, end = c["begin_ms"], c["end_ms"]
        fresh = np.r_[True, g[1:] != g[:-1]]
        number = np.cumsum(fresh) - 1
        low = int(end.min())
        step = int(end.max()) - low + 1
        if step * (int(number[-1]) + 1) < 2**62:
            reach = np.maximum.accumulate(end - low + number * step) - number * step + low
        else:  # one group at a time, where the offsets would not fit
            reach = end.copy()
            at = np.r_[np.flatnonzero(fresh), len(g)]
            for i, j in zip(at[:-1], at[1:]):
                reach[i:j] = np.maximum.accumulate(end[i:j])
        starts = fresh.copy()
        starts[1:] |= begin[1:] > reach[:-1]
        first = np.flatnonzero(starts)
        other = np.r_[False, (c["own_begin"][1:] != c["own_begin"][:-1]) | (c["own_end"][1:] != c["own_end"][:-1])]
        other &= ~starts
        last = np.r_[first[1:], len(g)] - 1
        return first, {
            "begin_ms": begin[first],
            "end_ms": reach[last],
            "own_begin": c["own_begin"][first],
            "own_end": c["own_end"][first],
            "joined": np.logical_or.reduceat(other | c["joined"].astype(bool), first),
        }


def _codes(*columns: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct combination of values."""
    code = np.zeros(len(columns[0]), np.int64)
    for x in columns:
        if pa.types.is_string(x.type) or pa.types.is_large_string(x.type):
            own = x.combine_chunks().dictionary_encode()
            own = (own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own).indices.to_numpy().astype(np.int64)
        else:
            _, own = np.unique(x.to_numpy(), return_inverse=True)
        code = code * (int(own.max(initial=0)) + 1) + own
    return code


def _collapse_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level one: what one task has read, some rows at a time, as disjoint sorted intervals per entity and block."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        group = _codes(t.column("entity"), t.column("block"))
        order = np.lexsort((t.column("end_ms").to_numpy(), t.column("begin_ms").to_numpy(), group))
        t = t.take(pa.array(order))
        first, cols = _Runs.of(group[order], t).merged()
        out = t.select(["entity", "block"]).take(pa.array(first))
        for name in _Runs.names:
            out = out.append_column(name, pa.array(cols[name]))
        yield from out.combine_chunks().to_batches()

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BUFFER_ROWS:
            yield from flush(held)
            held, rows = [], 0
    if held:
        yield from flush(held)


def _streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
    """Merge a stream sorted by keys and begin. The last union of each batch waits for the next one."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        runs = _Runs.of(_codes(*(t.column(k) for k in keys)), t)
        first, cols = runs.merged()
        out = t.take(pa.array(first))
        for name in _Runs.names:
            out = out.set_column(out.schema.get_field_index(name), name, pa.array(cols[name]))
        held = out.slice(out.num_rows - 1).combine_chunks()
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def _collapse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level two: each block's disjoint intervals. Those inside are final, as are the gaps between them; the outer two go on."""
    schema = pa.schema(
        [("entity", pa.string()), ("block", pa.int64()), ("begin_ms", pa.int64()), ("end_ms", pa.int64()),
         ("own_begin", pa.int64()), ("own_end", pa.int64()), ("joined", pa.bool_()), ("kind", pa.string())]
    )

    def rows(t: pa.Table, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        if t.num_rows:
            yield from t.append_column("kind", pa.array(kind, pa.string())).cast(schema).combine_chunks().to_batches()

    tail: pa.Table | None = None  # the last union so far, whose place in its block isn't known yet
    tail_first = True
    for t in _streamed(batches, ["entity", "block"]):
        t = pa.concat_tables([tail, t]) if tail is not None else t
        code = _codes(t.column("entity"), t.column("block"))
        change = code[1:] != code[:-1]
        is_first = np.r_[tail_first, change]
        is_last = np.r_[change, False]
        n = t.num_rows
        # Between neighbours of one block lies a gap that nothing else can fill.
        i = np.flatnonzero(~change)
        if len(i):
            gaps = t.take(pa.array(i))
            begin, end = t.column("end_ms").to_numpy()[i], t.column("begin_ms").to_numpy()[i + 1]
            gaps = gaps.set_column(2, "begin_ms", pa.array(begin)).set_column(3, "end_ms", pa.array(end))
            yield from rows(gaps, np.full(len(i), "gap"))
        kind = np.where(is_first & is_last, "only", np.where(is_first, "first", np.where(is_last, "last", "inner"))).astype(object)
        yield from rows(t.slice(0, n - 1), kind[: n - 1])
        tail, tail_first = t.slice(n - 1).combine_chunks(), bool(is_first[-1])
    if tail is not None:
        yield from rows(tail, np.array(["only" if tail_first else "last"], object))


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level three: one linear merge of the outer intervals of each entity's blocks. The last union of each batch waits for the next one.

    Between the first and the last interval of one block the gaps are known already.
    """
    held: pa.Table | None = None

    def rows(entity: pa.ChunkedArray, at: np.ndarray, kind: str, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            names = entity.take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([names, pa.array([kind] * len(at), pa.string()), pa.array(begin), pa.array(end)], names=["entity", "kind", "begin_ms", "end_ms"])

    def closed(entity: pa.ChunkedArray, cols: dict, kind: np.ndarray, upto: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Unions that nothing else can join, and the gaps behind them."""
        begin, end = cols["begin_ms"], cols["end_ms"]
        period = at[cols["joined"][at]]
        yield from rows(entity, period, "period", begin[period], end[period])
        gap = at[(kind[at] != "first") & (upto[at] > end[at])]
        yield from rows(entity, gap, "gap", end[gap], upto[gap])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        fresh = held is None
        t = t if fresh else pa.concat_tables([held, t])
        code = _codes(t.column("entity"))
        first, cols = _Runs.of(code, t).merged()
        entity = t.column("entity").take(pa.array(first))
        last = np.r_[first[1:], t.num_rows] - 1
        kind = np.array(t.column("kind").take(pa.array(last)).to_pylist(), object)
        new = np.r_[fresh, code[first[1:]] != code[first[:-1]]]  # the first union of its entity
        upto = np.r_[np.where(new[1:], OPEN_END, cols["begin_ms"][1:]), OPEN_END]
        head = np.flatnonzero(new & (cols["begin_ms"] > 0))
        yield from rows(entity, head, "gap", np.zeros(len(head), np.int64), cols["begin_ms"][head])
        yield from closed(entity, cols, kind, upto, np.arange(len(first) - 1))
        held = t.take(pa.array(first[-1:]))
        for name in _Runs.names:
            held = held.set_column(held.schema.get_field_index(name), name, pa.array(cols[name][-1:]))
        held = held.set_column(held.schema.get_field_index("kind"), "kind", pa.array(kind[-1:], pa.string())).combine_chunks()
    if held is not None:
        cols = {n: held.column(n).to_numpy() for n in _Runs.names}
        yield from closed(held.column("entity"), cols, np.array(held.column("kind").to_pylist(), object), np.array([OPEN_END]), np.array([0]))


def periods_and_gaps(intervals: DataFrame, lengths: DataFrame, min_gap_ms: int = 2_000, block_ms: int = 3_600_000) -> DataFrame:
    """Merge each entity's intervals into continuous periods and list what they leave uncovered.

    ``intervals`` has ``entity STRING, begin_ms BIGINT, end_ms BIGINT``, ``lengths`` has ``entity STRING, length_ms
    BIGINT`` with one row per entity; other columns are ignored. Only entities in both come out. Returns ``entity,
    kind, begin_ms, end_ms``: a ``period`` for each union of overlapping or touching intervals that holds at least two
    different ones (not clipped to the length), and a ``gap`` for each uncovered stretch of at least ``min_gap_ms``
    between 0 and the length.

    Defined cases: rows with a null, a negative begin or an end not above the begin are ignored; repeated rows count
    once; empty tables give no rows; ties need no rule, as equal intervals are one interval. An interval is cut at
    the borders of blocks of time (see :func:`uttermill.functions.times.time_block`), so it costs one row per block
    that it spans, a thousand and a few however long it is. A null or non-positive length leaves the entity out.
    """
    spark = intervals.sparkSession
    width = shuffle_width(spark)
    usable = intervals.select(F.col("entity").cast("string"), "begin_ms", "end_ms").where(
        "entity is not null and begin_ms >= 0 and end_ms > begin_ms"
    )
    spanned = F.sequence(time_block(F.col("begin_ms"), block_ms), time_block(F.col("end_ms") - 1, block_ms))
    cut = usable.select("entity", "begin_ms", "end_ms", F.explode(spanned).alias("block"))
    pieces = cut.select(
        "entity",
        "block",
        F.greatest("begin_ms", block_start(F.col("block"), block_ms)).alias("begin_ms"),
        F.least("end_ms", block_start(F.col("block") + 1, block_ms)).alias("end_ms"),
        F.col("begin_ms").alias("own_begin"),
        F.col("end_ms").alias("own_end"),
        F.lit(False).alias("joined"),
    )
    read = pieces.mapInArrow(_collapse_read, _PIECES)
    # A number of partitions given by hand is one that adaptive execution leaves whole: a key stays in one task.
    blocks = read.repartition(width, "entity", "block").sortWithinPartitions("entity", "block", "begin_ms", "end_ms")
    lists = blocks.mapInArrow(_collapse_blocks, _LISTS)
    outer = F.col("kind").isin("first", "last", "only")
    final = lists.where(~outer & ((F.col("kind") == "gap") | F.col("joined"))).select(
        "entity", F.when(F.col("kind") == "gap", "gap").otherwise("period").alias("kind"), "begin_ms", "end_ms"
    )
    joined = (
        lists.where(outer)
        .repartition(width, "entity")
        .sortWithinPartitions("entity", "begin_ms", "end_ms")
        .mapInArrow(_join_blocks, _ROWS)
    )
    known = lengths.select(F.col("entity").cast("string").alias("of"), "length_ms").where("length_ms > 0")
    end = F.when(F.col("kind") == "gap", F.least("end_ms", "length_ms")).otherwise(F.col("end_ms"))
    return (
        final.unionAll(joined)
        .join(known, F.col("entity") == F.col("of"))
        .select("entity", "kind", "begin_ms", end.alias("end_ms"))
        .where((F.col("kind") == "period") | (F.col("end_ms") - F.col("begin_ms") >= min_gap_ms))
    )
