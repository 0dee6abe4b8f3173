"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECES = "item string, length_ms bigint, piece_no int, begin_ms bigint, end_ms bigint, cut string, cut_kind string"

Span = tuple[int, int]


def stretches(spans: Sequence[Span], min_pause: int) -> list[Span]:
    """Stretches of speech, where silences below ``min_pause`` count as speech. Spans may lie in any order and overlap."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin - out[-1][1] < min_pause:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def bisected(length: int, pauses: Sequence[Span], most: int, overlap: int = 0) -> list[tuple[int, str]]:
    """Where to cut ``0..length`` so that no part exceeds ``most``: the ends of all parts, and how each end came about.

    A part that is too long is cut at its strongest boundary near the midpoint: the middle of the longest pause in its
    central half, else of the longest one elsewhere in it (ties: nearest to the midpoint, then the earlier), else at
    the midpoint itself. A pause whose middle is no further than ``overlap`` from an edge of the part does not count,
    as the overlap would reach across the piece.
    """
    done: list[tuple[int, str]] = []
    todo = [(0, length, "end")]
    while todo:
        begin, end, how = todo.pop()
        if end - begin <= most:
            done.append((end, how))
            continue
        middle = (begin + end) // 2
        inside = [(b + (e - b) // 2, e - b) for b, e in pauses if begin + overlap < b + (e - b) // 2 < end - overlap]
        central = [p for p in inside if abs(p[0] - middle) <= (end - begin) // 4]
        best = min(central or inside, key=lambda p: (-p[1], abs(p[0] - middle), p[0]), default=None)
        at, kind = (best[0], "pause") if best else (middle, "forced")
        todo += [(at, end, how), (begin, at, kind)]
    return done


def kept_whole(cuts: list[tuple[int, str]], spoken: Sequence[Span], limit: int, overlap: int) -> list[tuple[int, str]]:
    """Cuts moved off the stretches of speech that fit into a piece.

    Bisection puts cuts into the middle of pauses, which may leave less room than a long stretch needs. A stretch of
    at most ``limit`` that holds a forced cut gets a piece that begins in the pause before it, by a cut at that pause's
    end or, where the stretch needs the room, less than ``overlap`` behind it (``overlap``), and that ends where the
    stretch does or in the pause after it.
    """
    most = limit - overlap
    for s, e in spoken:
        if e - s > limit or not any(how == "forced" and s < at < e for at, how in cuts):
            continue
        before, after = [c for c in cuts if c[0] <= s], [c for c in cuts if c[0] >= e]
        free = not before and e <= limit  # the first piece has no overlap
        if after[0][0] > e and after[0][0] - (0 if free else s) > (limit if free else most):
            # The cut behind moves back to the stretch's end, unless the part behind it would grow too long.
            if after[0][1] != "end" and after[1][0] - e <= most:
                after.pop(0)
            after.insert(0, (e, "pause"))
        if not free:
            at = max(s, after[0][0] - most, overlap + 1)
            # The cut before moves up, unless the part before it would grow too long.
            if before and at - (before[-2][0] if len(before) > 1 else 0) <= most:
                before.pop()
            before.append((at, "pause" if at == s else "overlap"))
        cuts = before + after
    return cuts


def split_oversized(
    items: DataFrame, limit_ms: int = 30_000, overlap_ms: int = 500, min_pause_ms: int = 300
) -> DataFrame:
    """Cut items longer than ``limit_ms`` into pieces of at most that length, in pauses where there are any.

    ``items`` has ``item STRING, length_ms BIGINT, spans ARRAY<STRUCT<begin_ms, end_ms>>`` (speech; null if unknown),
    one row per item; other columns are ignored. Returns ``item, length_ms, piece_no, begin_ms, end_ms, cut,
    cut_kind``. Pieces cover the item; each but the first begins ``overlap_ms`` before the end of the one before, and
    begins and ends rise. ``cut`` tells how a piece's end was found: ``pause``, ``overlap`` (just behind a
    pause, in which the next piece begins), ``forced`` or ``end``. ``cut_kind`` is
    ``forced`` if any cut of the item is or a stretch of speech, taken as stated even beyond the item's end, exceeds
    the limit, else ``pause``. A forced cut is made only where spans are unknown or a stretch exceeds the limit, as
    every other stretch comes out whole in one piece.

    Items within the limit, of null length or with a null name give no rows. Spans that are null, reversed or empty
    are ignored; an empty list means silence throughout; repeated and overlapping
    spans count once. The work per item grows with its own pieces and pauses only, and rows are handled in Arrow
    batches after the short items have gone.
    """
    if not 0 <= overlap_ms < limit_ms // 2:
        raise ValueError("the overlap must lie below half the limit")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(batch.column("item").to_pylist(), batch.column("length_ms").to_pylist(), batch.column("spans").to_pylist())
            for item, length, spans in rows:
                spoken = stretches([(s["begin_ms"], s["end_ms"]) for s in spans or ()], min_pause_ms)
                edges = [0, *(min(x, length) for s in spoken for x in s), length]
                silent = list(zip(edges[::2], edges[1::2])) if spans is not None else []
                pauses = [(b, e) for b, e in silent if e - b >= min_pause_ms]
                inside = [(b, min(e, length)) for b, e in spoken if b < length]
                ends = kept_whole(bisected(length, pauses, limit_ms - overlap_ms, overlap_ms), inside, limit_ms, overlap_ms)
                kind = "forced" if any(how == "forced" for _, how in ends) or any(e - b > limit_ms for b, e in spoken) else "pause"
                begin = 0
                for no, (end, how) in enumerate(ends):
                    out.append((item, length, no, begin, end, how, kind))
                    begin = end - overlap_ms
            if out:
                cols = list(zip(*out))
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["item", "length_ms", "piece_no", "begin_ms", "end_ms", "cut", "cut_kind"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    long = items.select(F.col("item").cast("string"), F.col("length_ms").cast("bigint"), "spans").where(
        F.col("item").isNotNull() & (F.col("length_ms") > limit_ms)
    )
    usable = F.filter("spans", lambda s: (s["end_ms"] > s["begin_ms"]) & (s["begin_ms"] >= 0))
    return long.withColumn("spans", usable).mapInArrow(cut, _PIECES)


def spans_of_texts(vad: Column) -> Column:
    """``ARRAY<ARRAY<STRING>>`` of seconds as spans in whole milliseconds; what cannot be read becomes null."""
    as_ms = lambda x: F.round(x.try_cast("decimal(20,6)") * 1000).cast("bigint")
    return F.transform(vad, lambda p: F.struct(as_ms(F.get(p, F.lit(0))).alias("begin_ms"), as_ms(F.get(p, F.lit(1))).alias("end_ms")))
