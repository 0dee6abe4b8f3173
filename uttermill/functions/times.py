"""Times in seconds as whole milliseconds, and the latest of several versions of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values below this are packed under a load time; about 31,000 years in milliseconds.
_ROOM = 10**15
#: Added to load times so that those of all years of a timestamp are positive when packed; a missing one counts 0.
_EPOCH = 10**17
#: Blocks of time of equal width; those behind double.
EVEN_BLOCKS = 1_000


def finite(x: Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def seconds_to_ms(x: Column) -> Column:
    """Seconds to the nearest whole millisecond (halves away from zero); null stays null."""
    return F.round(x.cast("double") * 1000).cast("bigint")


def latest_key(loaded_at: Column, value: Column) -> Column:
    """A decimal that orders rows by load time, then by value, and carries the value: ``max`` of it is the latest one.

    A fixed-width number keeps the aggregate in hash form with map-side combining, where ``max(struct)`` would sort.
    Rows without a load time count as older than any that have one; equal load times give the larger value. Values are
    not negative.
    """
    micros = F.coalesce(F.unix_micros(loaded_at.cast("timestamp")) + F.lit(_EPOCH), F.lit(0)).cast("decimal(20,0)")
    return (micros * F.lit(_ROOM).cast("decimal(16,0)") + value.cast("decimal(16,0)")).cast("decimal(38,0)")


def latest_value(packed: Column) -> Column:
    """The value carried by the maximum of :func:`latest_key`."""
    return (packed % F.lit(_ROOM).cast("decimal(16,0)")).cast("bigint")


def time_block(ms: Column, width: int) -> Column:
    """The number of the block of time that a point lies in: even blocks of ``width`` first, each of the others as long as all before it.

    So what spans any stretch of time, however long, spans at most ``EVEN_BLOCKS`` blocks and a few.
    """
    even = F.floor(ms / F.lit(width)).cast("bigint")
    doubled = F.lit(EVEN_BLOCKS - 1) + F.length(F.bin(F.floor(even / EVEN_BLOCKS)))
    return F.when(even < EVEN_BLOCKS, even).otherwise(doubled).cast("bigint")


def block_start(block: Column, width: int) -> Column:
    """The first point of a block of :func:`time_block`."""
    over = F.greatest(block - EVEN_BLOCKS, F.lit(0)).cast("int")
    return F.when(block < EVEN_BLOCKS, block * width).otherwise((F.pow(F.lit(2.0), over) * (EVEN_BLOCKS * width)).cast("bigint"))
