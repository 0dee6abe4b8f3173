import random

import pytest
from pyspark.sql import functions as F

from uttermill.functions.times import block_start, time_block
from uttermill.operators.intervals import periods_and_gaps


def plain(rows, lengths, min_gap):
    out = set()
    for who, length in lengths.items():
        own = sorted({(b, e) for w, b, e in rows if w == who and b is not None and e is not None and b >= 0 and e > b})
        if length is None or length <= 0 or not own:
            continue
        unions = []
        for b, e in own:
            if unions and b <= unions[-1][1]:
                unions[-1] = [unions[-1][0], max(e, unions[-1][1]), unions[-1][2] + 1]
            else:
                unions.append([b, e, 1])
        out |= {(who, "period", b, e) for b, e, n in unions if n > 1}
        at = 0
        for b, e, _ in unions:
            out |= {(who, "gap", at, min(b, length))} if min(b, length) - at >= min_gap else set()
            at = e
        out |= {(who, "gap", at, length)} if length - at >= min_gap else set()
    return out


def run(spark, rows, lengths, **options):
    i = spark.createDataFrame([(*r, "x", 1) for r in rows], "entity string, begin_ms bigint, end_ms bigint, block string, kind int")
    n = spark.createDataFrame(list(lengths.items()), "entity string, length_ms bigint")
    found = [tuple(r) for r in periods_and_gaps(i, n, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed,block", [(1, 50), (2, 200), (3, 3_600_000), (4, 7)])
def test_equals_a_plain_loop(spark, seed, block):
    rng = random.Random(seed)
    rows = [(f"r{rng.randrange(12)}", b, b + rng.choice([-3, 0, 1, 5, 20, 90, 400])) for b in (rng.randrange(-5, 2_000) for _ in range(700))]
    rows += rng.choices(rows, k=150) + [("r1", None, 4), ("r2", 4, None), (None, 1, 2)]
    lengths = {f"r{k}": rng.choice([0, 500, 1_900, 5_000]) for k in range(14)}
    assert run(spark, rows, lengths, min_gap_ms=20, block_ms=block) == plain(rows, lengths, 20)


def test_touching_repeats_and_borders(spark):
    rows = [("a", 0, 100), ("a", 100, 200), ("b", 0, 300), ("b", 0, 300), ("c", 50, 150), ("d", 99, 101)]
    lengths = dict.fromkeys("abcd", 1_000)
    assert run(spark, rows, lengths, min_gap_ms=1, block_ms=100) == plain(rows, lengths, 1)


def test_hot_entity_and_empty_tables(spark):
    rows = [("hot", 10 * i, 10 * i + (12 if i % 3 else 5)) for i in range(30_000)] + [("cold", 0, 5)]
    lengths = {"hot": 400_000, "cold": 5, "none": 7}
    assert run(spark, rows, lengths, min_gap_ms=2, block_ms=1_000) == plain(rows, lengths, 2)
    assert run(spark, [], {"a": 5}) == set()
    assert run(spark, [("a", 0, 5)], {}) == set()


def test_intervals_of_any_length(spark):
    """One row that never seems to end costs no more than some blocks, and what it covers is no gap."""
    rows = [("a", 5, 10**16), ("a", 100, 200), ("b", 10**12, 10**12 + 50), ("b", 10**12 + 40, 10**15), ("b", 3, 9)] + [("c", k * 1_000, k * 1_000 + 400) for k in range(3_000)] + [("c", 500_000, 2_000_000)]
    lengths = {"a": 5_000, "b": 10**13, "c": 10**7}
    assert run(spark, rows, lengths, min_gap_ms=1, block_ms=100) == plain(rows, lengths, 1)
    assert run(spark, rows, lengths, min_gap_ms=1) == plain(rows, lengths, 1)


def test_blocks_of_time(spark):
    at = [0, 9, 10, 9_999, 10_000, 19_999, 20_000, 39_999, 40_000, 79_999, 80_000, 10**16]
    df = spark.createDataFrame([(x,) for x in at], "x bigint").select("x", time_block(F.col("x"), 10).alias("b"))
    got = df.select("x", "b", block_start(F.col("b"), 10).alias("s"), block_start(F.col("b") + 1, 10).alias("e")).orderBy("x").collect()
    assert [r["b"] for r in got][:-1] == [0, 0, 1, 999, 1000, 1000, 1001, 1001, 1002, 1002, 1003] and all(r["s"] <= r["x"] < r["e"] for r in got)
