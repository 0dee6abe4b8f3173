import random
from collections import defaultdict

import numpy as np

from uttermill.llm.packing import balanced, pack


def _run(spark, rows, **options):
    df = spark.createDataFrame([(i, n, "x") for i, n in rows], "item bigint, n_tokens bigint, container string")
    return pack(df, **options).collect()


def test_every_token_once_and_no_container_too_full(spark):
    rng = random.Random(0)
    rows = [(i, int(rng.lognormvariate(4.5, 1.2))) for i in range(3_000)] + [(9_000, 2_048), (9_001, 2_049), (9_002, 100_000), (9_003, 0)]
    got = _run(spark, rows)
    room, parts = defaultdict(int), defaultdict(list)
    for r in got:
        room[r["container"]] += r["n_tokens"]
        parts[r["item"]].append(r)
    assert max(room.values()) <= 2_048
    for i, n in rows:
        p = sorted(parts[i], key=lambda r: r["piece_no"])
        assert sum(r["n_tokens"] for r in p) == n and len(p) == p[0]["n_pieces"] == max(1, -(-n // 2_048))
        assert [r["first_token"] for r in p] == [2_048 * k for k in range(len(p))]
    assert 1 - sum(room.values()) / (2_048 * len(room)) < 0.03


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 400, 2_000))[::-1]
    at = balanced(sizes, 2_048, 1.0, 1 / 2_048)
    cost = np.bincount(at, sizes + sizes**2 / 2_048)
    full = cost[np.bincount(at, sizes) > 1_900]
    assert full.std() / full.mean() < 0.05


def test_defined_cases(spark):
    assert _run(spark, []) == []
    got = _run(spark, [(None, 5), (1, None), (2, -3), (2, 7), (2, 7)], capacity=10)
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 5, 7, 7]
    assert len({r["container"] for r in _run(spark, [(i, 10) for i in range(5)], capacity=10)}) == 5
