import hashlib
import random

import pytest

from uttermill.llm.grouping import assign_splits, connected_components, star_edges


def plain(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "cliques"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)],
        "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(150)],
        "star": [("hub", f"n{i}") for i in range(400)],
        "cliques": [(f"c{k}-{i}", f"c{k}-{j}") for k in range(5) for i in range(8) for j in range(8)],
    }[shape] + [(None, "n1"), ("n1", None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == plain(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_stars_are_linear(spark):
    rows = [(f"n{i}", "hot") for i in range(500)] + [("n1", "e"), ("n2", "e"), (None, "e"), ("n9", None)] + [("n1", "e")] * 5
    edges = star_edges(spark.createDataFrame([(*r, 1) for r in rows], "node string, entity string, a int"))
    assert edges.count() <= 501
    assert all(r["a"] > r["b"] for r in edges.collect())


def _shares(spark, weights, shares):
    df = spark.createDataFrame(weights, "component string, weight bigint")
    rows = assign_splits(df, spark.createDataFrame(shares, "split_name string, target_share double")).collect()
    total = sum(r["weight"] for r in rows)
    out = {}
    for r in rows:
        out[r["split_name"]] = out.get(r["split_name"], 0) + r["weight"] / total
    return rows, out


def test_shares_are_met_by_hash_and_by_weight(spark):
    shares = [("train", 0.8), ("valid", 0.1), ("test", 0.1)]
    rows, got = _shares(spark, [(f"c{i}", 1) for i in range(40_000)], shares)
    assert len(rows) == 40_000 and all(abs(got[n] - s) < 0.01 for n, s in shares)
    rows, got = _shares(spark, [(f"c{i}", 1 + (i % 97)) for i in range(800)] + [("hot", 20_000)], shares)
    assert all(abs(got[n] - s) < 0.005 for n, s in shares)


def test_hash_ranges_follow_the_weights(spark):
    """No component is heavy, so the hash decides: the ranges are whole, and the weights in them are as the shares."""
    shares = [("a", 0.5), ("b", 0.3), ("c", 0.2)]
    weights = [(f"c{i}", 1 + (i * i) % 50) for i in range(3_000)]
    rows, got = _shares(spark, weights, shares)
    assert all(abs(got[n] - s) < 0.002 for n, s in shares)
    point = {r["component"]: int(hashlib.md5(f"17|{r['component']}".encode()).hexdigest()[:8], 16) // 2**16 for r in rows}
    order = [r["split_name"] for r in sorted(rows, key=lambda r: point[r["component"]])]
    assert order == sorted(order)
    more, _ = _shares(spark, [(f"{c}-{k}", w) for c, w in weights for k in range(10)], shares)
    assert {r["split_name"] for r in more} == {"a", "b", "c"}


def test_a_third_of_the_weight_in_one_component(spark):
    for hot in ("hot", "warm", "x1", "x2"):
        _, got = _shares(spark, [(f"c{i}", 3) for i in range(2_000)] + [(hot, 3_000)], [("train", 0.8), ("valid", 0.1), ("test", 0.1)])
        assert abs(got["train"] - 0.8) < 0.002 and abs(got["test"] - 0.1) < 0.002


def test_defined_cases(spark):
    rows, got = _shares(spark, [("a", 5)], [("x", 2.0), ("y", 1.0), ("z", 0.0), (None, 1.0), ("w", None)])
    assert got == {"x": 1.0}
    assert _shares(spark, [], [("x", 1.0)])[0] == []
    assert _shares(spark, [(None, 3), ("a", None), ("b", 1)], [("x", 1.0)])[1] == {"x": 1.0}
    with pytest.raises(ValueError):
        _shares(spark, [("a", 1)], [])
