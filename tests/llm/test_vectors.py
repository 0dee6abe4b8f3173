from datetime import datetime, timedelta

import numpy as np
import pytest

from uttermill.llm import clusters, neighbours, routing, tiles

T0 = datetime(2024, 1, 1)
ONE_PART = routing.Linear(np.zeros((128, 1), np.float32), np.zeros(1, np.float32))
KIND = "utt string, emb array<float>, loaded_at timestamp, vec int, block string"


def _table(spark, rows):
    return spark.createDataFrame([(u, v, t, 1, "x") for u, v, t in rows], KIND)


def _voices(n, k, seed=0, d=128, spread=0.53):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((k, d)) / np.sqrt(d)
    y = rng.integers(k, size=n)
    x = c[y] + spread * rng.standard_normal((n, d)) / np.sqrt(d)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), y


def _small(df):
    return routing.unit_vectors(df, "utt", "emb", "loaded_at", small=True)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(routing, "PART_ROWS", 256)
    monkeypatch.setattr(routing, "FIT_ROWS", 1_024)


def test_latest_usable_vector(spark):
    good, other = [1.0] + [0.0] * 127, [0.0, 2.0] + [0.0] * 126
    rows = [
        ("a", good, T0), ("a", other, T0 + timedelta(1)), ("a", [float("nan")] * 128, T0 + timedelta(2)), ("b", good[:99], T0), ("c", [0.0] * 128, T0), ("d", None, T0),
        (None, good, T0), ("e", [None] + good[1:], T0), ("f", good, None), ("f", good, None), ("g", [float("inf")] + good[1:], T0), ("h", [1e-30] * 128, T0), ("i", [3e38] * 128, T0),
    ]
    got = {r["name"]: routing.unpacked(__import__("pyarrow").array([r["vec"]]))[0] for r in routing.unit_vectors(_table(spark, rows), "utt", "emb", "loaded_at").collect()}
    assert set(got) == {"a", "f", "h", "i"}
    assert got["a"][1] == pytest.approx(1) and got["f"][0] == pytest.approx(1) and all(np.linalg.norm(v) == pytest.approx(1, abs=1e-3) for v in got.values())


def test_packing_keeps_cosines():
    x, _ = _voices(200, 5)
    y = routing.unpacked(routing.packed(x))
    assert np.abs(x @ x.T - y @ y.T).max() < 2e-4


def test_cut_is_balanced_and_keeps_neighbours_together():
    x, _ = _voices(2_000, 60)
    at, near = routing.neighbour_graph(x, 10)
    part, _, _ = routing.balanced_cut(x, at, near, 8, np.random.default_rng(0))
    size = np.bincount(part, minlength=8)
    assert size.max() <= 1.3 * 250 and size.min() >= 0.7 * 250
    assert (part[at] == part[:, None]).mean() > 0.85


def _exact(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k], s


def test_recall_and_threshold(spark, small_parts):
    x, _ = _voices(2_500, 100)
    x[1_000:1_200] = x[:200] + 0.02 * np.random.default_rng(1).standard_normal((200, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = _table(spark, [(f"u{i:05}", v.tolist(), T0) for i, v in enumerate(x)])
    vectors, router = routing.unit_vectors(df, "utt", "emb", "loaded_at"), routing.learned_router(df, "utt", "emb", "loaded_at")
    assert router.parts == 10
    at, s = _exact(x, 10)
    found = {(r["name"], r["other"]) for r in neighbours.nearest(vectors, router).collect()}
    true = {(f"u{i:05}", f"u{j:05}") for i, row in enumerate(at) for j in row}
    assert len(found & true) / len(true) >= 0.9
    assert neighbours.recall(vectors, router, ask_share=5).first()["recall"] >= 0.9
    near = {(f"u{i:05}", f"u{j:05}") for i, j in zip(*np.nonzero(s >= 0.9005))}
    got = {(r["name"], r["other"]) for r in neighbours.nearest(vectors, router, min_cosine=0.9).collect()}
    assert len(near & got) >= 0.99 * len(near) and all(s[int(a[1:]), int(b[1:])] > 0.899 for a, b in got)


def test_tiles_of_one_part_are_searched_together(spark, monkeypatch):
    x, _ = _voices(300, 3)
    df = _table(spark, [(f"u{i:05}", v.tolist(), T0) for i, v in enumerate(x)])
    vectors = routing.unit_vectors(df, "utt", "emb", "loaded_at")
    monkeypatch.setattr(routing, "TILE_ROWS", 100)
    router = routing.Router(ONE_PART, expected=np.array([300.0]))
    assert routing.Tiles.of(router).count == 21
    at, _ = _exact(routing.unpacked(routing.packed(x)), 5)
    got = {(r["name"], r["other"]) for r in neighbours.nearest(vectors, router, k=5).collect()}
    assert len(got & {(f"u{i:05}", f"u{j:05}") for i, row in enumerate(at) for j in row}) >= 0.998 * 1_500 and len(got) == 1_500


def test_ties_few_rows_and_empty(spark):
    same = [1.0] + [0.0] * 127
    df = _table(spark, [(n, same, T0) for n in "dcba"])
    vectors, router = routing.unit_vectors(df, "utt", "emb", "loaded_at"), routing.learned_router(df, "utt", "emb", "loaded_at")
    got = {(r["name"], r["place"]): r["other"] for r in neighbours.nearest(vectors, router, k=2).collect()}
    assert got == {("a", 1): "b", ("a", 2): "c", ("b", 1): "a", ("b", 2): "c", ("c", 1): "a", ("c", 2): "b", ("d", 1): "a", ("d", 2): "b"}
    for rows in ([], [("a", same, T0)]):
        df = _table(spark, rows)
        vectors, router = routing.unit_vectors(df, "utt", "emb", "loaded_at"), routing.learned_router(df, "utt", "emb", "loaded_at")
        assert neighbours.nearest(vectors, router).count() == 0
        members, groups = clusters.cluster(_small(df), router)
        assert members.count() == len(rows) and groups.count() == len(rows)


@pytest.mark.parametrize("tile_rows", [16_384, 200])
def test_clusters_are_voices(spark, small_parts, monkeypatch, tile_rows):
    monkeypatch.setattr(routing, "TILE_ROWS", tile_rows)
    x, y = _voices(2_000, 60, seed=4, spread=0.45)
    y[:700], x[:700] = 0, (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(x[y == 0][:1] + 0.03 * np.random.default_rng(2).standard_normal((700, 128)).astype(np.float32))
    df = _table(spark, [(f"u{i:05}", v.tolist(), T0) for i, v in enumerate(x)])
    vectors, router = routing.unit_vectors(df, "utt", "emb", "loaded_at"), routing.learned_router(df, "utt", "emb", "loaded_at")
    members, groups = clusters.cluster(_small(df), router, least=0.6)
    got = {r["name"]: (r["cluster"], r["first"]) for r in members.collect()}
    assert len(got) == 2_000
    s = x @ x.T
    up = np.arange(len(x))
    for i in range(len(x)):  # components of the threshold graph
        near = np.flatnonzero(s[i] >= 0.6)
        for k in {up[j] for j in near}:
            up[up == k] = min(up[near])
    want = {f"u{i:05}": f"u{up[i]:05}" for i in range(len(x))}
    assert sum(got[n][1] == w for n, w in want.items()) >= 0.99 * len(want)
    rows = groups.collect()
    assert sum(r["size"] for r in rows) == 2_000 and all(1 <= len(r["typical"]) <= 3 for r in rows)
    assert all(r["typical"][0] in got and got[r["typical"][0]][0] == r["cluster"] for r in rows)


def test_pointers_go_to_the_nearest_denser_vector():
    x, _ = _voices(200, 4, seed=3, spread=0.4)
    dense = (x @ x.T >= 0.6).sum(1)
    rank = np.empty(200, np.int64)
    rank[np.lexsort((np.arange(200), -dense))] = np.arange(200)
    to, near, every = np.arange(200), np.full(200, -2.0, np.float32), np.arange(200)
    clusters.denser(x, rank, every, every, to, near)
    s = np.where(rank[:, None] > rank[None, :], x @ x.T, -2)
    assert (s.argmax(1)[rank > 0] == to[rank > 0]).all() and np.allclose(s.max(1)[rank > 0], near[rank > 0], atol=1e-6)
    peak = clusters.followed(np.where(near >= 0.6, to, every))
    assert (near[peak] < 0.6).all() and (rank[peak] <= rank).all()


def test_density_counts_all_parts(spark, small_parts):
    """Over parts that share rows, every neighbour counts once."""
    x, _ = _voices(1_500, 20, seed=5, spread=0.4)
    df = _table(spark, [(f"u{i:05}", v.tolist(), T0) for i, v in enumerate(x)])
    vectors, router = _small(df), routing.learned_router(df, "utt", "emb", "loaded_at")
    assert router.parts == 6
    laid = tiles.routed(vectors, router, 6, clusters._unpacked).mapInArrow(clusters._count(0.63, tiles.part_of_tile(router)), "name string, n bigint")
    got = {r["name"]: r["n"] for r in laid.groupBy("name").agg({"n": "sum"}).toDF("name", "n").collect()}
    x = routing.unpacked(routing.packed(x, small=True), small=True)
    want = (x @ x.T >= 0.63).sum(1) - 1
    assert sum(got.get(f"u{i:05}", 0) == n for i, n in enumerate(want)) >= 1_498  # sums of bytes may round otherwise at the border


def test_local_clusters_meet_whatever_their_parts(spark):
    """Two vectors of each voice with a cosine of 0.68 whose 20 most probable parts of 40 have none in common."""
    rng = np.random.default_rng(7)
    u = rng.standard_normal((30, 128))
    u[:, 0] = 0
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x = np.concatenate([np.sqrt(0.84) * u + 0.4 * np.eye(128)[0], np.sqrt(0.84) * u - 0.4 * np.eye(128)[0]])
    weights = np.zeros((128, 40), np.float32)
    weights[0] = np.where(np.arange(40) < 20, 50, -50)
    router = routing.Router(routing.Linear(weights, np.zeros(40, np.float32)))
    df = _table(spark, [(f"u{i:02}", v.tolist(), T0) for i, v in enumerate(x)])
    members, _ = clusters.cluster(_small(df), router)
    assert {r["name"]: r["first"] for r in members.collect()} == {f"u{i:02}": f"u{i % 30:02}" for i in range(60)}


def test_typical_members_are_those_of_all_tiles(spark, monkeypatch):
    """One voice over many tiles, and another one: the members nearest the centre of all, as in a single tile."""
    x, y = _voices(400, 2, seed=8, spread=0.45)
    df = _table(spark, [(f"u{i:03}", v.tolist(), T0) for i, v in enumerate(x)])
    x = routing.unpacked(routing.packed(x, small=True), small=True)
    want = {}
    for k in range(2):
        own = np.flatnonzero(y == k)
        centre = x[own].sum(0) / np.linalg.norm(x[own].sum(0))
        want[f"u{own[0]:03}"] = [f"u{own[i]:03}" for i in np.argsort(-(x[own] @ centre))[:3]]
    for tile_rows in (16_384, 100):
        monkeypatch.setattr(routing, "TILE_ROWS", tile_rows)
        _, groups = clusters.cluster(_small(df), routing.Router(ONE_PART, expected=np.array([400.0])))
        assert {r["first"]: list(r["typical"]) for r in groups.collect()} == want


def test_recall_holds_with_two_levels_of_parts(spark, monkeypatch):
    """More parts than one model may tell apart: groups are told first, then the parts of several groups."""
    monkeypatch.setattr(routing, "PART_ROWS", 10)
    monkeypatch.setattr(routing, "FLAT_PARTS", 64)
    x, _ = _voices(3_000, 600, spread=0.5)
    df = _table(spark, [(f"u{i:05}", v.tolist(), T0) for i, v in enumerate(x)])
    vectors, router = routing.unit_vectors(df, "utt", "emb", "loaded_at"), routing.learned_router(df, "utt", "emb", "loaded_at")
    assert len(router.inner) == 10 and router.parts == 300
    loose = neighbours.nearest(vectors, router, lookups=8, min_cosine=0.6).select("name", "other").collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    near = {(f"u{i:05}", f"u{j:05}") for i, j in zip(*np.nonzero(s >= 0.6))}
    assert len(near & {tuple(r) for r in loose}) >= 0.9 * len(near)


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 64)
    x, _ = _voices(500, 30, seed=6)
    df = _table(spark, [(f"u{i:05}", v.tolist(), T0) for i, v in enumerate(x)])
    got = {}
    for r in neighbours.nearest_exact(routing.unit_vectors(df, "utt", "emb", "loaded_at"), 5, ask_share=2).collect():
        got.setdefault(r["name"], {})[r["place"]] = r["other"]
    at, _ = _exact(routing.unpacked(routing.packed(x)), 5)
    assert 200 <= len(got) <= 300
    assert sum(got[n].get(p + 1) == f"u{at[int(n[1:]), p]:05}" for n in got for p in range(5)) >= 0.995 * 5 * len(got)


def test_candidates_hold_the_best_of_each_row():
    rng = np.random.default_rng(0)
    s = rng.random((50, 700)).astype(np.float32)
    s[3] = 0.5  # all alike
    s[4, ::2] = 0.99
    for floor in (None, 0.97):
        q, b = neighbours.candidates(s, 11, floor)
        for i in range(50):
            best = np.sort(s[i])[::-1][:11]
            mine = np.sort(s[i, b[q == i]])[::-1]
            best = best if floor is None else best[best >= floor]
            assert (mine[: len(best)] == best).all() and len(mine) <= 44
    assert set(neighbours.candidates(s[3:4], 11, None)[1]) == set(range(11))


def test_small_tiles_give_the_same_clusters(spark, monkeypatch):
    """A, B and C of falling size in one plane: C is near B only, B near A. In whatever tiles they lie, they are one cluster."""
    rows, weights = [], np.zeros((128, 3), np.float32)
    for k in range(12):
        for role, n in enumerate((3, 2, 1)):
            v = np.zeros(128)
            v[2 * k], v[2 * k + 1] = np.cos(role * np.radians(50)), np.sin(role * np.radians(50))
            weights[:, role] += 50 * v
            rows += [(f"u{k:02}-{role}-{i}", v.tolist(), T0) for i in range(n)]
    vectors = _small(_table(spark, rows))
    for tile_rows in (16_384, 12):
        monkeypatch.setattr(routing, "TILE_ROWS", tile_rows)
        router = routing.Router(routing.Linear(weights, np.zeros(3, np.float32)), expected=np.full(3, 72.0))
        members, _ = clusters.cluster(vectors, router)
        assert {r["name"]: r["first"] for r in members.collect()} == {n: f"{n[:3]}-0-0" for n, _, _ in rows}


@pytest.mark.parametrize("tile_rows", [16_384, 150])
def test_many_copies_of_one_vector(spark, monkeypatch, tile_rows):
    """A third of the rows are copies, among others that are twofold: the same neighbours and clusters as by brute force."""
    monkeypatch.setattr(routing, "TILE_ROWS", tile_rows)
    x, _ = _voices(400, 40, seed=9)
    x = np.concatenate([x, np.repeat(x[:1], 220, 0), x[10:30]])
    names = [f"u{i:03}" for i in np.random.default_rng(1).permutation(len(x))]
    df = _table(spark, [(n, v.tolist(), T0) for n, v in zip(names, x)])
    router = routing.Router(ONE_PART, expected=np.array([640.0]))
    vectors = routing.unit_vectors(df, "utt", "emb", "loaded_at")
    y = routing.unpacked(routing.packed(x))
    s = np.round(np.minimum((y @ y.T).astype(np.float64), 1.0), 5)
    got = {}
    for r in neighbours.nearest(vectors, router, k=5).collect():
        got.setdefault(r["name"], {})[r["place"]] = r["other"]
    wrong = 0
    for i, n in enumerate(names):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], names[j]))[:5]
        wrong += [got[n][p + 1] for p in range(5)] != [names[j] for j in order]
    assert wrong <= 3  # sums of another order may round otherwise
    pairs = {(r["name"], r["other"]) for r in neighbours.nearest(vectors, router, k=5, min_cosine=0.9).collect()}
    assert all(s[names.index(a), names.index(b)] >= 0.9 for a, b in pairs) and {(a, b) for a, v in got.items() for b in v.values() if s[names.index(a), names.index(b)] >= 0.9005} <= pairs
    z = routing.unpacked(routing.packed(x, small=True), small=True)
    up = np.arange(len(x))
    for i in range(len(x)):
        near = np.flatnonzero(z[i] @ z.T >= 0.63)
        for k in {up[j] for j in near}:
            up[up == k] = min(up[near])
    members, groups = clusters.cluster(_small(df), router)
    first = {r["name"]: r["first"] for r in members.collect()}
    want = {k: min(names[i] for i in np.flatnonzero(up == k)) for k in set(up)}
    assert sum(first[names[i]] == want[up[i]] for i in range(len(x))) >= 0.99 * len(x)
    assert sum(r["size"] for r in groups.collect()) == len(x)
