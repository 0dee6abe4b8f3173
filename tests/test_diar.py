import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttermill.operators import diar as O


def _turns(seed, n=300):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(6)}", i, b, b + rng.randrange(1, 60), rng.choice("ab")) for i, b in enumerate(rng.sample(range(1_500), n))]


def test_merged_labels_equal_a_loop(spark):
    rows = _turns(1)
    want = set()
    for u in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[3], r[1]))
        begin, end, label = own[0][2], own[0][3], own[0][4]
        for _, _, b, e, spk in own[1:]:
            if b <= end and spk == label:
                end = e
            elif b > end:
                want.add((u, float(begin), float(end), label))
                begin, end, label = b, e, spk
            else:
                mid = (b + end) / 2
                want.add((u, float(begin), mid, label))
                begin, end, label = mid, e, spk
        want.add((u, float(begin), float(end), label))
    df = spark.createDataFrame(rows, "utt string, seg int, begin bigint, end bigint, label string")
    assert {tuple(r) for r in O.merged_labels(df, "utt", ("begin", "end", "seg")).select("utt", "begin", "end", "label").collect()} == want


def test_union_is_disjoint(spark):
    df = spark.createDataFrame(_turns(2), "utt string, seg int, begin bigint, end bigint, spk string")
    got = sorted((r["utt"], r["begin"], r["end"]) for r in O.interval_union(df, "utt").collect())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got, got[1:]))
    covered = lambda rows: {(u, t) for u, b, e in rows for t in range(b, e)}
    assert covered(got) == covered([(r[0], r[2], r[3]) for r in _turns(2)])


def test_most_overlapping_equals_all_pairs(spark):
    pieces = [(f"u{i % 3}", f"p{i}", 7 * i, 7 * i + 40) for i in range(80)]
    turns = [(u, i, b, e, s) for u, i, b, e, s in _turns(3) if u in ("u0", "u1", "u2")]
    want = {}
    for u, p, b, e in pieces:
        best = max(((min(e, y) - max(b, x), -o, s) for v, o, x, y, s in turns if v == u and x < e and b < y), default=None)
        if best:
            want[p] = (best[2], best[0])
    a = spark.createDataFrame(pieces, "utt string, piece string, begin bigint, end bigint")
    b = spark.createDataFrame(turns, "utt string, ordinal int, begin bigint, end bigint, spk string")
    assert {r["piece"]: (r["spk"], r["overlap_ms"]) for r in O.most_overlapping(a, b, "utt", "piece", 16).collect()} == want


def test_windows_cover_the_segment(spark):
    df = spark.createDataFrame([("a", 0, 1_000), ("b", 0, 1_500), ("c", 0, 1_510), ("d", 0, 5_000)], "seg string, begin_ms bigint, end_ms bigint")
    got = {}
    for r in O.subsegments(df).orderBy("seg", "begin_frame").collect():
        got.setdefault(r["seg"], []).append((r["begin_frame"], r["end_frame"]))
    want = {}
    for seg, n in (("a", 100), ("b", 150), ("c", 151), ("d", 500)):
        want[seg] = [(0, n)] if n <= 150 else [(b, min(b + 150, n)) for b in range(0, n - 150 + 75, 75)]
    assert got == want


def test_lines(spark):
    df = spark.createDataFrame([("u-1", 10, 1_500)], "utt string, b bigint, e bigint")
    r = df.select(O.rttm_line(F.col("utt"), F.col("b") / 1000, (F.col("e") - F.col("b")) / 1000, F.lit("7")).alias("l"), O.segment_id(F.col("utt"), F.col("b"), F.col("e")).alias("s")).first()
    assert r["l"] == "SPEAKER u-1 1 0.010 1.490 <NA> <NA> 7 <NA> <NA>" and r["s"] == "u-1-00000010-00001500"


def test_assignment_is_the_best_of_all_permutations():
    rng = np.random.default_rng(0)
    for rows, cols in ((1, 1), (3, 3), (4, 2), (2, 5), (5, 5)):
        for _ in range(20):
            gain = rng.integers(0, 6, (rows, cols)).astype(float)
            to = O.assigned(gain)
            n = max(rows, cols)
            square = np.zeros((n, n))
            square[:rows, :cols] = gain
            best = max(sum(square[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            used = [c for c in to if c >= 0]
            assert len(used) == len(set(used)) and sum(gain[i, c] for i, c in enumerate(to) if c >= 0) == best
    assert O.assigned(np.zeros((2, 3))).tolist() == [-1, -1]


def test_diarization_error_by_instants(spark):
    rng = random.Random(4)
    turns = lambda who: [(f"r{r}", b, b + rng.randrange(50, 400), f"{who}{rng.randrange(3)}") for r in range(4) for b in (rng.randrange(0, 2_000) for _ in range(6))]
    ref, hyp = turns("a") + [("only", 0, 1_000, "x"), ("r0", 5, 5, "z"), ("r0", None, 9, "z")], turns("b") + [("extra", 0, 700, "y")]
    kind = "reco string, begin bigint, end bigint, spk string"
    got = {r["reco"]: r for r in O.diarization_error(spark.createDataFrame(ref, kind), spark.createDataFrame(hyp, kind), "reco", 20).collect()}
    assert set(got) == {"r0", "r1", "r2", "r3", "only", "extra"}
    for key, row in got.items():
        r, h = ([t for t in side if t[0] == key and t[1] is not None and t[2] > t[1]] for side in (ref, hyp))
        near = {t for x in r for e in x[1:3] for t in range(e - 20, e + 20)}
        at = [t for t in range(-50, 3_000) if t not in near]
        on = lambda side: [{x[3] for x in side if x[1] <= t < x[2]} for t in at]
        a, b = on(r), on(h)
        names, others = sorted({x[3] for x in r}), sorted({x[3] for x in h})
        others += ["-"] * max(0, len(names) - len(others))
        right = max((sum(sum(m.get(s) in y for s in x) for x, y in zip(a, b)) for m in ({s: o for s, o in zip(names, p)} for p in itertools.permutations(others, len(names)))), default=0)
        assert row["scored_ms"] == sum(map(len, a))
        assert row["missed_ms"] == sum(max(len(x) - len(y), 0) for x, y in zip(a, b))
        assert row["false_ms"] == sum(max(len(y) - len(x), 0) for x, y in zip(a, b))
        assert row["confused_ms"] == sum(min(len(x), len(y)) for x, y in zip(a, b)) - right


def test_pieces_must_match_one_to_one(spark):
    a = spark.createDataFrame([("p", 1, [1.0]), ("q", 1, [2.0])], "piece string, begin int, emb array<double>")
    assert {r["piece"]: (r["a"], r["b"]) for r in O.matched(a, a, ["piece", "begin"], "emb").collect()} == {"p": ([1.0], [1.0]), "q": ([2.0], [2.0])}
    for b in (a.where("piece = 'p'"), a.unionAll(a.where("piece = 'q'")), a.unionAll(spark.createDataFrame([("r", 1, [3.0])], a.schema))):
        with pytest.raises(Exception, match="one to one"):
            O.matched(a, b, ["piece", "begin"], "emb").collect()


def test_overlap_of_endless_turns(spark):
    p = spark.createDataFrame([("r", "a", 0, 50), ("r", "b", 10**9, 10**15)], "reco string, piece string, begin bigint, end bigint")
    t = spark.createDataFrame([("r", 1, 20, 10**16, "x"), ("r", 2, 0, 30, "y")], "reco string, ordinal int, begin bigint, end bigint, spk string")
    assert {r["piece"]: (r["spk"], r["overlap_ms"]) for r in O.most_overlapping(p, t, "reco", "piece").collect()} == {"a": ("x", 30), "b": ("x", 10**15 - 10**9)}
