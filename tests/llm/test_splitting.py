import random

from pyspark.sql import functions as F

from uttermill.llm.splitting import bisected, kept_whole, spans_of_texts, split_oversized, stretches

KIND = "item string, length_ms bigint, spans array<struct<begin_ms: bigint, end_ms: bigint>>, cut string, x int"


def _run(spark, rows, **options):
    df = spark.createDataFrame([(i, n, s, "mine", 1) for i, n, s in rows], KIND)
    out = {}
    for r in split_oversized(df, **options).orderBy("item", "piece_no").collect():
        out.setdefault(r["item"], []).append(r)
    return out


def test_pieces_cover_the_item_with_overlap(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        at, spans = 0, []
        n = rng.randrange(20_000, 300_000)
        while at < n:
            b = at + rng.choice([50, 290, 310, 900])
            at = b + rng.randrange(500, 12_000)
            spans.append((b, at))
        rows.append((f"i{k}", n, rng.sample(spans, len(spans))))
    got = _run(spark, rows)
    assert set(got) == {i for i, n, _ in rows if n > 30_000}
    for i, n, spans in rows:
        if i not in got:
            continue
        p = got[i]
        assert p[0]["begin_ms"] == 0 and p[-1]["end_ms"] == n and p[-1]["cut"] == "end"
        assert all(0 < r["end_ms"] - r["begin_ms"] <= 30_000 for r in p)
        assert all(b["begin_ms"] == a["end_ms"] - 500 for a, b in zip(p, p[1:]))
        longest = max(e - b for b, e in stretches(spans, 300))
        assert {r["cut_kind"] for r in p} == {"pause" if longest <= 30_000 else "forced"}
        silent = stretches(spans, 300)
        for r in p[:-1]:
            if r["cut"] == "pause":
                assert all(not b < r["end_ms"] < e for b, e in silent)


def test_defined_cases(spark):
    got = _run(
        spark,
        [
            ("short", 30_000, None), ("null", None, None), (None, 90_000, None), ("no vad", 59_000, None), ("silent", 45_000, []),
            ("odd", 40_000, [(19_000, 18_000), (None, 5), (0, 19_900), (20_400, 40_000), (0, 19_900)]), ("long", 10_000_000, None),
        ],
    )
    assert set(got) == {"no vad", "silent", "odd", "long"}
    assert [r["cut"] for r in got["no vad"]] == ["forced", "end"] and got["no vad"][0]["cut_kind"] == "forced"
    assert {r["cut_kind"] for r in got["silent"]} == {"pause"} and [r["cut"] for r in got["silent"]][0] == "pause"
    assert [(r["begin_ms"], r["end_ms"]) for r in got["odd"]] == [(0, 20_150), (19_650, 40_000)]
    assert len(got["long"]) >= 334
    assert _run(spark, []) == {}


def test_any_spans_give_whole_pieces():
    """Leading, trailing and short pauses and stretches close to the limit: pieces cover the item, rise, and keep to the limit."""
    for seed in range(4_000):
        rng = random.Random(seed)
        n, at, spans = rng.randrange(30_001, 200_000), rng.choice([0, 100, 400, 600, 20_000]), []
        while at < n:
            end = at + rng.choice([rng.randrange(200, 8_000), rng.randrange(28_000, 30_001), 29_500, 30_000, 31_000 if seed % 3 == 0 else 1_000])
            spans.append((at, end))
            at = end + rng.choice([300, 301, 310, 500, 900, 5_000])
        spoken = [(b, min(e, n)) for b, e in stretches(spans, 300)]
        edges = [0, *(x for s in spoken for x in s), n]
        pauses = [(b, e) for b, e in zip(edges[::2], edges[1::2]) if e - b >= 300]
        cuts = kept_whole(bisected(n, pauses, 29_500, 500), spoken, 30_000, 500)
        begin, last = 0, -1
        for end, how in cuts:
            assert last < begin and 0 <= begin < end <= begin + 30_000, seed
            last, begin = begin, end - 500
        assert cuts[-1] == (n, "end")
        assert any(how == "forced" for _, how in cuts) == any(e - b > 30_000 for b, e in spoken), seed


def test_pauses_at_the_edges(spark):
    got = _run(spark, [("lead", 40_000, [(400, 40_000)]), ("tail", 60_000, [(0, 59_700)]), ("long", 60_500, [(0, 300), (700, 30_600), (31_000, 60_500)])])
    assert [(r["begin_ms"], r["end_ms"]) for r in got["lead"]] == [(0, 20_000), (19_500, 40_000)]
    assert all(r["begin_ms"] >= 0 for rows in got.values() for r in rows)
    # Both stretches of just under 30 s come out whole.
    assert {r["cut_kind"] for r in got["long"]} == {"pause"}
    for b, e in ((700, 30_600), (31_000, 60_500)):
        assert any(r["begin_ms"] <= b and e <= r["end_ms"] for r in got["long"])


def test_strongest_boundary_near_the_midpoint():
    assert bisected(100, [(10, 30), (44, 48), (58, 64)], 70) == [(61, "pause"), (100, "end")]
    assert bisected(100, [(10, 30)], 85) == [(20, "pause"), (100, "end")]
    assert bisected(100, [], 60) == [(50, "forced"), (100, "end")]


def test_texts_as_spans(spark):
    df = spark.createDataFrame([([["0.150", "1.1100"], ["x", "2"], ["3"], None],), (None,)], "v array<array<string>>")
    rows = [r[0] for r in df.select(spans_of_texts(F.col("v")).alias("s")).collect()]
    assert [tuple(s) for s in rows[0]] == [(150, 1110), (None, 2000), (3000, None), (None, None)] and rows[1] is None
