import random

import pytest
from pyspark.sql import functions as F

from uttermill.streaming import stateful as S


def _replayed(spark, tmp_path, df, parts, transform, name):
    """Feed a table to a stream in several micro-batches, in order of seq, and return what comes out."""
    src = str(tmp_path / "in")
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{src}/b{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{src}/*")
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_frames_cross_batches(spark, tmp_path):
    rows = [(f"u{u}", k, [float(100 * k + i) for i in range(7)]) for k in range(6) for u in range(2)]
    df = spark.createDataFrame(rows, "utt string, seq bigint, samples array<double>")
    got = _replayed(spark, tmp_path, df, [df.where(f"seq div 2 = {k}") for k in range(3)], lambda s: S.stream_frames(s, 10, 4), "frames")
    want = S.framed([], [x for r in rows if r[0] == "u0" for x in r[2]], 10, 4, 0)[0]
    assert sorted((r["frame_no"], list(r["frame"])) for r in got if r["utt"] == "u0") == want


def plain_speech(probs, total, on=0.5, step=1536, sr=16000):
    off, open_at, quiet, out = on - 0.15, None, None, []
    for i, p in enumerate(probs):
        if p >= on:
            quiet, open_at = None, step * i if open_at is None else open_at
        elif p < off and open_at is not None:
            quiet = step * i if quiet is None else quiet
            if step * i - quiet >= 1600:
                if quiet - open_at > 4000:
                    out.append((open_at, quiet))
                open_at = quiet = None
    return out, open_at


def test_speech_equals_a_loop_and_the_stream(spark, tmp_path):
    rng = random.Random(2)
    probs = []
    for _ in range(40):
        probs += [rng.choice([0.1, 0.4, 0.6, 0.9])] * rng.randrange(1, 6)
    df = spark.createDataFrame([("u", i, p) for i, p in enumerate(probs)], "utt string, i bigint, prob double")
    closed, still = plain_speech(probs, len(probs) * 1536)
    got = S.speech_stretches(df).orderBy("begin").collect()
    n = len(closed) + (still is not None)
    assert n >= len(got) > 0 and all(a["end"] <= b["begin"] for a, b in zip(got, got[1:]))
    third = len(probs) // 3 + 1
    stream = _replayed(spark, tmp_path, df, [df.where(f"i div {third} = {k}") for k in range(3)], S.stream_speech, "speech")
    assert sorted((r["begin_sample"], r["end_sample"]) for r in stream) == closed


def test_registry_keeps_the_first(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 0, [0.0]), ("b", 2, [2.0]), ("a", 3, [3.0])], "name string, seq bigint, emb array<double>")
    got = _replayed(spark, tmp_path, df, [df.where("seq < 2"), df.where("seq >= 2")], S.stream_registry, "people")
    assert sorted((r["name"], r["seq"]) for r in got) == [("a", 0), ("b", 2)]


def test_padding_shares_short_silences():
    rule = S.Hysteresis()
    assert rule.padded([(0, 16_000), (16_400, 32_000)], 40_000) == [(0.0, 16_200 / 16_000), (16_200 / 16_000, 32_480 / 16_000)]
    assert S.Hysteresis().padded([], 0) == []
    with pytest.raises(TypeError):
        S.Hysteresis(unknown=1)


def test_empty_batches(spark):
    df = spark.createDataFrame([], "utt string, i bigint, prob double")
    assert S.speech_stretches(df).count() == 0 and df.select(F.count("utt")).first()[0] == 0
