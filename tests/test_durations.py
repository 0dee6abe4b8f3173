from datetime import datetime

from pyspark.sql import functions as F

from uttermill.functions.times import latest_key, latest_value
from uttermill.plans import datadir, models

T0 = datetime(2024, 1, 1)


def _tables(spark, path):
    """Two speakers with a long utterance each whose only length is in milliseconds, and lengths that are no use."""
    lengths = [("a", 7_000.0), ("b", 3.0), ("g", 8_250.0), ("h", 4.0), ("c", float("inf")), ("c", float("nan")), ("d", None), ("d", -5_000.0), ("e", 1_000.0)]
    speakers = [("a", "s1"), ("b", "s1"), ("c", "s1"), ("g", "s2"), ("h", "s2"), ("d", "s2"), ("e", "s3")]
    spark.createDataFrame([(*r, T0) for r in lengths], "utt string, dur double, loaded_at timestamp").write.parquet(f"{path}/utt2dur.parquet")
    spark.createDataFrame([(*r, T0, None) for r in speakers], "utt string, spk string, loaded_at timestamp, removed_at timestamp").write.parquet(f"{path}/utt2spk.parquet")
    return str(path)


def test_lengths_in_milliseconds_count_as_seconds(spark, tmp_path):
    got = {r["utt"]: r["dur"] for r in datadir.all_durations(spark, _tables(spark, tmp_path)).collect()}
    assert got == {"a": 7.0, "b": 3.0, "g": 8.25, "h": 4.0, "e": 1_000.0}


def test_latest_values(spark):
    """Of several lengths the latest counts, also before 1970; unknown times are the oldest."""
    rows = [("a", 5_000, datetime(1960, 5, 1)), ("a", 7_000, datetime(1950, 1, 1)), ("b", 1, None), ("b", 2, datetime(1930, 1, 1)), ("c", 3, None), ("c", 9, None), ("d", 4, T0), ("d", 6, T0)]
    df = spark.createDataFrame(rows, "k string, v bigint, t timestamp").groupBy("k").agg(F.max(latest_key(F.col("t"), F.col("v"))).alias("m"))
    assert {r["k"]: r["v"] for r in df.select("k", latest_value(F.col("m")).alias("v")).collect()} == {"a": 5_000, "b": 2, "c": 9, "d": 6}


def test_queries_without_sql_keep_lengths_in_milliseconds(spark, tmp_path):
    path = _tables(spark, tmp_path)
    trials = datadir.dd_calibration_trials(spark, path).collect()
    assert trials and {u for r in trials for u in (r["enroll"], r["test"])} == {"a", "b", "g", "h"}
    total = {}
    for r in models.m_combined_utterances(spark, path).collect():
        total[r["spk"]] = total.get(r["spk"], 0) + r["dur"]
    assert total == {"s1": 10.0, "s2": 12.25, "s3": 1_000.0}
