"""Readers of text tables. Every reader keeps ``line_no``, which orders the lines of a file, as later lines overwrite earlier ones."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermill.functions.storage import mounted, shuffle_width
from uttermill.sources.sinks import NO_VALUE


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of text files, which are read in splits, however large they are.

    ``line_no`` rises with the lines of a file but leaves numbers out: it is where the split begins, in bytes, and how
    many lines the task has read before. A line takes a byte or more, so no two lines of a file share one.
    """
    before = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + before).alias("line_no"), F.col("value").alias("line"))


def _tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """``key, value, line_no`` of key-value lines; the rest of a line is one value with single blanks. Pipes stay text and are never run."""
    t = lines(spark, path).where(F.trim("line") != "").select("line_no", _tokens(F.col("line")).alias("t"))
    return t.select(F.get("t", F.lit(0)).alias("key"), F.array_join(F.slice("t", 2, 2**30), " ").alias("value"), "line_no")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.trim("line").alias("item"), "line_no").where("item <> ''")


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """``tokens ARRAY<STRING>, line_no``."""
    return lines(spark, path).where(F.trim("line") != "").select(_tokens(F.col("line")).alias("tokens"), "line_no")


def last_of_key(rows: DataFrame) -> DataFrame:
    """``key, value`` with the last line of each key."""
    return rows.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """``enroll, test, label``; two columns leave the label null, other numbers of columns drop the line."""
    t = read_ragged(spark, path).where(F.size("tokens").isin(2, 3))
    return t.select(F.get("tokens", F.lit(0)).alias("enroll"), F.get("tokens", F.lit(1)).alias("test"), F.get("tokens", F.lit(2)).alias("label"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``key, emb`` of lines of a key and numbers; of a key's lines the last counts. What is no number becomes null."""
    t = read_ragged(spark, path).select(F.get("tokens", F.lit(0)).alias("key"), F.transform(F.slice("tokens", 2, 2**30), lambda x: x.try_cast("float")).alias("value"), "line_no")
    return last_of_key(t).withColumnRenamed("value", "emb")


def read_turns(spark: SparkSession, path: str, least_fields: int = 8, any_kind: bool = False) -> DataFrame:
    """``utt, channel, begin, dur, spk, line_no`` of RTTM files; comments, short lines and, unless asked for, other kinds of lines are left out."""
    kind = F.get("tokens", F.lit(0))
    t = read_ragged(spark, path).where((~kind.startswith("#") if any_kind else kind == "SPEAKER") & (F.size("tokens") >= least_fields))
    at = lambda i: F.get("tokens", F.lit(i))
    return t.select(at(1).alias("utt"), at(2).try_cast("int").alias("channel"), at(3).try_cast("double").alias("begin"), at(4).try_cast("double").alias("dur"), at(7).alias("spk"), "line_no").dropna(subset=["begin", "dur"])


def read_turn_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, value``: the lines of all folders that :func:`uttermill.sources.sinks.write_turn_files` wrote.

    In a mounted folder one task passes on the names of the folders, and all tasks open them; the driver holds none.
    """
    root = mounted(spark, path)
    if root is None:
        return spark.read.schema("value string, name string").text(path).select(F.coalesce("name", F.lit("")).alias("name"), "value")

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with os.scandir(root) as there:
                names = (e.name for e in there if e.name.startswith("name=") and e.is_dir())
                while some := list(itertools.islice(names, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["folder"])

    def lines_of(folder: str) -> Iterator[tuple[str, str]]:
        held = folder.split("=", 1)[1]
        name = "" if held == NO_VALUE else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), held)
        with os.scandir(os.path.join(root, folder)) as there:
            files = sorted(e.path for e in there if e.name[0] not in "._")
        for file in files:
            with open(file, "rb") as f:
                for line in f:
                    yield name, line.removesuffix(b"\n").decode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(lines_of(folder) for b in batches for folder in b.column("folder").to_pylist())
        while some := list(itertools.islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], names=["name", "value"])

    # A number of tasks is given, as the names of many folders are few bytes, of which few tasks would be made.
    there = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string").repartition(shuffle_width(spark), "folder")
    return there.mapInArrow(read, "name string, value string")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``seg, utt, begin, end``; times are the last two tokens, so a recording's name may hold blanks."""
    t = read_ragged(spark, path).where(F.size("tokens") >= 4)
    n = F.size("tokens")
    return t.select(
        F.get("tokens", F.lit(0)).alias("seg"), F.array_join(F.slice("tokens", 2, n - 3), " ").alias("utt"),
        F.element_at("tokens", -2).try_cast("double").alias("begin"), F.element_at("tokens", -1).try_cast("double").alias("end"),
    )


RAW_LIST = T.StructType([T.StructField("key", T.StringType()), T.StructField("spk", T.StringType()), T.StructField("wav", T.StringType()), T.StructField("feat", T.StringType()), T.StructField("vad", T.ArrayType(T.ArrayType(T.StringType())))])


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON with ``key, spk, wav, feat, vad``; lines without a key or a speaker, and broken ones, are left out."""
    return spark.read.schema(RAW_LIST).option("mode", "DROPMALFORMED").json(path).where("key is not null and spk is not null")


def read_meeting(spark: SparkSession, path: str) -> DataFrame:
    """``path, speaker_id, start_time, end_time`` of JSON arrays of segments."""
    kind = "speaker_id string, start_time double, end_time double"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), "speaker_id", "start_time", "end_time")


def read_text_grid(spark: SparkSession, path: str) -> DataFrame:
    """``file, tier, xmin, xmax, text`` of the non-empty forward intervals of Praat files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    tiers = whole.select("file", F.explode(F.slice(F.split("value", r"item\s*\[\d+\]\s*:"), 2, 2**30)).alias("body"))
    name = F.regexp_extract("body", r'name\s*=\s*"((?:[^"]|"")*)"', 1)
    cuts = tiers.select("file", name.alias("tier"), F.explode(F.slice(F.split("body", r"intervals\s*\[\d+\]\s*:?"), 2, 2**30)).alias("i"))
    number = lambda k: F.regexp_extract("i", rf"{k}\s*=\s*(-?[\d.]+)", 1).try_cast("double")
    out = cuts.select("file", "tier", number("xmin").alias("xmin"), number("xmax").alias("xmax"), F.trim(F.replace(F.regexp_extract("i", r'text\s*=\s*"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))).alias("text"))
    return out.where("text <> '' and xmax > xmin")
