"""Writers: text lines, JSON lines, shards of bounded size."""

from __future__ import annotations

import errno
import io
import itertools
import os
import shutil
import struct
import tarfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttermill.functions.storage import mounted
from uttermill.operators.datadir import hashed_order


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def score_line(digits: int = 5) -> Column:
    """``enroll test score[ label]``."""
    return F.concat_ws(" ", "enroll", "test", F.format_string(f"%.{digits}f", F.col("score")), "label")


def keyed_line(key: str, value: str) -> Column:
    return F.concat_ws(" ", F.col(key), F.col(value).cast("string"))


def vector_line(key: str, vector: str) -> Column:
    return F.concat_ws(" ", F.col(key), F.array_join(F.transform(vector, lambda x: x.cast("string")), " "))


def write_json_list(df: DataFrame, path: str) -> None:
    """Lines of JSON of all columns; null values are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


#: What a value of a partition folder's name may not hold, as Spark writes it instead; the folder of the empty value.
_ESCAPED = {i: f"%{i:02X}" for i in (*range(32), *map(ord, "\"#%'*/:=?\\\x7f{[]^"))}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_turn_files(turns: DataFrame, path: str) -> None:
    """A folder of RTTM lines per recording and speaker; the speaker's number, in order of first turn, is added only if there are several.

    In a mounted folder each task writes its folders itself, with a file each, which nothing lists or moves again.
    Spark's writer, which other file systems take, makes the same folders, but several files on the way to each.
    """
    first = turns.groupBy("utt", "spk").agg(F.min(F.struct("begin", "spk")).alias("at"))
    number = (F.row_number().over(Window.partitionBy("utt").orderBy("at")) - 1).cast("string")
    many = F.count(F.lit(1)).over(Window.partitionBy("utt")) > 1
    named = first.select("utt", "spk", F.when(many, F.concat_ws("_", "utt", number)).otherwise(F.col("utt")).alias("name"))
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "utt", "begin", "dur", "spk")
    rows = turns.join(named, ["utt", "spk"]).select("name", "begin", line.alias("value"))
    # Lines of a folder lie in the order of their begin times.
    laid = rows.repartition("name").sortWithinPartitions("name", "begin", "value").drop("begin")
    root = mounted(turns.sparkSession, path)
    if root is None:
        laid.write.partitionBy("name").text(path)
        return
    os.makedirs(root)  # a folder that is there already is refused, as by Spark

    making = os.path.join(root, ".making")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        # Folders are made in one of the task's own and moved when whole: tasks that make them in one place wait for each other.
        own = os.path.join(making, uuid.uuid4().hex)
        os.makedirs(own)
        lines = (r for b in batches for r in zip(b.column("name").to_pylist(), b.column("value").to_pylist()))
        for name, of_name in itertools.groupby(lines, lambda r: r[0]):
            part = os.path.join(own, str(n))
            os.mkdir(part)
            with open(os.path.join(part, "part-00000.txt"), "wb") as f:
                f.writelines(f"{line}\n".encode() for _, line in of_name)
            try:
                os.rename(part, os.path.join(root, f"name={name.translate(_ESCAPED) or NO_VALUE}"))
            except OSError as e:
                if e.errno not in (errno.ENOTEMPTY, errno.EEXIST):
                    raise
                shutil.rmtree(part)  # an earlier run of the task has left the same folder, whole
            n += 1
        os.rmdir(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    laid.mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()
    shutil.rmtree(making, ignore_errors=True)
    open(os.path.join(root, "_SUCCESS"), "wb").close()


def write_tables(df: DataFrame, path: str, rows_per_file: int, seed: int | None = None) -> None:
    """Parquet files of at most so many rows, in hashed order of all columns if a seed is given."""
    ordered = df if seed is None else df.sortWithinPartitions(hashed_order(*df.columns, seed=seed))
    ordered.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def shards(rows: DataFrame, rows_per_shard: int = 1_000, seed: int = 0) -> DataFrame:
    """``key, spk, format, audio`` as tar files: ``shard, content``. Rows go to shards by hash, within them by key.

    The number of shards follows the number of rows, which is counted first.
    """
    n = max(1, -(-rows.count() // rows_per_shard))
    laid = rows.withColumn("shard", F.pmod(hashed_order("key", seed=seed), F.lit(n)).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, tar = None, None, None

        def done() -> pa.RecordBatch:
            tar.close()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([held.getvalue()], pa.binary())], names=["shard", "content"])

        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard:
                    if tar is not None:
                        yield done()
                    shard, held = r["shard"], io.BytesIO()
                    tar = tarfile.open(fileobj=held, mode="w")
                for ending, data in (("spk", (r["spk"] or "").encode()), (r["format"], r["audio"])):
                    info = tarfile.TarInfo(f"{r['key']}.{ending}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        if tar is not None:
            yield done()

    whole = laid.where("key is not null and audio is not null and format is not null").repartition(n, "shard").sortWithinPartitions("shard", "key")
    return whole.mapInArrow(build, "shard int, content binary")


def write_files(made: DataFrame, name: str, content: str, path: str) -> None:
    """Files of bytes in a folder that all executors share, each written by the task that has it. Names may hold folders."""
    root = path.split(":", 1)[1].replace("//", "/", 1) if path.startswith("file:") else path
    if ":" in root.split("/", 1)[0]:
        raise ValueError("files are written as plain ones; give a mounted folder")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                to = os.path.join(root, where)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                # Under another name first, so that a task that is lost or runs twice leaves whole files only.
                part = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, to)
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    rows = made.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).dropna()
    rows.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def write_shards(made: DataFrame, path: str) -> None:
    """Shards as files ``shard_<number>.tar``."""
    write_files(made.select(F.format_string("shard_%06d.tar", "shard").alias("name"), "content"), "name", "content", path)


def array_file(x: Column) -> Column:
    """A vector as the bytes of an ``.npy`` file."""

    @F.pandas_udf("binary")
    def save(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = []
            for v in vectors:
                held = io.BytesIO()
                np.save(held, np.asarray(v, np.float32))
                out.append(held.getvalue())
            yield pd.Series(out)

    return save(x)


def wave_file(samples: Column, rate: int, channels: int = 1, header: bool = True) -> Column:
    """Samples, of all channels in turn, as the bytes of a 16-bit wave file, or as the bare samples."""

    @F.pandas_udf("binary")
    def save(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = []
            for v in vectors:
                data = np.asarray(v, "<i2").tobytes()
                kind = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
                body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + kind + b"data" + struct.pack("<I", len(data)) + data
                out.append(b"RIFF" + struct.pack("<I", len(body)) + body if header else data)
            yield pd.Series(out)

    return save(samples)
