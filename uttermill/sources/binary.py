"""Readers of binary files: tar shards, arrays, wave files, and listings of file trees."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("flac", "mp3", "m4a", "ogg", "opus", "wav", "wma")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``shard, key, spk, format, audio`` of tar files whose neighbouring members ``key.spk`` and ``key.<audio>`` are one row.

    Rows without a speaker or audio, and members that cannot be read, are left out, the last row of a shard like any other.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = list(_grouped(name, content))
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["shard", "key", "spk", "format", "audio"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(expand, "shard string, key string, spk string, format string, audio binary")


def _grouped(shard: str, content: bytes) -> Iterator[tuple]:
    key, spk, kind, audio = None, None, None, None
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for member in tar:
                stem, _, ending = member.name.rpartition(".")
                if not stem or not member.isfile():
                    continue
                if stem != key:
                    if key is not None and spk is not None and audio is not None:
                        yield shard, key, spk, kind, audio
                    key, spk, kind, audio = stem, None, None, None
                data = tar.extractfile(member).read()
                if ending == "spk":
                    spk = data.decode("utf-8", "replace").strip()
                elif ending.lower() in AUDIO:
                    kind, audio = ending.lower(), data
    except (tarfile.TarError, EOFError, OSError):
        pass
    if key is not None and spk is not None and audio is not None:
        yield shard, key, spk, kind, audio


def read_arrays(spark: SparkSession, root: str) -> DataFrame:
    """``utt, emb`` of a tree of ``.npy`` files; the name is the path below the root without its ending. Broken files are left out."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, vectors = [], []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    vectors.append(np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32).ravel())
                except (ValueError, OSError, EOFError):
                    continue
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["path", "emb"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root).select("path", "content")
    at = root.rstrip("/").replace("file://", "").replace("file:", "")
    return files.mapInArrow(load, "path string, emb array<float>").select(F.regexp_replace(F.expr(f"substring_index(path, '{at}/', -1)"), r"\.npy$", "").alias("utt"), "emb")


def list_files(spark: SparkSession, root: str, glob: str = "*", parts: int = 3) -> DataFrame:
    """``key, path, length`` of a tree of files; the key is the last parts of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(F.array_join(F.slice(F.split("path", "/"), -parts, parts), "/").alias("key"), "path", "length")


def read_waves(spark: SparkSession, path: str, channel: int = 0) -> DataFrame:
    """``path, sample_rate, samples`` of one channel of 16-bit wave files; chunks other than format and data are skipped."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                wave = _wave(content, channel)
                if wave:
                    rows.append((name, *wave))
            if rows:
                p, r, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(r, pa.int32()), pa.array(s, pa.list_(pa.int16()))], names=["path", "sample_rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, "path string, sample_rate int, samples array<short>")


def read_pcm(spark: SparkSession, path: str, rate: int, channels: int = 1, channel: int = 0) -> DataFrame:
    """``path, sample_rate, samples`` of one channel of files of bare 16-bit samples, whose rate must be known."""
    if not 0 <= channel < channels:
        raise ValueError(f"channel {channel} of {channels} is not there")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = 2 * channels
            rows = [np.frombuffer(c[: len(c) // width * width], "<i2").reshape(-1, channels)[:, channel] for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([rate] * len(rows), pa.int32()), pa.array(rows, pa.list_(pa.int16()))], names=["path", "sample_rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, "path string, sample_rate int, samples array<short>")


def _wave(content: bytes, channel: int) -> tuple[int, np.ndarray] | None:
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, channels, rate = 12, 0, 0
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            channels, rate = int.from_bytes(body[2:4], "little"), int.from_bytes(body[4:8], "little")
            if int.from_bytes(body[14:16], "little") != 16:
                return None
        elif name == b"data" and channels:
            if channel >= channels:
                raise ValueError(f"channel {channel} of {channels} is not there")
            whole = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2")
            return rate, whole.reshape(-1, channels)[:, channel]
        at += 8 + size + size % 2
    return None
