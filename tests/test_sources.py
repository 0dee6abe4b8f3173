import io
import struct
import tarfile

import numpy as np
from pyspark.sql import functions as F

from uttermill.sources import binary, sinks, text


def _file(tmp_path, name, content):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return f"file://{p}"


def test_text_tables(spark, tmp_path):
    scp = _file(tmp_path, "wav.scp", "a  /x/a.wav\nb sph2pipe -f  wav b.sph |\n\na /y/a.wav\n")
    rows = text.read_keyed(spark, scp)
    assert {(r["key"], r["value"]) for r in rows.collect()} == {("a", "/x/a.wav"), ("b", "sph2pipe -f wav b.sph |"), ("a", "/y/a.wav")}
    assert {r["key"]: r["value"] for r in text.last_of_key(rows).collect()} == {"a": "/y/a.wav", "b": "sph2pipe -f wav b.sph |"}
    trials = _file(tmp_path, "trials", "a b target\na c\nx\na b c d\n")
    assert {tuple(r) for r in text.read_trials(spark, trials).collect()} == {("a", "b", "target"), ("a", "c", None)}
    rttm = _file(tmp_path, "x.rttm", "SPEAKER u 1 0.010 1.490 <NA> <NA> 0 <NA> <NA>\n; note\nSPKR-INFO u 1 <NA>\nSPEAKER u 1 x 1 <NA> <NA> 0 <NA> <NA>\n")
    assert [(r["utt"], r["begin"], r["dur"], r["spk"]) for r in text.read_turns(spark, rttm).collect()] == [("u", 0.01, 1.49, "0")]
    seg = _file(tmp_path, "segments", "s1 my recording 0.5 1.5\n")
    assert [tuple(r) for r in text.read_segments(spark, seg).collect()] == [("s1", "my recording", 0.5, 1.5)]
    assert [r["item"] for r in text.read_list(spark, _file(tmp_path, "l", " a \n\nb\n")).orderBy("line_no").collect()] == ["a", "b"]


def test_json_lists(spark, tmp_path):
    path = _file(tmp_path, "raw.list", '{"key": "k", "spk": "s", "wav": "w", "vad": [["0.1", "0.5"]]}\n{"key": "n"}\nbroken\n')
    assert [(r["key"], r["vad"]) for r in text.read_json_list(spark, path).collect()] == [("k", [["0.1", "0.5"]])]
    meeting = _file(tmp_path, "m.json", '[{"speaker_id": "A", "start_time": 0.0, "end_time": 1.0}, {"speaker_id": "B", "start_time": 1.0, "end_time": 2.5}]')
    assert {(r["speaker_id"], r["end_time"]) for r in text.read_meeting(spark, meeting).collect()} == {("A", 1.0), ("B", 2.5)}


def test_text_grid(spark, tmp_path):
    grid = (
        'item []:\n item [1]:\n  class = "IntervalTier"\n  name = "spk1"\n  intervals [1]:\n   xmin = 0\n   xmax = 1.5\n   text = "hello ""you"" "\n'
        '  intervals [2]:\n   xmin = 1.5\n   xmax = 2\n   text = ""\n item [2]:\n  name = "spk2"\n  intervals [1]:\n   xmin = 3\n   xmax = 2\n   text = "back"\n'
    )
    rows = text.read_text_grid(spark, _file(tmp_path, "a.TextGrid", grid)).collect()
    assert [(r["tier"], r["xmin"], r["xmax"], r["text"]) for r in rows] == [("spk1", 0.0, 1.5, 'hello "you"')]


def test_shards_round_trip_and_drop_invalid_rows(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", f"s{i % 2}", "wav", bytes([i] * 5)) for i in range(25)], "key string, spk string, format string, audio binary")
    out = tmp_path / "shards"
    out.mkdir()
    for r in sinks.shards(rows, 10).collect():
        (out / f"{r['shard']}.tar").write_bytes(r["content"])
    assert len(list(out.iterdir())) == 3
    back = binary.read_shards(spark, f"file://{out}").select("key", "spk", "format", "audio")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as tar:
        for name, data in (("a.spk", b"s"), ("a.wav", b"1"), ("b.spk", b"t")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    path = _file(tmp_path, "bad/x.tar", held.getvalue())
    assert [r["key"] for r in binary.read_shards(spark, path).collect()] == ["a"]
    assert binary.read_shards(spark, _file(tmp_path, "bad/y.tar", b"no tar")).count() == 0


def test_arrays_and_waves(spark, tmp_path):
    for name in ("s1/u1", "s2/u2"):
        p = tmp_path / "npy" / f"{name}.npy"
        p.parent.mkdir(parents=True, exist_ok=True)
        np.save(p, np.array([1.5, 2.5], np.float32))
    (tmp_path / "npy/broken.npy").write_bytes(b"x")
    got = binary.read_arrays(spark, f"file://{tmp_path}/npy").collect()
    assert {(r["utt"], tuple(r["emb"])) for r in got} == {("s1/u1", (1.5, 2.5)), ("s2/u2", (1.5, 2.5))}
    assert {r["key"] for r in binary.list_files(spark, f"file://{tmp_path}/npy", "*.npy", 2).collect()} >= {"s1/u1.npy", "s2/u2.npy"}
    data = struct.pack("<6h", 1, -1, 2, -2, 3, -3)
    fmt = struct.pack("<HHIIHH", 1, 2, 8_000, 32_000, 4, 16)
    wave = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 2) + b"xx" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
    r = binary.read_waves(spark, _file(tmp_path, "w.wav", wave), 1).first()
    assert r["sample_rate"] == 8_000 and r["samples"] == [-1, -2, -3]


def test_lines_written(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.123456, "target"), ("a", "c", 1.0, None)], "enroll string, test string, score double, label string")
    sinks.write_lines(df, sinks.score_line(), f"file://{tmp_path}/scores")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/scores").collect()) == ["a b 0.12346 target", "a c 1.00000"]
    turns = spark.createDataFrame([("u", 0.0, 1.0, "x"), ("u", 1.0, 1.0, "y"), ("v", 0.0, 1.0, "x")], "utt string, begin double, dur double, spk string")
    sinks.write_turn_files(turns, f"file://{tmp_path}/turns")
    assert {p.name for p in (tmp_path / "turns").iterdir() if p.is_dir()} == {"name=u_0", "name=u_1", "name=v"}
    sinks.write_json_list(df.select("enroll", "label"), f"file://{tmp_path}/json")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/json").collect()) == ['{"enroll":"a","label":"target"}', '{"enroll":"a"}']
    sinks.write_tables(spark.range(10).coalesce(1), f"file://{tmp_path}/few", 4, seed=1)
    assert len(list((tmp_path / "few").glob("*.parquet"))) == 3
    assert df.select(sinks.keyed_line("enroll", "test").alias("l")).where(F.col("l") == "a b").count() == 1


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """Later lines overwrite earlier ones, whichever split they lie in."""
    (tmp_path / "t").write_text("".join(f"k{i % 500} v{i}\n" for i in range(20_000)))
    (tmp_path / "u").write_text("other first\nother last\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = text.read_keyed(spark, f"file://{tmp_path}")
        assert rows.rdd.getNumPartitions() > 10
        assert rows.select("line_no", "key").where("key <> 'other'").distinct().count() == 20_000
        got = {r["key"]: r["value"] for r in text.last_of_key(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"k{i}": f"v{19_500 + i}" for i in range(500)} | {"other": "last"}


def test_turn_files_are_one_plain_file_each(spark, tmp_path, monkeypatch):
    """Numbers, marks, empty names and names that two recordings share come back; both writers leave the same folders."""
    turns = [(f"{i}", 0.0, 1.0, "x") for i in range(200)] + [("", 0.0, 1.0, "x"), ("a%2F:[b]", 0.0, 1.0, "é"), ("u_0", 9.0, 1.0, "z"), ("u", 1.0, 1.0, "x"), ("u", 10.0, 1.0, "x"), ("u", 2.0, 1.0, "y")]
    df = spark.createDataFrame(turns, "utt string, begin double, dur double, spk string")
    root = tmp_path / "turns"
    sinks.write_turn_files(df, f"file://{root}")
    assert all([p.name for p in d.iterdir()] == ["part-00000.txt"] for d in root.glob("name=*"))
    at_u_0 = [f"SPEAKER {u} 1 {b:.3f} 1.000 <NA> <NA> {s} <NA> <NA>" for u, b, s in (("u", 1, "x"), ("u_0", 9, "z"), ("u", 10, "x"))]
    assert (root / "name=u_0/part-00000.txt").read_text().splitlines() == at_u_0
    back = text.read_turn_files(spark, f"file://{root}")
    assert back.dtypes == [("name", "string"), ("value", "string")]
    assert back.rdd.getNumPartitions() <= 4  # not a task for every few folders
    got = sorted(map(tuple, back.collect()))
    assert len(got) == len(turns) and {n for n, _ in got} == {f"{i}" for i in range(200)} | {"", "a%2F:[b]", "u_0", "u_1"}
    monkeypatch.setattr(sinks, "mounted", lambda *_: None)
    monkeypatch.setattr(text, "mounted", lambda *_: None)
    sinks.write_turn_files(df, f"file://{tmp_path}/other")
    assert {d.name for d in root.glob("name=*")} == {d.name for d in (tmp_path / "other").glob("name=*")}
    assert sorted(map(tuple, text.read_turn_files(spark, f"file://{tmp_path}/other").collect())) == got


def test_no_turns_leave_no_folders(spark, tmp_path):
    sinks.write_turn_files(spark.createDataFrame([], "utt string, begin double, dur double, spk string"), f"file://{tmp_path}/none")
    assert text.read_turn_files(spark, f"file://{tmp_path}/none").count() == 0
