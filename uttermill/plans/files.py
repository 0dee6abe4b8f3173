"""Queries of sources and sinks: tables are written as the files of a data directory and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermill.functions import vectors as V
from uttermill.functions.storage import new_folder, table
from uttermill.operators.diar import rttm_line
from uttermill.plans.datadir import _U, _u2s
from uttermill.plans.diarization import _S, _T, _segments, _turns
from uttermill.plans.verification import _BASE, _scores
from uttermill.sources import binary, sinks, text


def _lines(df: DataFrame, line: Column, label: str) -> str:
    """The folder in which the lines of a table now lie."""
    path = new_folder(df.sparkSession, label)
    sinks.write_lines(df, line, path)
    return path


def f_scp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings and what they are read from, pipes included, which stay text."""
    w = table(spark, sf_dir, "wav_scp").where("wav_id is not null and wav_path is not null")
    path = _lines(w, F.concat_ws("   ", "wav_id", "wav_path"), "scp")
    return text.read_keyed(spark, path).select("key", "value")


def f_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(table(spark, sf_dir, "segments").where("seg is not null"), F.concat(F.lit("  "), "seg", F.lit(" ")), "list")
    return text.read_list(spark, path).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def f_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers with their utterances on one line each."""
    s = table(spark, sf_dir, "spk2utt").where("spk is not null and size(utts) > 0")
    path = _lines(s, F.concat_ws(" ", "spk", F.array_join("utts", " ")), "ragged")
    t = text.read_ragged(spark, path)
    return t.select(F.get("tokens", F.lit(0)).alias("spk"), (F.size("tokens") - 1).alias("n"), F.md5(F.array_join(F.slice("tokens", 2, 2**30), " ").cast("binary")).alias("digest"))


def f_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of which the last line of an utterance counts: all in one file, in the order of their speakers."""
    u = _u2s(spark, sf_dir).where("spk is not null").orderBy("spk", "utt").coalesce(1)
    return text.last_of_key(text.read_keyed(spark, _lines(u, F.concat_ws(" ", "utt", "spk"), "labels")))


def f_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored trials as trial lists with and without labels; lines of other numbers of columns are dropped."""
    line = F.when(F.col("test") % 3 == 0, F.concat_ws(" ", "enroll", "test")).when(F.col("test") % 3 == 1, F.concat_ws(" ", "enroll", "test", "label")).otherwise(F.concat_ws(" ", "enroll", "test", "label", "label"))
    return text.read_trials(spark, _lines(_scores(spark, sf_dir), line, "trials"))


def f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score lines, read as columns again."""
    t = text.read_ragged(spark, _lines(_scores(spark, sf_dir), sinks.score_line(), "scores"))
    at = lambda i: F.get("tokens", F.lit(i))
    return t.select(at(0).cast("bigint").alias("enroll"), at(1).cast("bigint").alias("test"), at(2).cast("double").alias("score"), at(3).alias("label"))


def f_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as lines of text and back; each is written twice, and the later one counts."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    twice = e.select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(0).alias("k")).unionAll(e.withColumn("k", F.lit(1))).orderBy("k").coalesce(1)
    v = text.read_vectors(spark, _lines(twice, sinks.vector_line("vec_id", "embedding"), "vectors"))
    return v.select(F.col("key").cast("bigint").alias("vec_id"), F.size("emb").alias("n"), F.round(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def f_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment lines, whose recordings hold blanks here."""
    line = F.concat_ws(" ", "seg", F.replace("reco", F.lit("-"), F.lit(" ")), F.format_string("%.3f", F.col("begin") / 1000.0), F.format_string("%.3f", F.col("end") / 1000.0))
    return text.read_segments(spark, _lines(_segments(spark, sf_dir), line, "segments"))


def _rttm(spark: SparkSession, sf_dir: str) -> str:
    t = _turns(spark, sf_dir)
    line = rttm_line(F.col("reco"), F.col("begin") / 1000.0, (F.col("end") - F.col("begin")) / 1000.0, F.col("spk"))
    other = F.when(F.col("begin") % 2 == 0, line).when(F.col("begin") % 3 == 0, F.concat(F.lit("# "), line)).otherwise(F.regexp_replace(line, "^SPEAKER", "NON-SPEECH"))
    return _lines(t, other, "rttm")


def f_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns of RTTM lines among comments and other kinds of lines."""
    return text.read_turns(spark, _rttm(spark, sf_dir)).select("utt", "channel", "begin", "dur", "spk")


def f_turn_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of RTTM lines of any kind."""
    t = text.read_turns(spark, _rttm(spark, sf_dir), any_kind=True)
    return t.select("utt", F.round(F.col("begin") * 1000).cast("bigint").alias("begin_ms"), F.round((F.col("begin") + F.col("dur")) * 1000).cast("bigint").alias("end_ms"))


def f_split_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RTTM lines in a folder for each recording and speaker."""
    t = _turns(spark, sf_dir).select(F.regexp_replace("reco", "/", "_").alias("utt"), (F.col("begin") / 1000.0).alias("begin"), ((F.col("end") - F.col("begin")) / 1000.0).alias("dur"), "spk")
    path = new_folder(spark, "split")
    sinks.write_turn_files(t, path)
    back = text.read_turn_files(spark, path)
    return back.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_line"))


def f_raw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of JSON lines with speech spans; lines without a speaker are left out."""
    r = table(spark, sf_dir, "raw_list").select(F.col("utt").alias("key"), "spk", "wav", "vad").distinct()
    path = new_folder(spark, "raw")
    sinks.write_json_list(r, path)
    back = text.read_json_list(spark, path)
    return back.select("key", "spk", "wav", F.size(F.coalesce("vad", F.array())).alias("n_spans"), F.get(F.get("vad", F.lit(0)), F.lit(0)).alias("first_begin"))


def f_feat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "feats_scp").where("feat_path is not null").groupBy("utt").agg(F.max("feat_path").alias("feat"))
    path = new_folder(spark, "feats")
    sinks.write_json_list(_u2s(spark, sf_dir).join(f, "utt").select(F.col("utt").alias("key"), "spk", "feat"), path)
    return text.read_json_list(spark, path).select("key", "spk", "feat")


def f_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tar shards of 200 utterances, whose audio is the text of their locator."""
    r = table(spark, sf_dir, "raw_list").where("utt is not null and wav is not null and spk is not null").groupBy("utt").agg(F.min(F.struct("spk", "wav")).alias("m"))
    rows = r.select(F.regexp_replace("utt", "/", "_").alias("key"), "m.spk", F.lit("wav").alias("format"), F.encode("m.wav", "UTF-8").alias("audio"))
    path = new_folder(spark, "shards")
    sinks.write_shards(sinks.shards(rows, 200), path)
    return binary.read_shards(spark, path).select("key", "spk", "format", F.decode("audio", "UTF-8").alias("wav"))


def f_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as an array of JSON for each recording."""
    t = _turns(spark, sf_dir)
    one = F.struct(F.col("spk").alias("speaker_id"), (F.col("begin") / 1000.0).alias("start_time"), (F.col("end") / 1000.0).alias("end_time"))
    arrays = t.groupBy("reco").agg(F.to_json(F.collect_list(one)).alias("value"))  # the turns of one recording
    path = new_folder(spark, "meeting")
    arrays.select(F.regexp_replace("reco", "/", "_").alias("reco"), "value").repartition("reco").write.partitionBy("reco").text(path)
    return text.read_meeting(spark, path + "/*").select("speaker_id", "start_time", "end_time")


def f_text_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as the tiers of Praat files, of which empty texts and reversed intervals are left out."""
    s = table(spark, sf_dir, "segments").where("begin_sec is not null and end_sec is not null and not isnan(begin_sec) and not isnan(end_sec) and seg is not null and reco is not null")
    said = F.when(F.col("seg").endswith("0"), F.lit("")).otherwise(F.col("seg"))
    body = F.concat(F.lit("        intervals [1]:\n            xmin = "), F.format_string("%.3f", "begin_sec"), F.lit("\n            xmax = "), F.format_string("%.3f", "end_sec"), F.lit('\n            text = "'), said, F.lit('"\n'))
    tiers = s.groupBy("reco").agg(F.array_join(F.collect_list(body), "").alias("all"))  # the segments of one recording
    value = F.concat(F.lit('File type = "ooTextFile"\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "'), "reco", F.lit('"\n'), "all")
    path = new_folder(spark, "grids")
    tiers.select(F.regexp_replace("reco", "/", "_").alias("of"), value.alias("value")).repartition("of").write.partitionBy("of").text(path)
    return text.read_text_grid(spark, path + "/*").select("tier", "xmin", "xmax", "text")


def f_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of a tree of files: the folders of turns, keyed by the last part of their path."""
    path = new_folder(spark, "listing")
    t = _turns(spark, sf_dir).select(F.regexp_replace("reco", "/", "_").alias("name"), F.col("spk").alias("value"))
    t.repartition("name").write.partitionBy("name").text(path)
    return binary.list_files(spark, path, "part-*", 2).select(F.regexp_extract("key", "name=([^/]*)/", 1).alias("name")).distinct()


def f_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a tree of arrays, a folder for each label; among them a file that is none."""
    e = table(spark, sf_dir, "embeddings").select(F.concat_ws("/", F.concat(F.lit("l"), "label"), F.concat("vec_id", F.lit(".npy"))).alias("name"), sinks.array_file(F.col("embedding")).alias("content"))
    path = new_folder(spark, "arrays")
    broken = spark.createDataFrame([("l0/broken.npy", bytearray(b"no array"))], "name string, content binary")
    sinks.write_files(e.unionAll(broken), "name", "content", path)
    total = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x)
    return binary.read_arrays(spark, path).select("utt", F.size("emb").alias("n"), F.round(total, 5).alias("total"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of samples from embeddings: the values and their negatives, in turn."""
    x = F.flatten(F.transform("embedding", lambda v: F.array(F.round(v * 1000).cast("int"), (-F.round(v * 1000)).cast("int"))))
    return table(spark, sf_dir, "embeddings").select(F.concat("vec_id", F.lit(".wav")).alias("name"), x.alias("samples"))


def _energies(waves: DataFrame) -> DataFrame:
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return waves.select(F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("bigint").alias("vec_id"), "sample_rate", F.size("samples").alias("n"), total.alias("total"))


def f_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second channel of wave files."""
    path = new_folder(spark, "waves")
    sinks.write_files(_samples(spark, sf_dir).withColumn("content", sinks.wave_file(F.col("samples"), 16_000, 2)), "name", "content", path)
    return _energies(binary.read_waves(spark, path, 1))


def f_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first channel of files of bare samples."""
    path = new_folder(spark, "pcm")
    sinks.write_files(_samples(spark, sf_dir).withColumn("content", sinks.wave_file(F.col("samples"), 8_000, 2, header=False)), "name", "content", path)
    return _energies(binary.read_pcm(spark, path, 8_000, 2, 0))


def f_raw_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed utterances with their speech cut out and put together: 3,000 samples at 10 a second stand for the audio."""
    r = table(spark, sf_dir, "raw_list").where("utt is not null").groupBy(F.col("utt").alias("key"), "spk").agg(F.max("wav").alias("wav"), F.max("vad").alias("vad"))
    path = new_folder(spark, "cut")
    sinks.write_json_list(r, path)
    seconds = lambda p, i: F.get(p, F.lit(i)).try_cast("double")
    spans = F.transform("vad", lambda p: F.struct(seconds(p, 0).alias("begin"), seconds(p, 1).alias("end")))
    good = F.filter(spans, lambda p: (p["begin"] >= 0) & (p["end"] > p["begin"]))
    heard = F.sequence(F.lit(0), F.lit(2_999))
    rows = text.read_json_list(spark, path).select("key", "spk", F.when(F.col("vad").isNull(), heard).otherwise(V.cut_spans(heard, good, 10)).alias("x"))
    return rows.select("key", "spk", F.size("x").alias("n"), F.aggregate("x", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


_RTTM = f"{_T}, x AS (SELECT reco, spk, CAST(format('{{:.3f}}', b / 1000.0) AS DOUBLE) AS b3, CAST(format('{{:.3f}}', (e - b) / 1000.0) AS DOUBLE) AS d3, b, e FROM t)"

SQL = {
    "f_scp": r"SELECT wav_id AS key, regexp_replace(trim(wav_path), '\s+', ' ', 'g') AS value FROM wav_scp WHERE wav_id IS NOT NULL AND wav_path IS NOT NULL",
    "f_list": "SELECT seg AS item, count(*) AS n FROM segments WHERE seg IS NOT NULL GROUP BY seg",
    "f_ragged": "SELECT spk, CAST(len(utts) AS INT) AS n, md5(array_to_string(utts, ' ')) AS digest FROM spk2utt WHERE spk IS NOT NULL AND len(utts) > 0",
    "f_labels": f"WITH {_U} SELECT utt AS key, max(trim(spk)) AS value FROM u WHERE spk IS NOT NULL GROUP BY utt",
    "f_trials": f"{_BASE} SELECT CAST(enroll AS VARCHAR) AS enroll, CAST(test AS VARCHAR) AS test, CASE WHEN test % 3 = 1 THEN label END AS label FROM s WHERE test % 3 < 2",
    "f_scores": f"{_BASE} SELECT enroll, test, score, label FROM s",
    "f_vectors": "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) + 0.0 AS total FROM embeddings",
    "f_segments": f"WITH {_S} SELECT seg, replace(reco, '-', ' ') AS utt, b / 1000.0 AS \"begin\", e / 1000.0 AS \"end\" FROM s",
    "f_turns": f"WITH {_RTTM} SELECT reco AS utt, CAST(1 AS INT) AS channel, b3 AS \"begin\", d3 AS dur, spk FROM x WHERE b % 2 = 0",
    "f_turn_intervals": f"WITH {_RTTM} SELECT reco AS utt, b AS begin_ms, e AS end_ms FROM x WHERE b % 2 = 0 OR b % 3 <> 0",
    "f_split_turns": f"""WITH {_T}, x AS (SELECT replace(reco, '/', '_') AS utt, b / 1000.0 AS b, (e - b) / 1000.0 AS d, spk FROM t),
      f AS (SELECT utt, spk, row_number() OVER (PARTITION BY utt ORDER BY min(b), spk) - 1 AS i, count(*) OVER (PARTITION BY utt) AS k FROM x GROUP BY utt, spk)
      SELECT CASE WHEN k > 1 THEN x.utt || '_' || i ELSE x.utt END AS name, count(*) AS n, min(format('SPEAKER {{}} 1 {{:.3f}} {{:.3f}} <NA> <NA> {{}} <NA> <NA>', x.utt, b, d, x.spk)) AS first_line
      FROM x JOIN f ON f.utt = x.utt AND f.spk = x.spk GROUP BY 1""",
    "f_raw_list": "SELECT utt AS key, spk, wav, CAST(len(coalesce(vad, [])) AS INT) AS n_spans, vad[1][1] AS first_begin FROM (SELECT DISTINCT utt, spk, wav, vad FROM raw_list) WHERE utt IS NOT NULL AND spk IS NOT NULL",
    "f_feat_list": f"WITH {_U} SELECT u.utt AS key, spk, feat FROM u JOIN (SELECT utt, max(feat_path) AS feat FROM feats_scp WHERE feat_path IS NOT NULL GROUP BY utt) f USING (utt) WHERE spk IS NOT NULL",
    "f_shards": "SELECT replace(utt, '/', '_') AS key, trim(min((spk, wav))[1]) AS spk, 'wav' AS format, min((spk, wav))[2] AS wav FROM raw_list WHERE utt IS NOT NULL AND wav IS NOT NULL AND spk IS NOT NULL GROUP BY utt",
    "f_meeting": f"WITH {_T} SELECT spk AS speaker_id, b / 1000.0 AS start_time, e / 1000.0 AS end_time FROM t",
    "f_text_grid": """SELECT reco AS tier, CAST(format('{:.3f}', begin_sec) AS DOUBLE) AS xmin, CAST(format('{:.3f}', end_sec) AS DOUBLE) AS xmax, seg AS text FROM segments
      WHERE isfinite(begin_sec) AND isfinite(end_sec) AND reco IS NOT NULL AND seg NOT LIKE '%0' AND CAST(format('{:.3f}', end_sec) AS DOUBLE) > CAST(format('{:.3f}', begin_sec) AS DOUBLE)""",
    "f_arrays": "SELECT 'l' || label || '/' || vec_id AS utt, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) + 0.0 AS total FROM embeddings",
    "f_waves": "SELECT vec_id, CAST(16000 AS INT) AS sample_rate, CAST(len(embedding) AS INT) AS n, CAST(-list_sum(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT))) AS BIGINT) AS total FROM embeddings",
    "f_pcm": "SELECT vec_id, CAST(8000 AS INT) AS sample_rate, CAST(len(embedding) AS INT) AS n, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT))) AS BIGINT) AS total FROM embeddings",
    "f_raw_cut": """WITH r AS (SELECT utt AS key, spk, max(vad) AS vad FROM raw_list WHERE utt IS NOT NULL AND spk IS NOT NULL GROUP BY utt, spk),
      s AS (SELECT key, spk, try_cast(p[1] AS DOUBLE) AS b, try_cast(p[2] AS DOUBLE) AS e FROM (SELECT key, spk, unnest(vad) AS p FROM r)),
      c AS (SELECT key, spk, least(CAST(floor(b * 10) AS BIGINT), 3000) AS i, least(CAST(floor(e * 10) AS BIGINT), 3000) AS j FROM s WHERE b >= 0 AND e > b),
      t AS (SELECT key, spk, sum(j - i) AS n, sum((j - i) * (i + j - 1) // 2) AS total FROM c GROUP BY ALL)
      SELECT r.key, r.spk, CAST(CASE WHEN vad IS NULL THEN 3000 ELSE coalesce(n, 0) END AS INT) AS n, CAST(CASE WHEN vad IS NULL THEN 4498500 ELSE coalesce(total, 0) END AS BIGINT) AS total
      FROM r LEFT JOIN t ON t.key = r.key AND t.spk = r.spk""",
    "f_files": f"WITH {_T} SELECT DISTINCT replace(reco, '/', '_') AS name FROM t",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for n, f in list(globals().items()) if n.startswith("f_")}
