"""Data-directory queries on the data-directory tables and, for generic tables, on orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermill.functions.storage import table
from uttermill.functions.times import finite, latest_key, latest_value, seconds_to_ms
from uttermill.operators import datadir as O

_RECORDING = r"^(.*)-(\d{8})-(\d{8})$"


def _u2s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "utt2spk").where("removed_at is null").select("utt", "spk").distinct()


def all_durations(spark: SparkSession, sf_dir: str, max_seconds: float = 1_000.0) -> DataFrame:
    """``utt, dur``: the latest usable length of every utterance, in seconds. Seconds never exceed ``max_seconds``, so larger values are milliseconds."""
    dur = F.col("dur")
    ms = F.when(dur > max_seconds, F.round(dur).cast("bigint")).otherwise(seconds_to_ms(dur))
    usable = table(spark, sf_dir, "utt2dur").where(finite(dur) & (dur > 0))
    return usable.groupBy("utt").agg(F.max(latest_key(F.col("loaded_at"), ms)).alias("packed")).select("utt", (latest_value(F.col("packed")) / 1_000).alias("dur"))


def dd_min_utts(spark, sf_dir):
    return O.frequent_only(_u2s(spark, sf_dir).where("spk is not null"), "spk", "utt", 3)


def dd_longer_than(spark, sf_dir):
    return O.longer_than(_u2s(spark, sf_dir), all_durations(spark, sf_dir), 5.0)


def dd_positive_durations(spark, sf_dir):
    return table(spark, sf_dir, "reco2dur").where((F.col("dur") > 0) & finite(F.col("dur"))).select("reco", "dur")


def dd_min_segment(spark, sf_dir):
    return table(spark, sf_dir, "segments").where("end_sec - begin_sec >= 0.255").select("seg", "begin_sec", "end_sec")


def dd_with_features(spark, sf_dir):
    return O.by_ids(_u2s(spark, sf_dir), table(spark, sf_dir, "feats_scp").where("feat_path is not null"), "utt", "utt")


def dd_without_features(spark, sf_dir):
    return O.by_ids(_u2s(spark, sf_dir), table(spark, sf_dir, "feats_scp").where("feat_path is not null"), "utt", "utt", exclude=True)


def dd_speaker_range(spark, sf_dir):
    return _u2s(spark, sf_dir).where(F.col("spk") < "id00000100")


def dd_codes(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


def dd_recoded_trials(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("enroll"), F.when(F.col("label") == 0, "nontarget").otherwise("target").alias("label"))


def dd_path_parts(spark, sf_dir):
    """Speaker, session and stem from audio paths; pipes and paths of fewer than three parts are left out."""
    p = table(spark, sf_dir, "wav_scp").where("wav_path is not null and wav_path not like '%|' and wav_path not like '% %'").select("wav_path", F.split("wav_path", "/").alias("p"))
    return p.where(F.size("p") >= 3).select("wav_path", F.element_at("p", -2).alias("folder"), F.regexp_replace(F.element_at("p", -1), r"\.[^.]*$", "").alias("stem")).distinct()


def dd_locator_kind(spark, sf_dir):
    """Paths, pipes and missing locators. Pipes are counted, never run."""
    kind = F.when(F.col("wav_path").isNull(), "none").when(F.trim("wav_path").endswith("|"), "pipe").otherwise("path")
    return table(spark, sf_dir, "wav_scp").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("wav_id").alias("n_recordings"))


def noise_keys(spark, sf_dir):
    """Keys of noises: the kinds of events, each under one of four prefixes."""
    kind = F.element_at(F.array(*map(F.lit, ("noise", "speech", "music", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat_ws("-", kind, "event_type").alias("noise")).distinct()


def dd_snr_range(spark, sf_dir):
    r = O.snr_range(F.col("noise"))
    return noise_keys(spark, sf_dir).select("noise", r["low"].alias("low"), r["high"].alias("high"))


def dd_segment_id_parts(spark, sf_dir):
    s = table(spark, sf_dir, "segments").select("seg").distinct()
    part = lambda i: F.regexp_extract("seg", _RECORDING, i)
    return s.select("seg", part(1).alias("reco"), part(2).cast("bigint").alias("begin_ms"), part(3).cast("bigint").alias("end_ms"))


def dd_speaker_ids(spark, sf_dir):
    return O.dense_ids(_u2s(spark, sf_dir), "spk")


def dd_labelled(spark, sf_dir):
    """raw_list with speaker ids from spk2utt; unknown speakers get -1."""
    ids = O.dense_ids(table(spark, sf_dir, "spk2utt"), "spk")
    return O.with_ids(table(spark, sf_dir, "raw_list").select("utt", "spk").distinct(), ids, "spk")


def _wavs(spark, sf_dir):
    return table(spark, sf_dir, "raw_list").groupBy("utt").agg(F.max("wav").alias("wav"))


def _vad(spark, sf_dir):
    r = table(spark, sf_dir, "raw_list").where("vad is not null").groupBy("utt").agg(F.max("vad").alias("vad"))
    return r.select("utt", F.size("vad").alias("n_spans"))


def dd_raw_list(spark, sf_dir):
    return O.raw_list(_u2s(spark, sf_dir), _wavs(spark, sf_dir), _vad(spark, sf_dir), keep_without_vad=False)


def dd_shard_list(spark, sf_dir):
    return O.raw_list(_u2s(spark, sf_dir), _wavs(spark, sf_dir), _vad(spark, sf_dir))


def dd_incomplete(spark, sf_dir):
    return O.incomplete_keys(_u2s(spark, sf_dir), table(spark, sf_dir, "feats_scp"), "utt")


def dd_recording_segments(spark, sf_dir):
    """Recordings with each of their segments."""
    w = table(spark, sf_dir, "wav_scp").where("removed_at is null").select(F.col("wav_id").alias("reco")).distinct()
    return w.join(table(spark, sf_dir, "segments").where("removed_at is null").select("reco", "seg").distinct(), "reco")


def dd_customer_region(spark, sf_dir):
    """A chained lookup: customer, nation, region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


def dd_model_of(spark, sf_dir):
    """Model ids from utterance ids: the time suffix is cut off and the columns change places."""
    return _u2s(spark, sf_dir).select(F.regexp_replace("utt", r"-\d{8}-\d{8}$", "").alias("model"), "utt")


def dd_enrolled_wavs(spark, sf_dir):
    """Enrolled models, here speakers with their first three utterances, and the audio of each."""
    w = O.every_few(table(spark, sf_dir, "raw_list").where("utt is not null and spk is not null").select("utt", "spk"), "spk", "utt", 3)
    return w.join(_wavs(spark, sf_dir), "utt").select("spk", "utt", "wav")


def dd_nested(spark, sf_dir):
    n = O.nested(_u2s(spark, sf_dir), "spk", "utt")
    return n.select("spk", F.size("members").alias("n"), F.get("members", F.lit(0)).alias("first_utt"), F.md5(F.array_join("members", " ").cast("binary")).alias("digest"))


def dd_unnested(spark, sf_dir):
    return O.unnested(table(spark, sf_dir, "spk2utt"), "spk", "utts", "utt")


def dd_voiced_duration(spark, sf_dir):
    s = table(spark, sf_dir, "segments").where("removed_at is null and begin_sec >= 0 and end_sec > begin_sec").select(F.col("reco"), F.col("begin_sec").alias("begin"), F.col("end_sec").alias("end"))
    return O.voiced_duration(s, "reco").select("reco", F.round("dur", 3).alias("dur"))


def dd_speech_lists(spark, sf_dir):
    s = table(spark, sf_dir, "segments").where("removed_at is null and begin_sec >= 0 and end_sec > begin_sec").select("reco", F.col("begin_sec").alias("begin"), F.col("end_sec").alias("end"))
    lists = O.speech_lists(s, "reco")
    return lists.select("reco", F.size("vad").alias("n"), F.get("vad", F.lit(0))["begin"].alias("first_begin"), F.element_at("vad", -1)["end"].alias("last_end"))


def dd_counts(spark, sf_dir):
    u = table(spark, sf_dir, "utt2spk")
    return u.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("utt").alias("n_utts"), F.countDistinct("spk").alias("n_spks"), F.count_if(F.col("removed_at").isNotNull()).alias("n_removed"))


def dd_first_of_key(spark, sf_dir):
    return O.first_of_key(table(spark, sf_dir, "wav_scp").select("wav_id", "wav_path", "loaded_at"), "wav_id", [F.col("loaded_at"), F.col("wav_path").asc_nulls_last()]).select("wav_id", "wav_path")


def dd_common_keys(spark, sf_dir):
    tables = [_u2s(spark, sf_dir), table(spark, sf_dir, "feats_scp"), table(spark, sf_dir, "utt2dur"), table(spark, sf_dir, "segments").select(F.col("seg").alias("utt"))]
    return O.common_keys(tables, "utt")


def dd_repaired(spark, sf_dir):
    """The rows that three tables keep when they are cut down to their common keys; of a key the first one in loading order."""
    feats, durs = table(spark, sf_dir, "feats_scp"), table(spark, sf_dir, "utt2dur").select("utt", "dur", "loaded_at")
    tables = {"utt2spk": _u2s(spark, sf_dir), "feats_scp": feats, "utt2dur": durs}
    path = F.col("feat_path").asc_nulls_last()
    good = O.repaired(tables, dict.fromkeys(tables, "utt"), {"utt2spk": [F.col("spk").asc_nulls_last()], "feats_scp": [F.col("loaded_at"), path], "utt2dur": [F.col("loaded_at"), F.col("dur")]})
    at = F.unix_micros(F.col("loaded_at").cast("timestamp")).cast("string")
    kept = {"utt2spk": F.col("spk"), "feats_scp": F.col("feat_path"), "utt2dur": at}
    parts = [good[n].select(F.lit(n).alias("table_name"), "utt", kept[n].alias("kept")) for n in tables]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def dd_repaired_directory(spark, sf_dir):
    """The keys that each table of a directory keeps when recordings, segments, speakers and utterances are made to agree."""
    live = lambda t: table(spark, sf_dir, t).where("removed_at is null")
    good = O.repaired_directory(
        live("wav_scp").select(F.col("wav_id").alias("reco")).distinct(), live("segments").where("seg is not null").select("seg", "reco").distinct(), _u2s(spark, sf_dir),
        [table(spark, sf_dir, "feats_scp").where("feat_path is not null"), all_durations(spark, sf_dir)], table(spark, sf_dir, "spk2utt"),
    )
    key = {"utt2spk": F.concat_ws("|", "utt", "spk"), "segments": F.concat_ws("|", "seg", "reco"), "recordings": F.col("reco"), "speakers": F.col("spk"), "per_utt_1": F.col("utt")}
    parts = [good[n].select(F.lit(n).alias("table_name"), k.alias("key")) for n, k in key.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


def dd_combined_uniq(spark, sf_dir):
    """Originals of utterances where only one of two directories names them."""
    raw = table(spark, sf_dir, "raw_list")
    a = {"utt2spk": raw.select("utt", "spk").distinct(), "utt2uniq": raw.select("utt", F.coalesce("spk", F.lit("?")).alias("uniq")).distinct()}
    both = O.combined([a, {"utt2spk": _u2s(spark, sf_dir)}])
    return both["utt2uniq"].groupBy("utt", "uniq").agg(F.count(F.lit(1)).alias("n"))


def dd_combined(spark, sf_dir):
    """Two directories put together: the flat and the nested speaker table, and lengths that only one has."""
    a = {"utt2spk": _u2s(spark, sf_dir), "utt2dur": all_durations(spark, sf_dir)}
    b = {"utt2spk": dd_unnested(spark, sf_dir).withColumn("extra", F.lit(1))}
    return O.combined([a, b])["utt2spk"].groupBy("utt", "spk").agg(F.count(F.lit(1)).alias("n"))


def dd_shared_speakers(spark, sf_dir):
    """Speakers with both short and long utterances."""
    d = _u2s(spark, sf_dir).join(all_durations(spark, sf_dir), "utt")
    return d.where("dur < 6 and dur > 2").select("spk").intersect(d.where("dur > 6").select("spk"))


def dd_set_difference(spark, sf_dir):
    flat, nested = _u2s(spark, sf_dir).where("spk is not null"), dd_unnested(spark, sf_dir)
    return flat.select("utt", "spk").exceptAll(nested).withColumn("side", F.lit("flat")).unionAll(nested.exceptAll(flat.select("utt", "spk")).withColumn("side", F.lit("nested")))


def dd_shortest(spark, sf_dir):
    return O.shortest(all_durations(spark, sf_dir), "dur", "utt", 100)


def dd_first_utts(spark, sf_dir):
    return _u2s(spark, sf_dir).select("utt").distinct().orderBy("utt").limit(100)


def dd_last_utts(spark, sf_dir):
    return O.last_rows(_u2s(spark, sf_dir).select("utt").distinct(), "utt", 100)


def dd_random_utts(spark, sf_dir):
    return O.random_rows(_u2s(spark, sf_dir).select("utt").distinct(), "utt", 100, seed=5)


def dd_local_shuffle(spark, sf_dir):
    """Utterances shuffled within windows of 500."""
    return O.locally_shuffled(_u2s(spark, sf_dir).select("utt").distinct(), ["utt"], "utt", 500, seed=4)


def dd_strided_share(spark, sf_dir):
    """What the third of four workers of the second of two processes reads."""
    return O.strided_share(_u2s(spark, sf_dir).select("utt").distinct(), ["utt"], 1, 2, 2, 4)


def dd_repeated(spark, sf_dir):
    """Three epochs over the recordings."""
    return O.repeated(table(spark, sf_dir, "wav_scp").select("wav_id").distinct(), 3)


def dd_batches(spark, sf_dir):
    """Utterances stacked into batches of 64."""
    b = O.collated(_u2s(spark, sf_dir).select("utt").distinct(), ["utt"], 64)
    return b.select("batch_no", F.size("rows").alias("n"), F.md5(F.array_join(F.transform("rows", lambda r: r["utt"]), " ").cast("binary")).alias("digest"))


def dd_every_few(spark, sf_dir):
    return O.every_few(_u2s(spark, sf_dir).where("spk is not null"), "spk", "utt", 5)


def dd_epoch_order(spark, sf_dir):
    """Utterances in the order of one epoch."""
    return _u2s(spark, sf_dir).select("utt").distinct().withColumn("place_key", O.hex_order("utt", seed=3)).orderBy("place_key", "utt")


def dd_speakers_up_to(spark, sf_dir):
    return O.groups_up_to(_u2s(spark, sf_dir).where("spk is not null"), "spk", 2_000, seed=1)


def dd_strided_part(spark, sf_dir):
    return O.strided_part(_u2s(spark, sf_dir).select("utt").distinct(), ["utt"], 1, 4)


def dd_calibration_trials(spark, sf_dir):
    u = _u2s(spark, sf_dir).where("spk is not null").join(all_durations(spark, sf_dir), "utt")
    return O.calibration_trials(u, 2_000)


def dd_augmented(spark, sf_dir):
    return O.augmented(table(spark, sf_dir, "raw_list").select("utt", "spk").distinct(), "utt", 2)


def dd_grid(spark, sf_dir):
    return O.grid(spark, n_neighbors=[16, 32], min_dist=[0.05, 0.1], min_cluster=[2, 4, 8])


def dd_required_files(spark, sf_dir):
    """Distinct recordings that speakers' first and last utterances need."""
    ends = _u2s(spark, sf_dir).where("spk is not null").groupBy("spk").agg(F.min("utt").alias("a"), F.max("utt").alias("b"))
    return ends.select(F.explode(F.array("a", "b")).alias("utt")).select(F.regexp_replace("utt", r"-\d{8}-\d{8}$", "").alias("reco")).distinct()


def dd_result_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    cells = o.select("o_orderpriority", "o_orderstatus", F.concat(F.col("n").cast("string"), F.lit(" / "), F.col("o_orderstatus")).alias("cell"))
    return O.result_table(cells, "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"], "cell")


def dd_unknown_speaker(spark, sf_dir):
    """A speaker column for a table without one."""
    return table(spark, sf_dir, "feats_scp").select("utt").distinct().withColumn("spk", F.lit("unk"))


def dd_speed_labels(spark, sf_dir):
    ids = dd_labelled(spark, sf_dir).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return ids.select("utt", "spk", "copy_no", O.shifted_label(F.col("id"), F.col("copy_no"), 1_000_000).alias("label"))


_U = "u AS (SELECT DISTINCT utt, spk FROM utt2spk WHERE removed_at IS NULL)"
_D = """d AS (SELECT utt, arg_max(ms, (coalesce(loaded_at, TIMESTAMP '1900-01-01'), ms)) / 1000.0 AS dur FROM (SELECT *, CAST(round(CASE WHEN dur > 1000 THEN dur ELSE dur * 1000 END) AS BIGINT) AS ms
  FROM utt2dur WHERE isfinite(dur) AND dur > 0) GROUP BY utt)"""
_NOISE = "noises AS (SELECT DISTINCT ['noise', 'speech', 'music', 'other'][event_id % 4 + 1] || '-' || event_type AS noise FROM events)"
_HEX = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_UTTS = "k AS (SELECT DISTINCT utt FROM u), r AS (SELECT utt, row_number() OVER (ORDER BY utt) - 1 AS i FROM k)"
_IDS = "ids AS (SELECT spk, row_number() OVER (ORDER BY spk) - 1 AS id FROM (SELECT DISTINCT spk FROM {t} WHERE spk IS NOT NULL))"
_OK = "removed_at IS NULL AND begin_sec >= 0 AND end_sec > begin_sec"
_W = "w AS (SELECT utt, max(wav) AS wav FROM raw_list GROUP BY utt), a AS (SELECT utt, CAST(len(max(vad)) AS INT) AS n_spans FROM raw_list WHERE vad IS NOT NULL GROUP BY utt)"

SQL = {
    "dd_min_utts": f"WITH {_U} SELECT * FROM u WHERE spk IN (SELECT spk FROM u WHERE spk IS NOT NULL GROUP BY spk HAVING count(DISTINCT utt) >= 3)",
    "dd_longer_than": f"WITH {_U}, {_D} SELECT u.* FROM u JOIN d USING (utt) WHERE dur > 5",
    "dd_positive_durations": "SELECT reco, dur FROM reco2dur WHERE dur > 0 AND isfinite(dur)",
    "dd_min_segment": "SELECT seg, begin_sec, end_sec FROM segments WHERE end_sec - begin_sec >= 0.255",
    "dd_with_features": f"WITH {_U} SELECT * FROM u WHERE utt IN (SELECT utt FROM feats_scp WHERE feat_path IS NOT NULL)",
    "dd_without_features": f"WITH {_U} SELECT * FROM u WHERE utt NOT IN (SELECT utt FROM feats_scp WHERE feat_path IS NOT NULL)",
    "dd_speaker_range": f"WITH {_U} SELECT * FROM u WHERE spk < 'id00000100'",
    "dd_codes": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "dd_recoded_trials": "SELECT vec_id AS enroll, CASE WHEN label = 0 THEN 'nontarget' ELSE 'target' END AS label FROM embeddings",
    "dd_path_parts": r"""SELECT DISTINCT wav_path, p[-2] AS folder, regexp_replace(p[-1], '\.[^.]*$', '') AS stem FROM
        (SELECT wav_path, string_split(wav_path, '/') AS p FROM wav_scp WHERE wav_path NOT LIKE '%|' AND wav_path NOT LIKE '% %') WHERE len(p) >= 3""",
    "dd_locator_kind": "SELECT CASE WHEN wav_path IS NULL THEN 'none' WHEN trim(wav_path) LIKE '%|' THEN 'pipe' ELSE 'path' END AS kind, count(*) AS n, count(DISTINCT wav_id) AS n_recordings FROM wav_scp GROUP BY 1",
    "dd_snr_range": f"""WITH {_NOISE} SELECT noise, CASE WHEN noise LIKE 'speech%' THEN 10 WHEN noise LIKE 'music%' THEN 5 ELSE 0 END AS low,
        CASE WHEN noise LIKE 'speech%' THEN 30 ELSE 15 END AS high FROM noises""",
    "dd_segment_id_parts": r"SELECT DISTINCT seg, seg[:-19] AS reco, CAST(seg[-17:-10] AS BIGINT) AS begin_ms, CAST(seg[-8:] AS BIGINT) AS end_ms FROM segments",
    "dd_speaker_ids": f"WITH {_U}, {_IDS.format(t='u')} SELECT * FROM ids",
    "dd_labelled": f"WITH {_IDS.format(t='spk2utt')}, r AS (SELECT DISTINCT utt, spk FROM raw_list) SELECT r.spk, utt, coalesce(id, -1) AS id FROM r LEFT JOIN ids ON r.spk = ids.spk",
    "dd_raw_list": f"WITH {_U}, {_W} SELECT u.utt, spk, wav, n_spans FROM u JOIN w USING (utt) JOIN a USING (utt)",
    "dd_shard_list": f"WITH {_U}, {_W} SELECT u.utt, spk, wav, n_spans FROM u JOIN w USING (utt) LEFT JOIN a USING (utt)",
    "dd_incomplete": f"""WITH {_U} SELECT DISTINCT utt, 'left' AS side FROM u WHERE utt NOT IN (SELECT utt FROM feats_scp)
        UNION ALL SELECT DISTINCT utt, 'right' FROM feats_scp WHERE utt NOT IN (SELECT utt FROM u)""",
    "dd_recording_segments": "SELECT DISTINCT reco, seg FROM segments WHERE removed_at IS NULL AND reco IN (SELECT wav_id FROM wav_scp WHERE removed_at IS NULL)",
    "dd_customer_region": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "dd_model_of": rf"WITH {_U} SELECT regexp_replace(utt, '-\d{{8}}-\d{{8}}$', '') AS model, utt FROM u",
    "dd_enrolled_wavs": f"""WITH {_W}, r AS (SELECT spk, utt, row_number() OVER (PARTITION BY spk ORDER BY utt) - 1 AS i, count(*) OVER (PARTITION BY spk) AS n FROM (SELECT DISTINCT utt, spk FROM raw_list WHERE utt IS NOT NULL AND spk IS NOT NULL))
        SELECT spk, r.utt, wav FROM r JOIN w ON w.utt = r.utt WHERE i % greatest(n // 3, 1) = 0 AND i // greatest(n // 3, 1) < 3""",
    "dd_nested": f"WITH {_U} SELECT spk, CAST(count(*) AS INT) AS n, min(utt) AS first_utt, md5(string_agg(utt, ' ' ORDER BY utt)) AS digest FROM u WHERE spk IS NOT NULL GROUP BY spk",
    "dd_unnested": "SELECT unnest(utts) AS utt, spk FROM spk2utt",
    "dd_voiced_duration": f"SELECT reco, round(sum(end_sec - begin_sec), 3) AS dur FROM segments WHERE {_OK} GROUP BY reco",
    "dd_speech_lists": f"SELECT reco, CAST(count(*) AS INT) AS n, min(begin_sec) AS first_begin, arg_max(end_sec, (begin_sec, end_sec)) AS last_end FROM segments WHERE {_OK} GROUP BY reco",
    "dd_counts": "SELECT count(*) AS n_rows, count(DISTINCT utt) AS n_utts, count(DISTINCT spk) AS n_spks, count(removed_at) AS n_removed FROM utt2spk",
    "dd_first_of_key": "SELECT wav_id, wav_path FROM (SELECT *, row_number() OVER (PARTITION BY wav_id ORDER BY loaded_at, wav_path NULLS LAST) AS r FROM wav_scp) WHERE r = 1",
    "dd_common_keys": f"""WITH {_U} SELECT DISTINCT utt FROM u WHERE utt IN (SELECT utt FROM feats_scp) AND utt IN (SELECT utt FROM utt2dur) AND utt IN (SELECT seg FROM segments)""",
    "dd_repaired": f"""WITH {_U}, k AS (SELECT utt FROM u INTERSECT SELECT utt FROM feats_scp INTERSECT SELECT utt FROM utt2dur),
        a AS (SELECT 'utt2spk' AS table_name, utt, spk AS kept, row_number() OVER (PARTITION BY utt ORDER BY spk NULLS LAST) AS r FROM u
          UNION ALL SELECT 'feats_scp', utt, feat_path, row_number() OVER (PARTITION BY utt ORDER BY loaded_at NULLS FIRST, feat_path NULLS LAST) FROM feats_scp
          UNION ALL SELECT 'utt2dur', utt, CAST(epoch_us(loaded_at) AS VARCHAR), row_number() OVER (PARTITION BY utt ORDER BY loaded_at NULLS FIRST, dur NULLS FIRST) FROM utt2dur)
        SELECT table_name, utt, kept FROM a WHERE r = 1 AND utt IN (SELECT utt FROM k)""",
    "dd_repaired_directory": f"""WITH {_U}, {_D}, w AS (SELECT DISTINCT wav_id AS reco FROM wav_scp WHERE removed_at IS NULL),
        s AS (SELECT DISTINCT seg, reco FROM segments WHERE removed_at IS NULL AND seg IS NOT NULL AND reco IN (SELECT reco FROM w)),
        p AS (SELECT * FROM u WHERE spk IN (SELECT spk FROM spk2utt)),
        k AS (SELECT utt FROM p INTERSECT SELECT seg FROM s INTERSECT SELECT utt FROM feats_scp WHERE feat_path IS NOT NULL INTERSECT SELECT utt FROM d),
        g AS (SELECT * FROM p WHERE utt IN (SELECT utt FROM k)), x AS (SELECT * FROM s WHERE seg IN (SELECT utt FROM k))
        SELECT 'utt2spk' AS table_name, utt || '|' || spk AS key FROM g UNION ALL SELECT 'segments', seg || '|' || reco FROM x UNION ALL SELECT DISTINCT 'recordings', reco FROM x
        UNION ALL SELECT DISTINCT 'speakers', spk FROM g UNION ALL SELECT 'per_utt_1', utt FROM d WHERE utt IN (SELECT utt FROM k)""",
    "dd_combined_uniq": f"WITH {_U} SELECT utt, uniq, count(*) AS n FROM (SELECT DISTINCT utt, coalesce(spk, '?') AS uniq FROM raw_list UNION ALL SELECT DISTINCT utt, utt FROM u) GROUP BY utt, uniq",
    "dd_last_utts": f"WITH {_U} SELECT DISTINCT utt FROM u ORDER BY utt DESC LIMIT 100",
    "dd_random_utts": f"WITH {_U}, {_UTTS} SELECT utt FROM k ORDER BY md5('5|' || utt), utt LIMIT 100",
    "dd_local_shuffle": f"WITH {_U}, {_UTTS} SELECT utt, i // 500 AS window_no, md5('4|' || utt) AS place_key FROM r",
    "dd_strided_share": f"WITH {_U}, {_UTTS} SELECT utt FROM r WHERE i % 2 = 1 AND (i // 2) % 4 = 2",
    "dd_repeated": "SELECT wav_id, CAST(e AS INT) AS epoch FROM (SELECT DISTINCT wav_id FROM wav_scp), (SELECT unnest([0, 1, 2]) AS e)",
    "dd_batches": f"WITH {_U}, {_UTTS} SELECT i // 64 AS batch_no, CAST(count(*) AS INT) AS n, md5(string_agg(utt, ' ' ORDER BY utt)) AS digest FROM r GROUP BY 1",
    "dd_epoch_order": f"WITH {_U}, {_UTTS} SELECT utt, md5('3|' || utt) AS place_key FROM k",
    "dd_speakers_up_to": f"""WITH {_U}, n AS (SELECT spk, count(*) AS n_members FROM u WHERE spk IS NOT NULL GROUP BY spk)
        SELECT spk, n_members FROM (SELECT *, sum(n_members) OVER (ORDER BY md5('1|' || spk), spk) - n_members AS before FROM n) WHERE before < 2000""",
    "dd_calibration_trials": f"""WITH {_U}, {_D}, per AS (SELECT DISTINCT utt, spk, CASE WHEN dur > 2 AND dur < 6 THEN 'short' WHEN dur > 6 THEN 'long' END AS kind FROM u JOIN d USING (utt) WHERE spk IS NOT NULL),
        p AS (SELECT * FROM per WHERE kind IS NOT NULL AND spk IN (SELECT spk FROM per WHERE kind IS NOT NULL GROUP BY spk HAVING count(DISTINCT kind) = 2)),
        s AS (SELECT spk, row_number() OVER (ORDER BY spk) - 1 AS id, count(*) OVER () AS c FROM (SELECT DISTINCT spk FROM p)),
        pools AS (SELECT *, row_number() OVER (PARTITION BY spk, kind ORDER BY utt) - 1 AS i, count(*) OVER (PARTITION BY spk, kind) AS size FROM p),
        g AS (SELECT draw, combo, label FROM (SELECT unnest(range(1000)) AS draw), (SELECT unnest(['short-short', 'short-long', 'long-long']) AS combo), (SELECT unnest(['target', 'nontarget']) AS label)),
        a AS (SELECT g.*, {_HEX.format("'0|' || draw || '|' || combo || '|a'")} % c AS a_id, c FROM g, (SELECT any_value(c) AS c FROM s)),
        b AS (SELECT *, CASE WHEN label = 'target' THEN a_id ELSE (a_id + 1 + {_HEX.format("'0|' || draw || '|' || combo || '|b'")} % (c - 1)) % c END AS b_id FROM a)
        SELECT x.utt AS enroll, y.utt AS test, label, combo AS kind FROM b JOIN s sa ON sa.id = a_id JOIN s sb ON sb.id = b_id
        JOIN pools x ON x.spk = sa.spk AND x.kind = split_part(combo, '-', 1) AND x.i = {_HEX.format("'0|' || draw || '|' || combo || '|a|utt'")} % x.size
        JOIN pools y ON y.spk = sb.spk AND y.kind = split_part(combo, '-', 2) AND y.i = {_HEX.format("'0|' || draw || '|' || combo || '|b|utt'")} % y.size""",
    "dd_combined": f"WITH {_U} SELECT utt, spk, count(*) AS n FROM (SELECT utt, spk FROM u UNION ALL SELECT unnest(utts), spk FROM spk2utt) GROUP BY utt, spk",
    "dd_shared_speakers": f"WITH {_U}, {_D} SELECT spk FROM u JOIN d USING (utt) WHERE dur < 6 AND dur > 2 INTERSECT SELECT spk FROM u JOIN d USING (utt) WHERE dur > 6",
    "dd_set_difference": f"""WITH {_U}, f AS (SELECT utt, spk FROM u WHERE spk IS NOT NULL), n AS (SELECT unnest(utts) AS utt, spk FROM spk2utt)
        SELECT *, 'flat' AS side FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'nested' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM f)""",
    "dd_shortest": f"WITH {_D} SELECT * FROM d ORDER BY dur, utt LIMIT 100",
    "dd_first_utts": f"WITH {_U} SELECT DISTINCT utt FROM u ORDER BY utt LIMIT 100",
    "dd_every_few": f"""WITH {_U}, r AS (SELECT spk, utt, row_number() OVER (PARTITION BY spk ORDER BY utt) - 1 AS i, count(*) OVER (PARTITION BY spk) AS n FROM u WHERE spk IS NOT NULL)
        SELECT spk, utt FROM r WHERE i % greatest(n // 5, 1) = 0 AND i // greatest(n // 5, 1) < 5""",
    "dd_strided_part": f"WITH {_U} SELECT utt FROM (SELECT utt, row_number() OVER (ORDER BY utt) - 1 AS i FROM (SELECT DISTINCT utt FROM u)) WHERE i % 4 = 1",
    "dd_augmented": "SELECT utt || '_copy-' || k AS utt, spk FROM (SELECT DISTINCT utt, spk FROM raw_list), (SELECT unnest([0, 1, 2]) AS k)",
    "dd_grid": "SELECT a AS n_neighbors, CAST(b AS DOUBLE) AS min_dist, c AS min_cluster FROM (SELECT unnest([16, 32]) AS a), (SELECT unnest([0.05, 0.1]) AS b), (SELECT unnest([2, 4, 8]) AS c)",
    "dd_required_files": rf"WITH {_U} SELECT DISTINCT regexp_replace(x, '-\d{{8}}-\d{{8}}$', '') AS reco FROM (SELECT unnest([min(utt), max(utt)]) AS x FROM u WHERE spk IS NOT NULL GROUP BY spk)",
    "dd_result_table": """WITH o AS (SELECT o_orderpriority, o_orderstatus AS s, count(*) || ' / ' || o_orderstatus AS c FROM orders GROUP BY 1, 2)
        SELECT o_orderpriority, coalesce(max(c) FILTER (s = 'F'), '- -') AS F, coalesce(max(c) FILTER (s = 'O'), '- -') AS O,
        coalesce(max(c) FILTER (s = 'P'), '- -') AS P, coalesce(max(c) FILTER (s = 'X'), '- -') AS X FROM o GROUP BY 1""",
    "dd_unknown_speaker": "SELECT DISTINCT utt, 'unk' AS spk FROM feats_scp",
    "dd_speed_labels": f"""WITH {_IDS.format(t='spk2utt')}, r AS (SELECT DISTINCT utt, spk FROM raw_list)
        SELECT utt, r.spk, CAST(k AS INT) AS copy_no, CASE WHEN id IS NULL THEN -1 ELSE id + 1000000 * k END AS label FROM r LEFT JOIN ids ON r.spk = ids.spk, (SELECT unnest([0, 1, 2]) AS k)""",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("dd_")}
