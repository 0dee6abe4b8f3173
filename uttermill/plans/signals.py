"""Queries of the functions on sample and feature arrays, schedules and report lines; vectors stand in for signals."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermill.functions import vectors as V
from uttermill.functions.storage import table
from uttermill.operators import datadir as D
from uttermill.operators.verify import detection_curve, mean_vector
from uttermill.plans.datadir import _HEX, _NOISE, noise_keys
from uttermill.plans.verification import _BASE, _scores, _vectors


def s_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors filled cyclically to 100 elements."""
    v = _vectors(spark, sf_dir)
    x = V.cyclic_fill(F.col("emb"), 100)
    return v.select("utt", F.size(x).alias("n"), F.round(V.dot(x, x), 6).alias("energy"))


def s_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with elements 10 to 19 set to 0."""
    x = V.zero_range(F.col("emb"), F.lit(10), F.lit(20))
    return _vectors(spark, sf_dir).select("utt", F.round(V.dot(x, x), 6).alias("energy"))


def s_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level in decibels, the gain that brings noise 10 dB below it, and the largest element after peak normalisation."""
    db = V.energy_db(F.col("emb"))
    peak = F.array_max(F.transform(V.peak_normalized(F.col("emb")), lambda x: F.abs(x)))
    return _vectors(spark, sf_dir).select("utt", F.round(db, 5).alias("db"), F.round(V.noise_gain(db, F.lit(-30.0), F.lit(10.0)), 6).alias("gain"), F.round(peak, 6).alias("peak"))


def s_pre_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.pre_emphasis(F.col("emb"), 0.97)
    return _vectors(spark, sf_dir).select("utt", F.round(V.dot(x, x), 6).alias("energy"))


def s_frames_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of eight elements, less their mean over time."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("emb", i * 8 + 1, F.lit(8)))
    x = F.flatten(V.mean_normalized(frames))
    return _vectors(spark, sf_dir).select("utt", F.round(V.dot(x, x), 6).alias("energy"))


def s_cut_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each vector from 0.1 to 0.3 s and from 0.5 to 0.6 s, at 64 elements a second."""
    spans = F.array(F.struct(F.lit(0.1).alias("begin"), F.lit(0.3).alias("end")), F.struct(F.lit(0.5).alias("begin"), F.lit(0.6).alias("end")))
    x = V.cut_spans(F.col("emb"), spans, 64)
    return _vectors(spark, sf_dir).select("utt", F.size(x).alias("n"), F.round(V.dot(x, x), 6).alias("energy"))


def s_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mel scale and its inverse, and a window of 65 points, for each position of a vector."""
    pos = _vectors(spark, sf_dir).select(F.posexplode("emb").alias("pos", "x")).select("pos").distinct()
    p = F.col("pos").cast("double")
    return pos.select("pos", F.round(V.mel(p * 100), 5).alias("mel"), F.round(V.inverse_mel(p * 40), 5).alias("hertz"), F.round(V.hamming(p, F.lit(65.0)), 6).alias("window"))


def s_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rates over the steps of a run."""
    steps = D.grid(spark, step=list(range(0, 101, 5)))
    s = F.col("step").cast("double")
    return steps.select("step", F.round(V.exponential_rate(s, 100.0, 0.1, 0.001, 10.0), 8).alias("exponential"), F.round(V.cosine_rate(s, 100.0, 0.1, 0.001), 8).alias("cosine"))


def s_fused_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as clipped sigmoids."""
    return _scores(spark, sf_dir).select("enroll", "test", F.round(V.clipped_sigmoid(3 * F.col("score")), 6).alias("score"))


def s_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time in segments against time in recordings, as one rate."""
    a = table(spark, sf_dir, "segments").where("removed_at is null and begin_sec >= 0 and end_sec > begin_sec").agg(F.sum(F.col("end_sec") - F.col("begin_sec")).alias("a"))
    b = table(spark, sf_dir, "reco2dur").where("dur > 0 and not isnan(dur) and dur < 1e9").groupBy("reco").agg(F.max("dur").alias("d")).agg(F.sum("d").alias("b"))
    return b.select(F.round(a.scalar() / F.col("b"), 6).alias("rate"))


def s_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the cheapest orders of each priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("m")).select("o_orderpriority", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_totalprice").alias("o_totalprice"))


def s_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of at least 5 utterances, cut to 50 at a hashed place."""
    rows = table(spark, sf_dir, "spk2utt").groupBy("spk").agg(F.max(F.struct(F.size("utts").alias("k"), "utts")).alias("m")).select("spk", "m.utts")
    kept = D.capped(rows, "utts", 5, 50, key="spk")
    return kept.select("spk", F.size("utts").alias("n"), F.get("utts", F.lit(0)).alias("first_utt"), F.element_at("utts", -1).alias("last_utt"))


def s_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two long and four short crops of each vector at hashed places."""
    v = _vectors(spark, sf_dir).withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(5))))
    n = F.when(F.col("crop") < 2, 48).otherwise(16)
    start = F.pmod(D.hex_number(D.hex_order("utt", "crop", seed=3)), (F.size("emb") - n + 1).cast("bigint")).cast("int")
    return v.select("utt", "crop", start.alias("start"), F.slice("emb", start + 1, n).alias("x")).select("utt", "crop", "start", F.size("x").alias("n"), F.round(V.dot(F.col("x"), F.col("x")), 6).alias("energy"))


def s_noise_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hashed noise and signal-to-noise ratio for each utterance of raw_list."""
    kinds = D.dense_ids(noise_keys(spark, sf_dir), "noise")
    n = kinds.agg(F.count(F.lit(1)).alias("n"))
    utts = table(spark, sf_dir, "raw_list").where("utt is not null").select("utt").distinct().select("utt", n.scalar().alias("n")).withColumn("id", D.hex_number(D.hex_order("utt", seed=5)) % F.col("n"))
    r = D.snr_range(F.col("noise"))
    unit = D.hex_number(D.hex_order("utt", seed=6)) % 1_000 / 1_000.0
    return utts.join(kinds, "id").select("utt", "noise", (r["low"] + unit * (r["high"] - r["low"])).alias("snr_db"))


def s_detection_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection curve on normal deviate axes."""

    @F.pandas_udf("double")
    def probit(p: pd.Series) -> pd.Series:
        return p.clip(1e-6, 1 - 1e-6).map(NormalDist().inv_cdf)

    return detection_curve(_scores(spark, sf_dir)).select("n", probit("fpr").alias("x"), probit("fnr").alias("y"))


def s_schedule_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangular learning rate whose peaks are halved, and a rising margin."""
    steps = D.grid(spark, step=list(range(0, 101, 2)))
    s = F.col("step").cast("double")
    return steps.select("step", F.round(V.triangular_rate(s, 20.0, 0.1, 0.001), 8).alias("triangular"), F.round(V.margin_at(s, 20.0, 80.0, 0.0, 0.2), 8).alias("margin"))


def s_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector in chunks of 20 elements, the last filled up from its head."""
    v = _vectors(spark, sf_dir).select("utt", F.posexplode(V.fixed_chunks(F.col("emb"), 20)).alias("chunk_no", "x"))
    return v.select("utt", "chunk_no", F.size("x").alias("n"), F.round(V.dot(F.col("x"), F.col("x")), 6).alias("energy"))


def s_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector in the steps of 24 samples that a speech detector reads, the last filled up with zeros."""
    v = _vectors(spark, sf_dir).select("utt", F.posexplode(V.zero_padded_steps(F.col("emb"), 24)).alias("step", "x"))
    return v.select("utt", "step", F.size("x").alias("n"), F.round(V.dot(F.col("x"), F.col("x")), 6).alias("energy"))


def s_chunk_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each vector's chunks."""
    v = _vectors(spark, sf_dir).select("utt", F.explode(V.fixed_chunks(F.col("emb"), 20)).alias("x"))
    mean = mean_vector(v, "x", "utt")
    return mean.select("utt", "n", F.round(V.dot(F.col("mean"), F.col("mean")), 6).alias("energy"))


def s_report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates read from the report lines of scoring programs; other lines have none."""
    p = table(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 3 == 0, F.lit("no score here")).otherwise(F.concat(F.lit("OVERALL SPEAKER DIARIZATION ERROR = "), F.format_string("%.2f", "p_retailprice"), F.lit(" percent of scored speaker time")))
    return p.select("p_partkey", line.alias("line")).select("p_partkey", V.reported_percent(F.col("line")).alias("percent"))


_V = "v AS (SELECT vec_id AS utt, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS emb FROM embeddings)"


def _energy(inner: str, n: bool = False) -> str:
    return f"WITH {_V}, y AS (SELECT utt, {inner} AS x FROM v) SELECT utt, {'CAST(len(x) AS INT) AS n, ' if n else ''}round(list_dot_product(x, x), 6) AS energy FROM y"


SQL = {
    "s_filled": _energy("list_transform(range(100), lambda i: emb[i % len(emb) + 1])", True),
    "s_masked": _energy("list_transform(emb, lambda x, i: CASE WHEN i BETWEEN 11 AND 20 THEN 0.0 ELSE x END)"),
    "s_levels": f"""WITH {_V}, d AS (SELECT utt, emb, 10 * log10(list_dot_product(emb, emb) / len(emb) + 1e-4) AS db, list_max(list_transform(emb, lambda x: abs(x))) AS m FROM v)
      SELECT utt, round(db, 5) AS db, round(pow(10, (db + 30 - 10) / 20), 6) AS gain, round(m / (m + 1e-4), 6) AS peak FROM d""",
    "s_pre_emphasis": _energy("list_transform(emb, lambda x, i: x - 0.97 * emb[greatest(i - 1, 1)])"),
    "s_frames_mean": f"""WITH {_V}, e AS (SELECT utt, unnest(emb) AS x, generate_subscripts(emb, 1) - 1 AS p FROM v), c AS (SELECT utt, x - avg(x) OVER (PARTITION BY utt, p % 8) AS z FROM e)
      SELECT utt, round(sum(z * z), 6) AS energy FROM c GROUP BY utt""",
    "s_cut_spans": _energy("list_concat(emb[7:19], emb[33:38])", True),
    "s_scales": """SELECT CAST(i AS INT) AS pos, round(1127 * ln(1 + i * 100 / 700.0), 5) AS mel, round(700 * (exp(i * 40 / 1127.0) - 1), 5) AS hertz,
      round(0.54 - 0.46 * cos(2 * pi() * i / 64.0), 6) AS window FROM (SELECT unnest(range(64)) AS i)""",
    "s_schedules": """SELECT CAST(s AS INT) AS step, round(0.1 * exp(s / 100.0 * ln(0.01)) * CASE WHEN s < 10 THEN s / 10.0 ELSE 1 END, 8) AS exponential,
      round(0.001 + 0.5 * 0.099 * (1 + cos(pi() * s / 100.0)), 8) AS cosine FROM (SELECT unnest(range(0, 101, 5)) AS s)""",
    "s_coverage": """SELECT round((SELECT sum(end_sec - begin_sec) FROM segments WHERE removed_at IS NULL AND begin_sec >= 0 AND end_sec > begin_sec)
      / (SELECT sum(d) FROM (SELECT max(dur) AS d FROM reco2dur WHERE dur > 0 AND isfinite(dur) AND dur < 1e9 GROUP BY reco)), 6) AS rate""",
    "s_fused_sigmoid": f"{_BASE} SELECT enroll, test, round(1 / (1 + exp(-greatest(least(3 * score, 60), -60))), 6) AS score FROM s",
    "s_capped": """WITH c AS (SELECT spk, arg_max(utts, (len(utts), utts)) AS utts FROM spk2utt GROUP BY spk),
      p AS (SELECT spk, utts, len(utts) AS n, CAST('0x' || substr(md5('0|' || spk), 1, 8) AS BIGINT) % greatest(len(utts) - 49, 1) AS s FROM c WHERE len(utts) >= 5),
      k AS (SELECT spk, CASE WHEN n > 50 THEN utts[s + 1:s + 50] ELSE utts END AS utts FROM p) SELECT spk, CAST(len(utts) AS INT) AS n, utts[1] AS first_utt, utts[-1] AS last_utt FROM k""",
    "s_crops": f"""WITH {_V}, c AS (SELECT utt, emb, unnest(range(6)) AS crop FROM v), n AS (SELECT *, CASE WHEN crop < 2 THEN 48 ELSE 16 END AS n FROM c),
      p AS (SELECT *, CAST('0x' || substr(md5('3|' || utt || '|' || crop), 1, 8) AS BIGINT) % (len(emb) - n + 1) AS s FROM n), x AS (SELECT *, emb[s + 1:s + n] AS y FROM p)
      SELECT utt, CAST(crop AS INT) AS crop, CAST(s AS INT) AS start, CAST(n AS INT) AS n, round(list_dot_product(y, y), 6) AS energy FROM x""",
    "s_noise_pick": f"""WITH {_NOISE}, k AS (SELECT noise, row_number() OVER (ORDER BY noise) - 1 AS id, count(*) OVER () AS n FROM noises),
      u AS (SELECT DISTINCT utt FROM raw_list WHERE utt IS NOT NULL), x AS (SELECT utt, {_HEX.format("'5|' || utt")} AS a, {_HEX.format("'6|' || utt")} % 1000 / 1000.0 AS unit FROM u)
      SELECT utt, noise, CASE WHEN noise LIKE 'speech%' THEN 10 WHEN noise LIKE 'music%' THEN 5 ELSE 0 END + unit * CASE WHEN noise LIKE 'speech%' THEN 20 WHEN noise LIKE 'music%' THEN 10 ELSE 15 END AS snr_db
      FROM x JOIN k ON k.id = a % n""",
    "s_schedule_forms": """SELECT CAST(s AS INT) AS step, round(0.001 + 0.099 * pow(0.5, s // 20) * CASE WHEN s % 20 <= 10 THEN (s % 20) / 10.0 ELSE 1 - (s % 20 - 10) / 10.0 END, 8) AS triangular,
      round(CASE WHEN s < 20 THEN 0.0 WHEN s >= 80 THEN 0.2 ELSE 0.2 * (1 - exp((s - 20) / 60.0 * ln(1e-3 / (1 + 1e-6)))) END, 8) AS margin FROM (SELECT unnest(range(0, 101, 2)) AS s)""",
    "s_chunks": f"""WITH {_V}, c AS (SELECT utt, unnest([emb[1:20], emb[21:40], emb[41:60], list_concat(emb[61:64], emb[1:16])]) AS x, unnest(range(4)) AS chunk_no FROM v)
      SELECT utt, CAST(chunk_no AS INT) AS chunk_no, CAST(len(x) AS INT) AS n, round(list_dot_product(x, x), 6) AS energy FROM c""",
    "s_steps": f"""WITH {_V}, c AS (SELECT utt, unnest([emb[1:24], emb[25:48], list_concat(emb[49:64], [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])]) AS x, unnest(range(3)) AS step FROM v)
      SELECT utt, CAST(step AS INT) AS step, CAST(len(x) AS INT) AS n, round(list_dot_product(x, x), 6) AS energy FROM c""",
    "s_chunk_mean": f"""WITH {_V}, c AS (SELECT utt, [emb[1:20], emb[21:40], emb[41:60], list_concat(emb[61:64], emb[1:16])] AS x FROM v),
      m AS (SELECT utt, list_transform(range(1, 21), lambda i: (x[1][i] + x[2][i] + x[3][i] + x[4][i]) / 4) AS m FROM c) SELECT utt, CAST(4 AS BIGINT) AS n, round(list_dot_product(m, m), 6) AS energy FROM m""",
    "s_report_numbers": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(format('{:.2f}', p_retailprice) AS DOUBLE) END AS percent FROM part",
    "s_best_of": "SELECT o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderpriority",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("s_")}
