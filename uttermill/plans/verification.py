"""Verification queries on the ``embeddings`` table: each label's first vector is enrolled and tested by all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermill.functions import vectors as V
from uttermill.functions.storage import table, written
from uttermill.operators import verify as O


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt"), F.col("embedding").alias("emb"), F.col("label").alias("spk"))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every enrolled vector against every other one."""
    v = _vectors(spark, sf_dir)
    enrolled = v.groupBy("spk").agg(F.min("utt").alias("enroll")).agg(F.collect_list(F.struct("enroll", "spk")).alias("e"))  # one per label
    rows = v.select(F.col("utt").alias("test"), "spk", F.explode(enrolled.scalar()).alias("e")).where("test <> e.enroll")
    return rows.select(F.col("e.enroll").alias("enroll"), "test", F.when(F.col("e.spk") == F.col("spk"), "target").otherwise("nontarget").alias("label"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = O.score_trials(_trials(spark, sf_dir), _vectors(spark, sf_dir))
    return scored.select("enroll", "test", F.round("score", 5).alias("score"), "label")


def v_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def v_global_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = O.mean_vector(_vectors(spark, sf_dir), "emb")
    return mean.select(F.posexplode("mean").alias("pos", "m")).select("pos", F.round("m", 6).alias("mean"))


def v_speaker_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = O.mean_vector(_vectors(spark, sf_dir), "emb", "spk")
    return mean.select("spk", "n", F.posexplode("mean").alias("pos", "m")).select("spk", "n", "pos", F.round("m", 6).alias("mean"))


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    mean = O.mean_vector(v, "emb").select(F.transform("mean", lambda x: F.round(x, 9)).alias("m"))
    with_mean = v.select("utt", "spk", "emb", mean.scalar().alias("m"))
    return with_mean.select("utt", "spk", V.subtract(F.col("emb"), F.col("m")).alias("emb"))


def v_centred_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = O.score_trials(_trials(spark, sf_dir), _centred(spark, sf_dir))
    return scored.select("enroll", "test", F.round("score", 5).alias("score"), "label")


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = O.mean_vector(_vectors(spark, sf_dir), "emb", "spk")
    return mean.select("spk", F.transform("mean", lambda x: F.round(x, 9)).alias("emb"))


def _stats(spark: SparkSession, sf_dir: str, top_n: int | None = 5) -> DataFrame:
    return O.cohort_statistics(_vectors(spark, sf_dir), _cohort(spark, sf_dir), top_n)


def v_cohort_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("utt", *(F.round(c, 6).alias(c) for c in ("magnitude", "cohort_mean", "cohort_std")))


def v_cohort_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, None).select("utt", *(F.round(c, 6).alias(c) for c in ("magnitude", "cohort_mean", "cohort_std")))


def _normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir).select("utt", *(F.round(c, 6).alias(c) for c in ("magnitude", "cohort_mean", "cohort_std")))
    return O.normalized_scores(_scores(spark, sf_dir), stats)


def v_normed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normed(spark, sf_dir).withColumn("score", F.round("score", 5))


def v_calibration_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.calibration_factors(v_normed_scores(spark, sf_dir))


def v_detection_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.detection_curve(_scores(spark, sf_dir)).select("score", "enroll", "test", F.round("fnr", 9).alias("fnr"), F.round("fpr", 9).alias("fpr"))


def v_equal_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.equal_error_rate_of_scores(_scores(spark, sf_dir)).select(F.round("eer", 6).alias("eer"), "threshold")


def v_minimum_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = written(O.detection_curve(_scores(spark, sf_dir)), "curve")
    rows = [O.minimum_cost(curve, p).select(F.lit(p).alias("p_target"), F.round("min_cost", 6).alias("min_cost")) for p in (0.01, 0.005, 0.001)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def v_simple_eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.simple_equal_error_rate(_scores(spark, sf_dir)).select(F.round("eer", 6).alias("eer"), "threshold")


def v_cllr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.log_likelihood_cost(_scores(spark, sf_dir)).select(F.round("cllr", 6).alias("cllr"))


def v_equalized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.equalized_weights(_scores(spark, sf_dir), "enroll").select("enroll", "n", "n_targets", F.round("weight", 6).alias("weight"))


def v_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.score_histogram(_scores(spark, sf_dir), -1.0, 1.0, 64).select("bin", "n", F.round("cumulative", 9).alias("cumulative"))


def v_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of trials between each speaker's first utterance and the others of raw_list that lack an embedding."""
    raw = table(spark, sf_dir, "raw_list").where("utt is not null and spk is not null").select("utt", "spk").distinct()
    wanted = raw.join(raw.groupBy("spk").agg(F.min("utt").alias("enroll")), "spk").select("enroll", F.col("utt").alias("test"))
    there = table(spark, sf_dir, "utt_embeddings").where("emb is not null").select(F.col("utt_name").alias("utt")).distinct()
    return O.missing_ids(wanted, there)


def v_binned_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection curve at 1,000 evenly spaced thresholds."""
    return O.binned_curve(_scores(spark, sf_dir), 1_000).select("bin", F.round("threshold", 6).alias("threshold"), F.round("fnr", 9).alias("fnr"), F.round("fpr", 9).alias("fpr"))


def v_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate and costs of trials whose ids begin with the speaker."""
    v = _vectors(spark, sf_dir).select("utt", F.format_string("%07d", "spk").alias("prefix"))
    named = lambda side: v.select(F.col("utt").alias(side), F.format_string("%s-%012d", "prefix", "utt").alias(f"{side}_name"))
    rows = _scores(spark, sf_dir).join(named("enroll"), "enroll").join(named("test"), "test").select(F.col("enroll_name").alias("enroll"), F.col("test_name").alias("test"), "score")
    r = O.detection_report(rows)
    return r.select(F.round("eer_percent", 4).alias("eer_percent"), "threshold", *(F.round(c, 6).alias(c) for c in ("dcf08", "dcf10", "c_primary")))


def v_duration_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors with durations, which count up to 10 s; they are made from the ids, as the vectors have none."""
    dur = _vectors(spark, sf_dir).select("utt", (1 + F.col("utt") % 23 / 2.0).alias("dur"))
    return O.calibration_factors(v_normed_scores(spark, sf_dir), dur, 10.0)


def v_unlabelled_in_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers' means against the mean of all vectors, to which those without a label contribute: labels from 7 on are taken as unknown."""
    v = _vectors(spark, sf_dir)
    labelled = v.where("spk < 7")
    mean = O.mean_vector(v, "emb").select(F.struct("mean", "n").alias("g")).scalar()
    n = labelled.agg(F.count(F.lit(1))).scalar()
    rows = O.mean_vector(labelled, "emb", "spk").select("spk", "mean", mean.alias("g"), n.alias("n_labelled"))
    x = V.subtract(F.col("mean"), F.col("g.mean"))
    return rows.select("spk", F.round(V.dot(x, x), 6).alias("energy"), F.col("g.n").alias("n_all"), "n_labelled")


def v_best_enrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    people = v.select(F.concat(F.lit("spk"), F.col("spk").cast("string")).alias("name"), "emb", F.col("utt").alias("ordinal"))
    best = O.best_enrolled(v, people)
    return best.select("utt", "name", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("accepted"))


def v_plda_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials scored by a diagonal two-covariance model with psi = 8, 4, 8/3, ... as given parameters."""
    psi = V.literal_vector([8.0 / (i + 1) for i in range(64)])
    scored = O.score_trials(_trials(spark, sf_dir), _vectors(spark, sf_dir), score=V.plda_llr(F.col("e_emb"), F.col("t_emb"), psi, F.lit(1)))
    return scored.select("enroll", "test", F.round("score", 5).alias("score"), "label")


_V = "v AS (SELECT vec_id AS utt, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS emb, label AS spk FROM embeddings)"
_T = """t AS (
  SELECT e.enroll, v.utt AS test, CASE WHEN e.spk = v.spk THEN 'target' ELSE 'nontarget' END AS label
  FROM (SELECT spk, min(utt) AS enroll FROM v GROUP BY spk) e, v WHERE v.utt <> e.enroll)"""
_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
_S = f"""s AS (SELECT t.enroll, t.test, round({_COS.format(a='a.emb', b='b.emb')}, 5) + 0.0 AS score, t.label
  FROM t JOIN v a ON a.utt = t.enroll JOIN v b ON b.utt = t.test)"""
_BASE = f"WITH {_V}, {_T}, {_S}"
_MEAN = "SELECT pos, avg(x) AS m {by} FROM (SELECT unnest(emb) AS x, generate_subscripts(emb, 1) AS pos {by} FROM v) GROUP BY pos {by}"
_COHORT = f"""cohort AS (SELECT spk, list(round(m, 9) ORDER BY pos) AS c FROM ({_MEAN.format(by=', spk')}) GROUP BY spk),
pairs AS (SELECT v.utt, sqrt(list_dot_product(v.emb, v.emb)) AS magnitude, round({_COS.format(a='v.emb', b='c')}, 12) AS x FROM v, cohort),
ranked AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY x DESC) AS r FROM pairs)"""
_STATS = "SELECT utt, round(min(magnitude), 6) AS magnitude, round(avg(x), 6) + 0.0 AS cohort_mean, round(stddev_pop(x), 6) AS cohort_std FROM ranked {where} GROUP BY utt"
_NORMED = f"""{_BASE}, {_COHORT}, st AS ({_STATS.format(where='WHERE r <= 5')}),
normed AS (SELECT s.enroll, s.test, round(0.5 * ((s.score - e.cohort_mean) / e.cohort_std + (s.score - q.cohort_mean) / q.cohort_std), 5) + 0.0 AS score, s.label,
  e.magnitude AS enroll_magnitude, q.magnitude AS test_magnitude, e.cohort_mean AS enroll_cohort_mean, q.cohort_mean AS test_cohort_mean
  FROM s JOIN st e ON e.utt = s.enroll JOIN st q ON q.utt = s.test)"""
_CURVE = """c AS (SELECT score, enroll, test, row_number() OVER w AS n,
  sum(CAST(label = 'target' AS INT)) OVER w / sum(CAST(label = 'target' AS INT)) OVER () AS fnr,
  1 - sum(CAST(label <> 'target' AS INT)) OVER w / sum(CAST(label <> 'target' AS INT)) OVER () AS fpr
  FROM s WINDOW w AS (ORDER BY score, enroll, test ROWS UNBOUNDED PRECEDING))"""


def _factors(name: str, a: str, b: str) -> str:
    lo, hi = f"least({a}, {b})", f"greatest({a}, {b})"
    cut = lambda x, n: f"floor(({x}) * 10000.0 + 0.5) / 10000.0 AS {name}_{n}"
    return ", ".join((cut(lo, "min"), cut(hi, "max"), cut(f"{hi} - {lo}", "diff"), cut(f"{hi} / {lo}", "ratio")))


QUERIES = {
    f.__name__: f
    for f in (
        v_scores, v_global_mean, v_speaker_mean, v_centred_scores, v_cohort_top5, v_cohort_all, v_normed_scores, v_calibration_factors, v_detection_curve,
        v_equal_error_rate, v_minimum_cost, v_simple_eer, v_cllr, v_equalized_weights, v_score_histogram, v_missing_vectors, v_best_enrolled, v_plda_scores,
        v_binned_curve, v_report, v_duration_factors, v_unlabelled_in_mean,
    )
}

SQL = {
    "v_scores": f"{_BASE} SELECT * FROM s",
    "v_global_mean": f"WITH {_V} SELECT CAST(pos - 1 AS INT) AS pos, round(m, 6) + 0.0 AS mean FROM ({_MEAN.format(by='')})",
    "v_speaker_mean": f"WITH {_V} SELECT spk, n, CAST(pos - 1 AS INT) AS pos, round(m, 6) + 0.0 AS mean FROM ({_MEAN.format(by=', spk')}) JOIN (SELECT spk, count(*) AS n FROM v GROUP BY spk) USING (spk)",
    "v_centred_scores": f"""WITH {_V}, m AS (SELECT list(round(m, 9) ORDER BY pos) AS m FROM ({_MEAN.format(by='')})), {_T},
      z AS (SELECT utt, list_transform(list_zip(emb, m), lambda p: p[1] - p[2]) AS emb FROM v, m)
      SELECT t.enroll, t.test, round({_COS.format(a='a.emb', b='b.emb')}, 5) + 0.0 AS score, t.label
      FROM t JOIN z a ON a.utt = t.enroll JOIN z b ON b.utt = t.test""",
    "v_cohort_top5": f"WITH {_V}, {_COHORT} {_STATS.format(where='WHERE r <= 5')}",
    "v_cohort_all": f"WITH {_V}, {_COHORT} {_STATS.format(where='')}",
    "v_normed_scores": f"{_NORMED} SELECT * FROM normed",
    "v_calibration_factors": f"{_NORMED} SELECT enroll, test, label, score, {_factors('magnitude', 'enroll_magnitude', 'test_magnitude')}, {_factors('cohort', 'enroll_cohort_mean', 'test_cohort_mean')} FROM normed",
    "v_detection_curve": f"{_BASE}, {_CURVE} SELECT score, enroll, test, round(fnr, 9) AS fnr, round(fpr, 9) + 0.0 AS fpr FROM c",
    "v_equal_error_rate": f"""{_BASE}, {_CURVE}, h AS (SELECT * FROM c WHERE fnr - fpr >= 0 ORDER BY n LIMIT 1), l AS (SELECT * FROM c WHERE fnr - fpr < 0 ORDER BY n DESC LIMIT 1)
      SELECT round(h.fnr + (h.fnr - h.fpr) / ((l.fpr - h.fpr) - (l.fnr - h.fnr)) * (l.fnr - h.fnr), 6) AS eer, h.score AS threshold FROM h, l""",
    "v_minimum_cost": f"""{_BASE}, {_CURVE}, p AS (SELECT CAST(unnest([0.01, 0.005, 0.001]) AS DOUBLE) AS p_target)
      SELECT p_target, round(min(p_target * fnr + (1 - p_target) * fpr) / least(p_target, 1 - p_target), 6) AS min_cost FROM c, p GROUP BY p_target""",
    "v_simple_eer": f"""{_BASE}, d AS (SELECT score, count(*) FILTER (label = 'target') AS t, count(*) FILTER (label <> 'target') AS i FROM s GROUP BY score),
      r AS (SELECT score, (sum(t) OVER w - t) / sum(t) OVER () AS frr, (sum(i) OVER () - sum(i) OVER w + i) / sum(i) OVER () AS far FROM d WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))
      SELECT round((far + frr) / 2, 6) AS eer, score AS threshold FROM r ORDER BY abs(far - frr), score LIMIT 1""",
    "v_cllr": f"{_BASE} SELECT round((avg(ln(1 + exp(-score))) FILTER (label = 'target') + avg(ln(1 + exp(score))) FILTER (label <> 'target')) / 2 / ln(2), 6) AS cllr FROM s",
    "v_equalized_weights": f"""{_BASE}, k AS (SELECT enroll, count(*) AS n, count(*) FILTER (label = 'target') AS n_targets FROM s GROUP BY enroll)
      SELECT enroll, n, n_targets, CASE WHEN n_targets > 0 THEN round(max(n_targets) OVER () / n_targets, 6) ELSE 0.0 END AS weight FROM k""",
    "v_score_histogram": f"""{_BASE}, b AS (SELECT CAST(least(floor((score + 1) / (2.0 / 64)), 63) AS INT) AS bin, count(*) AS n FROM s WHERE score BETWEEN -1 AND 1 GROUP BY 1)
      SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS cumulative FROM b""",
    "v_missing_vectors": """WITH r AS (SELECT DISTINCT utt, spk FROM raw_list WHERE utt IS NOT NULL AND spk IS NOT NULL),
      t AS (SELECT enroll, utt AS test FROM r JOIN (SELECT spk, min(utt) AS enroll FROM r GROUP BY spk) USING (spk))
      SELECT utt, count(*) AS n_trials FROM (SELECT enroll AS utt FROM t UNION ALL SELECT test FROM t) WHERE utt NOT IN (SELECT utt_name FROM utt_embeddings WHERE emb IS NOT NULL) GROUP BY utt""",
    "v_binned_curve": f"""{_BASE}, e AS (SELECT min(score) AS low, (max(score) - min(score)) / 999 AS w FROM s),
      b AS (SELECT CAST(least(floor((score - low) / w), 998) AS BIGINT) AS bin, label, low, w FROM s, e),
      p AS (SELECT bin, min(low + (bin + 1) * w) AS threshold, count(*) FILTER (label = 'target') AS t, count(*) FILTER (label <> 'target') AS i FROM b GROUP BY bin)
      SELECT bin, round(threshold, 6) + 0.0 AS threshold, round(sum(t) OVER o / sum(t) OVER (), 9) AS fnr, round(1 - sum(i) OVER o / sum(i) OVER (), 9) + 0.0 AS fpr FROM p WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)""",
    "v_report": f"""{_BASE}, {_CURVE}, h AS (SELECT * FROM c WHERE fnr - fpr >= 0 ORDER BY n LIMIT 1), l AS (SELECT * FROM c WHERE fnr - fpr < 0 ORDER BY n DESC LIMIT 1),
      m AS (SELECT min(0.01 * fnr + 0.99 * fpr) / 0.01 AS a, min(0.001 * fnr + 0.999 * fpr) / 0.001 AS b, min(0.005 * fnr + 0.995 * fpr) / 0.005 AS d FROM c)
      SELECT round(100 * (h.fnr + (h.fnr - h.fpr) / ((l.fpr - h.fpr) - (l.fnr - h.fnr)) * (l.fnr - h.fnr)), 4) AS eer_percent, h.score AS threshold, round(a, 6) AS dcf08, round(b, 6) AS dcf10, round((a + d) / 2, 6) AS c_primary FROM h, l, m""",
    "v_duration_factors": f"""{_NORMED}, dur AS (SELECT utt, least(1 + utt % 23 / 2.0, 10.0) AS d FROM v)
      SELECT enroll, test, label, score, {_factors('duration', 'a.d', 'b.d')}, {_factors('magnitude', 'enroll_magnitude', 'test_magnitude')}, {_factors('cohort', 'enroll_cohort_mean', 'test_cohort_mean')}
      FROM normed JOIN dur a ON a.utt = enroll JOIN dur b ON b.utt = test""",
    "v_unlabelled_in_mean": f"""WITH {_V}, g AS (SELECT pos, avg(x) AS g FROM (SELECT unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM v) GROUP BY pos),
      m AS (SELECT spk, pos, avg(x) AS m FROM (SELECT spk, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM v WHERE spk < 7) GROUP BY ALL)
      SELECT spk, round(sum((m - g) * (m - g)), 6) AS energy, (SELECT count(*) FROM v) AS n_all, (SELECT count(*) FROM v WHERE spk < 7) AS n_labelled FROM m JOIN g USING (pos) GROUP BY spk""",
    "v_best_enrolled": f"""WITH {_V}, e AS (SELECT 'spk' || spk AS name, min(utt) AS ordinal, arg_min(emb, utt) AS emb FROM v GROUP BY spk),
      p AS (SELECT v.utt, e.name, e.ordinal, ({_COS.format(a='v.emb', b='e.emb')} + 1) / 2 AS score FROM v, e)
      SELECT utt, name, round(score, 6) AS score, score >= 0.5 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY score DESC, ordinal) AS r FROM p) WHERE r = 1""",
    "v_plda_scores": f"""WITH {_V}, {_T}, x AS (
        SELECT t.enroll, t.test, t.label, unnest(a.emb) AS e, unnest(b.emb) AS q, 8.0 / generate_subscripts(a.emb, 1) AS p
        FROM t JOIN v a ON a.utt = t.enroll JOIN v b ON b.utt = t.test)
      SELECT enroll, test, round(sum(-0.5 * (ln(1 + p / (p + 1)) + pow(q - p / (p + 1) * e, 2) / (1 + p / (p + 1))) + 0.5 * (ln(1 + p) + q * q / (1 + p))), 5) + 0.0 AS score, label
      FROM x GROUP BY enroll, test, label""",
}
