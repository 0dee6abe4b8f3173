"""Queries of the model-fitting, grouped and stateful operators. Where SQL cannot express them, tests compare them with plain loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermill.functions import vectors as V
from uttermill.functions.storage import table
from uttermill.operators import backend as B
from uttermill.operators import cluster as C
from uttermill.operators.verify import mean_vector
from uttermill.plans.datadir import all_durations
from uttermill.plans.diarization import _pieces
from uttermill.plans.verification import _normed, _trials, _vectors
from uttermill.streaming.stateful import framed, registered, speech_stretches


def m_trained_plda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials scored by a two-covariance model that is fitted to all vectors."""
    v = _vectors(spark, sf_dir)
    model = B.TwoCovariance.fit(v, "spk", "emb", 5)
    enrolled = _trials(spark, sf_dir).select("enroll").distinct().join(v, F.col("enroll") == F.col("utt")).select(F.col("enroll").alias("name"), "emb", F.lit(1).alias("n"))
    return model.score(_trials(spark, sf_dir), enrolled, v).withColumn("score", F.round("score", 4))


def m_adapted_plda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagonal of the model before and after unsupervised adaptation."""
    v = _vectors(spark, sf_dir)
    model = B.TwoCovariance.fit(v, "spk", "emb", 5)
    after = model.adapted(v, "emb")
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(model.psi, after.psi))], "pos int, psi double, adapted_psi double")


def m_session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean of all its vectors against every vector, with the number of sessions taken into account."""
    v = _vectors(spark, sf_dir)
    model = B.TwoCovariance.fit(v, "spk", "emb", 5)
    enrolled = mean_vector(v, "emb", "spk").select(F.col("spk").alias("name"), F.col("mean").alias("emb"), "n")
    names = enrolled.agg(F.collect_list("name").alias("names"))  # one per label
    trials = v.select(F.col("utt").alias("test"), "spk", F.explode(names.scalar()).alias("enroll")).select("enroll", "test", F.when(F.col("enroll") == F.col("spk"), "target").otherwise("nontarget").alias("label"))
    return model.score(trials, enrolled, v, count_sessions=True).withColumn("score", F.round("score", 4))


def m_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after subtraction of the mean, length normalisation, projection to 8 dimensions and normalisation again."""
    v = _vectors(spark, sf_dir)
    chain = B.Chain().fit("mean-subtract | length-norm | lda --dim 8 | length-norm", v, "emb", "spk")
    return chain.apply(v, "emb").select("utt", F.transform("emb", lambda x: F.round(x, 5)).alias("emb"))


def m_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised scores calibrated with the magnitudes and cohort means of both sides."""
    factors = ["score", "enroll_magnitude", "test_magnitude", "enroll_cohort_mean", "test_cohort_mean"]
    rows = _normed(spark, sf_dir)
    w, b = B.fit_calibration(rows, factors)
    score = V.linear_score(V.literal_vector(w), F.array(*(F.col(c).cast("double") for c in factors)), F.lit(b))
    return rows.select("enroll", "test", F.round(score, 5).alias("score"), "label")


def _clustered(method: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.cluster_recordings(_pieces(spark, sf_dir), "reco", "piece", "emb", ["begin", "end", "piece"], method, **options)

    return run


def m_fused_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the fused similarity of a vector's two halves, as if two models had made them."""
    p = _pieces(spark, sf_dir).select("reco", "piece", "begin", "end", F.slice("emb", 1, 64).alias("a"), F.slice("emb", 65, 64).alias("b"))
    return C.cluster_fused(p, "reco", "piece", "a", "b", ["begin", "end", "piece"], threshold=0.5)


def m_refined_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of utt2spk as given clusters; pieces that are alone with theirs are noise that is merged or absorbed."""
    pieces = _pieces(spark, sf_dir)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["begin", "end", "piece"], kind="stable")
        label, count = pd.factorize(pdf["spk"])[0], pdf.groupby("spk")["spk"].transform("size").to_numpy()
        named = C.in_order_of_appearance(label[count > 1]) if (count > 1).any() else np.zeros(0, np.int64)
        start = np.full(len(pdf), -1)
        start[count > 1] = named
        return pd.DataFrame({"reco": pdf["reco"], "piece": pdf["piece"], "label": C.refined(start, np.array(pdf["emb"].tolist(), np.float64)).astype(np.int32)})

    return pieces.groupBy("reco").applyInPandas(run, "reco string, piece string, label int")


def m_combined_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of each speaker joined to at least 5 s."""
    u = table(spark, sf_dir, "utt2spk").where("removed_at is null and spk is not null").select("utt", "spk").distinct()
    return C.combined_utterances(u.join(all_durations(spark, sf_dir), "utt"), "spk", "utt", "dur", 5.0).select("spk", "new_utt", F.size("utts").alias("n"), F.round("dur", 3).alias("dur"))


def m_combined_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances joined to at least 12 s, of the same speaker first, then across speakers that have too little."""
    u = table(spark, sf_dir, "raw_list").where("utt is not null and spk is not null").select("utt", "spk").distinct().join(all_durations(spark, sf_dir), "utt")
    return C.combined_utterances(u, "spk", "utt", "dur", 12.0, across=True).select("spk", "new_utt", F.size("utts").alias("n"), F.round("dur", 3).alias("dur"))


def m_speech_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech by hysteresis over events: each user's values, scaled to 0..1, are the probabilities of successive steps."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("value is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    probs = e.select(F.col("user_id").cast("string").alias("utt"), (F.row_number().over(w) - 1).alias("i"), F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"))
    return speech_stretches(probs)


def m_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 16 values every 8 of each vector, as samples arrive."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(u, i, f) for u, x in zip(pdf["utt"], pdf["emb"]) for i, f in framed([], [float(v) for v in x], 16, 8, 0)[0]]
        return pd.DataFrame(out, columns=["utt", "frame_no", "frame"])

    def each(batches):
        for pdf in batches:
            yield run(pdf)

    frames = _vectors(spark, sf_dir).select("utt", "emb").mapInPandas(each, "utt bigint, frame_no bigint, frame array<double>")
    return frames.select("utt", "frame_no", F.round(V.energy_db(F.col("frame")), 4).alias("energy_db"))


def m_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first registration of each name: users register with the value of each of their events, and only the first counts."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    people = e.select(F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("seq"), F.array(F.col("value")).alias("emb"))
    return registered(people).select("name", "seq", F.get("emb", F.lit(0)).alias("value"))


def m_averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters averaged over the last five checkpoints: each label stands for a parameter, its vectors for the checkpoints."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("spk").orderBy("utt"))
    rows = _vectors(spark, sf_dir).withColumn("checkpoint", place).withColumn("latest", F.max("checkpoint").over(Window.partitionBy("spk")))
    last = rows.where("checkpoint > latest - 5").select("spk", F.posexplode("emb").alias("pos", "x"))
    return B.averaged(last, ["spk", "pos"], "x", 5).select("spk", "pos", F.round("x", 6).alias("x"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("m_")} | {
    "m_hierarchical": _clustered("hierarchical"), "m_hierarchical_absorbed": _clustered("hierarchical", least_size=2), "m_spectral": _clustered("spectral"), "m_resegmented": _clustered("resegmented"),
}

SQL = {
    "m_registry": "SELECT CAST(user_id AS VARCHAR) AS name, min(event_id) AS seq, arg_min(value, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "m_averaged": """WITH r AS (SELECT label AS spk, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM embeddings),
      x AS (SELECT spk, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM r WHERE k <= 5) SELECT spk, CAST(pos AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS x FROM x GROUP BY spk, pos""",
    "m_frames": """WITH f AS (SELECT vec_id AS utt, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, unnest(range(7)) AS frame_no FROM embeddings), x AS (SELECT utt, frame_no, e[frame_no * 8 + 1:frame_no * 8 + 16] AS x FROM f)
      SELECT utt, frame_no, round(10 * log10(list_dot_product(x, x) / 16 + 1e-4), 4) AS energy_db FROM x""",
    "m_speech_stretches": """WITH RECURSIVE p AS (SELECT CAST(user_id AS VARCHAR) AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, least(value / 100, 1.0) AS prob FROM events WHERE value IS NOT NULL),
      n AS (SELECT utt, (max(i) + 1) * 1536 AS total FROM p GROUP BY utt),
      st AS (SELECT utt, CAST(-1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS quiet, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS e FROM n
        UNION ALL SELECT utt, i, CASE WHEN done THEN NULL WHEN prob >= 0.5 THEN coalesce(start, pt) ELSE start END,
          CASE WHEN done OR prob >= 0.5 THEN NULL WHEN prob < 0.35 AND start IS NOT NULL THEN coalesce(quiet, pt) ELSE quiet END,
          CASE WHEN done AND coalesce(quiet, pt) - start > 4000 THEN start END, CASE WHEN done AND coalesce(quiet, pt) - start > 4000 THEN coalesce(quiet, pt) END
        FROM (SELECT st.*, p.i AS j, p.prob, p.i * 1536 AS pt, coalesce(p.prob < 0.35 AND start IS NOT NULL AND p.i * 1536 - coalesce(quiet, p.i * 1536) >= 1600, false) AS done
              FROM st JOIN p ON p.utt = st.utt AND p.i = st.i + 1) AS q(utt, i0, start, quiet, b0, e0, i, prob, pt, done)),
      raw AS (SELECT utt, b, e FROM st WHERE b IS NOT NULL UNION ALL SELECT st.utt, start, total FROM st JOIN n ON n.utt = st.utt AND (st.i + 1) * 1536 = total WHERE start IS NOT NULL),
      w AS (SELECT *, lag(e) OVER o AS pe, lead(b) OVER o AS nb FROM raw WINDOW o AS (PARTITION BY utt ORDER BY b)),
      y AS (SELECT utt, CASE WHEN pe IS NULL THEN greatest(b - 480, 0) WHEN b - pe < 960 THEN greatest(b - (b - pe) // 2, 0) ELSE b END AS b,
        CASE WHEN nb IS NULL THEN least(total, e + 480) WHEN nb - e < 960 THEN e + (nb - e) // 2 ELSE e + 480 END AS e FROM w JOIN n USING (utt))
      SELECT utt, b / 16000.0 AS "begin", e / 16000.0 AS "end" FROM y WHERE (e - b) / 16000.0 >= 0.255""",
}
