import numpy as np
import pytest
from pyspark.sql import functions as F

from uttermill.operators import backend as B


def _data(spark, n=300, k=12, d=5, seed=0):
    rng = np.random.default_rng(seed)
    c = 2 * rng.standard_normal((k, d))
    y = rng.integers(k, size=n)
    x = c[y] + rng.standard_normal((n, d)) * np.arange(1, d + 1) / d
    return x, y, spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "spk int, emb array<double>")


def test_fit_equals_a_loop_over_classes(spark):
    x, y, df = _data(spark)
    d = x.shape[1]
    groups = [x[y == k] for k in np.unique(y)]
    mu = np.mean([g.mean(0) for g in groups], axis=0)
    scatter = sum((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups)
    b, w = np.eye(d), np.eye(d)
    for _ in range(4):
        bs, ws = np.zeros((d, d)), scatter.copy()
        for g in groups:
            n, m = len(g), g.mean(0) - mu
            v = np.linalg.inv(np.linalg.inv(b) + n * np.linalg.inv(w))
            h = v @ (n * np.linalg.inv(w) @ m)
            bs += v + np.outer(h, h)
            ws += n * (v + np.outer(m - h, m - h))
        b, w = bs / len(groups), ws / len(x)
    model = B.TwoCovariance.fit(df, "spk", "emb", 4)
    assert model.mu == pytest.approx(mu)
    assert model.transform @ w @ model.transform.T == pytest.approx(np.eye(d), abs=1e-8)
    assert model.transform @ b @ model.transform.T == pytest.approx(np.diag(model.psi), abs=1e-8)


def test_scores_tell_speakers_apart_and_models_round_trip(spark, tmp_path):
    x, y, df = _data(spark)
    model = B.TwoCovariance.fit(df, "spk", "emb", 5)
    model.save(spark, f"file://{tmp_path}/m")
    again = B.TwoCovariance.load(spark, f"file://{tmp_path}/m")
    assert again.transform == pytest.approx(model.transform)
    v = df.withColumn("utt", F.monotonically_increasing_id()).limit(40)
    rows = v.collect()
    trials = spark.createDataFrame([(a["utt"], b["utt"], "target" if a["spk"] == b["spk"] else "nontarget") for a in rows for b in rows if a["utt"] != b["utt"]], "enroll bigint, test bigint, label string")
    v = spark.createDataFrame(rows)
    got = again.score(trials, v.select(F.col("utt").alias("name"), "emb", F.lit(1).alias("n")), v).groupBy("label").agg(F.avg("score").alias("s")).collect()
    s = {r["label"]: r["s"] for r in got}
    assert s["target"] > s["nontarget"] + 1
    assert model.adapted(df, "emb").psi.shape == model.psi.shape


def test_discriminant_whitens_within(spark):
    x, y, df = _data(spark)
    mean, p = B.discriminant(df, "spk", "emb", 3)
    z = (x - mean) @ p
    within = sum((z[y == k] - z[y == k].mean(0)).T @ (z[y == k] - z[y == k].mean(0)) for k in np.unique(y)) / len(x)
    assert within == pytest.approx(np.eye(3), abs=1e-8)


def test_chain(spark):
    assert B.Chain.parse("mean-subtract --scp a | length-norm | lda --scp b --utt2spk c --dim 100 | length-norm") == [
        ("mean-subtract", {"scp": "a"}), ("length-norm", {}), ("lda", {"scp": "b", "utt2spk": "c", "dim": "100"}), ("length-norm", {}),
    ]
    x, y, df = _data(spark)
    chain = B.Chain().fit("mean-subtract | length-norm | lda --dim 2", df, "emb", "spk")
    again = B.Chain.from_json(chain.to_json())
    u = x - x.mean(0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = np.array([r["emb"] for r in again.apply(df, "emb").collect()])
    link = chain.links[-1]
    assert got == pytest.approx((u - np.array(link["mean"])) @ np.array(link["rows"]).T)
    assert len(chain.refit(0, "mean-subtract", df, "emb").links) == 3
    for bad in ("whiten", "lda | | x", "lda --dim"):
        with pytest.raises(ValueError):
            B.Chain().fit(bad, df, "emb", "spk")


def test_calibration_reaches_the_optimum(spark):
    rng = np.random.default_rng(1)
    t = rng.random(800) < 0.2
    x = np.c_[rng.standard_normal(800) + 1.5 * t, rng.standard_normal(800)]
    df = spark.createDataFrame([("target" if a else "nontarget", *map(float, b)) for a, b in zip(t, x)], "label string, a double, b double")
    w, b = B.fit_calibration(df, ["a", "b"])
    s = x @ w + b
    p = np.where(t, -1 / (1 + np.exp(s)) / t.sum(), 1 / (1 + np.exp(-s)) / (~t).sum())
    assert np.c_[x, np.ones(800)].T @ p == pytest.approx(np.zeros(3), abs=1e-4)
    with pytest.raises(ValueError):
        B.fit_calibration(df.where("label = 'target'"), ["a"])


@pytest.mark.parametrize("normalize,subtract", [(True, False), (False, True), (True, True)])
def test_flags_of_the_model(spark, normalize, subtract):
    """Vectors less the mean of all of them, labelled or not, and scaled, give the model that fitting them so would."""
    x, y, df = _data(spark)
    df = df.unionAll(spark.createDataFrame([(None, [9.0, -5.0, 3.0, 1.0, 2.0])] * 40, df.schema))
    everything = np.r_[x, np.tile([9.0, -5.0, 3.0, 1.0, 2.0], (40, 1))]
    z = x - everything.mean(0) if subtract else x
    z = z * np.sqrt(5) / np.linalg.norm(z, axis=1, keepdims=True) if normalize else z
    ready = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, z)], "spk int, emb array<double>")
    want, got = B.TwoCovariance.fit(ready, "spk", "emb", 3), B.TwoCovariance.fit(df, "spk", "emb", 3, normalize, subtract)
    assert got.mu == pytest.approx(want.mu) and got.psi == pytest.approx(want.psi) and got.normalize_length == normalize
    out = np.array([r["t"] for r in spark.createDataFrame([(x[0].tolist(),)], "emb array<double>").select(got.transformed(F.col("emb")).alias("t")).collect()][0])
    plain = got.transform @ (z[0] - got.mu)
    assert out == pytest.approx(plain * np.sqrt(5) / np.linalg.norm(plain) if normalize else plain)
    assert (np.linalg.norm(out) == pytest.approx(np.sqrt(5))) == normalize


def test_moments_over_many_tasks(spark):
    x = np.random.default_rng(2).standard_normal((500, 4))
    df = spark.createDataFrame([(b.tolist(), float(i % 3)) for i, b in enumerate(x)] + [(None, 1.0)], "emb array<double>, w double").repartition(90)
    n, first, second = B.second_moments(df, "emb", "w")
    w = np.arange(500) % 3
    assert n == w.sum() and first == pytest.approx(w @ x) and second == pytest.approx((x * w[:, None]).T @ x)
    with pytest.raises(ValueError):
        B.second_moments(df.limit(0), "emb")


def test_checkpoints_must_be_complete(spark):
    df = spark.createDataFrame([("w", 0, 1.0), ("w", 0, 3.0), ("b", 0, 5.0), ("b", 0, 7.0)], "name string, pos int, x double")
    assert {r["name"]: r["x"] for r in B.averaged(df, ["name", "pos"], "x", 2).collect()} == {"w": 2.0, "b": 6.0}
    with pytest.raises(Exception, match="2 checkpoints"):
        B.averaged(df.where("x > 1"), ["name", "pos"], "x", 2).collect()
