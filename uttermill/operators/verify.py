"""Verification: scoring of trials, means, cohort normalisation, detection curves and costs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttermill.functions import vectors as V
from uttermill.functions.running import running_sums
from uttermill.functions.storage import written
from uttermill.operators.products import all_products, top_products


def mean_vector(df: DataFrame, vector: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Mean vector of all rows, or of each group: ``[by,] mean ARRAY<DOUBLE>, n``.

    Each batch of rows is summed where it is read, by position; missing elements do not count. What is shuffled are
    sums of batches, not vectors.
    """
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    rows = df.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("__x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("__x").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size[size > 0]):
                part = b.filter(pa.array(size == d)) if (size != d).any() else b
                x = part.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                code = np.zeros(part.num_rows, np.int64)
                for k in keys:
                    own = part.column(k).dictionary_encode(null_encoding="encode")
                    code = code * (len(own.dictionary) + 1) + own.indices.to_numpy()
                _, first, group = np.unique(code, return_index=True, return_inverse=True)
                order = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(len(first)))
                known = np.isfinite(x) | np.isinf(x)
                total = np.add.reduceat(np.where(known, x, 0.0)[order], cuts, axis=0)
                count = np.add.reduceat(known.astype(np.int64)[order], cuts, axis=0)
                at = pa.array(first)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in keys), pa.array(list(total), pa.list_(pa.float64())), pa.array(list(count), pa.list_(pa.int64()))], names=[*keys, "s", "c"])

    kinds = dict(df.dtypes)
    partial = rows.mapInArrow(sums, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "s array<double>", "c array<bigint>"]))
    flat = partial.select(*keys, F.posexplode(F.arrays_zip("s", "c")).alias("pos", "z"))
    per = flat.groupBy(*keys, "pos").agg(F.sum("z.c").alias("n"), F.try_divide(F.sum("z.s"), F.sum("z.c")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return per.groupBy(*keys).agg(ordered.alias("mean"), F.max("n").alias("n"))


def score_trials(trials: DataFrame, vectors: DataFrame, on_missing: str = "drop", score: Column | None = None) -> DataFrame:
    """``enroll, test, label`` joined twice with ``utt, emb``, with the cosine as ``score``.

    Trials of an utterance without a vector are dropped, or raise with ``on_missing='error'`` once the result runs.
    """
    if on_missing not in ("drop", "error"):
        raise ValueError("on_missing must be drop or error")
    how = "inner" if on_missing == "drop" else "left"
    e = vectors.select(F.col("utt").alias("enroll"), F.col("emb").alias("e_emb"))
    t = vectors.select(F.col("utt").alias("test"), F.col("emb").alias("t_emb"))
    both = trials.join(e, "enroll", how).join(t, "test", how)
    value = V.cosine(F.col("e_emb"), F.col("t_emb")) if score is None else score
    if on_missing == "error":
        value = F.when(F.col("e_emb").isNull() | F.col("t_emb").isNull(), F.raise_error(F.lit("a trial names an utterance without a vector")).cast("double")).otherwise(value)
    return both.select("enroll", "test", value.alias("score"), "label")


def missing_ids(trials: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids of either side of the trials that have no vector, with the trials that they cost."""
    ids = trials.select(F.explode(F.array("enroll", "test")).alias("utt")).groupBy("utt").agg(F.count(F.lit(1)).alias("n_trials"))
    return ids.join(vectors.select("utt"), "utt", "left_anti")


def cohort_statistics(vectors: DataFrame, cohort: DataFrame, top_n: int | None) -> DataFrame:
    """Mean and population deviation of each vector's ``top_n`` cosines with the cohort (all of them if None).

    ``vectors`` has ``utt, emb``; ``cohort`` has ``emb``, of any size: vectors meet it block by block, and of each block
    only the best cosines leave. Returns ``utt, magnitude, cohort_mean, cohort_std``.
    """
    others = cohort.select(F.monotonically_increasing_id().alias("id"), "emb")
    if top_n is None:
        stats = all_products(vectors, "utt", "emb", others, "id", "emb").select("utt", F.col("mean").alias("cohort_mean"), F.col("deviation").alias("cohort_std"))
    else:
        top = F.transform("top", lambda t: -t["fall"])
        n = F.size("top").cast("double")
        total = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda s, x: s + x)
        best = top_products(vectors, "utt", "emb", others, "id", "emb", top_n).select("utt", top.alias("x"), n.alias("n")).withColumn("cohort_mean", total(lambda x: x) / F.col("n"))
        stats = best.select("utt", "cohort_mean", F.sqrt(total(lambda x: (x - F.col("cohort_mean")) * (x - F.col("cohort_mean"))) / F.col("n")).alias("cohort_std"))
    return vectors.select("utt", V.norm(F.col("emb")).alias("magnitude")).join(stats, "utt")


def normalized_scores(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Symmetric score normalisation: half the sum of both sides' standardised scores, with the four side values."""
    side = lambda name, p: stats.select(F.col("utt").alias(name), *(F.col(c).alias(f"{p}_{c}") for c in ("magnitude", "cohort_mean", "cohort_std")))
    both = scores.join(side("enroll", "enroll"), "enroll").join(side("test", "test"), "test")
    s = lambda p: (F.col("score") - F.col(f"{p}_cohort_mean")) / F.col(f"{p}_cohort_std")
    return both.select("enroll", "test", (0.5 * (s("enroll") + s("test"))).alias("score"), "label", "enroll_magnitude", "test_magnitude", "enroll_cohort_mean", "test_cohort_mean")


def calibration_factors(normed: DataFrame, durations: DataFrame | None = None, max_duration: float | None = None) -> DataFrame:
    """Score with minimum, maximum, difference and ratio of both sides' magnitudes and cohort means, and of durations if given."""
    out, pairs = normed, [("magnitude", "enroll_magnitude", "test_magnitude"), ("cohort", "enroll_cohort_mean", "test_cohort_mean")]
    if durations is not None:
        d = F.col("dur") if max_duration is None else F.least("dur", F.lit(max_duration))
        for name in ("enroll", "test"):
            out = out.join(durations.select(F.col("utt").alias(name), d.alias(f"{name}_dur")), name)
        pairs.insert(0, ("duration", "enroll_dur", "test_dur"))
    cols = [c.alias(f"{n}_{k}") for n, a, b in pairs for k, c in zip(("min", "max", "diff", "ratio"), V.score_factors(F.col(a), F.col(b)))]
    return out.select("enroll", "test", "label", "score", *cols)


def detection_curve(scores: DataFrame) -> DataFrame:
    """Miss and false-alarm rate at each score, in rising order: ``score, enroll, test, n, fnr, fpr``.

    The row itself counts as missed or rejected. Equal scores go by enrolment and test id.
    """
    is_target = (F.col("label") == "target").cast("bigint")
    totals = running_sums(
        scores.where(F.col("score").isNotNull()), ["score", "enroll", "test"], {"targets": is_target, "others": 1 - is_target, "n": F.lit(1).cast("bigint")}
    )
    return totals.select(
        "score", "enroll", "test", "n", F.try_divide(F.col("targets"), F.col("targets_all")).alias("fnr"), (1 - F.try_divide(F.col("others"), F.col("others_all"))).alias("fpr")
    )


def equal_error_rate(curve: DataFrame) -> DataFrame:
    """``eer, threshold``: where both rates meet, between the first row at or above and the last row below."""
    diff = F.col("fnr") - F.col("fpr")
    at = curve.agg(
        F.min(F.when(diff >= 0, F.struct("n", "fnr", "fpr", "score"))).alias("hi"), F.max(F.when(diff < 0, F.struct("n", "fnr", "fpr", "score"))).alias("lo")
    )
    h, lo = F.col("hi"), F.col("lo")
    a = (h["fnr"] - h["fpr"]) / ((lo["fpr"] - h["fpr"]) - (lo["fnr"] - h["fnr"]))
    return at.select((h["fnr"] + a * (lo["fnr"] - h["fnr"])).alias("eer"), h["score"].alias("threshold"))


def equal_error_rate_of_scores(scores: DataFrame) -> DataFrame:
    """What :func:`equal_error_rate` says of the curve of all trials, without sorting them all.

    Trials are counted per score first, so running sums go over distinct scores. Within one score the rows go by
    enrolment and test id; only the score in which the rates cross is looked at row by row.
    """
    known = scores.where(F.col("score").isNotNull()).select("score", "enroll", "test", (F.col("label") == "target").cast("bigint").alias("t"))
    per = known.groupBy("score").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    run = written(running_sums(per, ["score"], {"t_upto": F.col("t"), "n_upto": F.col("n")}), "rates")
    fnr, fpr = F.col("t_upto") / F.col("t_upto_all"), 1 - (F.col("n_upto") - F.col("t_upto")) / (F.col("n_upto_all") - F.col("t_upto_all"))
    # The rates only approach each other as the score rises, so the crossing lies in the first score at whose end it is passed.
    passed = run.where(fnr - fpr >= 0).agg(F.min("score").alias("score"))
    at = run.join(passed, "score").select(F.struct("score", (F.col("t_upto") - F.col("t")).alias("t0"), (F.col("n_upto") - F.col("n")).alias("n0"), F.col("t_upto_all").alias("ta"), F.col("n_upto_all").alias("na")).alias("at"))
    rows = running_sums(known.withColumn("at", at.scalar()).where("score = at.score"), ["enroll", "test"], {"i": F.lit(1).cast("bigint"), "hits": F.col("t")})
    n, t = F.col("at.n0") + F.col("i"), F.col("at.t0") + F.col("hits")
    rate = lambda n, t: (t / F.col("at.ta"), 1 - (n - t) / (F.col("at.na") - F.col("at.ta")))
    near = rows.select("score", "t", "at", n.alias("n"), t.alias("upto"))
    hi = near.withColumns(dict(zip(("fnr", "fpr"), rate(F.col("n"), F.col("upto"))))).where("fnr - fpr >= 0")
    first = hi.agg(F.min(F.struct("n", "upto", "t", "score", "fnr", "fpr", "at")).alias("h")).select("h.*")
    low_fnr, low_fpr = rate(F.col("n") - 1, F.col("upto") - F.col("t"))
    both = first.select("score", "fnr", "fpr", low_fnr.alias("l_fnr"), low_fpr.alias("l_fpr"))
    a = (F.col("fnr") - F.col("fpr")) / ((F.col("l_fpr") - F.col("fpr")) - (F.col("l_fnr") - F.col("fnr")))
    return both.select((F.col("fnr") + a * (F.col("l_fnr") - F.col("fnr"))).alias("eer"), F.col("score").alias("threshold"))


def minimum_cost(curve: DataFrame, p_target: float, c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    """``min_cost``: the smallest detection cost over all thresholds, against that of deciding blindly."""
    cost = c_miss * p_target * F.col("fnr") + c_fa * (1 - p_target) * F.col("fpr")
    return curve.agg((F.min(cost) / min(c_miss * p_target, c_fa * (1 - p_target))).alias("min_cost"))


def simple_equal_error_rate(scores: DataFrame) -> DataFrame:
    """Over distinct scores as thresholds, the mean of both rates where they differ least (first of equals).

    False accepts are impostors at or above the threshold, false rejects are targets below it.
    """
    per = scores.groupBy("score").agg(F.count_if(F.col("label") == "target").alias("t"), F.count_if(F.col("label") != "target").alias("i"))
    run = running_sums(per, ["score"], {"t_upto": F.col("t"), "i_upto": F.col("i")})
    frr, far = (F.col("t_upto") - F.col("t")) / F.col("t_upto_all"), (F.col("i_upto_all") - F.col("i_upto") + F.col("i")) / F.col("i_upto_all")
    best = run.select(F.struct(F.abs(far - frr).alias("d"), "score", far.alias("far"), frr.alias("frr")).alias("x")).agg(F.min("x").alias("x"))
    return best.select(((F.col("x.far") + F.col("x.frr")) / 2).alias("eer"), F.col("x.score").alias("threshold"))


def log_likelihood_cost(scores: DataFrame) -> DataFrame:
    """``cllr``: mean cost in bits of target and other scores taken as log-likelihood ratios."""
    t = F.avg(F.when(F.col("label") == "target", F.log1p(F.exp(-F.col("score")))))
    o = F.avg(F.when(F.col("label") != "target", F.log1p(F.exp(F.col("score")))))
    return scores.agg(((t + o) / 2 / F.ln(F.lit(2.0))).alias("cllr"))


def equalized_weights(scores: DataFrame, condition: str) -> DataFrame:
    """Each condition's targets weighted to the largest number of targets of any condition; 0 where it has none."""
    per = scores.groupBy(condition).agg(F.count_if(F.col("label") == "target").alias("n_targets"), F.count(F.lit(1)).alias("n"))
    most = F.max("n_targets").over(Window.partitionBy(F.lit(1)))  # one row per condition
    return per.select(condition, "n", "n_targets", F.when(F.col("n_targets") > 0, most / F.col("n_targets")).otherwise(0.0).alias("weight"))


def score_histogram(scores: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of equal width and their normalised running sum. The top edge belongs to the last bin; scores outside are left out."""
    inside = scores.where((F.col("score") >= low) & (F.col("score") <= high))
    bin_no = F.least(F.floor((F.col("score") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    per = inside.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bin")  # at most `bins` rows
    whole = Window.partitionBy(F.lit(1))
    return per.select("bin", "n", (F.sum("n").over(order) / F.sum("n").over(whole)).alias("cumulative"))


def binned_curve(scores: DataFrame, edges: int = 1_000_000) -> DataFrame:
    """``bin, threshold, fnr, fpr`` at evenly spaced thresholds between the smallest and the largest score, for bins that hold scores.

    As many edges bound one bin less; the top edge belongs to the last one. The rates count all scores up to the bin's end.
    """
    known = scores.where(F.col("score").isNotNull())
    span = known.agg(F.struct(F.min("score").alias("low"), F.max("score").alias("high")).alias("s")).scalar()
    width = (F.col("s.high") - F.col("s.low")) / (edges - 1)
    at = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("s.low")) / width), F.lit(edges - 2))).otherwise(F.lit(0)).cast("bigint")
    rows = known.select("score", "label", span.alias("s")).select(at.alias("bin"), (F.col("s.low") + (at + 1) * width).alias("threshold"), (F.col("label") == "target").alias("t"))
    per = rows.groupBy("bin").agg(F.min("threshold").alias("threshold"), F.count_if("t").alias("t"), F.count_if(~F.col("t")).alias("i"))
    run = running_sums(per, ["bin"], {"t_upto": F.col("t"), "i_upto": F.col("i")})
    return run.select("bin", "threshold", F.try_divide(F.col("t_upto"), F.col("t_upto_all")).alias("fnr"), (1 - F.try_divide(F.col("i_upto"), F.col("i_upto_all"))).alias("fpr"))


def detection_report(scores: DataFrame, prefix: int = 7) -> DataFrame:
    """``eer_percent, threshold, dcf08, dcf10, c_primary`` of trials whose ids tell the speaker by their first characters."""
    same = F.substring("enroll", 1, prefix) == F.substring("test", 1, prefix)
    curve = written(detection_curve(scores.withColumn("label", F.when(same, "target").otherwise("nontarget"))), "curve")
    costs = [minimum_cost(curve, p).select(F.col("min_cost").alias(f"c{i}")) for i, p in enumerate((0.01, 0.001, 0.005))]
    eer = equal_error_rate(curve)
    one = [F.col("c0"), costs[1].scalar(), costs[2].scalar(), eer.select(F.struct("eer", "threshold").alias("e")).scalar()]
    rows = costs[0].select(one[0].alias("a"), one[1].alias("b"), one[2].alias("c"), one[3].alias("e"))
    return rows.select((F.col("e.eer") * 100).alias("eer_percent"), F.col("e.threshold").alias("threshold"), F.col("a").alias("dcf08"), F.col("b").alias("dcf10"), ((F.col("a") + F.col("c")) / 2).alias("c_primary"))


def best_enrolled(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """The most similar enrolled name of each query: ``utt, name, score``.

    ``queries`` has ``utt, emb``; ``registry`` has ``name, emb, ordinal``, of any size: queries meet it block by block.
    The first registration of a name counts; the first enrolled wins ties; no score above 0 gives an empty name.
    """
    first = registry.groupBy("name").agg(F.min(F.struct("ordinal", "emb")).alias("r")).select("name", "r.ordinal", "r.emb")
    best = top_products(queries, "utt", "emb", first, "ordinal", "emb", 1).select("utt", F.get("top", F.lit(0)).alias("t"))
    scored = queries.select("utt").join(best, "utt", "left").select("utt", F.col("t.id").alias("ordinal"), ((1 - F.col("t.fall")) / 2).alias("score"))
    named = scored.join(first.select("ordinal", "name"), "ordinal", "left")
    good = F.col("score") > 0
    return named.select("utt", F.when(good, F.col("name")).otherwise("").alias("name"), F.when(good, F.col("score")).otherwise(0.0).alias("score"))
