"""Diarization: windows over segments, merging of labelled pieces, interval joins, centroids and overlap. Times are whole milliseconds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttermill.functions import vectors as V
from uttermill.functions.times import time_block
from uttermill.operators.verify import mean_vector


def subsegments(segments: DataFrame, window: int = 150, period: int = 75, shift_ms: int = 10) -> DataFrame:
    """Sliding windows of frames over each segment: adds ``begin_frame, end_frame``.

    ``segments`` has ``begin_ms, end_ms``. A segment of at most ``window`` frames is one piece; the last window of a
    longer one ends with it.
    """
    length = F.floor((F.col("end_ms") - F.col("begin_ms")) / shift_ms).cast("int")
    begins = F.when(length <= window, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(length - window + period - 1, F.lit(0)), F.lit(period)))
    out = segments.withColumn("__n", length).withColumn("begin_frame", F.explode(begins))
    return out.withColumn("end_frame", F.when(F.col("__n") <= window, F.col("__n")).otherwise(F.least(F.col("begin_frame") + window, F.col("__n")))).drop("__n")


def sample_windows(segments: DataFrame, window: int = 24_000, period: int = 12_000, rate: int = 16_000, shift_ms: int = 10) -> DataFrame:
    """Sliding windows of samples over each segment: adds ``begin_frame, end_frame, first_sample, n_samples``.

    The twin of :func:`subsegments` for signals: windows are counted in samples, a slice holds one sample more than the
    window, and frame numbers are rounded down from the samples.
    """
    first = F.floor(F.col("begin_ms") * rate / 1_000).cast("bigint")
    n = F.floor(F.col("end_ms") * rate / 1_000).cast("bigint") - first
    begins = F.when(n <= window, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - window + period - 1, F.lit(0)), F.lit(period).cast("bigint")))
    out = segments.withColumn("__n", n).withColumn("__b", F.explode(begins))
    end = F.when(F.col("__n") <= window, F.col("__n")).otherwise(F.least(F.col("__b") + window, F.col("__n")))
    frame = lambda x: F.floor(x * 1_000 / (rate * shift_ms)).cast("int")
    return out.withColumns({"begin_frame": frame(F.col("__b")), "end_frame": frame(end), "first_sample": first + F.col("__b"), "n_samples": end - F.col("__b") + 1}).drop("__n", "__b")


def merged_labels(pieces: DataFrame, utt: str = "utt", order: tuple[str, ...] = ("begin", "end")) -> DataFrame:
    """Consecutive pieces of one label become one turn: ``utt, begin, end, label``.

    Pieces come in the given order. A new turn begins where the label changes or a gap opens; where pieces of two
    labels overlap or touch, both turns meet in the middle of the overlap.
    """
    w = Window.partitionBy(utt).orderBy(*order)
    pe, pl = F.lag("end").over(w), F.lag("label").over(w)
    ordered = pieces.select(utt, *order, *(c for c in ("begin", "end", "label") if c not in order), pe.alias("pe"), pl.alias("pl"))
    fresh = F.col("pe").isNull() | (F.col("begin") > F.col("pe")) | ~F.col("label").eqNullSafe(F.col("pl"))
    start = F.when(F.col("pe").isNull() | (F.col("begin") > F.col("pe")), F.col("begin").cast("double")).otherwise((F.col("begin") + F.col("pe")) / 2)
    marked = ordered.withColumn("fresh", fresh).withColumn("start", F.when(fresh, start)).withColumn("shared", F.col("fresh") & F.col("pe").isNotNull() & (F.col("begin") <= F.col("pe")))
    w2 = Window.partitionBy(utt).orderBy(*order)
    islands = marked.withColumn("island", F.sum(F.col("fresh").cast("int")).over(w2)).withColumn("next_shared", F.lead("shared").over(w2)).withColumn("next_start", F.lead("start").over(w2))
    last = F.max(F.struct(*order, F.when(F.col("next_shared"), F.col("next_start")).otherwise(F.col("end").cast("double")).alias("stop")))
    return islands.groupBy(utt, "island").agg(F.min("start").alias("begin"), last.alias("l"), F.first("label").alias("label")).select(utt, "begin", F.col("l.stop").alias("end"), "label")


def interval_union(intervals: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """Union of overlapping or touching intervals per key, at least so long: ``key, begin, end``."""
    order = Window.partitionBy(key).orderBy("begin", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col("begin") > F.max("end").over(before)).cast("int"), F.lit(1))
    numbered = intervals.where("end > begin").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    return numbered.groupBy(key, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).where(F.col("end") - F.col("begin") >= least).drop("island")


def same_speaker_turns(turns: DataFrame, key: str, tolerance: int = 1) -> DataFrame:
    """A turn joins the one right before it if the speaker is the same and it begins at most ``tolerance`` after its end."""
    order = Window.partitionBy(key).orderBy("begin", "end", "spk")
    runs = turns.withColumn("new_run", F.coalesce((F.col("spk") != F.lag("spk").over(order)).cast("int"), F.lit(1))).withColumn("run", F.sum("new_run").over(order))
    inside = Window.partitionBy(key, "run").orderBy("begin", "end")
    fresh = F.coalesce((F.col("begin") > F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)) + tolerance).cast("int"), F.lit(1))
    numbered = runs.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(inside))
    return numbered.groupBy(key, "run", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("spk").alias("spk")).drop("run", "island")


def median_filtered(rows: DataFrame, key: list[str], order: list[str], flag: str, width: int = 5) -> DataFrame:
    """A flag smoothed by the majority of an odd window; ends are continued with the outermost values."""
    if width % 2 == 0:
        raise ValueError("the window must be odd")
    w = Window.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col(flag).cast("int")
    first, last = F.first(v).over(whole), F.last(v).over(whole)
    total = v
    for k in range(1, width // 2 + 1):
        total = total + F.coalesce(F.lag(v, k).over(w), first) + F.coalesce(F.lead(v, k).over(w), last)
    return rows.withColumn("smooth", total * 2 >= width)


def true_regions(rows: DataFrame, key: list[str], order: list[str], flag: str, least: float = 0.0) -> DataFrame:
    """Runs of rows whose flag holds, from the first begin to the last end: ``key, begin, end, n``."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    runs = rows.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w)).where(F.col(flag))
    out = runs.groupBy(*key, "__run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("end") - F.col("begin") >= least).drop("__run")


def relabelled(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Labels numbered from 0 in the order of their first appearance per key: ``key, label, new_label``."""
    at = F.min(F.struct(*order)).alias("at")
    firsts = rows.groupBy(key, label).agg(at)
    return firsts.select(key, label, (F.row_number().over(Window.partitionBy(key).orderBy("at", label)) - 1).alias("new_label"))


def most_overlapping(pieces: DataFrame, turns: DataFrame, key: str, piece_id: str, bucket_ms: int = 60_000) -> DataFrame:
    """For each piece the turn that overlaps it longest: ``piece_id, spk, overlap_ms``; pieces without overlap give no row.

    ``pieces`` has ``key, piece_id, begin, end``; ``turns`` has ``key, ordinal, begin, end, spk``. Both sides are laid
    into buckets of time and meet on key and bucket, so a recording with many turns is no quadratic group; a pair
    that shares several buckets counts in the one where its overlap begins. Late buckets are longer, so that no stretch,
    however long, spans more than a thousand and a few. Ties go to the lowest ordinal.
    """
    bucket = lambda x: time_block(x, bucket_ms)
    spread = lambda df: df.where("end > begin").withColumn("bucket", F.explode(F.sequence(bucket(F.col("begin")), bucket(F.col("end")))))
    a = spread(pieces.select(key, piece_id, "begin", "end"))
    b = spread(turns.select(key, "ordinal", "begin", "end", "spk")).select(F.col(key).alias("t_key"), F.col("bucket").alias("t_bucket"), "ordinal", F.col("begin").alias("t_begin"), F.col("end").alias("t_end"), "spk")
    met = a.join(b, (F.col(key) == F.col("t_key")) & (F.col("bucket") == F.col("t_bucket")) & (F.col("begin") < F.col("t_end")) & (F.col("t_begin") < F.col("end")))
    met = met.where(bucket(F.greatest("begin", "t_begin")) == F.col("bucket"))
    overlap = F.least("end", "t_end") - F.greatest("begin", "t_begin")
    best = F.max_by(F.struct("spk", overlap.alias("overlap_ms")), F.struct(overlap, -F.col("ordinal")))
    return met.groupBy(piece_id).agg(best.alias("b")).select(piece_id, "b.spk", "b.overlap_ms")


def centroids(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector per group, scaled to length 1: ``keys, centroid, n``."""
    return mean_vector(rows, vector, keys).select(*keys, V.length_normalized(F.col("mean")).alias("centroid"), "n")


def overlap_candidates(rows: DataFrame, key: str, least: float = 0.55, margin: float = 0.35, digits: int = 6) -> DataFrame:
    """Other speakers who may speak in a piece as well: ``piece columns, other, sim, active``.

    ``rows`` has ``key, piece, begin, end, spk, emb``. Each piece meets the centroids of the other speakers of its
    recording; a speaker is active if the similarity is at least ``least`` and at most ``margin`` below that of the
    piece's own speaker. Recordings with one speaker give no rows.
    """
    c = centroids(rows, [key, "spk"], "emb")
    per = c.groupBy(key).agg(F.collect_list(F.struct("spk", "centroid")).alias("people"))  # the speakers of one recording
    sims = rows.join(per.where(F.size("people") > 1), key).select(
        key, "piece", "begin", "end", "spk",
        F.transform("people", lambda p: F.struct(p["spk"].alias("other"), F.round(V.dot(V.length_normalized(F.col("emb")), p["centroid"]), digits).alias("sim"))).alias("s"),
    )
    own = F.filter("s", lambda x: x["other"] == F.col("spk"))[0]["sim"]
    flat = sims.select(key, "piece", "begin", "end", "spk", own.alias("own_sim"), F.explode("s").alias("x"))
    active = (F.col("x.other") != F.col("spk")) & (F.col("x.sim") >= least) & (F.col("own_sim") - F.col("x.sim") <= margin)
    return flat.select(key, "piece", "begin", "end", "spk", F.col("x.other").alias("other"), F.col("x.sim").alias("sim"), active.alias("active"))


def nearest_other_speaker(centres: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """For each speaker of a recording the other one whose centroid is most similar: ``key, spk, other, sim``. Ties go to the smaller name."""
    per = centres.groupBy(key).agg(F.collect_list(F.struct("spk", "centroid")).alias("people"))
    met = centres.join(per.where(F.size("people") > 1), key)
    sims = F.transform(F.filter("people", lambda p: p["spk"] != F.col("spk")), lambda p: F.struct(F.round(V.dot(F.col("centroid"), p["centroid"]), digits).alias("sim"), p["spk"].alias("other")))
    flat = met.select(key, "spk", F.explode(sims).alias("x"))
    w = Window.partitionBy(key, "spk").orderBy(F.desc("x.sim"), "x.other")
    return flat.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "spk", "x.other", "x.sim")


def matched(a: DataFrame, b: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, a, b``: two sets of vectors of the same pieces, which must match one to one.

    A key that is repeated or missing on either side raises an error once the result runs, with the first such key.
    """
    side = lambda df, name: df.groupBy(*keys).agg(F.any_value(vector).alias(name), F.count(F.lit(1)).alias(f"__{name}"))
    both = side(a, "a").join(side(b, "b"), keys, "full")
    fault = F.concat(F.lit("pieces do not match one to one: "), F.concat_ws(" ", *(F.col(k).cast("string") for k in keys)))
    good = (F.coalesce("__a", F.lit(0)) == 1) & (F.coalesce("__b", F.lit(0)) == 1)
    return both.where(F.when(good, F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))).select(*keys, "a", "b")


def assigned(gain: np.ndarray) -> np.ndarray:
    """The column of each row in the one-to-one assignment of greatest total gain; -1 where a row gets none. By shortest augmenting paths."""
    rows, cols = gain.shape
    n = max(rows, cols)
    cost = np.zeros((n, n))
    cost[:rows, :cols] = gain.max(initial=0.0) - gain
    cost[rows:, :] = cost[:, cols:] = gain.max(initial=0.0)
    u, v, owner = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for r in range(n):
        owner[n], at = r, n
        low, came, seen = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while owner[at] >= 0:
            seen[at] = True
            slack = cost[owner[at]] - u[owner[at]] - v[:n]
            better = (slack < low) & ~seen[:n]
            low[better], came[better] = slack[better], at
            open_ = np.where(seen[:n], np.inf, low)
            nxt = int(open_.argmin())
            step = open_[nxt]
            u[owner[seen]] += step
            v[seen] -= step
            low[~seen[:n]] -= step
            at = nxt
        while at != n:
            owner[at] = owner[came[at]]
            at = came[at]
    out = np.full(rows, -1)
    for c in range(cols):
        if owner[c] < rows and gain[owner[c], c] > 0:
            out[owner[c]] = c
    return out


def diarization_error(reference: DataFrame, hypothesis: DataFrame, key: str, collar_ms: int = 250) -> DataFrame:
    """``key, scored_ms, missed_ms, false_ms, confused_ms``: speaker time that a hypothesis gets wrong, per recording.

    Both have ``key, begin, end, spk``. Speakers of both sides are matched one to one so that they speak together
    longest. Time within ``collar_ms`` of a reference turn's edges is not scored. At each instant, speakers that the
    hypothesis lacks are missed, those that it has too many are false, and matched ones that differ are confused.
    Recordings of either side come out; turns that are null, empty or reversed are ignored. A recording's turns are one
    group, whose size its length bounds.
    """
    rows = [df.where(F.col("end") > F.col("begin")).select(F.col(key).alias("k"), F.col("begin").cast("bigint"), F.col("end").cast("bigint"), F.col("spk").cast("string"), F.lit(side).alias("side")) for df, side in ((reference, 0), (hypothesis, 1))]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        ref, hyp = (pdf[pdf["side"] == i] for i in (0, 1))
        edges = np.unique(np.r_[ref["begin"], ref["end"]]) if len(ref) else np.zeros(0, np.int64)
        cuts = np.unique(np.r_[pdf["begin"], pdf["end"], edges - collar_ms, edges + collar_ms])
        length = np.diff(cuts)
        near = np.zeros(len(cuts), np.int64)
        np.add.at(near, np.searchsorted(cuts, edges - collar_ms), 1)
        np.add.at(near, np.searchsorted(cuts, edges + collar_ms), -1)
        scored = length * (np.cumsum(near)[:-1] == 0)

        def active(side: pd.DataFrame) -> np.ndarray:
            who, name = pd.factorize(side["spk"], sort=True)
            on = np.zeros((len(name), len(cuts)), np.int64)
            np.add.at(on, (who, np.searchsorted(cuts, side["begin"])), 1)
            np.add.at(on, (who, np.searchsorted(cuts, side["end"])), -1)
            return np.cumsum(on, axis=1)[:, :-1] > 0

        r, h = active(ref), active(hyp)
        to = assigned((r * scored) @ h.T.astype(np.float64)) if len(r) and len(h) else np.full(len(r), -1)
        n_ref, n_hyp = r.sum(0), h.sum(0)
        right = sum((r[i] & h[c] for i, c in enumerate(to) if c >= 0), np.zeros(len(length), np.int64))
        of = lambda x: int((scored * x).sum())
        return pd.DataFrame({key: [pdf["k"].iloc[0]], "scored_ms": [of(n_ref)], "missed_ms": [of(np.maximum(n_ref - n_hyp, 0))], "false_ms": [of(np.maximum(n_hyp - n_ref, 0))], "confused_ms": [of(np.minimum(n_ref, n_hyp) - right)]})

    kind = dict(reference.dtypes)[key]
    return rows[0].unionAll(rows[1]).groupBy("k").applyInPandas(score, f"`{key}` {kind}, scored_ms bigint, missed_ms bigint, false_ms bigint, confused_ms bigint")


def rttm_line(utt: Column, begin_s: Column, dur_s: Column, spk: Column, channel: int = 1) -> Column:
    """A speaker turn as a line of an RTTM file."""
    return F.format_string("SPEAKER %s %d %.3f %.3f <NA> <NA> %s <NA> <NA>", utt, F.lit(channel), begin_s, dur_s, spk)


def segment_id(utt: Column, begin_ms: Column, end_ms: Column) -> Column:
    return F.format_string("%s-%08d-%08d", utt, begin_ms, end_ms)
