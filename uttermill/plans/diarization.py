"""Diarization queries: segments with the speakers of utt2spk are the turns, usable vectors the pieces' embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from uttermill.functions import vectors as V
from uttermill.functions.storage import table
from uttermill.operators import diar as O

_OK = "removed_at is null and begin_sec >= 0 and end_sec > begin_sec"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live segments, one row each: ``seg, reco, begin, end`` in milliseconds."""
    s = table(spark, sf_dir, "segments").where(_OK)
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return s.groupBy("seg", "reco").agg(F.min(ms("begin_sec")).alias("begin"), F.max(ms("end_sec")).alias("end"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "utt2spk").where("removed_at is null and spk is not null").groupBy("utt").agg(F.min("spk").alias("spk"))
    return _segments(spark, sf_dir).join(u, F.col("seg") == F.col("utt")).select("reco", "seg", "begin", "end", "spk")


def d_subsegments(spark, sf_dir):
    s = _segments(spark, sf_dir).select("seg", F.col("begin").alias("begin_ms"), F.col("end").alias("end_ms"))
    return O.subsegments(s).select("seg", "begin_frame", "end_frame")


def d_merged_labels(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumnRenamed("spk", "label")
    return O.merged_labels(t, "reco", ("begin", "end", "seg"))


def d_interval_union(spark, sf_dir):
    return O.interval_union(_segments(spark, sf_dir), "reco", 255)


def d_same_speaker_turns(spark, sf_dir):
    return O.same_speaker_turns(_turns(spark, sf_dir).select("reco", "begin", "end", "spk"), "reco")


def _flags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", at.alias("begin"), (at + 1_000_000).alias("end"), (F.col("value") > 50).alias("loud"))


def d_median_filter(spark, sf_dir):
    return O.median_filtered(_flags(spark, sf_dir), ["user_id"], ["begin", "event_id"], "loud").select("event_id", "smooth")


def d_true_regions(spark, sf_dir):
    s = O.median_filtered(_flags(spark, sf_dir), ["user_id"], ["begin", "event_id"], "loud", 3)
    return O.true_regions(s, ["user_id"], ["begin", "event_id"], "smooth")


def d_relabelled(spark, sf_dir):
    return O.relabelled(_turns(spark, sf_dir), "reco", ["begin", "end", "seg"], "spk")


def d_most_overlapping(spark, sf_dir):
    """The speaker of each piece by longest overlap with other turns of its recording: pieces are the windows of segments."""
    s = _segments(spark, sf_dir).select("seg", "reco", F.col("begin").alias("begin_ms"), F.col("end").alias("end_ms"))
    p = O.subsegments(s)
    p = p.select("reco", F.concat_ws("#", "seg", "begin_frame").alias("piece"), (F.col("begin_ms") + F.col("begin_frame") * 10).alias("begin"), (F.col("begin_ms") + F.col("end_frame") * 10).alias("end"))
    t = _turns(spark, sf_dir)

    t = t.withColumn("ordinal", F.row_number().over(Window.partitionBy("reco").orderBy("begin", "end", "seg")))
    return O.most_overlapping(p, t, "reco", "piece")


def d_most_overlapping_parent(spark, sf_dir):
    """The speaker of each window by the longest overlap of the whole segment that it comes from."""
    s = _segments(spark, sf_dir).select("seg", "reco", F.col("begin").alias("begin_ms"), F.col("end").alias("end_ms"))
    p = O.subsegments(s).select("reco", F.concat_ws("#", "seg", "begin_frame").alias("piece"), F.col("begin_ms").alias("begin"), F.col("end_ms").alias("end"))
    t = _turns(spark, sf_dir)
    t = t.withColumn("ordinal", F.row_number().over(Window.partitionBy("reco").orderBy("begin", "end", "seg")))
    return O.most_overlapping(p, t, "reco", "piece")


def d_sample_windows(spark, sf_dir):
    s = _segments(spark, sf_dir).select("seg", F.col("begin").alias("begin_ms"), F.col("end").alias("end_ms"))
    return O.sample_windows(s).select("seg", "begin_frame", "end_frame", "first_sample", "n_samples")


def d_sorted_turns(spark, sf_dir):
    """Turns with their place in the order of begin times."""
    place = F.row_number().over(Window.partitionBy("reco").orderBy("begin", "end", "seg"))
    return _turns(spark, sf_dir).select("reco", "begin", "end", "spk", place.alias("place"))


def _pieces(spark, sf_dir):
    e = table(spark, sf_dir, "utt_embeddings").where("size(emb) = 128 and forall(emb, x -> x is not null and not isnan(x) and abs(x) < 1e30) and exists(emb, x -> x <> 0)")
    e = e.groupBy("utt_name").agg(F.max_by("emb", "loaded_at").alias("emb"))
    return _turns(spark, sf_dir).join(e, F.col("seg") == F.col("utt_name")).select("reco", F.col("seg").alias("piece"), "begin", "end", "spk", "emb")


def d_grouped_pieces(spark, sf_dir):
    """The pieces of each recording that have embeddings, in order, as the lists that clustering reads."""
    lists = _pieces(spark, sf_dir).groupBy("reco").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "piece", F.transform("emb", lambda x: x.cast("double")).alias("emb")))).alias("p"))
    first = F.get("p", F.lit(0))
    return lists.select("reco", F.size("p").alias("n"), F.md5(F.array_join(F.transform("p", lambda x: x["piece"]), " ").cast("binary")).alias("digest"), F.round(F.get(first["emb"], F.lit(0)), 6).alias("first_value"))


def d_speaker_centroids(spark, sf_dir):
    c = O.centroids(_pieces(spark, sf_dir), ["reco", "spk"], "emb")
    return c.select("reco", "spk", "n", F.posexplode("centroid").alias("pos", "x")).select("reco", "spk", "n", "pos", F.round("x", 6).alias("x"))


def d_overlap_candidates(spark, sf_dir):
    return O.overlap_candidates(_pieces(spark, sf_dir), "reco").select("piece", "other", F.round("sim", 5).alias("sim"))


def d_overlap_regions(spark, sf_dir):
    """Regions in which another speaker is active too, after smoothing."""
    c = O.overlap_candidates(_pieces(spark, sf_dir), "reco", 0.05, 0.95, 4)
    s = O.median_filtered(c, ["reco", "other"], ["begin", "end", "piece"], "active", 3)
    return O.true_regions(s, ["reco", "other"], ["begin", "end", "piece"], "smooth", 100)


def d_nearest_other_speaker(spark, sf_dir):
    c = O.centroids(_pieces(spark, sf_dir), ["reco", "spk"], "emb")
    return O.nearest_other_speaker(c, "reco", 5)


def d_turns_with_overlap(spark, sf_dir):
    """The turns, and the regions in which another speaker is active too, as turns of that one."""
    more = d_overlap_regions(spark, sf_dir).select("reco", "begin", "end", F.col("other").alias("spk"))
    return _turns(spark, sf_dir).select("reco", "begin", "end", "spk").unionAll(more)


def d_matched(spark, sf_dir):
    """Two embeddings of the same pieces, here the halves of one, matched by piece and times."""
    keys = ["piece", "begin", "end"]
    p = _pieces(spark, sf_dir)
    m = O.matched(p.select(*keys, F.slice("emb", 1, 64).alias("emb")), p.select(*keys, F.slice("emb", 65, 64).alias("emb")), keys, "emb")
    scaled = lambda c: F.round(V.dot(F.col(c), F.col(c)), 3)
    return m.select("piece", "begin", "end", scaled("a").alias("a"), scaled("b").alias("b"))


def d_error(spark, sf_dir):
    """Turns joined over speakers' short breaks, with two speakers taken for one, against the turns."""
    said = O.same_speaker_turns(_turns(spark, sf_dir).select("reco", "begin", "end", F.substring("spk", 1, 9).alias("spk")), "reco", 400)
    return O.diarization_error(_turns(spark, sf_dir), said, "reco")


def d_rttm_lines(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return t.select(O.rttm_line(F.col("reco"), F.col("begin") / 1000.0, (F.col("end") - F.col("begin")) / 1000.0, F.col("spk")).alias("line"))


def d_segment_ids(spark, sf_dir):
    return _segments(spark, sf_dir).select("seg", O.segment_id(F.col("reco"), F.col("begin"), F.col("end")).alias("written"))


_S = """s AS (SELECT seg, reco, min(CAST(round(begin_sec * 1000) AS BIGINT)) AS b, max(CAST(round(end_sec * 1000) AS BIGINT)) AS e
  FROM segments WHERE removed_at IS NULL AND begin_sec >= 0 AND end_sec > begin_sec GROUP BY seg, reco)"""
_T = f"""{_S}, t AS (SELECT s.*, spk FROM s JOIN (SELECT utt, min(spk) AS spk FROM utt2spk WHERE removed_at IS NULL AND spk IS NOT NULL GROUP BY utt) u ON u.utt = s.seg)"""
_P = """p AS (SELECT seg, reco, b, e, (e - b) // 10 AS n FROM s),
  w AS (SELECT seg, reco, b, 0 AS f0, n AS f1 FROM p WHERE n <= 150 UNION ALL SELECT seg, reco, b, f0, least(f0 + 150, n) FROM (SELECT *, unnest(range(0, n - 150 + 75, 75)) AS f0 FROM p WHERE n > 150))"""
_F = "f AS (SELECT user_id, event_id, epoch_us(ts) AS b, epoch_us(ts) + 1000000 AS e, CAST(value > 50 AS INT) AS v FROM events)"


def _smooth(src: str, part: str, order: str, h: int) -> str:
    w = f"(PARTITION BY {part} ORDER BY {order})"
    whole = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    terms = "".join(f" + coalesce(lag(v, {k}) OVER {w}, first_value(v) OVER {whole}) + coalesce(lead(v, {k}) OVER {w}, last_value(v) OVER {whole})" for k in range(1, h + 1))
    return f"(SELECT *, (v{terms}) * 2 >= {2 * h + 1} AS smooth FROM {src})"


def _regions(src: str, part: str, order: str, least: int) -> str:
    w = f"(PARTITION BY {part} ORDER BY {order})"
    return f"""SELECT {part}, CAST(min(b) AS BIGINT) AS "begin", CAST(max(e) AS BIGINT) AS "end", count(*) AS n FROM (
      SELECT *, sum(c) OVER {w} AS run FROM (SELECT *, CASE WHEN smooth <> lag(smooth) OVER {w} THEN 1 WHEN lag(smooth) OVER {w} IS NULL THEN 1 ELSE 0 END AS c FROM {src}))
      WHERE smooth GROUP BY {part}, run HAVING max(e) - min(b) >= {least}"""


_E = f"""{_T}, em AS (SELECT utt_name, arg_max(emb, loaded_at) AS emb FROM utt_embeddings
  WHERE len(emb) = 128 AND len(list_filter(emb, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 1e30)) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0 GROUP BY utt_name),
  pc AS (SELECT reco, seg AS piece, b, e, spk, list_transform(emb, lambda x: CAST(x AS DOUBLE)) AS emb FROM t JOIN em ON utt_name = seg),
  cm AS (SELECT reco, spk, pos, avg(x) AS m, count(*) AS n FROM (SELECT reco, spk, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM pc) GROUP BY ALL),
  cl AS (SELECT reco, spk, list(m ORDER BY pos) AS m, max(n) AS n FROM cm GROUP BY reco, spk),
  ce AS (SELECT reco, spk, n, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM cl),
  multi AS (SELECT reco FROM ce GROUP BY reco HAVING count(*) > 1),
  sim AS (SELECT pc.reco, piece, b, e, pc.spk, ce.spk AS other, list_dot_product(emb, c) / sqrt(list_dot_product(emb, emb)) AS sim
    FROM pc JOIN multi USING (reco) JOIN ce ON ce.reco = pc.reco)"""

SQL = {
    "d_subsegments": f"WITH {_S}, {_P} SELECT seg, CAST(f0 AS INT) AS begin_frame, CAST(f1 AS INT) AS end_frame FROM w",
    "d_merged_labels": f"""WITH {_T}, l AS (SELECT *, lag(e) OVER w AS pe, lag(spk) OVER w AS pl FROM t WINDOW w AS (PARTITION BY reco ORDER BY b, e, seg)),
      m AS (SELECT *, pe IS NULL OR b > pe OR spk <> pl AS fresh, CASE WHEN pe IS NULL OR b > pe THEN b ELSE (b + pe) / 2.0 END AS start, pe IS NOT NULL AND b <= pe AND spk <> pl AS shared FROM l),
      i AS (SELECT *, sum(CAST(fresh AS INT)) OVER w AS island, CASE WHEN lead(shared) OVER w THEN lead(start) OVER w ELSE e END AS stop, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY reco ORDER BY b, e, seg))
      SELECT reco, CAST(arg_min(start, r) AS DOUBLE) AS "begin", CAST(arg_max(stop, r) AS DOUBLE) AS "end", min(spk) AS label FROM i GROUP BY reco, island""",
    "d_interval_union": f"""WITH {_S}, m AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY reco ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM s),
      i AS (SELECT *, sum(f) OVER (PARTITION BY reco ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
      SELECT reco, min(b) AS "begin", max(e) AS "end" FROM i GROUP BY reco, k HAVING max(e) - min(b) >= 255""",
    "d_same_speaker_turns": f"""WITH {_T}, r AS (SELECT *, sum(x) OVER (PARTITION BY reco ORDER BY b, e, spk) AS run FROM (SELECT *, CASE WHEN spk = lag(spk) OVER (PARTITION BY reco ORDER BY b, e, spk) THEN 0 ELSE 1 END AS x FROM t)),
      m AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY reco, run ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM r),
      i AS (SELECT *, sum(f) OVER (PARTITION BY reco, run ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
      SELECT reco, min(b) AS "begin", max(e) AS "end", min(spk) AS spk FROM i GROUP BY reco, run, k""",
    "d_median_filter": f"WITH {_F} SELECT event_id, smooth FROM {_smooth('f', 'user_id', 'b, event_id', 2)}",
    "d_true_regions": f"WITH {_F}, g AS {_smooth('f', 'user_id', 'b, event_id', 1)} {_regions('g', 'user_id', 'b, event_id', 0)}",
    "d_relabelled": f"WITH {_T}, k AS (SELECT reco, spk, min((b, e, seg)) AS first_at FROM t GROUP BY reco, spk) SELECT reco, spk, CAST(row_number() OVER (PARTITION BY reco ORDER BY first_at, spk) - 1 AS INT) AS new_label FROM k",
    "d_most_overlapping": f"""WITH {_T}, {_P}, x AS (SELECT reco, seg || '#' || f0 AS piece, b + f0 * 10 AS b, b + f1 * 10 AS e FROM w),
      n AS (SELECT *, row_number() OVER (PARTITION BY reco ORDER BY b, e, seg) AS ordinal FROM t),
      j AS (SELECT piece, n.spk, least(x.e, n.e) - greatest(x.b, n.b) AS o, ordinal FROM x JOIN n ON x.reco = n.reco AND x.b < n.e AND n.b < x.e WHERE x.e > x.b)
      SELECT piece, spk, CAST(o AS BIGINT) AS overlap_ms FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY o DESC, ordinal) AS r FROM j) WHERE r = 1""",
    "d_speaker_centroids": f"WITH {_E} SELECT reco, spk, n, CAST(generate_subscripts(c, 1) - 1 AS INT) AS pos, round(unnest(c), 6) + 0.0 AS x FROM ce",
    "d_overlap_candidates": f"WITH {_E} SELECT piece, other, round(round(sim, 6), 5) + 0.0 AS sim FROM sim",
    "d_overlap_regions": f"""WITH {_E}, rs AS (SELECT *, round(sim, 4) AS s4 FROM sim),
      o AS (SELECT a.reco, a.piece, a.b, a.e, a.other, CAST(a.other <> a.spk AND a.s4 >= 0.05 AND p.s4 - a.s4 <= 0.95 AS INT) AS v FROM rs a JOIN rs p ON p.piece = a.piece AND p.other = a.spk),
      g AS {_smooth('o', 'reco, other', 'b, e, piece', 1)} {_regions('g', 'reco, other', 'b, e, piece', 100)}""",
    "d_nearest_other_speaker": f"""WITH {_E}, x AS (SELECT a.reco, a.spk, o.spk AS other, round(list_dot_product(a.c, o.c), 5) + 0.0 AS sim FROM ce a JOIN ce o ON o.reco = a.reco AND o.spk <> a.spk)
      SELECT reco, spk, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY reco, spk ORDER BY sim DESC, other) AS r FROM x) WHERE r = 1""",
    "d_rttm_lines": f"WITH {_T} SELECT format('SPEAKER {{}} 1 {{:.3f}} {{:.3f}} <NA> <NA> {{}} <NA> <NA>', reco, b / 1000.0, (e - b) / 1000.0, spk) AS line FROM t",
    "d_segment_ids": f"WITH {_S} SELECT seg, format('{{}}-{{:08d}}-{{:08d}}', reco, b, e) AS written FROM s",
}

SQL["d_grouped_pieces"] = f"""WITH {_E} SELECT reco, CAST(count(*) AS INT) AS n, md5(string_agg(piece, ' ' ORDER BY b, e, piece)) AS digest, round(arg_min(emb[1], (b, e, piece)), 6) + 0.0 AS first_value FROM pc GROUP BY reco"""
_MOST = SQL["d_most_overlapping"]
SQL["d_most_overlapping_parent"] = _MOST.replace("SELECT reco, seg || '#' || f0 AS piece, b + f0 * 10 AS b, b + f1 * 10 AS e FROM w", "SELECT w.reco, w.seg || '#' || f0 AS piece, s.b, s.e FROM w JOIN s ON s.seg = w.seg AND s.reco = w.reco")
SQL["d_sample_windows"] = f"""WITH {_S}, p AS (SELECT seg, b * 16 AS first, (e - b) * 16 AS n FROM s),
  w AS (SELECT seg, first, 0 AS x, n AS y FROM p WHERE n <= 24000 UNION ALL SELECT seg, first, x, least(x + 24000, n) FROM (SELECT *, unnest(range(0, n - 24000 + 12000, 12000)) AS x FROM p WHERE n > 24000))
  SELECT seg, CAST(x // 160 AS INT) AS begin_frame, CAST(y // 160 AS INT) AS end_frame, first + x AS first_sample, y - x + 1 AS n_samples FROM w"""
SQL["d_sorted_turns"] = f"""WITH {_T} SELECT reco, b AS "begin", e AS "end", spk, CAST(row_number() OVER (PARTITION BY reco ORDER BY b, e, seg) AS INT) AS place FROM t"""
SQL["d_turns_with_overlap"] = f"""SELECT reco, "begin", "end", other AS spk FROM ({SQL["d_overlap_regions"]}) UNION ALL SELECT reco, b, e, spk FROM (WITH {_T} SELECT reco, b, e, spk FROM t)"""
SQL["d_matched"] = f"""WITH {_E}, y AS (SELECT piece, b, e, emb[1:64] AS p, emb[65:128] AS q FROM pc)
  SELECT piece, b AS "begin", e AS "end", round(list_dot_product(p, p), 3) AS a, round(list_dot_product(q, q), 3) AS b FROM y"""

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("d_")}
