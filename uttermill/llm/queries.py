"""Queries of the training-data operators on whole tables, and their SQL where there is any."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from uttermill.functions.storage import table, written
from uttermill.functions.times import finite, latest_key, latest_value, seconds_to_ms
from uttermill.llm.clusters import cluster
from uttermill.llm.grouping import assign_splits, connected_components, star_edges
from uttermill.llm.mixing import mix, source_key
from uttermill.llm.neighbours import nearest, recall
from uttermill.llm.packing import pack
from uttermill.llm.personal import find_personal
from uttermill.llm.routing import learned_router, unit_vectors
from uttermill.llm.splitting import spans_of_texts, split_oversized
from uttermill.llm.tokens import token_count
from uttermill.plans.corpus import usable_segments

# ---------------------------------------------------------------- 1: splitting


def utterance_lengths(spark: SparkSession, sf_dir: str, max_seconds: float = 1_000.0) -> DataFrame:
    """``item, length_ms``: the latest usable length from utt2dur, else from segments. Values above ``max_seconds`` are milliseconds."""
    dur = F.col("dur")
    ms = F.when(dur > max_seconds, F.round(dur).cast("bigint")).otherwise(seconds_to_ms(dur))
    stated = table(spark, sf_dir, "utt2dur").where(finite(dur) & (dur > 0) & F.col("utt").isNotNull())
    stated = stated.select(F.col("utt").alias("item"), latest_key(F.col("loaded_at"), ms).alias("stated"), F.lit(None).cast("decimal(38,0)").alias("cut"))
    span = latest_key(F.col("loaded_at"), F.col("end_ms") - F.col("begin_ms"))
    from_cut = usable_segments(spark, sf_dir).select(F.col("seg").alias("item"), F.lit(None).cast("decimal(38,0)").alias("stated"), span.alias("cut"))
    best = stated.unionAll(from_cut).groupBy("item").agg(F.max("stated").alias("stated"), F.max("cut").alias("cut"))
    return best.select("item", F.coalesce(latest_value(F.col("stated")), latest_value(F.col("cut"))).alias("length_ms"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 30 s of every longer utterance."""
    long = utterance_lengths(spark, sf_dir).where("length_ms > 30000")
    spoken = table(spark, sf_dir, "raw_list").where("vad is not null and utt is not null").groupBy("utt").agg(F.max("vad").alias("vad"))
    items = long.join(spoken, F.col("item") == F.col("utt"), "left").select("item", "length_ms", spans_of_texts(F.col("vad")).alias("spans"))
    return split_oversized(items).withColumnRenamed("item", "utt")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance longer than 30 s, and whether pauses are enough to cut it."""
    return p1_pieces(spark, sf_dir).where("piece_no = 0").select("utt", "cut_kind")


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every cut utterance what its pieces span, and how many of them break a rule: length, overlap, order."""
    pieces = p1_pieces(spark, sf_dir)
    w = Window.partitionBy("utt").orderBy("piece_no")
    faults = (F.col("end_ms") - F.col("begin_ms") > 30_000) | (F.col("begin_ms") < 0) | (F.col("end_ms") <= F.col("begin_ms"))
    faults = faults | F.coalesce((F.col("begin_ms") <= F.lag("begin_ms").over(w)) | (F.col("begin_ms") != F.lag("end_ms").over(w) - 500), F.lit(False))
    # A piece that is cut by force stands in an utterance of which that is said.
    faults = faults | ((F.col("cut") == "forced") & (F.col("cut_kind") == "pause"))
    rows = pieces.select("utt", "begin_ms", "end_ms", "length_ms", faults.alias("fault"))
    return rows.groupBy("utt", "length_ms").agg(F.min("begin_ms").alias("begin_ms"), F.max("end_ms").alias("end_ms"), F.count_if("fault").alias("n_faults"))


# ---------------------------------------------------------------- 4: splits


def speaker_key(spk: Column) -> Column:
    """One key for the spellings and processed copies of a speaker id: case, dashes, padding, speed and copy marks."""
    bare = F.lower(F.trim(spk))
    bare = F.regexp_replace(bare, r"^(sp\d+(\.\d+)?[-_])+", "")
    bare = F.regexp_replace(bare, r"([-_]copy[-_]?\d+)+$", "")
    letters, digits = F.regexp_extract(bare, r"^([a-z]+)[-_ ]?0*(\d+)$", 1), F.regexp_extract(bare, r"^([a-z]+)[-_ ]?0*(\d+)$", 2)
    return F.when(digits != "", F.concat(letters, F.lit("#"), digits)).otherwise(bare)


def recording_of(utt: Column) -> Column:
    """The recording that an utterance id names."""
    # The pattern meets the 18 last characters only, not the whole id.
    return F.when(F.substring(utt, -18, 18).rlike(r"^-\d{8}-\d{8}$"), utt.substr(F.lit(1), F.length(utt) - 18)).otherwise(utt)


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``utt, spk`` of both tables; speakers that name nobody are null."""
    flat = table(spark, sf_dir, "utt2spk").select("utt", "spk")
    nested = table(spark, sf_dir, "spk2utt").select(F.explode_outer("utts").alias("utt"), "spk")
    return flat.unionAll(nested).select("utt", F.when(F.col("spk") != "unk", F.col("spk")).alias("spk"))


def tied_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, component``: speakers tied to another one, with the smallest of their group."""
    filed = _filed(spark, sf_dir).where("spk is not null")
    by_recording = filed.where("utt is not null").select(F.col("spk").alias("node"), F.concat(F.lit("r:"), recording_of(F.col("utt"))).alias("entity")).distinct()
    # As an aggregate, so that no test of the key is pushed down to every row.
    by_name = filed.groupBy("spk").agg(F.min("spk").alias("node")).select("node", F.concat(F.lit("s:"), speaker_key(F.col("node"))).alias("entity"))
    return connected_components(star_edges(by_recording.unionAll(by_name)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speaker that isn't the smallest of its group, with that smallest."""
    return tied_speakers(spark, sf_dir).where("node <> component").select(F.col("component").alias("first_spk"), F.col("node").alias("spk"))


def _recording_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``utt, recording`` of all utterances, and ``recording, component``. A recording without a named speaker is its own group."""
    filed = _filed(spark, sf_dir).where("utt is not null")
    tied = tied_speakers(spark, sf_dir)
    per_recording = filed.groupBy(recording_of(F.col("utt")).alias("recording")).agg(F.min("spk").alias("spk"))
    groups = per_recording.join(tied, F.col("spk") == F.col("node"), "left").select(
        "recording", F.coalesce("component", "spk", F.concat(F.lit("r:"), "recording")).alias("component")
    )
    return filed.select("utt", recording_of(F.col("utt")).alias("recording")).distinct(), groups


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every utterance."""
    utts, groups = _recording_groups(spark, sf_dir)
    groups = written(groups, "groups")
    weights = utts.groupBy("recording").agg(F.count(F.lit(1)).alias("n")).join(groups, "recording").groupBy("component").agg(F.sum("n").alias("weight"))
    splits = assign_splits(written(weights, "weights"), table(spark, sf_dir, "split_targets"))
    return utts.join(groups.join(splits, "component").select("recording", "component", "split_name"), "recording").select("utt", "component", "split_name")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances and actual share of each split beside its target."""
    counted = p4_splits(spark, sf_dir).groupBy("split_name").agg(F.count(F.lit(1)).alias("n_utts"), F.countDistinct("component").alias("n_groups"))
    all_utts = F.sum("n_utts").over(_everything())
    return table(spark, sf_dir, "split_targets").join(counted, "split_name", "left").select(
        "split_name", "target_share", F.coalesce("n_utts", F.lit(0)).alias("n_utts"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), (F.col("n_utts") / all_utts).alias("actual_share")
    )


def _everything():
    return Window.partitionBy(F.lit(1))


# ---------------------------------------------------------------- 5: neighbours


def _voices(spark: SparkSession, sf_dir: str, small: bool = False):
    """Usable vectors of utterances, and a router fitted to them."""
    rows = table(spark, sf_dir, "utt_embeddings").select("utt_name", "emb", "loaded_at")
    return unit_vectors(rows, "utt_name", "emb", "loaded_at", small=small), learned_router(rows, "utt_name", "emb", "loaded_at")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar other utterances of every utterance."""
    found = nearest(*_voices(spark, sf_dir))
    return found.select(F.col("name").alias("utt_name"), F.col("other").alias("other_utt"), F.round("cosine", 4).alias("cosine"), "place")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of at least 0.9 of which one is among the 10 nearest of the other."""
    found = nearest(*_voices(spark, sf_dir), min_cosine=0.9)
    return found.select(F.least("name", "other").alias("utt_a"), F.greatest("name", "other").alias("utt_b")).distinct()


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the routed search for one utterance in 20, against all rows."""
    return recall(*_voices(spark, sf_dir))


# ---------------------------------------------------------------- 6: clusters


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every utterance with a usable vector."""
    return cluster(*_voices(spark, sf_dir, small=True))[0].select(F.col("name").alias("utt_name"), "cluster", F.col("first").alias("first_utt"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of a cluster that isn't its smallest, with that smallest."""
    return p6_members(spark, sf_dir).where("utt_name <> first_utt").select("first_utt", "utt_name")


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size, most typical utterances and total speech time from segments."""
    members, groups = cluster(*_voices(spark, sf_dir, small=True))
    span = latest_key(F.col("loaded_at"), F.col("end_ms") - F.col("begin_ms"))
    spoken = usable_segments(spark, sf_dir).groupBy("seg").agg(latest_value(F.max(span)).alias("ms"))
    time = members.join(spoken, F.col("name") == F.col("seg")).groupBy("cluster").agg(F.sum("ms").alias("speech_ms"), F.count(F.lit(1)).alias("n_timed"))
    return groups.join(time, "cluster", "left").select(
        F.col("first").alias("first_utt"), "size", "typical", F.coalesce("speech_ms", F.lit(0)).alias("speech_ms"), F.coalesce("n_timed", F.lit(0)).alias("n_timed")
    )


# ---------------------------------------------------------------- 7 and 8: tokens


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document, counted once and stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return written(docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")), "sizes")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    items = document_sizes(spark, sf_dir).select(F.col("doc_id").alias("item"), "n_tokens")
    return pack(items).withColumnRenamed("item", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split."""
    return p7_packed(spark, sf_dir).where("n_pieces > 1 and piece_no = 0").select("doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused space."""
    used = p7_packed(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"),
        (1 - F.sum("tokens") / (F.count(F.lit(1)) * 2048)).alias("unused_share"),
    )


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn copies of all texts."""
    return mix(document_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share of the drawn tokens, and how often its texts were used at most."""
    sizes = document_sizes(spark, sf_dir)
    copies, _ = mix(sizes, table(spark, sf_dir, "mix_targets"))
    drawn = copies.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_copies"), F.max("copy_no").alias("most_repeats"))
    there = sizes.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("own_tokens"), F.count(F.lit(1)).alias("n_docs"))
    wanted = table(spark, sf_dir, "mix_targets").select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = wanted.join(there, "source", "full").join(drawn, "source", "left")
    return joined.select(
        "source", "target_share", "max_repeats", "n_docs", "own_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(_everything())).alias("actual_share"),
    )


# ---------------------------------------------------------------- 9: personal information


def _key(spark: SparkSession) -> str:
    """The secret of the pseudonyms: a setting of the session or the environment, else a new one for this run."""
    return spark.conf.get("spark.uttermill.pseudonymKey", None) or os.environ.get("UTTERMILL_PSEUDONYM_KEY") or secrets.token_hex(32)


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders for what is personal."""
    return find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"), _key(spark)).select("doc_id", F.col("masked").alias("text"), F.size("found").alias("n_found"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence: its document, kind and first code point."""
    rows = find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"), _key(spark))
    return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.kind", "f.start_pos")


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_cover": p1_cover,
    "p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares,
    "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_recall": p5_recall,
    "p6_found": p6_found, "p6_members": p6_members, "p6_clusters": p6_clusters,
    "p7_found": p7_found, "p7_packed": p7_packed, "p7_fill": p7_fill,
    "p8_mixed": p8_mixed, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_masked": p9_masked,
}

SQL: dict[str, str] = {}

_LONG = """stated AS (
  SELECT utt, CAST(round(CASE WHEN d > 1000 THEN d ELSE d * 1000 END) AS BIGINT) AS ms
  FROM (SELECT utt, arg_max(dur, loaded_at) AS d FROM utt2dur WHERE isfinite(dur) AND dur > 0 GROUP BY utt)
), cut AS (
  SELECT seg, arg_max(e - b, loaded_at) AS ms
  FROM (SELECT *, CAST(round(begin_sec * 1000) AS BIGINT) AS b, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM segments
        WHERE removed_at IS NULL AND reco IS NOT NULL AND isfinite(begin_sec) AND isfinite(end_sec))
  WHERE b >= 0 AND e > b GROUP BY seg
), long AS (
  SELECT coalesce(s.utt, c.seg) AS utt, coalesce(s.ms, c.ms) AS length_ms FROM stated s FULL JOIN cut c ON s.utt = c.seg WHERE coalesce(s.ms, c.ms) > 30000
)"""
SQL["p1_found"] = f"""
WITH {_LONG}, spoken AS (SELECT utt, max(vad) AS vad FROM raw_list WHERE vad IS NOT NULL GROUP BY utt),
spans AS (
  SELECT utt, CAST(round(CAST(s[1] AS DECIMAL(20, 6)) * 1000) AS BIGINT) AS b, CAST(round(CAST(s[2] AS DECIMAL(20, 6)) * 1000) AS BIGINT) AS e
  FROM (SELECT utt, unnest(vad) AS s FROM spoken)
), marked AS (
  SELECT *, CASE WHEN b - max(e) OVER (PARTITION BY utt ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 300
                 THEN 0 ELSE 1 END AS fresh
  FROM spans WHERE b >= 0 AND e > b
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY utt ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
longest AS (SELECT utt, max(n) AS n FROM (SELECT utt, k, max(e) - min(b) AS n FROM numbered GROUP BY utt, k) GROUP BY utt)
SELECT long.utt, CASE WHEN spoken.utt IS NOT NULL AND coalesce(longest.n, 0) <= 30000 THEN 'pause' ELSE 'forced' END AS cut_kind
FROM long LEFT JOIN spoken USING (utt) LEFT JOIN longest USING (utt)
"""

SQL["p1_cover"] = f"WITH {_LONG} SELECT utt, length_ms, CAST(0 AS BIGINT) AS begin_ms, length_ms AS end_ms, CAST(0 AS BIGINT) AS n_faults FROM long"

_FILED = r"""filed AS (SELECT utt, CASE WHEN spk <> 'unk' THEN spk END AS spk FROM (SELECT utt, spk FROM utt2spk UNION ALL SELECT unnest(utts), spk FROM spk2utt)),
named AS (SELECT DISTINCT spk, regexp_replace(regexp_replace(lower(trim(spk)), '^(sp\d+(\.\d+)?[-_])+', ''), '([-_]copy[-_]?\d+)+$', '') AS bare FROM filed WHERE spk IS NOT NULL),
member AS (SELECT spk, 's:' || CASE WHEN regexp_matches(bare, '^([a-z]+)[-_ ]?0*(\d+)$') THEN regexp_extract(bare, '^([a-z]+)[-_ ]?0*(\d+)$', 1) || '#' || regexp_extract(bare, '^([a-z]+)[-_ ]?0*(\d+)$', 2) ELSE bare END AS entity FROM named
  UNION SELECT spk, 'r:' || regexp_replace(utt, '-\d{8}-\d{8}$', '') FROM filed WHERE spk IS NOT NULL AND utt IS NOT NULL),
tie AS (SELECT DISTINCT a.spk AS a, b.spk AS b FROM member a JOIN member b USING (entity)),
reach AS (SELECT a, b FROM tie UNION SELECT r.a, t.b FROM reach r JOIN tie t ON t.a = r.b)"""
SQL["p4_found"] = f"WITH RECURSIVE {_FILED} SELECT min(b) AS first_spk, a AS spk FROM reach GROUP BY a HAVING min(b) <> a"

_VOICES = """x AS (SELECT utt_name AS u, arg_max(emb, loaded_at) AS e FROM utt_embeddings
  WHERE len(emb) = 128 AND len(list_filter(emb, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0 GROUP BY utt_name),
n AS (SELECT u, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS e FROM x),
l AS (SELECT u, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM n),
c AS (SELECT a.u AS a, b.u AS b, list_dot_product(a.e, b.e) AS cosine FROM l a JOIN l b ON a.u <> b.u)"""
SQL["p5_found"] = f"""WITH {_VOICES}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 5) DESC, b) AS k FROM c)
SELECT DISTINCT least(a, b) AS utt_a, greatest(a, b) AS utt_b FROM r WHERE k <= 10 AND cosine >= 0.9"""
SQL["p6_found"] = f"""WITH RECURSIVE {_VOICES}, tie AS (SELECT a, b FROM c WHERE cosine >= 0.63), reach AS (SELECT a, b FROM tie UNION SELECT r.a, t.b FROM reach r JOIN tie t ON t.a = r.b)
SELECT min(b) AS first_utt, a AS utt_name FROM reach GROUP BY a HAVING min(b) < a"""
