"""Queries on the data-directory tables: orphan references, periods and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermill.functions.storage import table
from uttermill.functions.times import finite, latest_key, latest_value, seconds_to_ms
from uttermill.operators.intervals import periods_and_gaps
from uttermill.operators.references import orphan_references, orphan_report

#: Referring table, its own key and reference, referred table and key, whether that table has removed_at.
REFERENCES = (
    ("utt2spk", "utt", "utt", "segments", "seg", "removed_at"),
    ("feats_scp", "utt", "utt", "utt2spk", "utt", "removed_at"),
    ("segments", "seg", "reco", "wav_scp", "wav_id", "removed_at"),
)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key whose reference is missing, deleted or late."""
    found = [
        orphan_references(table(spark, sf_dir, a), table(spark, sf_dir, b), [(ref, key)], own, target_removed_at=gone).select(
            F.lit(a).alias("ref_table"),
            F.col(own).alias("ref_key"),
            "reason",
            F.date_format("first_loaded_at", "yyyy-MM").alias("load_month"),
        )
        for a, own, ref, b, key, gone in REFERENCES
    ]
    return reduce(DataFrame.unionAll, found)


def p2_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, counted per table, month and reason."""
    return orphan_report(p2_found(spark, sf_dir))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances whose pair of utterance and speaker no speaker lists, under two meanings of a missing speaker.

    Composite keys with nulls: ``partial`` asks for any listing of the utterance where the speaker is unknown, ``full``
    reports such a pair as incomplete.
    """
    lists = table(spark, sf_dir, "spk2utt").select(F.explode("utts").alias("l_utt"), F.col("spk").alias("l_spk"), F.lit(None).cast("timestamp").alias("listed_at"))
    found = [
        orphan_references(table(spark, sf_dir, "utt2spk"), lists, [("utt", "l_utt"), ("spk", "l_spk")], "utt", target_loaded_at="listed_at", target_removed_at=None, match=match).select(
            F.lit(match).alias("match"), F.col("utt").alias("ref_key"), "reason", F.date_format("first_loaded_at", "yyyy-MM").alias("load_month")
        )
        for match in ("partial", "full")
    ]
    return found[0].unionAll(found[1])


def usable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of segments with a live, complete, forward interval: ``seg, reco, begin_ms, end_ms, loaded_at``."""
    rows = table(spark, sf_dir, "segments").where(
        F.col("removed_at").isNull() & F.col("seg").isNotNull() & F.col("reco").isNotNull() & finite(F.col("begin_sec")) & finite(F.col("end_sec"))
    )
    return rows.select("seg", "reco", seconds_to_ms(F.col("begin_sec")).alias("begin_ms"), seconds_to_ms(F.col("end_sec")).alias("end_ms"), "loaded_at").where(
        "begin_ms >= 0 and end_ms > begin_ms"
    )


def recording_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, length_ms``: each recording's latest finite length above 0."""
    rows = table(spark, sf_dir, "reco2dur").where(finite(F.col("dur")) & (F.col("dur") > 0))
    packed = rows.groupBy("reco").agg(F.max(latest_key(F.col("loaded_at"), seconds_to_ms(F.col("dur")))).alias("packed"))
    return packed.select(F.col("reco").alias("entity"), latest_value(F.col("packed")).alias("length_ms"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined speech periods and the gaps of at least 2 s in each recording."""
    intervals = usable_segments(spark, sf_dir).select(F.col("reco").alias("entity"), "begin_ms", "end_ms")
    rows = periods_and_gaps(intervals, recording_lengths(spark, sf_dir))
    return rows.select(F.col("entity").alias("reco"), "kind", "begin_ms", "end_ms")


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recording: joined periods, gaps and their total time."""
    rows = p3_found(spark, sf_dir)
    length = F.col("end_ms") - F.col("begin_ms")
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0)).cast("bigint")
    return rows.groupBy("reco").agg(
        of("period", F.lit(1)).alias("n_periods"),
        of("period", length).alias("period_ms"),
        of("gap", F.lit(1)).alias("n_gaps"),
        of("gap", length).alias("gap_ms"),
    )


_P2_PART = """
SELECT '{a}' AS ref_table, own AS ref_key,
       CASE min(rank) WHEN 2 THEN 'missing' WHEN 3 THEN 'deleted' ELSE 'late' END AS reason,
       strftime(min(first), '%Y-%m') AS load_month
FROM (
  SELECT o.own, o.first,
         CASE WHEN t.k IS NULL THEN 2 WHEN t.gone THEN 3 WHEN t.there_from > o.first THEN 4 END AS rank
  FROM (SELECT {own} AS own, {ref} AS ref, min(loaded_at) AS first FROM {a} GROUP BY 1, 2) o
  LEFT JOIN (SELECT {key} AS k, min(loaded_at) AS there_from, bool_and(removed_at IS NOT NULL) AS gone
             FROM {b} GROUP BY 1) t ON o.ref = t.k
  WHERE o.ref IS NOT NULL
) GROUP BY own HAVING min(rank) IS NOT NULL
"""
P2_SQL = " UNION ALL ".join(_P2_PART.format(a=a, own=own, ref=ref, b=b, key=key) for a, own, ref, b, key, _ in REFERENCES)

P3_SQL = """
WITH iv AS (
  SELECT DISTINCT reco, CAST(round(begin_sec * 1000) AS BIGINT) AS b, CAST(round(end_sec * 1000) AS BIGINT) AS e
  FROM segments
  WHERE removed_at IS NULL AND seg IS NOT NULL AND reco IS NOT NULL AND isfinite(begin_sec) AND isfinite(end_sec)
), ok AS (SELECT * FROM iv WHERE b >= 0 AND e > b),
len AS (
  SELECT reco, CAST(round(arg_max(dur, loaded_at) * 1000) AS BIGINT) AS n
  FROM reco2dur WHERE isfinite(dur) AND dur > 0 GROUP BY reco
), marked AS (
  SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY reco ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 THEN 0 ELSE 1 END AS fresh
  FROM ok
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY reco ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM marked
), unions AS (SELECT reco, island, min(b) AS b, max(e) AS e, count(*) AS n FROM numbered GROUP BY 1, 2),
edges AS (
  SELECT u.reco, u.e AS b, coalesce(lead(u.b) OVER (PARTITION BY u.reco ORDER BY u.b), len.n) AS e, len.n
  FROM unions u JOIN len USING (reco)
  UNION ALL
  SELECT u.reco, 0 AS b, min(u.b) AS e, min(len.n) AS n FROM unions u JOIN len USING (reco) GROUP BY u.reco
)
SELECT reco, 'period' AS kind, CAST(b AS BIGINT) AS begin_ms, CAST(e AS BIGINT) AS end_ms FROM unions JOIN len USING (reco) WHERE unions.n > 1
UNION ALL
SELECT reco, 'gap' AS kind, CAST(b AS BIGINT) AS begin_ms, CAST(least(e, n) AS BIGINT) AS end_ms FROM edges WHERE least(e, n) - b >= 2000
"""

_PAIRS = """WITH o AS (SELECT utt, spk, min(loaded_at) AS first FROM utt2spk GROUP BY utt, spk), l AS (SELECT unnest(utts) AS utt, spk FROM spk2utt), p AS (SELECT DISTINCT utt, spk FROM l), k AS (SELECT DISTINCT utt FROM l),
x AS (SELECT o.utt, o.spk, o.first, p.utt IS NOT NULL AS paired, k.utt IS NOT NULL AS listed FROM o LEFT JOIN p ON p.utt = o.utt AND p.spk = o.spk LEFT JOIN k ON k.utt = o.utt),
r AS (SELECT 'partial' AS match, utt, first, CASE WHEN spk IS NULL THEN CASE WHEN NOT listed THEN 2 END WHEN NOT paired THEN 2 END AS rank FROM x
  UNION ALL SELECT 'full', utt, first, CASE WHEN spk IS NULL THEN 1 WHEN NOT paired THEN 2 END FROM x)
SELECT match, utt AS ref_key, CASE min(rank) WHEN 1 THEN 'incomplete' ELSE 'missing' END AS reason, strftime(min(first), '%Y-%m') AS load_month FROM r GROUP BY match, utt HAVING min(rank) IS NOT NULL"""

QUERIES = {"p2_found": p2_found, "p2_orphans": p2_orphans, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_coverage": p3_coverage}
SQL = {
    "p2_found": P2_SQL,
    "p2_pairs": _PAIRS,
    "p2_orphans": f"SELECT ref_table, load_month, reason, count(*) AS n_keys FROM ({P2_SQL}) GROUP BY ALL",
    "p3_found": P3_SQL,
    "p3_coverage": f"""
SELECT reco, count(*) FILTER (kind = 'period') AS n_periods,
       CAST(coalesce(sum(end_ms - begin_ms) FILTER (kind = 'period'), 0) AS BIGINT) AS period_ms,
       count(*) FILTER (kind = 'gap') AS n_gaps,
       CAST(coalesce(sum(end_ms - begin_ms) FILTER (kind = 'gap'), 0) AS BIGINT) AS gap_ms
FROM ({P3_SQL}) GROUP BY reco""",
}
