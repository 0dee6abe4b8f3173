"""Data directories as keyed tables: filters, joins, nesting, set operations, repair, subsets and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttermill.functions.running import group_ranks, running_sums


def hashed_order(*cols: str, seed: int = 0) -> Column:
    """A pseudo-random order of rows that depends on their keys and a seed only."""
    return F.xxhash64(*cols, F.lit(seed))


# ---------------------------------------------------------------- filters


def hex_order(*cols: str, seed: int = 0) -> Column:
    """A pseudo-random order that other engines have, too: the MD5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)).cast("binary"))


def hex_number(x: Column) -> Column:
    """The first 32 bits of a :func:`hex_order` as a number."""
    return F.conv(F.substring(x, 1, 8), 16, 10).cast("bigint")


def longer_than(rows: DataFrame, durations: DataFrame, least: float, key: str = "utt", dur: str = "dur") -> DataFrame:
    """Rows whose duration is known and strictly above ``least``; each key's longest stated duration counts."""
    known = durations.where(~F.isnan(dur)).groupBy(key).agg(F.max(dur).alias("__dur")).where(F.col("__dur") > least).select(key)
    return rows.join(known, key, "left_semi")


def frequent_only(rows: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """Rows of groups with at least ``least`` distinct members."""
    kept = rows.groupBy(group).agg(F.countDistinct(member).alias("__n")).where(F.col("__n") >= least).select(group)
    return rows.join(kept, group, "left_semi")


def by_ids(rows: DataFrame, ids: DataFrame, column: str, id_column: str, exclude: bool = False) -> DataFrame:
    """Keep, or drop, the rows whose column is in an id list. Null is in no list."""
    right = ids.select(F.col(id_column).alias("__id"))
    return rows.join(right, F.col(column) == F.col("__id"), "left_anti" if exclude else "left_semi")


def capped(rows: DataFrame, column: str, least: int, most: int, seed: int = 0, key: str = "utt") -> DataFrame:
    """Drop arrays below ``least`` elements and cut those above ``most`` to a chunk at a hashed place."""
    size = F.size(column)
    start = F.pmod(hex_number(hex_order(key, seed=seed)), F.greatest(size - most + 1, F.lit(1)).cast("bigint")).cast("int")
    cut = F.when(size > most, F.slice(column, start + 1, F.lit(most))).otherwise(F.col(column))
    return rows.where(F.col(column).isNotNull() & (size >= least)).withColumn(column, cut)


def snr_range(key: Column) -> Column:
    """The range of signal-to-noise ratios for a noise, by the kind that its key begins with (fixed values)."""
    pair = lambda a, b: F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))
    return F.when(key.startswith("noise"), pair(0, 15)).when(key.startswith("speech"), pair(10, 30)).when(key.startswith("music"), pair(5, 15)).otherwise(pair(0, 15))


# ---------------------------------------------------------------- ids and joins


def dense_ids(rows: DataFrame, name: str) -> DataFrame:
    """``name, id``: distinct non-null names numbered from 0 in byte order, without putting them into one task."""
    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    return running_sums(names, [name], {"id": F.lit(1).cast("bigint")}).select(name, (F.col("id") - 1).alias("id"))


def with_ids(rows: DataFrame, ids: DataFrame, name: str, unknown: int = -1) -> DataFrame:
    """Add the id of a name; names without one get ``unknown``."""
    return rows.join(ids, name, "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def raw_list(utts: DataFrame, wavs: DataFrame, vad: DataFrame | None = None, keep_without_vad: bool = True) -> DataFrame:
    """``utt, spk, wav[, vad]``: utterances with their audio and, if given, their speech; without audio they are left out."""
    rows = utts.join(wavs, "utt")
    return rows if vad is None else rows.join(vad, "utt", "left" if keep_without_vad else "inner")


def incomplete_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``key, side``."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


# ---------------------------------------------------------------- nesting


def nested(rows: DataFrame, group: str, member: str) -> DataFrame:
    """``group, members``: distinct members of each group in byte order. A group's array is one value, which its size must allow."""
    return rows.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct().groupBy(group).agg(F.sort_array(F.collect_list(member)).alias("members"))


def unnested(rows: DataFrame, group: str, members: str, member: str) -> DataFrame:
    return rows.select(F.explode(members).alias(member), group)


def speech_lists(segments: DataFrame, key: str = "utt") -> DataFrame:
    """``key, vad``: each key's ``begin, end`` pairs in order."""
    return segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("vad"))


def voiced_duration(segments: DataFrame, key: str = "utt") -> DataFrame:
    return segments.groupBy(key).agg(F.sum(F.col("end") - F.col("begin")).alias("dur"))


# ---------------------------------------------------------------- sets of tables


def first_of_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in a given order that tells a key's rows apart."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def common_keys(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    keys = [t.select(key).where(F.col(key).isNotNull()).distinct() for t in tables]
    return reduce(lambda a, b: a.join(b, key, "left_semi"), keys)


def repaired(tables: Mapping[str, DataFrame], keys: Mapping[str, str], order: Mapping[str, Sequence[Column]]) -> dict[str, DataFrame]:
    """Every table with the first row of each key, in an order that tells a key's rows apart, cut down to the keys that all tables have."""
    once = {n: first_of_key(t, keys[n], order[n]) for n, t in tables.items()}
    shared = common_keys([t.select(F.col(keys[n]).alias("__key")) for n, t in once.items()], "__key")
    return {n: t.join(shared, F.col(keys[n]) == F.col("__key"), "left_semi") for n, t in once.items()}


def repaired_directory(recordings: DataFrame, segments: DataFrame, utt2spk: DataFrame, per_utt: Sequence[DataFrame], spk2utt: DataFrame | None = None) -> dict[str, DataFrame]:
    """A directory whose tables agree: recordings (``reco``), segments (``seg, reco``), utterances (``utt, spk``) and tables per utterance.

    An utterance stays if it has a speaker, a segment of a recording that is there, and a row in every other table;
    a recording, segment or speaker stays if an utterance that stays needs it. One pass settles this, as an utterance
    names one recording and one speaker, so what falls away with it was needed by nothing else that stays. With
    ``spk2utt`` (``spk``) only speakers that it lists stay.
    """
    speakers = utt2spk.where("spk is not null")
    if spk2utt is not None:
        speakers = speakers.join(spk2utt.select("spk"), "spk", "left_semi").select(*utt2spk.columns)
    there = segments.join(recordings.select("reco"), "reco", "left_semi")
    utts = common_keys([speakers, there.select(F.col("seg").alias("utt")), *(t.select("utt") for t in per_utt)], "utt")
    good = speakers.join(utts, "utt", "left_semi").select(*utt2spk.columns)
    kept = there.join(utts, F.col("seg") == F.col("utt"), "left_semi").select(*segments.columns)
    out = {"utt2spk": good, "segments": kept, "recordings": recordings.join(kept.select("reco"), "reco", "left_semi"), "speakers": good.select("spk").distinct()}
    return out | {f"per_utt_{i}": t.join(utts, "utt", "left_semi") for i, t in enumerate(per_utt)}


def combined(directories: Sequence[Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Data directories put together: a table comes out if all of them have it, with the columns that all share.

    ``utt2uniq``, which tells the original of a copy, comes out if any has it; in the others each utterance is its own.
    """
    out = {}
    if any("utt2uniq" in d for d in directories):
        directories = [d if "utt2uniq" in d else {**d, "utt2uniq": d["utt2spk"].select("utt", F.col("utt").alias("uniq")).distinct()} for d in directories]
    for name in directories[0]:
        if all(name in d for d in directories):
            cols = [c for c in directories[0][name].columns if all(c in d[name].columns for d in directories)]
            out[name] = reduce(DataFrame.unionByName, [d[name].select(*cols) for d in directories])
    return out


# ---------------------------------------------------------------- subsets and sampling


def shortest(rows: DataFrame, duration: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(duration, key).limit(n)


def every_few(rows: DataFrame, group: str, member: str, n: int) -> DataFrame:
    """``n`` members of each group, evenly spread in order: every k-th, for the largest k with ``n * k`` not above the size."""
    numbered = group_ranks(rows.select(group, member).distinct(), group, [member])
    k = F.greatest(F.floor(F.col("group_size") / n), F.lit(1))
    return numbered.where((F.col("rank") % k == 0) & (F.col("rank") / k < n)).select(group, member)


def groups_up_to(rows: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """Whole groups in hashed order while the members taken before each are below ``n``: ``group, n_members``."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_members")).withColumn("__order", hex_order(group, seed=seed))
    run = running_sums(sizes, ["__order", group], {"upto": F.col("n_members")})
    return run.where(F.col("upto") - F.col("n_members") < n).select(group, "n_members")


def strided_part(rows: DataFrame, order: Sequence[str], rank: int, world: int) -> DataFrame:
    """Every ``world``-th row from ``rank`` on, in an order that tells rows apart."""
    numbered = running_sums(rows, order, {"__at": F.lit(1).cast("bigint")})
    return numbered.where(F.pmod(F.col("__at") - 1, F.lit(world)) == rank).drop("__at", "__at_all")


def calibration_trials(utts: DataFrame, n: int, short: tuple[float, float] = (2.0, 6.0), seed: int = 0) -> DataFrame:
    """Trials between short and long utterances of speakers that have both: ``enroll, test, label, kind``.

    ``utts`` has ``utt, spk, dur``. Durations between the two limits are short, above the upper one long, and exactly
    on a limit neither. For each of ``n // 2`` draws, a speaker and another one are picked by hash, and so are their
    utterances, with replacement: for short-short, short-long and long-long one target and one other trial each.
    """
    kind = F.when((F.col("dur") > short[0]) & (F.col("dur") < short[1]), "short").when(F.col("dur") > short[1], "long")
    per = utts.select("utt", "spk", kind.alias("kind")).where("kind is not null and spk is not null").distinct()
    both = per.groupBy("spk").agg(F.countDistinct("kind").alias("k")).where("k = 2").select("spk")
    speakers = dense_ids(both, "spk")
    count = speakers.count()
    spark = utts.sparkSession
    if count < 2 or n < 2:
        return spark.createDataFrame([], "enroll string, test string, label string, kind string")
    pools = per.join(both, "spk", "left_semi")
    pools = group_ranks(pools.withColumn("of", F.concat_ws("|", "kind", "spk")), "of", ["utt"]).withColumnsRenamed({"rank": "i", "group_size": "size"}).drop("of")
    pick = lambda *x: hex_number(F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", "combo", *map(F.lit, x)).cast("binary")))
    draws = spark.range(n // 2).withColumnRenamed("id", "draw").withColumn("combo", F.explode(F.array(*map(F.lit, ("short-short", "short-long", "long-long")))))
    draws = draws.withColumn("label", F.explode(F.array(F.lit("target"), F.lit("nontarget"))))
    a = F.pmod(pick("a"), F.lit(count))
    b = F.when(F.col("label") == "target", a).otherwise(F.pmod(a + 1 + F.pmod(pick("b"), F.lit(count - 1)), F.lit(count)))
    draws = draws.select("draw", "combo", "label", a.alias("a_id"), b.alias("b_id"), F.split("combo", "-")[0].alias("a_kind"), F.split("combo", "-")[1].alias("b_kind"))
    sizes = pools.select("spk", "kind", "size").distinct()
    for side in "ab":
        names = speakers.select(F.col("spk").alias(f"{side}_spk"), F.col("id").alias(f"{side}_id"))
        draws = draws.join(names, f"{side}_id")
        draws = draws.join(sizes.select(F.col("spk").alias(f"{side}_spk"), F.col("kind").alias(f"{side}_kind"), F.col("size").alias(f"{side}_n")), [f"{side}_spk", f"{side}_kind"])
        draws = draws.withColumn(f"{side}_i", F.pmod(pick(side, "utt"), F.col(f"{side}_n")).cast("int"))
        utt = pools.select(F.col("spk").alias(f"{side}_spk"), F.col("kind").alias(f"{side}_kind"), F.col("i").alias(f"{side}_i"), F.col("utt").alias(f"{side}_utt"))
        draws = draws.join(utt, [f"{side}_spk", f"{side}_kind", f"{side}_i"])
    return draws.select(F.col("a_utt").alias("enroll"), F.col("b_utt").alias("test"), "label", F.col("combo").alias("kind"))


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(key).limit(n)


def last_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(key)).limit(n)


def random_rows(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in hashed order of a key that tells them apart; the same for a seed at any partitioning."""
    return rows.orderBy(hex_order(key, seed=seed), key).limit(n)


def locally_shuffled(rows: DataFrame, order: Sequence[str], key: str, window: int = 2_500, seed: int = 0) -> DataFrame:
    """Rows in an order in which each has moved within a window of so many rows only: adds ``window_no, place_key`` to sort by."""
    numbered = running_sums(rows, order, {"__at": F.lit(1).cast("bigint")})
    return numbered.withColumn("window_no", F.floor((F.col("__at") - 1) / window).cast("bigint")).withColumn("place_key", hex_order(key, seed=seed)).drop("__at", "__at_all")


def strided_share(rows: DataFrame, order: Sequence[str], rank: int, world: int, worker: int, workers: int) -> DataFrame:
    """The share of one worker of one process: every ``workers``-th from ``worker`` on of every ``world``-th row from ``rank`` on."""
    return strided_part(rows, order, rank + world * worker, world * workers)


def collated(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``batch_no, rows``: rows stacked into batches of so many, in an order that tells them apart."""
    numbered = running_sums(rows, order, {"__at": F.lit(1).cast("bigint")}).drop("__at_all")
    batch = F.floor((F.col("__at") - 1) / size).cast("bigint")
    return numbered.groupBy(batch.alias("batch_no")).agg(F.array_sort(F.collect_list(F.struct("__at", *rows.columns))).alias("rows"))


def repeated(rows: DataFrame, epochs: int) -> DataFrame:
    """The whole table once for each epoch: adds ``epoch``."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


# ---------------------------------------------------------------- reshaping


def augmented(rows: DataFrame, key: str, copies: int) -> DataFrame:
    """Copies 0 to ``copies`` of each row, with the copy's number added to its key."""
    return rows.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(copies)))).withColumn(key, F.concat(F.col(key), F.lit("_copy-"), F.col("copy_no").cast("string"))).drop("copy_no")


def grid(spark, **choices: Sequence) -> DataFrame:
    """Every combination of the given choices, a column each."""
    out = spark.range(1).select()
    for name, values in choices.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def result_table(results: DataFrame, row: str, column: str, values: Sequence[str], cell: str, missing: str = "- -") -> DataFrame:
    """One row per system and one column per trial set, with a mark where there is no result."""
    return results.groupBy(row).pivot(column, list(values)).agg(F.max(cell)).na.fill(missing)


def shifted_label(label: Column, copy_no: Column, n_labels: int) -> Column:
    """Label of a speed copy: one range of labels per copy. An unknown label (-1) stays unknown."""
    return F.when(label < 0, label).otherwise(label + n_labels * copy_no)
