"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of one cell, the part of a source that one task puts in order.
CELL_DOCS = 1_000_000
#: Classes of sizes from one power of 2 to the next.
CLASSES_PER_DOUBLING = 8


@dataclass(frozen=True)
class Quota:
    """What one source is to give: its scaled share, its own tokens, and copies of each text on average."""

    share: float
    tokens: int
    max_repeats: int
    copies: float


def source_key(source: Column) -> Column:
    """A source's name without outer blanks and in lower case."""
    return F.lower(F.trim(source))


def quotas(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: float | None = None) -> dict[str, Quota]:
    """Average copies per source.

    Sources without tokens or without a target above 0 take no part, and the other shares are scaled to sum to 1.
    Without ``total_tokens`` the mixture is the largest in which every source reaches its share within its repeats.
    With it, a source that cannot reach its share gives what its repeats allow, and the others share the rest.
    """
    live = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in live.values())
    most = {s: sizes[s] * live[s][1] for s in live}
    give: dict[str, float] = {}
    if total_tokens is None:
        total = min((most[s] * whole / live[s][0] for s in live), default=0.0)
        give = {s: live[s][0] / whole * total for s in live}
    else:
        free, left = dict(live), float(total_tokens)
        while free:
            part = sum(t[0] for t in free.values())
            tight = [s for s, t in free.items() if t[0] / part * left >= most[s]]
            if not tight:
                give |= {s: t[0] / part * left for s, t in free.items()}
                break
            for s in tight:
                give[s] = most[s]
                left -= most[s]
                del free[s]
    return {s: Quota(live[s][0] / whole, sizes[s], live[s][1], float(min(give[s] / sizes[s], live[s][1]))) for s in live}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 41) -> tuple[DataFrame, dict[str, Quota]]:
    """Draw texts so that each source has its target share of all tokens; returns the copies and the quotas.

    ``docs`` has ``doc_id, source, n_tokens`` and is read twice, so it should be a stored table; ``targets`` has
    ``source, target_share, max_repeats``, a row per source, and is small. The copies are ``doc_id, source, copy_no,
    n_tokens``.

    A source's documents lie in the order of their size classes, and within one in that of cells of a hash; the running
    sum of their expected copies, shifted by one random offset per source, gives a copy at each integer that it crosses.
    So every document has its expected copies, and as every size gets its part, a source's tokens come near its quota.
    The running sum is built from counts per cell, so no source, however large, is sorted in one task. No text comes out more than ``max_repeats`` times. Null sources take no part, null sizes count 0,
    repeated targets of one source count once (the largest share, the smallest repeats), repeated documents are drawn
    each on their own, and an empty table on either side gives no rows.
    """
    rows = docs.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).where("source is not null")
    wanted = {
        r["source"]: (float(r["share"]), int(r["most"]))
        for r in targets.groupBy(source_key(F.col("source")).alias("source"))
        .agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("most"))
        .dropna()
        .collect()
    }
    sums = rows.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    plan = quotas({r["source"]: r["tokens"] for r in sums}, wanted, total_tokens)
    cells = max(1, math.ceil(sum(r["n"] for r in sums) / CELL_DOCS))
    spark = docs.sparkSession
    rates = spark.createDataFrame([(s, q.copies, q.max_repeats) for s, q in plan.items()], "source string, rate double, most int")
    spot = F.xxhash64("doc_id", F.lit(seed))
    size_class = F.floor(F.log2(F.greatest("n_tokens", F.lit(0)) + 1) * CLASSES_PER_DOUBLING).cast("int")
    placed = rows.select("doc_id", "source", "n_tokens", spot.alias("spot"), size_class.alias("size_class"), F.pmod(spot, F.lit(cells)).cast("int").alias("cell")).join(F.broadcast(rates), "source")
    place = ["source", "size_class", "cell"]
    counts = placed.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("size_class", "cell")  # a row per cell
    before = counts.select(*place, (F.sum("n").over(order) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("n_tokens", "spot", "doc_id"))
    ranked = placed.withColumn("rank", rank).join(before, place).withColumn("at", F.col("before") + F.col("rank"))

    starts = spark.createDataFrame([(s, random.Random(f"{seed}|{s}").random()) for s in plan], "source string, offset double")  # a row per source
    # The same expression at both ends of a document's step: no boundary is lost or met twice.
    crossed = lambda i: F.floor(F.col("rate") * i + F.col("offset"))
    copies_here = F.least(crossed(F.col("at")) - crossed(F.col("at") - 1), F.col("most")).cast("int")
    drawn = ranked.join(F.broadcast(starts), "source").withColumn("copies", copies_here).where("copies > 0")
    copies = drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")
    return copies, plan
