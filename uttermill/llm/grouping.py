"""Splits that keep related records together: connected components, then proportional ranges of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermill.functions.storage import drop_written, written

#: A component with at least this part of the total weight is placed by weight, not by hash. There are at most
#: 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.01
#: Points that identifiers are hashed to.
POINTS = 2**16


def star_edges(memberships: DataFrame) -> DataFrame:
    """``node, entity`` pairs as edges ``a > b`` from each node of an entity to its smallest one.

    One edge per membership: an entity with a million nodes gives a million edges, never pairs. Null nodes or
    entities tie nothing.
    """
    pairs = memberships.select(F.col("node").cast("string"), F.col("entity").cast("string")).dropna().distinct()
    least = pairs.groupBy("entity").agg(F.min("node").alias("b"))
    return pairs.join(least, "entity").where("node > b").select(F.col("node").alias("a"), "b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component``: every node of the edges ``a, b`` with the smallest node that it is connected to.

    Alternates large-star and small-star until the edges no longer change. Each round is two grouped minima with joins
    back, so a hub costs as many rows as it has neighbours, and the edges never grow. Edges lie in the shared folder
    between rounds. Loops and repeated edges are allowed; null ends are ignored; no edges give no rows.
    """
    now = written(
        edges.select(F.col("a").cast("string").alias("u"), F.col("b").cast("string").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = written(small, "edges")
        new = _mark(after)
        drop_written(now)
        now, settled, mark = after, new == mark, new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def assign_splits(groups: DataFrame, shares: DataFrame, seed: str = "17") -> DataFrame:
    """Assign each ``component`` with its ``weight`` to one split, in shares as near as possible.

    ``shares`` has ``split_name, target_share``. The identifier of a component is hashed to a point, and each split has
    one range of points, whose borders are laid so that the components in it weigh what the split is to get: the weight
    at each of ``POINTS`` points is summed in Spark, and the sums are cut at the shares. Only components of at least
    ``HEAVY_SHARE`` of all weight, of which there cannot be more than ``1 / HEAVY_SHARE``, would burst a range; they go
    first, heaviest first, to the split that lacks most, and the ranges of the others narrow to what is then lacking.
    Both rules go by shares of the whole, so they are the same at every size.

    Shares are scaled to sum to 1; splits of null or non-positive share get nothing; repeated names count once, with
    the largest share. Returns ``component, weight, split_name``; null components and weights are ignored, and no
    shares is an error.
    """
    known = shares.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share").cast("double").alias("share"))
    groups = groups.select("component", "weight").dropna()
    # A point is the first 32 bits of a hash that other engines have, too.
    point = F.floor(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "component").cast("binary")), 1, 8), 16, 10).cast("bigint") / (2**32 // POINTS)).cast("bigint")
    total = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("total"))
    placed = groups.withColumn("point", point).withColumn("heavy", F.col("weight") >= total.scalar() * HEAVY_SHARE)
    wanted = {r["split_name"]: r["share"] for r in known.orderBy("split_name").collect()}  # a row per split
    if not wanted:
        raise ValueError("no split has a share above 0")
    weight = float(total.first()[0])
    lacks = {n: s / sum(wanted.values()) * weight for n, s in wanted.items()}
    by_weight: dict[str, str] = {}
    for row in placed.where("heavy").orderBy(F.desc("weight"), "component").collect():  # at most 1 / HEAVY_SHARE rows
        to = max(lacks, key=lambda n: lacks[n])
        lacks[to] -= row["weight"]
        by_weight[row["component"]] = to
    room = {n: max(0.0, x) for n, x in lacks.items()}
    sums = placed.where("not heavy").groupBy("point").agg(F.sum("weight").alias("w")).orderBy("point").collect()  # at most POINTS rows
    borders, upto, left = [], 0.0, list(room.items())
    for at, r in enumerate(sums):
        # The range ends where its weight is nearest to the room.
        while len(left) > 1 and upto + r["w"] / 2 > left[0][1]:
            upto -= left.pop(0)[1]
            borders.append(r["point"])
        upto += r["w"]
    names = list(room)
    by_hash = F.lit(names[len(borders)])
    for name, border in reversed(list(zip(names, borders))):
        by_hash = F.when(F.col("point") < border, F.lit(name)).otherwise(by_hash)
    split = by_hash
    if by_weight:
        split = F.coalesce(F.create_map(*(F.lit(x) for kv in by_weight.items() for x in kv))[F.col("component")], by_hash)
    return placed.select("component", "weight", split.alias("split_name"))
