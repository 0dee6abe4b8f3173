"""Filling fixed-capacity containers with items."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are packed against each other. Every shard is one bounded task, however large the input.
SHARD_ITEMS = 8_192

_PLACED = "item bigint, piece_no int, n_pieces int, first_token bigint, n_tokens bigint, container string"


def balanced(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """A container for each size, given in descending order.

    As many containers as the total needs are open from the start. Each item goes to the one of lowest cost so far
    that still has room for it (ties: the first); where none has, another one is opened. An item costs ``linear * n +
    quadratic * n * n``, the price of attention within it.
    """
    bins = max(1, math.ceil(int(sizes.sum()) / capacity))
    room, cost = np.full(bins, capacity, np.int64), np.zeros(bins)
    out = np.empty(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        fits = np.flatnonzero(room >= n)
        if len(fits):
            k = int(fits[np.argmin(cost[fits])])
        else:
            k = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
        out[i] = k
    return out


def pack(items: DataFrame, capacity: int = 2_048, linear: float = 1.0, quadratic: float = 1.0 / 2_048, seed: int = 29) -> DataFrame:
    """Pack items into containers of ``capacity`` tokens; only items larger than a container are split.

    ``items`` has ``item BIGINT, n_tokens BIGINT``, one row per item; other columns are ignored. It is read twice, so
    it should be a stored table. Returns ``item, piece_no, n_pieces, first_token, n_tokens, container``.

    An oversized item gives full pieces, each a container of its own, and a rest that is packed like any item. Items
    are spread over shards of about ``SHARD_ITEMS`` by hash and packed within each by balanced cost, largest first.
    Null names and sizes are taken as item null and size 0; empty items take part with size 0; repeated rows are packed
    each on its own; an empty table gives no rows.
    """
    rows = items.select(F.col("item").cast("bigint"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    shards = max(1, math.ceil(rows.count() / SHARD_ITEMS))
    n_pieces = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    pieces = (
        rows.withColumn("n_pieces", n_pieces)
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("first_token", F.col("piece_no").cast("bigint") * capacity)
        .withColumn("n_tokens", F.least(F.col("size") - F.col("first_token"), F.lit(capacity)).cast("bigint"))
    )
    full = pieces.where(F.col("n_tokens") == capacity).select(
        "item", "piece_no", "n_pieces", "first_token", "n_tokens", F.format_string("whole-%d-%d", "item", "piece_no").alias("container")
    )
    shard = F.pmod(F.xxhash64("item", "piece_no", F.lit(seed)), F.lit(shards)).cast("int")

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "item", "piece_no"], ascending=[False, True, True])
        at = balanced(pdf["n_tokens"].to_numpy(np.int64), capacity, linear, quadratic)
        pdf["container"] = [f"mixed-{key[0]}-{k}" for k in at]
        return pdf.drop(columns="shard")

    rest = pieces.where(F.col("n_tokens") < capacity).select("item", "piece_no", "n_pieces", "first_token", "n_tokens", shard.alias("shard"))
    return full.unionAll(rest.groupBy("shard").applyInPandas(place, _PLACED))
