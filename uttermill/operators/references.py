"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are tested.
REASONS = ("incomplete", "missing", "deleted", "late")


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    keys: Sequence[tuple[str, str]],
    own_key: str,
    loaded_at: str = "loaded_at",
    target_loaded_at: str = "loaded_at",
    target_removed_at: str | None = "removed_at",
    match: str = "simple",
) -> DataFrame:
    """Find the records whose reference points at nothing, at something deleted, or at something that came later.

    ``keys`` pairs each referring column with the column it refers to; the referring columns together are one
    composite key. References are grouped by which of their columns are null, and each group meets the targets on its
    non-null columns only. ``match`` says what a null means, as in SQL foreign keys: ``simple`` checks only complete
    keys; ``full`` lets a key be null as a whole and reports a part-null one as ``incomplete``; ``partial`` compares
    the non-null columns with any target.

    Returns ``own_key STRING, reason STRING, first_loaded_at TIMESTAMP``: one row per own key in fault. A key with
    several references gets its first reason in the order of ``REASONS`` and the earliest time over all of its rows.

    Both sides are reduced to one row per key before they meet, so repeats of a hot key never reach the join. Defined
    cases: a null own key is reported under null like any other key; null load times count as unknown (never late,
    earliest time null if there is no other); an empty target table makes every checked reference ``missing``; empty
    references give no rows; repeated rows count once; other columns, whatever their names, are ignored.
    """
    if match not in ("simple", "full", "partial"):
        raise ValueError(f"match must be simple, full or partial, not {match!r}")
    n = len(keys)
    if not 1 <= n <= 5:
        raise ValueError("a reference has 1 to 5 columns")
    ref_cols, target_cols = [f"r{i}" for i in range(n)], [f"t{i}" for i in range(n)]
    itself = [own_key] == [a for a, _ in keys]  # each own key is one reference, so one column and one row serve as both
    own = references.select(F.col(own_key).alias("own"), *(F.col(a).alias(r) for (a, _), r in zip(keys, ref_cols) if not itself), F.col(loaded_at).alias("first"))
    own = own.groupBy("own", *(r for r in ref_cols if not itself)).agg(F.min("first").alias("first"))
    if itself:
        own = own.select("own", F.col("own").alias("r0"), "first")
    removed = F.lit(False) if target_removed_at is None else F.col(target_removed_at).isNotNull()
    there = targets.select(
        *(F.col(b).alias(t) for (_, b), t in zip(keys, target_cols)),
        F.col(target_loaded_at).alias("there_from"),
        removed.alias("gone"),
    )
    judged = [_judged(own, there, ref_cols, target_cols, mask, match) for mask in product((True, False), repeat=n)]
    ranked = reduce(DataFrame.unionAll, [x for x in judged if x is not None])
    found = ranked if itself else ranked.groupBy("own").agg(F.min("rank").alias("rank"), F.min("first").alias("first"))
    return found.where(F.col("rank").isNotNull()).select(
        F.col("own").cast("string").alias(own_key),
        F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank")).alias("reason"),
        F.col("first").alias("first_loaded_at"),
    )


def _judged(
    own: DataFrame, there: DataFrame, refs: list[str], targets: list[str], mask: tuple[bool, ...], match: str
) -> DataFrame | None:
    """``own, first, rank`` of the references whose non-null columns are exactly those in the mask; rank is null if all is well."""
    has = reduce(Column.__and__, [F.col(r).isNotNull() if m else F.col(r).isNull() for r, m in zip(refs, mask)])
    rows = own.where(has)
    if not any(mask) or (match == "simple" and not all(mask)):
        return rows.select("own", "first", F.lit(None).cast("int").alias("rank"))
    if match == "full" and not all(mask):
        return rows.select("own", "first", F.lit(1).alias("rank"))
    on = [(r, t) for r, t, m in zip(refs, targets, mask) if m]
    some = there.where(reduce(Column.__and__, [F.col(t).isNotNull() for _, t in on]))
    some = some.groupBy(*(t for _, t in on)).agg(
        F.min("there_from").alias("there_from"), F.min("gone").alias("gone"), F.lit(True).alias("there")
    )
    met = rows.join(some, reduce(Column.__and__, [F.col(r) == F.col(t) for r, t in on]), "left")
    rank = (
        F.when(F.col("there").isNull(), F.lit(2))
        .when(F.col("gone"), F.lit(3))
        .when(F.col("there_from") > F.col("first"), F.lit(4))
    )
    return met.select("own", "first", rank.cast("int").alias("rank"))


def orphan_report(found: DataFrame, table_col: str = "ref_table", period_col: str = "load_month") -> DataFrame:
    """Orphans counted per table, period and reason."""
    return found.groupBy(table_col, period_col, "reason").agg(F.count(F.lit(1)).alias("n_keys"))
