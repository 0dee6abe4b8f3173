from datetime import datetime

from uttermill.operators.references import orphan_references, orphan_report

T = [datetime(2024, m, 1) for m in range(1, 13)]
REF = "k string, a string, b string, loaded_at timestamp, rank int, first string, there string"
TARGET = "a string, b string, loaded_at timestamp, removed_at timestamp, gone int"


def _ref(spark, rows):
    return spark.createDataFrame([(k, a, b, t, 1, "x", "y") for k, a, b, t in rows], REF)


def _target(spark, rows):
    return spark.createDataFrame([(a, b, t, r, 7) for a, b, t, r in rows], TARGET)


def _found(df):
    return {(r["k"], r["reason"], r["first_loaded_at"]) for r in df.collect()}


def test_reasons_and_earliest_time(spark):
    refs = _ref(spark, [("1", "x", None, T[5]), ("1", "x", None, T[2]), ("2", "gone", None, T[3]), ("3", "late", None, T[1]), ("4", "ok", None, T[6]), ("5", "back", None, T[6])])
    targets = _target(spark, [("gone", None, T[0], T[1]), ("gone", None, T[2], T[3]), ("late", None, T[4], None), ("ok", None, T[0], None), ("back", None, T[0], T[1]), ("back", None, T[2], None)])
    found = _found(orphan_references(refs, targets, [("a", "a")], "k"))
    assert found == {("1", "missing", T[2]), ("2", "deleted", T[3]), ("3", "late", T[1])}


def test_own_key_as_reference(spark):
    refs = _ref(spark, [("x", None, None, T[1]), ("x", None, None, T[0]), (None, None, None, T[0]), ("y", None, None, None)])
    found = _found(orphan_references(refs, _target(spark, [("y", None, T[0], None)]), [("k", "a")], "k"))
    assert found == {("x", "missing", T[0])}


def test_composite_keys_by_null_mask(spark):
    refs = _ref(spark, [("1", "p", "q", T[0]), ("2", "p", None, T[0]), ("3", None, "z", T[0]), ("4", None, None, T[0]), ("5", "p", "z", T[0])])
    targets = _target(spark, [("p", "q", T[0], None)])
    keys = [("a", "a"), ("b", "b")]
    assert _found(orphan_references(refs, targets, keys, "k")) == {("5", "missing", T[0])}
    assert _found(orphan_references(refs, targets, keys, "k", match="full")) == {("5", "missing", T[0]), ("2", "incomplete", T[0]), ("3", "incomplete", T[0])}
    assert _found(orphan_references(refs, targets, keys, "k", match="partial")) == {("5", "missing", T[0]), ("3", "missing", T[0])}


def test_empty_tables(spark):
    assert _found(orphan_references(_ref(spark, []), _target(spark, []), [("a", "a")], "k")) == set()
    assert _found(orphan_references(_ref(spark, [("1", "x", None, None)]), _target(spark, []), [("a", "a")], "k")) == {("1", "missing", None)}


def test_report_counts(spark):
    rows = spark.createDataFrame([("t", "2024-01", "late"), ("t", "2024-01", "late"), ("u", "2024-01", "late")], "ref_table string, load_month string, reason string")
    assert {(r["ref_table"], r["n_keys"]) for r in orphan_report(rows).collect()} == {("t", 2), ("u", 1)}
