import importlib

import pytest

from oracle import compare

MODULES = [importlib.import_module(f"uttermill.plans.{n}") for n in ("corpus", "verification", "datadir", "diarization", "models", "signals", "files")]
WITH_SQL = [(m, n) for m in MODULES for n in m.SQL]
WITHOUT = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.mark.parametrize("module,name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_equals_its_sql(spark, sf_dir, module, name):
    compare(spark, sf_dir, module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize("module,name", WITHOUT, ids=[n for _, n in WITHOUT])
def test_gives_rows(spark, sf_dir, module, name):
    assert module.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n for m in MODULES for n in m.QUERIES} <= names
    assert set(entry.oracle_sql()) <= names
    assert entry.entry(spark).count() > 0
