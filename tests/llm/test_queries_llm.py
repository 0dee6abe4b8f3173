import pytest

from oracle import compare
from uttermill.llm import queries as Q
from uttermill.llm.tokens import token_count


@pytest.mark.parametrize("name", list(Q.SQL))
def test_equals_its_sql(spark, sf_dir, name):
    compare(spark, sf_dir, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL])
def test_gives_rows(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0


def test_speaker_keys(spark):
    same = ["id00000110", "ID00000110", "id-00000110", "id110", "sp0.9-id00000110", "sp1.1-id110", "id00000110_copy-2", " id110 "]
    rows = spark.createDataFrame([(s,) for s in same + ["id1100", "unknown", "id00000110x"]], "spk string").select(Q.speaker_key(Q.F.col("spk")).alias("k")).collect()
    assert len({r["k"] for r in rows[: len(same)]}) == 1 and len({r["k"] for r in rows}) == 4


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a" * 50_000,), ("<|endoftext|>",)], "text string")
    n = [r[0] for r in df.select(token_count(Q.F.col("text"))).collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] > 1_000 and n[4] > 1
