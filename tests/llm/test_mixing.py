from collections import Counter, defaultdict

import pytest

from uttermill.llm.mixing import mix, quotas

TARGETS = "source string, target_share double, max_repeats int, rate double"
DOCS = "doc_id bigint, source string, n_tokens bigint, rank int, at string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


def _targets(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], TARGETS)


def test_shares_and_repeats(spark):
    rows = [(i, " Web" if i % 3 else "web", 20 + i % 300) for i in range(6_000)] + [(10_000 + i, "news", 100 + i) for i in range(400)] + [(20_000 + i, "legal", 50) for i in range(60)]
    copies, plan = mix(_docs(spark, rows), _targets(spark, [("WEB", 0.6, 1), ("news ", 0.3, 3), ("legal", 0.05, 8), ("gone", 0.05, 2)]))
    got = copies.collect()
    tokens, uses, size = defaultdict(int), Counter(), {r[0]: r[2] for r in rows}
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
        uses[r["doc_id"]] += 1
        assert size[r["doc_id"]] == r["n_tokens"]
    whole = sum(tokens.values())
    for s, share in (("web", 0.6 / 0.95), ("news", 0.3 / 0.95), ("legal", 0.05 / 0.95)):
        assert tokens[s] / whole == pytest.approx(share, abs=0.01)
        assert plan[s].share == pytest.approx(share)
    assert max(uses[i] for i, s, _ in rows if s.strip().lower() == "web") == 1
    assert max(uses.values()) <= 8 and len({(r["doc_id"], r["copy_no"]) for r in got}) == len(got)
    # Within a source no text is used two times more often than another.
    legal = [uses[i] for i, s, _ in rows if s == "legal"]
    assert max(legal) - min(legal) <= 1


def test_quotas_with_a_given_total():
    plan = quotas({"a": 1_000, "b": 100, "c": 0}, {"a": (0.5, 2), "b": (0.5, 3), "c": (0.2, 9), "d": (0.1, 1)}, 2_000)
    assert plan["b"].copies == 3.0 and plan["a"].copies == pytest.approx(1.7) and set(plan) == {"a", "b"}
    assert quotas({}, {}) == {} and quotas({"a": 5}, {"a": (0.0, 1)}) == {}
    assert all(isinstance(q.copies, float) for q in quotas({"a": 10}, {"a": (1.0, 4)}).values())


def test_defined_cases(spark):
    rows = [(1, "a", None), (2, None, 5), (3, "a", 7), (3, "a", 7), (None, "a", 7)]
    copies, plan = mix(_docs(spark, rows), _targets(spark, [("a", 1.0, 2), ("a", 0.5, 3), (None, 1.0, 1), ("b", None, 1)]))
    assert plan["a"].max_repeats == 2 and sum(r["n_tokens"] for r in copies.collect()) == 42
    for r, t in (([], [("a", 1.0, 1)]), (rows, [])):
        copies, plan = mix(_docs(spark, r), _targets(spark, t))
        assert copies.count() == 0 and plan == {}
