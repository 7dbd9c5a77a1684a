"""Packing plans and placements."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litloom.llm.containers import DEFAULT_VOCABULARY, fill_containers, plan_containers, tokenizer


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=25))
def test_plan_uses_every_item_once(counts):
    used = Counter()
    for n, combo in plan_containers(counts, 50):
        assert n > 0 and sum(x * k for x, k in combo.items()) <= 50
        for x, k in combo.items():
            used[x] += n * k
    assert used == Counter({x: c for x, c in counts.items() if c})


def test_plan_fills_well():
    rng = random.Random(0)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(50_000))
    steps = plan_containers(counts, 2048)
    containers, tokens = sum(n for n, _ in steps), sum(x * c for x, c in counts.items())
    assert containers <= tokens / 2048 * 1.005 + 1 and len(steps) < 3 * 2048
    assert sum(n for n, c in plan_containers({1000: 500, 1048: 500}, 2048)) == 500


def test_placement(spark):
    texts = ["one two three", "word " * 500, None, "", "  \n", "word " * 130, "a", "a", "long text here " * 400]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(6, "a", 5)], "doc_id long, text string, tokens int")
    rows = fill_containers(df, "doc_id", "text", 128).collect()
    encode = tokenizer(DEFAULT_VOCABULARY).encode_ordinary
    per: dict = {}
    for r in rows:
        per.setdefault(r.id, []).append((r.part, r.token_start, r.tokens))
    assert set(per) == {0, 1, 5, 6, 7, 8} and len(per[6]) == 2
    for i in (0, 1, 5, 8):
        parts, at = sorted(per[i]), 0
        for k, (part, start, n) in enumerate(parts):
            assert part == k and start == at
            at += n
        assert at == len(encode(texts[i])) and all(n == 128 for _, _, n in parts[:-1])
    load = Counter()
    for r in rows:
        load[r.container] += r.tokens
    assert max(load.values()) <= 128 and len(load) <= sum(load.values()) / 128 + 1.5
    assert len({(r.container, r.slot) for r in rows}) == len(rows)
    assert fill_containers(df.limit(0), "doc_id", "text", 128).count() == 0


@pytest.mark.parametrize("buckets", [1, 7])
def test_hot_length(spark, buckets):
    df = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, 'same words here', repeat('w ', cast(1 + id % 37 as int))) text")
    rows = fill_containers(df, "doc_id", "text", 64, buckets=buckets).collect()
    assert len(rows) == 900 and len({r.id for r in rows}) == 900 and len({(r.container, r.slot) for r in rows}) == 900
