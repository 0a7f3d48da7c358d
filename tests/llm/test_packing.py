import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import packing


def contents(plan):
    """Container → lengths, from the rules."""
    out = {}
    for length, rules in plan.rules.items():
        for rank, n, first, per in rules:
            for r in range(n):
                out.setdefault(first + r // per, []).append(length)
    return out


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=40), st.integers(64, 70))
@settings(deadline=None, max_examples=150)
def test_plan_places_everything_within_the_capacity(histogram, capacity):
    plan = packing.plan(histogram, capacity)
    got = contents(plan)
    placed = {}
    for lengths in got.values():
        assert sum(lengths) <= capacity
        for x in lengths:
            placed[x] = placed.get(x, 0) + 1
    assert placed == {k: v for k, v in histogram.items() if v}
    assert set(got) == set(range(plan.containers))


def first_fit_decreasing(items, capacity):
    gaps = []
    for x in sorted(items, reverse=True):
        for i, g in enumerate(gaps):
            if g >= x:
                gaps[i] -= x
                break
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_little_space_is_unused(seed):
    rnd = random.Random(seed)
    items = [min(512, max(1, int(rnd.lognormvariate(4.5, 1)))) for _ in range(3000)]
    histogram = {}
    for x in items:
        histogram[x] = histogram.get(x, 0) + 1
    assert packing.plan(histogram, 512).containers <= 1.02 * first_fit_decreasing(items, 512)


def test_least_squares():
    rnd = np.random.default_rng(1)
    a, x = rnd.random((8, 20)), np.maximum(rnd.normal(size=20), 0)
    got = packing.non_negative_least_squares(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)
    assert packing.non_negative_least_squares(np.zeros((3, 0)), np.ones(3)).size == 0


LIMITS = [("pack_a", 10), ("pack_b", 25)]


def test_every_item_gets_a_container(spark, rows):
    rnd = random.Random(3)
    data = [(i, rnd.choice([0, 1, 3, 4, 6, 7, 9, 10, 11, 26, 60])) for i in range(300)] + [(999, None), (5, 4), (5, 4)]
    got = packing.pack(spark.createDataFrame(data, "doc_id bigint, n_tokens bigint"), LIMITS, salts=5).collect()
    for name, capacity in LIMITS:
        mine = [r for r in got if r.limit_name == name]
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n in data)
        space = {}
        for r in mine:
            space[r.container_id] = space.get(r.container_id, 0) + r.n_tokens
        assert max(space.values()) <= capacity
        assert len(mine) == sum(max(1, -(-(n or 0) // capacity)) for _, n in data)
        assert all(r.n_tokens == capacity for r in mine if r.start_token == 0 and sum(x.doc_id == r.doc_id for x in mine) > 1 and r.doc_id != 5)


def test_edges(spark, rows):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert rows(packing.pack(empty, LIMITS)) == []
    zeros = packing.pack(spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, n_tokens bigint"), LIMITS[:1])
    assert rows(zeros, "doc_id", "container_id") == [(1, 0), (2, 0)]
    assert rows(packing.pack(zeros.select("doc_id", "n_tokens"), [])) == []
    with pytest.raises(ValueError):
        packing.pack(empty, [("x", 0)])
