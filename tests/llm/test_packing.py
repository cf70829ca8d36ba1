from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixturelake.llm.packing import bucket_bounds, pack, plan_containers


def padding(h, bounds):
    return sum(h[s] * (min(b for b in bounds if b >= s) - s) for s in range(1, len(h)) if h[s])


@given(st.lists(st.integers(0, 5), min_size=2, max_size=9), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_bounds_are_optimal(counts, most):
    h = np.array([0, *counts])
    sizes = [s for s in range(1, len(h)) if h[s]]
    got = bucket_bounds(h, most).tolist()
    if sizes:
        assert len(got) <= max(most, 1) and got[-1] == sizes[-1]
        best = min(padding(h, [*c, sizes[-1]]) for k in range(min(most, len(sizes))) for c in combinations(sizes[:-1], k))
        assert padding(h, got) == best
    else:
        assert got == []


@given(st.dictionaries(st.integers(1, 30), st.integers(0, 50), max_size=8))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_item_once_and_overfills_nothing(counts):
    left, n = dict(counts), 0
    for first, times, pattern in plan_containers(counts, 30):
        assert first == n and times >= 1 and sum(b * k for b, k in pattern) <= 30
        n += times
        for b, k in pattern:
            left[b] -= k * times
    assert not any(left.values())


def check(df, sizes, caps, **kw):
    fill, cover = defaultdict(int), defaultdict(list)
    for r in pack(df, "doc_id", "n", caps, **kw).collect():
        fill[r.capacity_id, r.container_id] += r.n_tokens
        cover[r.capacity_id, r.doc_id].append((r.first_token, r.n_tokens))
    for cid, cap in caps:
        assert all(v <= cap for (c, _), v in fill.items() if c == cid)
        for d, n in sizes.items():
            parts = sorted(cover[cid, d])
            assert sum(k for _, k in parts) == (n or 0) and [a for a, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))]
            assert len(parts) == max(1, -(-(n or 0) // cap))
    return fill


@pytest.mark.parametrize("buckets", [512, 5])
def test_in_a_table(spark, buckets):
    rng = np.random.default_rng(3)
    sizes = {i: int(x) for i, x in enumerate(rng.integers(1, 60, 400))} | {1000: None, 1001: 0, 1002: 100, 1003: 200, 1004: 237, 1005: 30_001}
    df = spark.createDataFrame([(d, n, "x") for d, n in sizes.items()], "doc_id long, n int, piece string")
    fill = check(df, sizes, [(1, 100), (2, 7)], buckets=buckets)
    if buckets == 512:
        used = [v for (c, _), v in fill.items() if c == 1]
        assert sum(used) / (100 * len(used)) > 0.97


def test_one_length_fills_everything(spark):
    sizes = dict.fromkeys(range(1000), 10)
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n int")
    assert len(check(df, sizes, [(1, 25)])) == 500


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, n int")
    assert pack(df, "doc_id", "n", [(1, 10)]).count() == 0
    assert pack(spark.createDataFrame([(1, 3)], "doc_id long, n int"), "doc_id", "n", []).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "n", [(1, 0)])
