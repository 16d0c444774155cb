"""Problem 8: best fit against a plain search, nothing lost, little unused."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pluvion.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 37), max_size=60), st.integers(37, 64))
def test_best_fit_is_the_tightest(sizes, capacity):
    of, fill = packing.best_fit_decreasing(np.array(sizes, dtype=np.int64), capacity)
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [(capacity - f - s, -i) for i, f in enumerate(bins) if f + s <= capacity]
        if fits:
            room = min(fits)[0]
            bins[next(i for i, f in enumerate(bins) if capacity - f - s == room)] += s
        else:
            bins.append(s)
    assert sorted(fill.tolist()) == sorted(bins)
    assert [int(sum(s for s, b in zip(sizes, of) if b == k)) for k in range(len(fill))] == fill.tolist()


def test_pack(spark):
    r = random.Random(1)
    rows = [(i, int(r.lognormvariate(4, 1.3)), "x") for i in range(3000)] + [(5000, 0, "x"), (5001, None, "x"), (5002, -3, "x"), (5003, 2500, "x"), (5003, 2500, "x"), (None, 7, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, part string"), 1000, shard_items=800).toPandas()
    per = got.groupby("bin_id").agg(n=("n_tokens", "sum"), fill=("fill", "first"))
    assert (per.n == per.fill).all() and per.n.max() <= 1000
    whole = [s for _, s, _ in rows if s is not None and s >= 0]
    assert got.n_tokens.sum() == sum(whole) and len(got) == sum(max(1, math.ceil(s / 1000)) for s in whole)
    big = got[got.doc_id == 5003].sort_values(["part"])
    assert big.n_tokens.tolist() == [1000, 1000, 1000, 1000, 500, 500] and big.token_start.tolist() == [0, 0, 1000, 1000, 2000, 2000]
    assert len(per) <= math.ceil(sum(whole) / 1000) + 3


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 10).count() == 0
    counts = packing.token_counts(spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id bigint, text string"))
    assert sorted(map(tuple, counts.collect())) == [(2, 0), (3, 2)]
