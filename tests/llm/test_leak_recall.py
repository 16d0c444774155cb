"""Problem 9: planted leaks of every kind and frequency are found, notices are not."""

import random

import numpy as np
import pytest

from pluvion.llm import leaks as lk

R = random.Random(11)
VOCABULARY = ["".join(R.choice("bcdfgklmnprst") + R.choice("aeiou") for _ in range(R.randint(2, 4))) for _ in range(1500)]
words = lambda n: [R.choice(VOCABULARY) for _ in range(n)]
numbers = lambda n: [str(R.randint(0, 99999)) for _ in range(n)]


def altered(ws, share, ways=("change", "insert", "drop")):
    """Every 1 / share words one is changed, put in or left out."""
    out, step = [], round(1 / share) if share else 0
    for i, w in enumerate(ws):
        way = R.choice(ways) if step and i % step == step // 2 else ""
        out += {"": [w], "change": ["q" + w], "insert": [w, R.choice(VOCABULARY)], "drop": []}[way]
    return out


@pytest.fixture(scope="module")
def planted():
    items, docs, want = {}, {k: words(R.randint(60, 200)) for k in range(600)}, set()
    free = iter(R.sample(range(600), 600))

    def plant(item, passage, copies):
        for _ in range(copies):
            d = next(free)
            cut = R.randint(0, len(docs[d]))
            docs[d] = docs[d][:cut] + passage() + docs[d][cut:]
            want.add((d, item))

    for item, copies in ((1, 5), (2, 12), (3, 30)):  # whole items, up to 5 % of the texts
        items[item] = words(60)
        plant(item, lambda ws=items[item]: ws, copies)
    items[4] = numbers(60)
    plant(4, lambda: items[4], 3)
    items[5] = words(40)
    plant(5, lambda: items[5][:20] + ["inserted"] + items[5][20:], 1)
    for item, share, ways in ((6, 0.05, ("change",)), (7, 0.1, ("change",)), (8, 0.1, ("insert",)), (9, 0.1, ("drop",)), (10, 0.1, ("change", "insert", "drop"))):
        items[item] = words(70)
        plant(item, lambda ws=items[item], s=share, w=ways: altered(ws, s, w), 8)
    items[11] = ["0", "1"] * 20 + words(30)
    plant(11, lambda: items[11][:40], 2)
    notice = words(45)
    for item in (20, 21, 22):
        own = words(60)
        items[item] = own[:30] + notice + own[30:]
    for _ in range(40):  # the notice, alone
        d = next(free)
        docs[d] = docs[d][:30] + notice + docs[d][30:]
    for item in (20, 21):  # the items' own words
        plant(item, lambda ws=items[item]: ws[:28], 2)
    return items, docs, want


def test_every_planted_leak(spark, planted):
    items, docs, want = planted
    d = spark.createDataFrame([(k, " ".join(ws)) for k, ws in docs.items()], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()] + [(102, " ".join(items[2]))], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in lk.leaks(d, i).filter("kind = 'copy'").collect()}
    assert got == want | {(k, 102) for k, item in want if item == 2}


def test_a_notice_of_one_item(spark):
    notice, own = words(40), words(60)
    docs = [(k, " ".join(words(20) + notice + words(20))) for k in range(60)] + [(100, " ".join(own[:30]))]
    i = spark.createDataFrame([(1, " ".join(own + notice))], "item_id bigint, text string")
    got = lk.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), i).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(100, 1)]


def test_the_filter_holds_every_hash(spark):
    h = np.random.default_rng(3).integers(-(2**63), 2**63, 5000)
    f = lk.HashFilter(spark.createDataFrame([(int(x),) for x in h], "hash bigint"), 5000)
    other = np.random.default_rng(4).integers(-(2**63), 2**63, 50_000)
    assert f.holds(h.view(np.uint64)).all() and f.holds(other.view(np.uint64)).mean() < 0.01


def test_aligned_paths_cost_what_is_put_in():
    item = np.arange(100, 140) * 4
    text = np.concatenate([item[:20], [-4], item[20:]])
    path = lk.aligned(text, item, np.array([0, 1]))
    assert path.tolist() == [0] * 20 + [1] * 20
    assert lk.compare(text, item, path, np.zeros(0, int))[:3] == (0, 40, 1)
    gone = np.concatenate([item[:20], item[21:]])
    assert lk.compare(gone, item, lk.aligned(gone, item, np.array([-1, 0])), np.zeros(0, int))[:3] == (0, 40, 1)
