"""Problem 9: no number of texts, no other run and no margin loses a passage."""

import random

import numpy as np
import pytest

from pluvion.llm import leaks as lk

NONE = np.zeros(0, int)
R = random.Random(23)
VOCABULARY = ["".join(R.choice("bcdfgklmnprst") + R.choice("aeiou") for _ in range(4)) for _ in range(3000)]
words = lambda n: [R.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def found(spark):
    """(item, text) found and wanted of leaks in many contexts and of passages at the edge of what counts."""
    notice, docs, want, items = words(45), {}, set(), {}

    def plant(passage, item=None):
        docs[len(docs)] = words(30) + passage + words(30)
        if item:
            want.add((item, len(docs) - 1))

    items[1], items[2], items[3] = notice + words(60), words(30) + notice + words(30), notice + words(50)
    items[4], items[5] = words(120), words(120)
    for _ in range(90):
        plant(notice)
    for _ in range(60):  # without the notice, and around it
        plant(items[1][45:], 1)
        plant(items[2], 2)
        plant(items[4][9:70], 4)  # one of many parts
        plant(items[5][9:70])  # always the same part: a notice
    for k in range(70):
        plant(items[4][k % 35 : 50 + k], 4)
    items[6] = words(60)  # ten words, then three times a changed one and four more
    plant(items[6][20:30] + ["x"] + items[6][31:35] + ["y"] + items[6][36:40] + ["z"] + items[6][41:45], 6)
    items[7] = words(80)
    plant([w for i, w in enumerate(items[7][10:44]) if i not in (10, 14, 18, 22)], 7)
    items[8] = words(80)
    plant(items[8][10:34] + items[8][40:64], 8)
    items[9] = words(80)  # a run without change, then a passage with changes
    plant(items[9][:24] + words(10) + items[9][34:42] + ["x"] + items[9][43:51] + ["y"] + items[9][52:59], 9)
    items[10] = words(30) + ["0"] * 30
    plant(["0"] * 100, 10)
    d = spark.createDataFrame([(k, " ".join(ws)) for k, ws in docs.items()], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id bigint, text string")
    return {(r["item_id"], r["doc_id"]) for r in lk.leaks(d, i).collect()}, want


@pytest.mark.parametrize("item", range(1, 11))
def test_every_leak_of_an_item(found, item):
    got, want = ({k for i, k in pairs if i == item} for pairs in found)
    assert got == want


def test_the_longest_passage_lies_beside_a_run_that_scores_more():
    item = np.arange(1000, 1100) * 4
    text = item.copy()
    text[24:34], text[59:], text[[42, 51]] = -4, -4, -8
    assert lk.compare(text, item, 0, NONE)[:3] == (34, 25, 2)


def test_words_put_in_before_a_passage_are_no_part_of_it():
    item = np.arange(1000, 1040) * 4
    text = np.concatenate([item[:10], np.full(12, -4), item[10:35]])
    assert lk.compare(text, item, np.where(np.arange(40) < 10, 0, 12), NONE)[:3] == (10, 25, 0)


def test_the_longest_part_with_consistent_replacements():
    item = np.arange(1000, 1100) * 4
    item[[10, 40, 60]] = 4001
    text = item.copy()
    text[[10, 40, 60]] = 5001, 6001, 6001
    assert lk.compare(text, item, 0, NONE, slots_free=True) == (11, 89, 2, 1, True)


def test_leaks_within_a_part_of_two_items(spark):
    shared, docs = words(60), {}
    item = shared + words(30)
    while len(docs) < 200:
        a, b = R.randint(0, 90), R.randint(0, 90)
        if b - a >= 25:
            docs[len(docs)] = " ".join(words(30) + item[a:b] + words(30))
    d = spark.createDataFrame([*docs.items()], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(shared + words(30)))], "item_id bigint, text string")
    assert {r["doc_id"] for r in lk.leaks(d, i).filter("item_id = 1").collect()} == set(docs)
