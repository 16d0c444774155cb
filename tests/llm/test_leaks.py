"""Problem 9 on made cases and against a plain search."""

import random

import numpy as np
import pytest

from pluvion.llm import leaks as lk

R = random.Random(7)
WORDS = ["".join(R.choice("bcdfgklmnprst") + R.choice("aeiou") for _ in range(R.randint(2, 4))) for _ in range(900)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def changed(ws, every, seed):
    r = random.Random(seed)
    return [r.choice(WORDS).upper() + "q" if i % every == every // 2 else w for i, w in enumerate(ws)]


ITEMS = {k: words(120, k) for k in range(1, 7)}
NOTICE = words(45, 99)
NOISE = lambda s, n=60: " ".join(words(n, s))


def corpus():
    docs = {}
    docs[10] = (f"{NOISE(200)} {' '.join(ITEMS[1][20:50])} {NOISE(201)}", {1})
    docs[11] = ("\n".join("+  // " + " ".join(ITEMS[2][i : i + 6]).upper() + "!" for i in range(0, 48, 6)), {2})
    docs[12] = ('{"t": "' + "\\n\\t".join(ITEMS[3][:40]) + '"}', {3})
    docs[13] = (" &gt; ".join(ITEMS[4][30:70]), {4})
    docs[14] = (f"{NOISE(202)} {' '.join(changed(ITEMS[5][10:60], 10, 1))}", {5})
    docs[15] = (f"{' '.join(ITEMS[1][:18])} {NOISE(203)} {' '.join(ITEMS[1][60:80])}", set())  # under 25 words each
    docs[16] = (" ".join(changed(ITEMS[2][:100], 3, 2)), set())  # every third word changed
    docs[17] = (" ".join(ITEMS[6][:30] + words(20, 5) + ITEMS[3][70:110]), {6, 3})
    docs[18] = (None, set())
    docs[19] = ("", set())
    for i in range(100, 140):
        docs[i] = (f"{NOISE(i)} {' '.join(NOTICE)} {NOISE(i + 500)}", set())
    docs[200] = (NOISE(9, 60_000) + " " + " ".join(ITEMS[4][:26]), {4})
    return docs


def test_cases(spark):
    docs = corpus()
    items = [(k, " ".join(ws[:60] + (NOTICE if k in (1, 2) else []) + ws[60:]), "n") for k, ws in ITEMS.items()] + [(50, None, "n"), (None, "x y", "n"), (51, "", "n"), (52, "too short", "n")]
    d = spark.createDataFrame([(k, t, "s") for k, (t, _) in docs.items()] + [(10, docs[10][0], "again")], "doc_id bigint, text string, hash string")
    i = spark.createDataFrame(items, "item_id bigint, text string, words string")
    got = lk.leaks(d, i).toPandas()
    want = {(k, x) for k, (_, xs) in docs.items() for x in xs}
    assert set(zip(got.doc_id, got.item_id)) == want and len(got) == len(want) and set(got.kind) == {"copy"}
    row = got[got.doc_id == 14].iloc[0]
    assert row.changed == pytest.approx(row.words / 10, abs=1.5) and row.consistent
    assert lk.leaks(d.filter("doc_id < 0"), i).count() == 0 == lk.leaks(d, i.filter("item_id < 0")).count()


def test_numbers_are_slots_with_consistent_replacements(spark):
    base = "a train leaves at {a} and runs {b} km while another leaves at {a} and runs until it meets the first after {b} km on the same old line near the river".split()
    item = " ".join(base).format(a=7, b=90)
    d = spark.createDataFrame([(1, " ".join(base).format(a=8, b=75)), (2, item.replace("7", "8", 1))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lk.leaks(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got[1]["changed"] == 4 and got[1]["replacements"] == 2 and got[1]["consistent"]
    assert got[1]["kind"] == "reparameterised" and got[2]["kind"] == "copy" and got[2]["changed"] <= 1


def test_masked_escapes():
    t = 'a\\nb\\u00e9c %20d &amp;e &#39;f x\\y "%d" AT&T; \\'
    p = lk.code_points(t)
    kept = "".join(c if not m else "." for c, m in zip(t, lk.masked(p)))
    assert kept == 'a\\.b\\.....c %..d &...;e &...;f x\\y "%d" AT&.; \\'
    assert lk.masked(lk.code_points("")).size == 0


def test_compare_cuts_notices_and_finds_the_best_run():
    item = np.arange(100)
    text = np.concatenate([np.full(10, -1), item[20:60], np.full(5, -2)])
    assert lk.compare(text, item, -10, np.zeros(0, int))[:3] == (20, 40, 0)
    assert lk.compare(text, item, -10, np.arange(30, 50))[1] == 10  # words 30 to 53 are a notice
    assert lk.compare(text, item, 500, np.zeros(0, int))[1] == 0
