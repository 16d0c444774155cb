"""Problem 9: widely copied commits are leaks, notices in otherwise different commits are not."""

import random

from pluvion.llm import leaks as lk

R = random.Random(3)
VOCABULARY = ["".join(R.choice("bcdfgklmnprst") + R.choice("aeiou") for _ in range(4)) for _ in range(900)]
words = lambda n: [R.choice(VOCABULARY) for _ in range(n)]


def test_copies_of_a_third_of_the_rows(spark):
    notice, item = words(45), words(60)
    leak = " ".join(words(40) + item[5:50] + words(40))
    docs = {k: " ".join(words(80)) for k in range(40)} | {k: leak for k in range(100, 130)}
    docs |= {k: f"{' '.join(words(30))} {leak}" for k in range(130, 140)}  # another header
    docs |= {k: " ".join(words(30) + notice + words(30)) for k in range(200, 220)}
    d = spark.createDataFrame([*docs.items()], "doc_id bigint, text string")
    got = lk.leaks(d, spark.createDataFrame([(1, " ".join(item + notice)), (2, " ".join(notice + words(30)))], "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in got) == [(k, 1, "copy") for k in range(100, 140)]
