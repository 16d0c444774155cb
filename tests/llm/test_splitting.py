"""Problem 10: limits, whole cover, overlap, boundaries."""

import random

import pytest

from pluvion.llm.pieces import VOCABULARY, encoding
from pluvion.llm.splitting import split_oversized, split_text


def check(text, limit, overlap):
    enc = encoding(VOCABULARY)
    pieces = split_text(text, limit, overlap, VOCABULARY)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for i, (s, e, n, shared, _) in enumerate(pieces):
        assert s < e and n == len(enc.encode_ordinary(text[s:e])) <= limit
        if i:
            assert pieces[i - 1][0] < s <= pieces[i - 1][1] < e and shared <= overlap
    return pieces


@pytest.mark.parametrize("text", ["x" * 3000, "日本" * 900, " " * 4000, "\n" * 2000 + "x\n" * 900, "a b " * 2000, "$_$" * 900, "word\r\n" * 900, "🙂" * 500, "ab\t\t" * 600])
def test_hard_texts(text):
    check(text, 100, 10)
    check(text, 7, 3)
    check(text, 64, 0)


def test_random_diffs():
    r = random.Random(1)
    for _ in range(15):
        t = "".join(r.choice(["diff --git a/x b/x\n", "@@ -1,2 +3,4 @@ f\n", "\n", "+  foo bar baz\n", "-qux(1, 2)\n", "some words of prose here\n", "   "]) for _ in range(300))
        check(t, 120, 16)


def test_cuts_between_files_first_then_in_the_valley():
    a, b = "the cat sat on the mat with a hat\n", "stocks fell as bond yields rose again\n"
    pieces = check(a * 30 + b * 30, 300, 0)
    assert pieces[1][0] == pytest.approx(len(a) * 30, abs=1)
    t = a * 14 + "diff --git a/y b/y\n" + a * 30
    assert check(t, 200, 0)[1][4] == "file"


def test_operator(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "w " * 900, "x"), (4, "w " * 900, "x"), (5, "y" * 150, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    got = split_oversized(df, 100, 10).toPandas()
    assert set(got.doc_id) == {4} and len(got) % 2 == 0
    assert (got.piece_text.str.len() == got.end_char - got.start_char).all()
    assert split_oversized(df.filter("doc_id > 9"), 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, 10, 10)
