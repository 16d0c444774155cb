"""The text and percentile operators on hard tables: NULLs, empty and very long texts, ties, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from pluvion.llm import leaks, packing, percentiles, splitting

CLASHES = "doc item t k n_tokens part shard bin_id fill token_start piece words at hash segment first kind key n q rank low high __v __prefix __digit".split()
random.seed(5)
WORDS = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "lan mer tik sol vun dar".split()]
PASSAGE = " ".join(random.choice(WORDS) for _ in range(40))
DOCS = [(1, PASSAGE), (2, None), (3, ""), (4, " \r\n\t"), (5, "x" * 200_000), (6, "word " * 60_000 + PASSAGE.upper()), (7, "\x00퟿😀" * 3_000), (1, PASSAGE), (None, PASSAGE)]
ITEMS = [(10, PASSAGE), (10, PASSAGE), (11, None), (12, ""), (None, PASSAGE), (13, "short text of six words only")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string").cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string").cache()


@pytest.fixture(scope="module")
def operators(items):
    return {
        "leaks": lambda df: leaks.leaks(df, items),
        "pack": lambda df: packing.pack(packing.token_counts(df), 4096),
        "split": lambda df: splitting.split_oversized(df, 256, 16),
    }


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["leaks", "pack", "split"])
def test_clashing_columns_and_empty_tables(operators, docs, name):
    plain = operators[name](docs)
    wide = docs.withColumns({c: F.lit("7") for c in CLASHES})
    assert rows_of(operators[name](wide), *plain.columns) == rows_of(plain)
    assert operators[name](docs.limit(0)).count() == 0
    assert operators[name](docs.filter("text IS NULL")).count() == 0


def test_leaks(operators, docs):
    got = {(r["doc_id"], r["item_id"]) for r in operators["leaks"](docs).collect()}
    assert {(1, 10), (6, 10)} <= got and {i for _, i in got} == {10}
    assert {d for d, _ in got} <= {1, 6, None}
    assert operators["leaks"](docs).groupBy("doc_id", "item_id").count().filter("count > 1").count() == 0


def test_no_items(docs, items):
    assert leaks.leaks(docs, items.limit(0)).count() == 0
    assert leaks.leaks(docs, items.filter("text IS NULL")).count() == 0


def test_a_full_filter_gives_the_same(docs, items):
    assert rows_of(leaks.leaks(docs, items, filter_bits=64)) == rows_of(leaks.leaks(docs, items))


def test_every_item_is_packed_within_capacity(operators, docs):
    out = operators["pack"](docs).collect()
    assert sum(r["doc_id"] == 1 for r in out) == 2 and sum(r["doc_id"] == 3 for r in out) == 1 and not any(r["doc_id"] == 2 for r in out)
    fill = {}
    for r in out:
        fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["n_tokens"]
    assert max(fill.values()) <= 4096


def test_pieces_cover_long_texts(operators, docs):
    texts, pieces = dict(DOCS[:7]), {}
    for r in operators["split"](docs.filter("doc_id > 1")).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start_char"], r["end_char"], r["n_tokens"], r["piece_text"]))
    assert set(pieces) == {5, 6, 7}
    for d, p in pieces.items():
        p.sort()
        assert p[0][1] == 0 and p[-1][2] == len(texts[d]) and all(x[3] <= 256 and x[4] == texts[d][x[1] : x[2]] for x in p)
        assert all(b[1] <= a[2] and b[2] > a[2] for a, b in zip(p, p[1:]))


def test_percentiles_of_hard_values(spark):
    inf = float("inf")
    rows = [("a", 1.0), ("a", 1.0), ("a", None), ("a", float("nan")), ("a", inf), ("a", -inf), ("a", -0.0), ("a", 0.0), (None, 5.0), (None, 7.0), ("only null", None), ("one", -5e-324)]
    df = spark.createDataFrame(rows, "g string, v double").withColumns({c: F.lit("7") for c in CLASHES})
    got = rows_of(percentiles.exact_percentiles(df, ["g"], "v", [0.0, 0.5, 1.0]), "g", "q", "n", "value")
    want = [("a", 0.0, 6, -inf), ("a", 0.5, 6, 0.5), ("a", 1.0, 6, inf), (None, 0.0, 2, 5.0), (None, 0.5, 2, 6.0), (None, 1.0, 2, 7.0), *[("one", q, 1, -5e-324) for q in (0.0, 0.5, 1.0)]]
    assert got == sorted(want, key=repr)
