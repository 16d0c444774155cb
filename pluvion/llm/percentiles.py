"""Problem 7: percentiles of very large numeric columns by radix selection.

Doubles become order-preserving integers.  Each round counts one digit of the values that share the digits found so
far, and follows only the digit that holds each target rank; after the last round the value is exact.  Stopping after
fewer digits gives bounds that hold the value, and the counts of separate days or files add up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvion.session import cut

DIGIT_BITS = 16
#: Rows of (group, prefix) that may be sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
SIGN = np.int64(-(2**63))


def ordered_key(value: Column | str) -> Column:
    """Order-preserving integer of a double: as unsigned numbers, keys sort like the values (-0.0 counts as 0.0)."""

    @F.pandas_udf("bigint")
    def key(v: pd.Series) -> pd.Series:
        bits = (v.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(bits < 0, ~bits, bits | SIGN))

    return key(value)


def key_value(key: Column | str) -> Column:
    """The double of a key."""

    @F.pandas_udf("double")
    def value(k: pd.Series) -> pd.Series:
        bits = k.to_numpy(dtype=np.int64)
        v = np.where(bits < 0, bits & ~SIGN, ~bits).view(np.float64)
        return pd.Series(np.where(np.isnan(v), np.where(bits < 0, np.inf, -np.inf), v))  # beyond the infinite values' keys

    return value(key)


def keyed(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, key, n = 1): one row per value; NULL and NaN take no part, infinite values do; a NULL group is a group."""
    v = df.select(*group, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL AND NOT isnan(__v)")
    return v.select(*group, ordered_key("__v").alias("key"), F.lit(1).cast("bigint").alias("n"))


def merge_counts(*counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts of separate days or files, added up: associative and commutative."""
    merged = counts[0]
    for c in counts[1:]:
        merged = merged.unionByName(c)
    keys = [c for c in merged.columns if c != "n"]
    return merged.groupBy(*keys).agg(F.sum("n").alias("n"))


def _digit(key: Column, level: int) -> Column:
    return F.shiftrightunsigned(key, 64 - DIGIT_BITS * (level + 1)).bitwiseAND(2**DIGIT_BITS - 1)


def _histogram(counts: DataFrame, group: Sequence[str], level: int, asked: DataFrame | None) -> DataFrame:
    """(group, __prefix, __digit, n, below): one digit of the values under the prefixes asked for, counted before the shuffle."""
    prefix = F.lit(0).cast("bigint") if level == 0 else F.shiftrightunsigned("key", 64 - DIGIT_BITS * level)
    rows = counts.select(*group, prefix.alias("__prefix"), _digit(F.col("key"), level).alias("__digit"), "n")
    if asked is not None:
        d = rows.alias("d")
        small = asked.count() <= BROADCAST_ROWS
        a = (F.broadcast(asked) if small else asked).alias("a")
        rows = d.join(a, [*[F.col(f"d.{g}").eqNullSafe(F.col(f"a.{g}")) for g in group], F.col("d.__prefix") == F.col("a.__prefix")], "left_semi")
    rows = rows.groupBy(*group, "__prefix", "__digit").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*group, "__prefix").orderBy("__digit")  # at most 2^DIGIT_BITS rows
    return rows.withColumn("below", F.sum("n").over(run) - F.col("n"))


def select_ranks(counts: DataFrame, group: Sequence[str], targets: DataFrame, digits: int = 64 // DIGIT_BITS, first: DataFrame | None = None) -> DataFrame:
    """Follow each target (group, rank: 0-based position) through the digits: (group, rank, key).

    A round histograms the next digit of the values whose prefix is still asked for (2^16 at most per prefix, by partial
    sums before the shuffle; the values themselves are not shuffled), and takes for each target the digit where the
    running count passes its rank.  ``first`` is the histogram of the first digit, if it is there already.
    """
    live = targets.withColumns({"__prefix": F.lit(0).cast("bigint"), "__rest": F.col("rank")})

    for level in range(digits):
        asked = live.select(*group, "__prefix").distinct() if level else None
        histogram = (first if level == 0 and first is not None else _histogram(counts, group, level, asked)).alias("h")
        t = live.alias("t")
        hit = (F.col("t.__rest") >= F.col("h.below")) & (F.col("t.__rest") < F.col("h.below") + F.col("h.n"))
        on = [*[F.col(f"t.{g}").eqNullSafe(F.col(f"h.{g}")) for g in group], F.col("t.__prefix") == F.col("h.__prefix"), hit]
        live = t.join(histogram, on, "inner").select(
            *[F.col(f"t.{g}") for g in group], "t.rank",
            F.shiftleft("t.__prefix", DIGIT_BITS).bitwiseOR(F.col("h.__digit")).alias("__prefix"), (F.col("t.__rest") - F.col("h.below")).alias("__rest"),
        )
        live = cut(live)  # used twice in the next round
    return live.select(*group, "rank", F.shiftleft("__prefix", 64 - DIGIT_BITS * digits).alias("key"))


def percentiles(counts: DataFrame, group: Sequence[str], qs: Sequence[float], digits: int = 64 // DIGIT_BITS) -> DataFrame:
    """(group, q, n, low, high) of each percentile, linear between neighbouring ranks.

    With all digits ``low`` = ``high`` = the exact value.  With fewer, low <= value <= high, and for 2 digits (32 bits)
    the bounds differ by a factor of at most 1 + 2^-20.  A group without values gives no row; repeated values and ties
    count as often as they occur.  Between a finite and an infinite value lies the infinite one, between -Infinity and
    Infinity NaN.  ``counts`` is read once a digit.
    """
    first = cut(_histogram(counts, group, 0, None))
    n = first.groupBy(*group).agg(F.sum("n").alias("n"))
    asked = n.select(*group, "n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("at", F.col("q") * (F.col("n") - 1))
    asked = asked.withColumns({"r0": F.floor("at"), "r1": F.ceil("at")})
    targets = cut(asked.select(*group, F.explode(F.array("r0", "r1")).alias("rank")).distinct())
    found = select_ranks(counts, group, targets, digits, first)
    top = F.col("key") if digits * DIGIT_BITS >= 64 else F.col("key").bitwiseOR(2 ** (64 - DIGIT_BITS * digits) - 1)
    found = found.select(*group, "rank", key_value("key").alias("v0"), key_value(top).alias("v1"))
    at = lambda i: found.select(*[F.col(g).alias(f"__{i}{g}") for g in group], F.col("rank").alias(f"__rank{i}"), F.col("v0").alias(f"low{i}"), F.col("v1").alias(f"high{i}"))
    out = asked
    for i in (0, 1):
        out = out.join(at(i), [*[F.col(g).eqNullSafe(F.col(f"__{i}{g}")) for g in group], F.col(f"r{i}") == F.col(f"__rank{i}")], "left")
    part = F.col("at") - F.col("r0")
    mix = lambda a, b: F.when((part == 0) | (F.col(a) == F.col(b)), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * part)
    return out.select(*group, "q", "n", mix("low0", "low1").alias("low"), mix("high0", "high1").alias("high"))


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """(group, q, n, value): exact percentiles of a column per group by radix selection over all 64 bits."""
    p = percentiles(keyed(df, group, value), group, qs)
    return p.select(*group, "q", "n", F.col("low").alias("value"))


def digit_histogram(counts: DataFrame, group: Sequence[str], digits: int = 2) -> DataFrame:
    """The combinable form: (group, key, n) by the first digits only (relative error 2^-20 for 2)."""
    keep = 64 - DIGIT_BITS * digits
    return counts.groupBy(*group, F.shiftleft(F.shiftrightunsigned("key", keep), keep).alias("key")).agg(F.sum("n").alias("n"))
