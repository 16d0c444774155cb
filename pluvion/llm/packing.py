"""Problem 8: items of uneven length into containers of fixed capacity, by best-fit decreasing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.llm.pieces import VOCABULARY, text_token_counts
from pluvion.session import cut


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each row with a text that is not NULL; an empty text has 0 tokens."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(text_token_counts(texts.tolist(), vocabulary))

    return df.filter(F.col(text).isNotNull()).select(key, count(text).alias("n_tokens"))


class OpenBins:
    """Open bins by remaining capacity under a segment tree: finds and moves the tightest bin in logarithmic time."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.base
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._add(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take the bin with the least room that holds ``size``: (room, bin), or None."""
        i = size + self.base
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up to the first right-hand sibling with bins
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.base
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin); equal sizes keep their order."""
    open_bins, of, fill = OpenBins(capacity), np.zeros(len(sizes), dtype=np.int64), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room, number = open_bins.tightest(size) or (capacity, len(fill))
        if number == len(fill):
            fill.append(0)
        fill[number] += size
        of[i] = number
        open_bins.put(room - size, number)
    return of, np.array(fill, dtype=np.int64)


def _round(items: DataFrame, number: int, shards: int, capacity: int) -> DataFrame:
    key = items.columns[0]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", key, "part"], ascending=[False, True, True], kind="stable")
        of, fill = best_fit_decreasing(group["n_tokens"].to_numpy(), capacity)
        return group[[key, "part", "token_start", "n_tokens"]].assign(bin_id=(number << 58) + (group["shard"].to_numpy(dtype=np.int64) << 24) + of, fill=fill[of])

    kind = dict(items.dtypes)[key]
    sharded = items.withColumn("shard", F.pmod(F.xxhash64(key, "part"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(pack, f"{key} {kind}, part bigint, token_start bigint, n_tokens bigint, bin_id bigint, fill bigint")


def pack(sizes: DataFrame, capacity: int = 4096, shard_items: int = 10_000, tight: float = 0.99) -> DataFrame:
    """(key, part, token_start, n_tokens, bin_id, fill) of ``sizes`` (key, n_tokens): a bin for every item.

    Only an item above the capacity is divided, into full parts and a rest.  Items are dealt to shards of about
    ``shard_items`` by hash (each a fair sample of all lengths), and each shard is packed by best-fit decreasing.  The
    items of bins filled below ``tight`` (the last of each shard) are dealt to fewer shards and packed once more, so
    that splitting the work costs a part of one bin per ``shard_items`` items.

    NULL or negative sizes give no row, size 0 is an item, repeated rows are items of their own, an empty table gives
    no rows.
    """
    key = sizes.columns[0]
    parts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr(f"cast(ceil(n_tokens / {capacity}) AS bigint) - 1"), F.lit(0).cast("bigint")))
    items = sizes.filter("n_tokens >= 0").select(key, "n_tokens", F.explode(parts).alias("part")).withColumn("token_start", F.col("part") * capacity)
    items = cut(items.select(key, "part", "token_start", F.least(F.col("n_tokens") - F.col("token_start"), F.lit(capacity).cast("bigint")).alias("n_tokens")))
    shards = max(1, math.ceil(items.count() / shard_items))
    first = cut(_round(items, 0, shards, capacity))
    if shards == 1:
        return first
    loose = F.col("fill") < int(tight * capacity)
    left = first.filter(loose).select(key, "part", "token_start", "n_tokens")
    return first.filter(~loose).unionByName(_round(left, 1, max(1, math.ceil(left.count() / shard_items)), capacity))
