"""Problem 10: oversized texts cut at natural boundaries, where lexical cohesion is lowest, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.llm.pieces import DIGIT, VOCABULARY, classes, code_points, counter, encoding, span_hashes, text_token_counts

FILE, HUNK, PARAGRAPH, LINE, INSIDE = "file", "hunk", "paragraph", "line", "inside"
LEVEL = {FILE: 3, HUNK: 2, PARAGRAPH: 1, LINE: 0}
OPENERS = [ord(c) for c in "dIFc@-*"]  #: first characters of headers
WEIGHT = np.array([1.0, 1.1, 1.2, 1.3])  #: by which a boundary's level multiplies the depth of its valley
BLOCK = 8  #: lines on each side of a boundary that are compared


@cache
def openings() -> tuple[re.Pattern, re.Pattern]:
    return re.compile(r"diff --git |diff -|Index: |From [0-9a-f]{7,40} |commit [0-9a-f]{7,40}\b"), re.compile(r"@@ |---$|--- |\*\*\* ")


def boundaries(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece numbers, levels) where a line ends: the piece that holds the line break opens what follows.

    The level is that of the next line: a file's or record's header, a hunk's header, the first line after an empty
    one, or any other line.
    """
    points = code_points(text)
    breaks = np.flatnonzero((points == 0x0A) | (points == 0x0D))
    if not len(breaks):
        return np.zeros(0, int), np.zeros(0, int)
    piece, first = np.unique(np.searchsorted(starts, breaks, side="right") - 1, return_index=True)
    last = np.append(breaks[first[1:] - 1], breaks[-1])  # the last break in the same run of white space
    level = (np.add.reduceat((points[breaks] == 0x0A).astype(int), first) > 1).astype(int)
    is_file, is_hunk = openings()
    opens = np.append(points, 0)[last + 1]
    for j in np.flatnonzero(np.isin(opens, OPENERS)).tolist():
        at = int(last[j]) + 1
        level[j] = 3 if is_file.match(text, at) else 2 if is_hunk.match(text, at) else level[j]
    keep = piece > 0
    return piece[keep], level[keep]


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word (run of letters and digits), without regard to ASCII case."""
    part = np.concatenate([[False], classes()[points] <= DIGIT, [False]])
    edge = np.flatnonzero(part[1:] != part[:-1])
    upper = (points >= 65) & (points <= 90)
    return edge[::2], span_hashes(np.where(upper, points + np.uint32(32), points).astype(np.uint32), edge[::2], edge[1::2])


def _block_products(line: np.ndarray, word: np.ndarray, count: np.ndarray, size: int, n: int) -> np.ndarray:
    """For j = 0 ... n - 1 the squared length of the word vector of lines j - size + 1 ... j.

    The triples (line, word, count) are sorted by word, then line; two occurrences of a word less than ``size`` lines
    apart meet in the blocks that hold both, a range of j that is added by its two ends.
    """
    change = np.zeros(n + size + 1)
    np.add.at(change, line, count * count)
    np.subtract.at(change, line + size, count * count)
    for lag in range(1, size):
        a, b = slice(None, -lag), slice(lag, None)
        near = np.flatnonzero((word[a] == word[b]) & (line[b] - line[a] < size))
        if not len(near):
            break
        product = 2 * count[near] * count[near + lag]
        np.add.at(change, line[near + lag], product)
        np.subtract.at(change, line[near] + size, product)
    return np.cumsum(change)[:n]


def valley_depths(hashes: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """How deep the similarity of the lines before and after each of ``n`` boundaries lies below its surroundings.

    ``hashes`` are a text's words and ``line`` (0 ... n) the lines that hold them.  The similarity at a boundary is the
    cosine of the word counts of BLOCK lines on each side, and its depth the rise to the highest similarity within BLOCK
    boundaries to the left plus that to the right.
    """
    if not len(hashes) or not n:
        return np.zeros(n)
    order = np.lexsort((line, hashes))
    h, k = hashes[order], line[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]))
    count = np.diff(np.append(new, len(h))).astype(float)
    triples = (k[new], h[new], count)
    one, two = _block_products(*triples, BLOCK, n + BLOCK + 1), _block_products(*triples, 2 * BLOCK, n + BLOCK + 1)
    j = np.arange(n)  # between line j and line j + 1
    before, after, both = one[j], one[j + BLOCK], two[j + BLOCK]
    similar = (both - before - after) / 2 / np.sqrt(np.maximum(before * after, 1e-9))
    view = np.lib.stride_tricks.sliding_window_view(np.pad(similar, BLOCK, mode="edge"), BLOCK + 1).max(axis=1)
    return view[:n] + view[BLOCK : BLOCK + n] - 2 * similar


def split_text(text: str, limit: int, overlap: int, path: str, least: float = 0.5) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, tokens shared with the piece before, kind of boundary before) of each piece of a text.

    Every piece has at most ``limit`` tokens.  Cuts lie where pre-tokens start, so that the pieces' tokens are those of
    the whole text.  Within the window of sizes between ``least`` and all of the room, the boundary in the deepest valley
    counts, where a file's, hunk's or paragraph's start weighs a little more than a line's (WEIGHT), then the higher level,
    then the latest; without one there, the latest line in reach; without a line break, the latest pre-token.  A piece begins with as many pre-tokens before its cut as fit into ``overlap`` tokens.
    """
    starts, counts = counter(path).pieces(text)
    points = code_points(text)
    room = max(1, limit - overlap)
    long = np.flatnonzero(counts > room // 2)
    bound = False
    if len(long):  # runs without any boundary inside: character by character, tokens bounded by bytes
        bound = True
        keep_s, keep_c, done = [], [], 0
        ends = np.append(starts[1:], len(points))
        for k in long.tolist():
            keep_s += [starts[done:k], np.arange(starts[k], ends[k])]
            c = points[starts[k] : ends[k]]
            keep_c += [counts[done:k], 1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)]
            done = k + 1
        starts, counts = np.concatenate([*keep_s, starts[done:]]), np.concatenate([*keep_c, counts[done:]])
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    if total[-1] <= limit:
        return [(0, len(points), int(total[-1]), 0, "")]
    at, level = boundaries(text, starts)
    at_word, hashes = words_of(points)
    line = np.searchsorted(starts[at], at_word, side="right") if len(at) else np.zeros(len(hashes), int)
    depth = valley_depths(hashes, line, len(at))
    position, score = total[at], np.round(depth * WEIGHT[level], 6) + 1e-7 * level
    out, begin, cut, kind, n = [], 0, 0, "", len(starts)
    while True:
        left = limit - int(total[cut] - total[begin])
        if total[n] - total[cut] <= left:
            out.append((begin, n, int(total[cut] - total[begin]), kind))
            break
        a, b = np.searchsorted(position, [total[cut] + least * left, total[cut] + left], side="right")
        a = max(a, int(np.searchsorted(at, cut, side="right")))
        if b > a:
            best = int(b - 1 - np.argmax(score[a:b][::-1]))
        else:
            best = b - 1 if b > 0 and at[b - 1] > cut else -1
        if best >= 0:
            next_cut, next_kind = int(at[best]), {v: k for k, v in LEVEL.items()}[int(level[best])]
        else:
            next_cut, next_kind = max(cut + 1, int(np.searchsorted(total, total[cut] + left, side="right")) - 1), INSIDE
        out.append((begin, next_cut, int(total[cut] - total[begin]), kind))
        begin = max(int(np.searchsorted(total, total[next_cut] - overlap, side="left")), begin + 1)
        begin, cut, kind = min(begin, next_cut), next_cut, next_kind
    chars = np.append(starts, len(points))
    pieces = [(int(chars[i]), int(chars[j]), int(total[j] - total[i]), shared, k) for i, j, shared, k in out]
    if bound:
        pieces = [(i, j, len(encoding(path).encode_ordinary(text[i:j])), shared, k) for i, j, _, shared, k in pieces]
    return pieces


def split_oversized(df: DataFrame, limit: int = 1024, overlap: int = 64, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, start_char, end_char, n_tokens, overlap_tokens, boundary, piece_text) of the texts above ``limit`` tokens.

    Texts of no more bytes than ``limit`` cannot have more tokens and are left out before any Python work; so are NULL
    and empty texts.  Texts under the limit give no row.  Repeated rows give repeated pieces; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    kind = dict(df.dtypes)[key]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            above = text_token_counts(b["t"].tolist(), vocabulary) > limit
            for k, t in zip(b["k"][above].tolist(), b["t"][above].tolist()):
                found = split_text(t, limit, overlap, vocabulary)
                if len(found) > 1:
                    rows += [(k, i, s, e, n, o, w, t[s:e]) for i, (s, e, n, o, w) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["k", "piece", "start_char", "end_char", "n_tokens", "overlap_tokens", "boundary", "piece_text"])

    long = df.filter(F.octet_length(text) > limit).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = long.mapInPandas(pieces, f"k {kind}, piece bigint, start_char bigint, end_char bigint, n_tokens bigint, overlap_tokens bigint, boundary string, piece_text string")
    return out.withColumnRenamed("k", key)
