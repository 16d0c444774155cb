"""Vectorised pre-tokenisation and token counts of a public byte-level BPE vocabulary.

The vocabulary's pattern cuts text into pieces (letters, digits, other marks, white space); each piece is encoded by
itself.  Pieces are found for a whole batch of texts by array operations on code points and hashed; each distinct piece
is encoded once per worker, so that repeated words cost one look-up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np

#: Default vocabulary; every operator takes another path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, DIGIT, OTHER, SPACE = 0, 1, 2, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def classes() -> np.ndarray:
    """Class of every code point: letter, digit, other or white space, as the pattern's engine sees them."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *([0xFFFD] * 0x800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, what in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(what, every):
            out[m.start() : m.end()] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 2**64))
    up, down = np.full(size, MULTIPLIER, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points, by differences of one running polynomial."""
    size = 1 << max(12, int(len(points) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Positions where the pattern's matches start (every character belongs to one match)."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[points]
    run = np.ones(n, dtype=bool)
    run[1:] = kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == SPACE
    # last character of white space before something: a blank joins what follows, another is a piece of its own
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:]
    start |= last
    blank = last & (points == 0x20)
    start[1:] &= ~blank[:-1]
    # contractions: an apostrophe that starts a match and stands alone, then s t m d, or re ve ll
    mark = np.flatnonzero((points == 0x27) & start)
    if len(mark):
        mark = mark[mark + 1 < n]
        follow = points[mark + 1]
        second = points[np.minimum(mark + 2, n - 1)] * (mark + 2 < n)
        one = np.isin(follow, [ord(c) for c in "stmd"])
        two = ((follow == ord("r")) & (second == ord("e"))) | ((follow == ord("v")) & (second == ord("e"))) | ((follow == ord("l")) & (second == ord("l")))
        for chosen, length in ((mark[one], 1), (mark[two], 2)):
            start[chosen + 1] = False
            after = chosen + 1 + length
            start[after[after < n]] = True
    return np.flatnonzero(start)


class TokenCounter:
    """Token counts of pieces, each distinct piece encoded once while the worker lives (at most ``keep`` are remembered)."""

    def __init__(self, path: str, keep: int = 2_000_000):
        self.encoder, self.keep = encoding(path), keep
        self.hashes, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(starts, token counts) of the pieces of a text."""
        points = code_points(text)
        starts = piece_starts(points)
        if not len(starts):
            return starts, np.zeros(0, dtype=np.int32)
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(points, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool) if not len(self.hashes) else self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct
        counts = np.zeros(len(distinct), dtype=np.int32)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            encode = self.encoder.encode_ordinary
            counts[new] = [len(encode(text[a:b])) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            if len(self.hashes) + len(new) > self.keep:
                self.hashes, self.counts, at = self.hashes[:0], self.counts[:0], at * 0
            self.hashes, self.counts = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.counts, at[new], counts[new])
        return starts, counts[back]


def slices(texts: list[str | None], most_chars: int) -> Iterator[tuple[int, int]]:
    """(from, to) of successive texts with at most ``most_chars`` characters together, or of one longer text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= most_chars):
            size += len(texts[j] or "") + 2
            j += 1
        yield i, j
        i = j


@cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


@lru_cache(maxsize=4096)
def tail_tokens(white: str, path: str) -> int:
    return len(encoding(path).encode_ordinary(white))


def text_token_counts(texts: list[str | None], path: str, batch_chars: int = 2_000_000) -> np.ndarray:
    """Tokens of each text (0 for None); texts are joined to batches by a character that no piece crosses."""
    out = np.zeros(len(texts), dtype=np.int64)
    count = counter(path)
    for i, j in slices(texts, batch_chars):
        # White space at a text's ends is cut otherwise inside a batch: at the end it is counted apart, at the start the text is.
        bodies = {k: texts[k].rstrip(" \t\n\r\f\v") for k in range(i, j) if texts[k]}
        joint = [k for k, body in bodies.items() if body and SPACE not in classes()[[ord(body[0]), ord(body[-1])]]]
        for k in bodies.keys() - joint:
            out[k] = count.pieces(texts[k])[1].sum()
        if joint:
            starts, counts = count.pieces("\n".join(bodies[k] for k in joint))
            begins = np.cumsum([0] + [len(bodies[k]) + 1 for k in joint])
            total = np.concatenate([[0], np.cumsum(counts)])
            out[joint] = np.diff(total[np.searchsorted(starts, begins)]) - 1  # without the line break between
            out[joint[-1]] += 1
            for k in joint:
                if len(bodies[k]) < len(texts[k]):
                    out[k] += tail_tokens(texts[k][len(bodies[k]) :], path)
    return out
