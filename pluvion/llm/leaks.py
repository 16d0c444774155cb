"""Problem 9: evaluation texts inside training text, by template windows, a hash join and slot consistency.

Texts become words (runs of letters and digits; escape sequences, marks, case and line breaks don't count).  Numbers,
units and names are replaced by typed placeholders, and the hashes of five successive template words join texts with
items.  On each diagonal (item and text side by side) the words are then compared exactly: unchanged words, changed
words, and slots, whose replacements must be consistent if the text is a re-parameterised copy.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvion.llm.pieces import DIGIT, classes, code_points, mix, slices, span_hashes
from pluvion.session import cut

WINDOW = 5
LEAST_WORDS = 25
#: About one word in ten: cost of a changed word and of a number, unit or name in place of another one, and allowance a word.
CHANGED, REPLACED, ALLOWED = 25, 30, 3
NUMBER, UNIT, NAME = (np.uint64(x) for x in (11, 12, 13))
# Unit words.
UNITS = "mm cm m km in ft mi mg g kg lb oz ms us ns s sec secs min mins hr hrs hour hours day days hz khz mhz ghz kb mb gb tb kib mib gib px pt em percent pct deg hpa kpa".split()
#: Hits within STRETCH windows, at least DENSE of them, make a segment: 25 words with three changed hold six whole windows.
STRETCH, DENSE, MARGIN = 21, 5, 12
#: A notice is at least so many successive windows; texts that hold one often also hold the rest of an item less than half the time.
NOTICE_WINDOWS, ALONE = 12, 0.5
#: Windows by which the ends of a notice may vary where words near them are changed.
ENDS = 8
#: Words that one diagonal may lie from the next where words were put in or left out: a passage of which no part is one has
#: at most 55 words, so at most six of them (24 words, six left out, 24 words).
SHIFT = 6
NAME_BITS = 22
ESCAPED = np.array([ord(c) for c in "abfnrtv0"], dtype=np.uint32)


def _hash_words(words: list[str]) -> np.ndarray:
    joined, ends = "".join(words), np.cumsum([len(w) for w in words])
    return span_hashes(code_points(joined), np.concatenate([[0], ends[:-1]]), ends) if words else np.zeros(0, np.uint64)


def masked(points: np.ndarray) -> np.ndarray:
    """True for letters and digits that belong to an escape sequence: \\n, \\t ..., \\uXXXX, \\xXX, %XX, &name; and &#n;."""
    n = len(points)
    out = np.zeros(n + 12, dtype=bool)
    p = np.concatenate([points, np.zeros(12, dtype=np.uint32)])
    digit = (p >= 48) & (p <= 57)
    upper = (p >= 65) & (p <= 90)
    lower = (p >= 97) & (p <= 122)
    hexed = digit | ((p | 32) >= 97) & ((p | 32) <= 102)
    back = np.flatnonzero(points == 0x5C)
    if len(back):
        follow = p[back + 1]
        out[back[np.isin(follow, ESCAPED)] + 1] = True
        for lead, size in ((ord("u"), 4), (ord("x"), 2)):
            b = back[follow == lead]
            b = b[np.logical_and.reduce([hexed[b + 2 + i] for i in range(size)])] if len(b) else b
            for i in range(size + 1):
                out[b + 1 + i] = True
    percent = np.flatnonzero(points == 0x25)
    percent = percent[hexed[percent + 1] & hexed[percent + 2] & ~lower[percent + 1] & ~lower[percent + 2]]
    out[percent + 1] = out[percent + 2] = True
    amp = np.flatnonzero(points == 0x26)
    inner = digit | upper | lower | (p == 0x23)
    alive = np.ones(len(amp), dtype=bool)
    for size in range(1, 9):
        alive &= inner[amp + size]
        closed = amp[alive & (p[amp + size + 1] == 0x3B)]
        for i in range(1, size + 1):
            out[closed + i] = True
    return out[:n]


class Reader:
    """Words and template words of texts, in batches."""

    def __init__(self, names: np.ndarray):
        self.names, self.units = names, np.sort(_hash_words(UNITS))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, its template hash, number of words before each text) of a batch of texts."""
        lowered = []
        for t in texts:
            t = t if t.isascii() else unicodedata.normalize("NFKC", t)
            lowered.append(t.lower())
        points = code_points("\n".join(lowered))
        begins = np.cumsum([0] + [len(t) + 1 for t in lowered])
        # names of escapes are lower case already; %XX needs the case before lowering where the length is kept
        raw = "\n".join(t if len(t) == len(x) else x for t, x in zip(texts, lowered))
        kind = classes()[points]
        part = (kind <= DIGIT) & ~masked(code_points(raw))
        edge = np.diff(np.concatenate([[0], part.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        exact = span_hashes(points, starts, ends)
        digits = np.concatenate([[0], np.cumsum(kind == DIGIT)])
        template = np.where(digits[ends] > digits[starts], NUMBER, np.where(_member(exact, self.units), UNIT, np.where(self.names[exact >> np.uint64(64 - NAME_BITS)], NAME, exact)))
        exact = (exact & ~np.uint64(3)) | np.where(template <= NAME, template - np.uint64(10), np.uint64(0))  # the slot's type in the last bits
        return exact, template, np.searchsorted(starts, begins)

    def windows(self, exact: np.ndarray, template: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the window at each word, whether it lies in one text); with less than two words that are no slot, a
        window counts by its exact words."""
        n = len(template) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h, g, literal = np.zeros(n, np.uint64), np.ones(n, np.uint64), np.zeros(n, np.int8)
        for i in range(WINDOW):
            t = template[i : i + n]
            h = h * np.uint64(0x100000001B3) + t
            g = g * np.uint64(0x100000001B3) + exact[i : i + n]
            literal += t > NAME
        text = np.searchsorted(firsts, np.arange(len(template)), side="right")
        return mix(np.where(literal >= 2, h, g)), text[:n] == text[WINDOW - 1 :]


def repeating(h: np.ndarray) -> np.ndarray:
    """Windows inside a run of one or two words in turn: equal to one of the two before and one of the two behind."""
    before = np.concatenate([[False], h[1:] == h[:-1]]) | np.concatenate([[False, False], h[2:] == h[:-2]])[: len(h)]
    behind = np.concatenate([h[1:] == h[:-1], [False]]) | np.concatenate([h[2:] == h[:-2], [False, False]])[: len(h)]
    return before & behind


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), dtype=bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def item_names(items: DataFrame, text: str = "text") -> np.ndarray:
    """Which of 2^NAME_BITS hash cells hold a name: words of the items that only ever occur capitalised, and not only where
    a sentence starts.  Whatever the number of items, the driver gets at most one number a cell; items and texts look their
    words up in the same cells."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, list[bool]] = {}
            for t in b[text]:
                for m in re.finditer(r"[^\W\d_]+", t):
                    w, at = m.group(), m.start()
                    flags = seen.setdefault(w.lower(), [False, False])
                    flags[0] |= not w[0].isupper()
                    flags[1] |= w[0].isupper() and re.search(r"[a-z,] $", t[max(0, at - 2) : at]) is not None
            yield pd.DataFrame({"word": _hash_words(list(seen)).view(np.int64), "common": [f[0] for f in seen.values()], "inside": [f[1] for f in seen.values()]})

    words = items.filter(F.col(text).isNotNull()).select(text).mapInPandas(rows, "word bigint, common boolean, inside boolean")
    names = words.groupBy("word").agg(F.max("common").alias("common"), F.max("inside").alias("inside")).filter("inside AND NOT common")
    cells = np.zeros(2**NAME_BITS, dtype=bool)
    cells[names.select(F.shiftrightunsigned("word", 64 - NAME_BITS).alias("cell")).distinct().toArrow()["cell"].to_numpy()] = True
    return cells


def item_windows(items: DataFrame, names: np.ndarray, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, at, hash): exact word hashes, and positions and hashes of the windows of each item."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(names)
        for b in batches:
            out = []
            for k, t in zip(b["item"].tolist(), b["t"].tolist()):
                exact, template, firsts = reader.words([t])
                h, ok = reader.windows(exact, template, firsts)
                at = np.flatnonzero(ok & ~repeating(h))
                out.append((k, exact.view(np.int64), at, h[at].view(np.int64)))
            yield pd.DataFrame(out, columns=["item", "words", "at", "hash"])

    kind = dict(items.dtypes)[key]
    chosen = items.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("t"))
    return chosen.mapInPandas(rows, f"item {kind}, words array<bigint>, at array<bigint>, hash array<bigint>")


class HashFilter:
    """Two bits a hash in a field of fixed size: holds every hash it was built from, and few others."""

    def __init__(self, hashes: DataFrame, size: int, most_bits: int = 2**28):
        """``hashes`` has one bigint column.  The field has 32 bits for each of ``size`` hashes, at most ``most_bits`` (32 MB)."""
        bits = min(most_bits, max(2**16, 1 << (32 * size).bit_length()))
        self.mask = np.uint64(bits - 1)
        h = F.col(hashes.columns[0])
        spots = hashes.select(F.explode(F.array(h, F.shiftrightunsigned(h, 32))).alias("x")).select(F.col("x").bitwiseAND(bits - 1).alias("x"))
        words = spots.groupBy(F.shiftright("x", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 AS int))")).alias("v")).toArrow()
        self.field = np.zeros(bits // 64, dtype=np.uint64)
        self.field[words["word"].to_numpy()] = words["v"].to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for x in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            out &= (self.field[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
        return out


def segments(docs: DataFrame, wanted: HashFilter, names: np.ndarray, key: str = "doc_id", text: str = "text", batch_chars: int = 1_000_000) -> DataFrame:
    """(doc, segment, words, lead, inner, at, hash): stretches of each text where the items' windows are dense.

    25 words with up to three changed, put in or left out hold at least six whole windows of five words, so a stretch with
    fewer than DENSE hits within 21 windows holds no passage.  Every window of every text is looked up; only the stretches,
    with the words around them that a passage may reach, leave the task: where hits are not dense, at least four of 21 words
    are changed, which is as much as less than twice the dense words allow.  The context, the dense words and MARGIN on
    either side, is ``inner`` words from ``lead``; ``at`` counts from there.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(names)
        for b in batches:
            keys, texts = b["doc"].tolist(), b["t"].tolist()
            out = []
            for i, j in slices(texts, batch_chars):
                exact, template, firsts = reader.words(texts[i:j])
                h, ok = reader.windows(exact, template, firsts)
                hit = np.flatnonzero(ok & wanted.holds(h))
                if not len(hit):
                    continue
                owner = np.searchsorted(firsts, hit, side="right") - 1
                end = np.minimum(np.searchsorted(hit, hit + STRETCH, side="left"), np.searchsorted(owner, owner, side="right"))
                dense = np.zeros(len(hit) + 1, dtype=np.int64)
                strong = np.flatnonzero(end - np.arange(len(hit)) >= DENSE)
                np.add.at(dense, strong, 1)
                np.add.at(dense, end[strong], -1)
                kept = np.flatnonzero(np.cumsum(dense[:-1]) > 0)
                if not len(kept):
                    continue
                p, o = hit[kept], owner[kept]
                seed = ~repeating(h)[p]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(p) > 2 * MARGIN) | (np.diff(o) != 0)]))
                for a, z in zip(new.tolist(), [*new[1:].tolist(), len(p)]):
                    first, last, reach = firsts[o[a]], firsts[o[a] + 1], 2 * (p[z - 1] + WINDOW - p[a]) + STRETCH + WINDOW
                    lo, begin = max(first, p[a] - reach), max(first, p[a] - MARGIN)
                    hi, end = min(last, p[z - 1] + WINDOW + reach), min(last, p[z - 1] + WINDOW + MARGIN)
                    at = p[a:z][seed[a:z]]
                    out.append((keys[i + o[a]], int(p[a] - first), exact[lo:hi].view(np.int64), int(begin - lo), int(end - begin), at - begin, h[at].view(np.int64)))
            yield pd.DataFrame(out, columns=["doc", "segment", "words", "lead", "inner", "at", "hash"])

    kind = dict(docs.dtypes)[key]
    chosen = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"))
    return chosen.mapInPandas(rows, f"doc {kind}, segment bigint, words array<bigint>, lead int, inner int, at array<bigint>, hash array<bigint>")


def _longest(equal: np.ndarray, cost: np.ndarray, lead: np.ndarray, notice: np.ndarray, first: np.ndarray | None = None) -> tuple[int, int]:
    """The longest passage that begins and ends with equal words, holds no word of a notice and costs at most ALLOWED a word.

    ``lead`` is the part of each word's cost that lies before it and doesn't count where a passage begins; a passage
    that ends with a word begins at ``first`` of that word at the earliest, if given (never falling).
    """
    left = ALLOWED * np.arange(len(cost) + 1) - np.concatenate([[0], np.cumsum(cost)])  # allowance left, if all words before are taken
    kept = np.flatnonzero(equal & ~notice)
    best = (0, 0)
    for s in np.split(kept, np.flatnonzero(np.diff(np.cumsum(notice)[kept])) + 1):
        if not len(s) or s[-1] + 1 - s[0] <= best[1] - best[0]:
            continue
        begin, end = left[s] - lead[s], left[s + 1]
        if first is None:  # the earliest beginning with no more left than the end
            i = np.searchsorted(-np.minimum.accumulate(begin), -end)
        else:
            least = np.searchsorted(s, first[s])
            i = np.array([f + int(np.argmax(begin[f : k + 1] <= end[k])) for k, f in enumerate(least.tolist())])
        size = s + 1 - s[i]
        k = int(np.argmax(size))
        if size[k] > best[1] - best[0]:
            best = int(s[i[k]]), int(s[k]) + 1
    return best


def _consistent_from(a: np.ndarray, b: np.ndarray, changed: np.ndarray) -> np.ndarray:
    """For each word, the first one from which on every replaced word of ``a`` always became the same word of ``b``."""
    last: dict[int, tuple[int, int, int]] = {}  # by replaced word: its present replacement, last place, last place of another one
    out = np.zeros(len(a), dtype=np.int64)
    for i in np.flatnonzero(changed).tolist():
        x, y = int(a[i]), int(b[i])
        now, place, other = last.get(x, (y, -1, -1))
        other = other if now == y else place
        last[x] = (y, i, other)
        out[i] = other + 1
    return np.maximum.accumulate(out)


def notice_words(size: int, standing: np.ndarray, notice_windows: int = NOTICE_WINDOWS) -> np.ndarray:
    """The words of an item that belong to at least ``notice_windows`` successive standing windows."""
    notice = np.zeros(size, dtype=bool)
    if len(standing):
        s = np.sort(standing)
        for run in np.split(s, np.flatnonzero(np.diff(s) > WINDOW) + 1):
            if run[-1] - run[0] + 1 >= notice_windows:
                notice[run[0] : run[-1] + WINDOW] = True
    return notice


def with_same_ends(notice: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``notice`` words that at least half of the contexts, from window ``begin`` to window ``end`` of the item
    (``count`` of each), hold with the same ends, give or take ENDS windows; parts of varying ends are no notice."""
    edge = np.diff(np.concatenate([[0], notice.view(np.int8), [0]]))
    out = notice.copy()
    for first, last in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - WINDOW).tolist()):
        over = (begin <= last) & (end >= first)
        same = (np.abs(begin - first) <= ENDS) & (np.abs(end - last) <= ENDS)
        if count[same].sum() < ALONE * count[over].sum():
            out[first : last + WINDOW] = False
    return out


def compare(words: np.ndarray, item: np.ndarray, shift: int | np.ndarray, standing: np.ndarray, slots_free: bool = False, notice_windows: int = NOTICE_WINDOWS) -> tuple[int, int, int, int, bool]:
    """Longest passage of an item in a stretch: (first word, words, changed words, distinct replacements, consistent).

    Item word i stands beside text word i + ``shift`` (one number, or one for each item word); a step up in the shifts is
    words put in, each of which is a changed word.  The passage is the longest of all in which about one word in ten is
    changed (three of 25; one in ten of replaced slots).  With ``slots_free`` a number, unit or name in place of another
    one costs nothing, and the replacements are consistent.  Words of standing notices end a passage.  The replacements
    are consistent if every replaced item word always became the same text word.
    """
    at = np.arange(len(item)) + shift
    lo, hi = int(np.searchsorted(at, 0)), int(np.searchsorted(at, len(words)))
    if hi <= lo:
        return 0, 0, 0, 0, True
    a, b, notice = item[lo:hi], words[at[lo:hi]], notice_words(len(item), standing, notice_windows)[lo:hi]
    put_in = np.maximum(np.diff(at[lo:hi], prepend=at[lo] - 1) - 1, 0)
    equal = a == b
    slot = ~equal & ((a & 3) == (b & 3)) & ((a & 3) != 0)
    cost = np.where(equal, 0, np.where(slot, 0 if slots_free else REPLACED, CHANGED)) + CHANGED * put_in

    def passage(first: np.ndarray | None = None) -> tuple[int, int, int, int, bool]:
        s, e = _longest(equal, cost, CHANGED * put_in, notice, first)
        changed = ~equal[s:e]
        pairs = set(zip(a[s:e][changed].tolist(), b[s:e][changed].tolist()))
        return lo + s, e - s, int(changed.sum() + put_in[s + 1 : e].sum()), len(pairs), len({x for x, _ in pairs}) == len(pairs)

    found = passage()
    return found if found[4] or not slots_free else passage(_consistent_from(a, b, ~equal))


def aligned(words: np.ndarray, item: np.ndarray, shifts: np.ndarray, penalty: float = 4.0) -> np.ndarray:
    """A shift for each item word, not falling by more than words are left out: the path over neighbouring diagonals with
    most equal words, where every word put in costs ``penalty``."""
    band = np.arange(shifts.min(), shifts.max() + 1)
    padded = np.concatenate([words, [np.int64(-1)]])
    at = np.arange(len(item))[:, None] + band[None, :]
    equal = (padded[np.where((at >= 0) & (at < len(words)), at, len(words))] == item[:, None]).astype(float)
    best, back = equal[0], np.zeros(equal.shape, dtype=np.int64)
    here = np.arange(len(band))
    for i in range(1, len(item)):
        top, come = best.copy(), here.copy()
        for step in range(1, SHIFT + 1):
            for move, price in ((step, penalty * step), (-step, 0.5)):  # words put in; words left out already differ
                other = here - move
                ok = (other >= 0) & (other < len(band))
                value = np.where(ok, best[np.clip(other, 0, len(band) - 1)] - price, -np.inf)
                come, top = np.where(value > top, other, come), np.maximum(value, top)
        best, back[i] = top + equal[i], come
    path = np.zeros(len(item), dtype=np.int64)
    path[-1] = int(np.argmax(best))
    for i in range(len(item) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    # word positions never fall, so that no text word is used twice
    return np.maximum.accumulate(band[path] + np.arange(len(item))) - np.arange(len(item))


def _reach(words: np.ndarray, item: np.ndarray, shifts: np.ndarray, span: int) -> int:
    """Most words of ``span`` successive ones of an item that stand beside an equal one, or a slot, on any of the diagonals."""
    band = np.arange(shifts.min(), shifts.max() + 1)
    at = np.arange(len(item))[:, None] + band[None, :]
    beside = np.concatenate([words, [np.int64(0)]])[np.where((at >= 0) & (at < len(words)), at, len(words))]
    kind = item & 3
    total = np.concatenate([[0], np.cumsum(((beside == item[:, None]) | (((beside & 3) == kind[:, None]) & (kind[:, None] != 0))).any(axis=1))])
    span = min(span, len(item))
    return int((total[span:] - total[:-span]).max()) if span else 0


def best_passage(words: np.ndarray, item: np.ndarray, shifts: np.ndarray, counts: np.ndarray, standing: np.ndarray, least_words: int, least_windows: int = 2) -> tuple | None:
    """The longest passage: on single diagonals, then over neighbouring ones with enough windows together; copies before
    re-parameterised ones."""
    single = shifts if least_windows < DENSE else shifts[counts >= 2]  # runs of repeated words seed by their ends only
    cuts = np.flatnonzero(np.diff(shifts) > SHIFT) + 1
    groups = [g for g, c in zip(np.split(shifts, cuts), np.split(counts, cuts)) if len(g) > 1 and c.sum() >= least_windows]
    paths = None
    for kind, free in (("copy", False), ("reparameterised", True)):
        found = [(kind, *compare(words, item, int(d), standing, slots_free=free)) for d in single]
        if max((f[2] for f in found), default=0) < least_words and groups:
            if paths is None:  # some part of this length has at most so many changed words: all those of a passage that is too short to be parted
                most_changed = (2 * least_words - 1) * ALLOWED // CHANGED
                paths = [aligned(words, item, g) for g in groups if _reach(words, item, g, least_words) >= least_words - most_changed]
            found += [(kind, *compare(words, item, path, standing, slots_free=free)) for path in paths]
        found = [f for f in found if f[2] >= least_words and (f[5] or kind == "copy")]
        if found:
            return max(found, key=lambda f: (f[2], -f[3], f[1]))
    return None


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least_words: int = LEAST_WORDS, standing_least: int = 8, sole_standing: int = 50, filter_bits: int = 2**28) -> DataFrame:
    """(doc, item, kind, item_from, words, changed, replacements, consistent): passages of at least ``least_words`` item words.

    One row per text and item, its longest passage.  Kind 'copy': up to about one word in ten is changed, put in or left
    out; kind 'reparameterised': longer only if numbers, units and names may differ, and their replacements are consistent.

    Standing notices don't count.  A notice is a part of several items (whose rest has at least ``least_words`` words), at
    least NOTICE_WINDOWS windows long, found in more than ``standing_least`` different contexts, at least half of them
    without anything that only one item has, and at least half of these with the same ends; or a part of one item that is found with the same ends in more than
    ``sole_standing`` different contexts without the rest of the item (of at least ``least_words`` words that are no notice),
    at least half of all contexts that hold this part; passages of that part with fewer than ``least_words`` words beyond
    it, and without the rest of the item, don't count either.  A context is a stretch with MARGIN words around it, however many
    texts hold it.  So an item that leaks as a whole, or in parts with different ends, is found whatever the number of
    texts, at every size of corpus.

    The corpus is read once: a filter of at most ``filter_bits`` keeps the items' windows (and the more others, the fuller it
    is), which a hash join then tells apart.  Items
    with the same words, and stretches with the same words, are compared once.  NULL texts and NULL item ids take no part,
    texts without words match nothing, repeated texts give repeated evidence but one row per id, empty tables give no
    rows, other columns are ignored.
    """
    names = item_names(items, text)
    every = cut(item_windows(items, names, item_key, text).withColumn("one", F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.reverse("words")).alias("b"))))
    single = every.groupBy("one").agg(F.first("words").alias("words"), F.first("at").alias("at"), F.first("hash").alias("hash"))
    windows = single.select("one", F.inline(F.arrays_zip(F.col("at").alias("item_at"), "hash")))
    owners = windows.select("hash", "one").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    owners = cut(owners)
    part = segments(docs, HashFilter(owners.select("hash"), owners.count(), filter_bits), names, doc_key, text).withColumn("dense", F.slice("words", F.col("lead") + 1, F.col("inner")))
    stretch = F.struct(F.xxhash64("lead", "inner", "words").alias("a"), F.xxhash64(F.reverse("words"), "inner", "lead").alias("b"))
    part = cut(part.withColumns({"context": F.struct(F.xxhash64("dense").alias("a"), F.xxhash64(F.reverse("dense")).alias("b")), "stretch": stretch}).drop("dense"))
    contexts = cut(part.groupBy("context").agg(F.max(F.struct(F.size("at").alias("n"), "at", "hash")).alias("h")).select("context", "h.at", "h.hash"))
    stretches = part.groupBy("context", "stretch").agg(F.first("words").alias("text_words"), F.first("lead").alias("lead"))
    hits = contexts.select("context", F.inline(F.arrays_zip("at", "hash"))).join(owners, "hash")
    # windows of several items in contexts that hold nothing of a single one
    alone = F.sum((F.col("owners") == 1).cast("int")).over(Window.partitionBy("context")) < 3
    several = hits.withColumn("alone", alone.cast("int")).filter("owners > 1")
    often = several.groupBy("hash", "context").agg(F.max("alone").alias("alone"))
    often = often.groupBy("hash").agg(F.count("*").alias("n"), F.sum("alone").alias("alone")).filter((F.col("alone") > standing_least) & (F.col("alone") >= ALONE * F.col("n"))).select("hash", F.lit(True).alias("often"))
    marked = windows.join(often, "hash").groupBy("one").agg(F.collect_list("item_at").alias("standing_at"))  # an item's own windows
    # where such contexts begin and end in each item
    spans = several.filter("alone = 1").groupBy("context").agg(F.min_by("hash", "at").alias("first"), F.max_by("hash", "at").alias("last")).groupBy("first", "last").agg(F.count("*").alias("n"))
    spans = spans.join(windows.select(F.col("hash").alias("first"), "one", F.col("item_at").alias("a")), "first").join(windows.select(F.col("hash").alias("last"), "one", F.col("item_at").alias("z")), ["last", "one"])
    spans = spans.filter("a <= z").groupBy("one").agg(F.collect_list(F.struct("a", "z", "n")).alias("spans"))

    @F.pandas_udf("array<bigint>")
    def proper(sizes: pd.Series, standing: pd.Series, a: pd.Series, z: pd.Series, counts: pd.Series) -> pd.Series:
        """Standing windows of an item that keeps enough words of its own, in runs with the same ends; none otherwise."""
        out = []
        for n, s, begin, end, count in zip(sizes, standing, a, z, counts):
            notice = notice_words(n, np.asarray(s))
            if begin is not None:
                notice = with_same_ends(notice, *(np.asarray(x) for x in (begin, end, count)))
            whole = np.convolve(notice, np.ones(WINDOW, int), "valid") == WINDOW
            out.append(np.flatnonzero(whole) if 0 < notice.sum() <= n - least_words else np.zeros(0, np.int64))
        return pd.Series(out)

    marked = marked.join(single, "one").join(spans, "one", "left")
    marked = cut(marked.select("one", proper(F.size("words"), "standing_at", "spans.a", "spans.z", "spans.n").alias("standing_at")).filter("size(standing_at) > 0"))
    out_of = marked.select("one", F.explode("standing_at").alias("item_at"))
    seeds = hits.select("context", "at", "hash").join(windows.join(out_of, ["one", "item_at"], "left_anti"), "hash")
    pair = F.struct((F.col("at") - F.col("item_at")).cast("int").alias("shift"), F.col("item_at").cast("int").alias("i"))
    asked = seeds.groupBy("context", "one").agg(F.collect_list(pair).alias("s")).withColumn("found", F.size(F.array_distinct("s.i")))
    # a passage holds at least DENSE different windows of the item, unless it has runs of repeated words, whose inner windows don't seed
    least = F.when(F.size("at") < F.size("words") - (WINDOW - 1), 2).otherwise(DENSE)
    asked = asked.join(single.select("one", "words", least.alias("least")), "one").filter("found >= least")
    sides = asked.select("context", "one", F.col("s.shift").alias("shift"), F.col("s.i").alias("i"), "words", "least").join(stretches, "context").join(marked, "one", "left")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.int64)
        for b in batches:
            rows = []
            for context, stretch, one, d, seeds, lead, w, i, s, least in b.itertuples(index=False):
                s = none if s is None else np.asarray(s)
                got = best_passage(w, i, *np.unique(d.astype(np.int64) + lead, return_counts=True), s, least_words, least)
                if got:
                    outside = seeds[(seeds <= got[1] - WINDOW) | (seeds >= got[1] + got[2])]
                    own = len(i) - int(notice_words(len(i), s).sum())
                    rest = own - got[2] < least_words or len(np.unique(outside)) >= 3  # found with the rest of the item, or nothing is left of it
                    rows.append((context["a"], context["b"], stretch["a"], stretch["b"], one["a"], one["b"], not rest, *got))
            yield pd.DataFrame(rows, columns=["ca", "cb", "sa", "sb", "oa", "ob", "part", "kind", "item_from", "n", "changed", "replacements", "consistent"])

    passages = sides.select("context", "stretch", "one", "shift", "i", "lead", "text_words", "words", "standing_at", "least").mapInPandas(best, "ca bigint, cb bigint, sa bigint, sb bigint, oa bigint, ob bigint, part boolean, kind string, item_from bigint, n bigint, changed bigint, replacements bigint, consistent boolean")
    pairs = {name: F.struct(F.col(name[0] + "a").alias("a"), F.col(name[0] + "b").alias("b")).alias(name) for name in ("context", "stretch", "one")}
    passages = cut(passages.select(*pairs.values(), "part", F.expr("item_from div 8").alias("f"), F.expr("(item_from + n) div 8").alias("t"), F.struct("kind", "item_from", "n", "changed", "replacements", "consistent").alias("p")))
    ends = passages.groupBy("one", "f", "t").agg(F.count_distinct("context").alias("n"), F.count_distinct(F.when(F.col("part"), F.col("context"))).alias("parts"), F.min("p.item_from").alias("first"), F.max(F.col("p.item_from") + F.col("p.n")).alias("end"))
    repeated = ends.filter(F.col("parts") > sole_standing).select("one", "f", "t", "parts", "first", "end")
    around = ends.select("one", F.col("f").alias("from"), F.col("t").alias("to"), "n")
    middle = (F.col("f") + F.col("t")) / 2
    same_ends = repeated.join(around, "one").filter((F.col("from") <= middle) & (middle <= F.col("to"))).groupBy("one", "f", "t", "parts", "first", "end").agg(F.sum("n").alias("n"))
    same_ends = same_ends.filter(F.col("parts") >= ALONE * F.col("n")).select(F.col("one").alias("of"), "first", "end")
    beyond = F.greatest(F.col("first") - F.col("p.item_from"), F.col("p.item_from") + F.col("p.n") - F.col("end"))
    passages = passages.join(same_ends, F.col("part") & (F.col("one") == F.col("of")) & (beyond < least_words), "left_anti")
    order = F.struct((F.col("p.kind") == "copy").alias("k"), F.col("p.n").alias("n"), (-F.col("p.changed")).alias("c"), "p")
    rows = passages.join(part.select("doc", "stretch"), "stretch").join(every.select("item", "one"), "one").groupBy("doc", "item").agg(F.max(order)["p"].alias("p"))
    return rows.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "p.kind", "p.item_from", F.col("p.n").alias("words"), "p.changed", "p.replacements", "p.consistent")
