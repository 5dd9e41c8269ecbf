"""Benchmark decontamination: bounds from n-gram hits, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII bytes, lower-cased from A-Z. Matching
words score 2, other pairs and gaps -1, and an alignment's score is over that of the
whole item. All word pairs of an item, however common, are its seeds.

No alignment at the threshold is missed. Let it need a score s of an item of n words.
With m matches and e other pairs and gaps, 2m - e >= s; the matches lie in e + 1 runs at
most, so m - e - 1 >= s - m - 1 >= s - n - 1 pairs of neighbouring words are in both, and
matches and pairs together are s - 1 or more. Gaps in the item are 2n - s at most, so all
of this is within 3n - s words of the text. Stretches of text that pass both counts are
aligned, and no others. Items too short to owe a pair are sought by single words.

Items are the query set and are taken in blocks of bounded size; what workers get
is one block. Candidates have no cap, and alignments run many at a time in fixed-size
arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, powers, slices, span_hashes, text_buffer, text_or_empty

#: Least share of the whole item's score.
THRESHOLD = 0.6
MATCH, OTHER, GAP = 2, -1, -1
#: Items handled at once, and so sent to workers at once.
ITEMS = 20_000
#: Cells of the alignment arrays that are worked on at once.
CELLS = 4_000_000
#: Hits, and words of candidate stretches, that are counted at once; a row of more stands alone.
HITS = 1_000_000

BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of rows of text."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = BREAK[buf]
    edge = np.r_[True, gap[:-1]]
    edge[offs[:-1][offs[:-1] < len(buf)]] = True
    starts = np.flatnonzero(~gap & edge)
    edge = np.r_[gap[1:], True]
    edge[offs[1:][offs[1:] > 0] - 1] = True
    ends = np.flatnonzero(~gap & edge) + 1
    return span_hashes(LOWER[buf], starts, ends), np.searchsorted(offs, starts, "right") - 1


def grams_of(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every n-gram inside a row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = powers(np.uint64(0xD6E8FEB86659FD93), n + 1)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += words[at + k] * p[k + 1]
    return total, at


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair of word sequences, and where in the text it ends (exclusive)."""
    n, m = max(map(len, items)), max(map(len, texts))
    a = np.zeros((len(items), n), np.uint64)
    b = np.zeros((len(items), m), np.uint64)
    for i, (x, y) in enumerate(zip(items, texts)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    pad_a = np.arange(n) >= np.array([len(x) for x in items])[:, None]
    pad_b = np.arange(m) >= np.array([len(y) for y in texts])[:, None]
    slope = (-GAP) * np.arange(1, m + 1)
    before = np.zeros((len(items), m + 1), np.int32)
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(n):
        gain = np.where((a[:, i : i + 1] == b) & ~pad_b, MATCH, OTHER)
        gain[pad_a[:, i]] = OTHER
        row = np.maximum(np.maximum(before[:, :-1] + gain, before[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope  # gaps along the text
        before[:, 1:] = row
        at = row.argmax(axis=1)
        top = row[np.arange(len(row)), at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def align_all(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, start and end for many pairs, of like sizes together and a bounded number of cells at once."""
    score, begin, stop = (np.zeros(len(items), np.int64) for _ in range(3))
    order = sorted(range(len(items)), key=lambda i: (len(texts[i]), len(items[i])))
    at = 0
    while at < len(order):
        wide = max(1, len(texts[order[at]]))
        some = order[at : at + max(1, CELLS // (8 * wide))]
        some = [i for i in some if len(texts[i]) <= 2 * wide + 64] or some[:1]
        at += len(some)
        score[some], stop[some] = align([items[i] for i in some], [texts[i] for i in some])
        back = [texts[i][: stop[i]][::-1] for i in some]
        _, length = align([items[i][::-1] for i in some], back)
        begin[some] = stop[some] - length
    return score, begin, stop


def within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is among the sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def ragged(lo: np.ndarray, length: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... for ``length[0]`` values, then the same for the next."""
    ends = np.cumsum(length)
    return np.repeat(lo - ends + length, length) + np.arange(length.sum())


def parts_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to ``most`` at most; a larger one stands alone."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


class Index:
    """A block of items: their words, their seeds by hash, and what an alignment at the threshold owes."""

    def __init__(self, ids: list, words: list[np.ndarray], threshold: float = THRESHOLD):
        self.ids, self.words, self.threshold = ids, words, threshold
        self.size = np.array([len(w) for w in words], np.int64)
        need = np.maximum(1, np.ceil(threshold * MATCH * self.size - 1e-9)).astype(np.int64)
        pairs = need - self.size - 1
        self.gram = np.where(pairs > 0, 2, 1)
        #: Least hits, least hits and matches together, and most words of text they are spread over.
        self.least = np.where(pairs > 0, pairs, -(-need // MATCH))
        self.both = np.where(pairs > 0, need - 1, self.least)
        self.span = 3 * self.size - need
        item = np.repeat(np.arange(len(words)), self.size)
        flat = np.concatenate([np.zeros(0, np.uint64), *words])
        self.own = np.unique(self.tag(flat, item))
        self.seeds = {}
        for n in (1, 2):
            h, at = grams_of(flat, item, n)
            some = self.gram[item[at]] == n
            h, of = h[some], item[at[some]]
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
            self.seeds[n] = h[new], of[new]

    @staticmethod
    def tag(words: np.ndarray, item: np.ndarray) -> np.ndarray:
        return mix(words + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))

    def hits(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in words, item) of every seed met, some rows at a time, in order of item and place."""
        for n, (seed, of) in self.seeds.items():
            h, at = grams_of(words, row, n) if len(seed) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            met = within(seed, h)
            h, at = h[met], at[met]
            lo = np.searchsorted(seed, h, "left")
            k = np.searchsorted(seed, h, "right") - lo
            cut = np.flatnonzero(np.r_[True, np.diff(row[at]) > 0]) if len(at) else np.zeros(0, np.int64)
            for x, y in parts_of(np.add.reduceat(k, cut) if len(cut) else cut, HITS):
                some = slice(cut[x], cut[y] if y < len(cut) else len(at))
                place, item = np.repeat(at[some], k[some]), of[ragged(lo[some], k[some])]
                order = np.lexsort((place, item))
                yield place[order], item[order]

    def passages(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, first word, last word + 1) of stretches of text; each alignment at the threshold lies whole in one of its item."""
        first = np.searchsorted(row, np.arange(row[-1] + 1), "left")
        last = np.searchsorted(row, np.arange(row[-1] + 1), "right")
        for at, item in self.hits(words, row):
            end = np.arange(len(at)) + self.least[item] - 1
            ok = np.flatnonzero(end < len(at))
            end = end[ok]
            fits = (item[end] == item[ok]) & (row[at[end]] == row[at[ok]]) & (at[end] - at[ok] + self.gram[item[ok]] <= self.span[item[ok]])
            ok, end = ok[fits], end[fits]
            if not len(ok):
                continue
            of, r = item[ok], row[at[ok]]
            lo = np.maximum(at[end] + self.gram[of] - self.span[of], first[r])
            hi = np.minimum(at[ok] + self.span[of], last[r])
            new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (r[1:] != r[:-1]) | (lo[1:] > hi[:-1])])
            of, lo, hi = of[new], lo[new], hi[np.r_[new[1:] - 1, len(hi) - 1]]
            keys = item * (len(words) + 1) + at
            for x, y in parts_of(hi - lo, HITS):
                yield from self._narrowed(words, keys, of[x:y], lo[x:y], hi[x:y])

    def _narrowed(self, words: np.ndarray, keys: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """What is left of stretches when matches are counted as well."""
        length = hi - lo
        at, stop = ragged(lo, length), np.repeat(np.cumsum(length), length)
        which = np.repeat(np.arange(len(of)), length)
        item = of[which]
        match = within(self.own, self.tag(words[at], item))
        count = match + ((self.gram[item] == 2) & within(keys, item * (len(words) + 1) + at)).astype(np.int64)
        total = np.r_[0, np.cumsum(count)]
        begin = np.arange(len(at))
        begin = np.flatnonzero(match & (total[np.minimum(begin + self.span[item], stop)] - total[begin] >= self.both[item]))
        if not len(begin):
            return
        apart = np.r_[True, (np.diff(which[begin]) > 0) | (np.diff(begin) > self.span[item[begin[1:]]])]
        start = begin[np.flatnonzero(apart)][np.cumsum(apart) - 1]
        piece = (begin - start) // (4 * self.size[item[begin]])  # long runs of candidates are cut, but no window is
        new = np.flatnonzero(apart | np.r_[True, np.diff(piece) != 0])
        end = begin[np.r_[new[1:] - 1, len(begin) - 1]]
        begin = begin[new]
        yield item[begin], at[begin], at[np.minimum(end + self.span[item[end]], stop[end]) - 1] + 1

    def leaks(self, words: np.ndarray, row: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, last word + 1) of the best passage of each row and item that reaches the threshold."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for item, lo, hi in self.passages(words, row) if len(row) else ():
            keys = [(i, words[x:y].tobytes()) for i, x, y in zip(item.tolist(), lo.tolist(), hi.tolist())]
            distinct = list(dict.fromkeys(keys))  # copies of a passage are aligned once
            number = {k: n for n, k in enumerate(distinct)}
            score, begin, stop = align_all([self.words[i] for i, _ in distinct], [np.frombuffer(w, np.uint64) for _, w in distinct])
            for x, key in zip(lo.tolist(), keys):
                n, i, r = number[key], key[0], int(row[x])
                share = float(score[n]) / (MATCH * len(self.words[i]))
                if share >= self.threshold and share > best.get((r, i), (0.0,))[0]:
                    x -= int(np.searchsorted(row, r, "left"))
                    best[r, i] = (share, x + int(begin[n]), x + int(stop[n]))
        return [(r, i, *found) for (r, i), found in sorted(best.items())]


def build_indexes(items: DataFrame, item_col: str, text_col: str, threshold: float, most: int = ITEMS) -> Iterator[Index]:
    """One index for each block of items."""
    asked = items.select(F.col(item_col).alias("item"), text_or_empty(text_col).alias("text"))
    blocks = max(1, -(-asked.count() // most))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else asked.collect()  # about ``most`` rows
        ids, words = [], []
        for r in rows:
            buf, offs = text_buffer(pa.array([r.text]))
            w, _ = words_of(buf, offs)
            if len(w):
                ids.append(r.item)
                words.append(w)
        yield Index(ids, words, threshold)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item, score, first_word, end_word, item_words) for every text and item whose alignment reaches the threshold.

    Null texts and items are empty and leak nothing; repeated rows of either side
    give repeated results; no items or no rows give no results; of passages that tie
    in one text the first is told; very long texts are searched whole; items of one
    word match where it stands; other columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {kind}, item {item_kind}, score double, first_word long, end_word long, item_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in build_indexes(items, item_col, text_col, threshold):
        if not index.ids:
            continue

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            for b in slices(batches, "text"):
                w, row = words_of(*text_buffer(b.column("text")))
                got = index.leaks(w, row)
                if got:
                    rows, which, *rest = zip(*got)
                    rest.append([len(index.words[i]) for i in which])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(rows)), pa.array([index.ids[i] for i in which]), *(pa.array(list(x), k) for x, k in zip(rest, kinds))],
                        ["id", "item", "score", "first_word", "end_word", "item_words"],
                    )

        part = given.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item; all columns stay. The verdict is made where the row is read."""
    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    for index in build_indexes(items, item_col, text_col, threshold):
        if not index.ids:
            continue

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col):
                w, row = words_of(*text_buffer(b.column(text_col)))
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in index.leaks(w, row)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
