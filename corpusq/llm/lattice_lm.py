"""LM scoring by subword lattices: the marginal probability of a text over all its segmentations.

The pieces of an existing public vocabulary span a lattice over each word. A
unigram model over pieces gives every path a probability; the forward recursion in
log space sums all paths. Pieces do not cross words, so a text's probability is
the product of its words' and of one end piece.

The box has no unigram model, only a vocabulary whose scores are ranks. Those
scores give the starting weights (Zipf's law over ranks); expectation
maximisation over the counts of all training words then learns the weights. The
vocabulary stays as it is and is the only thing that workers get: its size is
fixed. Word counts grow with the corpus and stay in tables.

A word's score is computed once, wherever it occurs: the text pass writes, for
each distinct word of a batch, the rows and counts of its occurrences, packed;
scores join on the word and are summed back by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, slices, span_hashes, text_buffer, text_or_empty, word_spans

TOKENIZERS = "/opt/tokenizers"
PIECES = "piece_bpe_32k.model"
FOLDS, HELD = 7, 2
ROUNDS = 2
#: Expected count that every piece has beside what training gives it.
PRIOR = 0.05
#: Words of text whose occurrences are packed together.
BATCH_WORDS = 2_200_000
#: Bytes of text that wait to be packed at most, beside those of one document.
BATCH_BYTES = 24 << 20
#: A word with more than this share of all packed rows is hot; there can be no more hot words than its inverse.
HOT_SHARE = 0.001
#: Words of up to this many characters are scored many at once.
SHORT = 62
#: Places of lattices that are worked on at once.
CELLS = 400_000
#: Row numbers share a record of sums if they agree but for so many low bits.
BLOCK = 10
SPACE = "▁"


def vocabulary(folder: str = TOKENIZERS) -> tuple[list[str], list[str], int]:
    """The pieces in order of rank, the byte pieces by byte, and the longest piece's characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
    pieces, fallback = [], [""] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            fallback[int(model.id_to_piece(i)[3:-1], 16)] = model.id_to_piece(i)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((-model.get_score(i), model.id_to_piece(i)))
    pieces = [p for _, p in sorted(pieces)]
    return pieces, fallback, max(map(len, pieces))


class Lattice:
    """Log weights of pieces, of byte pieces and of the end."""

    def __init__(self, pieces: list[str], fallback: list[str], longest: int, weights: np.ndarray):
        logs = np.log(weights / weights.sum()).tolist()
        n = len(pieces)
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.logs, self.longest, self.end, self.n = logs, longest, logs[-1], n
        # all openings of pieces: the log weight of a piece, None for an opening that is none
        self.weight: dict[str, float | None] = {p[:k]: None for p in pieces for k in range(1, len(p))}
        self.weight.update(zip(pieces, logs))
        # the same as a tree: 0 is no opening, 1 the empty one; the number of each one's piece, -1 for an opening that is none
        place = {"": 1, **{x: i for i, x in enumerate(self.weight, 2)}}
        self.number = np.array([-1, -1, *[self.ids.get(x, -1) for x in self.weight]])
        # from opening and next character to opening: an open table, probed slot by slot
        keys = np.array([place[x[:-1]] << 21 | ord(x[-1]) for x in self.weight], np.int64)
        self.bits = (4 * len(keys)).bit_length()
        self.keys, self.follow = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[rest[free]]
            mine = self.keys[slot] == keys[rest]
            self.follow[slot[mine]] = rest[mine] + 2
            rest, slot = rest[~mine], slot[~mine] + 1 & len(self.keys) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, openings: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The openings that follow with these characters (code points), 0 where there is none."""
        keys = openings << 21 | chars
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.follow[slot], 0).astype(np.int64)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[rest]
        while len(rest):
            slot = slot + 1 & len(self.keys) - 1
            there = self.keys[slot]
            mine = there == keys[rest]
            out[rest[mine]] = self.follow[slot[mine]]
            more = ~mine & (there >= 0)
            rest, slot = rest[more], slot[more]
        return out

    def spelt(self, char: str) -> tuple[float, tuple[int, ...]]:
        """A character that is no piece, in bytes."""
        path = tuple(self.n + b for b in char.encode("utf-8", "replace"))
        return sum(self.logs[b] for b in path), path

    def forward(self, word: str) -> float:
        """Log probability of a word over all segmentations, by the forward recursion in log space."""
        text = SPACE + word
        get, n, exp, log = self.weight.get, len(text), math.exp, math.log
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            terms = into[i]
            if len(terms) == 1:
                alpha = terms[0]
            else:
                top = max(terms)
                alpha = top + log(sum([exp(t - top) for t in terms]))
            w = get(text[i], 0)
            if w is None or w == 0:
                into[i + 1].append(alpha + self.spelt(text[i])[0])
                if w == 0:
                    continue
            else:
                into[i + 1].append(alpha + w)
            for j in range(i + 2, n + 1):
                w = get(text[i:j], 0)
                if w is not None:
                    if w == 0:
                        break
                    into[j].append(alpha + w)
        terms = into[n]
        top = max(terms)
        return top + log(sum([exp(t - top) for t in terms]))

    def expect(self, word: str, count: float, into: list[float]) -> None:
        """Add to ``into`` the expected uses of each piece in ``count`` times the word.

        Forward sums are scaled at each place, so long words do not underflow.
        """
        text = SPACE + word
        get, ids, n, exp = self.weight.get, self.ids, len(text), math.exp
        arcs: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        alpha, scale = [0.0] * (n + 1), [0.0] * (n + 1)
        alpha[0] = 1.0
        for i in range(n):
            if i:
                total, shift = 0.0, scale[arcs[i][0][0]]
                for h, p, _ in arcs[i]:
                    total += alpha[h] * p * exp(scale[h] - shift) if scale[h] != shift else alpha[h] * p
                alpha[i], scale[i] = total, shift
                if total < 1e-200:
                    alpha[i], scale[i] = 1.0, shift + math.log(total)
            w = get(text[i], 0)
            if w is None or w == 0:
                spelt, path = self.spelt(text[i])
                arcs[i + 1].append((i, exp(spelt), path))
                if w == 0:
                    continue
            else:
                arcs[i + 1].append((i, exp(w), (ids[text[i]],)))
            for j in range(i + 2, n + 1):
                part = text[i:j]
                w = get(part, 0)
                if w is not None:
                    if w == 0:
                        break
                    arcs[j].append((i, exp(w), (ids[part],)))
        flow = [0.0] * (n + 1)
        flow[n] = count
        for j in range(n, 0, -1):
            f = flow[j]
            if f <= 0:
                continue
            if len(arcs[j]) == 1:
                i, _, path = arcs[j][0]
                flow[i] += f
                for k in path:
                    into[k] += f
                continue
            shift = max(scale[i] for i, _, _ in arcs[j])
            parts = [alpha[i] * p * exp(scale[i] - shift) if scale[i] != shift else alpha[i] * p for i, p, _ in arcs[j]]
            share = f / sum(parts)
            for (i, _, path), part in zip(arcs[j], parts):
                flow[i] += part * share
                for k in path:
                    into[k] += part * share


class Lattices:
    """The lattices of many short words: each arc's word, start, end and number, in order of end and in order of start."""

    def __init__(self, lattice: Lattice, words: list[str]):
        self.size = np.array([len(w) + 1 for w in words])
        self.width = int(self.size.max()) + 1
        chars = np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), self.size)
        start = np.arange(len(chars)) - (np.cumsum(self.size) - self.size)[word]
        left, places = self.size[word] - start, (word << 6 | start) << 6
        at, opening, size, arcs = np.arange(len(chars)), np.ones(len(chars), np.int64), 0, []
        while len(at):
            opening = lattice.step(opening, chars[at + size])
            size += 1
            number = lattice.number[opening]
            if size == 1:  # characters that are no piece are spelt
                odd = np.flatnonzero(number < 0)
                spelt, which = np.unique(chars[odd], return_inverse=True)
                number[odd] = len(lattice.logs) + which
            some = number >= 0
            arcs.append((places[at[some]] | start[at[some]] + size) << 32 | number[some])
            on = (opening > 0) & (left[at] > size)
            at, opening = at[on], opening[on]
        packed = np.sort(np.concatenate(arcs))
        self.number = packed & 0xFFFFFFFF
        self.end = packed >> 32 & 63
        self.start = packed >> 38 & 63
        self.word = packed >> 44
        paths = [lattice.spelt(chr(c)) for c in spelt.tolist()]
        self.paths = [path for _, path in paths]
        self.logs = np.r_[np.array(lattice.logs), [log for log, _ in paths]][self.number]

    def _sweep(self, into: np.ndarray, key: np.ndarray, other: np.ndarray, order: np.ndarray, steps: range) -> np.ndarray:
        """Log sums over the arcs that meet at each place, place by place."""
        cut = np.searchsorted(key[order], range(self.width + 1))
        flat, row = into.reshape(-1), self.word * self.width
        for j in steps:
            arc = order[cut[j] : cut[j + 1]]
            if not len(arc):
                continue
            term = flat[row[arc] + other[arc]] + self.logs[arc]
            first = np.flatnonzero(np.r_[True, self.word[arc][1:] != self.word[arc][:-1]])
            top = np.maximum.reduceat(term, first)
            count = np.diff(np.r_[first, len(arc)])
            flat[row[arc[first]] + j] = top + np.log(np.add.reduceat(np.exp(term - np.repeat(top, count)), first))
        return into

    def forward(self) -> np.ndarray:
        """Log probabilities of all openings of the words; a word's own stands at its size."""
        alpha = np.zeros((len(self.size), self.width))
        return self._sweep(alpha, self.end, self.start, np.argsort(self.end.astype(np.uint8), kind="stable"), range(1, self.width))

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(self.size)), self.size]

    def expect(self, counts: np.ndarray, into: np.ndarray) -> None:
        """Add the expected uses of each piece in so many times each word."""
        alpha = self.forward()
        beta = np.zeros_like(alpha)
        self._sweep(beta, self.start, self.end, np.argsort(self.start.astype(np.uint8), kind="stable"), range(self.width - 1, -1, -1))
        row = self.word * self.width
        share = np.exp(alpha.reshape(-1)[row + self.start] + self.logs + beta.reshape(-1)[row + self.end] - self.totals(alpha)[self.word])
        uses = np.bincount(self.number, share * counts[self.word], minlength=len(into) + len(self.paths))
        into += uses[: len(into)]
        for path, n in zip(self.paths, uses[len(into) :].tolist()):
            for k in path:
                into[k] += n


def groups(words: list[str]) -> Iterator[np.ndarray]:
    """Places of short words, those of like length together, in bounded numbers."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    order = order[size[order] < SHORT]
    at = 0
    while at < len(order):
        to = at + max(1, CELLS // (int(size[order[at]]) + 8))
        to = min(to, len(order), at + int(np.searchsorted(size[order[at:]], size[order[at]] + 4, "right")))
        yield order[at:to]
        at = to


def log_scores(lattice: Lattice, words: list[str]) -> np.ndarray:
    """``Lattice.forward`` of each word; short ones many at once."""
    out = np.zeros(len(words))
    for i, w in enumerate(words):
        if len(w) >= SHORT:
            out[i] = lattice.forward(w)
    for at in groups(words):
        some = Lattices(lattice, [words[i] for i in at.tolist()])
        out[at] = some.totals(some.forward())
    return out


def add_expected(lattice: Lattice, words: list[str], counts: np.ndarray, into: np.ndarray) -> None:
    """``Lattice.expect`` of each word; short ones many at once."""
    rest = [0.0] * len(into)
    for w, c in zip(words, counts.tolist()):
        if len(w) >= SHORT:
            lattice.expect(w, float(c), rest)
    into += rest
    for at in groups(words):
        Lattices(lattice, [words[i] for i in at.tolist()]).expect(counts[at].astype(float), into)


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds. word set: its training count in a batch, and packed row numbers and counts. word null: a row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (fold == HELD).alias("held"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "c", "rows", "tfs", "row", "id", "held", "n"]
        held_back: list[tuple] = []

        def flush() -> pa.RecordBatch:
            hashes, row, train, begin, stop = (np.concatenate([x[k] for x in held_back]) for k in range(5))
            source, raws = np.repeat(np.arange(len(held_back)), [len(x[0]) for x in held_back]), [x[5] for x in held_back]
            order = np.argsort(hashes, kind="stable")
            h, r = hashes[order], row[order]
            new = np.r_[True, h[1:] != h[:-1]]
            cut = np.flatnonzero(new | np.r_[True, r[1:] != r[:-1]])
            tf = np.diff(np.r_[cut, len(h)])
            first = np.flatnonzero(new[cut])
            at = np.r_[first, len(cut)] * 8
            rows, tfs = r[cut].astype("<i8").tobytes(), tf.astype("<i8").tobytes()
            c = np.add.reduceat(np.where(train[order][cut], tf, 0), first)
            spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
            one = order[cut[first]]
            word = pa.array([raws[k][a:b] for k, a, b in zip(source[one].tolist(), begin[one].tolist(), stop[one].tolist())], pa.binary()).cast(pa.string())
            held_back.clear()
            n = len(spans)
            return pa.RecordBatch.from_arrays(
                [word, pa.array(c), pa.array([rows[s:e] for s, e in spans], pa.binary()), pa.array([tfs[s:e] for s, e in spans], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, id_type[0]), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64())], names
            )

        id_type: list[pa.DataType] = []
        waiting = waiting_bytes = 0
        for b in slices(batches, "text"):
            id_type[:] = [b.column("id").type]
            buf, offs = text_buffer(b.column("text"))
            buf = LOWER[buf]
            starts, ends, row = word_spans(buf, offs)
            n = np.bincount(row, minlength=b.num_rows).astype(np.int64)
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.int64()), none, none, b.column("row"), b.column("id"), b.column("held"), pa.array(n)], names)
            if not len(row):
                continue
            held = b.column("held").to_numpy(zero_copy_only=False)
            raw = buf.tobytes()
            held_back.append((span_hashes(buf, starts, ends), b.column("row").to_numpy()[row], ~held[row], starts.astype(np.int32), ends.astype(np.int32), raw))
            waiting += len(row)
            waiting_bytes += len(raw)
            if waiting >= BATCH_WORDS or waiting_bytes >= BATCH_BYTES:
                yield flush()
                waiting = waiting_bytes = 0
        if held_back:
            yield flush()

    return given.mapInArrow(run, f"word string, c long, rows binary, tfs binary, row long, id {kind}, held boolean, n long")


def train(counts: DataFrame, ends: int, folder: str = TOKENIZERS, rounds: int = ROUNDS) -> tuple[list[str], list[str], int, np.ndarray]:
    """The vocabulary and its weights (pieces, byte pieces, end), learned from ``counts(word, c)``."""
    pieces, fallback, longest = vocabulary(folder)
    size = len(pieces) + 257
    weights = 1.0 / np.arange(1, size + 1)
    weights[-1] = 0.01
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast((pieces, fallback, longest, weights))  # of the vocabulary's fixed size

        def run(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
            into, lattice = np.zeros(size), Lattice(*shared.value)
            for b in batches:
                add_expected(lattice, b.column("word").to_pylist(), b.column("c").to_numpy(), into)
            some = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(into[some])], ["piece", "uses"])

        summed = counts.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # at most the vocabulary's size
        weights = np.full(size, PRIOR)
        for r in summed:
            weights[r.piece] += r.uses
        weights[-1] += ends
        shared.unpersist()
    return pieces, fallback, longest, weights


def lm_scores(docs: DataFrame, folder: str = TOKENIZERS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null texts are empty: their only token is the end. A null id has checksum 0
    and so trains. Repeated rows train as often as they occur and each get a row.
    Without training rows the base score is 0 and the lattice keeps its starting
    weights. Very long texts and words are scored whole. An empty table gives an
    empty result. Other columns are not read.
    """
    packed = materialize(pack(docs, id_col, text_col), "packed")
    rows = packed.where("word is null").select("row", "id", "held", "n")
    counts = materialize(packed.where("word is not null").groupBy("word").agg(F.sum("c").alias("c"), F.count("*").alias("m")), "counts")
    ends = rows.where("not held").count()
    seen, kinds = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = seen + ends, kinds + (ends > 0)
    trained = counts.where("c > 0")
    trained = train(trained, ends, folder, rounds)
    shared, end_weight = docs.sparkSession.sparkContext.broadcast(trained), Lattice(*trained).end  # of the vocabulary's fixed size
    floor = total + 1 * (distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for b in batches:
            logs = log_scores(lattice, b.column("word").to_pylist())
            c = b.column("c").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(c > 0), pa.array(np.log10((c + 1) / floor)), pa.array(logs / math.log(10))], ["word", "known", "base", "lw"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by row over some packed rows, laid out as one record for each block of row numbers."""
        parts: list[list[np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            row, *sums = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            distinct_rows, back = np.unique(row, return_inverse=True)
            columns = [distinct_rows.astype("<i8"), *(np.bincount(back, x).astype("<f8") for x in sums)]
            block = distinct_rows >> BLOCK
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.r_[cut[1:], len(block)]
            packed_columns = [[c[s:e].tobytes() for s, e in zip(cut.tolist(), ends.tolist())] for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(block[cut]), *(pa.array(c, pa.binary()) for c in packed_columns)], ["block", "rows", "known", "base", "lw"])

        for b in batches:
            sizes = np.diff(np.frombuffer(b.column("rows").buffers()[1], np.int32)[b.column("rows").offset :][: b.num_rows + 1]) // 8
            row, tf = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<i8") for c in ("rows", "tfs"))
            known, base, lw = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), sizes) * tf for c in ("known", "base", "lw"))
            parts.append([row, known.astype(float), base, lw])
            held += len(row)
            if held > 2_000_000:
                yield flush()
                held = 0
        if parts:
            yield flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by row from records in order of block."""
        now, parts = None, []

        def flush() -> pa.RecordBatch:
            row, *sums = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*parts), ("<i8", "<f8", "<f8", "<f8")))
            distinct_rows, back = np.unique(row, return_inverse=True)
            known, base, lw = (np.bincount(back, x) for x in sums)
            return pa.RecordBatch.from_arrays([pa.array(distinct_rows), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(lw)], ["row", "n_known", "base", "lw"])

        for b in batches:
            for block, *record in zip(*(b.column(c).to_pylist() for c in ("block", "rows", "known", "base", "lw"))):
                if block != now and parts:
                    yield flush()
                    parts = []
                now = block
                parts.append(record)
        if parts:
            yield flush()

    # a word of nearly all documents has a packed row in nearly all batches: such words, few by their share, are not shuffled
    all_rows = counts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    hot = counts.where(F.col("m") > max(HOT_SHARE * all_rows, 1)).select(F.col("word").alias("hot"))  # at most 1 / HOT_SHARE words
    words = materialize(counts.select("word", "c").mapInArrow(score, "word string, known boolean, base double, lw double"), "words")
    some = packed.where("word is not null").select("word", "rows", "tfs").join(F.broadcast(hot), F.col("word") == F.col("hot"), "left")
    hot_words = words.join(F.broadcast(hot), F.col("word") == F.col("hot"), "left_semi")
    joined = some.where("hot is null").drop("hot").join(words, "word").unionByName(some.where("hot is not null").drop("hot").join(F.broadcast(hot_words), "word"))
    sums = joined.select("rows", "tfs", "known", "base", "lw").mapInArrow(add, "block long, rows binary, known binary, base binary, lw binary")
    summed = sums.repartition("block").sortWithinPartitions("block").mapInArrow(settle, "row long, n_known long, base double, lw double")
    end_base, end_log = math.log10((ends + 1) / floor), end_weight / math.log(10)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.join(summed, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), (F.col("n") + 1).alias("n_tokens"),
        (zero("n_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (zero("base") + end_base).alias("base_score"), (zero("lw") + end_log).alias("score"),
    )
