"""Exact substring dedup: maximal repeats from the common-prefix interval trees of suffix arrays.

Suffixes that can matter. Every window of ``window`` bytes has one anchor: the first
of its grams of least hash. It depends on the window's bytes alone, so equal windows
have their anchors at the same place, and the suffixes that start at anchors find
every repeat: about two in a window's length, one for each period in a periodic text.

Leaves. An anchor's windows start in one run of places; its context is what they
cover. Occurrences with equal contexts are one leaf with a count, so thousands of
copies of a passage are one row. Anchors whose gram occurs once go no further.

Trees. The leaves of one gram, in the order of their suffixes, with the common
prefixes of neighbours are an enhanced suffix array. A stack scan gives its
common-prefix intervals: sets of leaves that agree on R bytes and on no more. In each
interval a second stack scan over the reversed left contexts tests whether left
extensions differ: sets that agree on L bytes before the anchor and on no more. A
set that is diverse on both sides is a maximal repeat of L + R bytes within its
context, with all its leaves, and through them all occurrences.

Skew. A gram with more than ``most`` leaves is dealt out again: windows fall into
ranges by the anchor's offset in them, leaves are grouped by the bytes that all
windows of a range share, and contexts are cut to what the range can reach. Ranges
shrink until a group is small or holds one window, whose leaves need no scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices, text_buffer, text_or_empty

WINDOW = 400
GRAM = 32
MOST = 20_000
SPLIT = 8


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) from each place."""
    n = len(buf) - gram + 1
    raw = buf.tobytes()
    total = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        part = np.ndarray((n,), "<u8", raw, k, (1,))
        total += part * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & ((1 << 64) - 1) | 1)
    return mix(total)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Place, row, gram hash, and most and least bytes from a window's start, of every anchor of rows of text.

    Windows do not cross rows. One running minimum over hash and place finds the
    first gram of least hash of every window.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < window:
        return none, none, none.astype(np.uint64), none, none
    h, width, bits = gram_hashes(buf, gram), window - gram + 1, np.uint64(32)  # the same everywhere, so that equal windows agree
    least = sliding((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), width, np.minimum)
    open_ = np.zeros(len(buf) + 1, np.int64)
    fits = offs[1:] - offs[:-1] >= window
    np.add.at(open_, offs[:-1][fits], 1)
    np.add.at(open_, offs[1:][fits] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(open_)[: len(least)])
    if not len(starts):
        return none, none, none.astype(np.uint64), none, none
    at = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # an anchor's windows are next to each other
    last = np.r_[first[1:], len(at)] - 1
    place = at[first]
    return place, np.searchsorted(offs, place, "right") - 1, h[place], place - starts[first], place - starts[last]


def find_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, ctx, id, th, pos, lo, hi): an anchor's gram and context hashes, its row, place and context on both sides."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            at, row, h, lo, near = anchors(buf, offs, window, gram)
            if not len(at):
                continue
            hi = window - near
            raw = buf.tobytes()
            ctx = np.array([digest(raw[p - x : p + y], x) for p, x, y in zip(at.tolist(), lo.tolist(), hi.tolist())], np.uint64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), b.column("id").take(take), b.column("th").take(take), *(pa.array(x.astype(np.int32)) for x in (at - offs[row], lo, hi))],
                ["key", "ctx", "id", "th", "pos", "lo", "hi"],
            )

    return docs.mapInArrow(run, f"key long, ctx long, id {kind}, th long, pos int, lo int, hi int")


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (depth, first, last) of every common-prefix interval of an array of len(lcp) + 1 leaves, inner ones first."""
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp, -1], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the texts, zero-padded to ``width``, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    return flat, sizes


def _agree(flat: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 4096):
        x, y = a[at : at + 4096], b[at : at + 4096]
        differ = flat[x] != flat[y]
        out[at : at + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), flat.shape[1])
    return np.minimum(out, np.minimum(sizes[a], sizes[b]))


def _prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two byte strings."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def maximal_repeats(lefts: list[bytes], rights: list[bytes], counts: list[int], window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(L, R, leaves, fresh) of maximal repeats of ``window`` bytes or more over one gram's leaves.

    ``rights`` must be in order; ``lefts`` are reversed. ``fresh`` are the leaves that
    no repeat given before covers as far on both sides; a repeat without such a
    leaf lies inside longer ones wherever it occurs and is left out. Intervals come
    from the deepest, so R only falls as L grows. A leaf of two or more occurrences
    is a repeat by itself, with its whole context.
    """
    n = len(rights)
    reach = np.full(n, -1, np.int64)  # the longest L so far of each leaf
    for i, c in enumerate(counts):
        if c > 1:
            reach[i] = len(lefts[i])
            if len(lefts[i]) + len(rights[i]) >= window:
                yield len(lefts[i]), len(rights[i]), np.array([i]), np.array([i])
    if n < 2:
        return
    if n == 2:
        depth = _prefix(*rights)
        left = _prefix(*lefts) if depth + min(map(len, lefts)) >= window else -1
        if left + depth >= window:
            fresh = np.flatnonzero(reach < left)
            if len(fresh):
                yield left, depth, np.array([0, 1]), fresh
        return
    flat, sizes = _common(rights, max(map(len, rights)))
    every = np.arange(n)
    lcp = _agree(flat, sizes, every[:-1], every[1:])
    by_left = np.array(sorted(range(n), key=lefts.__getitem__))
    rank = np.empty(n, np.int64)
    rank[by_left] = every
    flat, sizes = _common(lefts, max(1, max(map(len, lefts))))
    longest = int(sizes.max())
    for depth, first, last in intervals(lcp.tolist()):
        if depth + longest < window or first == last:
            continue
        members = by_left[np.sort(rank[first : last + 1])]
        near = _agree(flat, sizes, members[:-1], members[1:])
        own = np.maximum(np.r_[-1, near], np.r_[near, -1])  # each leaf's longest left extension shared in the interval
        fresh = (own + depth >= window) & (own > reach[members])
        if not fresh.any():  # left extensions add nothing to what deeper intervals gave
            continue
        reach[members[fresh]] = own[fresh]
        if len(members) == 2:
            yield int(near[0]), depth, members, members[fresh]
            continue
        for left, a, b in intervals(near.tolist()):
            if left + depth >= window and a < b:
                new = fresh[a : b + 1] & (own[a : b + 1] == left)
                if new.any():
                    yield left, depth, members[a : b + 1], members[a : b + 1][new]


def _scan(window: int, whole: bool):
    """Groups of sorted rows (g, left, right, key, ctx, n) to rows of maximal repeats: all their leaves, or only the fresh ones."""
    names = ["g", "part", "size", "l", "r", "key", "ctx", "best"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def emit(g: int, rows: list[tuple], out: list[list]) -> None:
        counts = [r[4] for r in rows]
        for part, (left, right, leaves, fresh) in enumerate(maximal_repeats([r[0] for r in rows], [r[1] for r in rows], counts, window)):
            size, new = sum(counts[i] for i in leaves.tolist()), set(fresh.tolist())
            for i in leaves.tolist() if whole else new:
                for column, value in zip(out, (g, part, size, left, right, rows[i][2], rows[i][3], i in new)):
                    column.append(value)

    def pack(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], [[] for _ in names]
        for b in batches:
            for g, left, right, key, ctx, n in zip(*(b.column(c).to_pylist() for c in ("g", "left", "right", "key", "ctx", "n"))):
                if g != now:
                    if rows:
                        emit(now, rows, out)
                    if len(out[0]) > 50_000:
                        yield pack(out)
                        out = [[] for _ in names]
                    now, rows = g, []
                if not rows or rows[-1][1:4] != (right, key, ctx):  # a repeated row of the input sends a leaf twice
                    rows.append((left, right, key, ctx, n))
        if rows:
            emit(now, rows, out)
        yield pack(out)

    return run


def _refine(window: int, width: int):
    """Rows of a large group, dealt out over ranges of ``width`` offsets; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["g", "left", "right", "key", "ctx", "n", "low", "high"]
        for b in batches:
            out = []
            for g, left, right, key, ctx, n, low, high in zip(*(b.column(c).to_pylist() for c in names)):
                for a in range(low, high + 1, width):
                    z = min(a + width - 1, high)  # the anchor lies a to z bytes into a window
                    if len(left) < a or len(right) < window - z or len(left) + len(right) < window:
                        continue
                    core = left[:a] + b"|" + right[: window - z]
                    new = xxhash.xxh3_64_intdigest(core, (g ^ (a << 16) ^ z) & ((1 << 64) - 1))
                    out.append((new - (1 << 64) if new >> 63 else new, left[:z], right[: window - a], key, ctx, n, a, z))
            columns = [list(x) for x in zip(*out)] if out else [[] for _ in names]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


LEAF = "g long, left binary, right binary, key long, ctx long, n long, low int, high int"
FOUND = "g long, part int, size long, l int, r int, key long, ctx long, best boolean"


def scan_leaves(leaves: DataFrame, window: int, gram: int, most: int = MOST, whole: bool = False) -> DataFrame:
    """Rows of maximal repeats from leaf rows (see LEAF); no group of more than ``most`` rows meets in a task."""
    run, found, width = _scan(window, whole), None, window - gram + 1
    while True:
        hot = materialize(leaves.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > most), "hot")
        some = bool(hot.head(1))
        cold = leaves.join(hot, "g", "left_anti") if some else leaves
        part = cold.repartition("g").sortWithinPartitions("g", "right", "key", "ctx").mapInArrow(run, FOUND)
        found = part if found is None else found.union(part)
        if not some:
            return found
        width = -(-width // SPLIT)
        leaves = materialize(leaves.join(hot.select("g"), "g").select(*[c.split()[0] for c in LEAF.split(", ")]).mapInArrow(_refine(window, width), LEAF), "leaves")
        if width == 1:  # a group is one window: if it occurs twice, all its leaves hold a repeat
            sums = leaves.groupBy("g").agg(F.sum("n").alias("size")).where("size > 1")
            last = leaves.join(sums, "g").select("g", F.lit(0).alias("part"), "size", F.col("low").alias("l"), (window - F.col("low")).alias("r"), "key", "ctx", F.lit(True).alias("best"))
            return found.union(last)


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, occurrences, repeats).

    texts: id, th (hash of the text), text. occurrences: an anchor's leaf (key,
    ctx), its row (id, th) and place. repeats: for each maximal repeat (g, part) its
    occurrence count, reach before and after the anchor, and leaves: all of them if
    ``whole``, else those that no longer repeat covers, which ``best`` marks.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select("id", F.xxhash64("text").alias("th"), "text")
    found = materialize(find_anchors(texts, window, gram), "anchors")
    often = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    occurrences = materialize(found.join(often, "key"), "occurrences")
    leaves = occurrences.groupBy("key", "ctx", "lo", "hi").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "th", "pos")])
    leaves = materialize(leaves, "leaves")
    several = leaves.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    # a gram with one leaf: its tree is that leaf
    single = leaves.join(several, "key", "left_anti").where("n > 1").select(
        F.col("key").alias("g"), F.lit(0).alias("part"), F.col("n").alias("size"), F.col("lo").alias("l"), F.col("hi").alias("r"), "key", "ctx", F.lit(True).alias("best")
    )
    asked = leaves.join(several, "key").groupBy("id", "th").agg(F.collect_list(F.struct("key", "ctx", "pos", "lo", "hi", "n")).alias("asked"))
    fetched = texts.alias("t").join(asked.alias("a"), F.col("t.id").eqNullSafe(F.col("a.id")) & (F.col("t.th") == F.col("a.th"))).select("text", "asked")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            raw, out = buf.tobytes(), []
            for start, asked in zip(offs.tolist(), b.column("asked").to_pylist()):
                for a in asked:
                    p = start + a["pos"]
                    out.append((a["key"], raw[p - a["lo"] : p][::-1], raw[p : p + a["hi"]], a["key"], a["ctx"], a["n"], 0, window - gram))
            columns = [list(x) for x in zip(*out)] if out else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["g", "left", "right", "key", "ctx", "n", "low", "high"])

    rows = materialize(fetched.mapInArrow(contexts, LEAF), "contexts")
    repeats = materialize(single.union(scan_leaves(rows, window, gram, most, whole)), "repeats")
    return texts, occurrences, repeats


def repeat_groups(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, n_bytes, n_occurrences, id, start): every maximal repeat of ``window`` bytes or more, with all occurrences.

    Repeats longer than a context come as several, one for each anchor, that
    overlap. Starts are byte offsets.
    """
    _, occurrences, repeats = find_repeats(docs, window, gram, most, id_col, text_col, whole=True)
    joined = repeats.join(occurrences, ["key", "ctx"])
    return joined.select(F.concat_ws("-", F.hex("g"), "part").alias("repeat"), (F.col("l") + F.col("r")).alias("n_bytes"), F.col("size").alias("n_occurrences"), F.col("id").alias(id_col), (F.col("pos") - F.col("l")).alias("start"))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans.

    Removed is every byte that a ``window``-byte string covers which also starts
    anywhere else in the table, judged on the texts as given. Null texts are empty;
    rows repeated under one id are copies of each other; very long texts are taken
    whole; no copy is kept for being first, so nothing ties; an empty table gives an
    empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts, occurrences, repeats = find_repeats(docs, window, gram, most, id_col, text_col)
    # all repeats of a leaf hold its anchor, so together they cover one span
    pairs = repeats.where("best").groupBy("key", "ctx").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    spans = occurrences.join(pairs, ["key", "ctx"]).select("id", "th", F.struct((F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e")).alias("span")).distinct()
    cover = spans.groupBy("id", "th").agg(F.collect_list("span").alias("spans"))
    joined = texts.alias("t").join(cover.alias("c"), F.col("t.id").eqNullSafe(F.col("c.id")) & (F.col("t.th") == F.col("c.th")), "left").select("t.id", "text", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            raw, out = buf.tobytes(), []
            for i, (s, e) in enumerate(zip(b.column("s").to_pylist(), b.column("e").to_pylist())):
                text, removed = raw[offs[i] : offs[i + 1]], []
                for x, y in sorted(zip(s or [], e or [])):
                    if removed and x <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], y)
                    else:
                        removed.append([x, y])
                rest, at = hashlib.sha256(), 0
                for x, y in removed:
                    rest.update(text[at:x])
                    at = y
                rest.update(text[at:])
                out.append((len(text), sum(y - x for x, y in removed), len(removed), rest.hexdigest(), ",".join(f"{x}-{y}" for x, y in removed)))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(list(c)) for c in columns)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string").withColumnRenamed("id", id_col)
