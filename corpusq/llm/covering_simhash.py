"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint has 64 bits. Let r be the radius. Every bit gets a vector of r+1
bits, and every non-zero vector v of r+1 bits names a table whose mask keeps the
bits whose vector has an odd product with v (Pagh, 2016). Up to r differing bits
span at most r dimensions, so some v is orthogonal to all of them: its mask keeps
none of the differing bits and the two fingerprints share that table's key. No
pair within the radius is missed, whatever the data.

Fingerprints are de-duplicated before the tables, so thousands of copies are one
row. A table's bucket with more than ``bucket`` fingerprints is dealt out again
under a second and third covering of its free bits; at the third level eight or
fewer bits are free, so no bucket can hold more than 256 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SEP, broadcast_if_small, checkpoint, discard, materialize, mix, powers, slices, span_hashes, text_buffer, text_or_empty, word_spans
from .graph import block_groups, connected_components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 1024


def covering_masks(radius: int = RADIUS, free: int = (1 << BITS) - 1) -> list[int]:
    """One mask for each table over the ``free`` bits; bits get their vectors in turn, so masks are about even."""
    width = radius + 1
    vectors, masks = {}, []
    positions = [i for i in range(BITS) if free >> i & 1]
    for n, i in enumerate(positions):
        vectors[i] = n % ((1 << width) - 1) + 1
    for v in range(1, 1 << width):
        mask = sum(1 << i for i in positions if bin(vectors[i] & v).count("1") % 2)
        masks.append(mask)
    return list(dict.fromkeys(masks))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_spans(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by one space; start, end and row of each shingle in that text.

    A row of fewer words than ``size`` gives its whole sequence; one of no words gives none.
    """
    starts, ends, row = word_spans(buf, offs)
    if not len(starts):
        return b"", starts, ends, row
    sep = SEP[buf]
    keep = ~sep
    keep[1:] |= ~sep[:-1]
    if len(offs) > 2:  # a separator that opens a row belongs to no word of it
        inner = offs[1:-1]
        inner = inner[inner < len(buf)]
        keep[inner[sep[inner]]] = False
    text = np.where(sep, np.uint8(32), LOWER[buf])[keep]
    place = np.cumsum(keep) - 1
    starts, ends = place[starts], place[ends - 1] + 1
    count = np.bincount(row, minlength=len(offs) - 1)
    begin = np.cumsum(count) - count
    full = np.arange(len(row)) + size - 1 < (begin + count)[row]
    short = (count > 0) & (count < size)
    full[begin[short]] = True
    at = np.flatnonzero(full)
    to = np.minimum(at + size - 1, (begin + count)[row[at]] - 1)
    return text.tobytes(), starts[at], ends[to], row[at]


def fingerprint_batch(column: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of a string column as signed 64-bit values."""
    import xxhash

    buf, offs = text_buffer(column)
    text, starts, ends, row = shingle_spans(buf, offs, size)
    out = np.zeros(len(offs) - 1, np.int64)
    if not len(starts):
        return out
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist())], dtype=">u8")
    return majority(hashes, row, out)


def majority(hashes: np.ndarray, row: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Puts into ``out`` (signed) for each row the bits that are set in over half of its big-endian hashes."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rows, counts = row[first], np.diff(np.r_[first, len(row)])
    step = max(1, int(np.searchsorted(np.r_[first, len(row)], 1 << 16)))
    for at in range(0, len(first), step):  # bits are unpacked for some rows at a time
        lo, hi = first[at], np.r_[first, len(row)][min(at + step, len(first))]
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first[at : at + step] - lo, axis=0, dtype=np.int64)
        major = ones * 2 > counts[at : at + step, None]
        out[rows[at : at + step]] = np.packbits(major, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long) for every row; null or empty texts have fingerprint zero."""
    kind = docs.schema[id_col].dataType
    given = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fingerprint_batch(b.column("text"), size, seed))], ["id", "fp"])

    return given.mapInArrow(run, schema=f"id {kind.simpleString()}, fp long")


def components_of(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of some fingerprints of a bucket, the position of the first one it is linked with."""
    n = len(values)
    near = np.empty((n, n), bool)
    for at in range(0, n, 256):
        near[at : at + 256] = np.bitwise_count(values[at : at + 256, None] ^ values[None, :]) <= radius
    label = np.arange(n, dtype=np.int32)
    while True:
        least = np.array([label[near[i]].min() for i in range(n)], np.int32)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
            size = np.diff(np.r_[cut, len(fp)])
            two = cut[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, b = [fp[two]], [fp[two + 1]]
            for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist()):
                part = fp[at : at + n]
                label = components_of(part, radius)
                moved = label != np.arange(n)
                a.append(part[moved])
                b.append(part[label[moved]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "key", "fp")]
            got[2] = got[2].view(np.uint64)
            if held is not None:
                got = [np.concatenate(x) for x in zip(held, got)]
            change = np.flatnonzero((got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1]))
            done = int(change[-1]) + 1 if len(change) else 0
            if done:
                yield links(*(x[:done] for x in got))
            held = [x[done:] for x in got]
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect what fingerprints within the radius connect, from distinct ``nodes(fp)``.

    Within a bucket a spanning forest stands for all its pairs, so edges stay in
    proportion to the rows.
    """
    run, edges = _bucket_edges(radius), None
    levels = [[(m, m) for m in covering_masks(radius)]]
    rows = nodes.select("fp", F.posexplode(F.array(*[F.lit(signed(m)) for m, _ in levels[0]])).alias("tab", "mask")).select(
        "tab", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    masks = [m for m, _ in levels[0]]
    for level in range(3):
        hot = None
        if level < 2:
            hot = checkpoint(rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("tab", "key"))
            if not hot.head(1):
                hot = None
        cold = rows if hot is None else rows.join(hot, ["tab", "key"], "left_anti")
        part = cold.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp").mapInArrow(run, "a long, b long")
        edges = part if edges is None else edges.union(part)
        if hot is None:
            break
        finer = [[m | x for x in covering_masks(radius, ((1 << BITS) - 1) & ~m)] for m in masks]
        starts = np.cumsum([0, *map(len, finer)]).tolist()
        table = F.array(*[F.array(*[F.struct(F.lit(starts[i] + j).alias("t"), F.lit(signed(x)).alias("m")) for j, x in enumerate(xs)]) for i, xs in enumerate(finer)])
        masks = [x for xs in finer for x in xs]
        rows = (
            rows.join(hot, ["tab", "key"]).select("fp", F.explode(F.element_at(table, F.col("tab") + 1)).alias("x"))
            .select(F.col("x.t").alias("tab"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp").distinct()
        )
        rows = materialize(rows, "buckets")
    return edges


def _grouped(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, least, root) of each fingerprint in ``prints(id, fp)``, and (root, component_id), the least id of each group."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    parts = connected_components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least id reachable over fingerprints within the radius.
    Repeated rows stay repeated; null texts count as empty, and all empty texts
    are linked with each other; a null id never is a component's id unless all
    its ids are null; other columns of ``docs``, whatever their names, are not
    read. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, size, seed), "prints")
    rooted, least = _grouped(prints, radius)
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: The filter's shingles, similarity and fingerprints: SimHash of three least hashes, one from each of three bins.
WORDS, SIMILARITY, BLOCKS = 5, 0.8, 5
#: What stands for an empty bin.
EMPTY = mix(np.arange(1, 3 * BLOCKS + 1, dtype=np.uint64))


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each row's lower-cased words in order; then rows and hashes of its distinct shingles, in order of both.

    A row of fewer words than ``size`` has one shingle, its whole sequence; one of no words has hash zero and none.
    """
    buf, offs = text_buffer(column)
    starts, ends, row = word_spans(buf, offs)
    rows = len(offs) - 1
    whole = np.zeros(rows, np.uint64)
    if not len(row):
        return whole, row, np.zeros(0, np.uint64)
    words = span_hashes(LOWER[buf], starts, ends)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    place = np.arange(len(row)) - np.repeat(first, count)
    base = powers(np.uint64(0xD6E8FEB86659FD93), int(count.max()) + 1)
    whole[row[first]] = mix(np.add.reduceat(words * base[place], first) + base[count]) | np.uint64(1)
    full = np.flatnonzero(place + size <= np.repeat(count, count))
    grams = sum(words[full + k] * base[:size][k] for k in range(size)) if len(full) else np.zeros(0, np.uint64)
    short = row[first[count < size]]
    of, grams = np.r_[row[full], short], np.r_[mix(np.asarray(grams, np.uint64)), whole[short]]
    order = np.lexsort((grams, of))
    of, grams = of[order], grams[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])]
    return whole, of[new], grams[new]


def block_prints(rows: int, of: np.ndarray, grams: np.ndarray, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each row's blocks, and whether a block holds anything. Shingles are dealt to bins by hash."""
    bins = 3 * blocks
    least = np.tile(EMPTY, (rows, 1))
    held = np.zeros((rows, bins), bool)
    if len(of):
        cell = of * bins + (mix(grams) % np.uint64(bins)).astype(np.int64)
        order = np.argsort(cell, kind="stable")  # hashes of a row are in order, so the first of a cell is its least
        cell = cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        least.reshape(-1)[cell[first]] = grams[order[first]]
        held.reshape(-1)[cell[first]] = True
    a, b, c = (least[:, k::3] for k in range(3))
    # a block's number makes equal hashes of different blocks differ
    return ((a & b) | (b & c) | (a & c)) ^ EMPTY[:blocks], held.reshape(rows, blocks, 3).any(axis=2)


def _alike(pairs: DataFrame, prints: DataFrame, docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Those pairs (a, b) of word sequences whose shingle sets have the Jaccard similarity."""
    pairs = materialize(pairs, "near-pairs")
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "near-asked")
    one = materialize(prints.join(broadcast_if_small(asked), "h").groupBy("h").agg(F.min("key").alias("key")), "near-places")
    keyed = docs.join(broadcast_if_small(one, 48), docs["key"].eqNullSafe(one["key"])).select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            whole, of, grams = shingle_sets(b.column("text"), size)
            cut = np.searchsorted(of, np.arange(b.num_rows + 1)) * 8
            raw = grams.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array([raw[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())], ["h", "grams"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(keyed.mapInArrow(sets, "h long, grams binary").groupBy("h").agg(F.first("grams").alias("grams")), "near-sets")
    both = pairs.join(found.select(F.col("h").alias("a"), F.col("grams").alias("x")), "a").join(found.select(F.col("h").alias("b"), F.col("grams").alias("y")), "b")
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long"), "near-links")
    discard(pairs, asked, one, found)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, that of the least id and then of the least text hash; all columns stay.

    Texts are linked if their sets of ``size``-word shingles have a Jaccard similarity
    of ``similarity`` or more. Texts whose SimHash fingerprints differ in ``RADIUS`` bits
    or fewer meet in the covering tables, so that none of those is missed. This reaches few of the
    pairs at 0.8, and a radius that reaches them would need thousands of tables; so a text has
    five more fingerprints, each of three shingles drawn by least hash, that meet
    where they are equal (0.97 of the pairs at 0.8, more above). Then sets are compared.

    A null id stays only where all ids of its group are null. Null and empty texts are
    one group and so leave one row. Rows repeated under one id with one text are cut to
    one; unlike texts under one id, or under none, are groups of their own. Very long
    texts are compared whole. An empty table gives an empty result.
    """
    hashed = F.xxhash64(docs[text_col].cast("string"))
    key = F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), hashed.alias("th"))
    given = docs.select(key.alias("key"), text_or_empty(text_col).alias("text"))
    keys = [f"k{k}" for k in range(BLOCKS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            whole, of, grams = shingle_sets(b.column("text"), size)
            found, held = block_prints(b.num_rows, of, grams)
            fp = majority(grams.astype(">u8"), of, np.zeros(b.num_rows, np.int64)) if len(of) else np.zeros(b.num_rows, np.int64)
            n = np.bincount(of, minlength=b.num_rows)
            columns = [pa.array(found[:, k].copy().view(np.int64), mask=~held[:, k]) for k in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(fp), *columns], ["key", "h", "n", "fp", *keys])

    kind = given.schema["key"].dataType.simpleString()
    prints = materialize(given.mapInArrow(run, f"key {kind}, h long, n long, fp long, {', '.join(f'{k} long' for k in keys)}"), "near-prints")
    nodes = materialize(prints.where("n > 0").groupBy("h").agg(*[F.max(c).alias(c) for c in ("n", "fp", *keys)]), "near-nodes")
    tables = [F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key"), F.col("fp")) for i, m in enumerate(covering_masks())]
    blocks = [F.struct(F.col(k).alias("key"), F.lit(None).cast("long").alias("fp")) for k in keys]
    index = nodes.select("h", "n", F.explode(F.array_distinct(F.array(*tables, *blocks))).alias("e")).select("h", "n", "e.key", "e.fp").where("key is not null")
    within = lambda a, b: a("fp").isNull() | b("fp").isNull() | (F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= RADIUS)
    groups = materialize(block_groups(index, similarity, lambda pairs: _alike(pairs, prints, given, similarity, size), meet=within), "near-groups")
    rooted = materialize(prints.join(broadcast_if_small(groups), "h", "left").select("key", F.coalesce("root", "h").alias("root")), "near-roots")
    least = rooted.groupBy("root").agg(F.min("key").alias("least"), F.count("*").alias("m")).where("m > 1").select("root", "least")
    placed = materialize(rooted.join(broadcast_if_small(materialize(least, "near-least"), 64), "root"), "near-placed")
    gone = materialize(placed.where("key <> least").select(F.col("key.id").alias("_id"), F.col("key.th").alias("_th")).distinct(), "near-gone")
    left = docs.join(broadcast_if_small(gone, 48), docs[id_col].eqNullSafe(gone["_id"]) & (hashed == gone["_th"]), "left_anti")
    again = placed.where("key = least").groupBy("key").count().where("count > 1")
    discard(nodes, groups, rooted)
    if again.head(1):
        mark = "_th"
        while mark in docs.columns:
            mark += "_"
        left = left.withColumn(mark, F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, mark]).drop(mark)
    return left
