"""Connected components of a distributed edge table, and of items that share blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, discard, materialize, release


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the least node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step
    is a grouped minimum, which combines on the map side, and one join; the edge
    table never grows, and nothing but its size reaches the driver. An empty edge
    table gives an empty result; null ends, self-loops and repeats are ignored.
    """
    now = checkpoint(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a > b").distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a > b").distinct()
        )
        now = checkpoint(small)
        after = state(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def most_apart(n: Column, m: Column, similarity: float) -> Column:
    """By how much items of these sizes may differ."""
    return F.floor(F.greatest(n, m) * (1 - similarity) + 1e-9)


#: Rows of a bucket on each side that meet in one task.
TILE = 128


def _judged_in_tiles(inside: DataFrame, outside: DataFrame, across: Column, judged: Column, spelt: Callable[[DataFrame], DataFrame], row_bytes: int) -> DataFrame:
    """(h, h1) of the rows inside(key, class, h, ...) and outside(key, class, h1, ...) that meet, for which ``across`` and the costly ``judged`` hold.

    Rows that meet none by ``across`` go first. The others of a (key, class) are dealt into tiles of ``TILE`` by ``TILE``
    rows, so that a large bucket's verdicts are spread over tasks and each row is moved once a tile, not once a pair.
    """
    renamed, same = {"key": "key1", "class": "class1"}, (F.col("key") == F.col("key1")) & (F.col("class") == F.col("class1"))
    met = materialize(inside.join(broadcast_if_small(outside.withColumnsRenamed(renamed), row_bytes), same & across, "left_semi"), "block-met")
    faced = materialize(outside.join(broadcast_if_small(met.withColumnsRenamed(renamed), row_bytes), same & across, "left_semi"), "block-faced")
    known = materialize(spelt(met.select("h").union(faced.select("h1")).distinct()), "block-spelt")
    parts = lambda side, name: side.groupBy("key", "class").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    tiles = broadcast_if_small(materialize(parts(met, "rows").join(parts(faced, "columns"), ["key", "class"]), "block-tiles"), 24)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda h, n: F.pmod(F.xxhash64(h), n).cast("int")
    left = met.join(known, "h").join(tiles, ["key", "class"]).withColumn("row", dealt("h", F.col("rows"))).withColumn("column", numbers("columns"))
    right = faced.join(known.withColumnsRenamed({c: f"{c}1" for c in known.columns}), "h1").join(tiles, ["key", "class"]).withColumn("column", dealt("h1", F.col("columns"))).withColumn("row", numbers("rows"))
    left, right = left.drop("rows", "columns").hint("merge"), right.drop("rows", "columns")
    return left.join(right, ["key", "class", "row", "column"]).where(F.when(across, judged).otherwise(False)).select("h", "h1")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The groups parts(node, root) with these links(a, b) between items besides. Groups found so far stand for their items."""
    if not links.head(1):
        return parts
    of = lambda name: parts.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    moved = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    merged = materialize(connected_components(moved), "block-merged").select(F.col("node").alias("root"), F.col("root").alias("top"))
    release(parts.sparkSession)
    known = parts.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = merged.join(parts, merged["root"] == parts["node"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return materialize(known.union(fresh), "block-parts")


def block_groups(
    index: DataFrame, similarity: float, verified: Callable[[DataFrame], DataFrame], opened: Callable[[DataFrame], None] | None = None,
    described: Callable[[DataFrame], DataFrame] | None = None, meet: Callable[[Callable, Callable], Column] | None = None,
    alike: Callable[[Callable, Callable], Column] | None = None, spelt: Callable[[DataFrame], DataFrame] | None = None,
    judged: Callable[[Callable, Callable], Column] | None = None, wide: int = 0, draws: tuple[Column, ...] = (),
) -> DataFrame:
    """(h, root) for every item of ``index(h, n, key, ...)``, one row an item and key, that is linked with another.

    Items are linked if they share a key, their sizes n allow the similarity, ``meet`` (if given) holds
    of their rows of that key, and ``verified``, which returns a written table, keeps their pair
    (a, b). In each bucket all items are first compared with its leader, which joins thousands
    of like items at a linear cost. Then only items outside their leader's group are compared,
    within classes of size that a link can span, with the items of other groups in the
    bucket. Items of one group need no comparison, and of two items in different groups
    one is outside the leader's, so groups come out as if all pairs had been compared.

    ``draws`` are arrays over the described items. Before that, for each in turn, the items of a bucket and of two neighbouring classes that
    share a value are compared with the least of them, at a linear cost: groups that many pairs link become one by few.

    ``opened`` gets the written table of items that share a key, before any pair is formed. ``described`` adds
    columns by h to the items that are compared across groups, and ``alike`` tells by them which pairs are verified.
    ``judged`` is the exact verdict on two items of a size below ``wide``, by the columns that ``spelt`` adds to a table of h.
    With it those pairs are judged where they meet, and only links become rows; pairs with a larger item are verified as rows.
    ``meet``, ``alike`` and ``judged`` get two functions that give a row's columns by name.
    """
    more = [c for c in index.columns if c not in ("h", "n", "key")]
    shared = index.groupBy("key").agg(F.count("*").alias("m"), F.min("h").alias("lead"), F.min_by(F.struct("n", *more), "h").alias("first")).where("m > 1")
    shared = materialize(shared.select("key", "lead", *[F.col(f"first.{c}").alias(f"lead_{c}") for c in ("n", *more)]), "block-buckets")
    members = materialize(index.join(broadcast_if_small(shared, 32 + 8 * len(more)), "key"), "block-members")
    discard(shared)
    if opened:
        opened(members)
    release(index.sparkSession)
    own, lead, other = F.col, lambda c: F.col(f"lead_{c}"), lambda c: F.col(f"{c}1")

    def close(a: Callable, b: Callable) -> Column:
        sizes = F.abs(a("n") - b("n")) <= most_apart(a("n"), b("n"), similarity)
        return sizes & meet(a, b) if meet else sizes

    links = verified(members.where((F.col("h") != F.col("lead")) & close(own, lead)).select(F.col("lead").alias("a"), F.col("h").alias("b")).distinct())
    release(index.sparkSession)
    parts = materialize(connected_components(links), "block-parts")
    release(index.sparkSession)
    tell = described or (lambda items: items)
    # sizes that a link can span are in one class or in neighbouring ones
    size = F.floor(F.log("n") / -math.log(similarity)).cast("int")

    def put(parts: DataFrame) -> DataFrame:
        named = broadcast_if_small(parts)
        of = lambda name, part: named.select(F.col("node").alias(name), F.col("root").alias(part))
        placed = members.join(of("h", "p"), "h", "left").join(of("lead", "q"), "lead", "left")
        placed = placed.select("key", "h", "n", *more, (F.col("h") == F.col("lead")).alias("leads"), F.coalesce("p", "h").alias("part"), F.coalesce("q", "lead").alias("main"), size.alias("class"))
        return materialize(placed, "block-placed")

    placed = put(parts)
    for draw in draws:
        differ = (F.min("part") != F.max("part")).alias("differ")
        open_ = materialize(placed.groupBy("key").agg(F.max(F.col("part") != F.col("main")).alias("open"), differ).where("open and differ").select("key"), "block-open")
        drawn = tell(placed.join(broadcast_if_small(open_), "key", "left_semi")).withColumn("class", F.explode(F.array("class", F.col("class") + 1)))
        drawn = drawn.select("key", "class", "h", "n", *more, "part", F.explode(draw).alias("value"))
        drawn = materialize(drawn, "block-drawn")
        least = drawn.groupBy("key", "class", "value").agg(F.min_by(F.struct("h", "n", *more, "part"), "h").alias("first"), differ).where("differ")
        least = materialize(least.select("key", "class", "value", *[F.col(f"first.{c}").alias(f"lead_{c}") for c in ("h", "n", *more, "part")]), "block-least")
        pairs = drawn.join(broadcast_if_small(least, 48 + 8 * len(more)), ["key", "class", "value"]).where((F.col("part") != F.col("lead_part")) & close(own, lead))
        found = verified(pairs.select(F.least("h", "lead_h").alias("a"), F.greatest("h", "lead_h").alias("b")).distinct())
        parts = _merged(parts, found)
        discard(open_, drawn, least, placed)
        placed = put(parts)
        release(index.sparkSession)
    discard(members)
    outside = tell(placed.where("part <> main").drop("leads", "main"))
    outside = outside.select("key", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"), *[F.col(c).alias(f"{c}1") for c in outside.columns if c not in ("key", "class")])
    outside = materialize(outside, "block-outside")
    asked = materialize(outside.select("key", "class").distinct(), "block-asked")
    written = [outside, asked]
    inside = tell(placed.where("not leads").join(broadcast_if_small(asked), ["key", "class"], "left_semi"))
    # two items that are both outside meet once
    across = (F.col("part") != F.col("part1")) & ((F.col("part") == F.col("main")) | (F.col("h") < F.col("h1"))) & close(own, other)
    across = across & alike(own, other) if alike else across
    row_bytes, ends = 320 if described else 48, [F.least("h", "h1").alias("a"), F.greatest("h", "h1").alias("b")]
    if judged:
        small = across & (F.greatest("n", "n1") < wide)

        def first(a: Column, b: Column) -> Column:
            """Whether no lesser key brings the two rows together, so that a pair is judged once."""
            at = lambda row, e: lambda c: e[c] if c in more else row(c)
            meets = lambda e, f: (e["key"] == f["key"]) & (meet(at(own, e), at(other, f)) if meet else F.lit(True))
            return ~F.exists(a, lambda e: (e["key"] < F.col("key")) & F.exists(b, lambda f: meets(e, f)))

        places = placed.groupBy("h").agg(F.collect_list(F.struct("key", *more)).alias("places"))
        verdict = F.when(first(F.col("places"), F.col("places1")), judged(own, other)).otherwise(False)
        links = _judged_in_tiles(inside, outside, small, verdict, lambda asked: spelt(asked).join(places, "h"), row_bytes).select(*ends).distinct()
        links = materialize(links, "block-links")
        release(index.sparkSession)
        # what reaches a size of ``wide`` is linked with nothing far below it
        large = wide * similarity - 1
        inside, outside, across = inside.where(F.col("n") >= large), outside.where(F.col("n1") >= large), across & (F.greatest("n", "n1") >= wide)
    more = verified(inside.join(broadcast_if_small(outside, row_bytes), ["key", "class"]).where(across).select(*ends).distinct())
    more = links.union(more) if judged else more
    discard(placed, *written)
    release(index.sparkSession)
    return _merged(parts, more).withColumnRenamed("node", "h")
