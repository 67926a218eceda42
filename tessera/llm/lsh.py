"""Linked nodes from banded signatures, without enumerating all pairs of a large bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, written
from tessera.llm.graph import components

#: Buckets up to this size give all their pairs (at most 28); larger ones are linked through hubs.
SMALL = 8
#: A block of the comparison of what the hubs leave: at most about so many nodes and so many bytes of sets a side.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
#: Lanes of a sketch: four bits of each of up to 64 signature values, 16 to a 64-bit word.
LANES, WORDS = 64, 4


def sketch(values: np.ndarray) -> np.ndarray:
    """Signature values, shape (n, up to LANES) -> the lowest four bits of each, shape (n, WORDS), as int64."""
    low = np.zeros((len(values), LANES), np.uint64)
    low[:, : values.shape[1]] = values & np.uint64(15)
    lanes = low.reshape(len(values), WORDS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(lanes, axis=2).view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """In how many lanes two sketches differ."""
    def one(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    return one(0) + one(1) + one(2) + one(3)


def shared_buckets(bands: DataFrame) -> DataFrame:
    """Distinct (node, key) rows -> the rows (node, key, n) of keys that several nodes share; n counts the key's nodes.
    Keys are counted by partial aggregation and joined back from a written table, so a hot key is split by the skew join."""
    many = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return bands.join(many, "key")


#: Pairs (a, b) -> those that hold; and the written rows (node, text).
Texts = tuple[Callable[[DataFrame], DataFrame], DataFrame]


def linked(
    rows: DataFrame, fetch: Callable[[DataFrame], Texts], draw: Callable[[str], np.ndarray], close: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray],
    same: Callable[[np.ndarray, np.ndarray], bool], most: int, char_bytes: int,
) -> DataFrame:
    """(node, root) of the nodes that have links: the components of all links between nodes that share a bucket.

    rows: (node, key, n, sketch), of shared_buckets(), written. Pairs whose sketches differ in more than `most` lanes are
    no candidates. fetch: called once with the nodes that verification may need. draw: text -> its whole set, of about
    `char_bytes` bytes a character. close: two lists of sets -> matrix of the pairs that may hold, none missed. same:
    whether two sets hold.

    Small buckets give all pairs. In a larger bucket every member is paired with the bucket's hub (the member whose
    buckets are fullest) and with the hub of the members that also share its fullest other bucket: two rows a member
    instead of n/2. What these links leave, the pairs of different components in a large bucket, is then compared by
    whole sets, block by block and without making rows of the pairs; a block gives only the links that unite components
    in it. So no pair that shares a bucket stays untried unless its ends are in one component by then, where a link adds
    nothing. Blocks get the texts only of nodes whose sketch is near one of another component in their bucket, and draw
    the sets themselves: texts are smaller and compress.
    """
    return written(rows.sparkSession, lambda: _linked(rows, fetch, draw, close, same, most, char_bytes))


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _linked(rows, fetch, draw, close, same, most, char_bytes) -> DataFrame:
    small = rows.where(F.col("n") <= SMALL)
    other = small.select("key", F.col("node").alias("other"), F.col("sketch").alias("_other"))
    near = small.join(other, (small["key"] == other["key"]) & (F.col("node") < F.col("other")) & (differing(F.col("sketch"), F.col("_other")) <= most))
    pairs = _pairs(near)
    big = rows.where(F.col("n") > SMALL)
    has_big = big.limit(1).count() > 0
    if has_big:
        weight = cut(big.groupBy("node").agg(F.sum("n").alias("c"), F.max(F.struct("n", "key")).getField("key").alias("top")))
        big = cut(big.join(weight, "node").select("node", "key", "c", "top", "sketch"))
        # Written, so that a hot key is split by the skew join.
        hubs = cut(big.groupBy("key").agg(F.max(F.struct("c", "node", "sketch")).alias("hub")))
        subs = cut(big.groupBy("key", "top").agg(F.max(F.struct("c", "node", "sketch")).alias("hub")))
        for heads, on in ((hubs, ["key"]), (subs, ["key", "top"])):
            star = big.join(heads, on).where(differing(F.col("sketch"), F.col("hub.sketch")) <= most)
            pairs = pairs.union(_pairs(star.select("node", F.col("hub.node").alias("other"))))
    pairs = cut(pairs.distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    verify, texts = fetch(cut((nodes.union(big.select("node")) if has_big else nodes).distinct()))
    roots = components(cut(verify(pairs)))
    if has_big:
        rest = _near_others(big, roots, most)
        if rest.limit(1).count():
            found = cut(_left_over(rest, texts, draw, close, same, char_bytes))
            if found.limit(1).count():
                roots = _united(roots, found)
    return roots


def _blocks(rest: DataFrame, dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides (key, i, j, node, root, ...) of a comparison: the members outside a bucket's largest component
    against all members, dealt into high x wide blocks by a hash, so a bucket of any size is spread over many tasks."""
    laid = rest.join(dealt, "key").select("*", F.xxhash64("node").alias("h"))
    none, own = F.lit(0).cast("long"), [c for c in rest.columns if c not in ("key", "minor")]
    asks = laid.where("minor").select("key", F.pmod("h", "high").alias("i"), F.explode(F.sequence(none, F.col("wide") - 1)).alias("j"), *own)
    told = laid.select("key", F.explode(F.sequence(none, F.col("high") - 1)).alias("i"), F.pmod("h", "wide").alias("j"), *own)
    return asks, told


def _near_others(big: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(key, node, root, minor): the members of buckets with several components whose sketch differs in at most `most`
    lanes from that of a member of another component. minor: outside the bucket's largest component."""
    at = cut(big.join(roots, "node", "left").select("node", "key", "sketch", F.coalesce("root", "node").alias("root")))
    parts = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    split = cut(parts.groupBy("key").agg(
        F.max(F.struct("m", "root")).getField("root").alias("main"), F.sum("m").alias("n"), F.max("m").alias("most"), F.count(F.lit(1)).alias("parts"),
    ).where("parts > 1"))
    rest = cut(at.join(split.select("key", "main"), "key").select("key", "node", "root", "sketch", (F.col("root") != F.col("main")).alias("minor")))
    dealt = split.select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("wide"), F.ceil((F.col("n") - F.col("most")) / BLOCK_ROWS).alias("high"))
    asks, told = _blocks(rest, dealt)
    live = []
    for one, two in ((asks, told), (told, asks)):
        other = two.select("key", "i", "j", F.col("root").alias("_root"), F.col("sketch").alias("_sketch"))
        near = (F.col("root") != F.col("_root")) & (differing(F.col("sketch"), F.col("_sketch")) <= most)
        live.append(one.join(other, [one[c] == other[c] for c in ("key", "i", "j")] + [near], "left_semi").select("key", "node"))
    return cut(rest.drop("sketch").join(live[0].union(live[1]).distinct(), ["key", "node"], "left_semi"))


def _left_over(rest: DataFrame, texts: DataFrame, draw, close, same, char_bytes: int) -> DataFrame:
    """Links (a, b) that unite different components of one large bucket, found by whole sets in blocks; at most one link
    a member leaves a block."""
    sized = rest.join(texts.select("node", (F.length("text") * char_bytes).alias("bytes")), "node")

    def blocks(rows, size):
        return F.ceil(F.greatest(rows / BLOCK_ROWS, size / BLOCK_BYTES))

    dealt = cut(sized.groupBy("key").agg(
        blocks(F.count(F.lit(1)), F.sum("bytes")).alias("wide"),
        blocks(F.count_if("minor"), F.sum(F.when(F.col("minor"), F.col("bytes")).otherwise(0))).alias("high"),
    ))
    asks, told = (side.withColumn("asks", F.lit(mark)) for side, mark in zip(_blocks(rest, dealt), (True, False), strict=True))
    kind = rest.schema["node"].dataType.simpleString()

    def compare(block: pa.Table) -> pa.Table:
        asks = block["asks"].to_numpy()
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        of = block.schema.field("node").type
        if not len(one) or not len(two):
            return pa.table({c: pa.array([], of) for c in ("node", "other")})
        nodes, roots = (block[c].to_pylist() for c in ("node", "root"))
        sets: dict = {}  # a node may stand on both sides
        for node, text in zip(nodes, block["text"], strict=True):
            if node not in sets:
                sets[node] = draw(text.as_py())
        drawn = [sets[x] for x in nodes]
        index: dict = {}
        root = [index.setdefault(r, len(index)) for r in roots]
        may = close([drawn[k] for k in one], [drawn[k] for k in two])
        up = list(range(len(index)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        out: list[tuple] = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
            x, y = find(root[one[i]]), find(root[two[j]])
            if x != y and same(drawn[one[i]], drawn[two[j]]):
                up[x] = y
                out.append((nodes[one[i]], nodes[two[j]]))
        return pa.table({"node": pa.array([a for a, _ in out], of), "other": pa.array([b for _, b in out], of)})

    found = asks.union(told).join(texts.select("node", "text"), "node").groupBy("key", "i", "j").applyInArrow(compare, f"node {kind}, other {kind}")
    return _pairs(found).distinct()


def _united(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots with the components united that found links; both may name nodes the other does not."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    between = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(between).withColumnRenamed("node", "old").withColumnRenamed("root", "new")
    kept = roots.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    single = moved.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return kept.union(single)
