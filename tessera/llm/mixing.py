"""Mixing sources to target weights, on DataFrame functions alone.

Every source's documents, in a hashed order, form one stream of words that is cut into blocks of a fixed length. The
mix has as many words as all documents together. Sources by code point (null last) weigh 1, 2, 3, repeating; a target
stops at MAX_EPOCHS times its source's size and what exceeds that is shared out again by weight. Each output shard
draws multinomial source counts: every slot picks its source by a hashed uniform number, with chances in proportion to
the targets in blocks. The drawn counts decide what is taken, so a source comes within about 1 / sqrt(its blocks to
take) of its target; sources are cut into MIN_BLOCKS blocks at least where they have the words for it. The slots of a
source are numbered through all shards and mapped to blocks by a keyed permutation per source and epoch (a Feistel
network with cycle walking), so a block is taken at most MAX_EPOCHS times; slots drawn beyond that stay empty. Blocks
are then joined by index. Everything follows from hashes of ids and texts: reruns agree.

Null texts have size 0 and are taken 0 times. Null sources are one source, sorted last. Rows repeated with id and text
are separate and interchangeable. No rows or only empty texts give targets of 0. Columns other than doc_id, source and
text are ignored by report() and blocks() and passed through by mix().

Scale: word positions come from sums per (source, hashed bucket) with about BUCKET_ROWS rows each, so a hot source is
spread over many tasks; the only windows over a whole source run on its buckets or shards, not on its documents.
Sources may be many: their running sums go through ranges, and slots find their source by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_WORD, cut, whole, words

MAX_EPOCHS = 3
BLOCK = 128
#: Blocks per source to aim at when a source is small; and at most, when it is huge.
MIN_BLOCKS, MAX_BLOCKS = 1 << 14, 1 << 30
SHARD_SLOTS = 1 << 14
BUCKET_ROWS = 20_000
#: Parts of the unit interval by which slots are joined to sources.
BINS = 1 << 12
ROUNDS, WALK = 4, 32
SEED = 11


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def sized(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Written rows (row, id, source, key, size, place): what the plan needs of each document; and, if whole_rows, the
    document itself as a struct."""
    size = F.regexp_count(whole(), F.lit(SPACE_WORD)).cast("long")
    return cut(docs.select(
        F.monotonically_increasing_id().alias("_row"), *([F.struct(*docs.columns).alias("_doc")] if whole_rows else []), F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
        _source_key(F.col("source")).alias("_key"), size.alias("_size"), F.xxhash64(F.col("doc_id"), whole()).alias("_place"),
    ))


def _running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with at (place in the order, from 1) and, for each of sums, before_<name>: its sum over the rows before. Rows
    are dealt by range and summed in their part; only one row a part meets in one task."""
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_over_{c}") for c in ("n", *sums)])
    inside = Window.partitionBy("_part").orderBy(*order)
    out = dealt.join(offsets, "_part").withColumn("at", F.col("_over_n") + F.row_number().over(inside))
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"_over_{c}") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_part", *[f"_over_{c}" for c in ("n", *sums)])


def targets(rows: DataFrame) -> DataFrame:
    """Per source: _key, source_size, target, block (length), blocks, goal (blocks to draw on average), share and lo (the
    part of the unit interval whose slots are the source's). One row per source."""
    per = rows.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("_size").alias("s"))
    by_source = [F.col("_source").isNull(), F.col("_source")]
    per = _running(per, by_source, []).withColumn("w", ((F.col("at") - 1) % 3 + 1).cast("double")).drop("at")
    # Water level: sources stop in the order of their cap per weight; the level is what is left per weight left.
    per = cut(_running(per.withColumn("full", F.col("s") / F.col("w")), [F.col("full"), *by_source], ["s", "w"]))
    total = per.agg(F.sum("s").alias("s"), F.sum("w").alias("w")).first()
    cap = MAX_EPOCHS * F.col("s")
    own = (F.lit(total.s) - MAX_EPOCHS * F.col("before_s")) / (F.lit(total.w) - F.col("before_w"))
    # The first source, in that order, that stays under its cap sets the level of all that are not capped before it.
    level = per.select(own.alias("own"), "at", "w", cap.alias("cap")).where("own * w <= cap").agg(F.min(F.struct("at", "own"))).first()[0]
    per = per.withColumn("target", F.least(cap.cast("double"), F.lit(level.own if level else 0.0) * F.col("w")))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"s div {MIN_BLOCKS}")), F.ceil(F.col("s") / MAX_BLOCKS)).cast("long")
    per = per.withColumn("block", block).withColumn("blocks", F.ceil(F.col("s") / F.col("block")).cast("long"))
    per = per.withColumn("goal", F.coalesce(F.col("target"), F.lit(0.0)) / F.col("block"))
    per = per.select("_key", "_source", F.col("s").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "block", "blocks", "goal")
    per = _running(per, by_source, ["goal"])
    return cut(per.select("_key", "source_size", "target", "block", "blocks", "goal", F.col("before_goal").alias("lo"), (F.col("before_goal") + F.col("goal")).alias("hi")))


def slots(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(id, shard, _key): the source that each slot of the mix draws. Slots are generated, not read; a slot finds its
    source through the bins of its uniform number."""
    total = plan.agg(F.max("hi")).first()[0] or 0.0
    n = round(total)
    if not n:
        return plan.limit(0).select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("shard"), "_key")
    part = lambda x: F.floor(x / F.lit(total) * F.lit(BINS))
    bins = plan.where("hi > lo").select("_key", "lo", "hi", F.explode(F.sequence(part(F.col("lo")), F.least(part(F.col("hi")), F.lit(BINS - 1)))).alias("bin"))
    uniform = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) * F.lit(2.0**-53) * F.lit(total)
    drawn = plan.sparkSession.range(n).select("id", F.expr(f"id div {SHARD_SLOTS}").alias("shard"), uniform.alias("u"))
    drawn = drawn.withColumn("bin", F.least(part(F.col("u")), F.lit(BINS - 1)))
    return drawn.join(bins, "bin").where("u >= lo and u < hi").select("id", "shard", "_key")


def draws(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Multinomial counts: (shard, _key, from, m): the m slots of the source in the shard are its slots from `from` on."""
    counts = slots(plan, seed).groupBy("shard", "_key").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("from", F.coalesce(F.sum("m").over(before), F.lit(0)))


def _permuted(x: Column, n: Column, key: Column) -> Column:
    """A keyed permutation of 0..n-1: a Feistel network over a grid of wide x high places (at least n, less than one row
    more), walked on until a place below n. A walk leaves n by as many places at most as the grid has too many; beyond
    WALK (chance below n ** -16) the place stays outside and matches no block."""
    wide = F.ceil(F.sqrt(n)).cast("long")
    high = F.ceil(n / wide).cast("long")

    def once(y: Column) -> Column:
        left, right = y % wide, F.floor(y / wide).cast("long")
        for k in range(ROUNDS):
            size = wide if k % 2 == 0 else high
            left, right = right, F.pmod(left + F.pmod(F.xxhash64(key, F.lit(k), right), size), size)
        return right * wide + left

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda y, _: F.when(y < n, y).otherwise(once(y)))


def _indexed(numbered: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """numbered: _key and slot (its number among the source's slots) -> with index, the block that fills it; without the
    slots beyond the last epoch."""
    at = numbered.join(plan.select("_key", "blocks"), "_key").where(F.col("slot") < MAX_EPOCHS * F.col("blocks"))
    index = _permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64("_key", F.expr("slot div blocks"), F.lit(seed)))
    return at.withColumn("index", index).drop("blocks")


def taken_blocks(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: (shard, slot, _key, index): which block of which source fills each drawn slot."""
    # A row stands for up to SHARD_SLOTS slots: dealt out by number, since few bytes would else end in one task.
    n = 4 * plan.sparkSession.sparkContext.defaultParallelism
    numbered = draws(plan, seed).repartition(n, "shard", "_key").select("shard", "_key", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("m") - 1)).alias("slot"))
    return _indexed(numbered, plan, seed)


def _pieces(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the blocks they touch: index, lo and hi (word positions in the document)."""
    n = rows.count()
    buckets = max(16, -(-n // BUCKET_ROWS))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("_place", F.lit(SEED)), F.lit(buckets)))
    inside = Window.partitionBy("_key", "bucket").orderBy("_place", "_row").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_key", "bucket").agg(F.sum("_size").alias("m"))
    across = Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_key", "bucket", F.coalesce(F.sum("m").over(across), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(offsets, ["_key", "bucket"])
    placed = placed.withColumn("start", F.col("offset") + F.col("inside")).drop("offset", "inside", "bucket").join(plan, "_key")
    touched = F.when(F.col("_size") > 0, F.sequence(F.expr("start div block"), F.expr("(start + _size - 1) div block")))
    pieces = placed.select(*placed.columns, F.explode_outer(touched).alias("index"))
    lo = F.greatest(F.lit(0), F.col("index") * F.col("block") - F.col("start"))
    hi = F.least(F.col("_size"), (F.col("index") + 1) * F.col("block") - F.col("start"))
    return pieces.select("_row", "_id", "_key", "_size", "source_size", "target", "index", "start", lo.alias("lo"), hi.alias("hi"))


def _taken(docs: DataFrame, seed: int, whole_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = sized(docs, whole_rows)
    plan = targets(rows)
    times = taken_blocks(plan, seed).groupBy("_key", "index").agg(F.count(F.lit(1)).alias("times"))
    return rows, _pieces(rows.drop("_doc"), plan).join(times, ["_key", "index"], "left")


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, with repeats)."""
    _, pieces = _taken(docs, seed)
    words_taken = F.sum((F.col("hi") - F.col("lo")) * F.coalesce("times", F.lit(0)))
    return pieces.groupBy("_row").agg(
        F.first("_id").alias("doc_id"), F.first("_size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.coalesce(words_taken, F.lit(0)).cast("long").alias("taken"),
    ).drop("_row")


#: A word with the white space behind it.
_TOKEN = SPACE_WORD + r"[\x20\x09-\x0D]*"


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each text replaced by the words the mix takes of it, white space and line breaks behind them included:
    first what is taken at least once, then, on new lines, what is taken again. A text taken exactly once as a whole
    stays as it is; documents of which nothing is taken go. n_chars, if there, follows the text. Same columns."""
    rows, pieces = _taken(docs, seed, whole_rows=True)
    lists = pieces.where("times > 0").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias("_parts"), F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("_sum"),
        F.max("times").alias("_most"),
    )
    own = F.col("_doc.text")
    joined = rows.join(lists, "_row").withColumn("_w", F.when((F.col("_sum") != F.col("_size")) | (F.col("_most") > 1), words(whole(own), _TOKEN)))

    def part(p: Column) -> Column:
        return F.slice("_w", (p.lo + 1).cast("int"), (p.hi - p.lo).cast("int"))

    again = F.transform(F.sequence(F.lit(1), F.lit(MAX_EPOCHS)), lambda e: F.array_join(F.flatten(F.transform(F.filter("_parts", lambda p: p.times >= e), part)), ""))
    out = joined.withColumn("_text", F.when(F.col("_w").isNull(), own).otherwise(F.array_join(F.filter(again, lambda x: x != ""), "\n")))
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text")}
    return out.select(*[fresh.get(c, F.col("_doc").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def blocks(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: (shard, place, source, n_words, text), a row for each filled slot, place being its number in the
    shard and text its block of the source's stream of words."""
    rows = sized(docs, whole_rows=True)
    plan = targets(rows)
    drawn = draws(plan, seed).select("shard", "_key", "from")
    rank = F.row_number().over(Window.partitionBy("shard", "_key").orderBy("id"))  # at most SHARD_SLOTS rows
    numbered = slots(plan, seed).withColumn("rank", rank).join(drawn, ["shard", "_key"]).select("shard", "id", "_key", (F.col("from") + F.col("rank") - 1).alias("slot"))
    texts = rows.select("_row", "_source", words(whole(F.col("_doc.text")), _TOKEN).alias("_w"))
    cutout = F.array_join(F.slice("_w", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), "")
    pieces = _pieces(rows.drop("_doc"), plan).where("hi > lo").join(texts, "_row").select("_key", "_source", "index", "start", "lo", "hi", cutout.alias("text"))
    filled = pieces.groupBy("_key", "index").agg(  # at most a block of words
        F.first("_source").alias("source"), F.sum(F.col("hi") - F.col("lo")).alias("n_words"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "lo", "text"))), lambda p: p.text), "\n").alias("text"),
    )
    return _indexed(numbered, plan, seed).join(filled, ["_key", "index"]).select("shard", (F.col("id") % SHARD_SLOTS).alias("place"), "source", "n_words", "text")


def write(docs: DataFrame, path: str, seed: int = SEED) -> None:
    """Writes blocks() as Parquet, every shard's rows side by side and in order of place."""
    blocks(docs, seed).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.parquet(path)
