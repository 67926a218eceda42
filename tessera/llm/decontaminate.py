"""Benchmark decontamination: word windows of benchmark items found in documents, on DataFrame functions alone.

A window is `width` consecutive words of an item (an item of fewer words, but not none, is one window). Two membership
tables of bounded size, of the hashes of the windows' first LEAD words and of all their words, go to every task. Each
document's windows are probed against them in place; the few that pass are joined with the window set on all their
words, which verifies them. The window set is broadcast only while its measured bytes stay under BROADCAST_BYTES; above
that the join shuffles the passed windows. No text is shuffled. report() marks documents, decontaminate() removes them,
without_spans() removes the hit words alone.

Null texts have no words. Null item ids are left out of item lists and counts, but their windows still hit. Repeated
rows are separate documents; repeated items count once by id. Empty tables give no hits or no rows. Other columns of
either table are ignored by hits() and passed through by decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM_WORD, ascii_lower, cut, whole, words
from tessera.llm.grams import probes, slots_of, window_hash, word_hashes

WIDTH = 10
LEAD = 3
BROADCAST_BYTES = 8 << 20


def _words(text: Column) -> Column:
    return words(ascii_lower(whole(text)), ALNUM_WORD)


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id string, k, window, h, full): the distinct windows of each item, k words joined by a blank, the hash of
    the first LEAD of them and of all."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), _words(F.col("text")).alias("w"))
    sized = split.withColumn("n", F.size("w")).withColumn("k", F.least("n", F.lit(width))).where("n > 0")
    at = sized.select("item_id", "k", "w", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("i"))
    cutout = at.select("item_id", "k", F.slice("w", F.col("i") + 1, F.col("k")).alias("v"))

    def hashed(most: int) -> Column:
        own, all_ = F.lit(None).cast("long"), word_hashes(F.col("v"))
        for k in range(1, most + 1):
            own = F.when(F.least("k", F.lit(most)) == k, window_hash(all_, F.lit(0), k)).otherwise(own)
        return own

    return cutout.select("item_id", "k", F.array_join("v", " ").alias("window"), hashed(LEAD).alias("h"), hashed(width).alias("full")).distinct()


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, hit (array of distinct hit word positions), items (sorted array of
    item ids as strings), and the columns named in payload."""
    bench = cut(benchmark_windows(items, width))
    sizes = sorted(r.k for r in bench.select("k").distinct().collect())  # at most `width` numbers
    split = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *payload, _words(F.col("text")).alias("_w"))
    hashed = split.withColumn("_h", word_hashes(F.col("_w"))).withColumn("n_words", F.size("_w"))

    def passing(k: int) -> Column:
        own = bench.where(F.col("k") == k)
        at = probes(F.col("_h"), F.col("n_words"), k, [(min(LEAD, k), slots_of(own, "h")), (k, slots_of(own, "full"))][: 2 if k > LEAD else 1])
        return F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), F.array_join(F.slice("_w", i + 1, k), " ").alias("window")))

    found = [passing(k) for k in sizes]
    none = F.expr("array()").cast("array<struct<i:int,k:int,window:string>>")
    passed = hashed.select("_row", "doc_id", *payload, "n_words", F.explode_outer(F.concat(*found) if found else none).alias("p"))
    probed = passed.select("_row", "doc_id", *payload, F.col("n_words").cast("long").alias("n_words"), "p.i", "p.k", "p.window")
    by_window = bench.groupBy("k", "window").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.lit(True).alias("real"))
    size = bench.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        by_window = F.broadcast(by_window)
    joined = probed.join(by_window, ["k", "window"], "left")
    real = F.col("real").isNotNull()
    per_doc = joined.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.first(c).alias(c) for c in payload],
        F.first("n_words").alias("n_words"),
        F.collect_set(F.when(real, F.struct("i", "k"))).alias("spans"),
        F.collect_set(F.when(real & (F.size("ids") > 0), F.col("ids"))).alias("ids"),
    )
    return per_doc.select(
        "doc_id", *payload, "n_words",
        F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.i, s.i + s.k - 1)))).alias("hit"),
        F.sort_array(F.array_distinct(F.flatten("ids"))).alias("items"),
    )


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(docs, items, width).select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def _marked(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(_id, _key, hit, n_words): one row for each doc_id and text hash with hits."""
    own = hits(docs.select("doc_id", "text", F.xxhash64(whole(docs["text"])).alias("_key")), items, width, payload=("_key",))
    return own.where(F.size("hit") > 0).select(F.col("doc_id").alias("_id"), "_key", "hit", F.col("n_words").alias("_n")).dropDuplicates(["_id", "_key"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, max_share: float = 0.0) -> DataFrame:
    """docs without the documents of which more than max_share of the words are hit. Same columns. Rows are matched by
    doc_id and text hash, so repeated ids do not mix."""
    bad = cut(_marked(docs, items, width).where(F.size("hit") > F.col("_n") * max_share).select("_id", "_key"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(whole(docs["text"])) == bad["_key"]), "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the hit words, and what stands between them and the next word, taken out of text; other texts stay as
    they are. Same columns."""
    bad = cut(_marked(docs, items, width).select("_id", "_key", F.col("hit").alias("_hit")))
    joined = docs.select(F.struct(*docs.columns).alias("_doc")).join(
        bad, F.col("_doc.doc_id").eqNullSafe(bad["_id"]) & (F.xxhash64(whole(F.col("_doc.text"))) == bad["_key"]), "left")
    text, gap = F.col("_doc.text"), "[" + ALNUM_WORD[2:-2] + "]*"
    tokens = words(text, ALNUM_WORD + gap)
    kept = F.concat(F.regexp_extract(text, "^" + gap, 0), F.array_join(F.filter(tokens, lambda w, i: ~F.array_contains("_hit", i)), ""))
    out = F.when(F.col("_hit").isNull(), text).otherwise(kept)
    return joined.select(*[out.alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])


REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)
), h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win
), pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
