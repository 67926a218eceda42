"""Quality rules under weak supervision, on DataFrame functions alone.

Each rule votes good, bad or abstains; expectation-maximisation over the vote patterns of all documents estimates how
reliable each rule is; a document passes if its posterior chance to be good is at least one half, rather than only if
it meets every rule. Two hard limits (too short, mostly repetition) stay outside the vote.

Null text has no words and fails the length limit. Repeated rows are judged alike and separately. Ties at one half
pass. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_WORD, cut, whole, words
from tessera.llm.label_model import posteriors, vote

# Fixed values of the data contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def _repeated(w: Column, n: Column) -> Column:
    """The three-word windows of w as (two independent 64-bit hashes, position), sorted, so equal windows become
    neighbours: n log n, no per-word rows, and no limit but that of an array."""
    empty = F.expr("array()").cast("array<struct<h:bigint,g:bigint,i:int>>")

    def window(i: Column) -> Column:
        own = [F.get(w, i + k) for k in range(3)]
        return F.struct(F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(1), *own).alias("g"), i.alias("i"))

    return F.when(n >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).otherwise(empty)


def stats(docs: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, payload and the counts that the rules use."""
    text = F.col("_t")
    base = docs.select("doc_id", *payload, whole().alias("_t"))
    base = base.withColumn("_w", words(text, SPACE_WORD)).withColumn("_n", F.size("_w"))
    base = base.withColumn("_windows", _repeated(F.col("_w"), F.col("_n")))
    base = base.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SPACE_WORD)))
    w, p = F.col("_w"), F.col("_windows")

    def same(a: Column, b: Column) -> Column:
        """Two neighbours: equal hashes, then equal words."""
        equal = [F.get(w, a.i + k) == F.get(w, b.i + k) for k in range(3)]
        return (a.h == b.h) & (a.g == b.g) & equal[0] & equal[1] & equal[2]

    # A window repeats if it equals the one before or after it.
    hit = F.filter(p, lambda x, i: F.coalesce(same(x, F.get(p, i + 1)), F.lit(False)) | F.coalesce((i > 0) & same(x, F.get(p, i - 1)), F.lit(False)))
    base = base.withColumn("_hit", hit)
    covered = F.flatten(F.transform("_hit", lambda x: F.array(*[x.i + k for k in range(3)])))
    kept = F.translate(text, SYMBOLS, "")
    return base.select(
        "doc_id", *payload,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(kept)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_bang"),
    )


def rules() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    long = F.col("n_words") >= 20
    symbols, upper, bang = F.col("n_symbols"), F.col("n_upper"), F.col("n_bang")
    repeat, lines, mean = F.col("n_repeat_words") / n, F.greatest(F.col("n_lines"), F.lit(1)), chars / n
    return [
        vote(long & (symbols / n > 0.2), long & (symbols / n < 0.05)),
        vote(long & (symbols / chars > 0.04), long & (symbols / chars < 0.01)),
        vote(long & (upper / chars > 0.4), long & (upper / chars < 0.2)),
        vote(long & (bang / n > 0.2), long & (bang / n < 0.05)),
        vote((F.col("n_words") >= 50) & (repeat > 0.4), long & (repeat < 0.3)),
        vote((F.col("n_words") >= 50) & (F.col("n_distinct") / F.sqrt(n) < 3), long & (F.col("n_distinct") / F.sqrt(n) > 4)),
        vote((F.col("n_dup_lines") / lines > 0.4) & (F.col("n_dup_lines") > 2), F.col("n_dup_lines") / lines < 0.3),
        vote(long & ((mean > 15) | (mean < 2.5)), long & (mean > 3) & (mean < 12)),
    ]


def judged(docs: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """stats() with votes, posterior, base_failed and kept. Texts are read once: their counts are written first."""
    own = rules()
    voted = cut(stats(docs, payload).withColumn("votes", F.array(*own)))
    chance = F.broadcast(posteriors(voted, len(own)).select("votes", "posterior"))  # at most 3 ** rules rows
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.join(chance, "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior."""
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior",
    )
