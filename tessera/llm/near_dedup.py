"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the weighted set of its five-word shingles (lower case; words are runs of letters and digits, or what
stands between blanks in a text without any; a text of fewer words is one shingle, an empty text has none). A shingle's
weight is its count times a damped inverse document frequency. Frequencies come from all documents: a count sketch of
fixed size (SLOTS counters, corrected for the mean collision) is filled in one pass, so its size does not grow with the
corpus. Two documents are linked if the weighted Jaccard similarity of their sets is at least `threshold`; classes are
the connected components of the links. Byte-equal texts are one class from the start and enter the search once.

Null text counts as empty; all empty texts are one class. A null doc_id is grouped like any other and never names a
class unless all ids of the class are null. Repeated rows are copies. An empty table gives an empty result. Columns
other than doc_id and text are ignored by near_duplicates() and passed through by drop_near_duplicates().
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, whole, written
from tessera.llm.lsh import linked, shared_buckets, sketch

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 15, 4
#: Candidates may differ in so many of the BANDS * ROWS sketch lanes: at the threshold 11 +- 3 do.
MOST = 28
_WORD = re.compile(r"[^\W_]+")
_ENTRY = np.dtype([("h", np.uint64), ("w", np.float32)])
#: Share of a weight that the inverse document frequency may add. Small, so that edits in a text with many copies
#: (whose shared shingles are frequent) do not outweigh what the copies share: of the pairs that hold without any
#: inverse frequency, 99 in 100 hold with 0.25, 85 with 1 and 63 without damping (sf0.1).
IDF_SHARE = 0.25
SLOTS = 1 << 20
MARKS = 1 << 23
BLOCK = 1 << 14
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts."""
    import xxhash

    low = (text or "").lower()
    found = _WORD.findall(low) or low.split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    width = min(SHINGLE, n)
    s = h[: n - width + 1].copy()
    for k in range(1, width):
        s = s * _P + h[k : n - width + 1 + k]
    return np.unique(_mix(s), return_counts=True)


class Weights:
    """Shingle weights from the corpus sketch; the same for every document."""

    def __init__(self, counts: np.ndarray, n_docs: int) -> None:
        total = float(counts.sum())
        df = np.maximum(1.0, counts - (total - counts) / (SLOTS - 1))
        n = max(1, n_docs)
        self.of_slot = (1 + IDF_SHARE * np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 1)).astype(np.float32)

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.of_slot[(hashes >> np.uint64(44)).astype(np.int64)] * counts.astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling. The random (r, c, beta) of a shingle and a sample are read from a table
    of TABLE triples at an index hashed from both, so equal shingles draw equal triples in every document.

    A shingle found once weighs between 1 and 1 + IDF_SHARE. For such weights the table also holds a lower bound of
    ln a, so that a sample needs one reading of each shingle; ln a itself is computed only where the bound does not
    exceed the value of the shingle with the least bound. The outcome is that of computing every ln a."""

    TABLE = 1 << 16
    FEW = 200  # fewer shingles are computed plainly, which is quicker for them

    def __init__(self, samples: int, seed: int = 7) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.r = rng.gamma(2, 1, self.TABLE).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, self.TABLE)).astype(np.float32)
        self.beta = rng.random(self.TABLE, dtype=np.float32)
        self.keys = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.top = np.float32(np.log1p(IDF_SHARE) + 1e-4)
        _, least = self._draw(np.arange(self.TABLE), np.full(self.TABLE, self.top))
        self.least = least - np.float32(1e-4) * (1 + np.abs(least))  # room for rounding

    def _draw(self, i: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(t, ln a) of table places i and weights."""
        r, beta = self.r[i], self.beta[i]
        t = np.floor(ln_w / r + beta)
        return t, self.ln_c[i] - r * (t - beta) - r

    def _at(self, h: np.ndarray) -> np.ndarray:
        return ((h[None, :] * self.keys[:, None]) >> np.uint64(48)).view(np.int64)

    def _plain(self, h: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least ln a, its shingle, value) of each sample; of equal ones that of the least shingle."""
        t, ln_a = self._draw(self._at(h), ln_w[None, :])
        k = ln_a.argmin(axis=1)
        row = np.arange(len(k))
        return ln_a[row, k], h[k], _mix(h[k] + _P * t[row, k].astype(np.int64).astype(np.uint64))

    def _bounded(self, h: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = self._at(h)
        bound = np.take(self.least, i, mode="clip")
        row, k = np.arange(len(i)), bound.argmin(axis=1)
        _, known = self._draw(i[row, k], ln_w[k])
        row, k = np.divmod(np.flatnonzero(bound <= known[:, None]), bound.shape[1])
        t, ln_a = self._draw(i[row, k], ln_w[k])
        order = np.lexsort((k, ln_a, row))
        first = order[np.searchsorted(row[order], np.arange(len(i)))]
        return ln_a[first], h[k[first]], _mix(h[k[first]] + _P * t[first].astype(np.int64).astype(np.uint64))

    def sample(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value per sample: the hash of the sampled shingle and its quantised weight."""
        ln = np.log(weights)
        light = (ln <= self.top) & (len(ln) >= self.FEW)
        best = None
        for find, of in ((self._bounded, light), (self._plain, ~light)):
            h_all, ln_all = hashes[of], ln[of]
            for at in range(0, len(h_all), 2048):  # bounds the memory of very long texts
                got = find(h_all[at : at + 2048], ln_all[at : at + 2048])
                if best is not None:
                    less = (got[0] < best[0]) | ((got[0] == best[0]) & (got[1] < best[1]))
                    got = tuple(np.where(less, x, y) for x, y in zip(got, best, strict=True))
                best = got
        return best[2]


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _P + v[:, k])
    return key.view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts[(shingles(text.as_py())[0] >> np.uint64(44)).astype(np.int64)] += 1  # distinct: a slot may repeat
            n += 1
    if n:
        blocks = [counts[k : k + BLOCK].astype(np.int32).tobytes() for k in range(0, SLOTS, BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary()), pa.array([n] + [0] * (len(blocks) - 1), pa.int64())],
            ["block", "counts", "docs"],
        )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for block, counts, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(block, [np.zeros(BLOCK, np.int64), 0])
            own[0] += np.frombuffer(counts, np.int32)
            own[1] += docs
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x[0].tobytes() for x in sums.values()], pa.binary()), pa.array([x[1] for x in sums.values()], pa.int64())],
            ["block", "counts", "docs"],
        )


def corpus_weights(texts: DataFrame) -> Weights:
    """Document frequencies of all documents. What reaches the driver is the sketch, 8 MB whatever the corpus."""
    parts = texts.mapInArrow(_count, "block int, counts binary, docs long").repartition("block")
    sums, n = np.zeros(SLOTS, np.int64), 0
    for row in parts.mapInArrow(_add, "block int, counts binary, docs long").collect():  # one row a block
        sums[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.int64)
        n += row.docs
    return Weights(sums, n)


def signatures(texts: DataFrame, weights) -> DataFrame:
    """text -> (node, keys, sketch): the text's md5, its band keys and its sketch, once per text and task."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, w, seen = Sampler(BANDS * ROWS), weights.value, set()
        for batch in batches:
            nodes, drawn = [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                node = hashlib.md5(text.encode()).digest()
                if node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                hashes, counts = shingles(text)
                if len(hashes):
                    nodes.append(node)
                    drawn.append(sampler.sample(hashes, w.of(hashes, counts)))
            lists = [np.empty((0, BANDS), np.int64), np.empty((0, 4), np.int64)]
            if nodes:
                lists = [np.stack([band_keys(v) for v in drawn]), sketch(np.stack(drawn))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), *[pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in lists]],
                ["node", "keys", "sketch"],
            )

    return texts.mapInArrow(sign, "node binary, keys array<long>, sketch array<long>")


def _drawer(weights):
    """text -> all its shingles, as hash and weight."""

    def draw(text: str) -> np.ndarray:
        hashes, counts = shingles(text)
        own = np.empty(len(hashes), _ENTRY)
        own["h"], own["w"] = hashes, weights.value.of(hashes, counts)
        return own

    return draw


def _same(threshold: float):
    """Whether two sets reach the threshold."""

    def same(x: np.ndarray, y: np.ndarray) -> bool:
        return _holds(x["h"], x["w"], float(x["w"].sum()), y["h"], y["w"], float(y["w"].sum()), threshold)

    return same


def _holds(ha, wa, sa: float, hb, wb, sb: float, threshold: float) -> bool:
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum())
    return both >= threshold * (sa + sb - both) - 1e-6


def _close(threshold: float, width: int = 2048):
    """Pairs whose similarity may reach the threshold. The root of a product of weights is at least the lesser of them,
    so a matrix product bounds what two texts share from above and no pair is missed."""

    def close(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        (x, i), (y, j) = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in (a, b))
        both = np.zeros((len(a), len(b)), np.float32)
        known = np.intersect1d(x["h"], y["h"])
        for lo in range(0, len(known), width):
            part = known[lo : lo + width]
            sides = []
            for v, owner, n in ((x, i, len(a)), (y, j, len(b))):
                near = (v["h"] >= part[0]) & (v["h"] <= part[-1])
                v, owner = v[near], owner[near]
                at = np.searchsorted(part, v["h"])
                hit = part[at] == v["h"]
                side = np.zeros((n, len(part)), np.float32)
                side[owner[hit], at[hit]] = np.sqrt(v["w"][hit])
                sides.append(side)
            both += sides[0] @ sides[1].T
        sa, sb = (np.bincount(k, v["w"].astype(float), len(s)) for v, k, s in ((x, i, a), (y, j, b)))
        total = sa[:, None] + sb[None, :]
        return both >= threshold * (total - both) - 1e-4 * total

    return close


def _verifier(texts: DataFrame, weights, threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, kept = weights.value, OrderedDict()

        def vector(node, text):
            if node in kept:
                kept.move_to_end(node)
            else:
                hashes, counts = shingles(text.as_py())
                kept[node] = hashes, (v := w.of(hashes, counts)), float(v.sum())
                if len(kept) > 256:
                    kept.popitem(last=False)
            return kept[node]

        for batch in batches:
            mask = []
            for a, b, ta, tb in zip(*batch.columns, strict=True):
                ha, wa, sa = vector(a.as_py(), ta)
                hb, wb, sb = vector(b.as_py(), tb)
                mask.append(_holds(ha, wa, sa, hb, wb, sb, threshold))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return with_b.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")

    return verify


def _marks(nodes: DataFrame) -> bytes:
    """A bit table of nodes, 1 MB whatever the corpus. Where it is crowded, more texts pass than needed and the join
    drops them. At most MARKS / 64 rows reach the driver."""
    slot = F.pmod(F.conv(F.substring(F.hex("node"), 1, 8), 16, 10).cast("long"), F.lit(MARKS))
    words = nodes.select(slot.alias("s")).selectExpr("cast(s div 64 as int) AS w", "shiftleft(1L, cast(s % 64 as int)) AS b")
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(MARKS // 64, np.uint64)
    table[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return table.tobytes()


def _picker(marks: bytes):
    """text -> (node, text) of the texts whose node is marked, and few others."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks, np.uint64)
        for batch in batches:
            nodes = [hashlib.md5((t.as_py() or "").encode()).digest() for t in batch.column(0)]
            slots = np.array([int.from_bytes(x[:4], "big") % MARKS for x in nodes], np.int64)
            held = pa.array((table[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column(0)], ["node", "text"]).filter(held)

    return pick


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((doc_id, node) of every row, (node, class_id, class_size, keeper, first) of every text)."""
    spark = docs.sparkSession
    node = F.unhex(F.md5(whole().cast("binary")))
    rows = docs.select("doc_id", node.alias("node"))
    texts = docs.select(whole().alias("text"))

    def classes() -> DataFrame:
        weights = spark.sparkContext.broadcast(corpus_weights(texts))
        signed = cut(signatures(texts, weights))
        bands = signed.select("node", F.explode("keys").alias("key")).distinct()
        shared = cut(shared_buckets(bands))
        used = cut(shared.select("node").distinct())
        sketches = signed.join(used, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))

        def fetch(nodes: DataFrame):
            few = texts.mapInArrow(_picker(_marks(nodes)), "node binary, text string")
            near = cut(few.join(nodes, "node", "left_semi").dropDuplicates(["node"]))
            return _verifier(near, weights, threshold), near

        roots = linked(cut(shared.join(sketches, "node")), fetch, _drawer(weights), _close(threshold), _same(threshold), MOST, char_bytes=2)
        firsts = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        named = cut(firsts.join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")))
        weights.destroy()
        # Written, so that the rows of a large class are split by the skew join.
        sizes = cut(named.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.min_by("node", F.struct(F.col("first").isNull(), "first", "node")).alias("keeper")))
        return named.join(sizes, "root").select("node", "class_id", "class_size", "keeper", "first")

    return rows, written(spark, classes)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), class_size (rows of the class)."""
    rows, classes = _classes(docs, threshold)
    return rows.join(classes, "node").select("doc_id", F.col("class_id").cast(T.LongType()), "class_size")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the least doc_id. All columns as they were."""
    rows, classes = _classes(docs, threshold)
    held = rows.join(classes, "node").groupBy("doc_id", "node", "keeper", "first").agg(F.count(F.lit(1)).alias("n"))
    held = cut(held.withColumn("stays", (F.col("keeper") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first"))))
    out = held.where("not stays").select(F.col("doc_id").alias("_gone_id"), F.col("node").alias("_gone_node"))
    kept = docs.join(out, docs["doc_id"].eqNullSafe(out["_gone_id"]) & (F.unhex(F.md5(whole(docs["text"]).cast("binary"))) == out["_gone_node"]), "left_anti")
    if held.where("stays and n > 1").limit(1).count():  # rows repeated with id and text: one of them stays
        kept = kept.withColumn("__tessera_node", F.md5(whole().cast("binary"))).dropDuplicates(["doc_id", "__tessera_node"]).drop("__tessera_node")
    return kept
