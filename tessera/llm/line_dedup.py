"""Fuzzy line deduplication: MinHash over character shingles, banded, verified by exact Jaccard, united, one line kept.

A line is the text between line feeds, without blanks at its ends; lines without other characters are left alone. It
is the set of its runs of SHINGLE characters (a shorter line is one shingle). Signatures are one-permutation MinHash
over BINS bins with empty bins filled by fixed probing, so equal sets have equal signatures and each character is
hashed once. Bands of ROWS bins give candidates, exact Jaccard similarity of at least `threshold` verifies them, and
connected components of the links (distributed union-find) are classes. Of each class the first line in order of
(doc_id, line number) stays. Equal lines are one class from the start and enter the search once.

Null text has no lines. A null doc_id sorts last, so its lines yield to others. Rows repeated with id and text repeat
their lines: the first by row stays. An empty table gives an empty result. Columns other than doc_id and text are ignored
by dedup_lines() and passed through by without_lines(). Candidates of a hot band are linked through hubs, and what hubs
leave is compared in blocks (lsh.linked), never as rows of all pairs. Rows get their numbers in the one pass that is
written first, so they agree whatever the plan of `docs` does when it is run again.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, whole, written
from tessera.llm.lsh import WORDS, linked, shared_buckets, sketch

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 5
BINS = 64  # a power of two: the bin is the top bits of the hash; the first BANDS * ROWS bins are used
#: Candidates may differ in so many of the BINS sketch lanes: at the threshold 12 +- 3 do, in short lines +- 6.
MOST = 28
#: Bits of the table that marks which lines the verification needs: 4 MB, whatever the corpus. A number sets two bits, of
#: its lowest and its next 25. Where a table is crowded, more passes than needed and the join drops it. The tables of
#: shared keys and repeated lines have so many bits, or SLICE_BITS for each slice if that is more.
MARKS = 1 << 25
SLICE_BITS = 1 << 16
CHUNK = 1 << 20
#: Bits of a line's hash that go with its keys. Of the pairs that share a key with no third line, one in 2 ** WHO seems
#: one line and is not found. More bits leave fewer for the key, and more lines pass that share none.
WHO = 36
SEEN = 200_000
PIECE = 1 << 19
_EMPTY = np.uint64(0xFFFFFFFF)
_P = np.uint64(0x9E3779B97F4A7C15)
_P32 = np.uint32(0x9E3779B1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _short_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """32-bit hashes of the runs, for signatures only: 32-bit products run in vector units, 64-bit ones do not."""
    n = len(codes) - width + 1
    h = codes[:n]
    for k in range(1, width):
        h = h * _P32 + codes[k : n + k]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _probes() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(3))
    return np.stack([rng.permutation(BINS) for _ in range(8 * BINS)])


PROBES = _probes()


def line_hash(line: str) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width codes."""
    n = len(codes) - width + 1
    h = codes[:n].astype(np.uint64)
    for k in range(1, width):
        h *= _P
        h += codes[k : n + k]
    h *= _P
    return _mix(h)


def signatures(lines: list[str]) -> np.ndarray:
    """The least hash of each bin of each line (len >= 1), empty bins filled, shape (lines, BINS)."""
    least = np.full((len(lines), BINS), _EMPTY, np.uint32)
    flat = least.ravel()

    def add(codes: np.ndarray, owner: np.ndarray, width: int) -> None:
        h = _short_hashes(codes, width)
        own = np.flatnonzero(owner[: len(h)] == owner[width - 1 :])  # inside one line
        h = h[own]
        np.minimum.at(flat, owner[own] + (h >> np.uint32(32 - BINS.bit_length() + 1)), h)

    long = [k for k, x in enumerate(lines) if len(x) >= SHINGLE]
    sizes = [len(lines[k]) for k in long]
    if long:
        codes = np.frombuffer("".join([lines[k] for k in long]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.array(long, np.int64) * BINS, sizes)  # the place of its first bin
        for lo in range(0, len(codes), PIECE):  # pieces overlap by a shingle less one
            add(codes[lo : lo + PIECE + SHINGLE - 1], owner[lo : lo + PIECE + SHINGLE - 1], SHINGLE) if len(codes) - lo >= SHINGLE else None
    for k, x in enumerate(lines):
        if len(x) < SHINGLE:
            add(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), np.full(len(x), k * BINS), len(x))
    out = least.astype(np.uint64)
    full = out.copy()
    hollow = np.flatnonzero((out == _EMPTY).any(axis=1))
    if len(hollow):
        base, fill, left = out[hollow], full[hollow], np.arange(len(hollow))
        for t, probe in enumerate(PROBES):
            row, bin_ = np.nonzero(fill[left] == _EMPTY)
            if not len(row):
                break
            row = left[row]
            other = base[row, probe[bin_]]
            hit = other != _EMPTY
            fill[row[hit], bin_[hit]] = _mix(other[hit] + np.uint64(t + 1))
            left = np.unique(row)
        full[hollow] = fill
    return full


def band_keys(full: np.ndarray) -> np.ndarray:
    """Band keys of signatures, shape (lines, BANDS)."""
    key = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    rows = full[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS)
    for k in range(ROWS):
        key = _mix(key * _P + rows[:, :, k])
    return key.view(np.int64)


def _lists(rows: np.ndarray, fresh: list[bool]) -> pa.ListArray:
    """The rows as lists, one for each place that is fresh, and empty ones for the others."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fresh)]) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


_LINES = "row long, doc_id long, line int, node long, signed binary"
_PICKED = "row long, doc_id long, line int, node long, keys array<long>, sketch array<long>"


def _signed(full: np.ndarray, fresh: list[bool]) -> pa.Array:
    """Keys and sketch as bytes at each place that is fresh, none at the others."""
    ends = np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32) * np.int32(8 * (BANDS + WORDS))
    data = np.ascontiguousarray(np.hstack([band_keys(full), sketch(full)]))
    return pa.Array.from_buffers(pa.binary(), len(fresh), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _read_signed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which places are fresh, and their keys and sketches."""
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset)
    fresh = ends[1:] > ends[:-1]
    count = fresh.sum() * (BANDS + WORDS)
    both = np.frombuffer(data, np.int64, count, int(ends[0])) if count else np.empty(0, np.int64)
    both = both.reshape(-1, BANDS + WORDS)
    return fresh, both[:, :BANDS], both[:, BANDS:]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) -> (row, doc_id, line, node, signed); the last only where the task meets a line first. After
    its lines, each row of docs has one of line -1, whose node is the number of its lines."""
    seen: set[int] = set()

    def flush(rows, docs, at, nodes, fresh, lines):
        full = signatures(lines) if lines else np.empty((0, BINS), np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(nodes, pa.int64()), _signed(full, fresh)],
            ["row", "doc_id", "line", "node", "signed"],
        )

    rows, docs, at, nodes, fresh, lines, size = [], [], [], [], [], [], 0
    for batch in batches:
        for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            n = 0
            for k, line in enumerate(text.split("\n")):
                line = line.strip()
                if not line:
                    continue
                n += 1
                node = line_hash(line)
                rows.append(row)
                docs.append(doc)
                at.append(k)
                nodes.append(node)
                new = node not in seen
                fresh.append(new)
                if new:
                    if len(seen) < SEEN:
                        seen.add(node)
                    lines.append(line)
                    size += len(line)
            rows.append(row)
            docs.append(doc)
            at.append(-1)
            nodes.append(n)
            fresh.append(False)
            if size >= PIECE or len(rows) >= 20_000:
                yield flush(rows, docs, at, nodes, fresh, lines)
                rows, docs, at, nodes, fresh, lines, size = [], [], [], [], [], [], 0
    if rows:
        yield flush(rows, docs, at, nodes, fresh, lines)


def _marks(numbers: DataFrame) -> np.ndarray:
    """The bit table of a column of numbers; at most MARKS / 64 rows reach the driver."""
    x = numbers.columns[0]
    slots = numbers.selectExpr(f"explode(array({x} & {MARKS - 1}L, shiftrightunsigned({x}, 25) & {MARKS - 1}L)) AS s")
    words = slots.selectExpr("cast(s div 64 as int) AS w", "shiftleft(1L, cast(s % 64 as int)) AS b")
    table = np.zeros(MARKS // 64, np.uint64)
    got = cut(words.groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()  # written, as in _repeats()
    table[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return table


def _marked(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the 64-bit numbers may be in the table; none that is in it is missed."""
    held = np.ones(len(numbers), bool)
    for slots in (numbers & (MARKS - 1), (numbers >> 25) & (MARKS - 1)):
        held &= (table[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return held


def _places(values: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The slice of hashed 64-bit numbers, of their top bits, and the 64 - WHO bits below."""
    u, top = values.view(np.uint64), slices.bit_length() - 1
    return (u >> np.uint64(64 - top)).astype(np.int64), (u >> np.uint64(WHO - top)) & np.uint64((1 << (64 - WHO)) - 1)


def _slots(low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a number in its slice of width bits."""
    mask = np.uint64(width - 1)
    return ((low & mask).astype(np.int64), (((low * _P) >> np.uint64(32)) & mask).astype(np.int64))


def _width(slices: int) -> int:
    return max(MARKS // slices, SLICE_BITS)


def _deal(slices: int):
    """(node, signed) -> (slice, packed): for each key its bits below the slice and WHO bits of the node; in slices of
    their own, for each node its bits and a number of the place, another for each place it is found at."""

    def rows(kind: int, values: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
        at, low = _places(values, slices)
        order = np.argsort(at.astype(np.uint16), kind="stable")
        packed = ((low << np.uint64(WHO)) | who)[order]
        counts = np.bincount(at, minlength=slices)
        full = np.flatnonzero(counts)
        ends = np.concatenate([[0], np.cumsum(counts[full])]).astype(np.int32) * np.int32(8)
        data = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays([pa.array(full + kind * slices, pa.int32()), data], ["slice", "packed"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        chunk, size, held = 0, 0, []

        def flush():
            keys, owners, nodes = (np.concatenate([x[k] for x in held]) for k in range(3))
            yield rows(0, keys, owners.view(np.uint64) & np.uint64((1 << WHO) - 1))
            nodes, counts = np.unique(nodes, return_counts=True)
            place = np.uint64(2 * (part << 18 | chunk))
            known = part < 1 << WHO - 19 and chunk < 1 << 18  # else every line counts as repeated
            yield rows(1, nodes, np.full(len(nodes), place if known else 0, np.uint64))
            again = nodes[counts > 1] if known else nodes
            yield rows(1, again, np.full(len(again), place + np.uint64(1) if known else 1, np.uint64))

        for batch in batches:
            nodes, (fresh, keys, _) = batch.column(0).to_numpy(), _read_signed(batch.column(1))
            held.append((keys.ravel(), np.repeat(nodes[fresh], BANDS), nodes))
            size += len(held[-1][0]) + len(nodes)
            if size >= CHUNK:
                yield from flush()
                chunk, size, held = chunk + 1, 0, []
        if held:
            yield from flush()

    return deal


def _repeats(lines: DataFrame, slices: int) -> np.ndarray:
    """Two bit tables: of the keys of several lines, and of the lines found more than once. No such key or line is
    missed, but for lines equal in WHO bits of their hash that share a key with no other; few others are in a table. A
    slice is settled in one task and its bits reach the driver once. They are written first: toArrow() would leave the
    shuffle of all keys on disk until the driver collects its garbage."""
    width = _width(slices)

    def settle(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group["packed"].to_pylist()), np.uint64).copy()
        x.sort()
        low = x >> np.uint64(WHO)
        held = low[1:][(low[1:] == low[:-1]) & (x[1:] != x[:-1])]
        bits = np.zeros(width, bool)
        for at in _slots(held, width):
            bits[at] = True
        return pa.table({"slice": group["slice"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    dealt = lines.where("line >= 0").select("node", "signed").mapInArrow(_deal(slices), "slice int, packed binary")
    table = np.zeros((2 * slices, width // 8), np.uint8)
    settled = cut(dealt.groupBy("slice").applyInArrow(settle, "slice int, bits binary"))
    for at, bits in zip(*settled.toArrow().columns, strict=True):
        table[at.as_py()] = np.frombuffer(bits.as_py(), np.uint8)
    return table.reshape(2, -1)


def _repeated(table: np.ndarray, values: np.ndarray, slices: int) -> np.ndarray:
    """Which of the keys, or lines, may be in their table of _repeats()."""
    at, low = _places(values, slices)
    width = _width(slices)
    held = np.ones(len(values), bool)
    for slot in _slots(low, width):
        slot += at * width
        held &= (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    return held


def _picked(given: DataFrame) -> DataFrame:
    """The signed lines that may be in a class of several, with the keys that several lines share, and the sketch where
    there are any; and those of line -1. Written; the signed lines themselves go."""
    spark = given.sparkSession
    slices = 1 << min(max((int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), 4), 12)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, again = table.value
        for batch in batches:
            fresh, keys, sketches = _read_signed(batch.column(4))
            held = _repeated(shared, keys.ravel(), slices).reshape(keys.shape)
            n = np.zeros(len(fresh), np.int64)
            n[fresh] = held.sum(axis=1)
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(keys[held]))
            some = _lists(sketches[held.any(axis=1)], (n > 0).tolist())
            kept = (n > 0) | _repeated(again, batch.column(3).to_numpy(), slices) | (batch.column(2).to_numpy() < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], own, some], [*batch.schema.names[:4], "keys", "sketch"]).filter(pa.array(kept))

    def made() -> DataFrame:
        nonlocal table
        lines = cut(given.mapInArrow(_sign, _LINES))
        table = spark.sparkContext.broadcast(_repeats(lines, slices))
        return lines.mapInArrow(pick, _PICKED)

    table = None
    out = written(spark, made)
    table.destroy()
    return out


def _needed(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes, one row each, from the documents."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(nodes))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = marks.value, set()
        for batch in batches:
            lines = [x for text in batch.column(0) for x in map(str.strip, text.as_py().split("\n")) if x]
            hashes = [line_hash(x) for x in lines]
            found: dict[int, str] = {}
            for k in np.flatnonzero(_marked(table, np.array(hashes, np.int64))).tolist():
                if hashes[k] not in seen:
                    found[hashes[k]] = lines[k]
                    if len(seen) < SEEN:
                        seen.add(hashes[k])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["node", "text"])

    picked = docs.select(whole().alias("text")).mapInArrow(pick, "node long, text string")
    out = cut(picked.join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    marks.destroy()
    return out


def _verifier(texts: DataFrame, threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(node, text):
            node = node.as_py()
            if node not in kept:
                kept[node] = _line_shingles(text.as_py())
                if len(kept) > 1000:
                    kept.popitem(last=False)
            return kept[node]

        for batch in batches:
            mask = []
            for a, b, ta, tb in zip(*batch.columns, strict=True):
                mask.append(_holds(shingles(a, ta), shingles(b, tb), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return with_b.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")

    return verify


def _distinct(h: np.ndarray) -> np.ndarray:
    """h sorted, each number once; changes h."""
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def _line_shingles(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _distinct(shingle_hashes(codes, min(SHINGLE, len(codes))))


def _same(threshold: float):
    """Whether two sets reach the threshold."""

    def same(x: np.ndarray, y: np.ndarray) -> bool:
        return _holds(x, y, threshold)

    return same


def _holds(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    all_ = np.concatenate((x, y))
    all_.sort()
    both = np.count_nonzero(all_[1:] == all_[:-1])
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def _close(threshold: float, width: int = 2048):
    """Lines whose shared shingles are enough, counted by matrix products over `width` shingles at a time."""

    def close(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        (x, i), (y, j) = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in (a, b))
        both = np.zeros((len(a), len(b)), np.float32)
        known = np.concatenate((_distinct(x.copy()), _distinct(y.copy())))
        known.sort()
        known = known[1:][known[1:] == known[:-1]]
        found = []
        for v, owner in ((x, i), (y, j)):
            at = np.minimum(np.searchsorted(known, v), max(len(known) - 1, 0))
            hit = known[at] == v if len(known) else np.zeros(len(v), bool)
            order = np.argsort(at[hit], kind="stable")
            found.append((at[hit][order], owner[hit][order]))
        for lo in range(0, len(known), width):
            sides = []
            for (at, owner), n in zip(found, (len(a), len(b)), strict=True):
                own = slice(*np.searchsorted(at, [lo, lo + width]))
                side = np.zeros((n, min(width, len(known) - lo)), np.float32)
                side[owner[own], at[own] - lo] = 1
                sides.append(side)
            both += sides[0] @ sides[1].T
        na, nb = np.bincount(i, minlength=len(a)), np.bincount(j, minlength=len(b))
        return both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-3

    return close


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))


def line_classes(given: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, text) -> written rows (row, doc_id, line, root), root being the same for the lines of a class, of all
    lines in classes of several (few others among them); and for each row of `given` one of line -1, whose root is the number of its lines. `given` is numbered once."""

    def classes() -> DataFrame:
        picked = _picked(given)
        shared = shared_buckets(cut(picked.select("node", F.explode("keys").alias("key")).distinct()))
        sketches = picked.where("size(keys) > 0").groupBy("node").agg(F.first("sketch").alias("sketch"))

        def fetch(nodes: DataFrame):
            texts = _needed(given, nodes)
            return _verifier(texts, threshold), texts

        roots = linked(cut(shared.join(sketches, "node")), fetch, _line_shingles, _close(threshold), _same(threshold), MOST, char_bytes=8)
        own, sums = (picked.where(x).select("row", "doc_id", "line", "node") for x in ("line >= 0", "line < 0"))
        classed = own.join(roots, "node", "left").select("row", "doc_id", "line", F.coalesce("root", "node").alias("root"))
        return classed.union(sums)

    return written(given.sparkSession, classes)


def _dropped(given: DataFrame, threshold: float) -> DataFrame:
    """Per row of `given`: row, doc_id, n_lines, dropped."""
    classed = line_classes(given, threshold)
    own = classed.where("line >= 0")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "line")
    # Written, so that the lines of a large class are split by the skew join.
    first = cut(own.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "first.row", "first.line"))
    other = first.select("root", F.col("row").alias("_row"), F.col("line").alias("_line"))
    late = own.join(other, "root").where((F.col("row") != F.col("_row")) | (F.col("line") != F.col("_line")))
    gone = late.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("dropped"))  # a document's own lines
    sums = classed.where("line < 0").select("row", "doc_id", F.col("root").alias("n_lines"))
    return sums.join(gone, "row", "left").withColumn("dropped", F.coalesce("dropped", F.expr("array()").cast("array<int>")))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (with characters), n_dropped, dropped (sorted numbers of the lines that
    repeat an earlier line of any document, counted from 0 over all line feeds)."""
    return _dropped(_given(docs), threshold).select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def without_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the repeated lines taken out of text; rows may repeat ids. Same columns."""
    held = cut(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("row")))
    given = held.select("row", F.col("_doc.doc_id").cast("long").alias("doc_id"), whole(F.col("_doc.text")).alias("text"))
    gone = _dropped(given, threshold).where("size(dropped) > 0").select("row", "dropped")
    text = F.col("_doc.text")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    out = held.join(gone, "row", "left").withColumn("_text", F.when(F.col("dropped").isNull(), text).otherwise(kept))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])
