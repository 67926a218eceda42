"""Token ids as raw binary shards with a minimal perfect hash index for keyed access.

write(): documents are dealt by range of doc_id (ties by text hash), so shards hold ascending ids; each task encodes its
whole texts, appends the end id, and writes one shard: a payload of raw little-endian ids (16 bits if the vocabulary
fits, else 32) and an index. The index holds, in row order, the document keys and token offsets, and a minimal perfect
hash of the shard's distinct keys: key -> bucket pilot -> slot -> (fingerprint, first row, rows). A lookup reads one
pilot and one slot whatever the shard's size; the stored fingerprint rejects keys that are not there (up to 2 ** -32).
The manifest (one row per shard) names the files of the tasks that succeeded; files of lost attempts have other names
and are never read. read(): the shards are read back through their indexes. Store: keyed access to all shards.

Null texts are empty: one end id. Rows with null ids come first; the index counts them and has no key for them.
Repeated ids are consecutive rows of one key (of one key per shard, where they span shards). An empty table writes no
shard. Columns other than doc_id and text are ignored. doc_id must be an integer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh_path, whole

MAGIC = b"TSRX\x02\x00\x00\x00"
BUCKET_KEYS = 4
#: Bytes of texts encoded together (a longer text alone).
GROUP = 4 << 20
END_ID = 2
_C = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct int64 keys -> (pilots, slot of each key). Buckets are placed from the fullest on: a pilot >= 0 is a
    seed under which all keys of the bucket fall into free slots; -1 - slot places a bucket of one key directly."""
    n = len(keys)
    u = keys.view(np.uint64)
    buckets = max(1, -(-n // BUCKET_KEYS))
    bucket = (_mix(u, 1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(counts)])
    pilots, slot, free = np.zeros(buckets, np.int32), np.empty(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-counts, kind="stable"):
        own = order[starts[b] : starts[b + 1]]
        if len(own) < 2:
            break
        seed = 2
        while True:  # each block of seeds at once
            seeds = np.arange(seed, seed + 32, dtype=np.uint64)
            at = (_mix(u[own][None, :] ^ (seeds[:, None] * _C), 3) % np.uint64(n)).astype(np.int64)
            good = free[at].all(axis=1)
            for k in np.flatnonzero(good):
                if len(np.unique(at[k])) == len(own):
                    pilots[b], slot[own], free[at[k]] = seed + int(k), at[k], False
                    break
            else:
                seed += 32
                continue
            break
    rest = iter(np.flatnonzero(free))
    for b in np.flatnonzero(counts == 1):
        at = next(rest)
        pilots[b], slot[order[starts[b]]] = -1 - at, at
    return pilots, slot


def find_slots(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    u = keys.view(np.uint64)
    pilot = pilots[(_mix(u, 1) % np.uint64(len(pilots))).astype(np.int64)].astype(np.int64)
    seeded = (_mix(u ^ (np.maximum(pilot, 0).astype(np.uint64) * _C), 3) % np.uint64(n)).astype(np.int64)
    return np.where(pilot < 0, -1 - pilot, seeded)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return _mix(keys.view(np.uint64), 5).astype(np.uint32)


_ENTRY = np.dtype([("fingerprint", "<u4"), ("rows", "<u4"), ("first", "<u8")])
HEAD = len(MAGIC) + 40


def index_bytes(keys: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """keys: of each row but the first ones, whose ids are null; equal keys side by side. offsets: of each row's first
    id, and of the end."""
    n_null = len(offsets) - 1 - len(keys)
    distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
    pilots, slot = build_hash(distinct)
    entry = np.zeros(len(distinct), _ENTRY)
    entry["fingerprint"][slot], entry["rows"][slot], entry["first"][slot] = fingerprints(distinct), rows, first + n_null
    head = MAGIC + struct.pack("<QQQQQ", width, len(offsets) - 1, n_null, len(distinct), len(pilots))
    return head + pilots.astype("<i4").tobytes() + entry.tobytes() + offsets.astype("<u8").tobytes() + keys.astype("<i8").tobytes()


class Index:
    """Random access to one shard through open, seekable files: a lookup reads the head once, then 4 bytes of pilot,
    16 of entry, 16 of offsets and the ids."""

    def __init__(self, index, payload) -> None:
        self.index, self.payload = index, payload
        head = self._at(0, HEAD)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token index")
        self.width, self.n_rows, self.n_null, self.n_keys, self.n_pilots = struct.unpack("<QQQQQ", head[len(MAGIC) :])
        self.entries = HEAD + 4 * self.n_pilots
        self.offsets = self.entries + 16 * self.n_keys

    def _at(self, start: int, size: int) -> bytes:
        self.index.seek(start)
        return self.index.read(size)

    def rows_of(self, key: int) -> tuple[int, int] | None:
        """(first row, rows) of a key, None if its fingerprint is not stored."""
        if not self.n_keys:
            return None
        k = np.array([key], np.int64)
        bucket = int(_mix(k.view(np.uint64), 1)[0] % np.uint64(self.n_pilots))
        pilot = np.frombuffer(self._at(HEAD + 4 * bucket, 4), "<i4")
        if pilot[0] < 0:
            slot = -1 - int(pilot[0])
        else:
            slot = int(_mix(k.view(np.uint64) ^ (pilot.astype(np.uint64) * _C), 3)[0] % np.uint64(self.n_keys))
        fingerprint, rows, first = struct.unpack("<IIQ", self._at(self.entries + 16 * slot, 16))
        return (first, rows) if fingerprint == int(fingerprints(k)[0]) else None

    def ids(self, row: int) -> np.ndarray:
        start, end = struct.unpack("<QQ", self._at(self.offsets + 8 * row, 16))
        self.payload.seek(start * self.width)
        return np.frombuffer(self.payload.read((end - start) * self.width), f"<u{self.width}").astype(np.uint32)

    def get(self, key: int) -> list[np.ndarray]:
        found = self.rows_of(key)
        return [self.ids(found[0] + k) for k in range(found[1])] if found else []


class Store:
    """Keyed access to all shards: the manifest's id ranges (16 bytes a shard) name the shard, its index the place."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        from pyarrow import fs

        shards = spark.read.parquet(f"{root}/manifest").where("first_id IS NOT NULL").orderBy("part").select("name", "first_id", "last_id").toArrow()
        self.names, self.first, self.last = shards["name"].to_pylist(), shards["first_id"].to_numpy(), shards["last_id"].to_numpy()
        self.files, self.base = fs.FileSystem.from_uri(root)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document of a key, in order; empty if there is none."""
        out = []
        for k in range(int(np.searchsorted(self.last, key, "left")), int(np.searchsorted(self.first, key, "right"))):
            at = f"{self.base}/{self.names[k]}"
            with self.files.open_input_file(f"{at}.idx") as index, self.files.open_input_file(f"{at}.ids") as payload:
                out += Index(index, payload).get(key)
        return out


class Encoder:
    """The tokenizer, asked once for what repeats.

    ASCII white space separates what the tokenizer encodes (its normaliser turns it into blanks, its splitter drops
    them), so pieces cut there encode as they do in the whole text. A piece of letters and then ASCII marks is split
    between the two by the splitter as well, so it is two parts, whatever pieces share them; but only where the tokenizer
    itself, asked about the last letter, cuts after it (some letters become a letter and a mark that joins those behind).
    Other pieces are one part. Of the texts of a call each distinct piece is cut once and each distinct part looked up
    once; parts not remembered yet are encoded together, blanks between, and the texts' ids are laid out by index.
    A part of letters or of marks is one word of the model as a rule, and ends with an id of its end-of-word suffix. As
    no part is without such an id, those of a run tell its parts apart if they are as many; else offsets do, as they do
    for other pieces. `remember=False`, for tokenizers without these properties, encodes whole texts. The memory is
    bounded and lasts for the worker."""

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which may join what follows
    #: Parts remembered, and their characters; parts encoded in a call of the tokenizer; ids laid out at once.
    PARTS, LONG, RUN, LAID = 600_000, 40, 500, 1 << 20
    _kept: dict[str, tuple] = {}

    def __init__(self, path: str, end_id: int, remember: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in self._kept:
            tokenizer = Tokenizer.from_file(path)
            self._kept[path] = tokenizer, self._word_ends(tokenizer), {}, {2: {"": b""}, 4: {"": b""}}
        self.tokenizer, self.word_ends, self.cuts, parts = self._kept[path]
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        self.parts, self.kind = parts[self.width], np.dtype(f"<u{self.width}")
        self.end, self.remember = end_id, remember

    @staticmethod
    def _word_ends(tokenizer) -> np.ndarray:
        """Whether an id ends a word; none does if the model might leave a word without such an id."""
        from tokenizers.pre_tokenizers import ByteLevel

        vocab, suffix = tokenizer.get_vocab(with_added_tokens=True), getattr(tokenizer.model, "end_of_word_suffix", None)
        out = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix and all(c in vocab and c + suffix in vocab for c in ByteLevel.alphabet()):
            out[[k for x, k in vocab.items() if x.endswith(suffix)]] = True
        return out

    def _cut_after(self, letter: str) -> bool:
        """Whether the tokenizer splits between the letter, as it normalises it, and a mark behind it."""
        got = self.cuts.get(letter)
        if got is None:
            normal = self.tokenizer.normalizer.normalize_str(letter)
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{normal}!")
            got = self.cuts[letter] = [x[1] for x in parts] == [(0, 1 + len(normal)), (1 + len(normal), 2 + len(normal))]
        return got

    def _encode(self, texts: list[str], words: bool) -> Iterator[bytes]:
        """The ids of each text; none has blanks. words: they are words of the model as a rule."""
        for lo in range(0, len(texts), self.RUN):
            own = texts[lo : lo + self.RUN]
            if words:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, self.kind)
                cuts = np.flatnonzero(self.word_ends[ids]) + 1
            if not words or len(cuts) != len(own):
                e = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
                ids = np.array(e.ids, self.kind)
                at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets))
                cuts = np.searchsorted(at, np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1))
            raw, cuts = ids.tobytes(), (cuts * self.width).tolist()
            yield from (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False))

    def _laid(self, ids: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
        """ids: those of spans of these sizes, one behind the other. The ids of the spans in an order."""
        start, sizes = np.cumsum(size) - size, size[order]
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, self.kind)
        lo = done = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(ends, done + self.LAID, "right")))
            n = sizes[lo:hi]
            at = np.repeat(start[order[lo:hi]] - (ends[lo:hi] - n), n)
            at += np.arange(done, int(ends[hi - 1]))
            out[done : ends[hi - 1]] = ids[at]
            lo, done = hi, int(ends[hi - 1])
        return out

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct texts without blanks -> their ids, one behind the other, and the numbers of them."""
        core = pc.ascii_rtrim(pieces, characters=self.MARKS)
        ascii_word, letters, whole_size = (x.to_numpy(zero_copy_only=False) for x in (pc.ascii_is_alpha(core), pc.binary_length(core), pc.binary_length(pieces)))
        ask = np.flatnonzero(~ascii_word & (letters > 0))
        cut = (x.isalpha() and (x[-1].isascii() or self._cut_after(x[-1])) for x in _strings(core.take(pa.array(ask))))
        odd = ask[~np.fromiter(cut, bool, len(ask))]
        first = np.cumsum(whole_size, dtype=np.int64) - whole_size
        at = np.empty(2 * len(pieces) + 1, np.int32)
        at[:-1:2], at[-1] = first, whole_size.sum()
        at[1::2] = first + letters
        at[1 + 2 * odd] = first[odd] + whole_size[odd]
        base = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset]
        parts = pa.StringArray.from_buffers(2 * len(pieces), pa.py_buffer(at + base), pieces.buffers()[2] or pa.py_buffer(b""))
        lower = np.zeros(2 * len(pieces), bool)
        lower[::2] = ascii_word
        parts = pc.if_else(pa.array(lower), pc.ascii_lower(parts), parts).dictionary_encode()
        names, others = _strings(parts.dictionary), set(_strings(pieces.take(pa.array(odd))))
        ids = list(map(self.parts.get, names))
        gaps = [k for k, x in enumerate(ids) if x is None]
        for words in (True, False):
            own = [k for k in gaps if (names[k] not in others) == words]
            for k, x in zip(own, self._encode([names[k] for k in own], words), strict=True):
                ids[k] = x
        kept = (k for k in gaps if len(names[k]) <= self.LONG)
        self.parts.update((names[k], ids[k]) for k in islice(kept, max(0, self.PARTS - len(self.parts))))
        size, order = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width, parts.indices.to_numpy()
        return self._laid(np.frombuffer(b"".join(ids), self.kind), size, order), size[order].reshape(-1, 2).sum(axis=1)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with their end ids, and the number of each text's."""
        if not len(texts):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        if not self.remember:
            got = [np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, self.end], self.kind) for t in texts.to_pylist()]
            return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
        cut_up = pc.ascii_split_whitespace(texts.cast(pa.string()))
        n = pc.list_value_length(cut_up).to_numpy()
        of = cut_up.flatten().dictionary_encode()
        ids, size = self._pieces(of.dictionary)
        ids, size = np.append(ids, self.kind.type(self.end)), np.append(size, 1)  # the end id as one more piece
        last = np.cumsum(n + 1, dtype=np.int64) - 1
        order, inner = np.full(int(last[-1]) + 1, len(size) - 1, np.int32), np.ones(int(last[-1]) + 1, bool)
        inner[last] = False
        order[inner] = of.indices.to_numpy()
        return self._laid(ids, size, order), np.add.reduceat(size[order], last - n)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, n = self.ids(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        return [ids[a:b].tobytes() for a, b in zip(ends - n, ends, strict=True)]


def _strings(texts: pa.StringArray) -> list[str]:
    """to_pylist() for texts without blanks, which takes many times longer."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), " ")[0].as_py().split(" ") if len(texts) else []


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int = END_ID, remember: bool = True) -> DataFrame:
    """Writes the shards under root and returns the manifest: name, width, keys from first_id on, n_docs, n_tokens,
    start (ids in all shards before). The manifest is committed as a table under root."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        encoder, keys, offsets, at = None, [], [np.zeros(1, np.int64)], 0  # the rows with null ids come first
        name, out = f"shard-{uuid.uuid4().hex}", None
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                if out is None:
                    encoder = Encoder(tokenizer, end_id, remember)
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}.ids")
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GROUP, "right")))
                ids, n = encoder.ids(batch.column(1).slice(lo, hi - lo))
                out.write(pa.py_buffer(ids))
                offsets.append(at + np.cumsum(n))
                at += len(ids)
                lo = hi
            keys.append(batch.column(0).drop_null().to_numpy())
        if out is not None:
            out.close()
            with files.open_output_stream(f"{base}/{name}.idx") as f:
                keys, offsets = np.concatenate(keys), np.concatenate(offsets)
                f.write(index_bytes(keys, offsets, encoder.width))
            yield pa.RecordBatch.from_pydict({"name": [name], "width": [encoder.width], "first_id": pa.array(keys[:1].tolist() or [None], pa.int64()), "last_id": pa.array(keys[-1:].tolist() or [None], pa.int64()), "n_docs": [len(offsets) - 1], "n_tokens": [at], "part": pa.array([_partition()], pa.int32())})

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), F.xxhash64(whole()).alias("_tie"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = cut(dealt.mapInArrow(shard, "name string, width long, first_id long, last_id long, n_docs long, n_tokens long, part int"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    manifest = shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.coalesce(1).write.parquet(f"{root}/manifest")
    return docs.sparkSession.read.parquet(f"{root}/manifest")


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read(spark: SparkSession, root: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian
    32-bit integers), read from the files through the index."""
    manifest = spark.read.parquet(f"{root}/manifest").select("name", "start")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(f"{base}/{name}.idx") as f:
                    raw = f.read()
                width, n, n_null, n_keys, n_pilots = struct.unpack("<QQQQQ", raw[len(MAGIC) : HEAD])
                pilots = np.frombuffer(raw, "<i4", n_pilots, HEAD)
                entry = np.frombuffer(raw, _ENTRY, n_keys, HEAD + 4 * n_pilots)
                offsets = np.frombuffer(raw, "<u8", n + 1, HEAD + 4 * n_pilots + 16 * n_keys).astype(np.int64)
                keys = np.frombuffer(raw, "<i8", n - n_null, HEAD + 4 * n_pilots + 16 * n_keys + 8 * (n + 1))
                got = entry[find_slots(keys, pilots, n_keys)] if n_keys else entry
                row = np.arange(n_null, n)
                if not ((got["fingerprint"] == fingerprints(keys)) & (got["first"] <= row) & (row < got["first"] + got["rows"])).all():
                    raise ValueError(f"{name}: the index does not hold its keys")
                crcs = np.empty(n, np.int64)
                with files.open_input_stream(f"{base}/{name}.ids") as f:
                    for k in range(n):
                        size = int(offsets[k + 1] - offsets[k])
                        crcs[k] = zlib.crc32(np.frombuffer(f.read(size * width), f"<u{width}").astype("<u4").tobytes())
                nulls, ids = np.arange(n) < n_null, np.concatenate([np.zeros(n_null, np.int64), keys])
                for lo in range(0, n, 50_000):
                    hi = min(n, lo + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi], pa.int64(), mask=nulls[lo:hi]), pa.array(start + offsets[lo:hi]), pa.array(offsets[lo + 1 : hi + 1] - offsets[lo:hi]), pa.array(crcs[lo:hi])],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # One shard a task: the manifest is dealt out by name.
    return manifest.repartition(spark.sparkContext.defaultParallelism * 4, "name").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """write() to a fresh folder of the shared storage, then read()."""
    root = fresh_path(docs.sparkSession, "tokens")
    write(docs, root, tokenizer, end_id)
    return read(docs.sparkSession, root)

