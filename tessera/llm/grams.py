"""Word n-gram probing on DataFrame functions: which windows of a text may equal a window of a small set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the slots (bytes) of a membership table, which travels with the tasks and stands in the plan's text.
SLOTS, MOST_SLOTS = 1 << 14, 1 << 22


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hash(hashes: Column, i: Column, k: int) -> Column:
    """Hash of the k word hashes from position i (0-based)."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]) if k > 1 else F.get(hashes, i)


def slots_of(windows: DataFrame, hash_col: str, each: int = 16) -> bytes:
    """The membership table of a window set, of about `each` slots a window: byte i is 1 if slot i is taken. At most
    MOST_SLOTS numbers reach the driver."""
    n = windows.select(hash_col).distinct().count()
    if not n:
        return b""
    size = min(MOST_SLOTS, max(SLOTS, 1 << (each * n - 1).bit_length()))
    flags = np.zeros(size, np.uint8)
    flags[windows.select(F.pmod(F.col(hash_col), F.lit(size)).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()] = 1
    return flags.tobytes()


def passes(number: Column, table: bytes) -> Column:
    """Whether the slot of a number is taken; false of an empty table."""
    if not table:
        return F.lit(False)
    return F.substring(F.lit(bytearray(table)), F.pmod(number, F.lit(len(table))).cast("int") + 1, F.lit(1)) == F.lit(bytearray([1]))


def probes(hashes: Column, n: Column, k: int, tables: list[tuple[int, bytes]]) -> Column:
    """Positions i of a text of n words whose window of k words may be in the set: none is missed. tables: (lead, table)
    in order; each table holds hashes of the windows' first `lead` words, and of the other positions at most the taken
    share of its slots passes. Positions are ints."""
    empty = F.expr("array()").cast("array<int>")
    if not all(t for _, t in tables):
        return empty
    at = F.when(n >= k, F.sequence(F.lit(0), (n - k).cast("int"))).otherwise(empty)
    for lead, table in tables:
        at = F.filter(at, lambda i: passes(window_hash(hashes, i, lead), table))  # noqa: B023
    return at
