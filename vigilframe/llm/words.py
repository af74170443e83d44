"""Hashes of words and word shingles, and counter tables summed over all partitions.

Words are what white space (space, \\t to \\r) separates; they are cut from UTF-8 bytes,
so that only ASCII white space counts. Everything works on whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.session import work_folder

STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
PART = 1 << 14  # counters in one row
ROWS = 1024  # documents whose texts a task takes up at once


def settle(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the folder all executors share."""
    work_folder(frame.sparkSession)
    return frame.checkpoint()


class Memo(dict):
    """What a function gives for each key; forgets all once `most` keys are held."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def slices(batches, rows: int = ROWS):
    """The same rows in batches of at most `rows`: Spark's hold 10 000 texts, and what is made of them is a multiple of that."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_hashes(text: bytes, memo: Memo) -> np.ndarray:
    """64-bit hashes of the words in order; `memo` maps a word to its 8 bytes."""
    return np.frombuffer(b"".join(map(memo.__getitem__, text.split())), np.uint64)


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_digest)


def scatter(h: np.ndarray) -> np.ndarray:
    """Mixes all bits of 64-bit numbers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width` consecutive words; fewer words count as one shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    used = min(n, width)
    h = np.full(n - used + 1, used, np.uint64)
    for j in range(used):
        h = (h ^ words[j : n - used + 1 + j]) * STEP
        h ^= h >> np.uint64(32)
    return np.unique(scatter(h))


def summed_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds counter arrays (`counts`, see packed) per key in two rounds.

    A round takes at most 64 arrays of one key together, so no task gathers what all
    partitions have counted before it has been added up.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", counts binary"

    def add(pdf):
        total = unpacked(pdf["counts"].iloc[0]).copy()
        for counts in pdf["counts"].iloc[1:]:
            total += unpacked(counts)
        out = pdf[keys].head(1).copy()
        out["counts"] = [packed(total)]
        return out

    first = rows.groupBy(*keys, (F.col("pid") / 64).cast("long").alias("lane")).applyInPandas(add, schema)
    return first.groupBy(*keys).applyInPandas(add, schema)


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def counter_rows(pid: int, tables: dict, part: int = PART) -> Iterator[dict]:
    """Cuts counter arrays into parts: one row for each key and part that is not all zero."""
    for key, counts in tables.items():
        for i in range(0, len(counts), part):
            piece = counts[i : i + part]
            if piece.any():
                yield {"key": key, "part": i // part, "pid": pid, "counts": packed(piece)}


def has_rows(frame: DataFrame) -> bool:
    return bool(frame.take(1))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
