"""Word and shingle helpers that run inside Python tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import SparkSession

WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; a null text has none."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a fixed number of words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, items: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a rolling hash, so that its high and low bits are both usable."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every run of k words, in order; a text of fewer words is one shingle, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * STEP + hashes[j : n - k + 1 + j]
    return mixed(out)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send at most so many texts at once to a Python worker, so that its memory does not depend on Spark's default of 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
