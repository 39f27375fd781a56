"""What the operators of this package share: table access, word hashing, stored intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Registered:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in Arrow batches of 4 MB, unless the session says otherwise: long texts don't pile up."""
    if spark.conf.get(_BATCH) in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCH, "4m")


def tidy(mapper: Callable) -> Callable:
    """The mapper, giving memory back to the machine at its end: workers are kept for other tasks."""

    def run(batches):
        yield from mapper(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


class Memo(dict):
    """A dict that computes missing values and forgets everything when it holds `bound` entries."""

    def __init__(self, fn: Callable, bound: int = 200_000):
        super().__init__()
        self.fn, self.bound = fn, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
