"""Shared helpers: table access, tables written to the shared folder, word hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeweave.plans.iterate import cut, dropped, shared_dir  # noqa: F401  (the operators take them from here)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return cut(df, tag)


SMALL_ROWS, SMALL_BYTES = 500_000, 32 << 20


def small_side(df: DataFrame, tag: str, text: str | None = None) -> DataFrame:
    """df, stored; marked for broadcast only if its counted rows and the bytes of its text column are below the bounds."""
    df = stored(df, tag)
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b") if text else F.lit(0).alias("b")).first()
    return F.broadcast(df) if size.n <= SMALL_ROWS and size.b <= SMALL_BYTES else df


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of what has been stored: it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
ROWS_CONF, BYTES_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """mapInPandas with bounded memory: a batch ends at BATCH_ROWS rows or with the row that reaches BATCH_BYTES (settings of
    the session), and workers, which Spark reuses, hand back what they have freed when a task ends."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(ROWS_CONF)) <= BATCH_ROWS:
        spark.conf.set(ROWS_CONF, str(BATCH_ROWS))
    spark.conf.set(BYTES_CONF, str(BATCH_BYTES))

    def tidy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return df.mapInPandas(tidy, schema)


def hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def free_names(taken: list[str], *own: str) -> list[str]:
    """The names of an operator's own columns: with as many underscores after them as keep them apart from those of the input."""
    low = {n.lower() for n in taken}
    out = []
    for name in own:
        while name.lower() in low:
            name += "_"
        low.add(name)
        out.append(name)
    return out


class WordIds(dict):
    """Word (bytes) -> 64-bit hash; emptied when it reaches `bound` words, so memory stays bounded."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, in UTF-8 (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of `width` ids, in order of position."""
    n = len(ids) - width + 1
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h ^= ids[j : j + n]
        h *= _ODD[0]
        h ^= h >> np.uint64(29)
    h *= _ODD[1]
    return h ^ (h >> np.uint64(32))


def connected_components(edges: DataFrame, tag: str, limit: int = 100) -> DataFrame:
    """Components of undirected edges(a, b) as (node, component): component is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then follows the label's own label, so
    that long paths halve. Only joins and map-side combined minima: hubs are never gathered in one place.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = stored(both.toDF("node", "other"), f"{tag}-edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), f"{tag}-labels")
    for _ in range(limit):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        best = labels.join(near, "node").select("node", F.least("component", "near").alias("best"), "component")
        jump = labels.select(F.col("node").alias("best"), F.col("component").alias("far"))
        new = stored(best.join(jump, "best", "left").select("node", F.least("best", "far").alias("component"), (F.least("best", "far") != F.col("component")).alias("moved")), f"{tag}-labels")
        moved = new.filter("moved").limit(1).count()
        dropped(labels)
        labels = new.select("node", "component")
        if not moved:
            dropped(both)
            return labels
    raise RuntimeError(f"components have not settled after {limit} rounds")
