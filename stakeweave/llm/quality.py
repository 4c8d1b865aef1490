"""Quality rules by an isolation forest on rule statistics.

Each document's rule statistics (counts of words, symbols, repeated lines and repeated windows, and shares
made of them) are one row of numbers. Trees split one statistic at a random value, drawn over the range that
all rows span; they are grown on rows labelled good. A document whose path to a leaf is
short on average is an anomaly. The threshold on the score 2 ** (-path / c) is calibrated on all
labelled rows: of those that reject at most `spare` of the good ones, that which separates best.

The trees are fitted on a bounded sample: one row labelled good in each of SAMPLE hash buckets of doc_id. Everything else,
ranges, statistics, scores and calibration, covers all rows. Scores are binned (`bins`); of thresholds that separate equally well
the lowest is taken, and a score equal to it is rejected.

Base rules: under 10 words, or over 20 % of the words in 5-word windows that occur twice, fail. Null and empty
texts have no words and fail. Without labelled rows of both kinds only the base rules reject. Rows with a
null doc_id are scored but not used to calibrate; repeated rows are judged alike; labels that name a
document twice count its lowest quality; texts of any length are measured whole. Columns other than doc_id and text are ignored, whatever
their names. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, mapped, stored, window_hashes

SAMPLE, TREES, GROWN_ON, DEPTH = 4096, 128, 256, 10
SYMBOLS = "#*$%&|<>"
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ("symbols", "marks", "dup_lines", "repeats", "word_length", "capitals", "commonest", "digits", "stutter", "log_words")


def statistics(text: str | None, ids: WordIds) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), FEATURES."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeat, commonest, stutter = 0, 0, 0
    if n:
        own = ids.of(words)
        stutter = int((own[1:] == own[:-1]).sum())
        commonest = int(np.unique(own, return_counts=True)[1].max())
    if n >= 6:
        _, at, count = np.unique(window_hashes(own, 5), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int32)
        twice = np.flatnonzero(count[at] > 1)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 5, -1)
        repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    w, c = max(n, 1), max(chars, 1)
    features = (
        math.sqrt(symbols / c), math.sqrt((text.count("!") + text.count("?")) / c), math.sqrt(dup / max(len(lines), 1)), math.sqrt(repeat / w),
        math.log1p(chars / w), math.sqrt(sum(len(x) > 1 and x.isupper() for x in words) / w), commonest / w if n >= 20 else 0.0,
        math.sqrt(sum(map(text.count, "0123456789")) / c), math.sqrt(stutter / w), math.log1p(n),
    )
    return (n, chars, symbols, dup, repeat), features


def measured(docs: DataFrame) -> DataFrame:
    """BASE and a column x of FEATURES for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for batch in batches:
            both = [statistics(t, ids) for t in batch["text"]]
            out = pd.DataFrame([b for b, _ in both], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out["x"] = [f for _, f in both]
            yield out

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"{BASE}, x array<double>")


def mean_path(n: int) -> float:
    """c(n): the mean path of an unsuccessful search in a binary tree of n rows."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class Forest:
    """Random axis splits over the box from low to high, grown until `good` rows are alone or DEPTH is reached."""

    def __init__(self, good: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.c = mean_path(min(GROWN_ON, len(good)))
        self.trees = [self.grow(good[rng.permutation(len(good))[:GROWN_ON]], low.copy(), high.copy(), rng) for _ in range(TREES)]

    def grow(self, rows, low, high, rng):
        """(feature, value, left, right, path) arrays of one tree; a leaf has feature -1 and its path."""
        nodes: list[list] = []

        def node(rows, low, high, depth) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + mean_path(len(rows))])
            wide = np.flatnonzero(high > low)
            if len(rows) > 1 and depth < DEPTH and len(wide):
                f = int(rng.choice(wide))
                v = rng.uniform(low[f], high[f])
                left_high, right_low = high.copy(), low.copy()
                left_high[f] = right_low[f] = v
                below = rows[:, f] < v
                a = node(rows[below], low, left_high, depth + 1)
                b = node(rows[~below], right_low, high, depth + 1)
                nodes[at] = [f, v, a, b, 0.0]
            return at

        node(rows, low, high, 0)
        f, v, a, b, path = zip(*nodes, strict=True)
        return np.array(f), np.array(v), np.array(a), np.array(b), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / c), in (0, 1): near 1 for anomalies."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, v, a, b, path in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                if not inner.any():
                    break
                step = np.where(x[rows, f[at]] < v[at], a[at], b[at])
                at = np.where(inner, step, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.c, 1e-9))


def one_per_bucket(rows: DataFrame, buckets: int = SAMPLE) -> np.ndarray:
    """At most one row's x for each hash bucket of doc_id."""
    h = F.xxhash64("doc_id")
    ids = rows.filter("doc_id is not null").groupBy(F.pmod(h, F.lit(buckets)).alias("bucket")).agg(F.min(h).alias("h"), F.min_by("doc_id", h).alias("doc_id"))
    found = rows.join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "x").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    return np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))


def judged(docs: DataFrame, labels: DataFrame, spare: float = 0.005, bins: int = 2000) -> DataFrame:
    """BASE, score, base_failed and kept for every row of docs(doc_id, text), given labels(doc_id, quality)."""
    rows = stored(measured(docs), "quality")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    good = one_per_bucket(rows.join(marks.filter("quality = 1"), "doc_id", "left_semi"))
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    if not len(good):
        return rows.select("*", F.lit(0.0).alias("score"), base_failed.alias("base_failed"), (~base_failed).alias("kept")).drop("x")
    x = F.col("x")
    box = rows.agg(*[f(x[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(len(FEATURES))]).first()
    forest = docs.sparkSession.sparkContext.broadcast(Forest(good, np.array(box[: len(FEATURES)]), np.array(box[len(FEATURES) :])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch.pop("x").tolist(), float).reshape(-1, len(FEATURES))
            batch["score"] = forest.value.score(x) if len(x) else 0.0
            yield batch

    scored = mapped(rows, run, f"{BASE}, score double")
    counts = scored.join(marks, "doc_id").groupBy("quality", F.floor(F.col("score") * bins).alias("bin")).agg(F.count("*").alias("n")).toPandas()
    by = {q: np.bincount(g["bin"].astype(int), g["n"], bins + 1) for q, g in counts.groupby("quality")}
    threshold = 2.0
    if 0 in by and 1 in by:
        over = {q: np.cumsum(b[::-1])[::-1] / b.sum() for q, b in by.items()}  # share with a score in this bin or above
        gain = np.where(over[1] <= spare, over[0] - over[1], -1.0)
        threshold = float(np.argmax(gain)) / bins
    return scored.select("*", base_failed.alias("base_failed"), (~base_failed & (F.floor(F.col("score") * bins) / bins < threshold)).alias("kept"))
