"""Evaluation of resolution: confusion counts, precision and recall, blocking counts, threshold sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stakeweave.functions.names import token_match
from stakeweave.plans.iterate import cut, some

from . import resolve


def scores(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of pairs(truth boolean, found boolean); empty denominators count 1, 1 and 0."""
    n = lambda c: F.count_if(c)
    t, f = F.col("truth"), F.col("found")
    c = pairs.agg(n(t & f).alias("tp"), n(~t & f).alias("fp"), n(t & ~f).alias("fn"), n(~t & ~f).alias("tn"))
    share = lambda x, y, empty: F.when(y == 0, empty).otherwise(x / y)
    c = c.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))
    return c.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def blocking_counts(keys: DataFrame, widths: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """width, comparisons, matches of prefix blocking for each width of the block (one letter or more).

    No pair is made to be counted. A block of n keys has n (n - 1) / 2 pairs, and a key shorter than the block one with every longer key
    that it begins; what matches in a wider block also does in the narrowest.
    """
    keys = cut(keys.select("entity_type", "key").distinct())
    lengths = F.sequence(F.lit(0), F.least(F.lit(max(widths)), F.length("key")))
    starts = keys.select("entity_type", "key", F.explode(lengths).alias("n")).select("entity_type", "n", F.substring("key", F.lit(1), F.col("n")).alias("start"), (F.length("key") == F.col("n")).alias("whole"))
    blocks = starts.groupBy("entity_type", "n", "start").agg(F.count("*").alias("size"), F.bool_or("whole").alias("whole"))
    size = F.col("size")
    made = lambda w: F.when(F.col("n") == w, F.expr("size * (size - 1) div 2")).when((F.col("n") < w) & F.col("whole"), size - 1)
    comparisons = blocks.agg(*[F.coalesce(F.sum(made(w)), F.lit(0)).alias(str(w)) for w in widths])
    met = resolve.fuzzy_pairs(keys, width=min(widths))
    matches = met.agg(*[F.count_if(F.startswith("b", F.substring("a", 1, w))).alias(f"m{w}") for w in widths])
    each = F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"`{w}`").alias("comparisons"), F.col(f"m{w}").alias("matches")) for w in widths])
    return comparisons.join(matches).select(F.inline(each))


THRESHOLDS = (0.6, 0.7, 0.8, 0.9)


def threshold_sweep(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, matches of pairs(a, b) by token comparison at each threshold."""
    counts = pairs.agg(*[F.count_if(token_match(F.col("a"), F.col("b"), t)).alias(str(t)) for t in thresholds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`{t}`").alias("matches")) for t in thresholds])).alias("x")).select("x.*")


# the steps of resolution, added one by one; the last two compare whole keys in place of words
ABLATIONS = {
    "normalised only": {"capacity": False, "truncation": False, "fuzzy": False}, "capacity": {"truncation": False, "fuzzy": False}, "truncation": {"fuzzy": False}, "fuzzy": {},
    "whole keys 0.8": {"token_guard": False, "key_threshold": 0.8}, "whole keys 0.9": {"token_guard": False, "key_threshold": 0.9},
}


def ablations(filed: DataFrame, pairs: DataFrame, configs: dict[str, dict] | None = None) -> DataFrame:
    """config, entities and scores on labelled pairs(a, b, filed_type, truth) of filed(raw, filed_type, listed) for each way of resolution."""
    out, seen = [], {}
    for config, switches in (configs or ABLATIONS).items():
        own = dict(switches)
        capacity = own.pop("capacity", True)
        obs = seen[capacity] = seen.get(capacity) or resolve.observations(filed, capacity=capacity)
        # without CINs no union is refused
        roots, _ = resolve.merged(obs, cut(resolve.merge_candidates(obs, **own, components=not some(obs.filter("cin is not null")))))
        root = cut(obs.join(roots, ["entity_type", "key"]).select("raw", "filed_type", F.concat_ws("\u0001", "entity_type", "root").alias("root")))
        told = pairs.join(root.withColumnsRenamed({"raw": "a", "root": "root_a"}), ["a", "filed_type"]).join(root.withColumnsRenamed({"raw": "b", "root": "root_b"}), ["b", "filed_type"])
        result = scores(told.select("truth", (F.col("root_a") == F.col("root_b")).alias("found")))
        out.append(result.join(root.agg(F.countDistinct("root").alias("entities"))).select(F.lit(config).alias("config"), "entities", "tp", "fp", "fn", "tn", "precision", "recall", "f1"))
    return reduce(DataFrame.unionByName, out)


def candidate_pool(keys: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """a, b, band (0 to 3, by quarters of Jaccard similarity) of different keys that share a word of at least `least` letters in at most `most` keys."""
    tok = keys.select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("token")).filter(F.length("token") >= least)
    own = tok.join(tok.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") <= most).select("token"), "token")
    pairs = own.toDF("token", "a").join(own.toDF("token", "b"), "token").filter("a < b").select("a", "b").distinct()
    x, y = F.split("a", " "), F.split("b", " ")
    return pairs.select("a", "b", F.least(F.lit(3), F.floor(4 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).cast("int")).alias("band"))


def stratified_sample(pool: DataFrame, per_band: int, seed: int) -> DataFrame:
    """`per_band` pairs of each band, by the smallest hashes of seed and pair: the same in any order and place."""
    drawn = F.md5(F.concat(F.lit(str(seed)), "a", F.lit("|"), "b").cast("binary"))
    place = F.row_number().over(Window.partitionBy("band").orderBy(drawn, "a", "b"))
    return pool.withColumn("place", place).filter(F.col("place") <= per_band).select("a", "b", "band")
