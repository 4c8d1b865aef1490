"""N-gram Jaccard join by vertical partitioning.

Every document becomes its set of distinct k-word shingles (64-bit hashes). The shingles have one global
order: those not known as frequent first, by hash, then the frequent ones by rising count. That order is
cut into fragments; for a candidate pair the overlap is counted in each fragment by itself and summed.

* Equal sets are one class (map-side combined), so groups of copies cost one row from there on.
* Candidates share a shingle among the first floor((100 - t) n / 100) + 1 of both in the global order, which
  every pair of Jaccard >= t % must (prefix filter), at positions that leave room for the overlap needed
  (positional filter). Any global order is exact, the frequent list only makes it cheap. The list comes from one document in `every` and keeps the `frequent` most common.
* Round 1 verifies a star per shared shingle (all against the smallest id). Round 2 verifies every
  remaining candidate pair whose ends are not already connected: no link that could join two components
  is lost, and pairs inside a component, however large, are never listed.

Nulls and empties: null or word-less texts have n_shingles 0, link with nothing and are their own
component. Rows with a null doc_id keep their n_shingles, link with nothing and have a null component.
Rows that repeat a doc_id are one node, also with different texts: it has the links of all of them, and n_shingles is each
row's own. Very long texts are read whole, their sets cut into fragments. Of equal sets the smallest doc_id stands for all. No rows give no
rows. Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, ascii_words, connected_components, dropped, mapped, released, stored, window_hashes

FRAGMENTS = 5  # four of infrequent shingles by hash, one of frequent ones


def shingles(text: str | None, k: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle; none make none."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(ids.of(words), min(k, len(words))))


class Order:
    """The global order: which hashes are frequent, and their rank."""

    def __init__(self, tokens: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.rank = tokens[by], by.astype(np.int64)
        self.mask = np.uint64((1 << 22) - 1)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(tokens & self.mask).astype(np.int64)] = True

    def split(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(infrequent by hash, frequent by rank)."""
        if not len(self.tokens) or not len(own):
            return own, own[:0]
        maybe = np.flatnonzero(self.seen[(own & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.tokens, own[maybe]), len(self.tokens) - 1)
        hit = self.tokens[at] == own[maybe]
        often = maybe[hit]
        return np.delete(own, often), own[often][np.argsort(self.rank[at[hit]])]


def frequent_shingles(docs: DataFrame, k: int, every: int, most: int) -> np.ndarray:
    """The `most` commonest shingles of one document in `every`, rising by count: a bounded list."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for batch in batches:
            own = [shingles(t, k, ids) for t in batch["text"]]
            tokens, n = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"token": tokens.view(np.int64), "n": n})

    part = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0).select("text")
    top = mapped(part, count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "token").limit(most)
    rows = top.toPandas()
    return rows["token"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def features(docs: DataFrame, order, k: int, t: int) -> DataFrame:
    """(doc_id, n, s1, s2, prefix): set size, 128-bit signature of the set, prefix in the global order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rule = WordIds(), order.value
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n": [], "s1": [], "s2": [], "prefix": []}
            for text in batch["text"]:
                own = shingles(text, k, ids)
                rare, often = rule.split(own)
                size = (100 - t) * len(own) // 100 + 1 if len(own) else 0
                sig = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                out["n"].append(len(own))
                out["s1"].append(sig[0])
                out["s2"].append(sig[1])
                out["prefix"].append(np.concatenate([rare[:size], often[: max(0, size - len(rare))]]).view(np.int64))
            yield pd.DataFrame(out)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, s1 long, s2 long, prefix array<long>")


def segments(docs: DataFrame, wanted: DataFrame, order, k: int, repeats: bool) -> DataFrame:
    """(rep, s1, fragment, tokens) of the documents in wanted(rep), once each, also if repeats (rows may share a doc_id).

    A bitmap of fixed size (2^24 bits) passes them, and some others, so that only their sets are made and
    moved; the joins that follow are on the ids themselves.
    """
    bits = 1 << 24
    h = F.pmod(F.xxhash64("rep"), F.lit(bits)) + 1  # 1 .. bits, as position 0 has a bucket of its own
    rows = wanted.groupBy(F.bitmap_bucket_number(h).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("map")).collect()
    passed = np.zeros(bits // 8 + 4096, np.uint8)
    for row in rows:
        passed[(row.part - 1) * 4096 : (row.part - 1) * 4096 + len(row.map)] = np.frombuffer(bytes(row.map), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(passed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rule, ok = WordIds(), order.value, sent.value
        for batch in batches:
            at = batch["h"].to_numpy(np.int64) - 1  # bitmap positions count from 1 within buckets
            hit = (ok[at >> 3] >> (at & 7)) & 1
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"][hit == 1], batch["text"][hit == 1], strict=True):
                own = shingles(text, k, ids)
                s1 = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)[0]
                rare, often = rule.split(own)
                cut = [0, *np.searchsorted(rare, np.arange(1, 4, dtype=np.uint64) << np.uint64(62)), len(rare)]
                for f, piece in enumerate([*(rare[a:b] for a, b in zip(cut, cut[1:], strict=False)), often]):
                    if len(piece):
                        out.append((doc_id, s1, f, piece.view(np.int64)))
                if len(out) > 4000:
                    yield pd.DataFrame(out, columns=["rep", "s1", "fragment", "tokens"])
                    out = []
            yield pd.DataFrame(out, columns=["rep", "s1", "fragment", "tokens"])

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)) + 1
    # position p (0-based) of the bitmap: bucket b holds p in [(b-1)*32768 + 1 .. b*32768]
    place = (F.bitmap_bucket_number(place) - 1) * 32768 + F.bitmap_bit_position(place) + 1
    own = mapped(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("h")), run, "rep long, s1 long, fragment int, tokens array<long>")
    return own.dropDuplicates(["rep", "s1", "fragment"]) if repeats else own


def promising(pairs: DataFrame, feats: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose overlap can suffice, as their prefixes tell.

    All of a set that precedes the end of both prefixes is in both prefixes, so the overlap is at most that
    of the prefixes plus what one of the sets has beyond its own.
    """
    own = feats.filter("doc_id is not null and n > 0").select("doc_id", "n", "prefix")
    both = pairs.join(own.toDF("b", "n_b", "prefix_b"), "b").join(own.toDF("a", "n_a", "prefix_a"), "a")
    beyond = F.greatest(F.col("n_a") - F.size("prefix_a"), F.col("n_b") - F.size("prefix_b"))
    most = F.size(F.array_intersect("prefix_a", "prefix_b")) + beyond
    both = both.filter((100 + t) * most >= t * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    return both.hint("rebalance").distinct()  # dealt anew, so that the join needn't keep its keys together and Spark can split a hub's pairs


def verified(pairs: DataFrame, docs: DataFrame, feats: DataFrame, order, k: int, t: int, repeats: bool, tag: str) -> DataFrame:
    """The pairs (a, b) with Jaccard >= t %: partial overlaps fragment by fragment, summed per pair."""
    pairs = stored(promising(pairs, feats, t), f"{tag}-promising")
    released(docs.sparkSession)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = stored(segments(docs, wanted, order, k, repeats), f"{tag}-segments")
    sizes = own.groupBy("rep", "s1").agg(F.sum(F.size("tokens")).alias("n"))
    right = own.select(F.col("rep").alias("b"), F.col("s1").alias("s1_b"), "fragment", F.col("tokens").alias("tokens_b"))
    left = own.join(pairs.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("a"), F.col("s1").alias("s1_a"), "fragment", "tokens")
    partial = pairs.join(right, "b").join(left, ["a", "fragment"]).select("a", "b", "s1_a", "s1_b", F.size(F.array_intersect("tokens", "tokens_b")).alias("shared"))
    both = partial.groupBy("a", "b", "s1_a", "s1_b").agg(F.sum("shared").alias("shared"))
    both = both.join(sizes.toDF("a", "s1_a", "n_a"), ["a", "s1_a"]).join(sizes.toDF("b", "s1_b", "n_b"), ["b", "s1_b"])
    links = stored(both.filter(F.col("shared") * 100 >= t * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b").distinct(), f"{tag}-links")
    dropped(own)
    dropped(pairs)
    released(docs.sparkSession)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, every: int = 16, frequent: int = 1 << 17) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_copies (rows with the same set)."""
    sc = docs.sparkSession.sparkContext
    order = sc.broadcast(Order(frequent_shingles(docs, k, every, frequent)))
    feats = stored(features(docs, order, k, percent), "feats")
    named = feats.filter("doc_id is not null and n > 0")
    repeats = bool(feats.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count())
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("n_copies"))
    classes = stored(classes, "sets")
    postings = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    # a token's postings never meet in one task: what is told of them all is aggregated and joined to each, in joins that Spark can split
    shared = stored(postings.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n", "pos")).alias("hub")).filter("size > 1").drop("size"), "shared")
    multi = stored(postings.join(shared, "token").select("token", "rep", "n", "pos", "hub"), "postings")
    dropped(shared)
    released(docs.sparkSession)

    def possible(x, y):
        """What stands from the first shared shingle on suffices for the least overlap, t (n_x + n_y) / (100 + t)."""
        least = percent * (x["n"] + y["n"])
        return ((100 + percent) * (x["n"] - x["pos"]) >= least) & ((100 + percent) * (y["n"] - y["pos"]) >= least)

    stars = multi.filter(F.col("rep") != F.col("hub.rep")).filter(possible({"n": F.col("n"), "pos": F.col("pos")}, F.col("hub")))
    stars = stored(stars.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = verified(stars, docs, feats, order, k, percent, repeats, "round1")
    if repeats:  # a doc_id in several classes links them
        members = named.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("rep", "doc_id").distinct()
        several = members.groupBy("doc_id").count().filter("count > 1").select("doc_id")
        links = stored(links.union(members.join(several, "doc_id").filter("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), "links")
    comp = connected_components(links, "round1")

    own = stored(multi.select("token", "rep", "n", "pos").join(comp.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "own")
    several = stored(own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token"), "several")
    sizes = own.join(several, "token", "left_semi").groupBy("token", "comp").agg(F.count("*").alias("size"))
    mains = stored(sizes.groupBy("token").agg(F.max(F.struct("size", "comp"))["comp"].alias("most")), "mains")
    mixed = stored(own.join(mains, "token").select("token", "rep", "n", "pos", "comp", (F.col("comp") == F.col("most")).alias("main")), "mixed")
    for old in (own, several, mains):
        dropped(old)
    x, y = mixed.filter("not main").alias("x"), mixed.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("y.main") | (F.col("x.rep") < F.col("y.rep"))) & possible({c: F.col(f"x.{c}") for c in ("n", "pos")}, {c: F.col(f"y.{c}") for c in ("n", "pos")})
    pairs = x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    pairs = stored(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    more = verified(pairs, docs, feats, order, k, percent, repeats, "round2")
    for old in (multi, stars, mixed, pairs):
        dropped(old)
    if more.limit(1).count():
        comp = connected_components(links.union(more), "round2")
    # stored, so that both sides of the last join are shuffled for it alone and Spark can split a class that many rows share
    named_class = stored(classes.select("s1", "s2", "rep", "n_copies").join(comp.toDF("rep", "comp"), "rep", "left"), "classes")
    out = feats.select("doc_id", "n", "s1", "s2").join(named_class, ["s1", "s2"], "left")
    out = out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("comp", "rep")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("n_copies")).otherwise(F.lit(1)).alias("n_copies"),
    )
    if repeats:  # a doc_id's rows without words follow the others
        least = out.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"), "n_copies")
    return out
