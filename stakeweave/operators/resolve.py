"""Entity resolution: observations, candidate merges by blocking, ordered merging with a CIN veto, entities, lookup."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stakeweave.functions.names import holding_type, match_key, token_match, with_entity
from stakeweave.plans.iterate import cut, placed
from stakeweave.plans.network import least_labels

BLOCK, TRUNCATED = 3, 15  # leading characters of a block; least length of a key that may be cut off
SPREAD = 16  # tasks that a block is dealt over where all of its pairs are looked at
TOGETHER = 2048  # keys of a mask that meet as many others at once
AT_ONCE = 1 << 19  # pairs of keys looked at in one array
TILE, STRIP, MOST_TASKS = 2048, 256, 20_000  # keys of a block that meet as many others at once, and how many of these in a row; tasks that pairs of tiles are dealt over


def observations(filed: DataFrame, capacity: bool = True) -> DataFrame:
    """One row per (raw, filed_type) of filed(raw, filed_type, listed[, cin, line]): count, listed, cin, name, rule, entity_type, key; cut, as much is built on it."""
    for c, kind in (("cin", "string"), ("line", "long")):
        filed = filed if c in filed.columns else filed.withColumn(c, F.lit(None).cast(kind))
    seen = filed.groupBy("raw", "filed_type").agg(F.count("*").alias("n"), F.bool_or("listed").alias("listed"), F.min_by("cin", F.when(F.col("cin").isNotNull(), F.coalesce("line", F.lit(0)))).alias("cin"))
    as_is = F.struct(F.col("raw").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit("as_filed").alias("rule"))
    seen = with_entity(seen, "raw") if capacity else seen.withColumn("held_as", as_is)
    return cut(seen.select("raw", "filed_type", "n", "listed", "cin", F.col("held_as.name").alias("name"), F.col("held_as.rule").alias("rule"), holding_type(F.col("filed_type"), F.col("held_as.kind")).alias("entity_type"), match_key(F.col("held_as.name")).alias("key")))


def block_pairs(keys: DataFrame, width: int = BLOCK) -> DataFrame:
    """Pairs a < b of keys(entity_type, key) of one type where b begins with the first `width` characters of a.

    The keys of all blocks are put in order and cut into tiles of TILE; a task unfolds pairs of tiles, so a large block is dealt over
    many tasks and pairs a > b are not made. A task's rows repeat a few thousand keys, STRIP of them as b again and again: that
    suits dictionaries and compression of columnar files, as the list grows with the square of a block.
    """
    keys = keys.select("entity_type", "key").distinct()
    own = F.substring("key", 1, width)
    # a key shorter than the block pairs with every longer key that it begins: b offers all its shorter prefixes too
    starts = F.transform(F.sequence(F.lit(0), F.least(F.lit(width), F.length("key"))), lambda n: F.col("key").substr(F.lit(1), n))
    offered = keys.select("entity_type", F.explode(F.array_distinct(starts)).alias("block"), "key")
    offered = offered.join(keys.select("entity_type", own.alias("block")).distinct(), ["entity_type", "block"])
    tile = F.floor((F.col("place") - 1) / TILE).alias("tile")
    tiles = placed(offered, F.col("entity_type"), F.col("block"), F.col("key")).select("entity_type", "block", tile, "key", (F.col("block") == own).alias("leads"))
    tiles = cut(tiles.groupBy("entity_type", "block", "tile").agg(F.sort_array(F.collect_list(F.when(F.col("leads"), F.col("key")))).alias("lead"), F.sort_array(F.collect_list("key")).alias("all")))
    a = tiles.filter("size(lead) > 0").select("entity_type", "block", F.col("tile").alias("of_a"), "lead")
    met = a.join(tiles.select("entity_type", "block", "tile", "all"), ["entity_type", "block"]).filter("of_a < tile or of_a = tile and size(all) > 1")
    strips = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / STRIP).cast("int")), lambda n: F.slice("all", n * STRIP + 1, F.lit(STRIP)))
    work = met.agg(F.sum(F.size("lead").cast("long") * F.size("all"))).first()[0] or 0
    met = met.repartition(min(MOST_TASKS, max(spread_over(keys.sparkSession), -(-work // TILE**2))), "entity_type", "block", "of_a", "tile")
    met = met.select("entity_type", "lead", F.explode(strips).alias("strip")).select("entity_type", F.explode("lead").alias("a"), "strip")
    return met.select("entity_type", "a", F.explode("strip").alias("b")).filter("a < b")


def truncation_pairs(keys: DataFrame) -> DataFrame:
    """Pairs of a key of at least TRUNCATED characters and the one longer key that it begins, cut off in a word."""
    a = keys.filter(F.length("key") >= TRUNCATED).select("entity_type", F.col("key").alias("a"), F.substring("key", 1, TRUNCATED).alias("block")).distinct()
    b = keys.select("entity_type", F.col("key").alias("b"), F.substring("key", 1, TRUNCATED).alias("block")).distinct()
    found = a.join(b, ["entity_type", "block"]).filter((F.col("a") != F.col("b")) & F.startswith("b", "a"))
    one = found.groupBy("entity_type", "a").agg(F.count("*").alias("n"), F.min("b").alias("b")).filter("n = 1")
    return one.filter(F.col("b").substr(F.length("a") + 1, F.lit(1)) != " ").select("entity_type", "a", "b")


def fuzzy_pairs(keys: DataFrame, threshold: float = 0.8, width: int = BLOCK) -> DataFrame:
    """The block_pairs of keys that token_match holds for, without making the others.

    Words that must be equal (up to three letters, or with digits) stand at the same places of both keys: with the number of words they
    are the join's key. Of the n words at least n - n // 2 are equal; where those words alone are not enough, both keys share
    one of their n // 2 + 1 rarest other words at the same place, too (prefix filter). Keys that are equal without spaces are joined on that.
    """
    keys = keys.select("entity_type", "key").distinct()
    within = (F.col("a") < F.col("b")) & F.startswith(F.col("b"), F.substring("a", 1, width))
    squeezed = keys.select("entity_type", "key", F.replace("key", F.lit(" "), F.lit("")).alias("squeezed"))
    same = squeezed.withColumnRenamed("key", "a").join(squeezed.withColumnRenamed("key", "b"), ["entity_type", "squeezed"]).filter(within)
    words = keys.withColumn("words", F.split("key", " ")).withColumn("n", F.size("words"))
    fixed = lambda w: (F.length(w) <= 3) | w.rlike("[0-9]")
    words = words.withColumn("fixed", F.transform("words", lambda w: F.when(fixed(w), w).otherwise("")))
    words = words.withColumn("places", F.filter(F.transform("words", lambda w, i: F.when(~fixed(w), F.struct(i.alias("place"), w.alias("word")))), lambda p: p.isNotNull()))
    enough = F.size("places") <= F.floor(F.col("n") / 2)  # the fixed words are n - n // 2 already
    plain = words.filter(enough).select("entity_type", "key", "n", "fixed", F.lit(-1).alias("place"), F.lit("").alias("word"))
    rest = words.filter(~enough).select("entity_type", "key", "n", "fixed", F.explode("places").alias("p")).select("entity_type", "key", "n", "fixed", "p.place", "p.word")
    often = rest.groupBy("entity_type", "n", "fixed", "place", "word").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("entity_type", "key").orderBy("df", "place"))
    rare = rest.join(often, ["entity_type", "n", "fixed", "place", "word"]).withColumn("rank", rank).filter(F.col("rank") <= F.floor(F.col("n") / 2) + 1)
    tokens = plain.unionByName(rare.select(plain.columns))
    on = ["entity_type", "n", "fixed", "place", "word"]
    alike = tokens.withColumnRenamed("key", "a").join(tokens.withColumnRenamed("key", "b"), on).filter(within).filter(token_match(F.col("a"), F.col("b"), threshold))
    return alike.select("entity_type", "a", "b").union(same.select("entity_type", "a", "b")).distinct()


def alike_pairs(keys: DataFrame, least: float) -> DataFrame:
    """The block_pairs of keys whose similarity is `least` or more; lengths and letters (letter_signature) decide on most pairs before the distance, bounded, does.

    A block's pairs are looked at SPREAD tasks a block, as blocks are few and large.
    """
    keys = cut(keys.select("entity_type", "key").distinct().select("entity_type", "key", *[s.alias(f"sig{i}") for i, s in enumerate(letter_signature(F.col("key")))]))
    a = keys.select("entity_type", F.col("key").alias("a"), F.col("sig0").alias("a0"), F.col("sig1").alias("a1"), F.substring("key", 1, BLOCK).alias("block"), F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int").alias("part"))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(BLOCK)), lambda n: F.col("key").substr(F.lit(1), n)))
    b = keys.select("entity_type", F.col("key").alias("b"), F.col("sig0").alias("b0"), F.col("sig1").alias("b1"), F.explode(starts).alias("block")).join(F.broadcast(a.select("entity_type", "block").distinct()), ["entity_type", "block"])
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    longest = F.greatest(F.lit(1), F.length("a"), F.length("b"))  # a filter may be tried on a pair before a < b is
    errors = F.floor(longest * (1 - least) + 1e-6).cast("int")
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    on, parts = ["entity_type", "block", "part"], spread_over(keys.sparkSession)
    pairs = a.repartition(parts, *on).join(b.repartition(parts, *on), on).filter("a < b").filter(F.abs(F.length("a") - F.length("b")) <= errors).filter(apart <= 2 * errors)
    pairs = pairs.select("entity_type", "a", "b", longest.alias("longest"), errors.alias("errors")).withColumn("distance", F.expr("levenshtein(a, b, errors)"))
    return pairs.filter("distance >= 0").filter(1 - F.col("distance") / F.col("longest") >= least).select("entity_type", "a", "b")


def alike_links(keys: DataFrame, least: float) -> DataFrame:
    """Some of the alike_pairs, which join the same keys into the same components as all do: for each pair of tiles of keys a forest.

    As in near_pairs, keys of near stems and of masks whose digits leave room meet tile by tile; what is joined already is not compared. A tile's keys are of one
    type and begin with the same letters, as many as a block has.
    """
    spark = keys.sparkSession
    parts = spread_over(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # rows of two tiles are large
    errors = lambda size: F.floor(size * (1 - least) + 1e-6).cast("int")
    group = ["entity_type", "start", "mask"]
    keys = cut(keys.select("entity_type", "key").filter("entity_type is not null and key is not null").distinct().select("entity_type", "key", F.substring("key", 1, BLOCK).alias("start"), F.regexp_replace("key", "[0-9]", "0").alias("mask"), digit_signature(F.col("key")).alias("sig")))
    masks = cut(keys.groupBy(*group).agg(F.count("*").alias("n")).select(*group, "n", F.replace("mask", F.lit("0"), F.lit("")).alias("stem"), F.length("mask").alias("m"), F.ceil(F.col("n") / TOGETHER).cast("int").alias("shares")))
    near = cut(near_texts(masks.groupBy(F.col("stem").alias("text")).agg(F.max(F.greatest(F.lit(0), errors(F.col("m")))).alias("r"))))
    tag = F.concat_ws("\u0001", "start", "mask")
    side = lambda x: masks.select("entity_type", F.col("mask").alias(x), F.col("stem").alias(f"stem_{x}"), tag.alias(f"tag_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("start", "n", "m")])
    met = side("x").join(near.toDF("stem_x", "stem_y"), "stem_x").join(side("y"), ["entity_type", "stem_y"]).filter("tag_x <= tag_y")
    short = lambda x, y: (F.length(x) < BLOCK) & F.startswith(y, x)
    met = met.filter((F.col("start_x") == F.col("start_y")) | short(F.col("start_x"), F.col("start_y")) | short(F.col("start_y"), F.col("start_x")))
    longest = F.greatest(F.lit(1), F.col("m_x"), F.col("m_y"))
    r = errors(longest) - F.when(1 - errors(longest) / longest >= least, 0).otherwise(1)
    pairs = met.withColumn("r", r).filter("r >= 0 and abs(m_x - m_y) <= r").select("entity_type", "tag_x", "tag_y", "x", "y", "r", (F.col("n_x") * F.col("n_y")).alias("work"))
    pairs = cut(pairs.repartition(parts, "tag_x", "tag_y").mapInPandas(digit_room, "entity_type string, tag_x string, tag_y string, x string, y string, r int, work long, bits int"))
    dealt = keys.join(masks.select(*group, "shares"), group).withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
    tiles = cut(dealt.groupBy(*group, "share").agg(F.collect_list(F.struct("key", "sig")).alias("tile")))
    tile = lambda x: tiles.select("entity_type", tag.alias(f"tag_{x}"), F.col("share").alias(f"share_{x}"), F.col("tile.key").alias(f"keys_{x}"), F.col("tile.sig").alias(f"sigs_{x}"))
    tiled = pairs.join(tile("x"), ["entity_type", "tag_x"]).join(tile("y"), ["entity_type", "tag_y"]).filter("tag_x != tag_y or share_x <= share_y")
    work = pairs.agg(F.sum("work")).first()[0] or 0
    tiled = tiled.repartition(min(MOST_TASKS, max(parts, -(-work // (4 * TOGETHER) ** 2))), "entity_type", "tag_x", "tag_y", "share_x", "share_y")
    whole = [F.col("r").alias("r_x"), F.lit(-1).alias("r_y"), F.lit(0).alias("first"), F.lit(0).alias("last"), "bits", F.expr("tag_x = tag_y and share_x = share_y").alias("same")]
    out = []
    for kind in [row[0] for row in masks.select("entity_type").distinct().collect()]:
        own = tiled.filter(F.col("entity_type") == kind).select(*whole, "keys_x", "sigs_x", "keys_y", "sigs_y")
        found = own.mapInArrow(partial(near_in_tiles, forest=True), "a string, b string, distance int")
        out.append(found.select(F.lit(kind).alias("entity_type"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return reduce(DataFrame.unionByName, out) if out else keys.select("entity_type", F.col("key").alias("a"), F.col("key").alias("b"))


def merge_candidates(obs: DataFrame, truncation: bool = True, fuzzy: bool = True, threshold: float = 0.8, token_guard: bool = True, key_threshold: float = 0.8, components: bool = False) -> DataFrame:
    """step (0 cin, 1 truncation, 2 fuzzy), entity_type, a, b: unions to try, in order of step, entity_type, a, b.

    Without the token guard the fuzzy step compares whole keys of a block, by their similarity alone. Where only the `components` are asked
    for, as no order of unions counts without CINs, not all of its pairs are made.
    """
    keys = obs.select("entity_type", "key").distinct()
    first = Window.partitionBy("cin", "entity_type")
    star = obs.filter("cin is not null").select("cin", "entity_type", "key").distinct().withColumn("a", F.min("key").over(first)).filter("a != key")
    out = star.select(F.lit(0).alias("step"), "entity_type", "a", F.col("key").alias("b"))
    if truncation:
        out = out.unionByName(truncation_pairs(keys).withColumn("step", F.lit(1)))
    if fuzzy:
        pairs = fuzzy_pairs(keys, threshold) if token_guard else (alike_links if components else alike_pairs)(keys, key_threshold)
        out = out.unionByName(pairs.withColumn("step", F.lit(2)))
    return out


def merged(obs: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((entity_type, key, root), merge log(step, entity_type, a, b)): unions in order; sets with differing CINs stay apart.

    Candidates that can touch each other form a component; each is replayed by itself, so the order only matters inside. Where no
    two keys of a component have differing CINs it is one set whatever the order, and replayed only for the log, if that is read. Keys
    that no candidate names are their own roots and take no part.
    """
    tag = lambda c: F.concat_ws("\u0001", "entity_type", c)
    links = cut(candidates.select(tag("a").alias("a"), tag("b").alias("b")).distinct())
    keys = obs.groupBy("entity_type", "key").agg(F.collect_set("cin").alias("cins")).withColumn("node", tag("key"))
    touched = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = cut(least_labels(links, touched))
    part = cut(keys.join(labels, "node").select("entity_type", "key", "cins", F.col("component").alias("part")))
    moves = candidates.withColumn("node", tag("a")).join(labels, "node").select(F.col("component").alias("part"), "step", "entity_type", "a", "b")

    def replay(key, rows: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
        parent = {r.key: r.key for r in rows.itertuples()}
        cins = {r.key: set(r.cins) for r in rows.itertuples()}

        def find(x: str) -> str:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        log = []
        for t in tries.sort_values(["step", "a", "b"]).itertuples():
            x, y = find(t.a), find(t.b)
            if x != y and not (cins[x] and cins[y] and cins[x] != cins[y]):
                low, high = min(x, y), max(x, y)
                parent[high] = low
                cins[low] |= cins.pop(high)
                log.append((int(t.step), t.entity_type, t.a, t.b, None))
        own = [(-1, r.entity_type, r.key, None, find(r.key)) for r in rows.itertuples()]
        return pd.DataFrame(own + log, columns=["step", "entity_type", "a", "b", "root"])

    replayed = lambda rows, tries: rows.groupBy("part").cogroup(tries.groupBy("part")).applyInPandas(replay, "step int, entity_type string, a string, b string, root string")
    own = F.when(F.size("cins") > 0, F.array_sort("cins"))
    torn = cut(part.groupBy("part").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low != high").select("part"))
    done = cut(replayed(part.join(torn, "part", "left_semi"), moves.join(torn, "part", "left_semi")))
    calm = part.join(torn, "part", "left_anti").select("entity_type", "key", F.substring_index("part", "\u0001", -1).alias("root"))
    alone = keys.join(labels, "node", "left_anti").select("entity_type", "key", F.col("key").alias("root"))
    return alone.unionByName(calm).unionByName(done.filter("step = -1").select("entity_type", F.col("a").alias("key"), "root")), replayed(part, moves).filter("step >= 0").select("step", "entity_type", "a", "b")


def entities(obs: DataFrame, roots: DataFrame) -> DataFrame:
    """entity_id, name, entity_type, variants, keys, cin, listed: one row per merged set."""
    own = cut(obs.join(roots, ["entity_type", "key"]))
    group = ["entity_type", "root"]
    weight = own.groupBy(*group, "name").agg(F.sum("n").alias("w"))
    spaces = F.length("name") - F.length(F.replace("name", F.lit(" "), F.lit("")))
    best = weight.groupBy(*group).agg(F.min(F.struct((-F.col("w")).alias("w"), (-spaces).alias("s"), F.col("name").alias("name")))["name"].alias("heaviest"))
    rows = own.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "raw"))).getField("raw").alias("variants"), F.array_sort(F.collect_set("key")).alias("keys"),
        F.min("cin").alias("cin"), F.bool_or("listed").alias("listed"), F.min(F.when(F.col("listed"), F.struct((-F.col("n")).alias("n"), "raw")))["raw"].alias("listed_as"),
    ).join(best, group)
    rows = rows.withColumn("name", F.coalesce("listed_as", "heaviest"))
    return numbered(rows).select("entity_id", "name", "entity_type", "variants", "keys", "cin", "listed", "root")


def entity_map(obs: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """raw, filed_type, entity_id of every name as filed."""
    return obs.join(roots, ["entity_type", "key"]).join(found.select("entity_type", "root", "entity_id"), ["entity_type", "root"]).select("raw", "filed_type", "entity_id")


def entity_of(names: DataFrame, raw: str, filed_type: str | None = None) -> str:
    """The entity of one name in an entity_map; KeyError if it was not filed, or under both types for different entities and none is given."""
    rows = names.filter(F.col("raw") == raw)
    rows = (rows if filed_type is None else rows.filter(F.col("filed_type") == filed_type)).select("entity_id").distinct().take(2)
    if len(rows) != 1:
        raise KeyError(f"{raw!r} is {'no name that was filed' if not rows else 'filed under both types'}")
    return rows[0].entity_id


def numbered(rows: DataFrame) -> DataFrame:
    """entity_id E0001... in the order of (lower name, type, first variant)."""
    rows = placed(rows, F.lower("name"), F.col("entity_type"), F.col("variants")[0])
    return rows.withColumn("entity_id", F.concat(F.lit("E"), F.lpad(F.col("place").cast("string"), F.length(F.col("total").cast("string")) + 1, "0")))


def spread_over(spark: SparkSession) -> int:
    """Tasks for work that is much for its bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def letter_signature(key: Column) -> list[Column]:
    """Two longs with a bit for each (letter, how often it has occurred so far). An edit changes at most one such pair on either
    side, so keys within distance r differ in at most 2 r bits."""
    letters = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: key.substr(i, F.lit(1)))
    nth = F.transform(letters, lambda c, i: F.pmod(F.xxhash64(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda d: d == c))), F.lit(128)))
    bits = lambda low: F.aggregate(F.filter(nth, lambda h: (h >= low) & (h < low + 64)), F.lit(0).cast("long"), lambda done, h: done.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (h - low).cast("int"))))
    return [bits(0), bits(64)]


def near_texts(texts: DataFrame) -> DataFrame:
    """a, b (both ways, and each with itself): texts of texts(text, r) within edit distance r of a, or within that of b.

    Pass-join: b is cut into r + 1 even parts, one of which a must hold unchanged. Part i can only have moved by as many places as errors
    fit to its left (i) and, seen from the end, to its right (r - i), so a offers few places to it. The join is on (r, length of b, i,
    part). Candidates whose letters differ too much are dropped by their signatures, the others are verified with the distance bounded by r; a
    pair that several parts find is verified each time and then made distinct, as most candidates are found by one part and fail.
    """
    # texts are few and the work on each is much, so parts are counted, not left to their size
    parts = spread_over(texts.sparkSession)
    texts = cut(texts.repartition(parts, "text").select("text", "r", F.length("text").alias("m"), *[s.alias(f"sig{i}") for i, s in enumerate(letter_signature(F.col("text")))]))
    edge = lambda i, n: F.floor(i * n / (F.col("r") + 1)).cast("int")
    a = texts.select(F.col("text").alias("a"), F.col("sig0").alias("a0"), F.col("sig1").alias("a1"), "m", "r").select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("m") - F.col("r")), F.col("m") + F.col("r"))).alias("n"))
    # b is indexed for every radius that an a of a fitting length has
    asked = texts.select("m", "r").distinct().select("r", F.explode(F.sequence(F.greatest(F.lit(0), F.col("m") - F.col("r")), F.col("m") + F.col("r"))).alias("n")).distinct()
    b = texts.select(F.col("text").alias("b"), F.col("sig0").alias("b0"), F.col("sig1").alias("b1"), F.col("m").alias("n")).join(asked, "n").select("*", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("i"))
    b = b.select("b", "b0", "b1", "r", "n", "i", F.col("b").substr(edge(F.col("i"), F.col("n")) + 1, edge(F.col("i") + 1, F.col("n")) - edge(F.col("i"), F.col("n"))).alias("part"))
    a = a.select("*", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("i"))
    a = a.select("*", edge(F.col("i"), F.col("n")).alias("begin"), (edge(F.col("i") + 1, F.col("n")) - edge(F.col("i"), F.col("n"))).alias("w"), (F.col("m") - F.col("n")).alias("longer"))
    left, right = F.col("i"), F.col("r") - F.col("i")
    low = F.greatest(F.lit(0), F.col("begin") - left, F.col("begin") + F.col("longer") - right)
    high = F.least(F.col("m") - F.col("w"), F.col("begin") + left, F.col("begin") + F.col("longer") + right)
    a = a.select("*", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("at"))
    a = a.select("a", "a0", "a1", "r", "n", "i", F.col("a").substr(F.col("at") + 1, F.col("w")).alias("part"))
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    on = ["r", "n", "i", "part"]
    found = a.repartition(parts, *on).join(b.repartition(parts, *on), on).filter("a != b").filter(apart <= 2 * F.col("r")).filter(F.expr("levenshtein(a, b, r)") >= 0).select("a", "b")
    return found.union(found.select("b", "a")).union(texts.select("text", "text")).distinct()


def digit_signature(key: Column) -> Column:
    """A long with as many bits set for each digit as the digit occurs, six at most. An edit that puts a digit for a digit changes at most
    two of them, any other at most one."""
    count = lambda d: F.least(F.lit(6), F.length(key) - F.length(F.replace(key, F.lit(d), F.lit(""))))
    unary = lambda d: F.shiftleft(F.call_function("shiftleft", F.lit(1).cast("long"), count(d)) - 1, 6 * int(d))
    return reduce(lambda done, bits: done.bitwiseOR(bits), map(unary, "0123456789"))


def digit_room(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(x, y, r) with bits: in how many bits the digit_signatures of keys of the masks x and y (digits are 0) can differ within distance r; pairs of masks without such keys are left out.

    r edits change 2 r bits, less 2 for each edit of letters only, and less 1 for each digit that a letter is put for (or the reverse) or that is left out or
    put in. The least of that, over all alignments with at most r places of shift, is an edit distance of the masks with those weights.
    """
    for rows in batches:
        if not len(rows):
            continue
        n, reach = len(rows), int(rows.r.max())
        sizes = [rows[c].str.len().to_numpy() for c in "xy"]
        codes = [np.zeros((int(size.max()), n), dtype=np.int32) for size in sizes]
        for c, code in zip("xy", codes):
            for k, text in enumerate(rows[c]):
                code[: len(text), k] = [ord(letter) for letter in text]
        (x, y), far = codes, np.int32(1 << 20)
        alone = [np.where(code == 48, 1, 2).astype(np.int32) for code in codes]
        above = np.full((len(y) + 1, n), far)
        above[0] = 0
        for j in range(1, min(reach, len(y)) + 1):
            above[j] = above[j - 1] + alone[1][j - 1]
        least = np.where(sizes[0] == 0, above[sizes[1], np.arange(n)], far)
        for i in range(1, len(x) + 1):
            row = np.full_like(above, far)
            if i <= reach:
                row[0] = above[0] + alone[0][i - 1]
            for j in range(max(1, i - reach), min(len(y), i + reach) + 1):
                swap = np.where(x[i - 1] == y[j - 1], 0, np.where((x[i - 1] == 48) | (y[j - 1] == 48), 1, 2))
                row[j] = np.minimum(np.minimum(above[j] + alone[0][i - 1], row[j - 1] + alone[1][j - 1]), above[j - 1] + swap)
            ends = sizes[0] == i
            least[ends] = row[sizes[1][ends], np.flatnonzero(ends)]
            above = row
        rows["bits"] = (2 * rows.r - least).astype("int32")
        yield rows[rows.bits >= 0]


def distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of the texts x[i] and y[j], rows of code points: a column of the table at a time, its differences as bits of words (Myers, Hyyro)."""
    m, n = x.shape[1], y.shape[1]
    if not m or not n:
        return np.full(len(i), max(m, n))
    if m > 64:  # more than a word has: the table itself
        above = np.repeat(np.arange(n + 1)[:, None], len(i), 1)
        for k in range(m):
            row = np.empty_like(above)
            row[0] = k + 1
            for t in range(n):
                row[t + 1] = np.minimum(np.minimum(above[t + 1], row[t]) + 1, above[t] + (x[i, k] != y[j, t]))
            above = row
        return above[n]
    word = next(w for w in (np.uint8, np.uint16, np.uint32, np.uint64) if m <= 8 * w(0).nbytes)
    letters, codes = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    x, y = codes[: x.size].reshape(x.shape), codes[x.size :].reshape(y.shape)
    places = np.zeros((len(x), len(letters)), dtype=word)
    for k in range(m):
        places[np.arange(len(x)), x[:, k]] |= word(1 << k)
    places, base, one, top = places.ravel(), i * len(letters), word(1), word(m - 1)
    more, less, found = np.full(len(i), ~word(0)), np.zeros(len(i), dtype=word), np.full(len(i), m, dtype=np.int32)
    for t in range(n):
        same = places[base + y[j, t]]
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up, fall = less | ~(across | more), more & across
        found += ((up >> top) & one).astype(np.int8) - ((fall >> top) & one).astype(np.int8)
        up, fall = (up << one) | one, fall << one
        more, less = fall | ~(down | up), up & down
    return found


def joining(a: np.ndarray, b: np.ndarray, away: np.ndarray, sets: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those of the links a, b (b stands `beyond` further in sets) that join two sets, none twice, and the sets after them, by their least member's number."""
    kept = [np.zeros(0, dtype=np.int64)]
    open_ = np.arange(len(a))
    while True:
        low, high = np.sort([sets[a[open_]], sets[b[open_] + beyond]], axis=0)
        open_, low, high = (v[low != high] for v in (open_, low, high))
        if not len(open_):
            kept = np.concatenate(kept)
            return a[kept], b[kept], away[kept], sets
        moved, which = np.unique(high, return_index=True)
        into = np.arange(len(sets))
        into[moved] = low[which]
        while (further := into[into] != into).any():
            into[further] = into[into[further]]
        sets = into[sets]
        kept.append(open_[which])


def near_in_tiles(batches: Iterator[pa.RecordBatch], forest: bool = False) -> Iterator[pa.RecordBatch]:
    """a, b, distance, both ways, of the near keys of each row's two tiles; see near_pairs. As a forest only as many of them as join what all of them do."""
    for batch in batches:
        for row in range(batch.num_rows):
            told = {c: batch.column(c)[row].as_py() for c in ("r_x", "r_y", "first", "last", "bits", "same")}
            keys = [batch.column(f"keys_{c}")[row].values for c in "xy"]
            sigs = [batch.column(f"sigs_{c}")[row].values.to_numpy(zero_copy_only=False) for c in "xy"]
            texts = []
            for own in keys:
                own = own.to_pylist()
                m = len(own[0])
                texts.append(np.array(own, dtype=f"U{max(1, m)}").view(np.uint32).reshape(len(own), -1)[:, :m][:, told["first"] : m - told["last"]])
            both, nx, ny = pa.concat_arrays(keys), len(keys[0]), len(keys[1])
            step, sets = max(1, AT_ONCE // ny), np.arange(nx + ny)
            for low in range(0, nx, step):
                fit = np.bitwise_count(sigs[0][low : low + step, None] ^ sigs[1][None, :]) <= told["bits"]
                if told["same"]:
                    fit &= np.arange(low, low + len(fit))[:, None] < np.arange(ny)
                i, j = np.nonzero(fit)
                i += low
                for at in range(0, len(i), AT_ONCE // 8):
                    a, b = i[at : at + AT_ONCE // 8], j[at : at + AT_ONCE // 8]
                    if forest:
                        apart = sets[a] != sets[b + (0 if told["same"] else nx)]
                        a, b = a[apart], b[apart]
                    away = distances(*texts, a, b)
                    if forest:
                        near = away <= told["r_x"]
                        a, b, away, sets = joining(a[near], b[near], away[near], sets, 0 if told["same"] else nx)
                    to, back = away <= told["r_x"], away <= told["r_y"]
                    out = [np.concatenate([a[to], b[back] + nx]), np.concatenate([b[to] + nx, a[back]]), np.concatenate([away[to], away[back]]).astype(np.int32)]
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays([both.take(pa.array(out[0])), both.take(pa.array(out[1])), pa.array(out[2])], names=["a", "b", "distance"])


def near_pairs(keys: DataFrame, which: Column | None = None, of_masks: Column | None = None) -> DataFrame:
    """a, b, distance: keys b within edit distance r = max(1, length(a) // 5) of a, without comparing all pairs; only those for which
    the Column `which` of a and b holds. Keys whose masks x and y (digits are 0) don't fulfil `of_masks` are not compared.

    Leaving out the digits of both never raises a distance. So the keys' stems, which are without digits, are compared first (near_texts, with the
    largest r of a stem's keys), then their masks: those of two keys tell how far their digits may differ (digit_room). The keys of two such masks
    meet tile by tile (TOGETHER), each pair once for both its ways, and is not gathered with others again. Of pairs whose digits fit (digit_signature) the
    distance is taken, from the first to the last digit where all else is equal.
    """
    spark = keys.sparkSession
    parts = spread_over(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # rows of two tiles are large
    digits, radius = F.col("key").rlike("[0-9]"), F.greatest(F.lit(1), F.floor(F.length("mask") / 5)).cast("int")
    keys = cut(keys.select("key").filter("key != ''").distinct().select("key", F.regexp_replace("key", "[0-9]", "0").alias("mask"), F.when(digits, digit_signature(F.col("key"))).otherwise(0).alias("sig")))
    masks = keys.groupBy("mask").agg(F.count("*").alias("n")).select("mask", "n", F.replace("mask", F.lit("0"), F.lit("")).alias("stem"), radius.alias("r"), F.length("mask").alias("m"), F.ceil(F.col("n") / TOGETHER).cast("int").alias("shares"), F.regexp_extract("mask", "^[^0]*", 0).alias("head"), F.regexp_extract("mask", "[^0]*$", 0).alias("tail"))
    masks = cut(masks)
    near = cut(near_texts(masks.groupBy(F.col("stem").alias("text")).agg(F.max("r").alias("r"))))
    side = lambda x: masks.select(F.col("mask").alias(x), F.col("stem").alias(f"stem_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "r", "m", "head", "tail")])
    pairs = side("x").join(near.toDF("stem_x", "stem_y"), "stem_x").join(side("y"), "stem_y").filter("x <= y and abs(m_x - m_y) <= greatest(r_x, r_y)")
    pairs = pairs if of_masks is None else pairs.filter(of_masks)
    inner = (F.col("head_x") == F.col("head_y")) & (F.col("tail_x") == F.col("tail_y")) & (F.col("stem_x") != F.col("x")) & (F.col("stem_y") != F.col("y"))
    pairs = pairs.select("x", "y", F.greatest("r_x", "r_y").alias("r"), "r_x", "r_y", (F.col("n_x") * F.col("n_y")).alias("work"), F.when(inner, F.length("head_x")).otherwise(0).alias("first"), F.when(inner, F.length("tail_x")).otherwise(0).alias("last"))
    pairs = cut(pairs.repartition(parts, "x", "y").mapInPandas(digit_room, "x string, y string, r int, r_x int, r_y int, work long, first int, last int, bits int"))
    dealt = keys.join(masks.select("mask", "shares"), "mask").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
    tiles = cut(dealt.groupBy("mask", "share").agg(F.collect_list(F.struct("key", "sig")).alias("tile")))
    tile = lambda x: tiles.select(F.col("mask").alias(x), F.col("share").alias(f"share_{x}"), F.col("tile.key").alias(f"keys_{x}"), F.col("tile.sig").alias(f"sigs_{x}"))
    met = pairs.join(tile("x"), "x").join(tile("y"), "y").filter("x != y or share_x <= share_y")
    work = pairs.agg(F.sum("work")).first()[0] or 0
    met = met.repartition(min(MOST_TASKS, max(parts, -(-work // (4 * TOGETHER) ** 2))), "x", "y", "share_x", "share_y")
    met = met.select("r_x", "r_y", "first", "last", "bits", F.expr("x = y and share_x = share_y").alias("same"), "keys_x", "sigs_x", "keys_y", "sigs_y")
    found = met.mapInArrow(near_in_tiles, "a string, b string, distance int")
    return found if which is None else found.filter(which)


def prefix_distance(query: Column, key: Column) -> Column:
    """The least edit distance between the query and any prefix of the key."""
    return F.array_min(F.transform(F.sequence(F.lit(0), F.length(key)), lambda n: F.levenshtein(query, key.substr(F.lit(1), n))))


def lookup(keys: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The `limit` best entities for a free text, over keys(key, entity_type, entity_id): equal, beginning with it, then near by distance and length."""
    text = query.strip()
    asked = with_entity(keys.sparkSession.createDataFrame([(text,)], "raw string"), "raw").select("raw", "held_as.name")
    asked = asked.select(F.when(match_key(F.col("name")) != "", match_key(F.col("name"))).otherwise(match_key(F.col("raw"))).alias("q")).filter("q != ''")
    rows = keys.join(F.broadcast(asked))
    r = F.greatest(F.lit(1), F.floor(F.length("q") * 0.2)).cast("int")
    near = F.least(F.levenshtein("q", "key"), prefix_distance(F.col("q"), F.col("key")))
    tier = F.when(F.col("key") == F.col("q"), 0).when(F.startswith("key", "q"), 1).when(near <= r, 2)
    best = rows.select("entity_id", "entity_type", "key", tier.alias("tier"), F.when(tier == 2, near).otherwise(0).alias("distance")).filter("tier is not null")
    order = [F.col("tier"), F.when(F.col("tier") < 2, F.col("entity_type")), F.col("distance"), F.when(F.col("tier") == 2, F.length("key")).otherwise(0), F.col("key")]
    one = best.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).filter("place = 1")
    return one.orderBy(*order).limit(limit).select("entity_id", "entity_type", "key", "tier", "distance")
