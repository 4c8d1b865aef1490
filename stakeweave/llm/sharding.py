"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards; a row descends from the root. At each node every child draws
-ln(u) / weight, u in (0, 1] from the MD5 of (key, child), and the smallest draw wins, so a child is chosen in
proportion to its weight. A child's draw depends on nothing but the key, its own name and its own weight:
when a weight changes, rows move only into or out of that child, within its parent's subtree.

The founding tree holds the first `founding` shards; each later shard is a region of its own beside them. No
weight that stood before changes, so one more shard takes rows only into itself (law `key`), for any
count from `founding` on.

Slots number the rows of each shard from 0 without a gap, in the order of (bucket of the key's and the text's hash, doc_id, text_crc32, size).
Rows that agree in doc_id, size and CRC can't be told apart in the result: they are counted (map-side first), one row of the count is
placed, and it is unfolded into their slots in the end, in chunks of CHUNK dealt to many tasks. So neither a repeated nor a null doc_id
gathers rows in one task, and only counts of one bucket are ordered together; the counts of at most 4096 buckets a shard are summed.

Of children with equal draws the first one wins. A null doc_id hashes as an empty key; a null text has size 1 and CRC 0; texts of any
length are hashed whole; repeated rows share a shard and get slots of their own; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1 << 16
Tree = dict[str, "Tree | float"]  # name -> subtree, or the weight of a shard (named by its number)


def default_tree(shards: int, founding: int = 8) -> Tree:
    """Two regions of two racks of two shards (as far as there are shards), later shards as regions of their own."""
    tree: Tree = {}
    for s in range(min(shards, founding)):
        tree.setdefault(f"region{s // 4}", {}).setdefault(f"rack{s // 2}", {})[str(s)] = 1.0
    for s in range(founding, shards):
        tree[f"region{s}"] = {f"rack{s}": {str(s): 1.0}}
    return tree


def weight(node: Tree | float) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def hashed(key: Column, name: str) -> Column:
    """52 bits of MD5(key/name) as a long."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}")).cast("binary")), 1, 13), 16, 10).cast("long")


def descend(key: Column, tree: Tree) -> Column:
    """The shard (int) that the key's descent ends in."""
    live = {name: sub for name, sub in tree.items() if weight(sub) > 0}
    ends = {name: descend(key, sub) if isinstance(sub, dict) else F.lit(int(name)) for name, sub in live.items()}
    if len(live) == 1:
        return next(iter(ends.values()))
    draws = [F.struct((-F.log((hashed(key, name) + 1) / F.lit(float(1 << 52))) / F.lit(weight(sub))).alias("draw"), F.lit(i).alias("i")) for i, (name, sub) in enumerate(live.items())]
    won = F.array_min(F.array(*draws))["i"]
    first, *between, last = ends.values()
    out = F.when(won == 0, first)
    for i, end in enumerate(between, 1):
        out = out.when(won == i, end)
    return out.otherwise(last)


def shard_rows(docs: DataFrame, shards: int = 8, founding: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    seen = docs.groupBy(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32")
    ).agg(F.count("*").alias("n"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = seen.select(
        "*",
        descend(key, default_tree(shards, founding)).cast("int").alias("shard"),
        descend(key, default_tree(shards + 1, founding)).cast("int").alias("grown_shard"),
        (hashed(F.concat_ws("/", key, F.col("text_crc32").cast("string")), "slot") % 4096).cast("int").alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    offsets = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("first", upto - F.col("n")).join(offsets, ["shard", "bucket"]).withColumn("first", F.col("first") + F.col("before"))
    out = ("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
    single = placed.filter("n = 1").withColumn("slot", F.col("first")).select(*out)
    chunks = placed.filter("n > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK)))).repartition("shard", "first", "chunk")
    own = F.sequence(F.col("first") + F.col("chunk") * CHUNK, F.col("first") + F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)
    return single.unionByName(chunks.withColumn("slot", F.explode(own)).select(*out))


def descent_sql(key: str, tree: Tree) -> str:
    """descend() for DuckDB."""
    live = {name: sub for name, sub in tree.items() if weight(sub) > 0}
    ends = [descent_sql(key, sub) if isinstance(sub, dict) else str(int(name)) for name, sub in live.items()]
    if len(live) == 1:
        return ends[0]
    draws = [f"-ln((CAST('0x' || substr(md5({key} || '/{name}'), 1, 13) AS BIGINT) + 1) / 4503599627370496.0) / {weight(sub)!r}" for name, sub in live.items()]
    won = f"list_position([{', '.join(draws)}], list_min([{', '.join(draws)}]))"
    return f"(CASE {won} {' '.join(f'WHEN {i} THEN {end}' for i, end in enumerate(ends[:-1], 1))} ELSE {ends[-1]} END)"


def oracle(shards: int = 8, founding: int = 8) -> str:
    """DuckDB SQL for shard_rows over documents: window functions over all rows, and CRC-32 byte by byte with a table made by its rule."""
    return f"""
    WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS step),
    d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size,
      xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM documents, crc),
    s AS (SELECT *, {descent_sql("key", default_tree(shards, founding))} AS shard, {descent_sql("key", default_tree(shards + 1, founding))} AS grown_shard,
      CAST('0x' || substr(md5(key || '/' || text_crc32 || '/slot'), 1, 13) AS BIGINT) % 4096 AS bucket FROM d)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s
    """
