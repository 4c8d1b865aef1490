"""Networks of any size for benchmarks, by hashing only: each row is made from its number, in any order and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The shape of the filed network.
LISTED, PERSONS, BY_COMPANIES, EDGES_A_NODE = 0.114, 0.319, 0.108, 946 / 405
RECORDED = (0.5, 0.85)  # what a company's recorded owners hold together
TAIL = 3.0  # the larger, the fewer holders have most of the holdings


def network(spark: SparkSession, size: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of `size` nodes.

    The first LISTED of them are companies, the only nodes with owners; every other node, a person or not, holds one company. The
    remaining edges belong to companies drawn alike, their holders being companies in BY_COMPANIES of the cases and else nodes drawn with
    a long tail (number u^TAIL for a uniform u). A company's stakes are drawn and scaled to its share of RECORDED. Repeated
    edges and self-holdings are left out, so there are a few less than EDGES_A_NODE a node.
    """
    companies = max(2, round(size * LISTED))
    holders, extra = size - companies, max(0, round(size * EDGES_A_NODE) - (size - companies))

    def drawn(what: str, *of: Column | str) -> Column:
        """A uniform number from 0 to 1, by what it is for and of."""
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *of), F.lit(1 << 40)) / float(1 << 40)

    pick = lambda n, u: F.least(F.floor(n * u), F.lit(n - 1)).cast("long")
    first = spark.range(holders).select((F.col("id") + companies).alias("to"), pick(companies, drawn("first", "id")).alias("of"))
    owner = F.when(drawn("kind", "id") < BY_COMPANIES, pick(companies, drawn("company", "id"))).otherwise(companies + pick(max(1, holders), F.pow(drawn("holder", "id"), TAIL)))
    more = spark.range(extra).select(owner.alias("to"), pick(companies, drawn("of", "id")).alias("of"))
    pairs = first.unionByName(more).filter((F.col("to") != F.col("of")) & (F.col("to") < size)).distinct()
    weight = F.exp(4 * drawn("stake", "to", "of"))  # a few large stakes, many small ones
    recorded = RECORDED[0] + (RECORDED[1] - RECORDED[0]) * drawn("recorded", "of")
    stake = recorded * F.col("weight") / F.sum("weight").over(Window.partitionBy("of"))
    name = lambda c: F.format_string("N%d", c)
    edges = pairs.withColumn("weight", weight).select(name("to").alias("holder"), name("of").alias("held"), stake.alias("stake"), F.lit("Promoter").alias("role"))
    kind = F.when((F.col("id") >= companies) & (F.col("id") < companies + round(size * PERSONS)), "individual").otherwise("corporate")
    nodes = spark.range(size).select(name("id").alias("id"), F.format_string("Company %d", "id").alias("name"), kind.alias("entity_type"), (F.col("id") < companies).alias("listed"))
    return nodes, edges
