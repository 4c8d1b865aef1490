"""The ownership relations derived from the TPC-H-like tables, and names to resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(holder_id, holder, held_id, held, stake_bp, role): the twelve largest customers of each supplier, and for every
    third supplier the two others that share most orders with it."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    q = items.join(orders, "l_orderkey").groupBy(F.col("o_custkey").alias("holder_id"), F.col("l_suppkey").alias("held_id")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    customers = _shares(q, 12, 5500).select(
        "holder_id", F.format_string("C%d", "holder_id").alias("holder"), "held_id", F.format_string("S%d", "held_id").alias("held"), "stake_bp",
        F.when(F.col("rank") <= 4, "Promoter").when(F.col("rank") <= 8, "Promoter Group").otherwise("Public (>1%)").alias("role"),
    )
    pairs = items.select("l_orderkey", "l_suppkey").distinct()
    held = pairs.filter("l_suppkey % 3 = 0").toDF("l_orderkey", "held_id")
    n = pairs.join(held, "l_orderkey").filter("l_suppkey != held_id").groupBy(F.col("l_suppkey").alias("holder_id"), "held_id").agg(F.count("*").alias("q"))
    cross = _shares(n, 2, 3000).select(
        "holder_id", F.format_string("S%d", "holder_id").alias("holder"), "held_id", F.format_string("S%d", "held_id").alias("held"), "stake_bp", F.lit("Promoter").alias("role")
    )
    return customers.unionByName(cross)


def _shares(q: DataFrame, keep: int, cap: int) -> DataFrame:
    """The `keep` largest holders of each held entity and their part of cap basis points."""
    ranked = q.withColumn("rank", F.row_number().over(Window.partitionBy("held_id").orderBy(F.desc("q"), "holder_id"))).filter(F.col("rank") <= keep)
    total = F.sum("q").over(Window.partitionBy("held_id"))
    return ranked.withColumn("stake_bp", F.floor((F.lit(cap) * F.col("q")).cast("double") / total.cast("double")).cast("bigint"))


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, name, entity_type, listed), edges(holder, held, stake, role))."""
    edges = relations(spark, sf_dir).groupBy("holder", "held").agg((F.sum("stake_bp") / F.lit(10000.0)).alias("stake"), F.min("role").alias("role"))
    people = F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE")
    customers = table(spark, sf_dir, "customer").select(F.format_string("C%d", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(people, "individual").otherwise("corporate").alias("entity_type"), F.lit(False).alias("listed"))
    suppliers = table(spark, sf_dir, "supplier").select(F.format_string("S%d", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("corporate").alias("entity_type"), F.lit(True).alias("listed"))
    return customers.unionByName(suppliers), edges


def filed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, holder_name, entity_type, held_name, stake, holder_role): relations with names as filed, in six spellings, one of them with a slip."""
    base = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    slip = F.when(F.length(F.substring_index("p_name", " ", -1)) >= 5, F.expr("left(p_name, length(p_name) - 1)")).otherwise(F.col("p_name"))
    parts = table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), F.concat_ws(" ", slip, F.col("p_partkey").cast("string")).alias("slip"))
    people = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE")).select(F.format_string("C%d", "c_custkey").alias("holder"), F.lit("individual").alias("person"))
    rel = relations(spark, sf_dir).join(people, "holder", "left")
    rel = rel.join(parts.withColumnRenamed("p_partkey", "holder_id"), "holder_id").join(parts.select(F.col("p_partkey").alias("held_id"), F.col("base").alias("held_base")), "held_id")
    v = F.pmod(F.col("holder_id") + F.col("held_id"), F.lit(6))
    raw = (
        F.when(v == 0, F.concat("base", F.lit(" Ltd"))).when(v == 1, F.concat("base", F.lit(" LIMITED"))).when(v == 2, F.concat("base", F.lit(" Pvt. Ltd."))).when(v == 3, F.upper("slip"))
        .when(v == 4, F.concat(F.lit("Mr "), "base")).otherwise(F.concat("base", F.lit(", Trustee of "), "base", F.lit(" Trust")))
    )
    # some name the holder once more, in a form that only resolution sees through
    held = F.when((F.col("holder_id") + F.col("held_id")) % 29 == 0, F.concat("base", F.lit(" Co"))).otherwise(F.concat("held_base", F.lit(" Company Ltd")))
    # the line tells rows apart and puts them in an order; customers and suppliers may share a number
    line = (F.col("held_id") * 1_000_000 + F.col("holder_id")) * 2 + F.startswith("holder", F.lit("C")).cast("int")
    return rel.select(
        line.alias("line"), raw.alias("holder_name"), F.coalesce("person", F.lit("corporate")).alias("entity_type"), held.alias("held_name"),
        (F.col("stake_bp") / 100).alias("stake"), F.col("role").alias("holder_role"),
    )


def filed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw, filed_type, listed): names of holders and held entities as filed."""
    # both sides of a row at once: the relations are worked out a single time
    sides = F.array(
        F.struct(F.col("holder_name").alias("raw"), F.col("entity_type").alias("filed_type"), F.lit(False).alias("listed")),
        F.struct(F.col("held_name").alias("raw"), F.lit("corporate").alias("filed_type"), F.lit(True).alias("listed")),
    )
    return filed_relations(spark, sf_dir).select(F.inline(sides))


def filed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation rows as text cells, every thirteenth kind of them wrong in one way."""
    rel = relations(spark, sf_dir)
    k = F.pmod(F.col("holder_id") * 7 + F.col("held_id"), F.lit(26))
    percent = F.format_string("%d.%02d", F.floor(F.col("stake_bp") / 100).cast("bigint"), F.pmod(F.col("stake_bp"), F.lit(100)))
    return rel.select(
        "holder", "held", F.when(k == 0, "").when(k == 1, "-- $ --").when(k == 2, F.concat(F.lit(" "), "holder", F.lit("\u0007"))).when(k == 3, F.concat(F.upper("held"), F.lit(" LIMITED"))).otherwise(F.concat("holder", F.lit(" Pvt Ltd"))).alias("holder_name"),
        F.concat("held", F.lit(" Ltd.")).alias("held_name"),
        F.when(k == 4, "abc").when(k == 5, "31.74%").when(k == 6, "nan").when(k == 7, "100.01").when(k == 8, "-0.5").otherwise(percent).alias("stake_pct"),
        F.when(k == 9, "2026-02-30").when(k == 10, "15/07/2026").when(k == 11, "20260715").otherwise("2026-07-15").alias("filing_date"),
        F.when(k == 12, "company").when(k == 13, " Corporate ").otherwise("corporate").alias("entity_type"),
        F.when(k == 14, "-5").when(k == 15, "1.5").when(k == 16, "").otherwise(F.col("stake_bp").cast("string")).alias("shares_held"),
        F.when(k == 17, "2026-13-01").otherwise("2026-06-30").alias("as_on_date"),
    )
