"""Reports: what is known of one company, circular holdings and families of all, and chains as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cycles, matrices
from . import network as net
from .iterate import cut, placed

END_LABELS = {"natural_person": "natural person", "no_recorded_owner": "no recorded owner", "circular": "circular", "below_threshold": "below threshold"}


def percent(x: Column) -> Column:
    return F.when(x >= 0.0001, F.format_string("%.2f%%", x * 100)).otherwise(F.format_string("%.4f%%", x * 100))


def chain_text(path: Column, stakes: Column) -> Column:
    """A <-[31.74%]- B <-[5.00%]- C"""
    steps = F.zip_with(stakes, F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(1))), lambda s, to: F.concat(F.lit(" <-["), percent(s), F.lit("]- "), to))
    return F.concat(F.element_at(path, 1), F.array_join(steps, ""))


def with_stakes(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """chains with stakes, the share of every step, company first."""
    step = chains.select("company", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "held")).withColumn("holder", F.element_at("path", F.col("i") + 2))
    shares = step.join(edges.select("holder", "held", "stake"), ["holder", "held"]).groupBy("company", "path").agg(F.array_sort(F.collect_list(F.struct("i", "stake")))["stake"].alias("stakes"))
    return chains.join(shares, ["company", "path"])


def describe(nodes: DataFrame, edges: DataFrame, company: str, top: int = 10, least: float = 0.0001) -> dict[str, DataFrame]:
    """chains, owners, controller with its integrated stake, levels and circular group of one company."""
    found = cut(net.chains(nodes, edges, least).filter(F.col("company") == company))
    stakes = net.integrated(edges).filter(F.col("company") == company)
    owners, groups = net.ranked_owners(found), net.strong_components(edges)
    shown = with_stakes(net.ranked_chains(found).orderBy("rank").limit(top), edges)
    return {
        "chains": shown.select("rank", chain_text(F.col("path"), F.col("stakes")).alias("chain"), percent(F.col("effective")).alias("effective"), "end_reason").orderBy("rank"),
        "owners": owners.orderBy("rank").limit(top),
        "controller": owners.filter("rank = 1").join(stakes.select("owner", F.col("stake").alias("integrated")), "owner", "left"),
        "levels": net.levels(edges, found.select("company").distinct()),
        "circular": groups.join(groups.filter(F.col("node") == company).select("component"), "component").select("node", "component"),
    }


def chain_report(nodes: DataFrame, edges: DataFrame, least: float = 0.0001) -> DataFrame:
    """company, rank, effective_pct, layers, end_reason, terminal, chain for all chains: one row each, ready for a sink."""
    ranked = with_stakes(net.ranked_chains(net.chains(nodes, edges, least)), edges)
    return ranked.select("company", "rank", net.fixed(F.col("effective") * 100, 6).alias("effective_pct"), "layers", "end_reason", "terminal", chain_text(F.col("path"), F.col("stakes")).alias("chain"), F.concat_ws(">", "path").alias("chain_ids"))


def control_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """company, owners_reachable, ownership_depth, controller, total, control_depth (layers to the controller; null without one)."""
    found, levels = cut(net.chains(nodes, edges)), cut(net.levels(edges))
    depth = levels.groupBy("company").agg((F.count("*") - 1).alias("owners_reachable"), F.max("level").alias("ownership_depth"))
    top = net.ranked_owners(found).filter("rank = 1").select("company", F.col("owner").alias("controller"), "total")
    control = levels.select("company", F.col("entity").alias("controller"), F.col("level").alias("control_depth"))
    return depth.join(top, "company", "left").join(control, ["company", "controller"], "left")


def labelled_families(nodes: DataFrame, family: DataFrame) -> DataFrame:
    """label (F1 for the largest; of equal ones the smallest member decides), family, size, listed, natural_persons."""
    rows = family.select("family", F.col("node").alias("id")).join(nodes.select("id", "listed", "entity_type"), "id").groupBy("family").agg(
        F.count("*").alias("size"), F.count_if("listed").alias("listed"), F.count_if(F.col("entity_type") == "individual").alias("natural_persons")
    )
    return placed(rows, F.desc("size"), F.col("family")).select(F.concat(F.lit("F"), F.col("place").cast("string")).alias("label"), "family", "size", "listed", "natural_persons")


def owner_rows(nodes: DataFrame, edges: DataFrame, simple: DataFrame, stakes: DataFrame, family: DataFrame) -> DataFrame:
    """company, owner, owner_type, same_family, integrated_pct, simple_pct, loop_pct of every ultimate owner."""
    f = family.select("node", "family")
    rows = net.ultimate_integrated(edges, stakes).join(simple.select("company", "owner", F.col("total").alias("simple")), ["company", "owner"], "left")
    rows = rows.join(nodes.select(F.col("id").alias("owner"), F.col("entity_type").alias("owner_type")), "owner").join(f.toDF("company", "family"), "company", "left").join(f.toDF("owner", "owner_family"), "owner", "left")
    added = F.col("stake") - F.coalesce("simple", F.lit(0.0))
    return rows.select(
        "company", "owner", "owner_type", F.coalesce(F.col("family") == F.col("owner_family"), F.lit(False)).alias("same_family"), net.fixed(F.col("stake") * 100, 6).alias("integrated_pct"),
        net.fixed(F.coalesce("simple", F.lit(0.0)) * 100, 6).alias("simple_pct"), net.fixed(F.when(F.abs(added) < 1e-12, 0.0).otherwise(added) * 100, 6).alias("loop_pct"),
    )


def end_histogram(chains: DataFrame) -> DataFrame:
    """company, ends map<string,bigint>: END_LABELS of how its chains end, with counts."""
    label = F.coalesce(*[F.when(F.col("end_reason") == k, v) for k, v in END_LABELS.items()])
    n = chains.groupBy("company", label.alias("label")).agg(F.count("*").alias("n"))
    return n.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("ends"))


def group_subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """holder, held, circular: the edges between members(node), and those with one end among them."""
    near = edges.join(members.select(F.col("node").alias("holder"), F.lit(True).alias("from_inside")), "holder", "left").join(members.select(F.col("node").alias("held"), F.lit(True).alias("to_inside")), "held", "left")
    both = F.col("from_inside").isNotNull() & F.col("to_inside").isNotNull()
    return near.filter("from_inside is not null OR to_inside is not null").select("holder", "held", both.alias("circular"))


def anomaly_report(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """circular groups with their inner edges, back edges and the strongest cycles, control depth and families."""
    groups = cut(net.strong_components(edges))
    inner = cut(edges.join(groups.toDF("holder", "component"), "holder").join(groups.toDF("held", "component"), ["held", "component"]))
    sizes = matrices.groups(groups)
    return {
        "circular_groups": sizes.join(inner.groupBy("component").agg(F.count("*").alias("internal_edges"), F.max("stake").alias("strongest")), "component", "left"),
        "strongest_edges": inner.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("stake"), "holder", "held"))).filter("place <= 5"),
        "back_edges": cycles.back_edges(edges),
        "example_cycles": cycles.example_cycles(edges, groups),
        "control_depth": control_depth(nodes, edges),
        "families": labelled_families(nodes, net.families(nodes, edges)),
    }
