"""Questions to the ownership network, over nodes(id, entity_type, listed) and edges(holder, held, stake, role).

All companies are asked at once: each walk step is one join of a frontier with the edges, cut and repeated until
nothing is left. Nothing is gathered on the driver but a test whether rows are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .iterate import cut, dropped, some

PROMOTERS = ("Promoter", "Promoter Group")
OWNER_ENDS = ("no_recorded_owner", "natural_person")


def fixed(c: Column | str, places: int) -> Column:
    """Rounded half up, with exact ties (products of whole basis points) moved off the edge, so that binary noise decides none."""
    return F.round((F.col(c) if isinstance(c, str) else c) + (1e-13 if places > 6 else 1e-11), places)


def chains(nodes: DataFrame, edges: DataFrame, least: float = 0.0001, deepest: int = 200, most: int = 10**10) -> DataFrame:
    """Every ownership chain upward: company, path (company first), effective, layers, terminal, end_reason.

    A step whose product of stakes is below `least` goes; an owner on the path ends it as circular, a person or
    an owner without owners ends it as such; a chain that cannot go on for the threshold is below_threshold.

    Without a threshold the simple paths of a dense cyclic core grow exponentially with its size: `most` rows of a step are the
    guard, beyond which ArithmeticError is raised before the next step (integrated() answers the same question in a few steps).
    """
    persons = nodes.filter("entity_type = 'individual'").select(F.col("id").alias("holder"), F.lit("natural_person").alias("person"))
    owned = edges.select(F.col("held").alias("holder")).distinct().withColumn("owned", F.lit(True))
    # what an owner ends a chain as, if it is not on it yet, stands on its edges
    ends = edges.select("holder", "held", "stake").join(persons, "holder", "left").join(owned, "holder", "left")
    steps = cut(ends.select(F.col("held").alias("at"), F.col("holder").alias("tip"), "stake", F.coalesce("person", F.when(F.col("owned").isNull(), "no_recorded_owner")).alias("end")))
    front = steps.select(F.col("at").alias("company")).distinct()
    front = front.select("company", F.array("company").alias("path"), F.lit(1.0).alias("effective"), F.col("company").alias("at"))
    out = []
    for _ in range(deepest):
        seen = front.join(steps, "at").withColumn("effective", F.col("effective") * F.col("stake")).filter(F.col("effective") >= least)
        reason = F.when(F.array_contains("path", F.col("tip")), "circular").otherwise(F.col("end"))
        seen = cut(seen.select("company", F.col("path").alias("before"), F.concat("path", F.array("tip")).alias("path"), "effective", "tip", reason.alias("end_reason")))
        stopped = front.filter(F.size("path") > 1).join(seen.select(F.col("before").alias("path")).distinct(), "path", "left_anti")
        out.append(stopped.select("company", "path", "effective", F.lit("below_threshold").alias("end_reason")))
        out.append(seen.filter("end_reason is not null").select("company", "path", "effective", "end_reason"))
        front = seen.filter("end_reason is null").select("company", "path", "effective", F.col("tip").alias("at"))
        left = front.count()
        if not left:
            break
        if left > most:
            raise ArithmeticError(f"{left} open chains after {len(out) // 2} layers: choose a higher threshold")
    else:
        raise RuntimeError(f"chains longer than {deepest} layers")
    every = reduce(DataFrame.unionByName, out)
    return every.select("company", "path", "effective", (F.size("path") - 1).alias("layers"), F.element_at("path", -1).alias("terminal"), "end_reason")


def ranked_chains(found: DataFrame) -> DataFrame:
    """Chains with their rank per company by effective stake (to 9 places), layers and ids."""
    order = Window.partitionBy("company").orderBy(F.desc(fixed("effective", 9)), "layers", F.concat_ws(">", "path"))
    return found.withColumn("rank", F.row_number().over(order))


def ultimate_owners(found: DataFrame) -> DataFrame:
    """company, owner, total, routes over chains that end at an owner."""
    return found.filter(F.col("end_reason").isin(*OWNER_ENDS)).groupBy("company", F.col("terminal").alias("owner")).agg(F.sum("effective").alias("total"), F.count("*").alias("routes"))


def ranked_owners(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("company").orderBy(F.desc(fixed("total", 8)), "owner")
    return ultimate_owners(found).withColumn("rank", F.row_number().over(order))


def levels(edges: DataFrame, starts: DataFrame | None = None, deepest: int = 100_000) -> DataFrame:
    """company, entity, level: the least number of layers from each company up to each entity; itself 0."""
    starts = (edges.select("held") if starts is None else starts).toDF("company").distinct()
    steps = edges.select(F.col("held").alias("entity"), F.col("holder").alias("up")).distinct()
    front = cut(starts.select("company", F.col("company").alias("entity"), F.lit(0).alias("level")))
    seen = front
    for level in range(1, deepest):
        new = front.join(steps, "entity").select("company", F.col("up").alias("entity")).distinct().join(seen.select("company", "entity"), ["company", "entity"], "left_anti")
        front = cut(new.withColumn("level", F.lit(level)))
        if not some(front):
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError("levels have not settled")


def least_labels(pairs: DataFrame, nodes: DataFrame, limit: int = 200) -> DataFrame:
    """node, component (its smallest node) of undirected pairs(a, b); isolated nodes are their own."""
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct().toDF("node", "other"))
    labels = cut(nodes.toDF("node").distinct().withColumn("component", F.col("node")))
    for _ in range(limit):
        near = both.join(labels.toDF("other", "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").withColumn("best", F.least("component", F.coalesce("near", "component")))
        far = labels.toDF("best", "far")
        new = cut(step.join(far, "best", "left").select("node", F.least("best", F.coalesce("far", "best")).alias("now"), "component"))
        dropped(labels)
        labels = new.select("node", F.col("now").alias("component"))
        if not some(new.filter("now != component")):
            dropped(both)
            return labels
    raise RuntimeError("components have not settled")


def components(nodes: DataFrame, edges: DataFrame, which: Column | None = None) -> DataFrame:
    """Connected components over all edges, or those for which the Column `which` holds."""
    kept = edges if which is None else edges.filter(which)
    return least_labels(kept.select(F.col("holder").alias("a"), F.col("held").alias("b")), nodes.select("id"))


def promoter() -> Column:
    return F.col("role").isin(*PROMOTERS)


def families(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, family (smallest member), size of components over promoter edges with over one member."""
    comp = components(nodes, edges, promoter())
    sizes = comp.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return comp.join(sizes, "component").select("node", F.col("component").alias("family"), "size")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (holder, held) left after repeatedly removing nodes without an owner or without a holding."""
    left, n = cut(edges.select("holder", "held").distinct()), -1
    while (now := left.count()) != n:
        n, old = now, left
        owned, owning = left.select(F.col("held").alias("holder")).distinct(), left.select(F.col("holder").alias("held")).distinct()
        left = cut(left.join(owned, "holder", "left_semi").join(owning, "held", "left_semi").select("holder", "held"))
        dropped(old)
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest member) of strongly connected groups of over one member.

    Only the trimmed core can hold cycles. There, forward and backward labels (the smallest node that reaches and
    that is reached) spread until they settle; nodes where both agree are a component, and go; the rest is repeated.
    """
    core = trimmed(edges)
    done = None
    while some(core):
        ahead, behind = spread(core, "holder", "held"), spread(core, "held", "holder")
        same = ahead.toDF("node", "component").join(behind.toDF("node", "component"), ["node", "component"])
        sizes = same.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
        found = cut(same.join(sizes, "component").select("node", "component"))
        settled = cut(same.select("node"))
        done = found if done is None else done.unionByName(found)
        old = core
        core = trimmed(core.join(settled.toDF("holder"), "holder", "left_anti").join(settled.toDF("held"), "held", "left_anti"))
        dropped(old, ahead, behind, settled)
    return edges.select(F.col("held").alias("node"), F.col("held").alias("component")).limit(0) if done is None else done


def spread(edges: DataFrame, source: str, target: str, limit: int = 100_000) -> DataFrame:
    """node, label: the smallest node from which the node can be reached along source -> target, itself included."""
    steps = edges.select(F.col(source).alias("node"), F.col(target).alias("to"))
    labels = cut(steps.select("node").union(steps.select("to")).distinct().withColumn("label", F.col("node")))
    for _ in range(limit):
        near = steps.join(labels, "node").groupBy(F.col("to").alias("node")).agg(F.min("label").alias("near"))
        new = cut(labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("now"), "label"))
        dropped(labels)
        labels = new.select("node", F.col("now").alias("label"))
        if not some(new.filter("now != label")):
            return labels
    raise RuntimeError("labels have not settled")


def integrated(edges: DataFrame, least: float = 1e-15, limit: int = 10_000) -> DataFrame:
    """company, owner, stake: x = sum over paths upward that do not pass the company again, loops included, for all companies.

    x_company = 1; x_v = sum over its holdings w of s(v, w) x_w for v other than the company. Walk weights are carried
    step by step; a weight below `least` is not carried on, so a stake may miss at most that much for each step and entity. A network
    whose walks don't fade raises ArithmeticError.
    """
    steps = edges.select(F.col("held").alias("at"), F.col("holder").alias("owner"), "stake")
    front = cut(edges.select(F.col("held").alias("company")).distinct().select("company", F.col("company").alias("at"), F.lit(1.0).alias("x")))
    parts = []
    for _ in range(limit):
        step = front.join(steps, "at").filter("owner != company").groupBy("company", "owner").agg(F.sum(F.col("x") * F.col("stake")).alias("x")).filter(F.col("x") >= least)
        front = cut(step.select("company", F.col("owner").alias("at"), "x"))
        if not some(front):
            whole = reduce(DataFrame.unionByName, parts) if parts else front
            return whole.groupBy("company", F.col("at").alias("owner")).agg(F.sum("x").alias("stake"))
        parts.append(front)
    raise ArithmeticError(f"the walk sum has not converged after {limit} terms")


def ultimate_integrated(edges: DataFrame, stakes: DataFrame) -> DataFrame:
    """Integrated stakes of entities without a recorded owner."""
    return stakes.join(edges.select(F.col("held").alias("owner")).distinct(), "owner", "left_anti").select("company", "owner", "stake")


def self_ownership(edges: DataFrame, stakes: DataFrame) -> DataFrame:
    """company, stake that it holds in itself through others."""
    back = edges.select(F.col("holder").alias("company"), F.col("held").alias("owner"), F.col("stake").alias("s"))
    return stakes.join(back, ["company", "owner"]).groupBy("company").agg(F.sum(F.col("s") * F.col("stake")).alias("self_stake"))


def company_metrics(nodes: DataFrame, edges: DataFrame, simple: DataFrame, stakes: DataFrame, family: DataFrame) -> DataFrame:
    """Concentration of control per listed company; `simple` are ultimate owners over chains without a threshold."""
    owners = ultimate_integrated(edges, stakes)
    f = family.select("node", "family")
    owners = owners.join(f.toDF("company", "family"), "company", "left").join(f.toDF("owner", "owner_family"), "owner", "left")
    place = F.row_number().over(Window.partitionBy("company").orderBy(F.desc(fixed("stake", 8)), "owner"))
    owners = owners.withColumn("place", place)
    one = owners.groupBy("company").agg(
        F.first("family").alias("family"), F.count("*").alias("owners"), F.sum("stake").alias("traced"), F.max(F.when(F.col("place") == 1, F.col("owner"))).alias("controller"),
        F.max(F.when(F.col("place") == 1, F.col("stake"))).alias("top"), F.sum(F.when(F.col("place") <= 3, F.col("stake"))).alias("top3"), F.sum(F.pow(F.col("stake") * 100, 2)).alias("hhi"),
        F.sum(F.when(F.col("family").eqNullSafe(F.col("owner_family")), F.col("stake")).otherwise(0.0)).alias("own"),
    )
    listed = nodes.filter("listed").select(F.col("id").alias("company"))
    total = simple.groupBy("company").agg(F.sum("total").alias("simple"))
    rows = listed.join(one, "company", "left").join(self_ownership(edges, stakes), "company", "left").join(total, "company", "left")
    x = lambda c: F.coalesce(c, F.lit(0.0))
    clean = lambda c: F.when(F.abs(c) < 1e-12, 0.0).otherwise(c)
    rows = rows.drop("family").join(f.toDF("company", "family"), "company", "left")
    return rows.select(
        "company", "family", F.coalesce("owners", F.lit(0)).alias("owners"), "controller", fixed(x("traced") * 100, 5).alias("traced_pct"), fixed(x("top") * 100, 5).alias("controller_pct"),
        fixed(x("top3") * 100, 5).alias("top3_pct"), fixed(x("hhi"), 5).alias("hhi"), fixed(x("own") * 100, 5).alias("family_pct"), fixed((x("traced") - x("own")) * 100, 5).alias("outside_family_pct"),
        fixed(clean(x("self_stake")) * 100, 5).alias("self_ownership_pct"), fixed(clean(x("traced") - x("simple")) * 100, 5).alias("loop_contribution_pct"),
    )


def family_metrics(companies: DataFrame) -> DataFrame:
    return companies.groupBy(F.coalesce("family", F.lit("none")).alias("family")).agg(
        F.count("*").alias("companies"), F.round(F.avg("family_pct"), 4).alias("mean_pct"), F.round(F.median("family_pct"), 4).alias("median_pct"), F.round(F.min("family_pct"), 4).alias("min_pct"), F.round(F.max("family_pct"), 4).alias("max_pct"),
        F.count_if(F.col("family_pct") > 50).alias("over_50"), F.count_if(F.col("family_pct").between(25, 50)).alias("from_25_to_50"), F.count_if(F.col("family_pct") < 25).alias("under_25"), F.round(F.avg("hhi"), 2).alias("mean_hhi"),
        F.countDistinct("controller").alias("controllers"),
    )
