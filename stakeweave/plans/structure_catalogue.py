"""Registered queries on the network's structure beyond chains: groups, families, matrices, owners' rows, depths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cycles, matrices, report
from . import network as net
from . import oracles as o
from .catalogue import CHAINS, METRICS, ROUTES, STRONG, network, query, r8
from .iterate import cut

# The derived network controls every company directly; without the customers of every third one, control reaches further.
INDIRECT = o.BASE.replace("owned AS MATERIALIZED", "direct AS MATERIALIZED (SELECT * FROM edges WHERE holder[1] = 'S' OR CAST(held[2:] AS BIGINT) % 3 <> 0),\nowned AS MATERIALIZED").replace("SELECT DISTINCT held FROM edges", "SELECT DISTINCT held FROM direct")


def _indirect(text: str) -> str:
    return text.replace("JOIN edges e", "JOIN direct e")


def _indirect_network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes, e = network(spark, sf_dir)
    return nodes, cut(e.filter("holder LIKE 'S%' OR cast(substring(held, 2) AS bigint) % 3 != 0"))


DEEP = o.ctes(INDIRECT, _indirect(o.walks()), _indirect(o.LEVELS)) + f"""SELECT c.company, c.owner, l.level AS control_depth, r.layers, r.path FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY round(total, 8) DESC, owner) AS rank FROM owners) c
JOIN levels l ON l.company = c.company AND l.entity = c.owner JOIN ({ROUTES}) r ON r.company = c.company AND r.owner = c.owner AND r.rank = 1 WHERE c.rank = 1 AND l.level >= 2"""


@query(DEEP)
def deep_chains(spark, sf_dir):
    """Companies whose controller is at least two layers up, by the dominant route."""
    nodes, e = _indirect_network(spark, sf_dir)
    found = cut(net.chains(nodes, e))
    top = net.ranked_owners(found).filter("rank = 1").select("company", "owner")
    route = net.ranked_chains(found.filter(F.col("end_reason").isin(*net.OWNER_ENDS))).withColumnRenamed("terminal", "owner")
    first = route.withColumn("own", F.row_number().over(Window.partitionBy("company", "owner").orderBy("rank"))).filter("own = 1")
    deep = top.join(net.levels(e).withColumnRenamed("entity", "owner"), ["company", "owner"]).filter("level >= 2").join(first, ["company", "owner"])
    return deep.select("company", "owner", F.col("level").alias("control_depth"), F.col("layers").cast("long").alias("layers"), F.concat_ws(">", "path").alias("path"))


@query(o.ctes(INDIRECT, _indirect(o.walks()), _indirect(o.LEVELS)) + """SELECT d.company, d.owners_reachable, d.ownership_depth, c.owner AS controller, round(c.total, 8) AS total, l.level AS control_depth
FROM (SELECT company, count(*) - 1 AS owners_reachable, max(level) AS ownership_depth FROM levels GROUP BY company) d
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY company ORDER BY round(total, 8) DESC, owner) AS rank FROM owners) c ON c.company = d.company AND c.rank = 1 LEFT JOIN levels l ON l.company = d.company AND l.entity = c.owner""")
def control_depth(spark, sf_dir):
    out = report.control_depth(*_indirect_network(spark, sf_dir))
    return out.select("company", "owners_reachable", "ownership_depth", "controller", r8("total").alias("total"), "control_depth")


@query(STRONG + ", sized AS (SELECT component, count(*) AS size FROM strong GROUP BY component) SELECT row_number() OVER (ORDER BY size DESC, component) AS id, component, size FROM sized")
def circular_groups(spark, sf_dir):
    """Circular groups, the largest first; strong_components has their members."""
    return matrices.groups(net.strong_components(network(spark, sf_dir)[1]))


@query(o.ctes(o.BASE, o.FAMILIES) + """, sized AS (SELECT family, count(*) AS size, count(*) FILTER (n.listed) AS listed, count(*) FILTER (n.entity_type = 'individual') AS natural_persons FROM families JOIN nodes n ON n.id = node GROUP BY family)
SELECT 'F' || row_number() OVER (ORDER BY size DESC, family) AS label, family, size, listed, natural_persons FROM sized""")
def family_labels(spark, sf_dir):
    """Families as F1, F2, ..., the largest first."""
    nodes, e = network(spark, sf_dir)
    return report.labelled_families(nodes, net.families(nodes, e))


OWNER_ROWS = METRICS + """, rows AS (SELECT u.company, u.owner, n.entity_type AS owner_type, coalesce(f.family = g.family, false) AS same_family, u.stake, coalesce(w.total, 0) AS simple
FROM ultimate u JOIN nodes n ON n.id = u.owner LEFT JOIN families f ON f.node = u.company LEFT JOIN families g ON g.node = u.owner LEFT JOIN owners w ON w.company = u.company AND w.owner = u.owner)"""


@query(OWNER_ROWS + "SELECT company, owner, owner_type, same_family, round(stake * 100, 6) AS integrated_pct, round(simple * 100, 6) AS simple_pct, round(CASE WHEN abs(stake - simple) < 1e-12 THEN 0 ELSE stake - simple END * 100, 6) AS loop_pct FROM rows")
def owner_rows(spark, sf_dir):
    """Every ultimate owner of every company: integrated stake, simple chains, what loops add, and whether both are of one family."""
    nodes, e = network(spark, sf_dir)
    simple = net.ultimate_owners(net.chains(nodes, e, 0.0))
    return report.owner_rows(nodes, e, simple, net.integrated(e), net.families(nodes, e))


MATRIX = STRONG + """, inner_edges AS MATERIALIZED (SELECT s.component, e.holder, e.held, e.stake FROM edges e JOIN strong s ON s.node = e.holder JOIN strong t ON t.node = e.held AND t.component = s.component)"""


@query(MATRIX + "SELECT component, holder, held, round(stake * 100, 6) AS stake_pct FROM inner_edges")
def group_matrix(spark, sf_dir):
    """The stakes inside each circular group, as entries of its matrix."""
    e = network(spark, sf_dir)[1]
    return matrices.group_matrix(e, net.strong_components(e)).select("component", "holder", "held", net.fixed(F.col("stake") * 100, 6).alias("stake_pct"))


@query(MATRIX + """, power AS (SELECT component, node AS holder, node AS held, CAST(1 AS DOUBLE) AS x FROM strong
  UNION ALL SELECT p.component, p.holder, e.held, p.x * e.stake FROM power p JOIN inner_edges e ON e.component = p.component AND e.holder = p.held WHERE p.x * e.stake >= 1e-16)
SELECT component, holder, held, round(sum(x), 8) AS total FROM power GROUP BY component, holder, held""")
def walk_sums(spark, sf_dir):
    """The sum of all walks inside each circular group, I + A + A A + ..., as entries."""
    e = network(spark, sf_dir)[1]
    inner = matrices.group_matrix(e, net.strong_components(e))
    return matrices.walk_sum(inner).select("component", "holder", "held", r8("total").alias("total"))


@query(CHAINS + """, ends AS (SELECT company, nodes FROM chain WHERE end_reason IN ('no_recorded_owner', 'natural_person')),
kept AS (SELECT unnest(list_transform(range(1, len(nodes) + 1), lambda n: array_to_string(list_reverse(nodes)[1:n], '>'))) AS prefix FROM ends)
SELECT (SELECT count(*) FROM ends) AS chains, (SELECT CAST(sum(len(nodes)) AS BIGINT) FROM ends) AS entries, (SELECT count(DISTINCT prefix) FROM kept) AS tree_nodes, round(1 - (SELECT count(DISTINCT prefix) FROM kept) / (SELECT sum(len(nodes)) FROM ends), 6) AS saved""")
def forest_saving(spark, sf_dir):
    """What sharing prefixes from the owner down saves: nodes of the trees against entries of the chains."""
    found = net.chains(*network(spark, sf_dir)).filter(F.col("end_reason").isin(*net.OWNER_ENDS))
    down = F.reverse("path")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.array_join(F.slice(down, F.lit(1), n), ">"))
    found = cut(found.select(F.size("path").cast("long").alias("size"), prefixes.alias("prefixes")))
    total = found.agg(F.count("*").alias("chains"), F.sum("size").alias("entries"))
    own = found.select(F.explode("prefixes").alias("prefix")).agg(F.countDistinct("prefix").alias("tree_nodes"))
    return total.join(own).select("chains", "entries", "tree_nodes", F.round(1 - F.col("tree_nodes") / F.col("entries"), 6).alias("saved"))


@query(o.ctes(o.BASE, o.LEVELS) + "SELECT entity AS owner, count(*) AS companies, row_number() OVER (ORDER BY count(*) DESC, entity) AS place FROM levels WHERE level > 0 AND entity NOT IN (SELECT held FROM owned) GROUP BY entity QUALIFY place <= 20")
def roots_by_reach(spark, sf_dir):
    """The twenty entities without an owner that reach most companies (a top-k report)."""
    e = network(spark, sf_dir)[1]
    reach = net.levels(e).filter("level > 0").withColumnRenamed("entity", "owner").join(e.select(F.col("held").alias("owner")).distinct(), "owner", "left_anti")
    top = reach.groupBy("owner").agg(F.count("*").alias("companies")).orderBy(F.desc("companies"), "owner").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("companies"), "owner")))  # twenty rows


@query(CHAINS + "SELECT company, string_agg(label || ':' || n, ', ' ORDER BY label) AS ends FROM (SELECT company, CASE end_reason WHEN 'natural_person' THEN 'natural person' WHEN 'no_recorded_owner' THEN 'no recorded owner' WHEN 'below_threshold' THEN 'below threshold' ELSE end_reason END AS label, count(*) AS n FROM chain GROUP BY company, label) GROUP BY company")
def end_histogram(spark, sf_dir):
    """How each company's chains end, as a map of labels to counts."""
    return report.end_histogram(net.chains(*network(spark, sf_dir))).select("company", F.array_join(F.transform(F.array_sort(F.map_entries("ends")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ", ").alias("ends"))


@query(METRICS + "SELECT coalesce(family, 'none') AS family, controller, count(*) AS companies FROM metrics WHERE controller IS NOT NULL GROUP BY ALL")
def controller_histogram(spark, sf_dir):
    """How many companies of a family each controller controls."""
    nodes, e = network(spark, sf_dir)
    simple = net.ultimate_owners(net.chains(nodes, e, 0.0))
    metrics = net.company_metrics(nodes, e, simple, cut(net.integrated(e)), net.families(nodes, e))
    return metrics.filter("controller is not null").groupBy(F.coalesce("family", F.lit("none")).alias("family"), "controller").agg(F.count("*").alias("companies"))


@query(STRONG + """, sides AS (SELECT e.holder, e.held FROM edges e JOIN strong s ON s.node = e.holder JOIN strong t ON t.node = e.held AND t.component = s.component WHERE s.component = (SELECT min(component) FROM strong))
SELECT holder, held, true AS circular FROM sides UNION ALL SELECT e.holder, e.held, false FROM edges e WHERE (e.holder IN (SELECT node FROM strong WHERE component = (SELECT min(component) FROM strong))) <> (e.held IN (SELECT node FROM strong WHERE component = (SELECT min(component) FROM strong)))""")
def group_subgraph(spark, sf_dir):
    """The circular group with the smallest name and what borders on it."""
    e = network(spark, sf_dir)[1]
    group = cut(net.strong_components(e))
    first = group.agg(F.min("component").alias("component"))
    return report.group_subgraph(e, group.join(F.broadcast(first), "component").select("node"))


@query()
def example_cycles(spark, sf_dir):
    """Up to five back edges' cycles of each circular group, the strongest first: which edges are back edges depends on the search."""
    e = network(spark, sf_dir)[1]
    return cycles.example_cycles(e, net.strong_components(e))
