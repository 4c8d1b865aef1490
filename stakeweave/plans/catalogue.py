"""The registered queries of the engine and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stakeweave.functions import names
from stakeweave.operators import evaluate, ingest, resolve
from stakeweave.sources import derived, synthetic

from . import cycles
from . import network as net
from . import oracles as o
from . import report
from .iterate import cut, placed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = o.ctes(o.BASE)


def query(sql: str | None = None):
    """Register a function as a query, with the SQL that it is checked against."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            # ties as in network.fixed
            ORACLES[f.__name__] = re.sub(r"round\(((?:[^()]|\([^()]*\))+), ([89])\)", r"round(\1 + 1e-13, \2)", re.sub(r" \* 100, ([56])\)", r" * 100 + 1e-11, \1)", sql))
        return f

    return put


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The derived network, its edges cut: they are small beside lineitem and every walk step reads them."""
    nodes, edges = derived.network(spark, sf_dir)
    return nodes, cut(edges)


def r9(c):
    return net.fixed(c, 9)


def r8(c):
    return net.fixed(c, 8)


@query(R + "SELECT holder, held, round(stake, 9) AS stake, role FROM edges")
def edges(spark, sf_dir):
    return derived.network(spark, sf_dir)[1].select("holder", "held", r9("stake").alias("stake"), "role")


@query(R + "SELECT held, holder, round(stake, 9) AS stake, row_number() OVER (PARTITION BY held ORDER BY round(stake, 9) DESC, holder) AS rank FROM edges")
def owners_ranked(spark, sf_dir):
    e = derived.network(spark, sf_dir)[1].withColumn("stake", r9("stake"))
    return e.select("held", "holder", "stake", F.row_number().over(Window.partitionBy("held").orderBy(F.desc("stake"), "holder")).alias("rank"))


CHAINS = o.ctes(o.BASE, o.walks())


@query(CHAINS + "SELECT company, path, round(effective, 9) AS effective, layers, terminal, end_reason FROM chain")
def chains(spark, sf_dir):
    return net.chains(*network(spark, sf_dir)).select("company", F.concat_ws(">", "path").alias("path"), r9("effective").alias("effective"), F.col("layers").cast("long").alias("layers"), "terminal", "end_reason")


@query(o.ctes(o.BASE, o.walks("0")) + "SELECT company, path, round(effective, 9) AS effective, layers, terminal, end_reason FROM chain")
def chains_unthresholded(spark, sf_dir):
    return net.chains(*network(spark, sf_dir), least=0.0).select("company", F.concat_ws(">", "path").alias("path"), r9("effective").alias("effective"), F.col("layers").cast("long").alias("layers"), "terminal", "end_reason")


@query(CHAINS + "SELECT company, path, row_number() OVER (PARTITION BY company ORDER BY round(effective, 9) DESC, layers, path) AS rank FROM chain")
def chains_ranked(spark, sf_dir):
    return net.ranked_chains(net.chains(*network(spark, sf_dir))).select("company", F.concat_ws(">", "path").alias("path"), "rank")


@query(CHAINS + "SELECT company, terminal, path, rank, printf('%.2f%%', effective * 100) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY round(effective, 9) DESC, layers, path) AS rank FROM chain) WHERE rank <= 3")
def top_chains(spark, sf_dir):
    found = net.ranked_chains(net.chains(*network(spark, sf_dir))).filter("rank <= 3")
    return found.select("company", "terminal", F.concat_ws(">", "path").alias("path"), "rank", F.format_string("%.2f%%", F.col("effective") * 100).alias("shown"))


@query(CHAINS + "SELECT company, count(*) FILTER (end_reason = 'circular') AS circular, count(*) FILTER (end_reason = 'natural_person') AS persons, count(*) FILTER (end_reason = 'no_recorded_owner') AS open, count(*) FILTER (end_reason = 'below_threshold') AS small, max(layers) AS deepest FROM chain GROUP BY company")
def chain_end_counts(spark, sf_dir):
    n = lambda r: F.count_if(F.col("end_reason") == r)
    return net.chains(*network(spark, sf_dir)).groupBy("company").agg(n("circular").alias("circular"), n("natural_person").alias("persons"), n("no_recorded_owner").alias("open"), n("below_threshold").alias("small"), F.max("layers").cast("long").alias("deepest"))


@query(CHAINS + "SELECT company, owner, round(total, 8) AS total, routes, row_number() OVER (PARTITION BY company ORDER BY round(total, 8) DESC, owner) AS rank FROM owners")
def ultimate_owners(spark, sf_dir):
    return net.ranked_owners(net.chains(*network(spark, sf_dir))).select("company", "owner", r8("total").alias("total"), "routes", "rank")


@query(CHAINS + "SELECT company, owner, round(total, 8) AS total FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY round(total, 8) DESC, owner) AS rank FROM owners) WHERE rank = 1")
def controller(spark, sf_dir):
    return net.ranked_owners(net.chains(*network(spark, sf_dir))).filter("rank = 1").select("company", "owner", r8("total").alias("total"))


ROUTES = "SELECT company, terminal AS owner, path, layers, row_number() OVER (PARTITION BY company, terminal ORDER BY round(effective, 9) DESC, layers, path) AS rank FROM chain WHERE end_reason IN ('no_recorded_owner', 'natural_person')"


@query(CHAINS + f"SELECT company, owner, path, layers FROM ({ROUTES}) WHERE rank = 1")
def dominant_route(spark, sf_dir):
    found = net.chains(*network(spark, sf_dir)).filter(F.col("end_reason").isin(*net.OWNER_ENDS)).withColumn("path", F.concat_ws(">", "path"))
    rank = F.row_number().over(Window.partitionBy("company", "terminal").orderBy(F.desc(r9("effective")), "layers", "path"))
    return found.withColumn("rank", rank).filter("rank = 1").select("company", F.col("terminal").alias("owner"), "path", F.col("layers").cast("long").alias("layers"))


@query(CHAINS + """SELECT company, path AS chain_ids, round(effective * 100, 6) AS effective_pct, end_reason,
company || string_agg(' <-[' || CASE WHEN stake >= 0.0001 THEN printf('%.2f%%', stake * 100) ELSE printf('%.4f%%', stake * 100) END || ']- ' || holder, '' ORDER BY i) AS chain
FROM (SELECT company, path, effective, end_reason, nodes, unnest(range(1, len(nodes))) AS i FROM chain) c JOIN edges e ON e.held = c.nodes[i] AND e.holder = c.nodes[i + 1] GROUP BY company, path, effective, end_reason""")
def chain_report(spark, sf_dir):
    return report.chain_report(*network(spark, sf_dir)).select("company", "chain_ids", "effective_pct", "end_reason", "chain")


LEVELS = o.ctes(o.BASE, o.LEVELS)


@query(LEVELS + "SELECT company, entity, level FROM levels")
def bfs_levels(spark, sf_dir):
    return net.levels(network(spark, sf_dir)[1])


@query(LEVELS + "SELECT company, count(*) - 1 AS reachable, max(level) AS depth FROM levels GROUP BY company")
def reachable(spark, sf_dir):
    return net.levels(network(spark, sf_dir)[1]).groupBy("company").agg((F.count("*") - 1).alias("reachable"), F.max("level").alias("depth"))


@query(LEVELS + "SELECT depth, count(*) AS companies FROM (SELECT company, max(level) AS depth FROM levels GROUP BY company) GROUP BY depth")
def depth_distribution(spark, sf_dir):
    return reachable(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("companies"))


@query(R + "SELECT id FROM nodes WHERE id NOT IN (SELECT held FROM owned)")
def no_recorded_owner(spark, sf_dir):
    nodes, e = derived.network(spark, sf_dir)
    return nodes.join(e.select(F.col("held").alias("id")).distinct(), "id", "left_anti").select("id")


@query(R + "SELECT DISTINCT holder FROM edges WHERE holder IN (SELECT held FROM owned)")
def holder_is_held(spark, sf_dir):
    e = derived.network(spark, sf_dir)[1]
    return e.select("holder").intersect(e.select("held"))


@query(R + "SELECT holder AS name FROM edges UNION SELECT held FROM edges")
def entities_named(spark, sf_dir):
    e = derived.network(spark, sf_dir)[1]
    return e.select(F.col("holder").alias("name")).union(e.select("held")).distinct()


@query(o.ctes(o.BASE, o.components("comp", "true")) + "SELECT node, component FROM comp")
def components(spark, sf_dir):
    return net.components(*network(spark, sf_dir))


@query(o.ctes(o.BASE, o.components("comp", "stake > 0.05")) + "SELECT node, component FROM comp")
def components_filtered(spark, sf_dir):
    return net.components(*network(spark, sf_dir), F.col("stake") > 0.05)


@query(o.ctes(o.BASE, o.FAMILIES) + "SELECT node, family, size FROM families")
def families(spark, sf_dir):
    return net.families(*network(spark, sf_dir))


STRONG = o.ctes(o.BASE, o.STRONG)


@query(STRONG + "SELECT node, component FROM strong")
def strong_components(spark, sf_dir):
    return net.strong_components(network(spark, sf_dir)[1])


def _internal(e: DataFrame) -> DataFrame:
    group = cut(net.strong_components(e))
    return e.join(group.toDF("holder", "component"), "holder").join(group.toDF("held", "component"), ["held", "component"])


INTERNAL = "SELECT e.holder, e.held, s.component, round(e.stake, 9) AS stake, row_number() OVER (PARTITION BY s.component ORDER BY round(e.stake, 9) DESC, e.holder, e.held) AS rank FROM edges e JOIN strong s ON s.node = e.holder JOIN strong t ON t.node = e.held AND t.component = s.component"


@query(STRONG + f"SELECT holder, held, component, stake FROM ({INTERNAL})")
def internal_edges(spark, sf_dir):
    return _internal(network(spark, sf_dir)[1]).select("holder", "held", "component", r9("stake").alias("stake"))


@query(STRONG + f"SELECT * FROM ({INTERNAL}) WHERE rank <= 5")
def strongest_edges(spark, sf_dir):
    own = internal_edges(spark, sf_dir)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("stake"), "holder", "held"))).filter("rank <= 5")


@query(R + "SELECT x.holder AS a, x.held AS b, round(x.stake * y.stake, 9) AS loop_stake FROM edges x JOIN edges y ON x.holder = y.held AND x.held = y.holder WHERE x.holder < x.held")
def mutual_holdings(spark, sf_dir):
    e = derived.network(spark, sf_dir)[1]
    back = e.select(F.col("holder").alias("held"), F.col("held").alias("holder"), F.col("stake").alias("other"))
    return e.join(back, ["holder", "held"]).filter("holder < held").select(F.col("holder").alias("a"), F.col("held").alias("b"), r9(F.col("stake") * F.col("other")).alias("loop_stake"))


STAKES = o.ctes(o.BASE, o.STAKES)


@query(STAKES + "SELECT company, owner, round(stake, 8) AS stake FROM stakes")
def integrated(spark, sf_dir):
    return net.integrated(network(spark, sf_dir)[1]).select("company", "owner", r8("stake").alias("stake"))


@query(STAKES + "SELECT company, owner, round(stake, 8) AS stake FROM ultimate")
def ultimate_integrated(spark, sf_dir):
    e = network(spark, sf_dir)[1]
    return net.ultimate_integrated(e, net.integrated(e)).select("company", "owner", r8("stake").alias("stake"))


@query(STAKES + "SELECT e.holder AS company, round(sum(e.stake * s.stake), 8) AS self_stake FROM edges e JOIN stakes s ON s.company = e.holder AND s.owner = e.held GROUP BY e.holder")
def self_ownership(spark, sf_dir):
    e = network(spark, sf_dir)[1]
    return net.self_ownership(e, net.integrated(e)).select("company", r8("self_stake").alias("self_stake"))


LOOPS = o.ctes(o.BASE, o.walks("0"), o.STAKES)


@query(LOOPS + "SELECT u.company, u.owner, round(u.stake * 100, 6) AS integrated_pct, round(coalesce(s.total, 0) * 100, 6) AS simple_pct FROM ultimate u LEFT JOIN owners s USING (company, owner)")
def loop_contribution(spark, sf_dir):
    nodes, e = network(spark, sf_dir)
    simple = net.ultimate_owners(net.chains(nodes, e, 0.0)).select("company", "owner", "total")
    own = net.ultimate_integrated(e, net.integrated(e)).join(simple, ["company", "owner"], "left")
    return own.select("company", "owner", net.fixed(F.col("stake") * 100, 6).alias("integrated_pct"), net.fixed(F.coalesce("total", F.lit(0.0)) * 100, 6).alias("simple_pct"))


METRICS = o.ctes(o.BASE, o.walks("0"), o.STAKES, o.FAMILIES, """
placed AS (SELECT u.*, f.family, g.family AS owner_family, row_number() OVER (PARTITION BY u.company ORDER BY round(u.stake, 8) DESC, u.owner) AS place FROM ultimate u LEFT JOIN families f ON f.node = u.company LEFT JOIN families g ON g.node = u.owner),
one AS (SELECT company, count(*) AS owners, sum(stake) AS traced, max(owner) FILTER (place = 1) AS controller, max(stake) FILTER (place = 1) AS top, sum(stake) FILTER (place <= 3) AS top3, sum((stake * 100) ** 2) AS hhi,
  coalesce(sum(stake) FILTER (family IS NOT DISTINCT FROM owner_family), 0) AS own FROM placed GROUP BY company),
selfs AS (SELECT e.holder AS company, sum(e.stake * s.stake) AS self_stake FROM edges e JOIN stakes s ON s.company = e.holder AND s.owner = e.held GROUP BY e.holder),
simple AS (SELECT company, sum(total) AS simple FROM owners GROUP BY company),
metrics AS (SELECT n.id AS company, f.family, coalesce(owners, 0) AS owners, controller, round(coalesce(traced, 0) * 100, 5) AS traced_pct, round(coalesce(top, 0) * 100, 5) AS controller_pct, round(coalesce(top3, 0) * 100, 5) AS top3_pct, round(coalesce(hhi, 0) + 1e-11, 5) AS hhi,
  round(coalesce(own, 0) * 100, 5) AS family_pct, round((coalesce(traced, 0) - coalesce(own, 0)) * 100, 5) AS outside_family_pct, round(CASE WHEN abs(coalesce(self_stake, 0)) < 1e-12 THEN 0 ELSE coalesce(self_stake, 0) END * 100, 5) AS self_ownership_pct,
  round(CASE WHEN abs(coalesce(traced, 0) - coalesce(simple, 0)) < 1e-12 THEN 0 ELSE coalesce(traced, 0) - coalesce(simple, 0) END * 100, 5) AS loop_contribution_pct
  FROM nodes n LEFT JOIN one ON one.company = n.id LEFT JOIN selfs ON selfs.company = n.id LEFT JOIN simple ON simple.company = n.id LEFT JOIN families f ON f.node = n.id WHERE n.listed)""")


@query(METRICS + "SELECT * FROM metrics")
def company_metrics(spark, sf_dir):
    nodes, e = network(spark, sf_dir)
    simple = net.ultimate_owners(net.chains(nodes, e, 0.0))
    return net.company_metrics(nodes, e, simple, cut(net.integrated(e)), net.families(nodes, e))


@query(METRICS + "SELECT coalesce(family, 'none') AS family, count(*) AS companies, round(avg(family_pct), 4) AS mean_pct, round(median(family_pct), 4) AS median_pct, round(min(family_pct), 4) AS min_pct, round(max(family_pct), 4) AS max_pct, count(*) FILTER (family_pct > 50) AS over_50, count(*) FILTER (family_pct BETWEEN 25 AND 50) AS from_25_to_50, count(*) FILTER (family_pct < 25) AS under_25, round(avg(hhi), 2) AS mean_hhi, count(DISTINCT controller) AS controllers FROM metrics GROUP BY ALL")
def family_metrics(spark, sf_dir):
    return net.family_metrics(company_metrics(spark, sf_dir))


@query(CHAINS + "SELECT terminal AS owner, company, round(sum(effective), 8) AS stake FROM chain WHERE end_reason IN ('no_recorded_owner', 'natural_person') GROUP BY ALL")
def portfolio(spark, sf_dir):
    return net.ultimate_owners(net.chains(*network(spark, sf_dir))).select("owner", "company", r8("total").alias("stake"))


@query(CHAINS + "SELECT owner, count(DISTINCT prefix) AS tree_nodes, count(DISTINCT path) AS chains FROM (SELECT terminal AS owner, path, unnest(list_transform(range(1, len(nodes) + 1), lambda n: array_to_string(list_reverse(nodes)[1:n], '>'))) AS prefix FROM chain WHERE end_reason IN ('no_recorded_owner', 'natural_person')) GROUP BY owner")
def forest_nodes(spark, sf_dir):
    found = net.chains(*network(spark, sf_dir)).filter(F.col("end_reason").isin(*net.OWNER_ENDS))
    down = F.reverse("path")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.array_join(F.slice(down, F.lit(1), n), ">")))
    return found.select(F.col("terminal").alias("owner"), F.concat_ws(">", "path").alias("chain"), prefix.alias("prefix")).groupBy("owner").agg(F.countDistinct("prefix").alias("tree_nodes"), F.countDistinct("chain").alias("chains"))


@query(CHAINS + "SELECT DISTINCT company, nodes[i + 1] AS holder, nodes[i] AS held FROM (SELECT company, nodes, unnest(range(1, len(nodes))) AS i FROM chain)")
def company_subgraph(spark, sf_dir):
    step = F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i")
    return net.chains(*network(spark, sf_dir)).select("company", "path", step).select("company", F.element_at("path", F.col("i") + 1).alias("holder"), F.element_at("path", F.col("i")).alias("held")).distinct()


@query(o.ctes(o.BASE, o.STRONG) + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)), 9) AS density, (SELECT count(DISTINCT component) FROM strong) AS circular_groups, (SELECT count(*) FROM strong) AS in_groups, (SELECT count(*) = 0 FROM strong) AS acyclic")
def network_summary(spark, sf_dir):
    nodes, e = network(spark, sf_dir)
    n = nodes.agg(F.count("*").alias("nodes")).join(e.agg(F.count("*").alias("edges")))
    g = net.strong_components(e).agg(F.countDistinct("component").alias("circular_groups"), F.count("*").alias("in_groups"))
    return n.join(g).select("nodes", "edges", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)), 9).alias("density"), "circular_groups", "in_groups", (F.col("in_groups") == 0).alias("acyclic"))


# names

NAMED = o.ctes(o.BASE, o.NAMES)


def _raws(spark, sf_dir):
    return derived.filed_names(spark, sf_dir).select("raw").distinct()


def _keys(spark, sf_dir):
    return cut(_raws(spark, sf_dir).select(names.match_key(F.col("raw")).alias("key")).distinct())


@query(NAMED + f"SELECT raw, {o.normal('raw')} AS norm FROM raws")
def normalise_names(spark, sf_dir):
    return _raws(spark, sf_dir).select("raw", names.normalised(F.col("raw")).alias("norm"))


@query(NAMED + f"SELECT raw, {o.key('raw')} AS key FROM raws")
def match_keys(spark, sf_dir):
    return _raws(spark, sf_dir).select("raw", names.match_key(F.col("raw")).alias("key"))


@query(NAMED + "SELECT a.key AS a, b.key AS b FROM keyed a JOIN keyed b ON starts_with(b.key, a.key[1:3]) AND a.key < b.key")
def block_pairs(spark, sf_dir):
    return resolve.block_pairs(_keys(spark, sf_dir).withColumn("entity_type", F.lit("x"))).select("a", "b")


@query(NAMED + "SELECT a, b FROM (SELECT a.key AS a, min(b.key) AS b, count(*) AS n FROM keyed a JOIN keyed b ON starts_with(b.key, a.key) AND a.key <> b.key WHERE len(a.key) >= 15 GROUP BY a.key) WHERE n = 1 AND b[len(a) + 1] <> ' '")
def truncation_pairs(spark, sf_dir):
    return resolve.truncation_pairs(_keys(spark, sf_dir).withColumn("entity_type", F.lit("x"))).select("a", "b")


@query(NAMED + "SELECT a.key AS a, b.key AS b, levenshtein(a.key, b.key) AS distance FROM keyed a JOIN keyed b ON a.key <> b.key AND abs(len(a.key) - len(b.key)) <= greatest(1, len(a.key) // 5) WHERE levenshtein(a.key, b.key) <= greatest(1, len(a.key) // 5)")
def near_pairs(spark, sf_dir):
    return resolve.near_pairs(_keys(spark, sf_dir))


TOKENS = """
pairs AS (SELECT a.key AS a, b.key AS b, string_split(a.key, ' ') AS x, string_split(b.key, ' ') AS y FROM keyed a JOIN keyed b ON starts_with(b.key, a.key[1:3]) AND a.key < b.key),
words AS (SELECT a, b, x, y, x[i] AS p, y[i] AS q FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM pairs WHERE len(x) = len(y))),
alike AS (SELECT a, b FROM words GROUP BY a, b, x HAVING bool_and(p = q OR least(len(p), len(q)) > 3 AND NOT regexp_matches(p || q, '[0-9]') AND 1 - levenshtein(p, q) / greatest(len(p), len(q)) >= 0.8) AND 2 * count(*) FILTER (p <> q) <= len(x))"""


@query(o.ctes(o.BASE, o.NAMES, TOKENS) + "SELECT a, b FROM alike UNION SELECT a, b FROM pairs WHERE replace(a, ' ', '') = replace(b, ' ', '')")
def token_match_pairs(spark, sf_dir):
    return resolve.fuzzy_pairs(_keys(spark, sf_dir).withColumn("entity_type", F.lit("x"))).select("a", "b")


@query(NAMED + "SELECT token, count(*) AS df FROM (SELECT DISTINCT key, unnest(string_split(key, ' ')) AS token FROM keyed) GROUP BY token")
def token_df(spark, sf_dir):
    return _keys(spark, sf_dir).select(F.explode(F.array_distinct(F.split("key", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@query(NAMED + """, tok AS (SELECT DISTINCT key, unnest(string_split(key, ' ')) AS token FROM keyed), rare AS (SELECT token FROM tok WHERE len(token) >= 3 GROUP BY token HAVING count(*) <= 10)
SELECT a, b, least(3, CAST(floor(4 * j) AS INTEGER)) AS band FROM (SELECT DISTINCT s.key AS a, t.key AS b, len(list_intersect(list_distinct(string_split(s.key, ' ')), list_distinct(string_split(t.key, ' ')))) / len(list_distinct(list_concat(string_split(s.key, ' '), string_split(t.key, ' ')))) AS j
FROM tok s JOIN rare USING (token) JOIN tok t ON t.token = s.token AND s.key < t.key)""")
def jaccard_bands(spark, sf_dir):
    return evaluate.candidate_pool(_keys(spark, sf_dir))


@query(NAMED + "SELECT key FROM keyed WHERE starts_with(key, 'small')")
def prefix_lookup(spark, sf_dir):
    return _keys(spark, sf_dir).filter(F.startswith("key", F.lit("small")))


@query(NAMED + "SELECT key, list_min(list_transform(range(0, len(key) + 1), lambda n: levenshtein('smal rong', key[1:n]))) AS distance FROM keyed WHERE distance <= 2")
def fuzzy_prefix(spark, sf_dir):
    return _keys(spark, sf_dir).select("key", resolve.prefix_distance(F.lit("smal rong"), F.col("key")).alias("distance")).filter("distance <= 2")


SAME = TOKENS.replace("a.key[1:3]", "a.key[1:1]")


@query(o.ctes(o.BASE, o.NAMES, SAME) + """, met AS (SELECT a, b FROM alike UNION SELECT a, b FROM pairs WHERE replace(a, ' ', '') = replace(b, ' ', '')), w AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS width)
SELECT width, count(*) AS comparisons, count(met.a) AS matches FROM w JOIN keyed a ON true JOIN keyed b ON starts_with(b.key, a.key[1:width]) AND a.key < b.key LEFT JOIN met ON met.a = a.key AND met.b = b.key GROUP BY width""")
def blocking_counts(spark, sf_dir):
    return evaluate.blocking_counts(_keys(spark, sf_dir).withColumn("entity_type", F.lit("x")))


@query()
def back_edges(spark, sf_dir):
    return cycles.back_edges(network(spark, sf_dir)[1])


@query()
def synthetic_network(spark, sf_dir):
    return synthetic.network(spark, derived.table(spark, sf_dir, "customer").count())[1]


@query(CHAINS + "SELECT DISTINCT owner, nodes[i + 1] AS holder, nodes[i] AS held FROM (SELECT terminal AS owner, nodes, unnest(range(1, len(nodes))) AS i FROM chain WHERE end_reason IN ('no_recorded_owner', 'natural_person'))")
def owner_subgraph(spark, sf_dir):
    found = net.chains(*network(spark, sf_dir)).filter(F.col("end_reason").isin(*net.OWNER_ENDS))
    step = F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i")
    return found.select(F.col("terminal").alias("owner"), "path", step).select("owner", F.element_at("path", F.col("i") + 1).alias("holder"), F.element_at("path", F.col("i")).alias("held")).distinct()


# rows


@query(o.ctes(o.BASE, o.ROWS) + "SELECT holder, held, outcome, message FROM judged")
def validate_rows(spark, sf_dir):
    return ingest.validated(derived.filed_rows(spark, sf_dir)).select("holder", "held", "outcome", F.coalesce("message", F.lit("")).alias("message"))


@query(o.ctes(o.BASE, o.NAMES, TOKENS) + "SELECT s.a, s.b FROM (SELECT x.key AS a, y.key AS b FROM keyed x JOIN keyed y ON x.key < y.key AND levenshtein(x.key, y.key) <= greatest(1, len(x.key) // 5)) s EXCEPT SELECT a, b FROM pairs")
def missed_pairs(spark, sf_dir):
    apart = ~F.startswith(F.col("b"), F.substring("a", 1, resolve.BLOCK))
    # the keys of masks that begin with the same letters, as long as a block, all do
    block = F.substring("x", 1, resolve.BLOCK)
    of_masks = (block != F.substring("y", 1, resolve.BLOCK)) | F.contains(block, F.lit("0"))
    return resolve.near_pairs(_keys(spark, sf_dir), (F.col("a") < F.col("b")) & apart, of_masks).select("a", "b")


@query(R + "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT 'S' || s_suppkey AS id FROM supplier)) WHERE (place - 1) % 7 = 0")
def systematic_sample(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "supplier").select(F.format_string("S%d", "s_suppkey").alias("id"))
    return placed(rows, F.col("id")).filter("(place - 1) % 7 = 0").select("id")


@query(R + "SELECT round(regr_slope(ln(n), ln(d)), 6) AS slope, round(regr_r2(ln(n), ln(d)), 6) AS r_squared, round(sum(n * d) / sum(d * d), 6) AS through_origin FROM (SELECT held, count(*) AS n, sum(stake) AS d FROM edges GROUP BY held)")
def loglog_slope(spark, sf_dir):
    per = derived.network(spark, sf_dir)[1].groupBy("held").agg(F.count("*").alias("n"), F.sum("stake").alias("d"))
    return per.agg(F.round(F.regr_slope(F.log("n"), F.log("d")), 6).alias("slope"), F.round(F.regr_r2(F.log("n"), F.log("d")), 6).alias("r_squared"), F.round(F.sum(F.col("n") * F.col("d")) / F.sum(F.col("d") * F.col("d")), 6).alias("through_origin"))
