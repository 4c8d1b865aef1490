"""Registered queries on the way from filings to the network: which rows count, who is meant, what is built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stakeweave.functions import names
from stakeweave.operators import build, evaluate, ingest, resolve
from stakeweave.sources import derived, filings

from . import network as net
from . import oracles as o
from .catalogue import query
from .iterate import cut

NAMED = o.ctes(o.BASE, o.NAMES)

# which rows count

REGISTER = NAMED + """,
register AS (SELECT line, CASE WHEN line % 3 = 0 THEN replace(holder_name, ' ', '   ') ELSE holder_name END AS holder, held_name AS held, CASE WHEN line % 11 = 0 THEN 0 ELSE stake_bp END AS shares, role, filed_type, CASE WHEN line % 13 = 0 THEN 'Any Other (Specify)' END AS kind FROM frel
  UNION ALL SELECT line + 1000000000000, upper(holder_name), held_name, stake_bp, role, filed_type, NULL FROM frel),
told_rows AS (SELECT *, regexp_replace(trim(holder), ' +', ' ', 'g') AS name, CASE WHEN shares <= 0 THEN 'no_shares' WHEN kind IS NOT NULL THEN 'any_other' ELSE 'kept' END AS why FROM register),
verdicts AS (SELECT *, CASE WHEN why = 'kept' AND row_number() OVER (PARTITION BY lower(name), lower(held), role, why ORDER BY line) > 1 THEN 'duplicate' ELSE why END AS verdict FROM told_rows)
"""


def _register(spark, sf_dir) -> DataFrame:
    """The derived relations as rows of a register, once more in capitals behind them."""
    rows = derived.filed_relations(spark, sf_dir).withColumn("shares", F.round(F.col("stake") * 100).cast("long"))
    line = F.col("line")
    holder = F.when(line % 3 == 0, F.replace("holder_name", F.lit(" "), F.lit("   "))).otherwise(F.col("holder_name"))
    code = F.when(F.col("entity_type") == "individual", "A1a").otherwise("B")
    once = rows.select("line", holder.alias("holder"), F.col("held_name").alias("held"), F.when(line % 11 == 0, 0).otherwise(F.col("shares")).alias("shares"), F.col("holder_role").alias("role"), code.alias("code"), F.when(line % 13 == 0, "Any Other (Specify)").alias("kind"))
    again = rows.select((line + 1_000_000_000_000).alias("line"), F.upper("holder_name").alias("holder"), F.col("held_name").alias("held"), "shares", F.col("holder_role").alias("role"), code.alias("code"), F.lit(None).cast("string").alias("kind"))
    return once.unionByName(again)


@query(REGISTER + "SELECT line, name AS holder, held, role, filed_type AS entity_type FROM verdicts WHERE verdict = 'kept'")
def dedupe_first(spark, sf_dir):
    return filings.cleaned(_register(spark, sf_dir), role=None).select("line", "holder", "held", "role", "entity_type")


@query(REGISTER + "SELECT verdict, role, count(*) AS rows FROM verdicts GROUP BY verdict, role")
def build_counters(spark, sf_dir):
    return filings.counters(_register(spark, sf_dir), role=None)


@query("""WITH q AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS quarter FROM orders)
SELECT o_custkey, o_orderkey, quarter FROM (SELECT *, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN quarter END) OVER (PARTITION BY o_custkey), max(quarter) OVER (PARTITION BY o_custkey)) AS newest FROM q) WHERE quarter = newest""")
def latest_filing(spark, sf_dir):
    """Orders stand for filings: those of each customer's latest quarter with a finished one, else of the latest quarter."""
    rows = derived.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long").alias("quarter"))
    return filings.latest(rows, "o_custkey", "quarter", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "quarter")


@query(NAMED + """, hit AS (SELECT held_name AS held, min(CASE WHEN contains(lower(holder_name), 'small') THEN 0 WHEN contains(lower(holder_name), 'red') THEN 1 WHEN contains(lower(holder_name), 'hot') THEN 2 END) AS anchor FROM frel GROUP BY held_name)
SELECT line, held, ['small', 'red', 'hot'][anchor + 1] AS "group" FROM hit JOIN frel ON held_name = held WHERE anchor IS NOT NULL""")
def scope_filter(spark, sf_dir):
    rows = derived.filed_relations(spark, sf_dir).select("line", F.col("holder_name").alias("holder"), F.col("held_name").alias("held"))
    return filings.in_scope(rows, ["small", "red", "hot"]).select("line", "held", "group")


@query(NAMED + """SELECT held_name AS held, arg_max(lower(string_split(holder_name, ' ')[1]), line) AS "group" FROM frel GROUP BY held_name""")
def company_groups(spark, sf_dir):
    rows = derived.filed_relations(spark, sf_dir).select("line", F.col("held_name").alias("held"), F.lower(F.split("holder_name", " ")[0]).alias("group"))
    return filings.group_of(rows)


CELLS = """
shown AS (SELECT holder, held, outcome, message, CASE k WHEN 0 THEN '' WHEN 1 THEN '-- $ --' WHEN 2 THEN holder || chr(7) WHEN 3 THEN upper(held) || ' LIMITED' ELSE holder || ' Pvt Ltd' END AS holder_name, held || ' Ltd.' AS held_name, CASE k WHEN 12 THEN 'company' ELSE 'corporate' END AS kind
  FROM (SELECT *, (CAST(holder[2:] AS BIGINT) * 7 + CAST(held[2:] AS BIGINT)) % 26 AS k FROM judged))"""


@query(o.ctes(o.BASE, o.ROWS, CELLS) + f"SELECT outcome, message, count(*) AS n, count(DISTINCT holder_name) AS holders, count(DISTINCT {o.normal('holder_name')}) AS holder_norms, count(DISTINCT {o.normal('held_name')}) AS held_norms FROM shown GROUP BY outcome, message")
def ingest_summary(spark, sf_dir):
    return ingest.summary(ingest.validated(derived.filed_rows(spark, sf_dir))).withColumnRenamed("rows", "n")


@query(o.ctes(o.BASE, o.ROWS, CELLS) + f"SELECT kind AS entity_type, count(*) AS n, count(DISTINCT {o.normal('holder_name')}) AS holder_norms, count(DISTINCT {o.normal('held_name')}) AS held_norms FROM shown WHERE outcome = 'loaded' GROUP BY kind")
def loaded_types(spark, sf_dir):
    return ingest.by_type(ingest.validated(derived.filed_rows(spark, sf_dir))).withColumnRenamed("rows", "n")


# who is meant

RESOLVED = o.ctes(o.BASE, o.NAMES, o.RESOLVED, o.ENTITIES)


def _resolved(spark, sf_dir):
    obs = resolve.observations(derived.filed_names(spark, sf_dir))
    roots, log = resolve.merged(obs, cut(resolve.merge_candidates(obs)))
    return obs, roots, log


@query(RESOLVED + "SELECT entity_id, name, etype AS entity_type, array_to_string(variants, '|') AS variants, keys, CAST(NULL AS VARCHAR) AS cin, listed FROM ent")
def resolve_entities(spark, sf_dir):
    obs, roots, _ = _resolved(spark, sf_dir)
    found = resolve.entities(obs, roots)
    return found.select("entity_id", "name", "entity_type", F.array_join("variants", "|").alias("variants"), F.array_join("keys", "|").alias("keys"), "cin", "listed")


@query()
def merge_log(spark, sf_dir):
    """Which union of the ordered replay was made by which step: the order of unions is no SQL."""
    return _resolved(spark, sf_dir)[2]


ASKED = "smal ring"


@query(RESOLVED + f""", ek AS (SELECT entity_id, etype, unnest(string_split(keys, '|')) AS key FROM ent),
near AS (SELECT *, least(levenshtein('{ASKED}', key), list_min(list_transform(range(len(key) + 1), lambda n: levenshtein('{ASKED}', key[1:n])))) AS away FROM ek),
tiers AS (SELECT *, CASE WHEN key = '{ASKED}' THEN 0 WHEN starts_with(key, '{ASKED}') THEN 1 WHEN away <= greatest(1, {len(ASKED)} // 5) THEN 2 END AS tier FROM near),
ordered AS (SELECT entity_id, etype AS entity_type, key, tier, CASE WHEN tier = 2 THEN away ELSE 0 END AS distance, CASE WHEN tier < 2 THEN etype END AS kind, CASE WHEN tier = 2 THEN len(key) ELSE 0 END AS size FROM tiers WHERE tier IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tier, kind NULLS FIRST, distance, size, key) AS own FROM ordered)
SELECT entity_id, entity_type, key, CAST(tier AS INTEGER) AS tier, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (ORDER BY tier, kind NULLS FIRST, distance, size, key) AS place FROM firsts WHERE own = 1) WHERE place <= 5""")
def lookup(spark, sf_dir):
    obs, roots, _ = _resolved(spark, sf_dir)
    keys = resolve.entities(obs, roots).select("entity_id", "entity_type", F.explode("keys").alias("key"))
    return resolve.lookup(keys, ASKED)


@query(o.ctes(o.BASE, o.NAMES, o.RESOLVED) + "SELECT raw, filed_type, etype AS entity_type, key, root FROM resolved")
def resolved_names(spark, sf_dir):
    obs, roots, _ = _resolved(spark, sf_dir)
    return obs.select("raw", "filed_type", "entity_type", "key").join(roots, ["entity_type", "key"])


@query(o.ctes(o.BASE, o.NAMES, o.RESOLVED) + "SELECT etype AS entity_type, count(*) AS variants, count(DISTINCT key) AS keys, count(DISTINCT root) AS entities FROM resolved GROUP BY etype")
def resolution_stats(spark, sf_dir):
    return resolved_names(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("variants"), F.countDistinct("key").alias("keys"), F.countDistinct("root").alias("entities"))


@query(RESOLVED + "SELECT etype AS entity_type, CAST(sum(n) AS BIGINT) AS variants, count(*) AS entities, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT etype, len(variants) AS n FROM ent) GROUP BY etype")
def entity_pairs(spark, sf_dir):
    """Pairs of names that resolution made one."""
    obs, roots, _ = _resolved(spark, sf_dir)
    size = resolve.entities(obs, roots).select("entity_type", F.size("variants").cast("long").alias("n"))
    return size.groupBy("entity_type").agg(F.sum("n").alias("variants"), F.count("*").alias("entities"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


@query(NAMED + f", told AS (SELECT DISTINCT raw FROM filed) SELECT CASE WHEN contains(raw, ', Trustee of ') THEN 'trustee_of' ELSE 'as_filed' END AS rule, count(*) AS names, count(DISTINCT {o.key('raw')}) AS keys FROM told GROUP BY 1")
def capacity_rules(spark, sf_dir):
    rows = derived.filed_names(spark, sf_dir).select("raw").distinct()
    return names.with_entity(rows, "raw").select(F.col("held_as.rule").alias("rule"), names.match_key(F.col("raw")).alias("key")).groupBy("rule").agg(F.count("*").alias("names"), F.countDistinct("key").alias("keys"))


# One capacity phrase of each rule and more, put behind or before a derived name.
PHRASES = {
    "behalf_of trust": ("{0} on behalf of {1} Trust", "{1} Trust"), "behalf_of firm": ("{0}, on behalf of the firm {1}", "{1}"), "partner_of": ("{0} (in the capacity of partner of {1})", "{1}"),
    "karta_of": ("{0} - karta of {1} HUF", "{1} HUF"), "trustee_of": ("{0}, trustee of {1} Trust", "{1} Trust"), "huf": ("{1} HUF rep. by {0}", "{1} HUF"), "karta_capacity": ("{1} (as karta of the HUF)", "{1} HUF"),
    "as_filed note": ("{1} (through various schemes)", "{1}"), "as_filed tail": ("{1} - holds jointly", "{1}"), "as_filed bracket": ("{1} (Northern Branch)", "{1} (Northern Branch)"),
}
SPOKEN = " UNION ALL ".join(
    "SELECT p_partkey AS key, '{rule}' AS rule, {raw} AS raw, {name} AS name FROM part".format(rule=rule.split(" ")[0], **{n: "'" + t.replace("{0}", "' || p_brand || ' Person' || '").replace("{1}", "' || p_name || '") + "'" for n, t in (("raw", raw), ("name", name))})
    for rule, (raw, name) in PHRASES.items()
)


@query(f"SELECT key, rule, raw, name FROM ({SPOKEN})")
def capacity_phrases(spark, sf_dir):
    """All seven rules, and notes that are dropped or kept, on names made from the part table."""
    part = derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat("p_brand", F.lit(" Person")).alias("person"), "p_name")
    spoken = F.array(*[F.replace(F.replace(F.lit(raw), F.lit("{0}"), F.col("person")), F.lit("{1}"), F.col("p_name")) for raw, _ in PHRASES.values()])
    rows = names.with_entity(part.select("key", F.explode(spoken).alias("raw")), "raw")
    return rows.select("key", F.col("held_as.rule").alias("rule"), "raw", F.col("held_as.name").alias("name"))


PAIRED = NAMED + f""", p AS (SELECT a.raw AS a, b.raw AS b, CAST(regexp_extract(a.raw, '[0-9]+') AS BIGINT) AS x, CAST(regexp_extract(b.raw, '[0-9]+') AS BIGINT) AS y FROM raws a JOIN raws b ON a.raw < b.raw AND CAST(regexp_extract(a.raw, '[0-9]+') AS BIGINT) // 4 = CAST(regexp_extract(b.raw, '[0-9]+') AS BIGINT) // 4),
j AS (SELECT x = y AS truth, {o.key('a')} = {o.key('b')} AS found FROM p),
c AS (SELECT count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (truth AND NOT found) AS fn, count(*) FILTER (NOT truth AND NOT found) AS tn FROM j)"""


@query(PAIRED + "SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS \"precision\", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2.0 * tp + fp + fn), 6) AS f1 FROM c")
def er_scores(spark, sf_dir):
    """Names with neighbouring numbers; those with the same number are one entity, and found where their match keys agree."""
    rows = derived.filed_names(spark, sf_dir).select("raw").distinct().select("raw", F.regexp_extract("raw", "[0-9]+", 0).cast("long").alias("n"), names.match_key(F.col("raw")).alias("key"))
    rows = cut(rows.withColumn("block", F.floor(F.col("n") / 4)))
    pairs = rows.select(*[F.col(c).alias(f"{c}_a") for c in ("raw", "n", "key")], "block").join(rows.select(*[F.col(c).alias(f"{c}_b") for c in ("raw", "n", "key")], "block"), "block").filter("raw_a < raw_b")
    out = evaluate.scores(pairs.select((F.col("n_a") == F.col("n_b")).alias("truth"), (F.col("key_a") == F.col("key_b")).alias("found")))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


SWEEP = """
pairs AS (SELECT a.key AS a, b.key AS b, string_split(a.key, ' ') AS x, string_split(b.key, ' ') AS y FROM keyed a JOIN keyed b ON starts_with(b.key, a.key[1:3]) AND a.key < b.key),
words AS (SELECT a, b, x, x[i] AS p, y[i] AS q FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM pairs WHERE len(x) = len(y))),
judged AS (SELECT a, b, count(*) FILTER (p <> q) AS differing, len(x) AS n, min(CASE WHEN p = q THEN 1 WHEN least(len(p), len(q)) > 3 AND NOT regexp_matches(p || q, '[0-9]') THEN 1 - levenshtein(p, q) / greatest(len(p), len(q)) ELSE -1 END) AS least FROM words GROUP BY a, b, x),
t AS (SELECT unnest([0.6, 0.7, 0.8, 0.9]) AS threshold)"""


@query(o.ctes(o.BASE, o.NAMES, SWEEP) + "SELECT CAST(threshold AS DOUBLE) AS threshold, (SELECT count(*) FROM pairs p LEFT JOIN judged j USING (a, b) WHERE replace(p.a, ' ', '') = replace(p.b, ' ', '') OR 2 * differing <= n AND least >= threshold) AS matches FROM t")
def threshold_sweep(spark, sf_dir):
    keys = derived.filed_names(spark, sf_dir).select(names.match_key(F.col("raw")).alias("key"), F.lit("x").alias("entity_type")).distinct()
    # what matches at a threshold does at the lowest
    return evaluate.threshold_sweep(resolve.fuzzy_pairs(cut(keys), min(evaluate.THRESHOLDS)).select("a", "b"))


@query()
def er_ablations(spark, sf_dir):
    """Entities and scores with the steps of resolution added one by one: each a resolution of its own."""
    rows = cut(derived.filed_names(spark, sf_dir))
    raws = rows.select("raw", "filed_type").distinct().withColumn("n", F.regexp_extract("raw", "[0-9]+", 0)).filter("NOT contains(raw, 'Trustee')")
    pairs = raws.select(F.col("raw").alias("a"), F.col("filed_type"), "n").join(raws.select(F.col("raw").alias("b"), "filed_type", F.col("n").alias("m")), "filed_type").filter("a < b AND n = m").select("a", "b", "filed_type", F.lit(True).alias("truth"))
    return evaluate.ablations(rows, pairs)


BANDED = NAMED + """, tok AS (SELECT DISTINCT key, unnest(string_split(key, ' ')) AS token FROM keyed), rare AS (SELECT token FROM tok WHERE len(token) >= 3 GROUP BY token HAVING count(*) <= 10),
pool AS (SELECT a, b, least(3, CAST(floor(4 * j) AS INTEGER)) AS band FROM (SELECT DISTINCT s.key AS a, t.key AS b, len(list_intersect(list_distinct(string_split(s.key, ' ')), list_distinct(string_split(t.key, ' ')))) / len(list_distinct(list_concat(string_split(s.key, ' '), string_split(t.key, ' ')))) AS j
  FROM tok s JOIN rare USING (token) JOIN tok t ON t.token = s.token AND s.key < t.key))"""


@query(BANDED + "SELECT a, b, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('7' || a || '|' || b), a, b) AS place FROM pool) WHERE place <= 25")
def stratified_sample(spark, sf_dir):
    """25 pairs of each band of Jaccard similarity, drawn by hash: what a person is to label."""
    keys = cut(derived.filed_names(spark, sf_dir).select(names.match_key(F.col("raw")).alias("key")).distinct())
    return evaluate.stratified_sample(evaluate.candidate_pool(keys), 25, 7)


# what is built

BUILT = o.ctes(o.BASE, o.NAMES, o.RESOLVED, o.ENTITIES, o.BUILT)


def _built(spark, sf_dir) -> build.Network:
    return build.network(derived.filed_relations(spark, sf_dir))


@query(BUILT + "SELECT holder_id AS holder, held_id AS held, round(sum(stake_bp) / 10000, 9) AS stake, CASE WHEN bool_or(role IN ('Promoter', 'Promoter Group')) THEN 'Promoter' ELSE max(role) END AS role, count(*) AS records FROM told_edges WHERE holder_id <> held_id GROUP BY holder_id, held_id")
def resolved_edges(spark, sf_dir):
    return _built(spark, sf_dir).edges.select("holder", "held", net.fixed("stake", 9).alias("stake"), "role", "records")


@query(BUILT + "SELECT line, 'self_ownership_resolved' AS kind, concat_ws(' ', holder_name, 'and', held_name, 'are one entity', holder_id) AS message FROM told_edges WHERE holder_id = held_id")
def resolved_issues(spark, sf_dir):
    return _built(spark, sf_dir).issues


@query(BUILT + "SELECT entity_id AS id, name, etype AS entity_type, listed, CASE WHEN listed THEN 'listed' ELSE etype END AS kind FROM ent")
def resolved_nodes(spark, sf_dir):
    nodes = _built(spark, sf_dir).nodes
    return nodes.select("*", names.kind(F.col("listed"), F.col("entity_type")).alias("kind"))


@query(BUILT + """, merged AS (SELECT holder_id AS holder, held_id AS held, sum(stake_bp) / 10000 AS stake FROM told_edges WHERE holder_id <> held_id GROUP BY ALL)
SELECT m.held, t.name, m.holder, round(m.stake, 9) AS stake, row_number() OVER (PARTITION BY m.held ORDER BY round(m.stake, 9) DESC, m.holder) AS rank FROM merged m JOIN ent t ON t.entity_id = m.held""")
def resolved_owners(spark, sf_dir):
    """Owners of every entity of the built network, largest first."""
    built = _built(spark, sf_dir)
    e = built.edges.withColumn("stake", net.fixed("stake", 9))
    rank = F.row_number().over(Window.partitionBy("held").orderBy(F.desc("stake"), "holder"))
    return e.join(built.nodes.select(F.col("id").alias("held"), "name"), "held").select("held", "name", "holder", "stake", rank.alias("rank"))
