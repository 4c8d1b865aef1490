"""SQL pieces for DuckDB that state the same questions in other ways (recursive enumeration, plain joins)."""

from __future__ import annotations

BASE = """
q AS (SELECT o_custkey AS holder_id, l_suppkey AS held_id, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY held_id ORDER BY q DESC, holder_id) AS rank FROM q),
c2 AS (SELECT holder_id, held_id, rank, CAST(floor(CAST(5500 * q AS DOUBLE) / CAST(sum(q) OVER (PARTITION BY held_id) AS DOUBLE)) AS BIGINT) AS stake_bp FROM c1 WHERE rank <= 12),
p1 AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
x0 AS (SELECT a.l_suppkey AS holder_id, b.l_suppkey AS held_id, count(*) AS q FROM p1 a JOIN p1 b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey AND b.l_suppkey % 3 = 0 GROUP BY ALL),
x1 AS (SELECT *, row_number() OVER (PARTITION BY held_id ORDER BY q DESC, holder_id) AS rank FROM x0),
x2 AS (SELECT holder_id, held_id, CAST(floor(CAST(3000 * q AS DOUBLE) / CAST(sum(q) OVER (PARTITION BY held_id) AS DOUBLE)) AS BIGINT) AS stake_bp FROM x1 WHERE rank <= 2),
rel AS MATERIALIZED (SELECT holder_id, 'C' || holder_id AS holder, held_id, 'S' || held_id AS held, stake_bp, CASE WHEN rank <= 4 THEN 'Promoter' WHEN rank <= 8 THEN 'Promoter Group' ELSE 'Public (>1%)' END AS role FROM c2
  UNION ALL SELECT holder_id, 'S' || holder_id, held_id, 'S' || held_id, stake_bp, 'Promoter' FROM x2),
edges AS MATERIALIZED (SELECT holder, held, CAST(sum(stake_bp) AS DOUBLE) / 10000 AS stake, min(role) AS role FROM rel GROUP BY ALL),
nodes AS MATERIALIZED (SELECT 'C' || c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'individual' ELSE 'corporate' END AS entity_type, false AS listed FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'corporate', true FROM supplier),
owned AS MATERIALIZED (SELECT DISTINCT held FROM edges)"""


def walks(least: str = "0.0001") -> str:
    return f"""
walk AS (SELECT held AS company, [held] AS path, CAST(1 AS DOUBLE) AS effective, held AS tip, CAST(NULL AS VARCHAR) AS end_reason FROM owned
  UNION ALL SELECT w.company, list_append(w.path, e.holder), w.effective * e.stake, e.holder,
    CASE WHEN list_contains(w.path, e.holder) THEN 'circular' WHEN n.entity_type = 'individual' THEN 'natural_person' WHEN o.held IS NULL THEN 'no_recorded_owner' END
  FROM walk w JOIN edges e ON e.held = w.tip JOIN nodes n ON n.id = e.holder LEFT JOIN owned o ON o.held = e.holder WHERE w.end_reason IS NULL AND w.effective * e.stake >= {least}),
parents AS (SELECT DISTINCT array_to_string(path[1:len(path) - 1], '>') AS path FROM walk WHERE len(path) > 1),
chain AS MATERIALIZED (SELECT company, array_to_string(path, '>') AS path, effective, len(path) - 1 AS layers, tip AS terminal, coalesce(end_reason, 'below_threshold') AS end_reason, path AS nodes FROM walk
  WHERE len(path) > 1 AND (end_reason IS NOT NULL OR NOT EXISTS (SELECT 1 FROM parents p WHERE p.path = array_to_string(walk.path, '>')))),
owners AS MATERIALIZED (SELECT company, terminal AS owner, sum(effective) AS total, count(*) AS routes FROM chain WHERE end_reason IN ('no_recorded_owner', 'natural_person') GROUP BY ALL)"""


STAKES = """
loopwalk AS (SELECT held AS company, held AS tip, CAST(1 AS DOUBLE) AS x, 0 AS n FROM owned
  UNION ALL SELECT w.company, e.holder, w.x * e.stake, w.n + 1 FROM loopwalk w JOIN edges e ON e.held = w.tip WHERE e.holder <> w.company AND w.x * e.stake >= 1e-16),
stakes AS MATERIALIZED (SELECT company, tip AS owner, sum(x) AS stake FROM loopwalk WHERE n > 0 GROUP BY ALL),
ultimate AS MATERIALIZED (SELECT * FROM stakes WHERE owner NOT IN (SELECT held FROM owned))"""

LEVELS = """
step AS (SELECT held AS company, held AS entity, 0 AS level FROM owned UNION SELECT s.company, e.holder, s.level + 1 FROM step s JOIN edges e ON e.held = s.entity WHERE s.level < 25),
levels AS MATERIALIZED (SELECT company, entity, min(level) AS level FROM step GROUP BY ALL)"""


def components(name: str, where: str) -> str:
    return f"""
{name}_sym AS (SELECT holder AS a, held AS b FROM edges WHERE {where} UNION SELECT held, holder FROM edges WHERE {where}),
{name}_reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, s.b FROM {name}_reach r JOIN {name}_sym s ON s.a = r.b),
{name} AS MATERIALIZED (SELECT a AS node, min(b) AS component FROM {name}_reach GROUP BY a)"""


FAMILIES = components("promoted", "role IN ('Promoter', 'Promoter Group')") + """,
families AS MATERIALIZED (SELECT node, component AS family, n AS size FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM promoted) WHERE n > 1)"""

STRONG = """
up AS (SELECT held AS a, holder AS b FROM edges UNION SELECT u.a, e.holder FROM up u JOIN edges e ON e.held = u.b),
strong AS MATERIALIZED (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM up x JOIN up y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


def normal(expr: str) -> str:
    """Canonical names without look-around: single letters are bracketed, brackets that touch are joined."""
    s = f"regexp_replace(regexp_replace(replace(replace(lower(regexp_replace({expr}, '(?i)\\(\\s*formerly\\b[^)]*\\)?', ' ', 'g')), 'ß', 'ss'), '&', ' and '), '[''’`]', '', 'g'), '[^0-9a-z]+', ' ', 'g')"
    s = f"regexp_replace(replace(regexp_replace(trim({s}), '\\b([0-9a-z])\\b', '<\\1>', 'g'), '> <', ''), '[<>]', '', 'g')"
    words = "(ltd|limited|pvt|private|llp)"
    s = f"(SELECT regexp_replace(CASE WHEN regexp_full_match(u.s, '{words}( {words})*') THEN u.s ELSE regexp_replace(u.s, '( {words})+$', '') END, '^the (.)', '\\1') FROM (SELECT {s} AS s) u)"
    return s


def key(expr: str) -> str:
    forms = "(ltd|limited|pvt|private|llp|company|co|corporation|corp|inc|plc|pte|bv|lp|llc|ac)"
    s = f"regexp_replace({normal(expr)}, '\\bfly\\b', 'family', 'g')"
    s = f"regexp_replace({s}, '^((mr|mrs|ms|smt|shri|sri|dr) )+(.)', '\\3')"
    return f"regexp_replace({s}, '(.)( {forms})+$', '\\1')"


NAMES = """
parts AS (SELECT p_partkey AS key, p_name || ' ' || p_partkey AS base, CASE WHEN len(string_split(p_name, ' ')[-1]) >= 5 THEN p_name[:-2] ELSE p_name END || ' ' || p_partkey AS slip FROM part),
people AS (SELECT 'C' || c_custkey AS holder FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'FURNITURE')),
frel AS MATERIALIZED (SELECT CASE (holder_id + held_id) % 6 WHEN 0 THEN p.base || ' Ltd' WHEN 1 THEN p.base || ' LIMITED' WHEN 2 THEN p.base || ' Pvt. Ltd.' WHEN 3 THEN upper(p.slip) WHEN 4 THEN 'Mr ' || p.base ELSE p.base || ', Trustee of ' || p.base || ' Trust' END AS holder_name,
    CASE WHEN holder IN (SELECT holder FROM people) THEN 'individual' ELSE 'corporate' END AS filed_type, CASE WHEN (holder_id + held_id) % 29 = 0 THEN p.base || ' Co' ELSE h.base || ' Company Ltd' END AS held_name, stake_bp, role, (held_id * 1000000 + holder_id) * 2 + CAST(holder[1] = 'C' AS INTEGER) AS line
  FROM rel JOIN parts p ON p.key = holder_id JOIN parts h ON h.key = held_id),
filed AS MATERIALIZED (SELECT holder_name AS raw, filed_type, false AS listed FROM frel UNION ALL SELECT held_name, 'corporate', true FROM frel),
raws AS MATERIALIZED (SELECT DISTINCT raw FROM filed),
keyed AS MATERIALIZED (SELECT DISTINCT {key} AS key FROM raws)""".replace("{key}", key("raw"))

RESOLVED = """
told AS (SELECT DISTINCT raw, filed_type, CASE WHEN contains(raw, ', Trustee of ') THEN 'corporate' ELSE filed_type END AS etype, CASE WHEN contains(raw, ', Trustee of ') THEN regexp_extract(raw, ', Trustee of (.*)$', 1) ELSE raw END AS held_as FROM filed),
tk AS MATERIALIZED (SELECT raw, filed_type, etype, trim(held_as, ' ,.-') AS name, {key} AS key FROM told),
tkey AS MATERIALIZED (SELECT DISTINCT etype, key FROM tk),
tpair AS (SELECT a.etype, a.key AS a, b.key AS b, string_split(a.key, ' ') AS x, string_split(b.key, ' ') AS y FROM tkey a JOIN tkey b ON a.etype = b.etype AND starts_with(b.key, a.key[1:3]) AND a.key < b.key),
tword AS (SELECT etype, a, b, x, x[i] AS p, y[i] AS q FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM tpair WHERE len(x) = len(y))),
tlink AS (SELECT etype, a, b FROM tword GROUP BY etype, a, b, x HAVING bool_and(p = q OR least(len(p), len(q)) > 3 AND NOT regexp_matches(p || q, '[0-9]') AND 1 - levenshtein(p, q) / greatest(len(p), len(q)) >= 0.8) AND 2 * count(*) FILTER (p <> q) <= len(x)
  UNION SELECT etype, a, b FROM tpair WHERE replace(a, ' ', '') = replace(b, ' ', '')
  UNION SELECT etype, a, b FROM (SELECT a.etype, a.key AS a, min(b.key) AS b, count(*) AS n FROM tkey a JOIN tkey b ON a.etype = b.etype AND starts_with(b.key, a.key) AND a.key <> b.key WHERE len(a.key) >= 15 GROUP BY a.etype, a.key) WHERE n = 1 AND b[len(a) + 1] <> ' '),
tsym AS (SELECT etype, a, b FROM tlink UNION SELECT etype, b, a FROM tlink),
treach AS (SELECT etype, key AS a, key AS b FROM tkey UNION SELECT r.etype, r.a, s.b FROM treach r JOIN tsym s ON s.etype = r.etype AND s.a = r.b),
resolved AS (SELECT tk.*, m.root FROM tk JOIN (SELECT etype, a AS key, min(b) AS root FROM treach GROUP BY ALL) m USING (etype, key))""".replace("{key}", key("held_as"))


ENTITIES = """
own AS (SELECT r.*, n, listed, len(name) - len(replace(name, ' ', '')) AS spaces FROM resolved r JOIN (SELECT raw, filed_type, count(*) AS n, bool_or(listed) AS listed FROM filed GROUP BY ALL) USING (raw, filed_type)),
weights AS (SELECT etype, root, name, row_number() OVER (PARTITION BY etype, root ORDER BY sum(n) DESC, any_value(spaces) DESC, name) AS place FROM own GROUP BY etype, root, name),
ent0 AS (SELECT etype, root, coalesce((array_agg(raw ORDER BY n DESC, raw) FILTER (listed))[1], max(w.name)) AS name, array_agg(raw ORDER BY n DESC, raw) AS variants, string_agg(DISTINCT key, '|' ORDER BY key) AS keys, bool_or(listed) AS listed
  FROM own JOIN (SELECT etype, root, name FROM weights WHERE place = 1) w USING (etype, root) GROUP BY etype, root),
ent AS MATERIALIZED (SELECT *, 'E' || lpad(CAST(row_number() OVER (ORDER BY lower(name), etype, variants[1]) AS VARCHAR), CAST(len(CAST(count(*) OVER () AS VARCHAR)) + 1 AS INTEGER), '0') AS entity_id FROM ent0)"""

BUILT = """
who AS (SELECT raw, filed_type, entity_id FROM resolved JOIN ent USING (etype, root)),
told_edges AS MATERIALIZED (SELECT f.*, h.entity_id AS holder_id, t.entity_id AS held_id FROM frel f JOIN who h ON h.raw = f.holder_name AND h.filed_type = f.filed_type JOIN who t ON t.raw = f.held_name AND t.filed_type = 'corporate')"""

ROWS = """
cells AS (SELECT holder, held, (holder_id * 7 + held_id) % 26 AS k, stake_bp FROM rel),
verdict AS (SELECT holder, held, CASE WHEN k = 0 THEN 'holder_name is empty' WHEN k = 12 THEN 'entity_type is unknown' WHEN k = 1 THEN 'holder_name has no name'
  WHEN k IN (4, 5, 6) THEN 'stake_pct is not a number' WHEN k IN (9, 10, 11) THEN 'filing_date is not a date' WHEN k IN (14, 15) THEN 'shares_held is not a count' WHEN k = 17 THEN 'as_on_date is not a date' WHEN k = 2 THEN 'holder_name has a control character' END AS failure,
  CASE WHEN k IN (7, 8) THEN 'stake_out_of_range' WHEN k = 3 THEN 'self_ownership' END AS flag FROM cells),
judged AS (SELECT holder, held, CASE WHEN failure IS NOT NULL THEN 'rejected' WHEN flag IS NOT NULL THEN 'flagged' ELSE 'loaded' END AS outcome, coalesce(failure, flag, '') AS message FROM verdict)"""
