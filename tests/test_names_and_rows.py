"""Names, resolution, ingest, and that every query's columns agree with its oracle's."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stakeweave.functions import names
from stakeweave.operators import build, evaluate, ingest, resolve


def column(spark, f, values):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, a string" + ", b string" * isinstance(values[0], tuple))
    return [r.x for r in rows.select("i", f.alias("x")).orderBy("i").collect()]


WORDS = ("quarry", "lantern", "& ", "tide's", "Örsk", "of", "q", "r", "s7", "9", "Private", "holding", "THE", "straße", "ﬁre")
FORMS = ("Ltd", "Limited", "Pvt", "LLP", "(P)", "Private Limited")


def slow_norm(name):
    """The canonical form word by word: initials are gathered while walking, forms and the article are taken off the ends."""
    text = re.sub(r"\(\s*formerly\b[^)]*\)?", " ", name, flags=re.I).lower().replace("ß", "ss").replace("&", " and ")
    words, run = [], ""
    for w in [*re.findall("[0-9a-z]+", "".join(c for c in text if c not in "'’`")), None]:
        if w and len(w) == 1:
            run += w
            continue
        words += [run] * bool(run) + [w] * bool(w)
        run = ""
    forms = {"ltd", "limited", "pvt", "private", "llp"}
    if set(words) - forms:
        while words[-1] in forms:
            words.pop()
    return " ".join(words[1:] if len(words) > 1 and words[0] == "the" else words)


def test_canonical_names_by_brute_force(spark):
    rng = random.Random(1)
    cases = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 6)) + rng.choices(FORMS, k=rng.randrange(3))) for _ in range(400)]
    cases += ["", "Ltd", "the", "The Ltd", "(formerly Tide Ltd", "Quarry (Formerly: Tide) Works", "Q.R.S. Lantern", "a-b", "::"]
    assert column(spark, names.normalised(F.col("a")), cases) == [slow_norm(c) for c in cases]


def test_match_keys_drop_titles_and_forms(spark):
    titles, forms = ("mr", "smt", "dr"), ("company", "inc", "plc", "co", "ltd")
    cases = {f"{t} {u} quarry lantern {f} {g}": "quarry lantern" for t, u, f, g in itertools.product(titles, ("shri", ""), forms, ("", "llc"))}
    cases |= {"Quarry Fly Trust": "quarry family trust", "mr": "mr", "inc plc": "inc", "dr ltd": "dr", "company": "company"}
    assert column(spark, names.match_key(F.col("a")), list(cases)) == list(cases.values())


BEARERS = ("Ila Quarry", "Oda (North) Tide", "Q. R. Lantern")


@pytest.mark.parametrize("bearer", BEARERS)
def test_capacity_rules(spark, bearer):
    """Each rule with the bearer in the place of the one who acts, and the tide family in that of whom it acts for."""
    cases = {
        f"{bearer} for and on behalf of Tide Lamp Trust": ("Tide Lamp Trust", "trust", "behalf_of"), f"{bearer}, on behalf of Tide Lamp HUF.": ("Tide Lamp HUF", "huf", "behalf_of"),
        f"{bearer} on behalf of the firm Tide and Lamp": ("Tide and Lamp", "firm", "behalf_of"), f"{bearer} in the capacity of partner of Tide Lamp - Firm": ("Tide Lamp", "firm", "partner_of"),
        f"{bearer} - kartha of Tide Lamp HUF (joint)": ("Tide Lamp HUF", "huf", "karta_of"), f"{bearer}, TRUSTEE OF Tide Lamp Trust": ("Tide Lamp Trust", "trust", "trustee_of"),
        f"Tide Lamp HUF, rep. by {bearer}": ("Tide Lamp HUF", "huf", "huf"), "Tide Lamp (acting karta, HUF)": ("Tide Lamp HUF", "huf", "karta_capacity"),
        "Tide Lamp (Holding for others)": ("Tide Lamp", None, "as_filed"), "Tide Lamp - holds jointly": ("Tide Lamp", None, "as_filed"), "Tide Lamp - East Works": ("Tide Lamp - East Works", None, "as_filed"),
        "Tide and Lamp Fund(TLF) ,": ("Tide and Lamp Fund", None, "as_filed"), "Tide and Lamp Fund (TL)": ("Tide and Lamp Fund (TL)", None, "as_filed"), "Tide (North": ("Tide (North", None, "as_filed"),
        "Lamp on behalf of trust": ("Lamp on behalf of trust", None, "as_filed"),
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*cases, None])], "i int, a string")
    got = {r.i: r.e for r in names.with_entity(rows, "a", "e").collect()}
    assert {x: tuple(got[i]) for i, x in enumerate(cases)} == cases and got[len(cases)] is None


def slow_match(a, b, threshold=0.8):
    if a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = a.split(), b.split()
    pairs = [(p, q) for p, q in zip(x, y, strict=False) if p != q]
    alike = all(min(len(p), len(q)) > 3 and not re.search("[0-9]", p + q) and 1 - distance(p, q) / max(len(p), len(q)) >= threshold for p, q in pairs)
    return len(x) == len(y) and alike and 2 * len(pairs) <= len(x)


def distance(a, b):
    """Edit distance by its definition over the last letters."""
    table = {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return table[len(a), len(b)]


def spelt(rng, base):
    """A base key with up to two of its letters changed, or without its spaces."""
    key = list(base)
    for _ in range(rng.randrange(3)):
        i = rng.randrange(3, len(key))
        key[i] = key[i] if key[i] == " " else rng.choice(["x", "y", "", key[i] * 2])
    return "".join(key).replace(" ", "" if rng.random() < 0.1 else " ")


def test_fuzzy_pairs_by_brute_force(spark):
    rng = random.Random(8)
    words = ["lantern", "quarry", "tide", "works", "co7", "ab", "12", "generation"]
    bases = [" ".join(rng.choices(words, k=rng.randrange(2, 6))) for _ in range(25)]
    keys = sorted({spelt(rng, rng.choice(bases)) for _ in range(260)})
    want = {(a, b) for a in keys for b in keys if a < b and b.startswith(a[:3]) and slow_match(a, b)}
    frame = spark.createDataFrame([(k, "x") for k in keys], "key string, entity_type string")
    assert len(want) > 20 and {(r.a, r.b) for r in resolve.fuzzy_pairs(frame).collect()} == want
    pairs = [(a, b) for a in keys[:40] for b in keys[:40]]
    assert column(spark, names.token_match(F.col("a"), F.col("b")), pairs) == [slow_match(a, b) for a, b in pairs]


@pytest.mark.parametrize(("letters", "longest"), [("abc", 14), ("abcdefgh", 30)])
def test_near_pairs_by_brute_force(spark, letters, longest):
    rng = random.Random(longest)
    keys = {"".join(rng.choices(letters, k=rng.randrange(1, longest))) for _ in range(70)}
    for k in list(keys):  # and neighbours of them
        i = rng.randrange(len(k))
        keys |= {k[:i] + rng.choice(letters) + k[i:], k[:i] + k[i + 1 :], k[i:] + k[:i]} - {""}
    want = {(a, b, d) for a in keys for b in keys if a != b and abs(len(a) - len(b)) <= len(a) and (d := distance(a, b)) <= max(1, len(a) // 5)}
    assert {tuple(r) for r in resolve.near_pairs(spark.createDataFrame([(k,) for k in keys], "key string")).collect()} == want


def test_near_pairs_of_numbered_names_are_met_once(spark, monkeypatch):
    monkeypatch.setattr(resolve, "TOGETHER", 7)
    rng = random.Random(5)
    keys = {f"{rng.choice(['large ring', 'large rin', 'cold bolt', 'old bolt', 'o', ''])} {rng.randrange(3000)}".strip() for _ in range(150)} | {"7", "77", "large ring", "3 large ring", "4large ring 12", "a1b2c3d4e5", "abcde", "1a2b3c4d5e6f", "9" * 40, "9" * 34 + "x"}
    want = {(a, b, d) for a in keys for b in keys if a != b and (d := distance(a, b)) <= max(1, len(a) // 5)}
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    found = resolve.near_pairs(frame)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) > 200 and set(rows) == want
    gathered = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "distance" in line]
    assert not gathered  # no pair is made twice, so none are made distinct
    some = (F.col("a") > F.col("b")) & F.endswith(F.col("a"), F.lit("1"))
    assert {tuple(r) for r in resolve.near_pairs(frame, some).collect()} == {w for w in want if w[0] > w[1] and w[0].endswith("1")}


def filed(spark, rows):
    return spark.createDataFrame([(n, "corporate", False, c, i) for i, (n, c) in enumerate(rows)], "raw string, filed_type string, listed boolean, cin string, line long")


def test_resolution_respects_cins(spark):
    obs = resolve.observations(filed(spark, [("Lantern Quarries Ltd", "L1"), ("Lanterm Quarries Ltd", None), ("Lanterx Quarries Ltd", "L2"), ("Tide Power Generation Co", "T9"), ("Ebb Light", "T9"), ("Tide Power Genera", None)]))
    roots, log = resolve.merged(obs, resolve.merge_candidates(obs))
    found = resolve.entities(obs, roots)
    sets = {frozenset(e.variants) for e in found.collect()}
    assert frozenset({"Tide Power Generation Co", "Ebb Light", "Tide Power Genera"}) in sets
    assert not any({"Lantern Quarries Ltd", "Lanterx Quarries Ltd"} <= s for s in sets) and len(sets) == 3
    assert sorted(e.entity_id for e in found.collect()) == ["E01", "E02", "E03"] and sorted(r.step for r in log.collect()) == [0, 1, 2]
    who = resolve.entity_map(obs, roots, found)
    assert resolve.entity_of(who, "Ebb Light") == resolve.entity_of(who, "Tide Power Genera", "corporate")
    with pytest.raises(KeyError, match="no name"):
        resolve.entity_of(who, "Nobody")


def test_switches_of_resolution(spark):
    rows = filed(spark, [("Tide Lamp Works", None), ("Tide Lamp Workz", None), ("Tide Lamp Generation", None), ("Tide Lamp Genera", None), ("Oda, trustee of Tide Lamp Works", None), ("AB Nifty 50", None), ("AB Nifty 90", None)])
    pairs = spark.createDataFrame([("Tide Lamp Works", "Tide Lamp Workz", "corporate", True), ("AB Nifty 50", "AB Nifty 90", "corporate", False)], "a string, b string, filed_type string, truth boolean")
    got = {r.config: r for r in evaluate.ablations(rows, pairs).collect()}
    assert {c: r.entities for c, r in got.items()} == {"normalised only": 7, "capacity": 6, "truncation": 5, "fuzzy": 4, "whole keys 0.8": 3, "whole keys 0.9": 3}
    assert (got["fuzzy"].tp, got["fuzzy"].fp, got["whole keys 0.8"].fp, got["capacity"].fn) == (1, 0, 1, 1)


def test_from_rows_to_a_network(spark):
    rows = [
        (1, "Tide Lamp Ltd", "corporate", "Ebb Works", 20.0, "Promoter", None, None), (2, "TIDE LAMP LIMITED", "Corporate", "Ebb Works Ltd.", 5.0, "Public (>1%)", None, None), (3, "Oda Quarry", "individual", "Tide Lamp", 60.0, "Public (>1%)", None, None),
        (4, "Ebb Works Private Limited", "corporate", "EBB WORKS", 1.0, None, None, None), (5, "Dusk Co", "corporate", "Dawn Co", 3.0, "Promoter", "C1", "C1"),
    ]
    records = spark.createDataFrame(rows, "line long, holder_name string, entity_type string, held_name string, stake double, holder_role string, holder_cin string, held_cin string")
    built = build.network(records)
    name = {r.id: r.name for r in built.nodes.collect()}
    assert len(name) == 4  # Dusk and Dawn share a number, and stay a node without edges
    assert {(name[r.holder], name[r.held], round(r.stake, 9), r.role, r.records) for r in built.edges.collect()} == {("Tide Lamp", "EBB WORKS", 0.25, "Promoter", 2), ("Oda Quarry", "Tide Lamp", 0.6, "Public (>1%)", 1)}
    assert sorted((r.line, r.kind) for r in built.issues.collect()) == [(4, "self_ownership_resolved"), (5, "self_ownership_resolved")]
    assert {r.listed for r in built.nodes.filter("name = 'Oda Quarry'").collect()} == {False}
    with pytest.raises(build.SelfOwnershipError, match="one entity"):
        build.network(records, strict=True)


HEADER = "holder_name,held_name,stake_pct,filing_date,entity_type,shares_held,held_cin\n"
GOOD = {"holder_name": "Tide Lamp Pvt Ltd", "held_name": "Ebb Works", "stake_pct": "12.5", "filing_date": "2025-11-30", "entity_type": "corporate", "shares_held": "", "held_cin": ""}
WRONG = {
    "holder_name": {"": "empty", " ": "empty", "!!": "no name", "Ti\x08de": "control"}, "held_name": {"": "empty", "—": "no name", "E\x1bb": "control"},
    "stake_pct": {"": "empty", "twelve": "number", "12%": "number", "12f": "number", "Infinity": "number", "0x1": "number"}, "filing_date": {"30.11.2025": "date", "2025-11-31": "date", "2025-1-3": "date", "20251130": "date"},
    "entity_type": {"fund": "unknown", "": "empty"}, "shares_held": {"-1": "count", "7.0": "count", "many": "count"},
}


def test_each_wrong_cell_is_told(spark):
    cases = [(c, v, says) for c, kinds in WRONG.items() for v, says in kinds.items()]
    text = HEADER + "".join(",".join((GOOD | {c: v}).values()) + "\n" for c, v, _ in cases)
    got = ingest.validated(ingest.from_text(spark, text)).orderBy("line").collect()
    assert [(r.line, r.outcome) for r in got] == [(i + 2, "rejected") for i in range(len(cases))]
    for r, (c, _, says) in zip(got, cases, strict=True):
        assert c in r.message and says in r.message


def test_rows_that_load_or_are_flagged(spark):
    changes = [({}, "loaded", None), ({"stake_pct": "0"}, "loaded", None), ({"stake_pct": "1e2"}, "loaded", None), ({"entity_type": "INDIVIDUAL"}, "loaded", None), ({"shares_held": "007", "held_cin": "l01x"}, "loaded", None),
               ({"stake_pct": "100.5"}, "flagged", "range"), ({"stake_pct": "-0.1"}, "flagged", "range"), ({"holder_name": "The EBB works ltd"}, "flagged", "self")]
    text = "﻿" + HEADER + "\n , ,,,,,\n" + "".join(",".join((GOOD | c).values()) + "\r\n" for c, *_ in changes) + "too,few\n" + ",".join(GOOD.values()) + ",more\n"
    got = ingest.validated(ingest.from_text(spark, text)).orderBy("line").collect()
    assert [r.line for r in got] == list(range(4, 14)) and [r.outcome for r in got] == [o for _, o, _ in changes] + ["rejected"] * 2
    assert all(says is None and r.message is None or says in r.message for r, (_, _, says) in zip(got, changes, strict=False))
    assert (got[4].held_cin, got[4].shares_held, got[0].held_cin, got[0].shares_held) == ("L01X", "007", None, None) and got[8].message.startswith("2 fields")
    assert ingest.by_type(ingest.validated(ingest.from_text(spark, text))).orderBy("entity_type").collect()[1].rows == 1


@pytest.mark.parametrize("text", ["", "\n", "holder_name,held_name\n", HEADER.strip() + ",held_name\n"])
def test_headers_that_cannot_be_read(spark, tmp_path, text):
    with pytest.raises(ingest.IngestError):
        ingest.from_text(spark, text)
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(ingest.IngestError):
        ingest.read_csv(spark, str(tmp_path))


def test_files_are_read_in_blocks(spark, tmp_path):
    """Against csv.reader over the whole file; blocks of 4 kB begin anywhere, also inside quoted fields."""
    import csv
    import io

    rng = random.Random(3)
    cells = lambda many: [rng.choice(["Tide Lamp", '"Lamp, Tide"', '"say ""no"" twice"', 'a"b"c', '"x"y', "", *(['"two\nlines"', '"\n\n"'] if many else [])]) for _ in range(2)] + ["5", "2025-11-30", "corporate", "7", ""]
    want = []
    for i in range(4):
        text = "﻿" * (i % 2) + HEADER + "".join(rng.choice(["", "\n", "short,row\n"]) + ",".join(cells(i > 1)) + "\n" for _ in range(300))
        (tmp_path / f"f {i}.csv").write_text(text, newline="")
        reader = csv.reader(io.StringIO(text, newline=""))
        next(reader)
        want += [(reader.line_num, row) for row in reader if any(c.strip() for c in row)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = [(r.line, r.row) for r in ingest.read_csv(spark, str(tmp_path)).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(want) and len(got) > 1200


def test_entry_points_agree(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert not [sql for sql in oracles.values() if re.search(r"\blimit\b", sql, re.I)]
    assert __spark_entry__.entry(spark).limit(1).count() == 1
