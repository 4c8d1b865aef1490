"""JSON filings, sinks, scoring, back edges and synthetic networks."""

import json

import pytest

from stakeweave.operators import evaluate
from stakeweave.plans import cycles
from stakeweave.sources import filings, synthetic


def payload(held, rows):
    keys = ("Fld_ShareHolderName", "Fld_TotalNoOfShares", "Fld_TotalPercentageOf_A_B_C2", "Fld_Code")
    return json.dumps({"Table": [{"Fld_AuthoriseDate": "2026-07-15T00:00:00"}], "Table2": [{"sLongName": held}], "Table1": [dict(zip(keys, r, strict=True)) for r in rows]}, indent=1)


def test_filings(spark, tmp_path):
    (tmp_path / "a.json").write_text(payload("Blue  Co", [("Ann   Bee", 10, 5.0, "A1a"), ("ann bee", 9, 4.0, "A1a"), ("Any Other (Specify)", 3, 1.0, "B"), ("Red Sons", 0, 2.0, "B"), ("Red Sons", 7, 2.0, "B")]))
    (tmp_path / "b.json").write_text(payload("Green Co", [("Red Sons", 4, 3.0, "B")]))
    rows = filings.cleaned(filings.read_filings(spark, str(tmp_path)))
    got = {(r.holder, r.held, r.shares, r.entity_type, str(r.filed_on)) for r in rows.collect()}
    assert got == {("Ann Bee", "Blue Co", 10, "individual", "2026-07-15"), ("Red Sons", "Blue Co", 7, "corporate", "2026-07-15"), ("Red Sons", "Green Co", 4, "corporate", "2026-07-15")}
    assert {(r.held, r.group) for r in filings.in_scope(rows, ["bee", "red"]).collect()} == {("Blue Co", "bee"), ("Green Co", "red")}
    old = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("m", 1, "z")], "key string, quarter int, v string")
    assert {r.v for r in filings.latest(old, "key", "quarter").collect()} == {"y", "z"}


def test_quarters_fallback_and_counters(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"88": {"fld_quartername": "June 2025", "fld_enddate": "30 Jun 2025"}, "89": {"fld_quartername": "odd", "fld_enddate": "soon"}}))
    assert {(r.quarter, r.name, str(r.ends_on)) for r in filings.read_quarters(spark, str(tmp_path / "q.json")).collect()} == {("88", "June 2025", "2025-06-30"), ("89", "odd", "None")}
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("m", 1, None), ("n", 2, "z"), ("n", 1, "y")], "key string, quarter int, v string")
    got = filings.latest(rows, "key", "quarter", rows.v.isNotNull()).collect()
    assert {(r.key, r.quarter, r.v) for r in got} == {("k", 1, "x"), ("m", 1, None), ("n", 2, "z")}
    filed = [(4, "Tide  Lamp", "Ebb", 5, "Promoter", None), (2, "TIDE LAMP", " Ebb", 9, "Promoter", None), (1, "tide lamp", "Ebb", 0, "Promoter", None), (3, "Tide Lamp", "Ebb", 1, "Public (>1%)", None), (5, " ", "Ebb", 1, "Promoter", None), (6, "Q", "Ebb", 1, "Promoter", "Any Other (Specify)")]
    frame = spark.createDataFrame(filed, "line long, holder string, held string, shares long, role string, kind string")
    assert {(r.verdict, r.role, r.rows) for r in filings.counters(frame, None).collect()} == {("kept", "Promoter", 1), ("duplicate", "Promoter", 1), ("no_shares", "Promoter", 1), ("kept", "Public (>1%)", 1), ("unnamed", "Promoter", 1), ("any_other", "Promoter", 1)}
    assert {(r.line, r.holder) for r in filings.cleaned(frame, None).collect()} == {(2, "TIDE LAMP"), (3, "Tide Lamp")}
    told = spark.createDataFrame([(1, "Ebb", "a"), (9, "Ebb", "b"), (10, "Ebb", None), (2, "Tide", "c")], "line long, held string, `group` string")
    assert {tuple(r) for r in filings.group_of(told).collect()} == {("Ebb", "b"), ("Tide", "c")}


def test_sinks_and_labels(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"])], "id int, v array<string>")
    filings.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first().v == '["a","b"]'
    filings.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == ["a", "b"]
    (tmp_path / "p.csv").write_text("name_a,name_b,band,same_entity,note\nA,B,<0.25,1,\n")
    assert filings.labelled_pairs(spark, str(tmp_path / "p.csv")).first().same_entity == 1
    (tmp_path / "q.csv").write_text("name_a,name_b,band,same_entity,note\nA,B,<0.25,yes,\n")
    with pytest.raises(Exception, match="not a label"):
        filings.labelled_pairs(spark, str(tmp_path / "q.csv")).collect()


def test_scores(spark):
    pairs = spark.createDataFrame([(True, True), (True, False), (False, False)], "truth boolean, found boolean")
    r = evaluate.scores(pairs).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (1, 0, 1, 1, 1.0, 0.5) and r.f1 == pytest.approx(2 / 3)
    r = evaluate.scores(pairs.limit(0)).first()
    assert (r.precision, r.recall) == (1.0, 1.0)


def test_back_edges(spark):
    e = spark.createDataFrame([("A", "B", 0.5), ("B", "C", 0.5), ("C", "D", 0.5), ("D", "B", 0.5), ("A", "E", 0.5)], "holder string, held string, stake double")
    assert [(r.holder, r.held, r.cycle) for r in cycles.back_edges(e).collect()] == [("D", "B", ["B", "C", "D", "B"])]
    assert cycles.back_edges(e.filter("holder != 'D'")).count() == 0


def test_synthetic(spark):
    size = 3000
    nodes, edges = synthetic.network(spark, size)
    rows, again = sorted(edges.collect()), sorted(synthetic.network(spark, size)[1].repartition(3).collect())
    assert rows == again and rows != sorted(synthetic.network(spark, size, seed=1)[1].collect())
    kinds = nodes.groupBy("entity_type", "listed").count().collect()
    assert {(r.entity_type, r.listed): r["count"] for r in kinds} == {("corporate", True): 342, ("individual", False): 957, ("corporate", False): 1701}
    assert 0.93 < len(rows) / (size * 946 / 405) <= 1 and len({(r.holder, r.held) for r in rows}) == len(rows)
    number = lambda x: int(x[1:])
    held, holds = {}, {}
    for r in rows:
        assert r.holder != r.held and number(r.held) < 342
        held[r.held] = held.get(r.held, 0) + r.stake
        holds[r.holder] = holds.get(r.holder, 0) + 1
    assert all(0.5 - 1e-9 <= x <= 0.85 + 1e-9 for x in held.values())
    assert {f"N{i}" for i in range(342, size)} <= set(holds)
    assert max(holds.values()) > 15 and sum(r.holder in held for r in rows) / len(rows) > 0.03
    assert synthetic.network(spark, 3)[1].count() >= 1
