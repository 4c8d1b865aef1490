"""Queries on pairs of one block don't make the block's pairs: their number grows with the square of the block."""

import pytest

import __spark_entry__ as entry
from stakeweave.operators import evaluate, resolve
from stakeweave.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def unblocked(monkeypatch):
    """block_pairs can't be called."""

    def refused(*args, **kwargs):
        raise AssertionError("all pairs of a block are made")

    for module, name in ((resolve, "block_pairs"), (evaluate, "block_pairs"), (catalogue, "block_pairs")):
        monkeypatch.setattr(module, name, refused, raising=False)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_token_matches_without_the_pairs_of_blocks(spark, unblocked):
    keys = [r.key for r in catalogue._keys(spark, DIR).collect()]
    from test_names_and_rows import slow_match

    want = sorted((a, b) for a in keys for b in keys if a < b and b.startswith(a[:3]) and slow_match(a, b))
    assert len(want) > 1 and rows(entry.queries()["token_match_pairs"](spark, DIR)) == want


def test_blocking_counts_without_the_pairs_of_blocks(spark, unblocked):
    from test_names_and_rows import slow_match

    keys = {("x", k) for k in ("", "l", "la", "lan", "lantern", "lanterm", "lantern works", "lanterm works", "lantern works 7", "lanterm works 7", "lan tern", "quarry 12", "quarri 12", "quarry 13", "q")} | {("y", "lantern"), ("y", "lanterx")}
    frame = spark.createDataFrame(sorted(keys), "entity_type string, key string")
    pairs = [(w, a, b) for w in range(1, 7) for s, a in keys for t, b in keys if s == t and a < b and b.startswith(a[:w])]
    want = [(w, sum(p[0] == w for p in pairs), sum(p[0] == w and slow_match(*p[1:]) for p in pairs)) for w in range(1, 7)]
    assert want[0][2] > 3 and rows(evaluate.blocking_counts(frame.union(frame))) == want
    assert rows(evaluate.blocking_counts(frame.limit(0))) == [(w, 0, 0) for w in range(1, 7)]


def test_threshold_sweep_without_the_pairs_of_blocks(spark, unblocked):
    from test_names_and_rows import slow_match

    keys = [r.key for r in catalogue._keys(spark, DIR).collect()]
    pairs = [(a, b) for a in keys for b in keys if a < b and b.startswith(a[:3])]
    want = [(t, sum(slow_match(a, b, t) for a, b in pairs)) for t in (0.6, 0.7, 0.8, 0.9)]
    assert want[0][1] > want[3][1] and rows(entry.queries()["threshold_sweep"](spark, DIR)) == want


def test_missed_pairs_without_the_pairs_of_blocks(spark, unblocked):
    from test_names_and_rows import distance

    keys = [r.key for r in catalogue._keys(spark, DIR).collect()]
    pairs = [(a, b) for a in keys for b in keys if a < b and not b.startswith(a[:3]) and abs(len(a) - len(b)) <= max(1, len(a) // 5)]
    assert rows(entry.queries()["missed_pairs"](spark, DIR)) == sorted(p for p in pairs if distance(*p) <= max(1, len(p[0]) // 5))


def test_whole_keys_alike_without_the_pairs_of_blocks(spark, unblocked):
    import random

    from test_names_and_rows import distance, spelt

    rng = random.Random(3)
    keys = sorted({spelt(rng, rng.choice(["lantern works 12", "lantern quarry 17", "lanes of tide 12"])) for _ in range(60)} | {"", "l", "la", "lan", "lant"})
    frame = spark.createDataFrame([("x", k) for k in keys], "entity_type string, key string")
    for least in (0.8, 0.9):
        want = sorted(("x", a, b) for a in keys for b in keys if a < b and b.startswith(a[:3]) and 1 - distance(a, b) / max(len(a), len(b)) >= least)
        assert len(want) > 5 and rows(resolve.alike_pairs(frame, least)) == want


def test_block_pairs_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(resolve, "TILE", 4, raising=False)
    monkeypatch.setattr(resolve, "STRIP", 3, raising=False)
    words = ["", "l", "la", "lan", "lant", "lb", "q", "quay", *(f"lan{n}" for n in range(23)), *(f"la{n}" for n in range(9)), *(f"z{n}" for n in range(5))]
    keys = [(t, k) for t in "xy" for k in words] + [("z", "lan"), ("z", None)]
    frame = spark.createDataFrame(keys, "entity_type string, key string")
    for width in (1, 3):
        want = sorted((s, a, b) for s, a in keys for t, b in keys if s == t and a is not None and b is not None and a < b and b.startswith(a[:width]))
        assert rows(resolve.block_pairs(frame.union(frame), width)) == want
    assert rows(resolve.block_pairs(frame.limit(0))) == []


def test_a_list_of_block_pairs_takes_little_disk(spark, tmp_path):
    frame = spark.range(1500).selectExpr("'x' AS entity_type", "concat('lantern ', sha2(string(id), 256)) AS key")
    resolve.block_pairs(frame).write.parquet(f"file://{tmp_path}/pairs")
    assert spark.read.parquet(f"file://{tmp_path}/pairs").distinct().count() == 1500 * 1499 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").iterdir()) < 0.5 * 1500 * 1499 // 2


def test_near_pairs_are_measured_in_arrays(spark):
    """No row of a pair is made that is not near, and none by a distance of Spark's own, which takes microseconds a pair."""
    import random

    import numpy as np
    from test_names_and_rows import distance

    rng = random.Random(11)
    for m, n, letters in ((0, 3, "a"), (5, 4, "a1"), (8, 9, "ab12"), (16, 13, "ab"), (33, 40, "abc "), (64, 60, "ab"), (70, 66, "ab")):
        x, y = [["".join(rng.choices(letters, k=k)) for _ in range(12)] for k in (m, n)]
        i, j = np.divmod(np.arange(144), 12)
        codes = [np.array([[ord(c) for c in t] for t in own], dtype=np.uint32).reshape(12, -1) for own in (x, y)]
        assert resolve.distances(*codes, i, j).tolist() == [distance(x[p], y[q]) for p, q in zip(i, j)]
    names = [f"{w} {rng.randrange(10**k)}" for w in ("blue anvil", "blue anvi", "red rod", "rod") for k in (2, 5, 6) for _ in range(9)]
    keys = sorted({*names, *(f"{k} trustee of {k} trust" for k in names), "rod", "77", "7"})
    found = resolve.near_pairs(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert "levenshtein" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((a, b, d) for a in keys for b in keys if a != b and abs(len(a) - len(b)) <= len(a) // 5 + 1 and (d := distance(a, b)) <= max(1, len(a) // 5))
    assert rows(found) == want and len(want) > 500


def test_missed_pairs_compare_no_keys_of_one_block(spark, monkeypatch):
    """Masks that begin with the same letters are left out before their keys meet."""
    met = []
    monkeypatch.setattr(resolve, "near_pairs", lambda keys, which, of_masks: met.append(of_masks) or keys.selectExpr("key AS a", "key AS b"))
    entry.queries()["missed_pairs"](spark, DIR)
    masks = spark.createDataFrame([("red rod 00", "red ring 0"), ("red rod 00", "old rod 00"), ("re0", "re0"), ("re", "re"), ("", "a")], "x string, y string")
    assert [r.m for r in masks.select(met[0].alias("m")).collect()] == [False, True, True, False, True]


def test_links_of_whole_keys_join_what_all_pairs_join(spark):
    import random

    rng = random.Random(9)
    keys = sorted({f"{w} {rng.randrange(10**k)}" for w in ("lantern", "lanterns", "lane", "quarry of", "7 lanes", "la") for k in (1, 4, 6) for _ in range(14)} | {"", "l", "la", "lan", "lant", "qu", "7", "7 7"})
    frame = spark.createDataFrame([(t, k) for t in "xy" for k in keys[:: 1 if t == "x" else 3]], "entity_type string, key string")

    def joined(pairs):
        sets = {}
        for t, a, b in pairs:
            one = sets.get((t, a), {(t, a)}) | sets.get((t, b), {(t, b)})
            sets |= dict.fromkeys(one, one)
        return {frozenset(s) for s in map(frozenset, sets.values())}

    for least in (0.8, 0.9):
        links, pairs = rows(resolve.alike_links(frame, least)), rows(resolve.alike_pairs(frame, least))
        assert set(links) <= set(pairs) and joined(links) == joined(pairs) and 20 < len(links) < len(pairs)


def test_ablations_without_company_numbers_make_no_list_of_alike_pairs(spark, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("all alike pairs are made")

    monkeypatch.setattr(resolve, "alike_pairs", refused)
    filed = spark.createDataFrame([(n, "corporate", False) for n in ("Lantern Works 1", "Lantern Works 2", "Quarry 7")], "raw string, filed_type string, listed boolean")
    pairs = spark.createDataFrame([("Lantern Works 1", "Lantern Works 2", "corporate", True)], "a string, b string, filed_type string, truth boolean")
    assert evaluate.ablations(filed, pairs, {"whole": {"token_guard": False}}).select("entities", "tp").collect() == [(2, 1)]
