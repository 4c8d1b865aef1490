"""The network engine against matrices and path sets worked out with NumPy, on drawn networks and a few small ones."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakeweave.plans import cycles, iterate, matrices, report
from stakeweave.plans import network as net


class Drawn:
    """A random network: A[i, j] is what i holds of j."""

    def __init__(self, seed, size=7, density=0.3, most=0.45, acyclic=False):
        rng = np.random.default_rng(seed)
        a = rng.uniform(0.02, most, (size, size)) * (rng.random((size, size)) < density)
        np.fill_diagonal(a, 0)
        a = np.triu(a) if acyclic else a
        self.a = np.round(a / np.maximum(1.0, a.sum(0) / 0.9), 3)  # nobody is held to more than nine tenths
        self.ids = [f"n{i}" for i in range(size)]
        self.people = {i for i in range(size) if rng.random() < 0.3}

    def frames(self, spark):
        nodes = [(n, n, "individual" if i in self.people else "corporate", i % 2 == 0) for i, n in enumerate(self.ids)]
        edges = [(self.ids[i], self.ids[j], float(self.a[i, j]), "Promoter" if (i + j) % 3 else "Public (>1%)") for i, j in zip(*np.nonzero(self.a), strict=True)]
        return spark.createDataFrame(nodes, "id string, name string, entity_type string, listed boolean"), spark.createDataFrame(edges, "holder string, held string, stake double, role string")

    def reach(self):
        """R[i, j]: i is reached from j by going up, in any number of steps."""
        r = np.eye(len(self.ids), dtype=bool) | (self.a > 0)
        for _ in self.ids:
            r = r | (r.astype(int) @ r.astype(int) > 0)
        return r


def path_sets(g, least):
    """{(path, end reason)}: all paths of one layer, then of two, and so on; a path goes on unless its last node ends it."""
    owned = {j for _, j in zip(*np.nonzero(g.a), strict=True)}
    out, layer = set(), {((c,), 1.0) for c in owned}
    while layer:
        longer = set()
        for path, weight in layer:
            steps = [(i, weight * g.a[i, path[-1]]) for i in np.flatnonzero(g.a[:, path[-1]])]
            steps = [(int(i), w) for i, w in steps if w >= least]
            if not steps and len(path) > 1:
                out.add((path, "below_threshold"))
            for i, w in steps:
                reason = "circular" if i in path else "natural_person" if i in g.people else None if i in owned else "no_recorded_owner"
                if reason:
                    out.add(((*path, i), reason))
                else:
                    longer.add(((*path, i), w))
        layer = longer
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 0.0), (2, 0.01)])
def test_chains_are_the_paths(spark, seed, least):
    g = Drawn(seed)
    found = net.chains(*g.frames(spark), least).collect()
    want = path_sets(g, least)
    assert {(tuple(int(x[1:]) for x in r.path), r.end_reason) for r in found} == want and len(found) == len(want)
    for r in found:
        steps = [g.a[int(b[1:]), int(a[1:])] for a, b in itertools.pairwise(r.path)]
        assert r.effective == pytest.approx(np.prod(steps)) and r.layers == len(steps) and r.company == r.path[0] and r.terminal == r.path[-1]


@pytest.mark.parametrize("seed", range(5, 7))
def test_integrated_stakes_are_columns_of_an_inverse(spark, seed):
    """With the company's own holdings cut off, its owners' stakes are a column of (I - A)^-1; without cycles, simple chains give the same."""
    g = Drawn(seed, acyclic=seed == 5)
    nodes, edges = g.frames(spark)
    got = {(r.company, r.owner): r.stake for r in net.integrated(edges).collect()}
    size = len(g.ids)
    for c in {int(j) for j in np.nonzero(g.a)[1]}:
        a = g.a.copy()
        a[c] = 0
        x = np.linalg.inv(np.eye(size) - a)[:, c]
        for v in range(size):
            if v != c and x[v] > 1e-9:
                assert got.pop((g.ids[c], g.ids[v])) == pytest.approx(x[v], abs=1e-10)
    assert not got
    if seed == 5:
        g.people = set()
        nodes, edges = g.frames(spark)
        simple = {(r.company, r.owner): r.total for r in net.ultimate_owners(net.chains(nodes, edges, 0.0)).collect()}
        whole = {(r.company, r.owner): r.stake for r in net.ultimate_integrated(edges, net.integrated(edges)).collect()}
        assert simple.keys() == whole.keys() and all(simple[k] == pytest.approx(whole[k]) for k in simple)
    else:  # loops only add
        simple = {(r.company, r.owner): r.total for r in net.ultimate_owners(net.chains(nodes, edges, 0.0)).collect()}
        stakes = {(r.company, r.owner): r.stake for r in net.integrated(edges).collect()}
        assert all(stakes[k] >= v - 1e-12 for k, v in simple.items())


@pytest.mark.parametrize("seed", range(10, 12))
def test_groups_levels_and_cycles(spark, seed):
    g = Drawn(seed, size=9, density=0.18)
    nodes, edges = g.frames(spark)
    r = g.reach()
    both = r & r.T
    label = {i: int(np.flatnonzero(both[i])[0]) for i in range(9)}
    strong = net.strong_components(edges)
    assert {(x.node, x.component) for x in strong.collect()} == {(g.ids[i], g.ids[label[i]]) for i in range(9) if both[i].sum() > 1}
    inner = {(i, j) for i, j in zip(*np.nonzero(g.a), strict=True) if label[i] == label[j]}
    back = cycles.back_edges(edges).collect()
    assert bool(back) == bool(inner)
    for b in back:
        assert b.cycle[0] == b.cycle[-1] == b.held and b.cycle[-2] == b.holder and all(g.a[int(x[1:]), int(y[1:])] > 0 for x, y in itertools.pairwise(b.cycle))
    for e in cycles.example_cycles(edges, strong).collect():
        walk = [int(x[1:]) for x in e.cycle.split(">")]
        assert e.loop_stake == pytest.approx(np.prod([g.a[x, y] for x, y in itertools.pairwise(walk)])) and e.place <= 5
    # breadth first: the power of the adjacency matrix in which an entry first appears
    step, seen = (g.a > 0).astype(int), {}
    for c in {int(j) for j in np.nonzero(g.a)[1]}:
        at, front, level = {c}, {c}, 0
        while front:
            seen.update({(g.ids[c], g.ids[v]): level for v in front})
            front = {int(v) for w in front for v in np.flatnonzero(step[:, w])} - at
            at |= front
            level += 1
    assert {(x.company, x.entity): x.level for x in net.levels(edges).collect()} == seen
    # components from the null space of the graph's Laplacian: as many as eigenvalues 0
    sym = (g.a + g.a.T > 0).astype(float)
    zero = int(np.sum(np.abs(np.linalg.eigvalsh(np.diag(sym.sum(0)) - sym)) < 1e-9))
    comp = net.components(nodes, edges).collect()
    assert len({x.component for x in comp}) == zero and all(x.component <= x.node for x in comp)
    assert len({x.component for x in net.components(nodes, edges, net.promoter()).collect()}) >= zero


@pytest.mark.parametrize("seed", range(20, 21))
def test_walk_sums_of_groups(spark, seed):
    g = Drawn(seed, size=5, density=0.5, most=0.15)
    _, edges = g.frames(spark)
    strong = net.strong_components(edges)
    member = {r.node: r.component for r in strong.collect()}
    target = min(member) if member else None
    for left_out in (None, target):
        inner = matrices.group_matrix(edges, strong, left_out)
        got = {(r.holder, r.held): r.total for r in matrices.walk_sum(inner).collect()}
        for component in set(member.values()):
            own = [i for i, n in enumerate(g.ids) if member.get(n) == component]
            a = g.a[np.ix_(own, own)]
            if left_out in [g.ids[i] for i in own]:
                a[own.index(g.ids.index(left_out))] = 0
            whole = np.linalg.inv(np.eye(len(own)) - a)
            for x, i in enumerate(own):
                for y, j in enumerate(own):
                    if (g.ids[i], g.ids[j]) in got:
                        assert got[g.ids[i], g.ids[j]] == pytest.approx(whole[x, y], abs=1e-9)
                    else:
                        assert whole[x, y] == pytest.approx(float(x == y), abs=1e-9)


def frames(spark, holdings, people=()):
    ids = sorted({x for h in holdings for x in h[:2]})
    nodes = spark.createDataFrame([(i, i.title(), "individual" if i in people else "corporate", i.startswith("co")) for i in ids], "id string, name string, entity_type string, listed boolean")
    return nodes, spark.createDataFrame([(*h[:3], h[3] if len(h) > 3 else "Promoter") for h in holdings], "holder string, held string, stake double, role string")


def test_a_ring_with_one_outsider(spark):
    """Three companies hold a tenth of the next; gran holds half of one of them."""
    nodes, edges = frames(spark, [("co1", "co2", 0.1), ("co2", "co3", 0.1), ("co3", "co1", 0.1), ("gran", "co1", 0.5)], {"gran"})
    found = net.chains(nodes, edges, 0.0).collect()
    assert {(">".join(r.path), r.end_reason) for r in found if r.company == "co1"} == {("co1>gran", "natural_person"), ("co1>co3>co2>co1", "circular")}
    stakes = net.integrated(edges)
    assert {r.company: round(r.self_stake, 12) for r in net.self_ownership(edges, stakes).collect()} == {c: 0.001 for c in ("co1", "co2", "co3")}
    metrics = {r.company: r for r in net.company_metrics(nodes, edges, net.ultimate_owners(net.chains(nodes, edges, 0.0)), stakes, net.families(nodes, edges)).collect()}
    assert metrics["co1"].controller == "gran" and metrics["co1"].traced_pct == 50 and metrics["co1"].hhi == 2500 and metrics["co2"].traced_pct == 5
    assert metrics["co1"].self_ownership_pct == 0.1 and metrics["co1"].family == "co1" and metrics["co1"].family_pct == 50
    walls = net.chains(nodes, edges, 0.2).filter("company = 'co2'").count()
    assert walls == 0  # a tenth is below the threshold at once: no chain begins
    assert {(r.label, r.size, r.listed, r.natural_persons) for r in report.labelled_families(nodes, net.families(nodes, edges)).collect()} == {("F1", 4, 3, 1)}


def test_long_rings_and_guards(spark):
    ring = [(f"r{i:02}", f"r{(i + 1) % 14:02}", 0.5) for i in range(14)]
    _, edges = frames(spark, ring)
    assert {(r.node, r.component) for r in net.strong_components(edges).collect()} == {(f"r{i:02}", "r00") for i in range(14)}
    assert cycles.back_edges(edges).count() == 1
    with pytest.raises(ArithmeticError):
        net.integrated(frames(spark, [("x", "y", 1.0), ("y", "x", 1.0), ("x", "z", 1.0)])[1], limit=25)
    with pytest.raises(ArithmeticError):
        matrices.walk_sum(matrices.group_matrix(frames(spark, [("x", "y", 1.0), ("y", "x", 1.0)])[1], spark.createDataFrame([("x", "x"), ("y", "x")], "node string, component string")), limit=25)
    nodes, dense = frames(spark, [(f"d{i}", f"d{j}", 0.2) for i in range(5) for j in range(5) if i != j])
    with pytest.raises(ArithmeticError):
        net.chains(nodes, dense, 0.0, most=20)


def test_subgraph_of_a_group(spark):
    _, edges = frames(spark, [("a", "b", 0.2), ("b", "a", 0.3), ("c", "a", 0.1), ("b", "d", 0.1), ("c", "d", 0.4)])
    got = report.group_subgraph(edges, net.strong_components(edges).select("node")).collect()
    assert {(r.holder, r.held, r.circular) for r in got} == {("a", "b", True), ("b", "a", True), ("c", "a", False), ("b", "d", False)}


def test_end_labels(spark):
    nodes, edges = frames(spark, [("p", "co1", 0.5), ("q", "co1", 0.3), ("s", "q", 0.00001)], {"p"})
    assert report.end_histogram(net.chains(nodes, edges)).filter("company = 'co1'").first().ends == {"natural person": 1, "below threshold": 1}


def test_folders_that_are_not_shared_are_refused():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        iterate.shared_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="checkpoint"):
        iterate.shared_dir(Session)


def test_tables_can_be_dropped(spark):
    table = iterate.cut(spark.range(10))
    files = table.inputFiles()
    iterate.dropped(table)
    assert files and not spark._jvm.java.io.File(files[0].removeprefix("file://")).exists()


def test_places_in_order(spark):
    rng = random.Random(4)
    values = [rng.randrange(50) for _ in range(300)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(5)
    got = sorted((r.place, r.v, r.i, r.total) for r in iterate.placed(rows, F.col("v"), F.col("i")).collect())
    assert [g[1:3] for g in got] == sorted(zip(values, range(300), strict=True)) and [g[0] for g in got] == list(range(1, 301)) and got[0][3] == 300
