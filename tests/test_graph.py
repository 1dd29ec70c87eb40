"""Graphs and Markov chains: closed forms, conservation and agreement of methods."""

import numpy as np
import pytest

from basinforge.operators import ctmc, graph


def random_graph(n, seed, density=0.5):
    rng = np.random.default_rng(seed)
    z = np.exp(rng.normal(0, 2, n))
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < density), 1)
    w += np.triu(np.diag(np.full(n - 1, 0.1), 1))
    return z, w + w.T


def tables(spark, z, w, run=0):
    nodes = spark.createDataFrame([(run, i, float(x)) for i, x in enumerate(z)], "run_id long, b long, z double")
    edges = spark.createDataFrame([(run, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.triu(w, 1)))], "run_id long, a long, b long, w double")
    return nodes, edges


def sparse(w):
    return [{j: v for j, v in enumerate(row) if v > 0} for row in w.tolist()]


def in_turn(z, w, goes, min_rate=0.0, min_part=1e-3):
    """Elimination on full matrices, step by step from its definition: z, w, shares."""
    z, w, n, z0 = z.copy(), w.copy(), len(z), z.copy()
    part = np.eye(n)
    for x in sorted(range(n), key=lambda x: (z0[x], x)):
        for y in range(n):
            if w[x, y] and w[x, y] / min(z[x], z[y]) < min_rate:
                w[x, y] = w[y, x] = 0
        out = w[x].sum() - w[x, x]
        if not goes(x, z, out):
            part[x][part[x] < min_part] = 0
            continue
        f = w[x] / out
        f[x] = 0
        z = z + f * z[x]
        z[x] = 0
        for p in np.flatnonzero(f):
            for q in np.flatnonzero(f):
                if q <= p:
                    new = w[p, q] + w[x, p] * f[q] + w[x, q] * f[p] + w[x, x] * f[p] * f[q]
                    if new / min(z[p], z[q]) >= min_rate:
                        w[p, q] = w[q, p] = new
            kept = part[x] * f[p]
            part[p] += np.where(kept >= min_part / n, kept, 0)
        w[x], w[:, x], part[x] = 0, 0, 0
    return z, w, part


def as_arrays(n, z, near, parts):
    w, share = np.zeros((n, n)), np.zeros((n, n))
    for out, rows in ((w, near), (share, parts)):
        for i, row in enumerate(rows):
            out[i, list(row)] = list(row.values())
    return z, w, share


@pytest.mark.parametrize("seed, min_rate, max_outflow", [(1, 0.0, 1e6), (2, 0.0, 0.3), (3, 0.02, 1e6), (4, 0.05, 0.5), (5, 0.0, 1e6)])
def test_elimination_against_full_matrices(seed, min_rate, max_outflow):
    z, w = random_graph(14, seed)
    w[2, 2] = 0.3  # a self-transition that is there from the start
    limits = graph.PruneLimits(max_outflow, 0.05, min_rate)
    total = z.sum()
    want = in_turn(z, w, lambda x, z, out: x != 0 and (z[x] / total < 0.05 or out / z[x] > max_outflow), min_rate)
    kept, *got = graph.eliminate(z, sparse(w), limits)
    for ours, theirs in zip(as_arrays(14, *got), want):
        assert np.allclose(ours, theirs)
    assert kept.tolist() == np.flatnonzero(want[0]).tolist()


def test_five_basins_of_which_two_go():
    """Paths from a neighbour to itself make self-transitions, which later turns count."""
    z = np.array([5.0, 4.0, 3.0, 1.0, 2.0])
    w = np.zeros((5, 5))
    for a, b, v in ((0, 1, 0.3), (0, 3, 0.2), (1, 3, 0.5), (2, 3, 0.4), (3, 4, 0.6), (2, 4, 0.7), (1, 4, 0.1)):
        w[a, b] = w[b, a] = v
    _, got, near, _ = graph.eliminate(z, sparse(w), graph.PruneLimits(), keep={0, 1, 2})
    f = w[3] / w[3].sum()
    one = w + np.outer(w[3], f) + np.outer(f, w[3])
    one[3], one[:, 3] = 0, 0
    g = one[4].copy()
    own, g[4] = g[4], 0
    h = g / g.sum()
    two = one + np.outer(g, h) + np.outer(h, g) + own * np.outer(h, h)
    assert own > 0
    for x in range(3):
        for y in range(3):
            assert near[x].get(y, 0.0) == pytest.approx(two[x, y])


def test_a_sum_below_the_least_rate_leaves_the_old_edge():
    z = np.array([1.0, 1.0, 10.0])  # both have had their turn when the third goes
    w = np.array([[0, 0.1, 0.1], [0.1, 0, 0.1], [0.1, 0.1, 0]])
    _, _, near, _ = graph.eliminate(z, sparse(w), graph.PruneLimits(min_rate=0.05), keep={0, 1})
    assert near[0][1] == 0.1 and 0 not in near[0]


def test_dissolution_by_joins(spark):
    z, w = random_graph(8, 1)
    nodes, edges = tables(spark, z, w)
    n2, e2 = nodes.drop("run_id"), edges.drop("run_id")
    for gone in (3, 5):
        n2, e2 = graph.dissolve(n2, e2, gone)
    one = in_turn(np.where(np.arange(8) == 3, 1e-9, z), w, lambda x, *_: x == 3)
    f = w[3] / w[3].sum()
    z1 = np.where(np.arange(8) == 3, 0, z + f * z[3])
    g = np.where(np.arange(8) == 5, 0, one[1][5])
    h = g / g.sum()
    two = one[1] + np.outer(g, h) + np.outer(h, g) + one[1][5, 5] * np.outer(h, h)
    made = {(r.a, r.b): r.w for r in e2.collect()}
    for r in n2.collect():
        assert r.z == pytest.approx(z1[r.b] + h[r.b] * z1[5])
    for a in range(8):
        for b in range(a, 8):
            if not {a, b} & {3, 5}:
                assert made.get((a, b), 0.0) == pytest.approx(two[a, b])


@pytest.mark.parametrize("keep", [None, (0, 2, 9)])
def test_rounds_give_what_turns_give(spark, keep):
    first, second = random_graph(14, 6, 0.2), random_graph(10, 7, 0.15)
    (n1, e1), (n2, e2) = tables(spark, *first), tables(spark, *second, run=1)
    nodes, edges = n1.unionByName(n2), e1.unionByName(e2)
    limits = graph.PruneLimits(max_outflow=0.6, min_share=0.04)
    key = lambda df: {(r.run_id, r.kind, r.a, r.b): r.value for r in df.collect()}
    ours, theirs = key(graph.prune_in_rounds(nodes, edges, limits, keep)), key(graph.prune(nodes, edges, limits, keep=keep))
    assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(theirs[k]) for k in ours)


def test_basins_without_neighbours_go_with_their_weight(spark):
    nodes = spark.createDataFrame([(0, 0, 5.0), (0, 1, 1.0), (0, 2, 0.1)], "run_id long, b long, z double")
    edges = spark.createDataFrame([(0, 0, 1, 0.5)], "run_id long, a long, b long, w double")
    for found in (graph.prune(nodes, edges, keep=(0,)), graph.prune_in_rounds(nodes, edges, keep=(0,))):
        assert {(r.kind, r.a): r.value for r in found.collect() if r.kind == "node"} == {("node", 0): 6.0}
        assert {(r.kind, r.a, r.b): r.value for r in found.collect() if r.kind == "self"} == {("self", 0, 0): pytest.approx(1.0)}


@pytest.mark.parametrize("seed", range(4))
def test_probabilities(seed):
    z, w = random_graph(12, seed)
    times = 0.1 * 1.2 ** np.arange(203)
    p = ctmc.probabilities(z, w, times, 0)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p[-1], z / z.sum(), atol=1e-8)
    early = times < 1e3
    assert np.allclose(p[early], ctmc.probabilities(z, w, times[early], 0, mode="expm"), atol=1e-7)
    r = ctmc.generator(z, w)
    assert np.allclose(z[:, None] * r, (z[:, None] * r).T)


def test_absorbing_state():
    z, w = random_graph(6, 9)
    p = ctmc.probabilities(z, w, np.array([0.0, 1.0, 1e6]), 0, absorb=4)
    assert p[0, 0] == pytest.approx(1) and p[2, 4] == pytest.approx(1)


def test_passage_times(spark):
    z, w = random_graph(5, 2)
    r = ctmc.generator(z, w)
    rows = ctmc.passage_times(*tables(spark, z, w)).collect()
    m = np.zeros((5, 5))
    for x in rows:
        m[x.a, x.b] = x.time
    for b in range(5):
        assert np.allclose((r @ m[:, b])[np.arange(5) != b], -1)


def test_solver_table_and_convergence(spark):
    nodes, edges = tables(spark, *random_graph(5, 3), run=7)
    solved = ctmc.solve(nodes, edges)
    assert {r.run_id for r in solved.collect()} == {7}
    ended = ctmc.until_converged(solved, ctmc.stationary(nodes))
    assert 0 < ended.count() < solved.count()


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i, 1.0) for i in range(60)], "b long, z double")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(59) if i != 29], "a long, b long, w double")
    found = {r.b: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert found == {i: 0 if i < 30 else 30 for i in range(60)}


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "b long, z double"), spark.createDataFrame([], "a long, b long, w double")
    assert graph.outflow(nodes, edges).count() == 0 and graph.connected_components(nodes, edges).count() == 0
    assert graph.min_equilibrium_by_number(graph.equilibrium(nodes), 0).first()[0] == 1.0


def test_limits_and_exchange(spark):
    assert graph.strictest([3.0, 2.0], [0.1, 0.2]) == (2.0, 0.2) and graph.strictest([], []) == (float("inf"), 0.0)
    nodes = spark.createDataFrame([(0, 1.0), (1, 2.0), (5, 3.0)], "b long, z double")
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 5, 2.0)], "a long, b long, w double")
    n, e = graph.swap_first_two(nodes, edges)
    assert {r.b: r.z for r in n.collect()} == {1: 1.0, 0: 2.0, 5: 3.0} and {(r.a, r.b): r.w for r in e.collect()} == {(0, 1): 1.0, (1, 5): 2.0}
    one = nodes.where("b = 0")
    assert graph.swap_first_two(one, edges)[0].collect() == one.collect()
    ids, moved = graph.reindex(nodes, edges)
    assert sorted((r.b, r.old) for r in ids.collect()) == [(0, 0), (1, 1), (2, 5)] and (0, 2) in {(r.a, r.b) for r in moved.collect()}


def rows_of(found):
    return {(r.run_id, r.kind, r.a, r.b): r.value for r in found.collect()}


def test_steps_of_a_prune_run(spark):
    z, w = random_graph(9, 11, 0.3)
    (n1, e1), (n2, e2) = tables(spark, z, w), tables(spark, np.array([3.0]), np.zeros((1, 1)), run=1)
    nodes, edges = n1.unionByName(n2), e1.unionByName(e2)
    steps = graph.PruneSteps(graph.PruneLimits(min_share=0.06), prefactor=3.0, keep=(0, 1, 3))
    found = rows_of(graph.prune_run(nodes, edges, steps))
    w = w.copy()
    w[0], w[:, 0] = w[0] * 3, w[:, 0] * 3
    z1, w1, part = in_turn(z, w, lambda x, zz, out: x != 0 and zz[x] / z.sum() < 0.06)
    left = np.flatnonzero(z1)
    order = [left[1], left[0], *left[2:]] if len(left) > 1 else left  # the first two are exchanged
    z2, w2, part = z1[order], w1[np.ix_(order, order)], part[order]
    assert len(order) > 3
    z3, w3, again = in_turn(z2, w2, lambda x, *_: x not in (0, 1, 3))
    kept = np.flatnonzero(z3)
    assert kept.tolist() == [0, 1, 3]
    for new, old in enumerate(kept):
        assert found[0, "node", new, new] == pytest.approx(z3[old])
        for other, second in enumerate(kept):
            if new < other and w3[old, second]:
                assert found[0, "edge", new, other] == pytest.approx(w3[old, second])
    shares = again[kept] @ part
    for (run, kind, a, b), v in found.items():
        if run == 0 and kind == "part":
            assert shares[a, b] == pytest.approx(v)
    assert found[1, "node", 0, 0] == 3.0 and found[1, "part", 0, 0] == 1.0


def test_components_are_connected_or_left_out(spark):
    nodes = spark.createDataFrame([(r, b, z) for r in (0, 1) for b, z in enumerate((4.0, 9.0, 2.0, 5.0, 1.0))], "run_id long, b long, z double")
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 2, 3, 1.0), (1, 0, 4, 0.5)], "run_id long, a long, b long, w double")
    limits = graph.PruneLimits(min_rate=0.01)
    joined = rows_of(graph.prune_run(nodes, edges, graph.PruneSteps(limits, simplify=False)))
    made = {(r, a, b): v for (r, kind, a, b), v in joined.items() if kind == "edge"}
    assert made == {(0, 0, 1): 1.0, (0, 2, 3): 1.0, (0, 0, 3): 0.05, (0, 0, 4): 0.01, (0, 3, 4): 0.01,
                    (1, 1, 4): 0.5, (1, 0, 1): pytest.approx(0.04), (1, 0, 2): 0.02, (1, 0, 3): 0.05, (1, 1, 2): 0.02, (1, 1, 3): pytest.approx(0.04), (1, 2, 3): 0.02}
    first = rows_of(graph.prune_run(nodes, edges, graph.PruneSteps(limits, simplify=False, connect=False)))
    assert {k: v for k, v in first.items() if k[1] == "node"} == {(0, "node", 0, 0): 9.0, (0, "node", 1, 1): 4.0, (1, "node", 0, 0): 9.0}
    assert {k for k in first if k[1] == "part"} == {(0, "part", 0, 1), (0, "part", 1, 0), (1, "part", 0, 1)}


def test_propagation_by_joins_agrees_with_the_eigen_form(spark):
    first, second = random_graph(7, 21, 0.3), random_graph(5, 22)
    (n1, e1), (n2, e2) = tables(spark, *first), tables(spark, *second, run=1)
    alone = spark.createDataFrame([(2, 0, 2.0)], "run_id long, b long, z double")
    times = [0.0, 0.05, 0.3]
    rates = max((w / z[:, None]).sum(axis=1).max() for z, w in (first, second))
    times = [t / rates * 8 for t in times]
    found = {(r.run_id, round(r.t, 12), r.b): r.p for r in ctmc.propagate(n1.unionByName(n2).unionByName(alone), e1.unionByName(e2), times).collect()}
    for run, (z, w) in enumerate((first, second)):
        want = ctmc.probabilities(z, w, np.array(times), 0)
        for k, t in enumerate(times):
            assert np.allclose([found[run, round(t, 12), b] for b in range(len(z))], want[k], atol=1e-8)
    assert all(found[2, round(t, 12), 0] == pytest.approx(1) for t in times)
    with pytest.raises(ValueError):
        ctmc.propagate(n1, e1, [1e6])
    assert ctmc.propagate(n1.limit(0), e1.limit(0), [1.0]).count() == 0 and ctmc.propagate(n1, e1, [0.0], start=77).count() == 0
