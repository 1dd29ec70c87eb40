"""Base pairs as events of states, basins and final states, against plain sums."""

import math

import numpy as np
import pytest

from basinforge.functions import energy
from basinforge.operators import ctmc, events, landscape
from basinforge.plans import registry
from test_landscape import structure_weight, structures

A, B = "GGGAAAACCCU", "GCGCAAAAGCGC"
RT = energy.thermal_energy()


def given(seq, region):
    """{(k, l): p} of a strand whose region is unpaired."""
    held = set(range(region[0], region[1] + 1)) if region else set()
    kept = [(s, structure_weight(seq, s, RT)) for s in structures(seq) if not held & {x for pair in s for x in pair}]
    total = sum(w for _, w in kept)
    out = {}
    for s, w in kept:
        for pair in s:
            out[pair] = out.get(pair, 0.0) + w / total
    return out


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([(4, A, B[::-1])], "run_id long, seq_a string, seq_b string")


@pytest.fixture(scope="module")
def states(spark):
    rows = [(4, 0, None, None, None, None, -410), (4, 1, 2, 3, 4, 5, -300), (4, 2, 2, 1, 4, 4, -100), (4, 3, 9, 9, 11, 12, 0)]
    return spark.createDataFrame(rows, "run_id long, rank long, i1 int, i2 int, j1 int, j2 int, energy long")


def by_state(states):
    n, out = len(B), {}
    for r in states.collect():
        first, second = (None, None) if r.i1 is None else ((r.i1, r.j1), (n - r.j2 + 1, n - r.i2 + 1))
        out[r["rank"]] = {("a", k, l): p for (k, l), p in given(A, first).items()} | {("b", k, l): p for (k, l), p in given(B, second).items()}
    return out


def test_pairs_given_states(runs, states):
    found = {}
    for r in events.pair_events(states, runs, threshold=0.01).collect():
        found.setdefault(r["rank"], {})[r.strand, r.i, r.j] = r.p
    for rank, want in by_state(states).items():
        want = {k: p for k, p in want.items() if p >= 0.01}
        assert found.get(rank, {}) == {k: pytest.approx(p) for k, p in want.items()}


def test_events_of_basins_and_final_states_over_time(spark, runs, states):
    members = spark.createDataFrame([(4, 0, 0), (4, 1, 1), (4, 2, 1), (4, 3, 0)], "run_id long, rank long, basin long")
    weight = {r["rank"]: math.exp(-r.energy / 100 / RT) for r in states.collect()}
    z = {0: weight[0] + weight[3], 1: weight[1] + weight[2]}
    basins = spark.createDataFrame([(4, b, v) for b, v in z.items()], "run_id long, basin long, z double")
    parts = spark.createDataFrame([(4, 0, 0, 0.9), (4, 0, 1, 0.2), (4, 1, 1, 0.8), (4, 1, 0, 0.1)], "run_id long, coarse long, fine long, part double")
    own = by_state(states)
    found = events.basin_events(events.pair_events(states, runs, 0.0), members, states)
    basin = {b: {} for b in z}
    for rank, b in ((0, 0), (1, 1), (2, 1), (3, 0)):
        for k, p in own[rank].items():
            basin[b][k] = basin[b].get(k, 0.0) + p * weight[rank] / z[b]
    got = {}
    for r in found.collect():
        got.setdefault(r.basin, {})[r.strand, r.i, r.j] = r.p
    assert got == {b: {k: pytest.approx(p) for k, p in v.items()} for b, v in basin.items()}
    final = events.final_events(found, parts, basins)
    share = {(c, f): p for c, f, p in ((0, 0, 0.9), (0, 1, 0.2), (1, 1, 0.8), (1, 0, 0.1))}
    total = {c: sum(share[c, f] * z[f] for f in z) for c in (0, 1)}
    kinetics = spark.createDataFrame([(4, 1.0, 0, 0.25), (4, 1.0, 1, 0.75), (4, 2.0, 0, 1.0)], "run_id long, t double, b long, p double")
    want = {}
    for t, ps in ((1.0, (0.25, 0.75)), (2.0, (1.0, 0.0))):
        for c in (0, 1):
            for f in z:
                for k, p in basin[f].items():
                    want[t, *k] = want.get((t, *k), 0.0) + ps[c] * share[c, f] * z[f] / total[c] * p
    over = {(r.t, r.strand, r.i, r.j): r.p for r in events.paired_over_time(kinetics, final).collect()}
    assert over == {k: pytest.approx(p) for k, p in want.items() if p}
    assert {r.i for r in events.of_strand(final, "b").collect()} == {k[1] for v in basin.values() for k in v if k[0] == "b"}


def test_relevant_states_are_cut_at_every_step(spark, states):
    members = spark.createDataFrame([(4, 0, 0), (4, 1, 1), (4, 2, 1), (4, 3, 0)], "run_id long, rank long, basin long")
    basins = spark.createDataFrame([(4, 0, 1.0), (4, 1, 1.0)], "run_id long, basin long, z double")
    parts = spark.createDataFrame([(4, 0, 0, 1.0), (4, 1, 1, 1.0)], "run_id long, coarse long, fine long, part double")
    most = spark.createDataFrame([(4, 0, 0.5), (4, 1, 0.009)], "run_id long, b long, p double")
    found = {r["rank"]: r.p for r in events.relevant_states(most, parts, basins, members, states).collect()}
    assert found.keys() == {0} and found[0] == pytest.approx(0.5, abs=0.01)  # the other state of its basin has less than a hundredth


def test_events_of_all_states_are_those_without_a_threshold(spark, runs, states):
    members = spark.createDataFrame([(4, 0, 0), (4, 1, 1), (4, 2, 1), (4, 3, 0)], "run_id long, rank long, basin long")
    basins = landscape.basin_summary(states, members)
    found, want = (
        {(r.basin, r.strand, r.i, r.j): r.p for r in df.collect()}
        for df in (events.whole_basin_events(basins, members, states, runs), events.basin_events(events.pair_events(states, runs, 0.0), members, states))
    )
    assert found == {k: pytest.approx(p, rel=1e-9) for k, p in want.items()} and min(found.values()) < 0.01


def test_events_solved_with_their_run(spark):
    """As the join of probabilities over time with events; a run without events and one of a single basin, too."""
    nodes = spark.createDataFrame([(1, 0, 3.0), (1, 4, 1.0), (1, 7, 0.5), (2, 0, 1.0), (2, 1, 2.0), (3, 5, 2.0)], "run_id long, b long, z double")
    edges = spark.createDataFrame([(1, 0, 4, 0.2), (1, 4, 7, 0.1), (2, 0, 1, 0.3)], "run_id long, a long, b long, w double")
    given = [(1, 4, "a", 1, 6, 0.5), (1, 7, "a", 1, 6, 0.25), (1, 7, "b", 1, 6, 1e-4), (1, 0, "b", 2, 9, 0.75), (3, 5, "a", 1, 6, 0.125)]
    given, spec = spark.createDataFrame(given, "run_id long, b long, strand string, i int, j int, p double"), ctmc.SolveSpec(end=50.0)
    found, want = (
        {(r.run_id, r.t, r.strand, r.i, r.j): r.p for r in df.collect()}
        for df in (ctmc.solve_events(nodes, edges, given, spec), events.paired_over_time(ctmc.solve(nodes, edges, spec), given))
    )
    assert {k[0] for k in found} == {1, 3} and found == {k: pytest.approx(p) for k, p in want.items()}


def test_paired_over_time_leaves_no_state_out(spark, tmp_path):
    """From all states of the run and all structures of its strands, with states that only hold much on the way, and pairs rarer than a hundredth."""
    at = str(tmp_path)
    a, b = "GGGAUUCCACA", "GUCCUACCUC"
    first, second = (x.translate(str.maketrans("ACGU", "ABCD")) for x in (a, b))  # names become strands
    spark.createDataFrame([(7, first, 3)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(3, second, 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    run = registry.B.runs(spark, at)
    assert tuple(run.select("seq_a", "seq_b").first()) == (a, b)
    ranked, edges, members = registry._basins(run)
    basin = {r["rank"]: r.basin for r in members.collect()}
    ids, n = sorted(set(basin.values())), len(b)
    z, w = np.zeros(len(ids)), np.zeros((len(ids), len(ids)))
    given_basin = [{} for _ in ids]
    for r in ranked.collect():
        v, k = math.exp(-r.energy / 100 / RT), ids.index(basin[r["rank"]])
        z[k] += v
        first, second = (None, None) if r.i1 is None else ((r.i1, r.j1), (n - r.j2 + 1, n - r.i2 + 1))
        for strand, seq, region in (("a", a, first), ("b", b[::-1], second)):
            for pair, p in given(seq, region).items():
                given_basin[k][strand, *pair] = given_basin[k].get((strand, *pair), 0.0) + v * p
    for r in edges.where("dst < src").collect():
        x, y = ids.index(basin[r.src]), ids.index(basin[r.dst])
        if x != y:
            w[x, y] += math.exp(-max(r.e_src, r.e_dst, r.e_ts) / 100 / RT)
    times = 0.1 * 1.2 ** np.arange(76)
    over = ctmc.probabilities(z, w + w.T, times, 0)
    keys = sorted(set().union(*given_basin))
    want = over @ np.array([[g.get(k, 0.0) / z[x] for k in keys] for x, g in enumerate(given_basin)])
    found = {(r.t, r.strand, r.i, r.j): r.p for r in registry.QUERIES["paired_over_time"](spark, at).collect()}
    assert found == {(round(float(t), 6), *k): pytest.approx(want[x, y], abs=2e-6) for x, t in enumerate(times) for y, k in enumerate(keys)}
    share = z / z.sum()
    assert ((share < 0.01) & (over.max(axis=0) >= 0.01)).any() and min(found.values()) < 0.01
