"""States of two sites against loops over all pairs, and the invariants of their moves."""

import random

import pytest
from pyspark.sql import functions as F

from basinforge.functions import energy
from basinforge.operators import hybrid, landscape, two_sites
from basinforge.operators.landscape import SECOND, SITE, SiteLimits

A, B = "GCAUGCGCAUGCAAGC", "CGUACGCGUACGUUCG"


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([(0, A, B), (1, A[::-1], B), (2, "ACG", "UGC")], "run_id long, seq_a string, seq_b string")


def test_pairs_in_order_are_all_pairs_and_no_others(spark):
    rng = random.Random(6)
    left = [(rng.randrange(3), k, rng.choice([1, 2, 7, 8, 63, 64, 65, rng.randrange(1, 3000)])) for k in range(120)]
    right = [(rng.randrange(3), k, rng.choice([1, 2, 8, 64, 66, rng.randrange(1, 3000), 65535])) for k in range(120)]
    x = spark.createDataFrame(left, "run_id long, a long, upto int")
    y = spark.createDataFrame(right, "run_id long, b long, start int")
    found = [(r.run_id, r.a, r.b) for r in two_sites.in_order(x, y, F.col("upto") + 3, "start").collect()]
    want = [(r, a, b) for r, a, u in left for s, b, t in right if r == s and t >= u + 3]
    assert sorted(found) == sorted(want)


@pytest.fixture(scope="module")
def limits():
    return SiteLimits(most=5, distance=4)


@pytest.fixture(scope="module")
def ranked(runs, limits):
    sites = landscape.enumerate_sites(runs, limits)
    return two_sites.states(runs, sites, two_sites.double_states(sites, limits)).cache()


def test_states(runs, limits, ranked):
    sites = [tuple(r) for r in landscape.enumerate_sites(runs, limits).select("run_id", *SITE, "hybrid", "energy").collect()]
    want = {(r.run_id, *[None] * 8, 0, -energy.DUPLEX_INIT) for r in runs.collect()}
    want |= {(*s[:5], *[None] * 4, *s[5:]) for s in sites}
    gap = limits.distance + 1
    want |= {(*x[:5], *y[1:5], x[5] + y[5], x[6] + y[6]) for x in sites for y in sites if x[0] == y[0] and y[1] >= x[3] + gap and y[2] >= x[4] + gap and x[6] + y[6] <= limits.max_total}
    rows = ranked.collect()
    assert {(r.run_id, *[r[c] for c in (*SITE, *SECOND)], r.hybrid, r.energy) for r in rows} == want and len(rows) == len(want)
    assert any(r.k1 for r in rows)
    for run in (0, 1, 2):
        own = sorted((r for r in rows if r.run_id == run), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and own[0].i1 is None
        assert all(x.energy <= y.energy for x, y in zip(own[1:], own[2:]))


def test_moves(runs, limits, ranked):
    between = two_sites.sites_between(runs, limits)
    edges = two_sites.moves(ranked, between, limits).collect()
    state = {(r.run_id, r["rank"]): tuple(tuple(r[c] for c in site) for site in (SITE, SECOND) if r[site[0]] is not None) for r in ranked.collect()}
    name = {k: n for k, n in enumerate(two_sites.KINDS)}
    seen = {(e.run_id, e.src, e.dst, e.e_ts) for e in edges}
    assert {(r, d, s, t) for r, s, d, t in seen} == seen
    pairs = set()
    for e in edges:
        x, y, kind = state[e.run_id, e.src], state[e.run_id, e.dst], name[e.kind]
        pairs.add((e.run_id, x, y))
        if kind in ("remove", "merge"):
            assert len(x) == len(y) + 1 and (kind == "merge" or set(y) < set(x))
        elif kind in ("new", "new_left", "new_right", "split"):
            assert len(y) == len(x) + 1 and (kind == "split" or set(x) < set(y))
            assert {"new_left": y[1:] == x, "new_right": y[:1] == x}.get(kind, True)
        else:
            changed = [k for k in range(len(x)) if x[k] != y[k]]
            assert len(x) == len(y) and len(changed) == 1
            moved = [c for c in range(4) if x[changed[0]][c] != y[changed[0]][c]]
            assert moved == {"left": [0, 1], "right": [2, 3]}.get(kind.partition("_")[2], moved) and (kind != "shift" or len(moved) == 1)
            assert kind == "shift" or kind.startswith(("first", "second")[changed[0]])
    # every pair of states that differ by a removable site is there, and every pair for shifts
    states = [(run, s) for (run, _), s in state.items()]
    for run, s in states:
        for k, site in enumerate(s):
            if site[2] - site[0] <= 7 and site[3] - site[1] <= 7:
                rest = s[:k] + s[k + 1 :]
                assert (run, s, rest) in pairs or (run, rest) not in states
            for c, step in ((c, step) for c in range(4) for step in (-3, -2, -1, 1, 2, 3)):
                other = s[:k] + (tuple(v + step * (i == c) for i, v in enumerate(site)),) + s[k + 1 :]
                if (run, other) in set(states):
                    assert (run, s, other) in pairs


def test_merging_pays_for_what_lies_between(spark):
    limits = SiteLimits(least=3, most=12, difference=0, distance=0, max_hybrid=10**6, max_total=10**6)
    runs = spark.createDataFrame([(0, "GGGGGGG", "CCCCCCC")], "run_id long, seq_a string, seq_b string")
    sites = landscape.enumerate_sites(runs, limits)
    ranked = two_sites.states(runs, sites, two_sites.double_states(sites, limits)).cache()
    near = two_sites.merge_moves(ranked, two_sites.sites_between(runs, SiteLimits(least=2, most=12, difference=0, distance=0)), limits)
    energies = {r["rank"]: (r.energy, r.hybrid, r.k1) for r in ranked.collect()}
    for e in near.where("kind = 9").collect():
        stacks = energies[e.src][1] + energy.stack_table()["GCGC"]
        assert e.e_ts == energies[e.dst][0] - energies[e.dst][1] + stacks == e.e_dst  # all stacks of the merged site
    assert near.count()


def test_joint_probabilities_replace_independent_ones(runs, limits):
    sites = landscape.enumerate_sites(runs, limits, landscape.model_energies(runs, limits))
    joint = two_sites.JointUnpaired(*hybrid.joint_windows(runs, limits.most, limits.least, limits.distance))
    ours = {tuple(r[:9]): (r.hybrid, r.energy) for r in two_sites.double_states(sites, limits, joint).collect()}
    plain = {tuple(r[:9]): (r.hybrid, r.energy) for r in two_sites.double_states(sites, limits).collect()}
    shared = ours.keys() & plain.keys()
    assert shared and all(ours[k][0] == plain[k][0] for k in shared) and any(ours[k][1] != plain[k][1] for k in shared)
