"""Landscapes against passes over plain Python lists, and their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from basinforge.functions import energy, sequence
from basinforge.functions.sequence import PAIRS
from basinforge.operators import hybrid, landscape
from basinforge.operators.lineage import numbered
from basinforge.plans import bindings
from oracle import TINY


@pytest.fixture(scope="module")
def runs(spark):
    random.seed(4)
    letters = lambda n: "".join(random.choice("ACGU") for _ in range(n))
    rows = [(k, letters(14), letters(10)) for k in range(3)] + [(3, "AAAA", "AAAA"), (4, "", "ACGU")]
    return spark.createDataFrame(rows, "run_id long, seq_a string, seq_b string")


@pytest.fixture(scope="module")
def ranked(runs):
    return landscape.rank_states(landscape.with_open_state(runs, landscape.enumerate_sites(runs))).cache()


def brute_sites(a, b, limits=landscape.SiteLimits()):
    table, out = energy.stack_table(), {}
    pairs = {(i, j) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1) if a[i - 1] + b[j - 1] in PAIRS}
    for i1, i2 in pairs:
        for j1, j2 in pairs:
            d1, d2 = j1 - i1, j2 - i2
            if min(d1, d2) < limits.least - 1 or max(d1, d2) > limits.most - 1 or abs(d1 - d2) > limits.difference:
                continue
            steps = [table.get(a[i1 + k - 1] + b[i2 + k - 1] + a[i1 + k] + b[i2 + k], 0) for k in range(min(d1, d2))]
            hybrid_energy = sum(steps) + 50 * abs(d1 - d2)
            total = hybrid_energy + 10 * (d1 + d2 + 2)
            if hybrid_energy <= limits.max_hybrid and total <= limits.max_total:
                out[i1, i2, j1, j2] = (hybrid_energy, total)
    return out


def test_enumeration(runs, ranked):
    found = {}
    for r in ranked.where("i1 is not null").collect():
        found.setdefault(r.run_id, {})[r.i1, r.i2, r.j1, r.j2] = (r.hybrid, r.energy)
    for run in runs.collect():
        assert found.get(run.run_id, {}) == brute_sites(run.seq_a, run.seq_b)


def test_basins_by_an_ordered_pass(ranked):
    edges = landscape.moves(ranked).collect()
    members = landscape.basin_members(landscape.resolve_parents(landscape.gradient_parents(ranked, landscape.moves(ranked)))).collect()
    got = {(m.run_id, m.rank): m.basin for m in members}
    near = {}
    for e in edges:
        if e.dst < e.src:
            near.setdefault((e.run_id, e.src), []).append((e.e_ts, e.kind, e.dst))
    basin, count = {}, {}
    for s in sorted(ranked.collect(), key=lambda s: (s.run_id, s.rank)):
        best = min(near.get((s.run_id, s.rank), []), default=None)
        if s.rank and best and best[0] <= s.energy:
            basin[s.run_id, s.rank] = basin[s.run_id, best[2]]
        else:
            basin[s.run_id, s.rank] = count.get(s.run_id, 0)
            count[s.run_id] = count.get(s.run_id, 0) + 1
    assert got == basin


def test_moves_go_both_ways(ranked):
    edges = landscape.moves(ranked)
    forth = {(e.run_id, e.src, e.dst, e.e_ts) for e in edges.collect()}
    assert {(r, b, a, t) for r, a, b, t in forth} == forth and forth


def test_hybrid_weights_are_submultiplicative():
    spec = hybrid.HybridSpec(most=7)
    a, b = "GGACUCGAUC", "CCUGAGCUAG"
    q = {}
    for i1 in range(1, 11):
        for i2 in range(1, 11):
            if a[i1 - 1] + b[i2 - 1] in PAIRS:
                q |= {(i1, i2, j1, j2): w for j1, j2, w in hybrid.hybrid_weights(a, b, i1, i2, spec)}
    for (i1, i2, k1, k2), x in q.items():
        for (m1, m2, j1, j2), y in q.items():
            if (m1, m2) == (k1, k2) and (i1, i2, j1, j2) in q:
                assert x * y <= q[i1, i2, j1, j2] * (1 + 1e-9)


def test_interaction_probabilities_at_the_ends(spark, runs):
    q = hybrid.hybrid_partition(runs, landscape.pairable_positions(runs))
    ends = hybrid.interaction_probability(q).where("k1 = i1 and k2 = i2").agg(F.min("p"), F.max("p")).first()
    assert abs(ends[0] - 1) < 1e-9 and abs(ends[1] - 1) < 1e-9


def test_unpaired_windows():
    for seq in ("GGGAAAACCC", "ACGUACGUGGCC", "A"):
        p = {(i, j): v for i, j, v in hybrid.unpaired_windows(seq, 3)}
        assert all(0 < v <= 1 + 1e-12 for v in p.values())
        assert all(p[i, j] <= p[i, i] + 1e-12 and p[i, j] <= p[j, j] + 1e-12 for i, j in p)
    assert all(v == 1 for *_, v in hybrid.unpaired_windows("AAAA", 2))


def test_site_codes(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (300, 5, 32000, 65535)], "i1 int, i2 int, j1 int, j2 int")
    code = df.select("*", sequence.encode_site(*[F.col(c) for c in landscape.SITE]).alias("code"))
    back = code.select(*landscape.SITE, *sequence.decode_site(F.col("code"))).collect()
    assert all(tuple(r[:4]) == tuple(r[4:]) for r in back)


def test_sequence_functions(spark):
    row = spark.createDataFrame([("acgtN",)], "s string").select(sequence.normalize(F.col("s")), sequence.reverse_complement(F.lit("ACGUT")), sequence.is_sequence(F.lit("ACGT")), sequence.is_sequence(F.lit(None).cast("string"))).first()
    assert tuple(row) == ("ACGUN", "AACGU", False, False)


def test_mirror_images(spark):
    runs = spark.createDataFrame([(0, "GCGCAUGC", "CGUACGCG")], "run_id long, seq_a string, seq_b string")
    ranked = landscape.rank_states(landscape.with_open_state(runs, landscape.enumerate_sites(runs)))
    parents = landscape.gradient_parents(ranked, landscape.moves(ranked))
    merged = landscape.merge_symmetric(ranked, parents, runs.select("run_id", F.length("seq_a").alias("n")))
    assert merged.count() == ranked.count() and merged.where("parent > rank").count() == 0


def test_bindings(spark):
    assert bindings.runs(spark, TINY).where("seq_a = '' or seq_b = ''").count() == 0


def structures(seq, least_loop=3):
    """All sets of nested pairs of a strand, as lists of pairs."""

    def of(i, j):
        if j - i < least_loop + 1:
            return [[]]
        out = list(of(i, j - 1))
        for k in range(i, j - least_loop):
            if seq[k - 1] + seq[j - 1] in PAIRS:
                out += [a + b + [(k, j)] for a in of(i, k - 1) for b in of(k + 1, j - 1)]
        return out

    return of(1, len(seq))


def structure_weight(seq, pairs, rt):
    """Each pair costs its closing; a pair right inside another may also stack, as two ways of one structure."""
    import math

    held, w = set(pairs), 1.0
    for k, l in pairs:
        stacked = (k + 1, l - 1) in held
        table = energy.stack_table()
        w *= math.exp(-4.0 / rt) + (math.exp(-table[seq[k - 1] + seq[l - 1] + seq[k] + seq[l - 2]] / 100 / rt) if stacked else 0.0)
    return w


@pytest.mark.parametrize("seq", ["GGGAAAACCC", "GCGCAAAAGCGC", "GGGA.AACCCU", "AAAA"])
def test_folded_pairs_against_all_structures(seq):
    rt = energy.thermal_energy()
    weights = [(s, structure_weight(seq, s, rt)) for s in structures(seq)]
    total = sum(w for _, w in weights)
    want = {}
    for s, w in weights:
        for p in s:
            want[p] = want.get(p, 0) + w / total
    got = {(k, l): p for k, l, p in hybrid.fold_pairs(seq)}
    assert got.keys() == {k for k, v in want.items() if v > 0} and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert abs(hybrid.fold_tables(seq)[0][1, len(seq)] - total) < 1e-9 * total


def test_two_site_moves(spark):
    runs = spark.createDataFrame([(0, "GCAUGCGCAUGCA", "CGUACGCGUACGU")], "run_id long, seq_a string, seq_b string")
    sites = landscape.enumerate_sites(runs, landscape.SiteLimits(most=5)).cache()
    near = landscape.SiteLimits(distance=0, most=5)
    double = landscape.double_states(sites, near).cache()
    assert double.count() and double.where("energy <> hybrid + unpaired or k1 <= j1 or k2 <= j2").count() == 0
    for second in (False, True):
        for left in (False, True):
            site = landscape.SECOND if second else landscape.SITE
            a, b = site[:2] if left else site[2:]
            rows = landscape.grow_shrink_double(double, second, left).collect()
            forth = {(tuple(r[c] for c in (*landscape.SITE, *landscape.SECOND) if c not in (a, b)), r[f"s_{a}"], r[f"s_{b}"], r[f"t_{a}"], r[f"t_{b}"], r.e_ts) for r in rows}
            assert {(k, u, v, x, y, e) for k, x, y, u, v, e in forth} == forth
    merged = landscape.merge_split_saddles(double, landscape.enumerate_sites(runs, landscape.SiteLimits(most=12)), near)
    assert merged.where("k1 <> j1 + 1 or k2 <> j2 + 1").count() == 0


def test_recovery_walks_down(spark):
    ranked = spark.createDataFrame([(0, r, -100 + 10 * r) for r in range(6)], "run_id long, rank int, energy long")
    edges = spark.createDataFrame([(0, r, r - 1, 0, -100 + 10 * r, -110 + 10 * r, -100 + 10 * r) for r in range(1, 6)], "run_id long, src int, dst int, kind int, e_src long, e_dst long, e_ts long")
    members = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 0)], "run_id long, rank int, root int, basin int")
    got = landscape.recover_members(members, ranked, edges, -60).collect()
    assert sorted(r["rank"] for r in got) == [0, 1, 2, 3, 4] and {r.basin for r in got} == {0}


def test_input_modes(spark):
    strands = spark.createDataFrame([(1, "ACGGU", "GGU"), (2, "ACGU", "ACGU")], "run_id long, seq_a string, seq_b string")
    seen = {m: {r.run_id: (r.seq_b, r.same) for r in landscape.input_runs(strands, m).withColumn("same", landscape.is_homodimer(strands)).collect()} for m in ("pair", "homodimer", "antisense")}
    assert seen["pair"] == {1: ("UGG", False), 2: ("UGCA", True)}
    assert seen["homodimer"] == {1: ("UGGCA", True), 2: ("UGCA", True)}
    assert seen["antisense"] == {1: ("UGCCA", False), 2: ("UGCA", True)}
    with pytest.raises(ValueError):
        landscape.input_runs(strands, "both")


def test_windows_by_enumeration():
    """Unpaired windows against refolding with the window closed to pairs, with and without a span."""
    seq = "GGGAAACCCAUGCGCAU"
    n = len(seq)
    for span in (None, 9):
        whole = hybrid.fold_tables(seq, span=span)[0][1, n]
        for i, j, p in hybrid.unpaired_windows(seq, 5, span=span):
            masked = seq[: i - 1] + "." * (j - i + 1) + seq[j:]
            assert abs(p - hybrid.fold_tables(masked, span=span)[0][1, n] / whole) < 1e-12


def test_long_strands_fold_in_seconds():
    rng = random.Random(1)
    assert len(hybrid.unpaired_windows("".join(rng.choice("ACGU") for _ in range(300)), 30)) == 30 * 300 - 435


def test_numbers_across_partitions(spark):
    rng = random.Random(2)
    rows = [(k % 3 if k < 300 else 7, rng.randrange(1000), k) for k in range(1500)]
    df = spark.createDataFrame(rows, "g long, v long, k long").repartition(9)
    got = {(r.g, r.k): r.n for r in numbered(df, "g", [F.col("v"), F.col("k")], "n").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {(g, k): n for n, (_, v, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    assert got == want
