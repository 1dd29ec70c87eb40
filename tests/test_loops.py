"""Loop parameters and hybrid weights against sums over all ways to pair."""

import math
import random

import numpy as np
import pytest

from basinforge.functions import energy, loops
from basinforge.functions.sequence import PAIRS
from basinforge.operators import hybrid
from basinforge.sources import readers

ROWS = [
    ("bulge", "1", 330), ("bulge", "2", 280), ("interior", "2", 110), ("interior", "3", 160), ("asymmetry", "each", 60), ("asymmetry", "most", 100), ("stacked_bulge", "", 1),
    ("terminal", "AU", 50), ("terminal", "UA", 45), ("terminal", "GU", 40), ("mismatch", "CGAA", -80), ("mismatch", "GCUG", -30), ("mismatch", "AUGA", 20), ("stack", "CGCG", -300),
]


def loop_energy(a, b, k1, k2, j1, j2, rows):
    """One loop by the parameters' definitions, positions from 1."""
    held = {(kind, key): v for kind, key, v in rows}
    d1, d2 = j1 - k1, j2 - k2
    first, second, n = a[k1 - 1] + b[k2 - 1], a[j1 - 1] + b[j2 - 1], d1 + d2 - 2
    stack = held.get(("stack", first + second), energy.stack_table()[first + second])

    def size(kind, step):
        given = [int(x) for k, x in held if k == kind]
        if n in given:
            return held[kind, str(n)]
        return held[kind, str(max(given))] + step * (n - max(given)) if given and n > max(given) else 100 + step * n

    if n == 0:
        return stack
    if d1 == 1 or d2 == 1:
        if n == 1:
            return size("bulge", 70) + (stack if held.get(("stacked_bulge", "")) else 0)
        return size("bulge", 70) + held.get(("terminal", first), 0) + held.get(("terminal", second), 0)
    uneven = min(held.get(("asymmetry", "most"), 1 << 30), held.get(("asymmetry", "each"), 50) * abs(d1 - d2))
    return size("interior", 20) + uneven + held.get(("mismatch", first + a[k1] + b[k2]), 0) + held.get(("mismatch", second[::-1] + b[j2 - 2] + a[j1 - 2]), 0)


def paths(a, b, i1, i2, most, loop=6):
    """All chains of pairs from a left end, as lists."""
    out, todo = [], [[(i1, i2)]]
    while todo:
        chain = todo.pop()
        out.append(chain)
        k1, k2 = chain[-1]
        for j1 in range(k1 + 1, min(len(a), i1 + most - 1) + 1):
            for j2 in range(k2 + 1, min(len(b), i2 + most - 1) + 1):
                if j1 - k1 + j2 - k2 - 2 <= loop and a[j1 - 1] + b[j2 - 1] in PAIRS:
                    todo.append(chain + [(j1, j2)])
    return out


@pytest.mark.parametrize("rows", [[], ROWS])
def test_hybrid_weights_are_sums_over_all_chains(rows):
    rng = random.Random(7)
    a, b = ("".join(rng.choice("ACGU") for _ in range(n)) for n in (11, 9))
    spec, rt = hybrid.HybridSpec(most=6, difference=3, table=loops.LoopTable.from_rows(rows)), energy.thermal_energy()
    lefts = [(i, j) for i in range(1, 12) for j in range(1, 10) if a[i - 1] + b[j - 1] in PAIRS]
    batch = hybrid.HybridBatch([(a, b)] * len(lefts), lefts, spec).run()
    found, given = {}, {}
    for left, x, y, q in zip(*batch.sites()):
        found[*lefts[left], lefts[left][0] + int(x), lefts[left][1] + int(y)] = q
    for left, x, y, u1, u2, q in zip(*batch.conditional()):
        given[*lefts[left], lefts[left][0] + int(x), lefts[left][1] + int(y), int(u1), int(u2)] = q
    want, ends = {}, {}
    for i1, i2 in lefts:
        for chain in paths(a, b, i1, i2, spec.most):
            j1, j2 = chain[-1]
            if abs((j1 - i1) - (j2 - i2)) > spec.difference:
                continue
            w = math.exp(-sum(loop_energy(a, b, *k, *j, rows) for k, j in zip(chain, chain[1:])) / 100 / rt)
            want[i1, i2, j1, j2] = want.get((i1, i2, j1, j2), 0.0) + w
            if len(chain) > 1:
                for u1 in range(j1 - chain[-2][0]):
                    for u2 in range(j2 - chain[-2][1]):
                        ends[i1, i2, j1, j2, u1, u2] = ends.get((i1, i2, j1, j2, u1, u2), 0.0) + w
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    assert given.keys() == ends.keys() and all(given[k] == pytest.approx(ends[k]) for k in ends)


def test_left_ends_are_right_ends_of_turned_strands(spark):
    a, b = "GGACUCGAUC", "CCUGAGCUAG"
    runs = spark.createDataFrame([(5, a, b)], "run_id long, seq_a string, seq_b string")
    lefts = spark.createDataFrame([(5, i, j) for i in range(1, 11) for j in range(1, 11) if a[i - 1] + b[j - 1] in PAIRS], "run_id long, i1 int, i2 int")
    spec, rt = hybrid.HybridSpec(most=5, table=loops.LoopTable.from_rows(ROWS)), energy.thermal_energy()
    want = {}
    for r in lefts.collect():
        for chain in paths(a, b, r.i1, r.i2, spec.most):
            if len(chain) > 1:
                w = math.exp(-sum(loop_energy(a, b, *k, *j, ROWS) for k, j in zip(chain, chain[1:])) / 100 / rt)
                for u1 in range(chain[1][0] - r.i1):
                    for u2 in range(chain[1][1] - r.i2):
                        key = (r.i1, r.i2, *chain[-1], u1, u2)
                        want[key] = want.get(key, 0.0) + w
    found = {(r.i1, r.i2, r.j1, r.j2, r.u1, r.u2): r.q for r in hybrid.conditional_hybrid(runs, lefts, spec, left=True).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_parameter_rows():
    table = loops.LoopTable.from_rows([("bulge", "3", 500), ("stacked_bulge", "", 0)], loop=6)
    assert table.bulge[3] == 500 and table.bulge[5] == 500 + 2 * 70 and table.bulge[1] == 170 and not table.stacked_bulge
    for bad in (("stack", "ACG", 1), ("bulge", "0", 1), ("loop", "", 1), ("terminal", "XY", 1)):
        with pytest.raises(ValueError):
            loops.LoopTable.from_rows([bad])
    assert np.array_equal(loops.codes("ACGUN."), [0, 1, 2, 3, 4, 4])


def test_parameter_file(spark, tmp_path):
    (tmp_path / "loops.tsv").write_text("bulge\t1\t330\nterminal\tAU\t50\nstacked_bulge\t\t1\n")
    table = readers.loop_table(spark, str(tmp_path / "loops.tsv"))
    assert table.bulge[1] == 330 and table.terminal[0, 3] == 50 and table.stacked_bulge
