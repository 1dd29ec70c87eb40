"""Local, conditional and joint unpaired windows against all structures of short strands."""

import math
import random

import pytest

from basinforge.functions import energy
from basinforge.operators import hybrid
from test_landscape import structure_weight, structures

RT = energy.thermal_energy()


def unpaired(seq, *spans, limit=None):
    """Share of the weight of all structures that leave the spans unpaired."""
    held = {k for i, j in spans for k in range(i, j + 1)}
    total = free = 0.0
    for s in structures(seq):
        if limit and any(l - k >= limit for k, l in s):
            continue
        w = structure_weight(seq, s, RT)
        total += w
        free += 0.0 if any(k in held or l in held for k, l in s) else w
    return free / total


@pytest.mark.parametrize("span", [None, 7])
def test_local_windows_against_all_structures(span):
    seq, window = "GGCAUACGAUGCC", 9
    n = len(seq)
    for i, j, p in hybrid.local_unpaired_windows(seq, 3, window, span):
        each = [unpaired(seq[s - 1 : s - 1 + window], (i - s + 1, j - s + 1), limit=span) for s in range(max(1, j - window + 1), min(i, n - window + 1) + 1)]
        assert p == pytest.approx(sum(each) / len(each), abs=1e-12)


def test_whole_strand_is_one_stretch():
    rng = random.Random(3)
    for n in (1, 4, 5, 30, 47):
        seq = "".join(rng.choice("ACGU.") for _ in range(n))
        for span in (None, 9):
            ours, theirs = hybrid.local_unpaired_windows(seq, 6, n, span), hybrid.unpaired_windows(seq, 6, span=span)
            assert [x[:2] for x in ours] == [x[:2] for x in theirs]
            assert all(math.isclose(x[2], y[2], rel_tol=1e-9) for x, y in zip(ours, theirs))
    assert hybrid.local_unpaired_windows("", 3, 5) == []


def test_ten_thousand_letters_within_memory():
    import tracemalloc

    rng = random.Random(4)
    seq = "".join(rng.choice("ACGU") for _ in range(10_000))
    tracemalloc.start()
    found = hybrid.local_unpaired_windows(seq, 4, 80, 40)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert len(found) == 4 * 10_000 - 6 and all(0 < p <= 1 + 1e-9 for *_, p in found)
    part = {x[:2]: x[2] for x in hybrid.local_unpaired_windows(seq[:400], 4, 80, 40)}
    assert all(math.isclose(p, part[i, j], rel_tol=1e-9) for i, j, p in found if j <= 300)


def test_conditional_windows_against_all_structures():
    seq = "GGCAUACGAUGCCA"
    found = hybrid.conditional_windows(seq, 3, least=2, distance=1)
    assert found and all(k > j + 1 and 2 <= l - k + 1 <= 3 and 2 <= j - i + 1 <= 3 for i, j, k, l, _ in found)
    assert len({x[:4] for x in found}) == len(found)
    for i, j, k, l, p in random.Random(1).sample(found, 40):
        assert p == pytest.approx(unpaired(seq, (i, j), (k, l)) / unpaired(seq, (i, j)), abs=1e-12)


def test_joint_windows_on_both_strands(spark):
    a, b = "GGCAUACGAUGCCA", "CCGUAUGCUACGG"  # the second from its 3' end
    runs = spark.createDataFrame([(1, a, b), (2, "ACG", "ACG")], "run_id long, seq_a string, seq_b string")
    first, second = hybrid.joint_windows(runs, 3, 3, 2)
    rows = [(a, r) for r in first.collect()], [(b[::-1], r) for r in second.collect()]
    for strand, r in rows[0]:
        assert r.p == pytest.approx(unpaired(strand, (r.i, r.j), (r.k, r.l)))
    n = len(b)
    for strand, r in rows[1]:
        assert r.j < r.k and r.p == pytest.approx(unpaired(strand, (n - r.j + 1, n - r.i + 1), (n - r.l + 1, n - r.k + 1)))
    assert {r.run_id for _, r in rows[0] + rows[1]} == {1} and len(rows[0]) == 7 * 8 // 2
