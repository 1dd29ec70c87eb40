"""Checks of states that are read, over partitions and runs."""

import random

from basinforge.operators import checks, lineage
from basinforge.operators.landscape import SiteLimits

SCHEMA = "run_id long, line long, i1 int, i2 int, j1 int, j2 int, k1 int, k2 int, l1 int, l2 int, energy double"


def test_previous_values_across_partitions(spark):
    rng = random.Random(5)
    rows = [(k % 3 if k < 400 else 9, k * 2, rng.random()) for k in range(900)]
    df = spark.createDataFrame(rows, "g long, k long, v double").repartition(11)
    got = {(r.g, r.k): r.before for r in lineage.with_previous(df, "g", "k", "v", "before").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == g)
        want |= {(g, r[1]): (own[n - 1][2] if n else None) for n, r in enumerate(own)}
    assert got == want


def test_errors(spark):
    runs = spark.createDataFrame([(1, "ACGU" * 6, "ACGU" * 6)], "run_id long, seq_a string, seq_b string")
    none = [None] * 4
    rows = [
        (1, 1, *none, *none, -4.1), (1, 2, 1, 1, 3, 3, *none, -3.0), (1, 3, 2, 2, 4, 4, *none, -3.0000005), (1, 4, 2, 2, 4, 5, *none, -3.1), (1, 5, 2, 2, 3, 4, *none, -3.0),
        (1, 6, 1, 1, 3, 3, 10, 10, 12, 12, -9.0), (1, 7, 22, 22, 25, 24, *none, -2.0), (1, 8, 1, 1, 3, 3, 9, 10, 12, 12, -1.0), (1, 9, *none, 1, 1, 3, 3, -0.5), (7, 1, 1, 1, 3, 3, *none, 0.0),
        (1, 10, 5, 1, 7, 3, *none, 5.0),
    ]
    states = spark.createDataFrame(rows, SCHEMA)
    found = lambda **more: sorted((r.run_id, r.line, r.error, r.value) for r in checks.input_errors(states, runs, SiteLimits(), **more).collect())
    assert found() == [(1, 4, "unsorted", -3.0000005), (1, 5, "invalid", None), (1, 7, "invalid", None), (7, 1, "invalid", None)]
    assert found(double=True) == [(1, 4, "unsorted", -3.0000005), (1, 5, "invalid", None), (1, 6, "unsorted", -3.0), (1, 7, "invalid", None), (1, 8, "invalid", None), (7, 1, "invalid", None)]  # the open first site counts as open
    outside = [e[:3] for e in found(regions=((1, 11), (1, 20)), double=True) if e[2] == "outside"]
    assert outside == [(1, 6, "outside"), (1, 7, "outside"), (1, 8, "outside")]
    assert checks.input_errors(states.limit(0), runs).count() == 0
    with_open = sorted(r.line for r in checks.input_errors(states, runs, special_open=False).collect() if r.error == "unsorted")
    assert with_open == [4]
