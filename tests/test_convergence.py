"""Runs end in the kernel at the time at which they are stationary."""

from basinforge.operators import ctmc


def test_ends_with_convergence(spark):
    nodes = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 1.0)], "run_id long, b long, z double")
    edges = spark.createDataFrame([(1, 0, 1, 0.3)], "run_id long, a long, b long, w double")
    cut = ctmc.solve(nodes, edges, ctmc.SolveSpec(tolerance=5e-3)).collect()
    later = ctmc.until_converged(ctmc.solve(nodes, edges, ctmc.SolveSpec()), ctmc.stationary(nodes)).collect()
    assert sorted(map(tuple, cut)) == sorted((r.run_id, r.t, r.b, r.p) for r in later)
