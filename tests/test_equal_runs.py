"""Runs with the same strands share one landscape, and no table of states is broadcast for the size of its files."""

import pytest

from basinforge.operators import landscape
from basinforge.operators.landscape import SiteLimits
from basinforge.plans import registry

NAMES = {2: "Supplier#000000043", 0: "Supplier#000000043", 5: "Supplier#000000005", 9: "Supplier#000000043", 7: None, 8: None}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("runs"))
    spark.createDataFrame([(k, n, 3) for k, n in NAMES.items()], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(3, "NATION_3", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(1, "AMERICA")], "r_regionkey int, r_name string").write.parquet(f"{at}/region.parquet")
    return at


def rows_of(df, run):
    return sorted(map(repr, (tuple(v for c, v in r.asDict().items() if c != "run_id") for r in df if r.run_id == run)))


def test_different_runs(spark):
    runs = spark.createDataFrame([(4, "A", "C"), (3, "A", "C"), (1, "C", "A"), (9, None, "C"), (8, None, "C")], "run_id long, seq_a string, seq_b string")
    different, same = landscape.different_runs(runs)
    assert {tuple(r) for r in different.collect()} == {(3, "A", "C"), (1, "C", "A"), (8, None, "C")}
    assert {tuple(r) for r in same.collect()} == {(3, 3), (4, 3), (1, 1), (8, 8), (9, 8)}
    given = landscape.of_every_run(spark.createDataFrame([("x", 3), ("y", 3), ("z", 8)], "v string, run_id long"), same)
    assert given.columns == ["v", "run_id"]
    assert sorted(map(tuple, given.collect())) == [("x", 3), ("x", 4), ("y", 3), ("y", 4), ("z", 8), ("z", 9)]


@pytest.mark.parametrize("name", ["movable_states", "basin_kinetics", "two_site_moves", "two_site_basins", "moves_new_site", "paired_over_time"])
def test_equal_strands_equal_rows(spark, folder, name, monkeypatch):
    seen = []
    whole = landscape.enumerate_sites
    monkeypatch.setattr(landscape, "enumerate_sites", lambda runs, *more, **named: (seen.append(runs), whole(runs, *more, **named))[1])
    found = registry.QUERIES[name](spark, folder).collect()
    assert seen[0].count() == 3  # six runs of three different pairs
    assert rows_of(found, 0) == rows_of(found, 2) == rows_of(found, 9) and rows_of(found, 0)
    assert rows_of(found, 7) == rows_of(found, 8)


def test_states_are_not_broadcast(spark, folder):
    plan = registry.QUERIES["movable_states"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 3


def test_longer_sites_by_cells(spark):
    """Sites longer than the reach of a move: the same edges with cells as without."""
    runs = spark.createDataFrame([(1, "GGGAAACCCUUUGGGCC", "CCCUUUGGGAAACCC")], "run_id long, seq_a string, seq_b string")
    limits = SiteLimits(most=14, unpaired_in_loop=2, max_hybrid=10**6, max_total=10**6)
    ranked = landscape.rank_states(landscape.with_open_state(runs, landscape.enumerate_sites(runs, limits))).cache()
    found = {(r.src, r.dst, r.kind) for r in landscape.moves(ranked, limits).where("kind < 3").collect()}
    at = {r["rank"]: (r.i1, r.i2, r.j1, r.j2) for r in ranked.where("i1 is not null").collect()}
    far, near, expected = 3, 1, set()
    for a, x in at.items():
        for b, y in at.items():
            d = [y[0] - x[0], y[1] - x[1], x[2] - y[2], x[3] - y[3]]
            for kind, k in ((0, 0), (1, 2)):
                if d[2 - k] == d[3 - k] == 0 and 1 <= d[k] <= far and 1 <= d[k + 1] <= far:
                    expected |= {(a, b, kind), (b, a, kind)}
            if sum(map(abs, d)) == max(d) and 1 <= max(d) <= near:
                expected |= {(a, b, 2), (b, a, 2)}
    assert found == expected and expected
