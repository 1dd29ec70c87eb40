"""Steps that all landscapes share move and make nothing twice: enumeration, ranks, folds, probabilities of pairs."""

from basinforge.operators import hybrid, landscape, lineage, two_sites
from basinforge.operators.landscape import SiteLimits

STRANDS = [(1, "GGGAAACCC", "CCCUUUGGG"), (2, "GXGAAAC", "CCUUUGC"), (3, "GG", "CC"), (4, "", "CCC"), (5, "GGG", ""), (6, None, "CCC"), (7, "GGG", None), (8, "GGG", "CCC")]


def runs_of(spark, rows=STRANDS):
    return spark.createDataFrame(rows, "run_id long, seq_a string, seq_b string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sites_need_no_shuffle(spark):
    assert "Exchange" not in plan_of(landscape.enumerate_sites(runs_of(spark)))


def test_sites_from_their_definition(spark):
    from basinforge.functions import energy
    from basinforge.functions.sequence import PAIRS

    limits, stack, expected = SiteLimits(), energy.stack_table(), set()
    for run, a, b in STRANDS:
        n, m = len(a or ""), len(b or "")
        ends = [(x, y) for x in range(n) for y in range(m) if a[x] + b[y] in PAIRS]
        for i1, i2 in ends:
            for j1, j2 in ends:
                d1, d2 = j1 - i1, j2 - i2
                if min(d1, d2) >= limits.least - 1 and max(d1, d2) < limits.most and abs(d1 - d2) <= limits.difference:
                    along = sum(stack.get(a[i1 + k] + b[i2 + k] + a[i1 + k + 1] + b[i2 + k + 1], 0) for k in range(min(d1, d2)))
                    h = along + 50 * abs(d1 - d2)
                    e = h + 10 * (d1 + d2 + 2)
                    if h <= limits.max_hybrid and e <= limits.max_total:
                        expected.add((run, i1 + 1, i2 + 1, j1 + 1, j2 + 1, h, e))
    found = list(map(tuple, landscape.enumerate_sites(runs_of(spark)).collect()))
    assert sorted(found) == sorted(expected) and {r[0] for r in found} == {1, 2, 8}


def test_runs_spread_over_tasks(spark):
    different, _ = landscape.different_runs(runs_of(spark))
    assert different.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    kept = lineage.checkpointed(spark.range(50))
    assert lineage.spread(kept, "id", rows=5).rdd.getNumPartitions() == 10


def test_split_sites_are_not_broadcast(spark):
    plan = plan_of(hybrid.interaction_probability(lineage.checkpointed(spark.createDataFrame([(1, 1, 1, 2, 2, 1.0)], "run_id long, i1 int, i2 int, j1 int, j2 int, q double"))))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_pairs_of_sites_are_made_once(spark, monkeypatch):
    """Ranges are found from a sample, which makes all that is not kept once more."""
    seen = []
    whole = two_sites.numbered
    monkeypatch.setattr(two_sites, "numbered", lambda df, *more: (seen.append(df), whole(df, *more))[1])
    runs = runs_of(spark)
    sites = landscape.enumerate_sites(runs)
    two_sites.states(runs, sites, two_sites.double_states(sites, SiteLimits(distance=0)))
    assert seen and "Scan parquet" in plan_of(seen[0]) and "Generate" not in plan_of(seen[0])


def test_strands_are_folded_once(spark):
    runs = runs_of(spark, [(1, "GGGAAACCCAAA", "CCCUUUGGGAAA")])
    for first, second in (hybrid.joint_windows(runs, 4, 3, 1), hybrid.strand_windows(runs, 4)):
        assert "MapInPandas" not in plan_of(first) + plan_of(second)
        assert first.count() and second.count()


def test_pairs_travel_by_the_ranges_that_starts_reach(spark, monkeypatch):
    """As many sizes of ranges as the last start needs, and all pairs up to it."""
    seen = []
    whole = two_sites._odd_ranges
    monkeypatch.setattr(two_sites, "_odd_ranges", lambda at, up, bits: (seen.append(bits), whole(at, up, bits))[1])
    at = [(1, k, k, k + 2, k + 2, 0, 0) for k in (1, 2, 5, 7, 8, 15, 16)]
    sites = spark.createDataFrame(at, "run_id long, i1 int, i2 int, j1 int, j2 int, hybrid long, energy long")
    found = two_sites.pairs_of_sites(sites, SiteLimits(distance=1)).select("i1", "k1").collect()
    assert sorted(map(tuple, found)) == sorted((x[1], y[1]) for x in at for y in at if y[1] >= x[3] + 2)
    assert seen == [5, 5]
    assert two_sites.pairs_of_sites(sites.where("false")).count() == 0


def test_folds_of_regions_spread_over_tasks(spark):
    """Few bytes, each costing a fold: they are not left in the one task that finds the distinct ones."""
    regions = lineage.checkpointed(spark.createDataFrame([("GGGAAACCC", i, i + 2) for i in range(1, 8)] * 3, "strand string, i int, j int"))
    folded = hybrid.region_pair_probabilities(regions)
    assert folded.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert {r.i for r in folded.collect()} == {2, 3, 4, 5, 6}  # the first and the last hold all of one letter
