"""Landscapes whose states have no, one or two interaction sites, the second behind the first on both strands.

A state is known by run_id and the codes of its sites, 0 for none.  Pairs of sites come from a join on
power-of-two ranges of one strand, so that only pairs in order on that strand are made.  Moves
of one end are joins on all that stays, others on the target's whole key.  Parents, basins and transitions are
those of ``landscape``, which knows states by their ranks alone.

A move and its reverse have one saddle, and where published bounds differ between the two the wider one holds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinforge.functions import energy, sequence
from basinforge.operators import landscape
from basinforge.operators.landscape import SECOND, SITE, SiteLimits
from basinforge.operators.lineage import checkpointed, numbered, unbroadcast

#: Order of the kinds of moves, which decides ties: each end of each site, shifts, a site less, a first, left or right one more, two in one, one in two.
KINDS = ("first_left", "first_right", "second_left", "second_right", "shift", "remove", "new", "new_left", "new_right", "merge", "split")
_KEY = ["run_id", "code1", "code2"]
#: Positions are below two to this power.
POSITION_BITS = 16


@dataclass(frozen=True)
class JointUnpaired:
    """``first`` and ``second`` (run_id, i, j, k, l, p): the probability that i..j and k..l (j < k) of that strand are both unpaired."""

    first: DataFrame
    second: DataFrame
    celsius: float = 37.0


def _odd_ranges(at: Column, rounded_up: bool, bits: int) -> Column:
    """The ranges of odd number, of each size 2**b, that hold a position; or that begin at it when it is rounded up to the size."""
    one = lambda b: F.shiftright((at + ((1 << b) - 1 if rounded_up else 0)).cast("int"), b)
    every = [F.when(one(b) % 2 == 1, F.struct(F.lit(b).alias("size"), one(b).alias("range"))) for b in range(bits)]
    return F.array_compact(F.array(*every))


def in_order(left: DataFrame, right: DataFrame, bound: Column, start: str, bits: int = POSITION_BITS) -> DataFrame:
    """``left`` joined with the rows of ``right`` of the same run whose ``start`` is at least ``bound``, which is 1 or more.

    Starts are below two to the power of ``bits``; a row of ``left`` travels once for each of its ranges, so fewer bits are fewer rows.

    The positions from a bound on fall into ranges whose sizes are different powers of two and whose numbers are odd; a
    position lies in just one of them.  So this is an equi-join that makes the result's rows and no others.
    """
    many = left.withColumn("__range", F.explode(_odd_ranges(bound, True, bits)))
    one = right.withColumn("__range", F.explode(_odd_ranges(F.col(start), False, bits)))
    return many.join(one, ["run_id", "__range"]).drop("__range")


def pairs_of_sites(sites: DataFrame, limits: SiteLimits = SiteLimits()) -> DataFrame:
    """(run_id, the first site, k1, k2, l1, l2, h1, h2, e1, e2): two sites with at least the distance between them on both strands."""
    gap = limits.distance + 1
    first = sites.select("run_id", *SITE, F.col("hybrid").alias("h1"), F.col("energy").alias("e1"))
    second = sites.select("run_id", *[F.col(a).alias(b) for a, b in zip(SITE, SECOND)], F.col("hybrid").alias("h2"), F.col("energy").alias("e2"))
    bits = (sites.agg(F.max("i1")).first()[0] or 0).bit_length()
    return in_order(first, second, F.col("j1") + gap, "k1", bits).where(F.col("k2") >= F.col("j2") + gap)


def double_states(sites: DataFrame, limits: SiteLimits = SiteLimits(), joint: JointUnpaired | None = None) -> DataFrame:
    """(run_id, both sites, h1, h2, hybrid, energy) of the pairs within ``limits.max_total``.

    Spans are unpaired independently of each other, or, with ``joint``, with the probability of both.
    """
    pairs = pairs_of_sites(sites, limits).withColumn("hybrid", F.col("h1") + F.col("h2"))
    if joint is None:
        pairs = pairs.withColumn("energy", F.col("e1") + F.col("e2"))
    else:
        for table, ends, name in ((joint.first, ("i1", "j1", "k1", "l1"), "p1"), (joint.second, ("i2", "j2", "k2", "l2"), "p2")):
            named = table.select("run_id", *[F.col(a).alias(b) for a, b in zip(("i", "j", "k", "l"), ends)], F.col("p").alias(name))
            pairs = pairs.join(named, ["run_id", *ends])
        free = lambda p: energy.free_energy(F.col(p), joint.celsius) * 100
        pairs = pairs.withColumn("energy", F.col("hybrid") + F.round(free("p1") + free("p2")).cast("long"))
    return pairs.where(F.col("energy") <= limits.max_total).select("run_id", *SITE, *SECOND, "h1", "h2", "hybrid", "energy")


def _code(site: tuple[str, ...]) -> Column:
    return F.coalesce(sequence.encode_site(*[F.col(c) for c in site]), F.lit(0).cast("long"))


def states(runs: DataFrame, sites: DataFrame, double: DataFrame) -> DataFrame:
    """(run_id, code1, code2, both sites, h1, h2, hybrid, energy, rank): the open state, those of one and those of two sites.

    Ranks go by energy, ties by the bytes of the line; the open state has rank 0.
    """
    none = F.lit(None)
    opened = landscape.with_open_state(runs, sites)
    second = {c: none.cast("int") for c in SECOND} | {"h1": F.when(F.col("i1").isNotNull(), F.col("hybrid")), "h2": none.cast("long")}
    columns = ["run_id", *SITE, *SECOND, "h1", "h2", "hybrid", "energy"]
    every = opened.withColumns(second).select(*columns).unionByName(double.select(*columns))
    every = every.withColumn("code1", _code(SITE)).withColumn("code2", _code(SECOND))
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in (*SITE, *SECOND)])  # lines of one energy begin alike
    # kept, for ranges are found from a sample, for which the pairs would be made twice
    return numbered(checkpointed(every), "run_id", [F.col("i1").isNotNull(), F.col("energy"), line], "rank")


def _both_ways(pairs: DataFrame, there: Column, back: Column) -> DataFrame:
    """Edges from l to s (kind ``there``) and from s to l (``back``) over their saddle e_ts."""

    def end(x: str, y: str, kind: Column) -> Column:
        ends = [F.col(f"{a}_{of}").alias(name) for of, names in (("rank", ("src", "dst")), ("energy", ("e_src", "e_dst"))) for a, name in zip((x, y), names)]
        return F.struct(*ends[:2], kind.cast("int").alias("kind"), *ends[2:], F.col("e_ts").cast("long").alias("e_ts"))

    return pairs.select("run_id", F.explode(F.array(end("l", "s", there), end("s", "l", back))).alias("e")).select("run_id", "e.*")


def _as(states: DataFrame, mark: str, *more: str) -> DataFrame:
    return states.select(*_KEY, *[F.col(c).alias(f"{mark}_{c}") for c in ("rank", "energy", "hybrid", *more)])


def _number(kind: str) -> Column:
    return F.lit(KINDS.index(kind))


def end_moves(ranked: DataFrame, limits: SiteLimits = SiteLimits()) -> DataFrame:
    """Moves of one end of one site, on both strands in the same direction or on one: both directions of each."""
    made = []
    for name, ends, fixed in (("first", SITE, ["code2"]), ("second", SECOND, ["code1"])):
        a, b, c, d = (F.col(x) for x in ends)
        own = ranked.where(F.col("code1" if name == "first" else "code2") != 0).where((c - a + 1 >= limits.least) & (d - b + 1 >= limits.least))
        for side, moved, kept in (("left", ends[:2], ends[2:]), ("right", ends[2:], ends[:2])):
            keys = [F.col(x) for x in (*kept, *fixed)]
            made.append(landscape.end_pairs(own, keys, moved, side == "left", limits, (KINDS.index(f"{name}_{side}"), KINDS.index("shift"))))
    pairs = reduce(DataFrame.unionByName, made)
    return _both_ways(pairs, F.col("kind"), F.col("kind"))


def site_moves(ranked: DataFrame, limits: SiteLimits = SiteLimits()) -> DataFrame:
    """A short site goes, or comes anew: between the open state and one site, and between one site and two.

    Paid are the spans of all sites, the loop of the short site's ends, and the other site.
    """
    most = limits.unpaired_in_loop + 1
    span = lambda site: (F.col(site[2]) - F.col(site[0]), F.col(site[3]) - F.col(site[1]))
    short = lambda site: (span(site)[0] <= most) & (span(site)[1] <= most)
    loop = lambda site: energy.loop_energy(*span(site))
    unpaired = F.col("energy") - F.col("hybrid")
    choice = lambda ok, kind, left1, left2, ts: F.when(ok, F.struct(_number(kind).alias("back"), left1.alias("code1"), left2.alias("code2"), ts.alias("e_ts")))
    none, two = F.lit(0).cast("long"), F.col("code2") != 0
    gone = F.array_compact(F.array(
        choice(~two & short(SITE), "new", none, none, unpaired + loop(SITE)),
        choice(two & short(SITE), "new_left", F.col("code2"), none, unpaired + loop(SITE) + F.col("h2")),
        choice(two & short(SECOND), "new_right", F.col("code1"), none, unpaired + loop(SECOND) + F.col("h1")),
    ))
    large = ranked.where("code1 <> 0").select("run_id", *[F.col(c).alias(f"l_{c}") for c in ("rank", "energy")], F.explode(gone).alias("g")).select("run_id", "l_rank", "l_energy", "g.*")
    # every run's open state has rank 0 and one energy, so that it needs no join
    opened = large.where("code1 = 0").withColumn("s_rank", F.lit(0).cast("long")).withColumn("s_energy", F.lit(-energy.DUPLEX_INIT).cast("long"))
    other = large.where("code1 <> 0").join(unbroadcast(ranked.select(*_KEY, F.col("rank").alias("s_rank"), F.col("energy").alias("s_energy"))), _KEY)
    columns = ["run_id", "l_rank", "l_energy", "s_rank", "s_energy", "back", "e_ts"]
    return _both_ways(opened.select(*columns).unionByName(other.select(*columns)), _number("remove"), F.col("back"))


def merge_moves(ranked: DataFrame, between: DataFrame, limits: SiteLimits = SiteLimits()) -> DataFrame:
    """Two sites at just the least distance on both strands become the site over both, which splits into them again.

    ``between`` has the sites that reach from one site's end to the next one's start, with their hybrid.
    Paid are the merged site's spans, both sites and what lies between them.
    """
    gap = limits.distance + 1
    near = ranked.where((F.col("k1") == F.col("j1") + gap) & (F.col("k2") == F.col("j2") + gap))
    over = sequence.encode_site(F.col("i1"), F.col("i2"), F.col("l1"), F.col("l2"))
    near = near.select("run_id", over.alias("code1"), F.lit(0).cast("long").alias("code2"), "j1", "j2", *[F.col(c).alias(f"l_{c}") for c in ("rank", "energy", "hybrid")])
    middle = between.where((F.col("j1") == F.col("i1") + gap) & (F.col("j2") == F.col("i2") + gap)).select("run_id", F.col("i1").alias("j1"), F.col("i2").alias("j2"), F.col("hybrid").alias("middle"))
    both = near.join(unbroadcast(_as(ranked, "s")), _KEY).join(middle, ["run_id", "j1", "j2"])
    return _both_ways(both.withColumn("e_ts", F.col("s_energy") - F.col("s_hybrid") + F.col("l_hybrid") + F.col("middle")), _number("merge"), _number("split"))


def moves(ranked: DataFrame, between: DataFrame, limits: SiteLimits = SiteLimits()) -> DataFrame:
    """All moves between states of up to two sites: run_id, src, dst, kind, e_src, e_dst, e_ts."""
    return end_moves(ranked, limits).unionByName(site_moves(ranked, limits)).unionByName(merge_moves(ranked, between, limits))


def sites_between(runs: DataFrame, limits: SiteLimits = SiteLimits(), energies: landscape.ModelEnergies | None = None) -> DataFrame:
    """Sites without a limit on energy, up to those that reach over the least distance."""
    free = replace(limits, max_hybrid=10**9, max_total=10**9, most=max(limits.most, limits.distance + 2))
    return landscape.enumerate_sites(runs, free, energies)
