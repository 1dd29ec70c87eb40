"""Weighted basin graphs: flows, filters, components, elimination of basins.

Tables: nodes (b, z) and edges (a, b, w) with a < b, each pair once.  For many
graphs at once the elimination kernel takes ``run_id`` as a further column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinforge.operators.lineage import checkpointed, forget, numbered


def both_directions(edges: DataFrame) -> DataFrame:
    """(s, t, w): each edge from both its ends."""
    ends = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))
    return edges.select(F.explode(ends).alias("e"), "w").select("e.s", "e.t", "w")


def outflow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(b, z, out_w, out_rate, max_rate): weight of all edges of a basin, over its own weight, and of its greatest edge."""
    flow = both_directions(edges).groupBy(F.col("s").alias("b")).agg(F.sum("w").alias("out_w"), F.max("w").alias("most"))
    return nodes.join(flow, "b", "left").select("b", "z", F.coalesce("out_w", F.lit(0.0)).alias("out_w"), F.coalesce(F.col("out_w") / F.col("z"), F.lit(0.0)).alias("out_rate"), F.coalesce(F.col("most") / F.col("z"), F.lit(0.0)).alias("max_rate"))


def equilibrium(nodes: DataFrame) -> DataFrame:
    """(b, z, p): shares of the total weight."""
    total = nodes.agg(F.sum("z")).first()[0]
    return nodes.select("b", "z", (F.col("z") / F.lit(total)).alias("p"))


def _dealt_in_order(df: DataFrame, column: str, size: Column) -> DataFrame:
    """``df`` with ``upto``: the sum of ``size`` over all rows up to and with this one, in order of distinct ``column`` values.

    Rows are dealt by range; a partition looks at its own rows and at one number from those before it.
    """
    dealt = checkpointed(df.withColumn("size", size).repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("size").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = dealt.withColumn("here", F.sum("size").over(Window.partitionBy("part").orderBy(column)))
    return within.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.col("here")).drop("part", "here", "before")  # a row for each partition


def _nth_least(values: DataFrame, column: str, nth: Callable[[int], int]) -> DataFrame:
    """The value that has ``nth(n)`` of the n values before it."""
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    placed = _dealt_in_order(counts, column, F.col("c"))
    target = nth(values.count())
    return placed.where((F.col("upto") > target) & (F.col("upto") - F.col("c") <= target)).select(F.col(column).alias("threshold"))


def max_outflow_by_quantile(rates: DataFrame, quantile: float) -> DataFrame:
    """The rate at position trunc(q (n - 1) / 100) of the ascending out_rate values."""
    return _nth_least(rates, "out_rate", lambda n: int(quantile * (n - 1) / 100))


def min_equilibrium_by_number(shares: DataFrame, number: int) -> DataFrame:
    """The share at position n - number of the ascending p values; 1 for no basins."""
    if number == 0:
        return shares.limit(0).agg(F.lit(1.0).alias("threshold"))
    return _nth_least(shares, "p", lambda n: n - number)


def max_outflow_by_number(rates: DataFrame, number: int) -> DataFrame:
    """The rate at position number - 1 of the ascending out_rate values."""
    return _nth_least(rates, "out_rate", lambda n: min(number, n) - 1)


def min_equilibrium_by_quantile(shares: DataFrame, quantile: float) -> DataFrame:
    """The share at position n - trunc(q n / 100) of the ascending p values; 1 for none of them."""
    if quantile == 0:
        return shares.limit(0).agg(F.lit(1.0).alias("threshold"))
    return _nth_least(shares, "p", lambda n: int(n - quantile * n / 100))


def run_limits(nodes: DataFrame, edges: DataFrame, number_outflow: int | None = None, quantile_outflow: float | None = None, number_share: int | None = None, quantile_share: float | None = None) -> DataFrame:
    """(run_id, max_outflow, min_share): each run's strictest limits of those asked for; null where none applies.

    A number larger than the run's basins asks for nothing.
    """
    flow = both_directions_by_run(edges.where("a <> b")).groupBy("run_id", F.col("s").alias("b")).agg(F.sum("w").alias("out"))
    totals = nodes.groupBy("run_id").agg(F.sum("z").alias("total"), F.count(F.lit(1)).alias("n"))
    each = nodes.join(flow, ["run_id", "b"], "left").join(totals, "run_id")
    each = each.select("run_id", F.coalesce(F.col("out") / F.col("z"), F.lit(0.0)).alias("rate"), (F.col("z") / F.col("total")).alias("p"), "n")
    each = numbered(numbered(each, "run_id", [F.col("rate")], "by_rate"), "run_id", [F.col("p")], "by_p")
    n, none = F.col("n"), F.lit(None).cast("double")
    at = lambda value, place, where: F.max(F.when((F.col(place) == where[0]) & where[1], F.col(value)))
    rates = [at("rate", "by_rate", (number_outflow - 1, number_outflow <= n))] if number_outflow else []
    rates += [at("rate", "by_rate", ((quantile_outflow * (n - 1) / 100).cast("long"), F.lit(True)))] if quantile_outflow is not None else []
    shares = [at("p", "by_p", (n - number_share, number_share <= n))] if number_share else []
    shares += [at("p", "by_p", ((n - quantile_share * n / 100).cast("long"), F.lit(True)))] if quantile_share else []
    return each.groupBy("run_id").agg(F.least(*rates, none, none).alias("max_outflow"), F.greatest(*shares, none, none).alias("min_share"))


def both_directions_by_run(edges: DataFrame) -> DataFrame:
    """(run_id, s, t, w): each edge from both its ends."""
    ends = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))
    return edges.select("run_id", F.explode(ends).alias("e"), "w").select("run_id", "e.s", "e.t", "w")


def filter_by_rate(nodes: DataFrame, edges: DataFrame, min_rate: float) -> DataFrame:
    """Edges whose weight is at least ``min_rate`` of the lesser basin's; of each run, where there is ``run_id``."""
    of = ["run_id"] if "run_id" in edges.columns else []
    za, zb = nodes.select(*of, F.col("b").alias("a"), F.col("z").alias("za")), nodes.select(*of, "b", F.col("z").alias("zb"))
    return edges.join(za, [*of, "a"]).join(zb, [*of, "b"]).where(F.col("w") / F.least("za", "zb") >= min_rate).select(*of, "a", "b", "w")


def merge_candidates(rates: DataFrame, shares: DataFrame, max_outflow: float, min_share: float, special_first: bool = True) -> DataFrame:
    """(b, out_rate, p): basins to be merged away: rare or fast ones, the first exempt if special."""
    both = rates.select("b", "out_rate").join(shares.select("b", "p"), "b")
    out = both.where((F.col("p") < min_share) | (F.col("out_rate") > max_outflow))
    return out.where("b <> 0") if special_first else out


def with_prefactor(edges: DataFrame, basin: int, factor: float) -> DataFrame:
    """Edges of ``basin`` multiplied."""
    return edges.withColumn("w", F.when((F.col("a") == basin) | (F.col("b") == basin), F.col("w") * factor).otherwise(F.col("w")))


def dissolve_set(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of each run without the basins ``gone`` (run_id, b), no two of which share an edge; and (run_id, x, y, f), what of a gone x goes to y.

    A gone basin's weight goes to its neighbours in proportion to their edges, and so do its paths: between two
    neighbours, from a neighbour to itself (which makes or adds to its self-transition, a row with a = b), and by way of its own self-transition.
    A basin without neighbours takes its weight along.
    """
    x = gone.select("run_id", F.col("b").alias("s"))
    near = both_directions_by_run(edges.where("a <> b")).join(x, ["run_id", "s"]).withColumnRenamed("s", "x")
    out = near.groupBy("run_id", "x").agg(F.sum("w").alias("out"))
    own = edges.where("a = b").select("run_id", F.col("a").alias("x"), F.col("w").alias("own"))
    weight = nodes.select("run_id", F.col("b").alias("x"), F.col("z").alias("z0"))
    held = out.join(own, ["run_id", "x"], "left").join(weight, ["run_id", "x"]).select("run_id", "x", "out", F.coalesce("own", F.lit(0.0)).alias("own"), "z0")
    share = near.join(held, ["run_id", "x"]).select("run_id", "x", F.col("t").alias("y"), "w", (F.col("w") / F.col("out")).alias("f"), "own", "z0")
    gains = share.groupBy("run_id", F.col("y").alias("b")).agg(F.sum(F.col("f") * F.col("z0")).alias("gain"))
    left = nodes.join(gone.select("run_id", "b"), ["run_id", "b"], "left_anti").join(gains, ["run_id", "b"], "left")
    new_nodes = left.withColumn("z", F.col("z") + F.coalesce("gain", F.lit(0.0))).drop("gain")
    # the pairs of a basin's neighbours, each with itself too, are what elimination makes
    p = share.select("run_id", "x", F.col("y").alias("a"), F.col("w").alias("wa"), F.col("f").alias("fa"), "own")
    q = share.select("run_id", "x", F.col("y").alias("b"), "w", "f")
    add = F.col("wa") * F.col("f") + F.col("w") * F.col("fa") + F.col("own") * F.col("f") * F.col("fa")
    made = p.join(q, ["run_id", "x"]).where("a <= b").select("run_id", "a", "b", add.alias("w"))
    kept = edges
    for end in ("a", "b"):
        kept = kept.join(gone.select("run_id", F.col("b").alias(end)), ["run_id", end], "left_anti")
    new_edges = kept.select("run_id", "a", "b", "w").unionByName(made).groupBy("run_id", "a", "b").agg(F.sum("w").alias("w"))
    return new_nodes, new_edges, share.select("run_id", "x", "y", "f")


def dissolve(nodes: DataFrame, edges: DataFrame, gone: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph without basin ``gone``; see ``dissolve_set``."""
    one = lambda df: df.withColumn("run_id", F.lit(0))
    which = one(nodes.where(F.col("b") == gone).select("b"))
    new_nodes, new_edges, _ = dissolve_set(one(nodes), one(edges), which)
    return new_nodes.drop("run_id"), new_edges.drop("run_id")


def _spread_join(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each of the ``keys``.

    A hash of the keys is joined with them, so that both sides are dealt anew: a join whose one side is dealt by
    its keys already can't be split where one key has very many rows.
    """
    turned = lambda df: df.withColumn("__deal", F.xxhash64(*keys))
    return turned(many).join(turned(one), [*keys, "__deal"]).drop("__deal")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(b, component): the least basin that can be reached, by taking neighbours' labels and pointer jumping; of each run, where there is ``run_id``."""
    of = ["run_id"] if "run_id" in nodes.columns else []
    ends = (both_directions_by_run(edges) if of else both_directions(edges)).select(*of, "s", "t")
    now = checkpointed(nodes.select(*of, "b", F.col("b").alias("component")))
    while True:
        label = now.select(*of, F.col("b").alias("t"), F.col("component").alias("other"))
        least = ends.join(label, [*of, "t"]).groupBy(*of, F.col("s").alias("b")).agg(F.min("other").alias("other"))
        hooked = checkpointed(now.join(least, [*of, "b"], "left").select(*of, "b", F.least("component", F.coalesce("other", "component")).alias("next"), "component"))
        jump = hooked.select(*of, F.col("b").alias("next"), F.col("next").alias("far"))
        step = checkpointed(_spread_join(hooked, jump, [*of, "next"]).select(*of, "b", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("moved")))
        forget(now, hooked)
        now = step
        if not step.where("moved").limit(1).count():
            return step.drop("moved")


def keep_component(nodes: DataFrame, edges: DataFrame, components: DataFrame, basin: int) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of that basin's component; of each run, where there is ``run_id``."""
    of = ["run_id"] if "run_id" in nodes.columns else []
    wanted = components.where(F.col("b") == basin).select(*of, "component")
    kept = components.join(wanted, [*of, "component"], "left_semi").select(*of, "b")
    return nodes.join(kept, [*of, "b"], "left_semi"), edges.join(kept.select(*of, F.col("b").alias("a")), [*of, "a"], "left_semi")


def connect_components(nodes: DataFrame, components: DataFrame, min_rate: float) -> DataFrame:
    """(a, b, w): an edge between the heaviest basins of each two components, of ``min_rate`` times the lesser weight; of each run, where there is ``run_id``."""
    of = ["run_id"] if "run_id" in nodes.columns else []
    heads = nodes.join(components, [*of, "b"]).groupBy(*of, "component").agg(F.max_by("b", F.struct("z", -F.col("b"))).alias("b"), F.max("z").alias("z"))
    x, y = heads.select(*of, F.col("b").alias("a"), F.col("z").alias("za")), heads.select(*of, "b", "z")
    both = x.join(y, of).where("a < b") if of else x.join(y, F.col("a") < F.col("b"))
    return both.select(*of, "a", "b", (min_rate * F.least("za", "z")).alias("w"))


def reindex(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Basins numbered from 0 in their order; all edges between kept basins stay."""
    ids = checkpointed(_dealt_in_order(nodes.select(F.col("b").alias("old"), "z"), "old", F.lit(1)).withColumn("new", F.col("upto") - 1))
    a, b = ids.select(F.col("old").alias("a"), F.col("new").alias("na")), ids.select(F.col("old").alias("b"), F.col("new").alias("nb"))
    return ids.select(F.col("new").alias("b"), "old", "z"), edges.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "w")


@dataclass(frozen=True)
class PruneLimits:
    max_outflow: float = 1e6
    min_share: float = 0.0
    min_rate: float = 0.0
    special_first: bool = True
    min_contribution: float = 1e-3


def in_turn(z: Column, b: Column) -> list[Column]:
    """The order in which basins are looked at: ascending weight, to nine decimals of its logarithm, then the basin."""
    return [F.round(F.log(z), 9), b]


def eliminate(z: np.ndarray, near: list[dict[int, float]], limits: PruneLimits, keep: set[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[dict[int, float]], list[dict[int, float]]]:
    """Eliminates basins in ascending order of their first weight: (kept, z, neighbours, contributions).

    ``near`` has the weights of each basin's edges by neighbour, its self-transition under itself, and only those are
    held and touched.  With ``keep`` all basins but those go; else those that the limits say, by the weight and the outflow that they have at their turn.
    At its turn a basin loses edges below ``min_rate`` of the lesser weight.  All weights of a gone basin's neighbours are raised before edges
    are tested; an edge whose sum would stay below ``min_rate`` keeps its old weight.  A basin without neighbours takes its weight along.
    """
    z, near, n = z.astype(float).copy(), [dict(x) for x in near], len(z)
    alive, parts, total = np.ones(n, bool), [{x: 1.0} for x in range(n)], z.sum()

    def too_slow(x: int, y: int, w: float) -> bool:
        return limits.min_rate > 0 and w / max(min(z[x], z[y]), 1e-300) < limits.min_rate

    for x in np.lexsort((np.arange(n), np.round(np.log(z), 9))).tolist():
        for y in [y for y, w in near[x].items() if too_slow(x, y, w)]:
            del near[x][y]
            near[y].pop(x, None)
        own = near[x].pop(x, 0.0)
        out = sum(near[x].values())
        if keep is not None:
            goes = x not in keep
        else:
            goes = not (x == 0 and limits.special_first) and (z[x] / total < limits.min_share or out / z[x] > limits.max_outflow)
        if not goes:
            if own:
                near[x][x] = own
            parts[x] = {b: v for b, v in parts[x].items() if v >= limits.min_contribution}
            continue
        share = {y: w / out for y, w in near[x].items()}
        for y, f in share.items():
            z[y] += f * z[x]
            del near[y][x]
        ends = list(share.items())
        for k, (p, fp) in enumerate(ends):
            for q, fq in ends[: k + 1]:
                w = near[p].get(q, 0.0) + near[x][p] * fq + near[x][q] * fp + own * fp * fq
                if not too_slow(p, q, w):
                    near[p][q] = near[q][p] = w
            for b, part in parts[x].items():
                if part * fp >= limits.min_contribution / n:
                    parts[p][b] = parts[p].get(b, 0.0) + part * fp
        near[x], parts[x], alive[x], z[x] = {}, {}, False, 0.0
    return np.flatnonzero(alive), z, near, parts


def prune(nodes: DataFrame, edges: DataFrame, limits: PruneLimits = PruneLimits(), per_run: DataFrame | None = None, keep: tuple[int, ...] | None = None) -> DataFrame:
    """(run_id, kind, a, b, value): what is left of each run's graph.

    kind "node" has a = b and the weight, "edge" an edge, "self" (a = b) a self-transition, "part" the share of input basin b in a.
    ``per_run`` (run_id, max_outflow, min_share) has stricter limits for single runs, null for none; ``keep``
    names the basins to reduce the graphs to.  One group is one run's basin graph, as its basins and edges; ``prune_in_rounds`` does the same for
    runs whose graphs no task holds.
    """
    row = lambda kind, a, value: [F.lit(kind).alias("kind"), F.col(a).alias("a"), "b", F.col(value).alias("value")]
    rows = nodes.select("run_id", *row("node", "b", "z")).unionByName(edges.select("run_id", *row("edge", "a", "w")))
    none = F.lit(None).cast("double")
    if per_run is None:
        rows = rows.withColumn("max_outflow", none).withColumn("min_share", none)
    else:
        rows = rows.join(per_run.select("run_id", "max_outflow", "min_share"), "run_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["kind"] == "node").to_numpy()
        ids = np.unique(pdf["a"][own])
        a, b, v = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"]), pdf["value"].to_numpy()
        z, near = np.zeros(len(ids)), [{} for _ in ids]
        z[a[own]] = v[own]
        for x, y, w in zip(a[~own].tolist(), b[~own].tolist(), v[~own].tolist()):
            near[x][y] = near[y][x] = near[x].get(y, 0.0) + w
        asked = pdf[["max_outflow", "min_share"]].iloc[0]
        strict = replace(limits, max_outflow=np.nanmin([limits.max_outflow, asked["max_outflow"]]), min_share=np.nanmax([limits.min_share, asked["min_share"]]))
        kept, z, near, parts = eliminate(z, near, strict, None if keep is None else set(np.flatnonzero(np.isin(ids, keep)).tolist()))
        out = [("node", x, x, z[x]) for x in kept.tolist()]
        out += [("self" if x == y else "edge", x, y, w) for x, ys in enumerate(near) for y, w in ys.items() if x <= y]
        out += [("part", x, y, w) for x, ys in enumerate(parts) for y, w in ys.items()]
        kind, a, b, value = zip(*out) if out else ((), (), (), ())
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "kind": kind, "a": ids[list(a)], "b": ids[list(b)], "value": value})

    return rows.groupBy("run_id").applyInPandas(run, "run_id long, kind string, a long, b long, value double")


def prune_in_rounds(nodes: DataFrame, edges: DataFrame, limits: PruneLimits = PruneLimits(), keep: tuple[int, ...] | None = None) -> DataFrame:
    """What ``prune`` gives at ``min_rate`` 0, by joins alone, for graphs that no task holds.

    In a round each basin whose neighbours before it in the order have all had their turn has its own. Such basins share no edge, and
    dissolving basins that share none commutes, so the result is that of one turn after the other.  The rounds are as many
    as the longest chain of neighbours in ascending order.
    """
    if limits.min_rate > 0:
        raise ValueError("rounds give the same in any order only at min_rate 0")
    totals = nodes.groupBy("run_id").agg(F.sum("z").alias("total"), F.count(F.lit(1)).alias("n"))
    ranked = numbered(nodes.select("run_id", "b", "z"), "run_id", in_turn(F.col("z"), F.col("b")), "rank")
    firsts = nodes.groupBy("run_id").agg(F.min("b").alias("first"))
    now = checkpointed(ranked.join(totals, "run_id").join(firsts, "run_id").withColumn("waits", F.lit(True)))
    links = checkpointed(edges.select("run_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("run_id", "a", "b").agg(F.sum("w").alias("w")))
    parts = checkpointed(nodes.select("run_id", F.col("b").alias("a"), "b", F.lit(1.0).alias("part")))
    while now.where("waits").limit(1).count():
        both = both_directions_by_run(links.where("a <> b"))
        rank = now.where("waits").select("run_id", F.col("b").alias("t"), F.col("rank").alias("other"))
        before = both.join(rank, ["run_id", "t"]).groupBy("run_id", F.col("s").alias("b")).agg(F.min("other").alias("other"))
        out = both.groupBy("run_id", F.col("s").alias("b")).agg(F.sum("w").alias("out"))
        turn = now.where("waits").join(before, ["run_id", "b"], "left").where(F.col("other").isNull() | (F.col("other") > F.col("rank")))
        turn = turn.join(out, ["run_id", "b"], "left").withColumn("out", F.coalesce("out", F.lit(0.0)))
        if keep is not None:
            goes = ~F.col("b").isin(*keep)
        else:
            goes = (F.col("z") / F.col("total") < limits.min_share) | (F.col("out") / F.col("z") > limits.max_outflow)
            goes = goes & (F.col("b") != F.col("first")) if limits.special_first else goes
        turn, before_turn = checkpointed(turn.select("run_id", "b", goes.alias("goes"))), (now, links, parts)
        stays = turn.where(~F.col("goes")).select("run_id", "b", F.lit(True).alias("had"))
        # what has its turn and stays drops small shares of what it is made of so far
        settled = parts.join(stays.withColumnRenamed("b", "a"), ["run_id", "a"], "left").where(F.col("had").isNull() | (F.col("part") >= limits.min_contribution)).drop("had")
        waiting = lambda df: df.join(stays, ["run_id", "b"], "left").withColumn("waits", F.col("waits") & F.col("had").isNull()).drop("had")
        if not turn.where("goes").limit(1).count():
            now, parts = checkpointed(waiting(now)), checkpointed(settled)
            forget(turn, before_turn[0], before_turn[2])
            continue
        left, made, share = dissolve_set(now, links, turn.where("goes"))
        n = now.select("run_id", "n").distinct()
        moved = parts.join(share.withColumnRenamed("x", "a"), ["run_id", "a"]).join(n, "run_id")
        moved = moved.select("run_id", F.col("y").alias("a"), "b", (F.col("part") * F.col("f")).alias("part"), "n").where(F.col("part") >= limits.min_contribution / F.col("n"))
        left_parts = settled.join(turn.where("goes").select("run_id", F.col("b").alias("a")), ["run_id", "a"], "left_anti")
        parts = checkpointed(left_parts.unionByName(moved.drop("n")).groupBy("run_id", "a", "b").agg(F.sum("part").alias("part")))
        now = checkpointed(waiting(left))
        links = checkpointed(made)
        forget(turn, *before_turn)
    kind = F.when(F.col("a") == F.col("b"), F.lit("self")).otherwise(F.lit("edge"))
    out = now.select("run_id", F.lit("node").alias("kind"), F.col("b").alias("a"), "b", F.col("z").alias("value"))
    out = out.unionByName(links.select("run_id", kind.alias("kind"), "a", "b", F.col("w").alias("value")))
    return out.unionByName(parts.select("run_id", F.lit("part").alias("kind"), "a", "b", F.col("part").alias("value")))


@dataclass(frozen=True)
class PruneSteps:
    """All that a prune run does with each run's graph.

    ``prefactor`` multiplies the edges of the first basin; limits go by value, by number and by quantile, and the strictest hold; ``simplify`` is
    whether basins are pruned at all; ``keep`` names basins as they are numbered then; components are connected, or only that of the first basin stays.
    """

    limits: PruneLimits = PruneLimits()
    prefactor: float = 1.0
    number_outflow: int | None = None
    quantile_outflow: float | None = None
    number_share: int | None = None
    quantile_share: float | None = None
    simplify: bool = True
    keep: tuple[int, ...] | None = None
    connect: bool = True


def _renumbered(pruned: DataFrame, swap: bool) -> DataFrame:
    """The rows of ``prune`` with basins numbered from 0 in their order in each run; ``swap``: the first two exchanged, where there are two."""
    ids = numbered(pruned.where("kind = 'node'").select("run_id", F.col("a").alias("old")), "run_id", [F.col("old")], "new")
    if swap:
        both = ids.where("new = 1").select("run_id", F.lit(True).alias("two"))
        ids = ids.join(both, "run_id", "left").select("run_id", "old", F.when(F.col("two") & (F.col("new") < 2), 1 - F.col("new")).otherwise(F.col("new")).alias("new"))
    ids = checkpointed(ids)
    a = pruned.join(ids.select("run_id", F.col("old").alias("a"), F.col("new").alias("na")), ["run_id", "a"])
    # the basins that a share comes from keep their numbers
    both = a.join(ids.select("run_id", F.col("old").alias("b"), F.col("new").alias("nb")), ["run_id", "b"], "left")
    part = F.col("kind") == "part"
    return both.select("run_id", "kind", F.when(part, F.col("na")).otherwise(F.least("na", "nb")).alias("a"), F.when(part, F.col("b")).otherwise(F.greatest("na", "nb")).alias("b"), "value")


def graph_of(pruned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (run_id, b, z) and edges (run_id, a, b, w), self-transitions too, of the rows of ``prune``."""
    nodes = pruned.where("kind = 'node'").select("run_id", F.col("a").alias("b"), F.col("value").alias("z"))
    return nodes, pruned.where("kind IN ('edge', 'self')").select("run_id", "a", "b", F.col("value").alias("w"))


def _composed(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Shares of shares: what the final basins are made of, by way of those between."""
    between = earlier.where("kind = 'part'").select("run_id", F.col("a").alias("m"), F.col("b").alias("input"), F.col("value").alias("v"))
    parts = later.where("kind = 'part'").withColumnRenamed("b", "m").join(between, ["run_id", "m"])
    return parts.groupBy("run_id", "kind", "a", F.col("input").alias("b")).agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def prune_run(nodes: DataFrame, edges: DataFrame, steps: PruneSteps = PruneSteps()) -> DataFrame:
    """The rows of ``prune`` after all steps of a prune run, in their order.

    Prefactor, strictest limits, pruning, new numbers, the first two exchanged (so that the open state has number 1), reduction to the basins to
    keep and new numbers again, components connected at ``min_rate``, or those without the first basin left out and new numbers once more.
    """
    limits = steps.limits
    if limits.special_first and steps.prefactor != 1.0:
        edges = with_prefactor(edges, 0, steps.prefactor)
    if steps.simplify:
        asked = run_limits(nodes, edges, steps.number_outflow, steps.quantile_outflow, steps.number_share, steps.quantile_share)
        found = prune(nodes, edges, limits, asked)
    else:
        kind = F.when(F.col("a") == F.col("b"), F.lit("self")).otherwise(F.lit("edge"))
        found = nodes.select("run_id", F.lit("node").alias("kind"), F.col("b").alias("a"), "b", F.col("z").alias("value"))
        found = found.unionByName(edges.select("run_id", kind.alias("kind"), "a", "b", F.col("w").alias("value")))
        found = found.unionByName(nodes.select("run_id", F.lit("part").alias("kind"), F.col("b").alias("a"), "b", F.lit(1.0).alias("value")))
    found = checkpointed(_renumbered(checkpointed(found), swap=limits.special_first))
    if steps.keep is not None:
        reduced = checkpointed(_renumbered(checkpointed(prune(*graph_of(found), limits, keep=steps.keep)), swap=False))
        found = checkpointed(reduced.where("kind <> 'part'").unionByName(_composed(reduced, found)))
    left, links = graph_of(found)
    components = connected_components(left, links.where("a <> b"))
    if steps.connect:
        more = connect_components(left, components, limits.min_rate)
        return found.unionByName(more.select("run_id", F.lit("edge").alias("kind"), "a", "b", F.col("w").alias("value")))
    own, _ = keep_component(left, links, components, 0)
    return _renumbered(found.join(own.select("run_id", F.col("b").alias("a")), ["run_id", "a"], "left_semi"), swap=False)


def component_sizes(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(component, basins, z): how many basins each component has and what they weigh."""
    return nodes.join(components, "b").groupBy("component").agg(F.count(F.lit(1)).alias("basins"), F.sum("z").alias("z"))


def pruned_pair_probabilities(parts: DataFrame, weights: DataFrame, pairs: DataFrame, final: DataFrame) -> DataFrame:
    """(run_id, a, i, j, p): pair probabilities of final states, from those of the basins that they are made of.

    ``parts`` has run_id, a, b and part; ``weights`` run_id, b and z; ``pairs`` b, i, j and p, and run_id if runs differ in them; ``final`` run_id, a and its weight z.
    """
    keys = ["run_id", "b"] if "run_id" in pairs.columns else ["b"]
    summed = parts.join(weights, ["run_id", "b"]).join(pairs, keys).groupBy("run_id", "a", "i", "j").agg(F.sum(F.col("part") * F.col("z") * F.col("p")).alias("w"))
    return summed.join(final, ["run_id", "a"]).select("run_id", "a", "i", "j", (F.col("w") / F.col("z")).alias("p"))


def swap_first_two(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Basins 0 and 1 exchanged, if there are two: the open state then has number 1."""
    if nodes.where("b < 2").limit(2).count() < 2:
        return nodes, edges
    swapped = lambda c: F.when(F.col(c) < 2, 1 - F.col(c)).otherwise(F.col(c))
    ends = edges.select(swapped("a").alias("x"), swapped("b").alias("y"), "w")
    return nodes.withColumn("b", swapped("b")), ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")


def strictest(max_outflows: list[float], min_shares: list[float]) -> tuple[float, float]:
    """The limits that hold when several are given."""
    return min(max_outflows, default=float("inf")), max(min_shares, default=0.0)
