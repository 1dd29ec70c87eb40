"""Markov chains in continuous time over basins: rates, stationary law, probabilities over time, passage times.

Rates follow from the weights: r(i, j) = w(i, j) / z(i), which obeys detailed
balance, so one symmetric eigendecomposition of a run serves all its times.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinforge.operators.graph import both_directions, both_directions_by_run
from basinforge.operators.lineage import checkpointed, forget


def symmetrize(entries: DataFrame) -> DataFrame:
    """(i, j, v): half the sum of the matrix and its transpose; absent entries are zero."""
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return entries.select(F.explode(both).alias("e"), "v").groupBy("e.i", "e.j").agg((F.sum("v") / 2).alias("v"))


def rate_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, rate): the off-diagonal rates, and on the diagonal minus a row's sum; of each run, where there is ``run_id``."""
    of = ["run_id"] if "run_id" in nodes.columns else []
    ends = both_directions_by_run(edges) if of else both_directions(edges)
    off = ends.where("s <> t").join(nodes.select(*of, F.col("b").alias("s"), "z"), [*of, "s"]).select(*of, F.col("s").alias("i"), F.col("t").alias("j"), (F.col("w") / F.col("z")).alias("rate"))
    diagonal = off.groupBy(*of, "i").agg((-F.sum("rate")).alias("rate")).select(*of, "i", F.col("i").alias("j"), "rate")
    return off.unionByName(diagonal)


def time_grid(spark: SparkSession, t0: float = 0.1, end: float = 1e16, factor: float = 1.2) -> DataFrame:
    """(k, t): t0 * factor**k below ``end``."""
    last = int(np.floor(np.log(end / t0) / np.log(factor))) + 1
    return spark.range(last + 1).select(F.col("id").alias("k"), (t0 * F.pow(F.lit(factor), F.col("id"))).alias("t")).where(F.col("t") < end)


def run_time_grids(ends: DataFrame, t0: float = 0.1, factor: float = 1.2) -> DataFrame:
    """(run_id, k, t): t0 * factor**k below each run's ``end`` (run_id, end)."""
    last = F.floor(F.log(F.col("end") / t0) / float(np.log(factor))) + 1
    steps = ends.where(F.col("end") > t0).select("run_id", "end", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    return steps.select("run_id", "k", (t0 * F.pow(F.lit(factor), F.col("k"))).alias("t"), "end").where(F.col("t") < F.col("end")).drop("end")


@dataclass(frozen=True)
class SolveSpec:
    """``start`` and ``absorb`` are basins; an absorbing one has no way out. With ``tolerance`` a run ends where ``until_converged`` ends it."""

    t0: float = 0.1
    end: float = 1e16
    factor: float = 1.2
    start: int = 0
    absorb: int | None = None
    mode: str = "diag"
    tolerance: float | None = None


def generator(z: np.ndarray, w: np.ndarray, absorb: int | None = None) -> np.ndarray:
    r = w / z[:, None]
    np.fill_diagonal(r, 0)
    np.fill_diagonal(r, -r.sum(axis=1))
    if absorb is not None:
        r[absorb] = 0
    return r


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: Taylor series of a halved argument, squared back."""
    norm = np.abs(a).sum(axis=1).max() if a.size else 0.0
    halvings = max(0, int(np.ceil(np.log2(max(norm, 1e-300)))) + 4)
    x = a / 2.0**halvings
    out = term = np.eye(len(a))
    for k in range(1, 19):
        term = term @ x / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def probabilities(z: np.ndarray, w: np.ndarray, times: np.ndarray, start: int, absorb: int | None = None, mode: str = "diag") -> np.ndarray:
    """(times, basins).  The zero eigenvalue of each component is held at zero, so mass stays whole at late times."""
    if absorb is not None or mode == "expm":
        r = generator(z, w, absorb)
        out = np.stack([expm(r * t)[start] for t in times])
        return out / out.sum(axis=1, keepdims=True)
    root = np.sqrt(z)
    r = generator(z, w)
    s = r * root[:, None] / root[None, :]
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    values = np.minimum(values, 0)
    values[values > -1e-13 * max(1.0, np.abs(values).max())] = 0
    left = vectors[start] / root[start]
    out = np.exp(np.outer(times, values)) * left @ (vectors * root[:, None]).T
    return np.clip(out, 0, None) / np.clip(out, 0, None).sum(axis=1, keepdims=True)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = (pdf["a"] == pdf["b"]).to_numpy()
    ids = np.unique(pdf["a"][own])
    a, b, v = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"]), pdf["value"].to_numpy(float)
    z, w = np.zeros(len(ids)), np.zeros((len(ids), len(ids)))
    z[a[own]] = v[own]
    np.add.at(w, (a[~own], b[~own]), v[~own])
    return ids, z, w + w.T


def _together(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("run_id", F.col("b").alias("a"), "b", F.col("z").alias("value")).unionByName(edges.select("run_id", "a", "b", F.col("w").alias("value")))


def _place(ids: np.ndarray, basin: int) -> int:
    """Where a basin stands among the run's; a basin that the run lacks is an error."""
    at = int(np.searchsorted(ids, basin))
    if at == len(ids) or ids[at] != basin:
        raise ValueError(f"the run has no basin {basin}")
    return at


def _components(w: np.ndarray) -> list[np.ndarray]:
    left, out = np.ones(len(w), bool), []
    while left.any():
        reached = np.zeros(len(w), bool)
        reached[np.flatnonzero(left)[0]] = True
        while True:
            more = reached | (w[reached] > 0).any(axis=0)
            if (more == reached).all():
                break
            reached = more
        out.append(np.flatnonzero(reached))
        left &= ~reached
    return out


def mean_passage(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(from, to) mean first passage times, by one inversion for each component; what can't be reached is NaN."""
    out = np.full((len(z), len(z)), np.nan)
    for own in _components(w):
        share = z[own] / z[own].sum()
        fundamental = np.linalg.inv(share[None, :] - generator(z[own], w[np.ix_(own, own)]))
        times = (np.diag(fundamental)[None, :] - fundamental) / share[None, :]
        np.fill_diagonal(times, 0.0)
        out[np.ix_(own, own)] = times
    return out


def symmetry_gap(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, gap): the greatest violation of detailed balance by a run's rates, relative to the greatest flow.

    ``edges`` may have both directions (a, b, w) of a pair with weights of their own.
    """
    flow = edges.where("a <> b").join(nodes.select("run_id", F.col("b").alias("a"), "z"), ["run_id", "a"]).select("run_id", "a", "b", "w", "z")
    pair = flow.groupBy("run_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.sum(F.when(F.col("a") < F.col("b"), F.col("w")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("a") > F.col("b"), F.col("w")).otherwise(0.0)).alias("down")
    )
    return pair.groupBy("run_id").agg((F.max(F.abs(F.col("up") - F.col("down"))) / F.max(F.greatest("up", "down"))).alias("gap"))


def _solved(pdf: pd.DataFrame, spec: SolveSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(basins, times, probabilities by time and basin) of one run's graph."""
    ids, z, w = _arrays(pdf)
    count = int(np.ceil(np.log(spec.end / spec.t0) / np.log(spec.factor)))
    t = spec.t0 * spec.factor ** np.arange(count)
    start = _place(ids, spec.start) if len(ids) > 1 else 0
    p = probabilities(z, w, t, start, None if spec.absorb is None else _place(ids, spec.absorb), spec.mode)
    if spec.tolerance is not None:  # here no row behind the end need travel
        near = np.flatnonzero(np.abs(p - z / z.sum()).sum(axis=1) < spec.tolerance)
        count = int(near[0]) + 1 if len(near) else count
        t, p = t[:count], p[:count]
    return ids, t, p


def solve(nodes: DataFrame, edges: DataFrame, spec: SolveSpec = SolveSpec()) -> DataFrame:
    """(run_id, t, b, p): state probabilities of each run over the time grid; each run must have ``start`` and ``absorb``, but for one of a single basin, which starts there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, t, p = _solved(pdf, spec)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "t": np.repeat(t, len(ids)), "b": np.tile(ids, len(t)), "p": p.ravel()})

    return _together(nodes, edges).groupBy("run_id").applyInPandas(run, "run_id long, t double, b long, p double")


def solve_events(nodes: DataFrame, edges: DataFrame, events: DataFrame, spec: SolveSpec = SolveSpec()) -> DataFrame:
    """(run_id, t, strand, i, j, p): each event's probability over the time grid, from those given each basin (run_id, b, strand, i, j, p).

    A product of the two tables of a run, so that neither a basin's probabilities over time nor its events at each time travel.
    """

    def run(graph: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if found.empty:
            return found.assign(t=0.0)[["run_id", "t", "strand", "i", "j", "p"]]
        ids, t, p = _solved(graph, spec)
        by = found.groupby(["strand", "i", "j"])
        own, at = by.size().reset_index(), by.ngroup().to_numpy()
        given = np.zeros((len(ids), len(own)))
        np.add.at(given, (np.searchsorted(ids, found["b"]), at), found["p"].to_numpy())
        times = {c: np.tile(own[c].to_numpy(), len(t)) for c in ("strand", "i", "j")}
        return pd.DataFrame({"run_id": found["run_id"].iloc[0], "t": np.repeat(t, len(own)), **times, "p": (p @ given).ravel()})

    graphs = _together(nodes, edges).groupBy("run_id")
    return graphs.cogroup(events.select("run_id", "b", "strand", "i", "j", "p").groupBy("run_id")).applyInPandas(run, "run_id long, t double, strand string, i int, j int, p double")


#: Steps of a propagation that are planned together before their result is kept as a table.
STEPS_AT_ONCE = 6


def _terms(most: float, tolerance: float) -> int:
    """How many jumps hold all but ``tolerance`` of a Poisson law of that mean."""
    k, log_p, left = 0, -most, 1.0
    while (left := left - math.exp(log_p)) > tolerance or k < most:
        k += 1
        log_p += math.log(most) - math.log(k)
    return k + 1


def propagate(nodes: DataFrame, edges: DataFrame, times: list[float], start: int = 0, tolerance: float = 1e-10, most_terms: int = 500) -> DataFrame:
    """(run_id, t, b, p): probabilities at a few times by jumps at one rate (uniformisation), as joins over edges.

    No run's matrix is held: a step joins the probabilities with the rates and sums them by basin, and every time takes its share of
    each step.  Steps are as many as the fastest run's jumps up to the last time, and some more for ``tolerance``; over ``most_terms`` is an error, and ``solve`` is for
    such times.  A run that lacks ``start`` has no rows.
    """
    ends = both_directions_by_run(edges.where("a <> b")).join(nodes.select("run_id", F.col("b").alias("s"), "z"), ["run_id", "s"])
    off = ends.select("run_id", "s", "t", (F.col("w") / F.col("z")).alias("r"))
    out = off.groupBy("run_id", "s").agg(F.sum("r").alias("o"))
    top = out.groupBy("run_id").agg(F.max("o").alias("rate"))
    every = nodes.select("run_id", F.col("b").alias("s")).join(out, ["run_id", "s"], "left").join(top, "run_id", "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    stay = every.select("run_id", "s", F.col("s").alias("t"), (1 - F.coalesce("o", F.lit(0.0)) / F.col("rate")).alias("p"), F.lit(1.0).alias("own"))
    steps = checkpointed(off.join(top, "run_id").select("run_id", "s", "t", (F.col("r") / F.col("rate")).alias("p"), F.lit(0.0).alias("own")).unionByName(stay))
    fastest = every.agg(F.max("rate")).first()[0]
    if fastest is None:
        return nodes.select("run_id", F.lit(0.0).alias("t"), "b", F.lit(0.0).alias("p")).limit(0)
    terms = _terms(fastest * max(times), tolerance)
    if terms > most_terms:
        raise ValueError(f"{terms} steps are needed, more than {most_terms}")
    held = nodes.where(F.col("b") == start).select("run_id")
    sums = [f"sum_{n}" for n in range(len(times))]

    def share(k: int, t: float) -> Column:
        mean = F.col("rate") * t
        return F.when(mean > 0, F.exp(k * F.log(mean) - mean - math.lgamma(k + 1))).otherwise(float(k == 0))

    state = every.join(held, "run_id", "left_semi").select("run_id", "s", "rate", (F.col("s") == start).cast("double").alias("v"))
    state = checkpointed(state.select("*", *[(share(0, t) * F.col("v")).alias(c) for c, t in zip(sums, times)]))
    kept = state
    for k in range(1, terms):
        joined = state.join(steps, ["run_id", "s"])
        state = joined.groupBy("run_id", F.col("t").alias("s")).agg(F.max("rate").alias("rate"), F.sum(F.col("v") * F.col("p")).alias("v"), *[F.sum(F.col(c) * F.col("own")).alias(c) for c in sums])
        state = state.select("run_id", "s", "rate", "v", *[(F.col(c) + share(k, t) * F.col("v")).alias(c) for c, t in zip(sums, times)])
        if k % STEPS_AT_ONCE == 0 or k == terms - 1:
            state = checkpointed(state)
            forget(kept)
            kept = state
    forget(steps)
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(c).alias("p")) for c, t in zip(sums, times)]))
    return state.select("run_id", "s", each.alias("x")).select("run_id", "x.t", F.col("s").alias("b"), "x.p")


def until_converged(kinetics: DataFrame, stationary: DataFrame, tolerance: float = 5e-3) -> DataFrame:
    """The rows up to and with the first time at which the probabilities are stationary within ``tolerance``."""
    gap = kinetics.join(stationary.select("run_id", "b", F.col("p").alias("pi")), ["run_id", "b"]).groupBy("run_id", "t").agg(F.sum(F.abs(F.col("p") - F.col("pi"))).alias("gap"))
    end = gap.where(F.col("gap") < tolerance).groupBy("run_id").agg(F.min("t").alias("end"))
    return kinetics.join(end, "run_id", "left").where(F.col("end").isNull() | (F.col("t") <= F.col("end"))).drop("end")


def passage_times(nodes: DataFrame, edges: DataFrame, target: int | None = None) -> DataFrame:
    """(run_id, a, b, time): mean first passage times from a to b, or to ``target`` alone.

    Times are exact for the chain in continuous time; unreachable targets give null.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, z, w = _arrays(pdf)
        if target is None:
            to, times = ids, mean_passage(z, w)
        else:
            at = _place(ids, target)
            own = next(c for c in _components(w) if at in c)
            others = own[own != at]
            to, times = ids[[at]], np.full((len(ids), 1), np.nan)
            times[others, 0] = np.linalg.solve(-generator(z[own], w[np.ix_(own, own)])[np.ix_(own != at, own != at)], np.ones(len(others)))
            times[at, 0] = 0.0
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "a": np.repeat(ids, len(to)), "b": np.tile(to, len(ids)), "time": times.ravel()})

    return _together(nodes, edges).groupBy("run_id").applyInPandas(run, "run_id long, a long, b long, time double")


def stationary(nodes: DataFrame) -> DataFrame:
    """(run_id, b, p): shares of a run's weight."""
    total = nodes.groupBy("run_id").agg(F.sum("z").alias("total"))
    return nodes.join(total, "run_id").select("run_id", "b", (F.col("z") / F.col("total")).alias("p"))
