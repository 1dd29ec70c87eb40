"""Dynamic programs per run: partition functions of hybrids and unpaired probabilities.

Each left end of a hybrid is independent of the others, and each strand of a run
is: they are the groups of the kernels.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinforge.functions import energy, loops
from basinforge.functions.sequence import PAIRS
from basinforge.operators.lineage import checkpointed, spread, unbroadcast


@dataclass(frozen=True)
class HybridSpec:
    """Greatest site length and length difference, unpaired bases in a loop, temperature, loop parameters."""

    most: int = 8
    difference: int = 8
    loop: int = 6
    celsius: float = 37.0
    table: loops.LoopTable = field(default_factory=loops.LoopTable.plain)


_STACK = energy.stack_table()
#: Numbers that a batch of left ends may hold at once.
BATCH_VALUES = 2_000_000


class HybridBatch:
    """The weights of all sites of many left ends at once: one step for each pair of offsets and each loop, over all left ends."""

    def __init__(self, strands: list[tuple[str, str]], lefts: list[tuple[int, int]], spec: HybridSpec):
        self.spec = spec
        kept = {s: loops.codes(s) for pair in set(strands) for s in pair}
        self.letters = np.full((2, len(lefts), spec.most + 1), loops.OTHER, np.int64)
        for r, (pair, at) in enumerate(zip(strands, lefts)):
            for k in (0, 1):
                own = kept[pair[k]][at[k] - 1 : at[k] + spec.most]
                self.letters[k, r, : len(own)] = own
        self.q = np.zeros((spec.most, spec.most, len(lefts)))
        self.q[0, 0] = 1.0
        self.can = loops.pairable()

    def steps(self, a: int, b: int) -> list[tuple[int, int, np.ndarray]]:
        """(d1, d2, weight): of sites to the offsets a and b whose last pair but one is d1 and d2 before."""
        out, x, spec = [], self.letters, self.spec
        rt = energy.thermal_energy(spec.celsius)
        here = self.can[x[0, :, a], x[1, :, b]]
        for d1 in range(1, min(a, spec.loop + 1) + 1):
            for d2 in range(1, min(b, spec.loop + 2 - d1) + 1):
                before = self.q[a - d1, b - d2]
                rows = np.flatnonzero(here & (before > 0))
                if len(rows):
                    c, e = a - d1, b - d2
                    at = lambda i, j: np.stack([x[0, rows, i], x[1, rows, j]])  # noqa: B023, E731
                    weight = np.zeros(len(before))
                    weight[rows] = before[rows] * np.exp(-spec.table.energies(d1, d2, at(c, e), at(a, b), at(c + 1, e + 1), at(a - 1, b - 1)) / 100 / rt)
                    out.append((d1, d2, weight))
        return out

    def run(self) -> HybridBatch:
        for a in range(1, self.spec.most):
            for b in range(1, self.spec.most):
                for _, _, weight in self.steps(a, b):
                    self.q[a, b] += weight
        return self

    def _near(self) -> np.ndarray:
        n = np.arange(self.spec.most)
        return np.abs(n[:, None] - n[None, :]) <= self.spec.difference

    def sites(self) -> tuple[np.ndarray, ...]:
        """(left end's place, offset, offset, weight) of all sites within the length difference."""
        a, b, left = np.nonzero((self.q > 0) & self._near()[:, :, None])
        return left, a, b, self.q[a, b, left]

    def conditional(self) -> tuple[np.ndarray, ...]:
        """(left end's place, offset, offset, u1, u2, weight): of each site with u1 and u2 letters before its last pair unpaired.

        The steps to a site lie in a table by the letters that they leave unpaired; sums over it from both sides give all u1 and u2.
        """
        near, parts = self._near(), []
        most = self.spec.loop + 1
        for a in range(1, self.spec.most):
            for b in range(1, self.spec.most):
                if not near[a, b]:
                    continue
                table = np.zeros((most, most, self.q.shape[2]))
                for d1, d2, weight in self.steps(a, b):
                    table[d1 - 1, d2 - 1] = weight
                sums = table[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1]
                u1, u2, left = np.nonzero(sums)
                parts.append((left, np.full(len(left), a), np.full(len(left), b), u1, u2, sums[u1, u2, left]))
        return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5 + (np.zeros(0),)


def hybrid_weights(seq_a: str, seq_b: str, i1: int, i2: int, spec: HybridSpec) -> list[tuple[int, int, float]]:
    """(j1, j2, q) with q > 0 of all right ends for the left end (i1, i2), positions from 1."""
    _, a, b, q = HybridBatch([(seq_a, seq_b)], [(i1, i2)], spec).run().sites()
    return [(i1 + int(x), i2 + int(y), float(w)) for x, y, w in zip(a, b, q)]


def _by_batches(rows: DataFrame, spec: HybridSpec, made: Callable[[HybridBatch], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``made``'s rows of batches of left ends (run_id, i1, i2, seq_a, seq_b), offsets as positions."""
    size = max(1, BATCH_VALUES // (spec.most * spec.most))

    def run(batches):
        for whole in batches:
            for k in range(0, len(whole), size):
                pdf = whole.iloc[k : k + size]
                out = made(HybridBatch(list(zip(pdf.seq_a, pdf.seq_b)), list(zip(pdf.i1, pdf.i2)), spec).run())
                left = out.pop("left")
                i1, i2 = pdf.i1.to_numpy()[left], pdf.i2.to_numpy()[left]
                yield pd.DataFrame({"run_id": pdf.run_id.to_numpy()[left], "i1": i1, "i2": i2, "j1": i1 + out.pop("a"), "j2": i2 + out.pop("b"), **out})

    return rows.mapInPandas(run, schema)


def hybrid_partition(runs: DataFrame, left_ends: DataFrame, spec: HybridSpec = HybridSpec()) -> DataFrame:
    """(run_id, i1, i2, j1, j2, q) of all sites from the pairable left ends (run_id, i1, i2)."""
    rows = left_ends.join(runs.select("run_id", "seq_a", "seq_b"), "run_id")
    made = lambda batch: dict(zip(("left", "a", "b", "q"), batch.sites()))
    return _by_batches(rows, spec, made, "run_id long, i1 int, i2 int, j1 int, j2 int, q double")


def conditional_hybrid(runs: DataFrame, left_ends: DataFrame, spec: HybridSpec = HybridSpec(), left: bool = False) -> DataFrame:
    """(run_id, i1, i2, j1, j2, u1, u2, q): weights of sites with u1 and u2 letters next to their right end's pair (``left``: the left end's) unpaired.

    The left ends' weights are the right ends' of both strands turned round and exchanged.
    """
    made = lambda batch: dict(zip(("left", "a", "b", "u1", "u2", "q"), batch.conditional()))
    schema = "run_id long, i1 int, i2 int, j1 int, j2 int, u1 int, u2 int, q double"
    strands = runs.select("run_id", "seq_a", "seq_b")
    if not left:
        return _by_batches(left_ends.join(strands, "run_id"), spec, made, schema)
    n1, n2 = F.length("seq_a"), F.length("seq_b")
    turned = left_ends.join(strands, "run_id").select("run_id", (n2 - F.col("i2") + 1).alias("i1"), (n1 - F.col("i1") + 1).alias("i2"), F.reverse("seq_b").alias("seq_a"), F.reverse("seq_a").alias("seq_b"))
    found = _by_batches(turned, replace(spec, table=spec.table.turned()), made, schema).join(runs.select("run_id", n1.alias("n1"), n2.alias("n2")), "run_id")
    back = {"i1": F.col("n1") - F.col("j2") + 1, "i2": F.col("n2") - F.col("j1") + 1, "j1": F.col("n1") - F.col("i2") + 1, "j2": F.col("n2") - F.col("i1") + 1}
    return found.select("run_id", *[v.cast("int").alias(k) for k, v in back.items()], F.col("u2").alias("u1"), F.col("u1").alias("u2"), "q")


def interaction_probability(hybrid: DataFrame) -> DataFrame:
    """(run_id, i1, i2, j1, j2, k1, k2, p): probability of the pair (k1, k2) inside each site.

    p = Q(i..k) Q(k..j) / Q(i..j); both joins are on one end, so they are equi-joins.
    """
    left = hybrid.select("run_id", "i1", "i2", F.col("j1").alias("k1"), F.col("j2").alias("k2"), F.col("q").alias("ql"))
    right = hybrid.select("run_id", F.col("i1").alias("k1"), F.col("i2").alias("k2"), "j1", "j2", F.col("q").alias("qr"))
    whole = hybrid.select("run_id", "i1", "i2", "j1", "j2", F.col("q").alias("q"))
    split = left.join(unbroadcast(right), ["run_id", "k1", "k2"]).join(unbroadcast(whole), ["run_id", "i1", "i2", "j1", "j2"])
    return split.select("run_id", "i1", "i2", "j1", "j2", "k1", "k2", (F.col("ql") * F.col("qr") / F.col("q")).alias("p"))


def fold_tables(seq: str, celsius: float = 37.0, least_loop: int = 3, span: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(inside, pair weights inside) of one strand in a stacking model without pseudoknots: q[i, j] over i..j.

    Paired positions are less than ``span`` apart, if it is given.
    """
    n, rt = len(seq), energy.thermal_energy(celsius)
    q, b = np.ones((n + 2, n + 2)), np.zeros((n + 2, n + 2))
    closing = math.exp(-4.0 / rt)
    for d in range(least_loop + 1, n):
        for i in range(1, n - d + 1):
            j = i + d
            if seq[i - 1] + seq[j - 1] in PAIRS and (span is None or d < span):
                w = closing * q[i + 1, j - 1]  # closing what lies inside
                if b[i + 1, j - 1]:
                    w += b[i + 1, j - 1] * math.exp(-_STACK[seq[i - 1] + seq[j - 1] + seq[i] + seq[j - 2]] / 100 / rt)
                b[i, j] = w
            k = slice(i, j - least_loop)
            q[i, j] = q[i, j - 1] + q[i, i - 1 : j - least_loop - 1] @ b[k, j]
    return q, b


def outside_weights(seq: str, q: np.ndarray, b: np.ndarray, celsius: float = 37.0, least_loop: int = 3) -> np.ndarray:
    """Derivative of the whole weight by each pair's: what stands around the pair.

    The inside recursion is differentiated backwards.
    """
    n, rt = len(seq), energy.thermal_energy(celsius)
    dq, db = np.zeros_like(q), np.zeros_like(b)
    dq[1, n] = 1.0
    closing = math.exp(-4.0 / rt)
    for d in range(n - 1, least_loop, -1):
        for i in range(1, n - d + 1):
            j = i + d
            if dq[i, j]:
                k = slice(i, j - least_loop)
                before = slice(i - 1, j - least_loop - 1)
                dq[i, j - 1] += dq[i, j]
                db[k, j] += dq[i, j] * q[i, before]
                dq[i, before] += dq[i, j] * b[k, j]
            if db[i, j] and b[i, j]:
                dq[i + 1, j - 1] += db[i, j] * closing
                if b[i + 1, j - 1]:
                    db[i + 1, j - 1] += db[i, j] * math.exp(-_STACK[seq[i - 1] + seq[j - 1] + seq[i] + seq[j - 2]] / 100 / rt)
    return np.where(b > 0, db, 0.0)


def unpaired_windows(seq: str, most: int, celsius: float = 37.0, span: int | None = None, least_loop: int = 3) -> list[tuple[int, int, float]]:
    """(i, j, p): probability that i..j is unpaired, for windows up to ``most``, from one fold.

    Either no pair is around the window, or there is an innermost one: what stands
    around that pair, and both sides of the window within it, multiply.
    """
    n = len(seq)
    if not n:
        return []
    q, b = fold_tables(seq, celsius, least_loop, span)
    around = outside_weights(seq, q, b, celsius, least_loop) * math.exp(-4.0 / energy.thermal_energy(celsius))
    out = []
    for i in range(1, n + 1):
        left = q[2 : i + 1, i - 1] @ around[1:i] if i > 1 else np.zeros(n + 2)  # by the pair's right end
        for j in range(i, min(n, i + most - 1) + 1):
            inner = left[j + 1 : n + 1] @ q[j + 1, j : n]
            out.append((i, j, float((q[1, i - 1] * q[j + 1, n] + inner) / q[1, n])))
    return out


def _fold_weights(celsius: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether two letters pair, the weight of a stack by its outer and its inner letters; none where letters can't pair)."""
    pairs = loops.pairable()
    both = pairs[:, :, None, None] & pairs[None, None, :, :]
    return pairs, np.where(both, np.exp(-loops.LoopTable.plain().stack / 100 / energy.thermal_energy(celsius)), 0.0)


def local_unpaired_windows(seq: str, most: int, window: int, span: int | None = None, celsius: float = 37.0, least_loop: int = 3) -> list[tuple[int, int, float]]:
    """(i, j, p): the mean, over all stretches of ``window`` letters that hold i..j, of the probability that i..j is unpaired in the stretch's fold.

    Paired positions are less than ``span`` apart.  All stretches share one table of weights by start and length, and the sum over stretches of the logarithms of
    their weights is differentiated backwards once; work is done for all starts at a time, and memory
    grows with letters times ``window``.  A stretch of all letters makes it the fold of the whole strand.
    """
    n = len(seq)
    if not n:
        return []
    window = min(window, n)
    span = min(span or window, window)
    x, (pairs, stacks), closing = loops.codes(seq), _fold_weights(celsius), math.exp(-4.0 / energy.thermal_energy(celsius))
    # q[d + 1][i] is the weight of i..i + d (from 0), b[d][i] that of the pair (i, i + d), at[d] its stack on the pair within
    q = [np.ones(n + 1)]
    b: list[np.ndarray] = []
    at: list[np.ndarray] = []
    for d in range(window):
        m = n - d
        if least_loop < d < span:
            inner = np.zeros(m) if d < least_loop + 3 else np.where(b[d - 2][1 : m + 1] > 0, stacks[x[:m], x[d:], x[1 : m + 1], x[d - 1 : n - 1]], 0.0)
            at.append(inner)
            b.append(np.where(pairs[x[:m], x[d:]], closing * q[d - 1][1 : m + 1] + (inner * b[d - 2][1 : m + 1] if d >= 2 else 0.0), 0.0))
        else:
            at.append(np.zeros(m))
            b.append(np.zeros(m))
        whole = q[d][:m].copy()
        for k in range(least_loop + 1, min(d, span - 1) + 1):
            whole += q[d - k][:m] * b[k][d - k : d - k + m]
        q.append(whole)
    dq, db = [np.zeros_like(v) for v in q], [np.zeros_like(v) for v in b]
    dq[window] += 1 / q[window]
    for d in range(window - 1, -1, -1):
        m, g = n - d, dq[d + 1]
        dq[d][:m] += g
        for k in range(least_loop + 1, min(d, span - 1) + 1):
            db[k][d - k : d - k + m] += g * q[d - k][:m]
            dq[d - k][:m] += g * b[k][d - k : d - k + m]
        if least_loop < d < span:
            h = np.where(b[d] > 0, db[d], 0.0)
            dq[d - 1][1 : m + 1] += h * closing
            db[d - 2][1 : m + 1] += h * at[d]
    around = [np.where(w > 0, v, 0.0) * closing for v, w in zip(db, b)]
    # what stands left of position i within the innermost pair whose right end is i + e
    left = [np.zeros(n + 1) for _ in range(span)]
    for e in range(span):
        for back in range(1, span - e):
            d = e + back  # the pair (i - back, i + e)
            if d > least_loop and n - d > 0:
                left[e][back : n - e] += q[back - 1][1 : n - d + 1] * around[d]
    out = []
    for u in range(1, min(most, window) + 1):
        starts = n - u + 1
        total = np.zeros(starts)
        for before in range(window - u + 1):  # letters of the stretch before i
            lo, hi = before, n - window + before + 1
            first = np.arange(lo, hi)
            total[lo:hi] += q[before][first - before] * q[window - u - before][first + u] / q[window][first - before]
        for y in range(1, span - u + 1):
            e = u - 1 + y
            if e < span and n - e > 0:
                total[: n - e] += left[e][: n - e] * q[y - 1][u : u + n - e]
        i = np.arange(starts)
        stretches = np.minimum(i, n - window) - np.maximum(i + u - window, 0) + 1
        out += [(int(k) + 1, int(k) + u, float(v)) for k, v in zip(i, total / stretches)]
    return sorted(out)


def conditional_windows(seq: str, most: int, least: int = 1, distance: int = 0, celsius: float = 37.0, span: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """(i, j, k, l, p): the probability that k..l is unpaired given that i..j is, for windows of ``least`` to ``most`` letters with at least ``distance`` letters between them.

    A strand whose first window is closed to pairs is folded for each first window; its fold gives all second ones.
    """
    out = []
    n = len(seq)
    for i in range(1, n + 1):
        for j in range(i + least - 1, min(n - distance - least, i + most - 1) + 1):
            out += [(i, j, k, l, p) for k, l, p in windows_given(seq, i, j, most, celsius, span) if k > j + distance and l - k + 1 >= least]
    return out


def windows_given(seq: str, i: int, j: int, most: int, celsius: float = 37.0, span: int | None = None) -> list[tuple[int, int, float]]:
    """(k, l, p): probability that k..l is unpaired in the folds that leave i..j unpaired."""
    closed = seq[: i - 1] + "." * (j - i + 1) + seq[j:]
    return local_unpaired_windows(closed, most, len(seq), span, celsius)


def unpaired_probabilities(runs: DataFrame, most: int = 4, celsius: float = 37.0, span: int | None = None, window: int | None = None) -> DataFrame:
    """(strand, i, j, p) of each distinct strand among the runs, read from its 5' end.

    With ``window`` the mean over local folds of that many letters; else of the fold of the whole strand.
    """
    strands = spread(runs.select(F.explode(F.array("seq_a", "seq_b")).alias("strand")).distinct(), "strand")

    def run(batches):
        for pdf in batches:
            out = [(s, *x) for s in pdf.strand for x in local_unpaired_windows(s, most, window or len(s), span, celsius)]
            yield pd.DataFrame(out, columns=["strand", "i", "j", "p"])

    return strands.mapInPandas(run, "strand string, i int, j int, p double")


def conditional_probabilities(runs: DataFrame, most: int, least: int = 1, distance: int = 0, celsius: float = 37.0, span: int | None = None) -> DataFrame:
    """(strand, i, j, k, l, p) of each distinct strand: p is the probability that k..l is unpaired given that i..j is.

    A row of the kernel's input is one first window, so a long strand's folds spread over tasks.
    """
    strands = runs.select(F.explode(F.array("seq_a", "seq_b")).alias("strand")).distinct()
    n = F.length("strand")
    firsts = strands.where(n >= 2 * least + distance).select("strand", F.explode(F.sequence(F.lit(1), n - 2 * least - distance + 1)).alias("i"))
    firsts = firsts.select("strand", "i", F.explode(F.sequence(F.col("i") + least - 1, F.least(n - distance - least, F.col("i") + most - 1))).alias("j"))

    def run(batches):
        for pdf in batches:
            out = [(s, i, j, k, l, p) for s, i, j in zip(pdf.strand, pdf.i, pdf.j) for k, l, p in windows_given(s, i, j, most, celsius, span) if k > j + distance and l - k + 1 >= least]
            yield pd.DataFrame(out, columns=["strand", "i", "j", "k", "l", "p"])

    dealt = spread(firsts, "strand", "i", "j")  # else a strand's folds stay in the task that made its rows
    return dealt.mapInPandas(run, "strand string, i int, j int, k int, l int, p double")


def joint_windows(runs: DataFrame, most: int, least: int, distance: int, celsius: float = 37.0, span: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(run_id, i, j, k, l, p) for the first and for the second strand, in each run's own positions: the probability that both windows are unpaired.

    It is that of the one times that of the other given the one.
    """
    turned = runs.select("run_id", "seq_a", F.reverse("seq_b").alias("seq_b"))
    single = unpaired_probabilities(turned, most, celsius, span).withColumnRenamed("p", "p1")
    given = conditional_probabilities(turned, most, least, distance, celsius, span)
    both = given.join(single, ["strand", "i", "j"]).select("strand", "i", "j", "k", "l", (F.col("p") * F.col("p1")).alias("p"))
    both = checkpointed(both)  # read for both strands, folded once
    n = F.length("seq_b")
    first = turned.join(both, F.col("seq_a") == F.col("strand")).select("run_id", "i", "j", "k", "l", "p")
    ends = {"i": "l", "j": "k", "k": "j", "l": "i"}
    second = turned.join(both, F.col("seq_b") == F.col("strand")).select("run_id", *[(n - F.col(b) + 1).alias(a) for a, b in ends.items()], "p")
    return first, second


def strand_windows(runs: DataFrame, most: int, celsius: float = 37.0, span: int | None = None, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(run_id, i, j, p) for the first and for the second strand, in each run's own positions.

    The second strand is counted from its 3' end, and is turned round to be folded.
    """
    turned = runs.select("run_id", "seq_a", F.reverse("seq_b").alias("seq_b"))
    windows = checkpointed(unpaired_probabilities(turned, most, celsius, span, window))  # read for both strands, folded once
    first = turned.join(windows, F.col("seq_a") == F.col("strand")).select("run_id", "i", "j", "p")
    n = F.length("seq_b")
    second = turned.join(windows, F.col("seq_b") == F.col("strand")).select("run_id", (n - F.col("j") + 1).alias("i"), (n - F.col("i") + 1).alias("j"), "p")
    return first, second


def fold_pairs(seq: str, celsius: float = 37.0, least_loop: int = 3) -> list[tuple[int, int, float]]:
    """(k, l, p): base-pair probabilities of one strand; positions written "." can't pair.

    A pair's probability is its weight times what stands around it, over the whole.
    """
    n = len(seq)
    if n < least_loop + 2:
        return []
    q, b = fold_tables(seq, celsius, least_loop)
    p = b * outside_weights(seq, q, b, celsius, least_loop) / q[1, n]
    return [(int(x), int(y), float(p[x, y])) for x, y in zip(*np.nonzero(p))]


def region_pair_probabilities(regions: DataFrame, celsius: float = 37.0, threshold: float = 0.0) -> DataFrame:
    """(strand, i, j, k, l, p): base pairs of a strand whose region i..j is held by the other strand.

    ``regions`` has strand (its letters), i and j; each distinct one is folded once.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for s, i, j in zip(pdf.strand, pdf.i, pdf.j):
                masked = s[: i - 1] + "." * (j - i + 1) + s[j:]
                out += [(s, i, j, *x) for x in fold_pairs(masked, celsius) if x[2] >= threshold]
            yield pd.DataFrame(out, columns=["strand", "i", "j", "k", "l", "p"])

    distinct = regions.where("strand is not null").select("strand", "i", "j").distinct()
    # not by the keys in the same order, by which they are dealt already: the planner would drop the dealing and put small tables in one task
    return spread(distinct, "i", "j", "strand").mapInPandas(run, "strand string, i int, j int, k int, l int, p double")


def basin_pair_weights(members: DataFrame, hybrid: DataFrame) -> DataFrame:
    """(run_id, basin, k1, k2, w): weight of each pair between the strands over a basin's states.

    ``members`` has run_id, basin, the site and its weight z; states of one site.
    """
    inner = interaction_probability(hybrid)
    both = members.join(inner, ["run_id", "i1", "i2", "j1", "j2"])
    return both.groupBy("run_id", "basin", "k1", "k2").agg(F.sum(F.col("z") * F.col("p")).alias("w"))
