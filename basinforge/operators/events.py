"""Base pairs within each strand as events of states, of basins and of final states, over time.

States of a run are known by one column, ``state``, a struct of run_id and number, so that the operators of
``analysis`` work on many runs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinforge.functions import energy
from basinforge.operators import analysis, hybrid
from basinforge.operators.lineage import checkpointed, unbroadcast


def of_run(number: str) -> Column:
    """A run's state as one value."""
    return F.struct(F.col("run_id"), F.col(number).cast("long").alias("id"))


def relevant_states(most: DataFrame, contributions: DataFrame, basins: DataFrame, members: DataFrame, states: DataFrame, threshold: float = 0.01, celsius: float = 37.0) -> DataFrame:
    """(run_id, rank, p): enumerated states that matter.

    ``most`` (run_id, b, p) has final states' greatest probabilities. Those of ``threshold`` or more go back to the basins that
    they are made of (``contributions``: run_id, coarse, fine, part; ``basins``: run_id, basin, z) and from there to the states, cut at the threshold each time.
    """
    final = most.where(F.col("p") >= threshold).select(of_run("b").alias("coarse"), "p")
    to_basins = contributions.select(of_run("coarse").alias("coarse"), of_run("fine").alias("fine"), "part")
    reached = analysis.backpropagate(to_basins, basins.select(of_run("basin").alias("state"), "z"), final, threshold)
    weight = states.select(of_run("rank").alias("state"), energy.boltzmann(F.col("energy") / 100.0, celsius).alias("z"))
    to_states = members.select(of_run("basin").alias("coarse"), of_run("rank").alias("fine"), F.lit(1.0).alias("part"))
    found = analysis.backpropagate(to_states, weight, reached.select(F.col("state").alias("coarse"), "p"), threshold)
    return found.select("state.run_id", F.col("state.id").alias("rank"), "p")


def state_regions(states: DataFrame, runs: DataFrame, *more: str) -> DataFrame:
    """(run_id, rank, strand, letters, i, j): what each state holds of each strand, whose letters are read from the 5' end; 1 to 0 for none. ``more`` columns of states stay."""
    length = F.length("seq_b")
    a = F.struct(F.lit("a").alias("strand"), F.col("seq_a").alias("letters"), F.coalesce("i1", F.lit(1)).alias("i"), F.coalesce("j1", F.lit(0)).alias("j"))
    b = F.struct(F.lit("b").alias("strand"), F.reverse("seq_b").alias("letters"), F.coalesce(length - F.col("j2") + 1, F.lit(1)).alias("i"), F.coalesce(length - F.col("i2") + 1, F.lit(0)).alias("j"))
    both = states.select("run_id", "rank", *more, "i1", "i2", "j1", "j2").join(runs.select("run_id", "seq_a", "seq_b"), "run_id")
    return both.select("run_id", "rank", *more, F.explode(F.array(a, b)).alias("r")).select("run_id", "rank", *more, "r.*")


def pair_events(states: DataFrame, runs: DataFrame, threshold: float = 0.01, celsius: float = 37.0) -> DataFrame:
    """(run_id, rank, strand, i, j, p): base pairs of each strand given each state of one site or none.

    Each region of each distinct strand is folded once, whichever and however many states and runs hold it.
    """
    regions = state_regions(states, runs)
    distinct = regions.select(F.col("letters").alias("strand"), "i", "j")
    folded = hybrid.region_pair_probabilities(distinct, celsius, threshold)
    folded = folded.select(F.col("strand").alias("letters"), "i", "j", "k", "l", "p")
    return regions.join(folded, ["letters", "i", "j"]).select("run_id", "rank", "strand", F.col("k").alias("i"), F.col("l").alias("j"), "p")


def basin_events(events: DataFrame, members: DataFrame, states: DataFrame, celsius: float = 37.0) -> DataFrame:
    """(run_id, basin, strand, i, j, p): a basin's events are its states' by weight; states without events count as having none."""
    parts = members.select(of_run("basin").alias("coarse"), of_run("rank").alias("fine"), F.lit(1.0).alias("part"))
    weight = states.select(of_run("rank").alias("state"), energy.boltzmann(F.col("energy") / 100.0, celsius).alias("z"))
    found = analysis.coarse_events(parts, weight, _as_events(events, "rank"))
    return _as_rows(found, "basin")


def whole_basin_events(basins: DataFrame, members: DataFrame, states: DataFrame, runs: DataFrame, celsius: float = 37.0) -> DataFrame:
    """(run_id, basin, strand, i, j, p): what ``basin_events`` gives of all pairs of all states, none too rare to count; ``basins`` has run_id, basin, z.

    States of a basin that hold the same region of a strand count together, so that regions and not states are joined with their pairs.
    """
    weighed = states.withColumn("z", energy.boltzmann(F.col("energy") / 100.0, celsius)).join(members.select("run_id", "rank", "basin"), ["run_id", "rank"])
    held = state_regions(weighed, runs, "basin", "z").groupBy("run_id", "basin", "strand", "letters", "i", "j").agg(F.sum("z").alias("held"))
    held = checkpointed(held.join(basins.select("run_id", "basin", "z"), ["run_id", "basin"]).withColumn("held", F.col("held") / F.col("z")).drop("z"))
    folded = hybrid.region_pair_probabilities(held.select(F.col("letters").alias("strand"), "i", "j"), celsius).withColumnRenamed("strand", "letters")
    both = unbroadcast(held).join(folded, ["letters", "i", "j"])
    return both.groupBy("run_id", "basin", "strand", F.col("k").alias("i"), F.col("l").alias("j")).agg(F.sum(F.col("held") * F.col("p")).alias("p"))


def final_events(events: DataFrame, contributions: DataFrame, basins: DataFrame) -> DataFrame:
    """(run_id, b, strand, i, j, p): final states' events from basins'."""
    parts = contributions.select(of_run("coarse").alias("coarse"), of_run("fine").alias("fine"), "part")
    found = analysis.coarse_events(parts, basins.select(of_run("basin").alias("state"), "z"), _as_events(events, "basin"))
    return _as_rows(found, "b")


def paired_over_time(kinetics: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, t, strand, i, j, p): probability over time that a pair is there, from final states' (run_id, t, b, p) and their events."""
    over = analysis.event_probability(kinetics.select("t", of_run("b").alias("state"), "p"), _as_events(events, "b"))
    return over.select("i.run_id", "t", "i.strand", "i.i", "j", "p")


def of_strand(events: DataFrame, strand: str) -> DataFrame:
    """The events of one strand, without its name."""
    return events.where(F.col("strand") == strand).drop("strand")


def _as_events(events: DataFrame, number: str) -> DataFrame:
    return events.select(of_run(number).alias("state"), F.struct("run_id", "strand", "i").alias("i"), "j", "p")


def _as_rows(events: DataFrame, number: str) -> DataFrame:
    return events.select("state.run_id", F.col("state.id").alias(number), "i.strand", "i.i", "j", "p")
