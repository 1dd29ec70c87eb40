"""Analysis of probabilities over time: prominent states, events, dot plots, coarse-graining, trajectories.

Tables: kinetics (t, state, p), events (state, i, j, p), contributions (coarse, fine, part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def max_over_time(kinetics: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(state, max_p) of the states that reach the threshold."""
    return kinetics.groupBy("state").agg(F.max("p").alias("max_p")).where(F.col("max_p") >= threshold)


def prominent_states(kinetics: DataFrame, threshold: float = 0.02) -> DataFrame:
    return max_over_time(kinetics, threshold).select("state")


def event_probability(kinetics: DataFrame, events: DataFrame) -> DataFrame:
    """(t, i, j, p): probability of each event over time."""
    both = kinetics.select("t", "state", F.col("p").alias("ps")).join(events, "state")
    return both.groupBy("t", "i", "j").agg(F.sum(F.col("ps") * F.col("p")).alias("p"))


def positional_marginals(events: DataFrame, both_ends: bool = True) -> DataFrame:
    """(state, pos, p): probability that a position takes part in an event."""
    ends = F.array("i", "j") if both_ends else F.array("i")
    return events.select("state", F.explode(ends).alias("pos"), "p").groupBy("state", "pos").agg(F.sum("p").alias("p"))


def dotplot_max_states(kinetics: DataFrame, events: DataFrame) -> DataFrame:
    """(i, j, p): event probabilities weighted by each state's greatest probability."""
    most = kinetics.groupBy("state").agg(F.max("p").alias("most"))
    return events.join(most, "state").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("most")).alias("p"))


def dotplot_integrated(kinetics: DataFrame, events: DataFrame) -> DataFrame:
    """(i, j, p): weighted by the trapezoid mean of a state's probability over the time steps."""
    before = F.lag("p").over(Window.partitionBy("state").orderBy("t"))
    steps = kinetics.withColumn("area", (F.col("p") + before) / 2)
    mean = steps.groupBy("state").agg((F.sum("area") / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("mean"))
    return events.join(mean, "state").groupBy("i", "j").agg(F.sum(F.col("p") * F.coalesce("mean", F.lit(0.0))).alias("p"))


def dotplot_max_events(kinetics: DataFrame, events: DataFrame, start=None, end=None) -> DataFrame:
    """(i, j, p): the greatest probability of each event at times start <= t < end."""
    window = kinetics
    if start is not None:
        window = window.where(F.col("t") >= start)
    if end is not None:
        window = window.where(F.col("t") < end)
    return event_probability(window, events).groupBy("i", "j").agg(F.max("p").alias("p"))


def coarse_weights(contributions: DataFrame, fine: DataFrame) -> DataFrame:
    """(coarse, z): weights of coarse states from the fine ones' (state, z); absent states count nothing."""
    return contributions.join(fine.select(F.col("state").alias("fine"), "z"), "fine").groupBy("coarse").agg(F.sum(F.col("part") * F.col("z")).alias("z"))


def backpropagate(contributions: DataFrame, fine: DataFrame, coarse_p: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(state, p): fine probabilities from the coarse ones' (coarse, p), in proportion to the weights."""
    total = coarse_weights(contributions, fine).withColumnRenamed("z", "total")
    parts = contributions.join(fine.select(F.col("state").alias("fine"), "z"), "fine").join(total, "coarse").join(coarse_p, "coarse")
    out = parts.groupBy(F.col("fine").alias("state")).agg(F.sum(F.col("part") * F.col("z") / F.col("total") * F.col("p")).alias("p"))
    return out.where(F.col("p") >= threshold)


def coarse_events(contributions: DataFrame, fine: DataFrame, events: DataFrame) -> DataFrame:
    """(state, i, j, p): events of coarse states, weighted means of the fine ones'."""
    total = coarse_weights(contributions, fine).withColumnRenamed("z", "total")
    parts = contributions.join(fine.select(F.col("state").alias("fine"), "z"), "fine").join(total, "coarse")
    both = parts.join(events.withColumnRenamed("state", "fine"), "fine")
    return both.groupBy(F.col("coarse").alias("state"), "i", "j").agg(F.sum(F.col("part") * F.col("p") * F.col("z") / F.col("total")).alias("p"))


def relevant_states(kinetics: DataFrame, contributions: DataFrame, fine: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(state, p): fine states that matter: greatest coarse probabilities, sent back and cut at the threshold."""
    most = max_over_time(kinetics, threshold).select(F.col("state").alias("coarse"), F.col("max_p").alias("p"))
    return backpropagate(contributions, fine, most, threshold)


def average_trajectories(trajectories: DataFrame, runs: int) -> DataFrame:
    """(t, species, mean): means over runs of step functions (run, t, species, count).

    Counts become steps, the steps of all runs are added up in order of time, and
    the last value of each time counts.
    """
    of = Window.partitionBy("run", "species").orderBy("t", "n")
    steps = trajectories.withColumn("step", F.col("n") - F.coalesce(F.lag("n").over(of), F.lit(0)))
    per_time = steps.groupBy("species", "t").agg(F.sum("step").alias("step"))
    total = F.sum("step").over(Window.partitionBy("species").orderBy("t"))
    return per_time.select("t", "species", (total / F.lit(runs)).alias("mean"))
