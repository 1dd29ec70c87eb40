"""The whole analysis of a batch of runs, in stages that write Parquet and can be taken up again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinforge.operators import analysis, ctmc, events, graph, hybrid, landscape, two_sites
from basinforge.operators.lineage import checkpointed
from basinforge.sources import config


@dataclass
class Stages:
    """Runs stages under ``root``. With ``reuse`` a finished stage is read, unless one before it ran anew; ``dry`` only lists."""

    spark: SparkSession
    root: str
    reuse: bool = False
    dry: bool = False
    ran: list[str] = field(default_factory=list)

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        path = f"{self.root}/{name}"
        if not (self.reuse and not self.ran and self._there(path)):
            self.ran.append(name)
            if self.dry:
                return None
            make().write.mode("overwrite").parquet(path)
        return None if self.dry else self.spark.read.parquet(path)


class KineticsRun:
    """A batch of runs and all that follows from it, each table made when it is asked for.

    ``runs`` has run_id, seq_a and seq_b, the second strand from its 3' end.  The settings' temperature
    holds for all; with ``model`` states have the energies of partition functions, with ``homodimer`` mirror images are
    one state (of one site); basins are pruned by the strictest of the limits given, by value, by number and by quantile, in all steps of ``graph.prune_run``.
    """

    def __init__(self, runs: DataFrame, stages: Stages, settings: dict | None = None):
        self.runs, self.stages, self.settings = runs, stages, settings or config.load()
        self.celsius = self.settings["celsius"]
        self.limits = landscape.SiteLimits(**{k: self.settings["enumerate"][k] for k in ("least", "most", "difference", "distance", "max_hybrid", "max_total")})

    def _energies(self) -> landscape.ModelEnergies | None:
        asked = self.settings["enumerate"]
        return landscape.model_energies(self.runs, self.limits, self.celsius, asked["span"], asked["window"]) if asked["model"] else None

    @cached_property
    def states(self) -> DataFrame:
        """Ranked states; with ``double`` those of two sites, too, which a model gives the probability that both spans are unpaired."""
        asked = self.settings["enumerate"]

        def make() -> DataFrame:
            sites = landscape.enumerate_sites(self.runs, self.limits, self._energies())
            if not asked["double"]:
                return landscape.rank_states(landscape.with_open_state(self.runs, sites))
            sites, joint = checkpointed(sites), None
            if asked["model"]:
                joint = two_sites.JointUnpaired(*hybrid.joint_windows(self.runs, self.limits.most, self.limits.least, self.limits.distance, self.celsius, asked["span"]), self.celsius)
            return two_sites.states(self.runs, sites, two_sites.double_states(sites, self.limits, joint))

        return self.stages.stage("states", make)

    @cached_property
    def moves(self) -> DataFrame:
        states = self.states
        if not self.settings["enumerate"]["double"]:
            return self.stages.stage("moves", lambda: landscape.moves(states, self.limits))
        return self.stages.stage("moves", lambda: two_sites.moves(states, two_sites.sites_between(self.runs, self.limits, self._energies()), self.limits))

    @cached_property
    def members(self) -> DataFrame:
        states, moves = self.states, self.moves

        def make() -> DataFrame:
            active = landscape.without_frozen(states, moves)
            parents = landscape.gradient_parents(active, moves)
            if self.settings["enumerate"]["homodimer"] and not self.settings["enumerate"]["double"]:
                parents = landscape.merge_symmetric(active, parents, self.runs.select("run_id", F.length("seq_a").alias("n")))
            return landscape.basin_members(landscape.resolve_parents(parents))

        return self.stages.stage("members", make)

    @cached_property
    def basins(self) -> DataFrame:
        states, members = self.states, self.members
        return self.stages.stage("basins", lambda: landscape.basin_summary(states, members, self.celsius))

    @cached_property
    def transitions(self) -> DataFrame:
        moves, members = self.moves, self.members
        return self.stages.stage("transitions", lambda: landscape.basin_transitions(moves, members, self.celsius))

    @cached_property
    def pruned(self) -> DataFrame:
        """What the prune run leaves: basins numbered anew, the open state's basin 1 where there are two."""
        p, basins, transitions = self.settings["prune"], self.basins, self.transitions
        limits = graph.PruneLimits(p["max_outflow"], p["min_share"], p["min_rate"], p["special_first"])
        asked = {f"{by}_{what}": p[f"{by}_{what}"] for what in ("outflow", "share") for by in ("number", "quantile")}
        steps = graph.PruneSteps(limits, p["prefactor"], **asked, simplify=p["simplify"], keep=None if p["keep"] is None else tuple(p["keep"]), connect=p["connect"])
        nodes, edges = basins.select("run_id", F.col("basin").alias("b"), "z"), transitions.withColumnRenamed("z", "w")
        return self.stages.stage("pruned", lambda: graph.prune_run(nodes, edges, steps))

    @property
    def final_nodes(self) -> DataFrame:
        return self.pruned.where("kind = 'node'").select("run_id", F.col("a").alias("b"), F.col("value").alias("z"))

    @property
    def final_edges(self) -> DataFrame:
        return self.pruned.where("kind = 'edge'").select("run_id", "a", "b", F.col("value").alias("w"))

    @property
    def contributions(self) -> DataFrame:
        return self.pruned.where("kind = 'part'").select("run_id", F.col("a").alias("coarse"), F.col("b").alias("fine"), F.col("value").alias("part"))

    @cached_property
    def kinetics(self) -> DataFrame:
        s, nodes, edges = self.settings["solve"], self.final_nodes, self.final_edges
        spec = ctmc.SolveSpec(s["t0"], s["end"], s["factor"], s["start"])
        return self.stages.stage("kinetics", lambda: ctmc.until_converged(ctmc.solve(nodes, edges, spec), ctmc.stationary(nodes)))

    @cached_property
    def final_events(self) -> DataFrame:
        """(run_id, b, strand, i, j, p): base pairs within the strands in final states, from the states that matter at some time."""
        if self.settings["enumerate"]["double"]:
            raise ValueError("events are those of states of one site")
        states, members, basins, kinetics, threshold = self.states, self.members, self.basins, self.kinetics, self.settings["show"]["event"]
        most = kinetics.groupBy("run_id", "b").agg(F.max("p").alias("p"))

        def make() -> DataFrame:
            matter = events.relevant_states(most, self.contributions, basins, members, states, threshold, self.celsius)
            own = events.pair_events(states.join(matter.select("run_id", "rank"), ["run_id", "rank"]), self.runs, threshold, self.celsius)
            return events.final_events(events.basin_events(own, members, states, self.celsius), self.contributions, basins)

        return self.stages.stage("final_events", make)

    @cached_property
    def paired(self) -> DataFrame:
        """(run_id, t, strand, i, j, p): probability of each base pair over time."""
        kinetics, found = self.kinetics, self.final_events
        return self.stages.stage("paired", lambda: events.paired_over_time(kinetics, found))

    def prominent(self, run_id: int) -> DataFrame:
        """Basins of one run that reach the shown threshold at some time."""
        own = self.kinetics.where(F.col("run_id") == run_id).select("t", F.col("b").alias("state"), "p")
        return analysis.prominent_states(own, self.settings["show"]["threshold"])
