"""Checks of states that are read: their order, their form and the region they lie in, with errors as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinforge.operators import landscape
from basinforge.operators.landscape import SECOND, SITE, SiteLimits
from basinforge.operators.lineage import with_previous

#: How much less than the state before it an energy may be, in kcal/mol.
SLACK = 1e-6


def valid_state(length_a: Column, length_b: Column, limits: SiteLimits = SiteLimits()) -> Column:
    """Whether a state's sites (null: none) lie within the strands, have the least length, and the second stands behind the first by the distance."""

    def site(names: tuple[str, ...]) -> Column:
        i1, i2, j1, j2 = (F.col(c) for c in names)
        inside = (i1 >= 1) & (i2 >= 1) & (j1 <= length_a) & (j2 <= length_b)
        return inside & (j1 - i1 + 1 >= limits.least) & (j2 - i2 + 1 >= limits.least)

    apart = (F.col("k1") - F.col("j1") > limits.distance) & (F.col("k2") - F.col("j2") > limits.distance)
    one = F.when(F.col("i1").isNull(), F.lit(True)).otherwise(F.coalesce(site(SITE), F.lit(False)))
    two = F.when(F.col("k1").isNull(), F.lit(True)).otherwise(F.coalesce(site(SECOND) & apart & F.col("i1").isNotNull(), F.lit(False)))
    return one & two


def input_errors(
    states: DataFrame, runs: DataFrame, limits: SiteLimits = SiteLimits(), regions: tuple[tuple[int, int], tuple[int, int]] | None = None, double: bool = False, special_open: bool = True
) -> DataFrame:
    """(run_id, line, error, value): what is wrong with states in the order of their lines.

    ``states`` has run_id, line, both sites and energy in kcal/mol.  "invalid" are states that the model can't have, "unsorted" those whose
    energy is less than that of the state before (``value``), "outside" those that leave the region of a strand.  States that a run passes over are not
    looked at: the open one if it is special, and those of two sites unless ``double``.  A line may have several errors; states of unknown runs are "invalid".
    """
    some = states.where("i1 IS NOT NULL") if special_open else states
    some = some if double else some.where("k1 IS NULL")
    lengths = runs.select("run_id", F.length("seq_a").alias("__a"), F.length("seq_b").alias("__b"))
    before = with_previous(some.select("run_id", "line", *SITE, *SECOND, "energy"), "run_id", "line", "energy", "__before").join(lengths, "run_id", "left")
    none = F.lit(None).cast("double")
    error = lambda wrong, name, value: F.when(wrong, F.struct(F.lit(name).alias("error"), value.alias("value")))
    found = [error(~F.coalesce(valid_state(F.col("__a"), F.col("__b"), limits), F.lit(False)), "invalid", none), error(F.col("energy") + SLACK < F.col("__before"), "unsorted", F.col("__before"))]
    if regions:
        out = landscape.outside_region(*regions) | F.coalesce(landscape.outside_region(*regions, SECOND), F.lit(False))
        found.append(error(F.coalesce(out, F.lit(False)), "outside", none))
    return before.select("run_id", "line", F.explode(F.array_compact(F.array(*found))).alias("e")).select("run_id", "line", "e.error", "e.value")
