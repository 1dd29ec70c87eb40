"""Exports: tables and text lines in the forms that other programs read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinforge.functions.energy import free_energy
from basinforge.operators.graph import both_directions, equilibrium, outflow
from basinforge.operators.lineage import numbered


def _off_ties(value: Column, digits: int) -> Column:
    """The value, moved a little to the side that C rounds it to where it is about half way between two numbers of that many digits.

    C rounds what the bits stand for, half to even; Java the shortest decimal, half up.  The product with a power of ten and its rounding
    error, from products of half numbers, tell exactly on which side of the middle a value is.
    """
    k = (digits - 1 - F.floor(F.log10(F.abs(value)))).cast("int")
    tens = F.array(*[F.lit(10.0**n) for n in range(23)])
    ten = F.try_element_at(tens, F.abs(k) + 1)

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    size = F.abs(value)
    product = size * ten
    (a, b), (c, d) = halves(size), halves(ten)
    error = ((a * c - product) + a * d + b * c) + b * d
    low = F.when(k >= 0, F.floor(product)).otherwise(F.floor(size / ten))
    beyond = F.when(k >= 0, (product - (low + 0.5)) + error).otherwise(size - (low + 0.5) * ten)
    near = F.abs(F.when(k >= 0, product).otherwise(size / ten) - (low + 0.5)) < 1e-7
    up = (beyond > 0) | ((beyond == 0) & (low % 2 == 1))
    return F.when(near & ten.isNotNull(), F.when(up, value * (1 + 1e-12)).otherwise(value * (1 - 1e-12))).otherwise(value)


def general(value: Column, digits: int) -> Column:
    """A number as C's %g writes it with that many digits."""
    value = _off_ties(value, digits)
    text = F.format_string(f"%.{digits - 1}e", value)
    exponent = F.substring_index(text, "e", -1).cast("int")
    bare = lambda s: F.when(s.contains("."), F.regexp_replace(s, "\\.?0+$", "")).otherwise(s)
    fixed = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(digits - 1 - exponent, F.lit(0)).cast("string"), F.lit("f")), value)
    scientific = F.concat(bare(F.substring_index(text, "e", 1)), F.lit("e"), F.substring_index(text, "e", -1))
    return F.when(value == 0, F.when(text.startswith("-"), "-0").otherwise("0")).when((exponent >= -4) & (exponent < digits), bare(fixed)).otherwise(scientific)


def quantised(probabilities: DataFrame, least: float) -> DataFrame:
    """Probabilities over ``least``, as multiples of it."""
    return probabilities.where(F.col("p") > least).withColumn("p", F.round(F.col("p") / least) * least)


def graph_stats(rates: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: basins, directed transitions, mean outflow, greatest rate."""
    n = F.lit(2 * edges.count())
    return rates.agg(F.count(F.lit(1)).alias("basins"), n.alias("transitions"), F.avg("out_rate").alias("mean_outflow"), F.max("max_rate").alias("max_rate"))


def weight_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, v): basin weights on the diagonal, transition weights beside it."""
    diagonal = nodes.select(F.col("b").alias("i"), F.col("b").alias("j"), F.col("z").alias("v"))
    return both_directions(edges).select(F.col("s").alias("i"), F.col("t").alias("j"), F.col("w").alias("v")).unionByName(diagonal)


def reactions(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(line): a reaction and its rate for each directed edge."""
    ends = both_directions(edges).join(nodes.select(F.col("b").alias("s"), "z"), "s")
    return ends.select(F.format_string(f"{name}%d -> {name}%d, %.8e", F.col("s") + 1, F.col("t") + 1, F.col("w") / F.col("z")).alias("line"))


def species(nodes: DataFrame, name: str, start: int) -> DataFrame:
    """(line): each basin and its amount at the start."""
    return nodes.select(F.format_string(f"{name}%d %d", F.col("b") + 1, (F.col("b") == start).cast("int")).alias("line"))


def pseudo_bar(nodes: DataFrame) -> DataFrame:
    """(rank, structure, energy): basins as local minima, energies with RT of one."""
    return nodes.select((F.col("b") + 1).alias("rank"), F.lit("-").alias("structure"), (-F.log("z")).alias("energy"))


def prune_track(parts: DataFrame, least: float = 1e-3) -> DataFrame:
    """(final, track): tab-separated basin:share of what each final state is made of, three digits."""
    text = F.struct("basin", F.concat(F.col("basin").cast("string"), F.lit(":"), general(F.col("part"), 3)).alias("x"))
    rows = parts.where(F.col("part") >= least).groupBy("final").agg(F.array_sort(F.collect_list(text)).alias("xs"))
    return rows.select("final", F.array_join(F.transform("xs", lambda s: s["x"]), "\t").alias("track"))


def stats_ladder(rates: DataFrame, shares: DataFrame) -> DataFrame:
    """(n, max_outflow, min_p): for n, n/2, n/4, ... basins the outflow that n basins do not exceed and the share that n have."""
    one = F.lit(0).alias("__one")
    by_rate = numbered(rates.select(one, "out_rate"), "__one", [F.col("out_rate")], "k").select((F.col("k") + 1).alias("n"), F.col("out_rate").alias("max_outflow"))
    total = rates.count()
    by_share = numbered(shares.select(one, "p"), "__one", [F.col("p")], "k").select((total - F.col("k")).alias("n"), F.col("p").alias("min_p"))
    wanted = [total >> k for k in range(total.bit_length()) if total >> k > 1]
    return by_rate.where(F.col("n").isin(wanted)).join(by_share, "n") if wanted else by_rate.limit(0).join(by_share, "n")


def kinetics_lines(kinetics: DataFrame) -> DataFrame:
    """(t, line): a time and the probabilities of all basins in order, separated by spaces."""
    p = F.array_sort(F.collect_list(F.struct("b", general(F.col("p"), 6).alias("x"))))
    return kinetics.groupBy("t").agg(p.alias("ps")).select("t", F.concat_ws(" ", F.format_string("%.6e", "t"), F.array_join(F.transform("ps", lambda s: s["x"]), " ")).alias("line"))


def rate_lines(rates: DataFrame) -> DataFrame:
    """(i, line): a row of the rate matrix of basins numbered from 0, each rate in ten places with four digits; absent ones are zero.

    With ``run_id``, of each run, whose rows are as wide as its own basins.
    """
    of = ["run_id"] if "run_id" in rates.columns else []
    width = rates.groupBy(*of).agg(F.max("j").cast("long").alias("last"))
    row = rates.groupBy(*of, "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "rate"))).alias("row"))
    row = row.join(width, of) if of else row.withColumn("last", F.lit(width.first()[0] or 0).cast("long"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda j: F.lpad(general(F.coalesce(F.try_element_at("row", j), F.lit(0.0)), 4), 10, " "))
    return row.select(*of, "i", F.array_join(cells, " ").alias("line"))


def basin_track_lines(states: DataFrame, members: DataFrame, summary: DataFrame, celsius: float = 37.0) -> DataFrame:
    """(run_id, basin, line): number, states, free energy (rounded to nine decimals before it is written), lowest state, its energy, and all states in order of rank, tab-separated.

    ``states`` has run_id, rank, the site (null: open) and energy; ``summary`` is that of the basins.
    """
    text = F.when(F.col("i1").isNull(), "{}").otherwise(F.format_string("{(%d,%d)-(%d,%d)}", "i1", "i2", "j1", "j2"))
    each = members.select("run_id", "basin", "rank").join(states.select("run_id", "rank", text.alias("x"), (F.col("energy") / 100.0).alias("e")), ["run_id", "rank"])
    listed = each.groupBy("run_id", "basin").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("xs"), F.min(F.struct("e", "rank", "x")).alias("low"))
    both = listed.join(summary.select("run_id", "basin", "n_states", "z"), ["run_id", "basin"])
    columns = [F.col("basin").cast("string"), F.col("n_states").cast("string"), general(F.round(free_energy(F.col("z"), celsius), 9) + 0.0, 6), F.col("low.x"), general(F.col("low.e"), 6), F.array_join(F.transform("xs", lambda s: s["x"]), " ")]
    return both.select("run_id", "basin", F.concat_ws("\t", *columns).alias("line"))


def basin_track(members: DataFrame) -> DataFrame:
    """(run_id, basin, track): the ranks of a basin's states, tab-separated, in order."""
    return members.groupBy("run_id", "basin").agg(F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda r: r.cast("string")), "\t").alias("track"))


def basin_report(nodes: DataFrame, edges: DataFrame, summary: DataFrame, celsius: float = 37.0) -> DataFrame:
    """(b, n_states, free_energy, p, out_rate, neighbours): a line's columns for each basin; neighbours ascend, joined by spaces.

    ``summary`` has b and n_states.
    """
    near = both_directions(edges).groupBy(F.col("s").alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t.cast("string")), " ").alias("neighbours"))
    flow, shares = outflow(nodes, edges).select("b", "out_rate"), equilibrium(nodes).select("b", "z", "p")
    return shares.join(flow, "b").join(summary, "b").join(near, "b", "left").select("b", "n_states", free_energy(F.col("z"), celsius).alias("free_energy"), "p", "out_rate", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def states_csv(states: DataFrame) -> DataFrame:
    """(line): energy with six decimals and positions, tab-separated."""
    return states.select(F.concat_ws("\t", F.format_string("%.6f", F.col("energy") / 100.0), *[F.col(c).cast("string") for c in ("i1", "i2", "j1", "j2")]).alias("line"))
