"""The engine's tables made of the driver's tables: runs, basin graphs, probabilities over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinforge.functions.sequence import PAIRS

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ACGU" * 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_sequence(text: Column) -> Column:
    """Letters and digits of a text as bases."""
    return F.translate(F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""), LETTERS, BASES)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, seq_a, seq_b): a run for each supplier, its name against its nation's."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    both = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations at any scale
    return both.select(F.col("s_suppkey").alias("run_id"), as_sequence(F.col("s_name")).alias("seq_a"), as_sequence(F.col("n_name")).alias("seq_b"))


def long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, seq_a, seq_b): a run for each supplier, its name against its nation's and region's."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions, 25 nations at any scale
    place = nation.select("n_nationkey", F.concat("n_name", "r_name").alias("place"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    both = supplier.join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.select(F.col("s_suppkey").alias("run_id"), as_sequence(F.col("s_name")).alias("seq_a"), as_sequence(F.col("place")).alias("seq_b"))


def loop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, key, value) loop parameters made of ``part``: mean prices by size for loops, numbers of parts for letters."""
    part, k = table(spark, sf_dir, "part"), F.col("k")
    kept = part.select((F.col("p_size") % 6 + 1).alias("n"), F.col("p_retailprice").alias("v"), F.pmod("p_partkey", F.lit(96)).cast("int").alias("k"))
    mean = kept.groupBy("n").agg(F.floor(F.avg("v")).cast("int").alias("v"))
    letters = F.array(*map(F.lit, "ACGU"))
    pair = F.element_at(F.array(*map(F.lit, PAIRS)), (k % 6 + 1).cast("int"))
    letter = lambda by: F.element_at(letters, (F.floor(k / by) % 4 + 1).cast("int"))
    counts = kept.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("c"))
    row = lambda kind, key, value: [F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("int").alias("value")]
    out = mean.select(*row("bulge", F.col("n"), F.col("v") % 200 + 200)).unionByName(mean.select(*row("interior", F.col("n"), F.col("v") % 150 + 90)))
    out = out.unionByName(counts.select(*row("mismatch", F.concat(pair, letter(6), letter(24)), -(F.col("c") * 7 + k) % 90)))
    out = out.unionByName(counts.where("k < 6").select(*row("terminal", pair, F.col("c") % 60)))
    return out.unionByName(spark.range(1).select(*row("stacked_bulge", F.lit(""), F.lit(1))))


def trade_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (run_id, b, z) and edges (run_id, a, b, w), a run for each year: nations, and the order lines between customers' and suppliers' nations."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("run_id"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("from"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("to"))
    # counts by order and supplier's nation first, so that the wide join carries few rows
    by_order = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "to").agg(F.count(F.lit(1)).alias("n"))
    origin = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "run_id", "from")
    flow = by_order.join(origin, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("run_id", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.sum("n").cast("double").alias("w"))
    ends = flow.select("run_id", F.explode(F.array("a", "b")).alias("b"), "w")
    return ends.groupBy("run_id", "b").agg(F.sum("w").alias("z")), flow.where("a <> b")


def trade_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (b, z) and edges (a, b, w) of all years together."""
    nodes, edges = trade_runs(spark, sf_dir)
    return nodes.groupBy("b").agg(F.sum("z").alias("z")), edges.groupBy("a", "b").agg(F.sum("w").alias("w"))


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v): how often a user's event of one type is followed by one of another."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("i"), F.lead("event_type").over(order).alias("j"))
    return steps.where("j is not null").groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


def kinetics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, state, p): shares of event types by day."""
    counts = table(spark, sf_dir, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"), F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("t", "state", (F.col("n") / F.sum("n").over(Window.partitionBy("t"))).alias("p"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, i, j, p): conditional probability of a pair (from user and properties) given the event type."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("state"), F.pmod("user_id", F.lit(7)).alias("i"), (F.get_json_object("props", "$.k").cast("long") % 5 + 10).alias("j"))
    counts = rows.groupBy("state", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("state", "i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy("state"))).alias("p"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coarse, fine, part): a nation counts three quarters for its region and one for the next."""
    nation = table(spark, sf_dir, "nation")
    region = F.col("n_regionkey").cast("long")
    parts = F.array(F.struct(region.alias("coarse"), F.lit(0.75).alias("part")), F.struct(((region + 1) % 5).alias("coarse"), F.lit(0.25).alias("part")))
    return nation.select(F.col("n_nationkey").cast("long").alias("fine"), F.explode(parts).alias("c")).select("c.coarse", "fine", "c.part")


def nation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, z): customers of each nation."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("state")).agg(F.count(F.lit(1)).cast("double").alias("z"))


def region_kinetics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, state, p): shares of regions in the orders of each year."""
    region = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("state"))
    customer = table(spark, sf_dir, "customer").join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "state")
    counts = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").cast("long").alias("t"), "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("t", "state", (F.col("n") / F.sum("n").over(Window.partitionBy("t"))).alias("p"))


def nation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, i, j, p): given a supplier's nation, the shares of line status and flag."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("state"))
    code = lambda c: F.ascii(c).cast("long")
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", code("l_returnflag").alias("i"), code("l_linestatus").alias("j"))
    # counts by supplier first: a map-side sum before the join
    counts = line.groupBy("l_suppkey", "i", "j").agg(F.count(F.lit(1)).alias("n")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("state", "i", "j").agg(F.sum("n").alias("n"))
    return counts.select("state", "i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy("state"))).alias("p"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, t, species, n): each user's events of each type up to each day."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"), F.col("event_type").alias("species")).agg(F.count(F.lit(1)).alias("d"))
    return daily.select("run", "t", "species", F.sum("d").over(Window.partitionBy("run", "species").orderBy("t")).alias("n"))
