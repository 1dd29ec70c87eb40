"""Readers, exports, configuration, stages and the stream."""

import struct

import pytest

from pyspark.sql import functions as F

from basinforge.operators import analysis
from basinforge.plans import bindings, stages
from basinforge.sources import config, exports, readers
from basinforge.streaming import shares
from oracle import TINY


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGU\nacgu\n>two\r\nAC GX\n")
    got = {(r.name, r.sequence, r.valid) for r in readers.checked_sequences(readers.fasta(spark, str(tmp_path))).collect()}
    assert got == {("one", "ACGUACGU", True), ("two", "ACGX", False)}


def test_states(spark):
    rows = readers.state_lines(lines(spark, "-4.100000", "1.5\t1\t2\t3\t4", "2 1 2 3 4 9 9 12 12", "x 1 2", "3 1 2")).collect()
    assert [len(r.sites) if r.valid else None for r in rows] == [0, 1, 2, None, None]


def test_binary_graph_and_matrix(spark, tmp_path):
    pack = lambda *x: b"".join(struct.pack("<Q" if isinstance(v, int) else "<d", v) for v in x)
    stop = readers.STOP
    (tmp_path / "g").write_bytes(pack(0, 1.5, 0, 9.0, 2, 0.25, stop, 2, 3.0, 0, 0.25, stop, stop))
    got = sorted((r.i, r.j, r.w) for r in readers.basin_graph(spark, str(tmp_path / "g")).collect())
    assert got == [(0, 0, 1.5), (0, 2, 0.25), (2, 0, 0.25), (2, 2, 3.0)]
    (tmp_path / "m").write_bytes(pack(2, 1.0, 0.0, 0.5, 2.0))
    assert sorted((r.i, r.j, r.v) for r in readers.weight_matrix(spark, str(tmp_path / "m")).collect()) == [(0, 0, 1.0), (1, 0, 0.5), (1, 1, 2.0)]


def test_text_tables(spark, tmp_path):
    pairs = readers.pair_probabilities(lines(spark, "0\t2.5\t1 2 0.5\t3 4 0.25", "1\t1.0")).collect()
    assert [(r.state, r.k1, r.k2, r.p) for r in pairs] == [(0, 1, 2, 0.5), (0, 3, 4, 0.25)]
    track = readers.prune_track(lines(spark, "3:0.5\t4:1").withColumn("final", F.lit(0))).collect()
    assert [(r.basin, r.part) for r in track] == [(3, 0.5), (4, 1.0)]
    members = readers.basin_track(lines(spark, "5\t2\t-1.5\t{}\t-4\t{(1,2)-(3,4)} {}")).collect()
    assert [(r.basin, r.i1, r.j2) for r in members] == [(5, 1, 4), (5, None, None)]
    kin = readers.kinetics(lines(spark, "1e-1 0.25 0.75", "bad")).collect()
    assert [(r.t, r.state, r.p) for r in kin] == [(0.1, 0, 0.25), (0.1, 1, 0.75)]
    (tmp_path / "t.txt").write_text("Time A B\n0 1 2\n1.5 0 3\n")
    got = sorted((r.t, r.species, r.n) for r in readers.trajectories(spark, str(tmp_path / "t.txt")).collect())
    assert got == [(0.0, "A", 1), (0.0, "B", 2), (1.5, "A", 0), (1.5, "B", 3)]


def test_track_round_trip(spark):
    parts = spark.createDataFrame([(0, 3, 0.5), (0, 10, 0.25), (0, 11, 1e-4)], "final long, basin long, part double")
    line = exports.prune_track(parts).withColumnRenamed("track", "value")
    assert [(r.basin, r.part) for r in readers.prune_track(line).collect()] == [(3, 0.5), (10, 0.25)]


def test_config():
    merged = config.load('{"solve": {"t0": 1}, "show": {"list": [1]}}')
    assert merged["solve"]["t0"] == 1 and merged["solve"]["end"] == 1e15 and merged["show"] == {"threshold": 0.02, "event": 0.01, "list": [1]}
    assert [config.parse_region(t, 1, 10) for t in ("2-5", "4", "-3", "0")] == [(2, 5), (1, 4), (8, 10), (1, 10)]


def test_average_trajectories(spark):
    rows = [("a", 0.0, "x", 2), ("a", 1.0, "x", 5), ("b", 0.5, "x", 4), ("b", 1.0, "x", 0)]
    got = analysis.average_trajectories(spark.createDataFrame(rows, "run string, t double, species string, n long"), 2).orderBy("t").collect()
    assert [(r.t, r["mean"]) for r in got] == [(0.0, 1.0), (0.5, 3.0), (1.0, 2.5)]


def test_stages(spark, tmp_path):
    runs = bindings.runs(spark, TINY).where("run_id < 3")
    first = stages.Stages(spark, str(tmp_path))
    run = stages.KineticsRun(runs, first)
    n = run.kinetics.count()
    assert n and run.prominent(0).count() >= 1
    again = stages.Stages(spark, str(tmp_path), reuse=True)
    assert stages.KineticsRun(runs, again).kinetics.count() == n and again.ran == []
    dry = stages.Stages(spark, str(tmp_path / "new"), dry=True)
    dry.stage("states", lambda: None)
    assert dry.ran == ["states"]
    total = run.kinetics.groupBy("run_id", "t").agg(F.sum("p").alias("p")).agg(F.min("p"), F.max("p")).first()
    assert abs(total[0] - 1) < 1e-9 and abs(total[1] - 1) < 1e-9
    few = config.load('{"celsius": 10, "enumerate": {"model": true, "span": 12}, "prune": {"number_outflow": 5, "number_share": 5}}')
    small = stages.KineticsRun(runs, stages.Stages(spark, str(tmp_path / "few")), few)
    sizes = {r.run_id: r.n for r in small.final_nodes.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert set(sizes) == {r.run_id for r in runs.collect()} and max(sizes.values()) <= 6  # the first basin stays beside the five
    assert small.basins.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > 6


def test_whole_run_with_events_and_with_two_sites(spark, tmp_path):
    runs = bindings.runs(spark, TINY).where("run_id IN (1, 2)")
    kept = config.load('{"prune": {"number_outflow": 6, "number_share": 6, "prefactor": 2.0}, "solve": {"end": 1e4}}')
    run = stages.KineticsRun(runs, stages.Stages(spark, str(tmp_path / "one")), kept)
    paired = run.paired.collect()
    assert paired and {r.strand for r in paired} <= {"a", "b"} and all(0 <= r.p <= 1 + 1e-9 for r in paired)
    parts = run.contributions.groupBy("run_id", "fine").agg(F.sum("part").alias("p")).collect()
    assert all(r.p <= 1 + 1e-9 for r in parts)
    first = run.kinetics.groupBy("run_id").agg(F.min_by(F.struct("b", "p"), "t").alias("x")).collect()
    assert first and {r.b for r in run.final_nodes.collect()} >= {0, 1}  # the open state is basin 1
    long = bindings.long_runs(spark, TINY).where("run_id = 3")
    two = config.load('{"enumerate": {"double": true, "distance": 3, "most": 5}, "prune": {"number_outflow": 6, "number_share": 6}, "solve": {"end": 1e4}}')
    both = stages.KineticsRun(long, stages.Stages(spark, str(tmp_path / "two")), two)
    assert both.states.where("code2 <> 0").count() and both.kinetics.count()
    with pytest.raises(ValueError):
        both.final_events


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{TINY}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = shares.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = shares.shares(spark.table("counts"))
    assert abs(got.agg(F.sum("p")).first()[0] - spark.table("counts").select("t").distinct().count()) < 1e-9


def test_numbers_as_c_writes_them(spark):
    values = [0.0, -0.0, 1.0, 0.5, 1234.5678, 123456.0, 1e-5, 0.0001234567, 9.9999e-5, 99999.5, -2.5e10, 1 / 3, 1e300, 999.95]
    values += [5 / 32, 7 / 32, 2.675, 1.0005, 1.00005, 0.00125, 3.0625, 12.345, 0.1034482758620689, 9.9995, 99.995, 123455.0, 1234550.0, 12345500.0, -0.15625, 0.5 + 2**-14, 1 / 1024, 1 / 4096, 2.5, 0.25, 0.125, 0.0625]
    values += [n / 64 for n in range(1, 200)] + [n / 1000 + 0.0005 for n in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4, 6):
        assert [r[0] for r in df.select(exports.general(F.col("v"), digits)).collect()] == [f"{v:.{digits}g}" for v in values]
