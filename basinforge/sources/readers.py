"""Readers of the text and binary files that kinetics programs exchange; all give DataFrames.

Gzipped text is read as such by its name.  Lines that do not have a reader's form
are left out of its table, except where a strict reader is asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinforge.functions.loops import LoopTable
from basinforge.functions.sequence import is_sequence, normalize

STOP = 2**64 - 1


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, sequence) of every record: the name is the first word behind ">", lines are joined."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    record = text.select("path", F.explode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("r")).where(F.trim("r") != "")
    first = F.substring_index("r", "\n", 1)
    rest = F.substring(F.col("r"), F.length(first) + 1, F.length("r"))
    return record.select("path", F.regexp_extract(first, r"^\s*(\S*)", 1).alias("name"), F.regexp_replace(rest, r"\s", "").alias("sequence"))


def checked_sequences(records: DataFrame) -> DataFrame:
    """The records with ``valid`` and the normalised ``sequence``."""
    return records.withColumn("valid", is_sequence(F.col("sequence"))).withColumn("sequence", normalize(F.col("sequence")))


def state_lines(lines: DataFrame) -> DataFrame:
    """(energy, sites, valid) of lines ``value``: an energy and none, four or eight positions."""
    words = F.split(F.trim("value"), r"\s+")
    n = F.size(words)
    site = lambda k: F.struct(*[F.try_element_at(words, F.lit(k + i)).try_cast("int").alias(c) for i, c in enumerate(("i1", "i2", "j1", "j2"))])
    sites = F.when(n == 1, F.array().cast("array<struct<i1:int,i2:int,j1:int,j2:int>>")).when(n == 5, F.array(site(2))).when(n == 9, F.array(site(2), site(6)))
    return lines.select(F.try_element_at(words, F.lit(1)).try_cast("double").alias("energy"), sites.alias("sites")).withColumn("valid", F.col("energy").isNotNull() & F.col("sites").isNotNull())


def states(spark: SparkSession, path: str) -> DataFrame:
    return state_lines(spark.read.text(path).where(F.trim("value") != ""))


def loop_table(spark: SparkSession, path: str) -> LoopTable:
    """Loop parameters of a tab-separated file of kind, key and value (hundredths of kcal/mol); a few thousand rows at most, which the driver takes."""
    return LoopTable.from_rows(map(tuple, spark.read.csv(path, sep="\t", schema="kind string, key string, value int").collect()))


def basin_graph(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, w) of binary basin graphs; rows with i = j hold the basin's weight.

    The form is a basin's index and weight, its neighbours' indices and weights, a
    stop, and so on to a second stop, all of 64 bits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                at = 0
                while at + 8 <= len(data) and (i := struct.unpack_from("<Q", data, at)[0]) != STOP:
                    rows.append((name, i, i, struct.unpack_from("<d", data, at + 8)[0]))
                    at += 16
                    while (j := struct.unpack_from("<Q", data, at)[0]) != STOP:
                        if i != j:
                            rows.append((name, i, j, struct.unpack_from("<d", data, at + 8)[0]))
                        at += 16
                    at += 8
            yield pd.DataFrame(rows, columns=["path", "i", "j", "w"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i long, j long, w double")


def weight_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, v): the entries but zero of binary square matrices: the size, then rows of doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                n = struct.unpack_from("<Q", data)[0]
                m = np.frombuffer(data, "<f8", n * n, 8).reshape(n, n)
                i, j = np.nonzero(m)
                yield pd.DataFrame({"path": name, "i": i, "j": j, "v": m[i, j]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i long, j long, v double")


def pair_probabilities(lines: DataFrame) -> DataFrame:
    """(state, z, k1, k2, p) of lines: index, weight, then "k1 k2 p" in tab-separated fields."""
    fields = F.split("value", "\t")
    head = lines.select(F.get(fields, F.lit(0)).try_cast("long").alias("state"), F.get(fields, F.lit(1)).try_cast("double").alias("z"), F.explode(F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0)))).alias("t")).where("trim(t) <> ''")
    part = F.split(F.trim("t"), " +")
    return head.select("state", "z", F.get(part, F.lit(0)).try_cast("int").alias("k1"), F.get(part, F.lit(1)).try_cast("int").alias("k2"), F.get(part, F.lit(2)).try_cast("double").alias("p"))


def prune_track(lines: DataFrame, number: str = "final") -> DataFrame:
    """(final, basin, part) of numbered lines: tab-separated "basin:part"."""
    rows = lines.select(number, F.explode(F.split("value", "\t")).alias("t")).select(number, F.split("t", ":").alias("e")).where(F.size("e") == 2)
    return rows.select(number, F.trim(F.get("e", F.lit(0))).try_cast("long").alias("basin"), F.get("e", F.lit(1)).try_cast("double").alias("part"))


def basin_track(lines: DataFrame) -> DataFrame:
    """(basin, n_states, energy, i1, i2, j1, j2): the members of basins of single-site states; the open state has null positions."""
    fields = F.split("value", "\t")
    member = F.explode(F.regexp_extract_all(F.get(fields, F.lit(5)), F.lit(r"\{[^}]*\}"), F.lit(0)))
    rows = lines.select(F.get(fields, F.lit(0)).try_cast("long").alias("basin"), F.get(fields, F.lit(1)).try_cast("double").alias("n_states"), F.get(fields, F.lit(2)).try_cast("double").alias("energy"), member.alias("m"))
    at = F.regexp_extract_all("m", F.lit("[0-9]+"), F.lit(0))
    return rows.select("basin", "n_states", "energy", *[F.get(at, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(("i1", "i2", "j1", "j2"))])


def kinetics(lines: DataFrame) -> DataFrame:
    """(t, state, p) of lines: a time and one probability for each state, by white space; states count from 0."""
    words = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.get(words, F.lit(0)).try_cast("double").alias("t"), F.posexplode(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).alias("state", "p"))
    return rows.select("t", F.col("state").cast("long").alias("state"), F.col("p").try_cast("double").alias("p")).where("t is not null")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """(run, t, species, n) of tables with a header "Time name ..." and whole numbers, a run for each file."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run"), F.split("value", "\r?\n").alias("l"))
    names = F.split(F.trim(F.get("l", F.lit(0))), r"\s+")
    rows = lines.select("run", names.alias("names"), F.explode(F.slice("l", 2, F.size("l"))).alias("row")).where("trim(row) <> ''")
    values = F.split(F.trim("row"), r"\s+")
    long = rows.select("run", "names", F.get(values, F.lit(0)).try_cast("double").alias("t"), F.posexplode(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))).alias("k", "n"))
    return long.select("run", "t", F.get("names", F.col("k") + 1).alias("species"), F.col("n").try_cast("long").alias("n"))
