"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A document is its lines that hold a word.  From each line a window runs over
the fewest lines with ``least_words`` words.  The least line hash of each window
is its fingerprint (winnowing, with windows measured in words): two equal runs
of lines with that many words contain two equal windows, and those select the same
line.  Only selected lines are kept as rows, each with the lines about it as far as the windows
that selected it reach.

Their positions are joined by fingerprint: each place with the first one, in order of id and line.  The match is
extended from the selected line to the left and to the right, line hash by line hash, over both places' lines; a window that
it fills is a repeat of the first place, unless it overlaps that in one document.  Where a window goes beyond the match,
others that are equal to it leave the first place at the same line with the same hash: they meet again under that, in a
further round, whose first place agrees with them for at least one line more.  So rounds are no more than a window's lines, no
pairs are made but with first places, and a fingerprint at a single place is none's repeat.
Repeats that overlap or adjoin make one run, which is deleted with the blank lines inside.

So a line is deleted just if it lies in a run of at least ``least_words`` words
that stands earlier in the table and does not overlap that earlier place.  Lines are
equal if two hashes of theirs are (96 bits).

Nulls: a null text has no lines and stays null; a null id sorts first.  Rows with
equal id and equal text are one document and get the same result.  Extra columns are
kept as they are.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinforge.llm.components import spread_join
from basinforge.llm.textcols import checkpointed, forget

#: Words as in all contracts of this subpackage.
WORD = "[^\\x20\\x09-\\x0D]+"
_KEY = ("__id", "__hash")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("__id"), F.xxhash64(text).alias("__hash"), *more)


def selected_lines(docs: DataFrame, least_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines that windows select: key of the document, fingerprint, the windows, and the lines about it.

    ``windows`` is in order; each has its first and last line, among all lines and among those
    with words (``_nth``), and the words before it and up to its end.  ``about`` has
    the hashes and places of the lines with words from the first window's start to the last one's end, ``chosen`` the selected line's place.
    """
    line = F.struct(F.xxhash64("__line").alias("h"), F.crc32(F.col("__line").cast("binary")).alias("c"), F.col("__at").alias("at"))
    lines = (
        _keyed(docs, id_col, text_col, F.posexplode(F.split(docs[text_col].cast("string"), "\n")).alias("__at", "__line"))
        .withColumn("__words", F.regexp_count("__line", F.lit(WORD)))
        .where("__words > 0")
        .select(*_KEY, "__at", line.alias("__line"), "__words")
    )
    of = Window.partitionBy(*_KEY)
    lines = lines.dropDuplicates([*_KEY, "__at"])  # repeated rows are one document
    order = of.orderBy("__at")
    lines = lines.withColumn("__before", F.sum("__words").over(order) - F.col("__words")).withColumn("__nth", F.row_number().over(order))
    # the last line of a window is the last that starts before the window has its words
    frame = of.orderBy("__before").rangeBetween(0, least_words - 1)
    windows = (
        lines.withColumn("last", F.max("__at").over(frame))
        .withColumn("last_nth", F.max("__nth").over(frame))
        .withColumn("end", F.max(F.col("__before") + F.col("__words")).over(frame))
        .withColumn("least", F.min(F.struct(F.col("__line.h").alias("h"), (-F.col("__at")).alias("at"))).over(frame))
        .withColumn("lines", F.collect_list("__line").over(frame))
        .where(F.col("end") >= F.col("__before") + least_words)
    )
    window = F.struct(F.col("__nth").alias("first_nth"), "last_nth", F.col("__at").alias("first"), "last", F.col("__before").alias("start"), "end")
    # windows of one line follow each other, and all hold it: the first one's lines and the rest of the last one's are all
    marks = windows.groupBy(*_KEY, F.col("least.at").alias("chosen")).agg(
        F.first("least.h").alias("fingerprint"), F.sort_array(F.collect_list(window)).alias("windows"), F.min_by("lines", "__nth").alias("head"), F.max_by("lines", "__nth").alias("tail")
    )
    one, other = F.element_at("windows", 1), F.element_at("windows", -1)
    rest = F.slice("tail", one["last_nth"] - other["first_nth"] + 2, other["last_nth"] - one["last_nth"])
    return marks.select(*_KEY, "fingerprint", (-F.col("chosen")).alias("chosen"), "windows", F.concat("head", rest).alias("about"))


def _agrees(own: Column, other: Column) -> Column:
    """How many of the first lines of two arrays are equal."""
    same = F.zip_with(own, other, lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["c"] == b["c"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def _sides(about: Column, chosen: Column) -> tuple[Column, Column]:
    """The lines left of the chosen one, nearest first, and those right of it."""
    return F.reverse(F.filter(about, lambda x: x["at"] < chosen)), F.filter(about, lambda x: x["at"] > chosen)


def _extended(places: DataFrame) -> DataFrame:
    """Each window of each place with the match between its place and the first one that shares its ``join`` key.

    (key, w, own place, left and right lines, l and r: the window's lines on both sides, agree_l and agree_r: the lines that
    agree, first: the first place, with its lines).  Keys at a single place are left out.
    """
    common = places.groupBy("join").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("join")
    met = spread_join(places, common, "join")
    place = F.struct(*_KEY, "chosen")
    firsts = met.groupBy("join").agg(F.min_by(F.struct(*_KEY, "chosen", "about"), place).alias("first"))
    both = spread_join(met, firsts, "join")
    own, other = _sides(F.col("about"), F.col("chosen")), _sides(F.col("first.about"), F.col("first.chosen"))
    both = both.select(*_KEY, "join", "chosen", "first", "windows", own[0].alias("left"), own[1].alias("right"), other[0].alias("first_left"), other[1].alias("first_right"))
    both = both.withColumn("agree_l", _agrees(F.col("left"), F.col("first_left"))).withColumn("agree_r", _agrees(F.col("right"), F.col("first_right")))
    each = both.withColumn("w", F.explode("windows")).drop("windows")
    inside = lambda side, ok: F.size(F.filter(F.col(side), ok))
    return each.withColumn("l", inside("left", lambda x: x["at"] >= F.col("w.first"))).withColumn("r", inside("right", lambda x: x["at"] <= F.col("w.last")))


def _repeats(found: DataFrame) -> DataFrame:
    """The windows that the match with a first place fills, but for that place's own and those that overlap it."""
    filled = found.where("l <= agree_l AND r <= agree_r")
    last = F.when(F.col("r") > 0, F.element_at(F.col("first_right.at"), F.greatest(F.col("r"), F.lit(1)))).otherwise(F.col("first.chosen"))
    same_doc = F.col("first.__id").eqNullSafe(F.col("__id")) & (F.col("first.__hash") == F.col("__hash"))
    return filled.where(~same_doc | (F.col("w.first") > last)).select(*_KEY, "w.*")


def _beyond(found: DataFrame) -> DataFrame:
    """The windows that go beyond the match, as places that meet again where and how they leave it."""
    to_left = F.col("l") > F.col("agree_l")
    line = F.when(to_left, F.element_at("left", F.col("agree_l") + 1)).otherwise(F.element_at("right", F.col("agree_r") + 1))
    key = F.xxhash64("join", to_left, F.when(to_left, F.col("agree_l")).otherwise(F.col("agree_r")), line["h"], line["c"])
    chosen = F.filter(F.col("first.about"), lambda x: x["at"] == F.col("first.chosen"))
    own = F.transform(chosen, lambda x: F.struct(x["h"].alias("h"), x["c"].alias("c"), F.col("chosen").alias("at")))
    about = F.concat(F.reverse(F.slice("left", F.lit(1), F.col("l"))), own, F.slice("right", F.lit(1), F.col("r")))
    open_ = found.where("l > agree_l OR r > agree_r")
    return open_.select(*_KEY, key.alias("join"), "chosen", F.array("w").alias("windows"), about.alias("about"))


def repeated_runs(docs: DataFrame, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key of the document, first, last, lines, words) of each run to delete; lines count from 0."""
    places = checkpointed(selected_lines(docs, least_words, id_col, text_col).withColumnRenamed("fingerprint", "join"))
    repeats: list[DataFrame] = []
    while True:
        found = checkpointed(_extended(places))
        forget(places)
        repeats.append(checkpointed(_repeats(found)))
        places = checkpointed(_beyond(found))
        forget(found)
        if not places.limit(1).count():
            forget(places)
            break
    later = reduce(DataFrame.unionByName, repeats)
    of = Window.partitionBy(*_KEY).orderBy("first")
    reach = F.max("last_nth").over(of.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("__new", F.when(F.col("first_nth") <= reach + 1, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    found = checkpointed(
        runs.groupBy(*_KEY, "__run").agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            (F.max("last_nth") - F.min("first_nth") + 1).cast("long").alias("lines"),
            (F.max("end") - F.min("start")).cast("long").alias("words"),
        )
    )
    forget(*repeats)
    return found


def drop_repeated_lines(docs: DataFrame, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without repeated runs, and n_deleted_lines and n_deleted_words behind.

    Columns that already have those two names are replaced.
    """
    run = F.struct("first", "last", "lines", "words")
    cuts = repeated_runs(docs, least_words, id_col, text_col).groupBy(*_KEY).agg(F.array_sort(F.collect_list(run)).alias("__runs"))
    cuts = cuts.select(F.col("__id").alias("__cut_id"), F.col("__hash").alias("__cut_hash"), "__runs")
    others = [c for c in docs.columns if c not in ("n_deleted_lines", "n_deleted_words")]
    text = docs[text_col].cast("string")
    cuts = cuts.withColumn("__cut_text_id", F.coalesce(F.col("__cut_id").cast("string"), F.lit("")))
    # the row travels as one struct, so that no name of its columns can clash
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in others]).alias("__row"), text.alias("__body"), F.xxhash64(text).alias("__hash"), docs[id_col].alias("__doc"))
    whole = whole.withColumn("__text_id", F.coalesce(F.col("__doc").cast("string"), F.lit("")))
    # dealt alike at every size: where the cuts are few they would be sent to all instead
    both = whole.join(cuts.hint("merge"), (F.col("__text_id") == F.col("__cut_text_id")) & (F.col("__hash") == F.col("__cut_hash")) & F.col("__doc").eqNullSafe(F.col("__cut_id")), "left")
    lines, runs = F.split("__body", "\n"), F.col("__runs")
    # kept stretches: from behind a run (or the start) to before the next (or the end)
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    stops = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda s: F.slice(F.col("__lines"), s["a"] + 1, s["b"] - s["a"])))
    total = lambda name: F.aggregate(F.coalesce(runs, F.array().cast("array<struct<first:int,last:int,lines:bigint,words:bigint>>")), F.lit(0).cast("long"), lambda x, r: x + r[name])
    both = both.withColumn("__lines", F.when(runs.isNotNull(), lines))
    new_text = F.when(runs.isNull(), F.col("__body")).otherwise(F.array_join(kept, "\n"))
    columns = [(new_text if c == text_col else F.col("__row").getField(c)).alias(c) for c in others]
    return both.select(*columns, total("lines").alias("n_deleted_lines"), total("words").alias("n_deleted_words"))
