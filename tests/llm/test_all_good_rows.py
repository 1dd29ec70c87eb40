"""The compression bands come from every good row outside the held-out fold, however the rows are dealt."""

import random
import zlib

from basinforge.llm import compression_rules
from texts import prose


def test_every_good_row_counts(spark):
    rng = random.Random(3)
    few = [prose(rng, 40) for _ in range(40)]
    rows = [(k, few[k % 40] + " " + prose(rng, 3)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 != 0)) for k, _ in rows], "doc_id long, quality int")
    learned = [compression_rules.fit(docs.repartition(n), labels) for n in (2, 5)]
    assert learned[0] == learned[1]
    assert learned[0].learned_from == sum(k % 7 != 0 and zlib.crc32(str(k).encode()) % 5 != 0 for k, _ in rows) > 4000
