"""The compression classifier and the compression bands."""

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from basinforge.llm import compression_rules, zdict_quality
from texts import prose

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = zdict_quality.score(docs, zdict_quality.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    share = {r.quality: r.kept for r in scored.groupBy("quality").agg(F.avg("predicted").alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.35


def test_scores_against_a_plain_computation(spark):
    """Each text compressed piece by piece with both dictionaries, and the logistic function written out."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = zdict_quality.fit(docs, labels)
    some = docs.where("doc_id % 5 = 0").select("doc_id", "text")
    scores = {r.doc_id: (r.score, r.predicted, r.held_out) for r in zdict_quality.score(some, model).collect()}
    kept = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
    sides = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), **kept) for d in (model.good, model.bad)]
    for r in some.collect():
        text = (r.text or "").encode()
        good, bad = (sum(len(z.compress(text[k : k + 1024])) for k in range(0, max(len(text), 1), 1024)) for z in sides)
        d, ratio, n = (bad - good) / max(good, bad), min(good, bad) / max(len(text), 1), math.log1p(len(text))
        z = sum(w * x for w, x in zip(model.weights, (1, d, min(ratio, 2.0), max(0.15 - ratio, 0) * 10, n, d * n)))
        score, predicted, held = scores[r.doc_id]
        assert abs(score - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 0.02  # prepared dictionaries differ by a byte or two
        assert predicted == int(score >= 0.3) and held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_calibration_of_separable_labels():
    rng = np.random.default_rng(1)
    good = np.c_[rng.normal(0.2, 0.02, 400), rng.normal(0.5, 0.02, 400), rng.normal(7, 1, 400)]
    bad = np.c_[rng.normal(-0.2, 0.02, 60), rng.normal(0.4, 0.02, 60), rng.normal(7, 1, 60)]
    for extra in (0, 1):  # one outlier makes plain Newton steps overshoot
        y = np.r_[np.ones(400), np.zeros(60)]
        x = np.r_[good, bad]
        if extra:
            x[0] = (0.9, 1.9, 0.5)
        w = zdict_quality.calibrate(x, y)
        p = 1 / (1 + np.exp(-zdict_quality.design(x) @ w))
        assert ((p > 0.3) == y).mean() > 0.98 and np.abs(w).max() < 1e3


def test_labels_that_say_nothing(spark, odd_docs, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = zdict_quality.fit(odd_docs, empty)
    assert {r.score for r in zdict_quality.score(odd_docs, model).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 1), (8, 0)], "doc_id long, quality int")
    model = zdict_quality.fit(odd_docs, odd)
    out = zdict_quality.score(odd_docs, model, keep=("lang", "a.b"))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert zdict_quality.score(no_docs, model).count() == 0


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + i for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for i in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


@pytest.mark.parametrize("seed", range(4))
def test_counts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab #\n\té|") for _ in range(rng.randint(0, 300))) for _ in range(40)] + [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in compression_rules.apply_rules(df).collect():
        want = slow_measure(texts[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_bands(spark):
    rng = random.Random(4)
    noise = "".join(chr(rng.randint(33, 126)) + (" " if rng.random() < 0.1 else "") for _ in range(9000))
    clean = prose(rng, 3000)
    looped = " ".join(f"{prose(rng, 6)} {k} the same words again and again and no end" for k in range(120))
    df = spark.createDataFrame([(0, clean), (1, noise), (2, looped)], "doc_id long, text string")
    assert [r.kept for r in compression_rules.apply_rules(df).orderBy("doc_id").collect()][:2] == [True, False]


def test_odd_documents(odd_docs, no_docs):
    rows = compression_rules.apply_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r.kept for r in rows if r.doc_id in (4, 5, 6, 10, 12))
    assert compression_rules.apply_rules(no_docs).count() == 0


def test_the_tail_after_the_last_whole_chunk_counts():
    rng = random.Random(7)
    rules, compressor = compression_rules.CompressionRules(), zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    clean = prose(rng, 3000).encode()
    noise = "".join(chr(rng.randint(33, 126)) + (" " if rng.random() < 0.1 else "") for _ in range(9000)).encode()
    assert compression_rules.measure(clean[:7996], rules, compressor)[6:] == (0.0, False, True)
    for tail, share in ((3900, 3900 / 7996), (4096, 0.5), (100, 0.0)):
        ratio, outside, failed, kept = compression_rules.measure(clean[:4096] + noise[:tail], rules, compressor)[5:]
        assert outside == share and not failed and kept == (share == 0 and ratio <= 0.74)


def test_bands_are_learned_from_good_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = compression_rules.fit(docs, labels)
    assert len(rules.bands) > 1 and rules != compression_rules.CompressionRules()
    out = compression_rules.apply_rules(docs, rules).where("not base_failed").join(labels, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    kept = {r.quality: (r.n, r.kept) for r in out.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1][1] >= 0.98 * kept[1][0]


def test_bands_without_labels_or_with_odd_ones(spark, odd_docs):
    rules = compression_rules.CompressionRules()
    assert compression_rules.fit(odd_docs, spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (8, 1)], "doc_id long, quality int")) == replace(rules, learned_from=1)  # the one good row lies within the bands
    sizes = np.repeat([100, 1000, 9000], 60)
    ratios = np.tile(np.linspace(0.5, 0.6, 60), 3)
    learned = compression_rules.learn_bands(sizes, ratios, np.zeros(0), rules, compression_rules.BandSpec(per_class=60))
    assert [b[0] for b in learned.bands] == [0, 1000, 9000] and learned.chunk_band == rules.chunk_band
    assert all(low <= 0.5 and high >= 0.6 for _, low, high in learned.bands)
    assert learned.band(50)[1] > learned.band(100)[1] and learned.band(90_000)[0] < learned.band(9000)[0]


def test_few_rows_widen_the_given_bands():
    rules = compression_rules.CompressionRules()
    sizes, ratios = np.array([300, 300, 5000]), np.array([0.1, 0.7, 0.95])
    few = compression_rules.learn_bands(sizes, ratios, np.array([0.9]), rules, compression_rules.BandSpec())
    assert few.band(300) == (0.1, 1.0) and few.band(5000) == (0.28, 0.95) and few.band(2000) == rules.band(2000)
    assert few.chunk_band == (0.28, 0.9) and few.learned_from == 3
    assert compression_rules.learn_bands(np.zeros(0, int), np.zeros(0), np.zeros(0), rules, compression_rules.BandSpec()) == rules


def test_long_rows_give_all_their_chunks_to_the_draw(spark):
    """A dictionary can hold what stands at any place of a long text."""
    spec = zdict_quality.QualitySpec()
    text = b"".join(b"%08d" % k * 128 for k in range(400))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([text, b"short"]), pa.array([1, 0], pa.int32())], names=["text", "label"])
    (out,) = zdict_quality._pieces_of(spec)([batch])
    assert b"".join(out.column("piece").to_pylist()[:-1]) == text and out.column("piece").to_pylist()[-1] == b"short"
    places = np.array(out.column("place").to_pylist()[:-1])
    assert (places > 0).all() and places.mean() > 10  # 400 chunks of one row weigh as sixteen
