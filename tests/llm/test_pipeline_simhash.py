"""The pipeline's near-duplicates go through SimHash: what op1 links is one group there, too."""

import random

import corpus_pipeline
from basinforge.llm import simhash
from texts import prose


def test_what_fingerprints_link_is_one_group(spark):
    rng = random.Random(5)
    words = prose(rng, 30).split()
    # the same shingles of three words over and over with one other in between: two fingerprints alike, five-word sets that are not
    unit = words[:3]
    texts = [" ".join(unit * 200), " ".join(unit * 100 + [words[5]] + unit * 100 + [words[6]]), prose(rng, 300), prose(rng, 300)]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=3).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 2, 3}
