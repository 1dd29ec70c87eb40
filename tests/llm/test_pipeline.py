"""The registered queries on the smallest tables, and the pipeline's stages one by one."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basinforge.llm import pii_crf, queries, zdict_quality
from oracle import TINY, database, same_rows
from test_lines import plain as plain_lines

COLUMNS = {
    1: {"doc_id", "fingerprint", "component_id"},
    2: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    3: {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    4: {"doc_id"},
    5: {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    6: {"doc_id", "held_out", "score", "predicted"},
    7: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    8: {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    9: {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    10: {"record_id"},
    11: {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    12: {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    13: {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    out = queries.QUERIES[name](spark, TINY)
    assert COLUMNS[int(name[2:].split("_")[0])] <= set(out.columns)
    rows = out.toPandas()
    if name in queries.ORACLE_SQL:
        same_rows(rows, database(TINY).execute(queries.ORACLE_SQL[name]).fetchdf())
    elif "doc_id" in rows:
        assert set(rows["doc_id"]) == set(range(200))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    schema, before = docs.columns, docs.count()
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, TINY).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == schema and 0 < docs.count() <= before
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
            before = docs.count()
        if name == "quality classifier":
            good = docs.join(labels.where("quality = 1"), "doc_id").count()
            assert good >= 0.97 * labels.where("quality = 1").count()
        if name == "pii":
            assert docs.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
    assert docs.select("doc_id").distinct().count() == before
    whole = corpus_pipeline.run(spark, TINY)
    assert whole.agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]


def alike_first(texts):
    """The least id of each text's group, by all pairs of sets of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    first = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if first[a] != first[b] and (common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9):
            low, high = sorted((first[a], first[b]))
            first = {i: low if f == high else f for i, f in first.items()}
    return first


def test_against_plain_passes(spark):
    """Every document of the smallest tables through plain versions of the stages; only the fits are shared."""
    docs, labels = spark.read.parquet(f"{TINY}/documents.parquet"), spark.read.parquet(f"{TINY}/labels.parquet")
    model = zdict_quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [i for i, s in zip(texts, model.scores([t.encode() for t in texts.values()])) if s >= 0.3]
    cut = plain_lines([(i, texts[i]) for i in sorted(kept)], 50)
    texts = {i: t for i, t, n in cut if not n or t.split()}
    first = alike_first(texts)
    texts = {i: t for i, t in texts.items() if first[i] == i}
    field = pii_crf.fit(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = {}
    for i, t in texts.items():
        ids = tokenizer.encode(pii_crf.redact(t, pii_crf.find(t, field)[1]), add_special_tokens=False).ids + [0]
        want[i] = np.array(ids, "<u4").tobytes()
    got = {}
    for r in sorted(corpus_pipeline.run(spark, TINY).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == want


def test_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs.select(*corpus_pipeline.COLUMNS), no_docs.select(*corpus_pipeline.COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, TINY)
            assert out.count() >= 0
