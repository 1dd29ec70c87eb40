"""Deleted interpolation against counts in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from basinforge.llm import interpolation_lm as lm
from texts import prose


def part(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def tokens(text):
    return [*(text or "").encode().lower().split(), b" end"]


def slow_scores(rows, rounds):
    train = [(i, tokens(t)) for i, t in rows if part(i) != 2]
    kept, deleted = [t for i, t in train if part(i) != 5], [t for i, t in train if part(i) == 5]

    def counts(texts):
        words, pairs = Counter(), Counter()
        for t in texts:
            words.update([b" start", *t])
            pairs.update(zip([b" start", *t], t))
        return words, pairs

    words, pairs = counts([t for _, t in train])
    kwords, kpairs = counts(kept)
    n, v = sum(len(t) for _, t in train), len([w for w in words if w != b" start"])
    kn = sum(map(len, kept))
    uniform = 1 / (v + 1)
    bins = Counter()
    for t in deleted:
        for a, b in zip([b" start", *t], t):
            c = kwords[a]
            code = lambda p: 0 if not p else min(max(1 + int(np.rint(lm.FINE * math.log2(p / uniform))), 1), lm.TOP)
            bins[c.bit_length(), code(kpairs[a, b] / max(c, 1)), code(kwords[b] / max(kn, 1))] += 1
    weights = lm.band_weights(lm.learn_weights([(*k, m) for k, m in bins.items()], rounds))
    out = []
    for i, text in rows:
        t = tokens(text)
        p = 0.0
        for a, b in zip([b" start", *t], t):
            w = weights[words[a].bit_length()]
            p += math.log10(w[0] * pairs[a, b] / max(words[a], 1) + w[1] * words[b] / max(n, 1) + w[2] * uniform)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t)
        out.append((part(i) == 2, len(t), sum(words[w] > 0 for w in t), n, base, p))
    return out


def test_scores(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(120)]
    spec = lm.InterpolationSpec(block_bytes=2000, bucket_bytes=4000)  # many blocks and buckets
    got = {r.doc_id: tuple(r)[1:] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), spec).collect()}
    for (i, _), want in zip(rows, slow_scores(rows, spec.rounds)):
        assert got[i][:4] == want[:4]
        assert got[i][4] == pytest.approx(want[4], rel=1e-9) and got[i][5] == pytest.approx(want[5], rel=1e-9)


def test_held_out_text_is_more_likely_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_weights_are_learned():
    # what the pair count predicts well gets its weight
    good = lm.learn_weights([(3, 60, 10, 100)], 50)[3]
    poor = lm.learn_weights([(3, 0, 40, 100)], 50)[3]
    assert good[0] > 0.9 and poor[0] < 0.01 and sum(good) == pytest.approx(1)
    table = lm.band_weights({3: good})
    assert tuple(table[9]) == good and tuple(table[1]) == lm.DEFAULT_WEIGHTS and table[0][0] == 0


def test_probabilities_add_up(spark):
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b", "b c a", "c c b a"] * 8) if part(i) != 2]
    held = [i for i in range(1000, 2000) if part(i) == 2]
    # documents of one word w score P(w | start) P(end | w); the end alone scores P(end | start)
    probe = list(zip(held, ["a", "b", "c", "unknown"]))
    spec = lm.InterpolationSpec()
    scores = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows + probe + [(held[9], "")], "doc_id long, text string"), spec).collect()}
    want = dict(zip([i for i, _ in rows + probe + [(held[9], "")]], slow_scores(rows + probe + [(held[9], "")], spec.rounds)))
    assert all(scores[i] == pytest.approx(want[i][5]) for i in scores)
    weights = lm.band_weights({})
    assert all(sum(w) == pytest.approx(1) for w in weights.tolist())


def test_odd_documents(odd_docs, no_docs):
    out = lm.score(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert lm.score(no_docs).count() == 0
