import hashlib
import random

import numpy as np
import pytest

from basinforge.llm import prefix_hashes as P
from basinforge.llm import queries
from oracle import TINY, database
from texts import prose


def hashes(text):
    """Length and polynomial hashes with Python's own integers."""
    each = [sum((ord(c) + 1) * pow(b, k, P.MODULUS) for k, c in enumerate(text)) % P.MODULUS for b in P.BASES]
    return f"{len(text):x}-" + "".join(f"{h:08x}" for h in each)


def likeness(x, y):
    """The definition, position by position."""
    seeds, spots = [(0, 0), (len(x), len(y))], []
    for a in range(0, len(x) // P.SEED * P.SEED, P.SEED):
        block = x[a : a + P.SEED]
        found = [k for k in range(len(y) - P.SEED + 1) if y.startswith(block, k)]
        spots += found
        seeds += [(a, k) for k in found[:1]]
    in_x, in_y = set(), {k + d for k in spots for d in range(P.SEED)}
    for a, b in seeds:
        low = high = 0
        while a + high < len(x) and b + high < len(y) and x[a + high] == y[b + high]:
            high += 1
        while low < min(a, b) and x[a - low - 1] == y[b - low - 1]:
            low += 1
        in_x |= set(range(a - low, a + high))
        in_y |= set(range(b - low, b + high))
    return (len(in_x) + len(in_y)) / (len(x) + len(y)) if x or y else 1.0


def changed(x, y):
    half = len(x) // 2
    return x[: len(x) - half] + y[:half]


def plainly(rows):
    """All columns for (id, text) rows whose ids and texts don't tie."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = changed(text, following)
        out.append((i, len(text), hashlib.sha256(e.encode()).hexdigest(), hashes(text), hashes(e), round(likeness(text, e), 12), round(likeness(text, following), 12)))
    return sorted(out, key=str)


def ours(docs):
    return sorted(((*r[:5], round(r[5], 12), round(r[6], 12)) for r in P.fingerprint_documents(docs).collect()), key=str)


def some_texts():
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split(" ")
    near = " ".join(words[:100] + ["other"] + words[101:])
    return [base, base, near, prose(rng, 200), base[500:] + base[:500], "", None, "a", "ab", base[:33], base[:31], "é漢字 \U0001f600" * 40, "x" * 700, "x" * 650, ("same line\n" * 30), near + base, prose(rng, 40), ""]


def test_pairs_against_plain_computation():
    texts = [t or "" for t in some_texts()]
    found = P.compared([t.encode() for t in texts], list(range(1, len(texts))))
    for k, (x, y) in enumerate(zip(texts, texts[1:])):
        e = changed(x, y)
        assert [c[k] for c in found[:4]] == [len(x), hashlib.sha256(e.encode()).hexdigest(), hashes(x), hashes(e)]
        assert found[4][k] == pytest.approx(likeness(x, e))
        assert found[5][k] == pytest.approx(likeness(x, y))


def test_span_equality_and_extensions():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(2)]
    h = P.PrefixHashes.of([t.encode() for t in texts])
    joined = "".join(texts)
    a, b = (np.array([rng.randrange(0, 380) + at for _ in range(500)]) for at in (0, 400))
    n = np.array([rng.randrange(1, 12) for _ in range(500)])
    assert h.equal(a, b, n).tolist() == [joined[x : x + k] == joined[y : y + k] for x, y, k in zip(a, b, n)]
    far = h.extension(a, b, np.minimum(400 - a, 800 - b))
    for x, y, k in zip(a.tolist(), b.tolist(), far.tolist()):
        assert joined[x : x + k] == joined[y : y + k]
        assert x + k == 400 or y + k == 800 or joined[x + k] != joined[y + k]


@pytest.mark.parametrize("parts", [1, 5])
def test_documents_in_descending_order(spark, parts):
    rows = [(k * 7 % 19, t) for k, t in enumerate(some_texts())] + [(None, "no id " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts * 3))  # some ranges hold a row or none
    try:
        assert ours(docs) == plainly(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(odd_docs):
    found = P.fingerprint_documents(odd_docs).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert len(found) == odd_docs.count()
    for r in found:
        assert r["fingerprint"] in [hashes(t) for t in texts[r["doc_id"]]]
        assert 0 <= r["near_next"] <= 1 and 0.5 <= r["near_edited"] <= 1
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["fingerprint"] == by_id[1]["fingerprint"]
    assert by_id[2]["near_next"] == 1.0  # document 1 is a copy
    twice = [r for r in found if r["doc_id"] == 3]
    assert twice[0]["fingerprint"] == twice[1]["fingerprint"] and 1.0 in (twice[0]["near_next"], twice[1]["near_next"])


def test_one_row_follows_itself(spark):
    (r,) = P.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert (r["near_next"], r["edited_sha256"]) == (1.0, hashlib.sha256(b"abcabc").hexdigest())


def test_empty_table(no_docs):
    assert P.fingerprint_documents(no_docs).count() == 0


def test_query_over_the_whole_table(spark):
    rows = database(TINY).execute("SELECT doc_id, text FROM documents").fetchall()
    found = queries.QUERIES["op12_prefix_hashes"](spark, TINY).collect()
    order = sorted(rows, reverse=True)
    follow = {i: (t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)}
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in rows)
    for r in found:
        text, following = follow[r["doc_id"]]
        e = changed(text, following)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(e.encode()).hexdigest())
        if len(text) < 1500:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (hashes(text), hashes(e))
            assert r["near_edited"] == pytest.approx(likeness(text, e))
            assert r["near_next"] == pytest.approx(likeness(text, following))
