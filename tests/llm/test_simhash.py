"""SimHash: fingerprints and groups against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basinforge.llm import components, simhash, simhash_similarity


def slow_fingerprint(text: bytes, k: int) -> int:
    words = text.lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def slow_groups(fps: list[int], limit: int) -> list[int]:
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if label[j] < label[i] and bin((a ^ b) & (1 << 64) - 1).count("1") <= limit:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(simhash, "_STEP", 7)  # long texts go in steps
    for n in (0, 1, 2, 3, 4, 7, 8, 9, 30):
        text = " ".join(rng.choice("aBcDe") * rng.randint(1, 3) for _ in range(n)).encode()
        assert simhash.simhash(text, 3) == slow_fingerprint(text, 3)


@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize("limit", [0, 1, 2])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, limit, crowded):
    if crowded:
        monkeypatch.setattr(simhash, "MAX_PAIRS", 0)  # all through the finest grid
    rng = random.Random(limit)
    fps = {0, -1, (1 << 63) - 1, -(1 << 63)}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add((x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) - (1 << 63))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(df, limit)
    found = {r.node: r.component for r in components.connected_components(links, "a", "b").collect()}
    want = slow_groups(fps, limit)
    assert [found.get(f, f) for f in fps] == [fps[k] for k in want]


def test_segment_counts(spark):
    values = [0, -1, 1, -(1 << 63), 0x123456789ABCDEF, -0x123456789ABCDEF]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for bits in (4, 8):
        got = [r[0] for r in df.select(simhash.segment_counts(F.col("fp"), bits)).collect()]
        for v, g in zip(values, got):
            u = v & (1 << 64) - 1
            assert g == sum(bin(u >> s & (1 << bits) - 1).count("1") << s for s in range(0, 64, bits))


def test_odd_documents(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs, shingle=3)
    got = {}
    for r in rows.collect():
        got.setdefault(r.doc_id, r)
    assert rows.count() == odd_docs.count() and rows.columns == ["doc_id", "fp", "component_id"]
    assert got[1].component_id == got[2].component_id == 1 and got[None].component_id in (1, 4)
    assert got[4].fp == got[5].fp == got[6].fp == 0 and got[4].component_id == got[5].component_id == 4
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


def test_similar_groups(spark, odd_docs, no_docs):
    rng = random.Random(5)
    rows, families = [], []
    for f in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 150, 400]))]
        family = []
        for copy in range(4):
            mine = words[:]
            if copy:
                mine[(copy * 37) % len(mine)] = f"changed{copy}"
            family.append(len(rows))
            rows.append((len(rows), " ".join(mine)))
        families.append(family)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.id: r.first_id for r in simhash_similarity.similar_groups(docs).collect()}
    long_enough = [f for f in families if len(rows[f[0]][1].split()) >= 150]
    assert all(first[d] == f[0] for f in long_enough for d in f)
    assert all(first[d] in f for f in families for d in f)  # nothing joined across families
    kept = simhash_similarity.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("text like '%漢字%'").count() == 1
    assert kept.where("doc_id in (2, 3)").count() == 0
    assert simhash_similarity.drop_near_duplicates(no_docs).count() == 0


def changed_pairs(n_pairs, run, seed):
    """Texts of 300 words and copies with a run of words changed: run + 4 of 296 shingles differ."""
    rng, rows = random.Random(seed), []
    for k in range(n_pairs):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words[:100] + [f"c{rng.randrange(10**9)}" for _ in range(run)] + words[100 + run :])))
    return rows


def test_every_pair_at_the_limit_is_found(spark):
    rows = changed_pairs(60, 28, 1)  # 264 of 328 shingles are common
    rows += [(1000 + k, f"a text of its own {k} {k * k}") for k in range(3000)]  # the size of the table tells nothing
    first = {r.id: r.first_id for r in simhash_similarity.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(first[2 * k + 1] == 2 * k for k in range(60)) and len(set(first.values())) == 3060


def test_pairs_in_crowded_blocks(spark):
    rng = random.Random(2)
    passages = [[f"p{k}w{i}" for i in range(60)] for k in range(10)]
    rows = []
    for chosen in itertools.combinations(range(10), 5):  # pages of common passages, at most 0.7 alike
        words = [w for k in chosen for w in passages[k]]
        rows += [(len(rows), " ".join(words))]
        words[rng.randrange(len(words))] = f"changed{len(rows)}"
        rows += [(len(rows), " ".join(words))]
    first = {r.id: r.first_id for r in simhash_similarity.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert first == {i: i - i % 2 for i in range(504)}


def test_pairs_below_the_limit_are_not_linked(spark):
    rows = changed_pairs(40, 29, 4)  # 263 of 329 shingles are common: 0.799
    rng = random.Random(9)
    line = "one long line again " * 300  # repeats of a shingle count once
    rows += [(k, line + " ".join(f"o{rng.randrange(10**9)}" for _ in range(300))) for k in (500, 501)]
    first = {r.id: r.first_id for r in simhash_similarity.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert first == {i: i for i, _ in rows}


def test_families_of_edited_copies(spark):
    """Copies with none to a dozen changed, dropped or added words: just the groups that all pairs give."""
    rng, rows = random.Random(11), []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(90):
            words = base[:]
            for _ in range(rng.randint(0, 12)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    first = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9 and first[a] != first[b]:
            old, new = max(first[a], first[b]), min(first[a], first[b])
            first = [new if f == old else f for f in first]
    found = {r.id: r.first_id for r in simhash_similarity.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(first)) and 30 < len(set(first)) < 250
