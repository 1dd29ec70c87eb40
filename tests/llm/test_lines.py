"""Line deduplication against a plain pass."""

import random

import pytest

from basinforge.llm import line_winnow
from texts import prose


def plain(docs, least):
    """docs: (id, text) in order of id. Texts without runs that stand earlier."""
    places, kept = {}, []
    worded = {}
    for i, text in docs:
        lines = text.split("\n")
        worded[i] = [(at, line, len(line.split())) for at, line in enumerate(lines) if line.split()]
        w = worded[i]
        for k in range(len(w)):
            n, e = 0, k
            while e < len(w) and n < least:
                n += w[e][2]
                e += 1
            if n >= least:
                places.setdefault(tuple(x[1] for x in w[k:e]), []).append((i, k, e))
    for i, text in docs:
        w, gone = worded[i], set()
        for found in places.values():
            first = min(found)
            for j, k, e in found:
                if j == i and (j, k, e) != first and (j != first[0] or k >= first[2]):
                    gone |= set(range(k, e))
        cut = {w[k][0] for k in gone}
        for k in gone:
            if k + 1 in gone:
                cut |= set(range(w[k][0], w[k + 1][0]))
        kept.append((i, "\n".join(x for at, x in enumerate(text.split("\n")) if at not in cut), len(gone)))
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_pass(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randint(1, 12), 100) for _ in range(14)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_deleted_lines) for r in line_winnow.drop_repeated_lines(df, 15).collect()}
    assert got == {i: (t, n) for i, t, n in plain(docs, 15)} and sum(n for _, n in got.values())


def test_a_passage_in_other_surroundings(spark):
    rng = random.Random(9)
    passage = "\n".join(prose(rng, 20, 100) for _ in range(3))
    docs = [(k, "\n".join([prose(rng, 30, 10), passage, prose(rng, 30, 10)])) for k in range(5)]
    out = line_winnow.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), 50)
    assert [passage in r.text for r in out.orderBy("doc_id").collect()] == [True] + [False] * 4


def test_odd_documents(odd_docs, no_docs):
    out = line_winnow.drop_repeated_lines(odd_docs, 50)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and set(out.columns) == {*odd_docs.columns, "n_deleted_words"}
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].text == "" and by_id[2].text == "" and by_id[4].text is None and by_id[5].text == ""
    assert by_id[8].n_deleted_lines == 0 and by_id[7]["a.b"] == "clash" and by_id[7]["__hash"] == "clash"
    first = next(r for r in rows if r.doc_id is None and r.text)
    assert first.n_deleted_lines == 0  # a null id sorts first
    assert line_winnow.drop_repeated_lines(no_docs, 50).count() == 0


def test_a_passage_behind_other_neighbours_of_the_same_line(spark):
    """The chosen line's first place has other surroundings than the repeated passages, which meet in a further round."""
    rng = random.Random(4)
    middle = prose(rng, 6, 100)
    first = "\n".join([prose(rng, 30, 100), middle, prose(rng, 30, 100)])
    left, right, other = prose(rng, 30, 100), prose(rng, 30, 100), prose(rng, 30, 100)
    docs = [(0, first), (1, f"{left}\n{middle}\n{right}"), (2, f"{left}\n{middle}\n{other}"), (3, f"{left}\n{middle}\n{right}"), (4, f"{left}\n{middle}\n{other}"), (5, first)]
    got = {r.doc_id: r.text for r in line_winnow.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), 50).collect()}
    assert got == {i: t for i, t, _ in plain(docs, 50)} and [got[k] == "" for k in range(6)] == [False, False, False, True, True, True]


def test_without_the_join_of_positions_nothing_is_found(spark, monkeypatch):
    rng = random.Random(2)
    text = "\n".join(prose(rng, 20, 100) for _ in range(4))
    docs = spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string")
    count = lambda: line_winnow.repeated_runs(docs, 50).count()
    assert count() == 2
    monkeypatch.setattr(line_winnow, "spread_join", lambda many, one, key: many.join(one.limit(0), key))
    assert count() == 0


def test_a_match_that_is_not_extended_finds_no_more_than_the_line(spark, monkeypatch):
    rng = random.Random(2)
    text = "\n".join(prose(rng, 20, 100) for _ in range(4))
    docs = spark.createDataFrame([(k, text) for k in range(2)], "doc_id long, text string")
    monkeypatch.setattr(line_winnow, "_agrees", lambda own, other: line_winnow.F.lit(0))
    monkeypatch.setattr(line_winnow, "_beyond", lambda found: found.where("false"))
    assert line_winnow.repeated_runs(docs, 50).count() == 0
