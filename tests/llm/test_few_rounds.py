"""Groups of near-duplicates are found in few rounds: each round is a query, and the driver holds what every query leaves."""

from basinforge.llm import components, simhash_similarity
from test_pipeline import alike_first


def test_stars_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "_large_star", lambda edges: 1 / 0)
    edges = spark.createDataFrame([(5, 1), (1, 7), (6, 2), (3, 3), (None, 4)], "a long, b long")
    found = {tuple(r) for r in components.connected_components(edges, "a", "b").collect()}
    assert found == {(1, 1), (5, 1), (7, 1), (2, 2), (6, 2)}


def test_paths_and_joined_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(99, 120), (300, 200), (250, 300), (220, 250)]
    found = {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {(k, 0) for k in range(41)} | {(k, 99) for k in range(99, 140)} | {(k, 200) for k in (200, 220, 250, 300)}


def test_links_are_gone_through_once(spark, monkeypatch):
    """A crowd takes further rounds of links; each goes through groups, and not through the links before."""
    seen = []
    whole = components.connected_components
    monkeypatch.setattr(simhash_similarity, "connected_components", lambda edges, *ends: (seen.append({frozenset(r) for r in edges.select(*ends).collect() if r[0] != r[1]}), whole(edges, *ends))[1])
    base = [f"w{k}" for k in range(60)]
    texts = {i: " ".join([*base[:-1], f"x{i}"]) for i in range(40)} | {40 + i: " ".join(f"y{i}-{k}" for k in range(30)) for i in range(3)}
    texts |= {50 + i: t + " and" for i, t in list(texts.items())[40:]}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    first = {r.id: r.first_id for r in simhash_similarity.similar_groups(docs).collect()}
    assert first == alike_first(texts)
    assert len(seen) > 1 and not any(a & b for k, a in enumerate(seen) for b in seen[k + 1 :])


def test_regrouped(spark):
    groups = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (6, 2), (3, 3), (7, 3)], "node long, component long")
    links = spark.createDataFrame([(5, 7), (1, 5), (9, 6), (12, 11)], "a long, b long")
    found = {tuple(r) for r in simhash_similarity.regrouped(groups, links).collect()}
    assert found == {(1, 1), (5, 1), (3, 1), (7, 1), (2, 2), (6, 2), (9, 2), (11, 11), (12, 11)}
