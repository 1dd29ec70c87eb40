import hashlib
import random
import zlib

import pytest

from basinforge.llm import merkle, queries
from oracle import TINY, database, same_rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    """All levels of a tree, from its leaves to its root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    """(left, right) per level of the leaf at that place."""
    out = []
    for nodes in tree[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 100, 511, 512])
def test_traversal_gives_every_path(n):
    leaves = [sha(str(k)) for k in range(n)]
    tree = up(leaves)
    walk = merkle.Traversal(leaves, merkle.levels(n))
    for at, path in enumerate(walk.paths()):
        assert path == siblings(tree, at)
        assert merkle.fold(leaves[at], path) == tree[-1][0]
    assert walk.late == 0


def test_traversal_holds_few_nodes():
    leaves = [sha(str(k)) for k in range(8**4)]
    walk = merkle.Traversal(leaves, 4)
    assert sum(1 for _ in walk.paths()) == len(leaves)
    assert walk.late == 0
    assert walk.most <= 4 * 8 * 3  # of 4096 leaves


@pytest.mark.parametrize("n, height", [(1, 3), (9, 3), (65, 3), (511, 3)])
def test_last_block_of_a_larger_tree_keeps_all_its_levels(n, height):
    leaves = [sha(str(k)) for k in range(n)]
    nodes = leaves
    for _ in range(height):
        nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    assert merkle.TreeHash(leaves, height, 0, merkle.BLOCK).run() == nodes
    assert all(merkle.fold(x, p) == nodes[0] for x, p in zip(leaves, merkle.Traversal(leaves, height).paths()))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def plainly(rows):
    """The whole manifest in one process: a sorted list of the query's rows."""
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*[coded(r[c]) for c in FIELDS])
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        order[lang], trees[lang] = own, up([leaf(r) for r in own])
    top = up([trees[x][-1][0] for x in langs])
    out = []
    for nth, lang in enumerate(langs):
        for at, r in enumerate(order[lang]):
            path = siblings(trees[lang], at) + siblings(top, nth)
            changed = dict(r)
            if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 0 and r["text"] is not None:
                changed["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            node = leaf(changed)
            for a, b in path:
                node = sha(a, node, b)
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], top[-1][0], sha(*[x for p in path for x in p]), node, node == top[-1][0]))
    return sorted(out, key=str)


OUTPUTS = ("subroot", "root", "proof_sha256", "folded_root", "verified")


def ours(docs):
    return sorted(map(tuple, merkle.authenticate(docs, outputs=OUTPUTS, changed=merkle.lowered).collect()), key=str)


def test_odd_rows_against_plain_computation(odd_docs):
    assert ours(odd_docs) == plainly([r.asDict() for r in odd_docs.select(*FIELDS).collect()])


def test_many_blocks_and_trees(spark):
    rng = random.Random(3)
    langs = [None, "", "Z", "a", "é", "漢", *[f"l{k}" for k in range(20)]]
    rows = [(k, rng.choice("AbC") * rng.randint(0, 5), rng.choice(langs) if k % 3 else "hot", rng.choice("xy"), k % 5 or None) for k in range(2000)]
    rows += rows[:30] + [(None, t, "hot", "x", 1) for t in ("A", "A", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert ours(docs) == plainly([r.asDict() for r in docs.collect()])


def test_proof_column_folds_to_the_root(odd_docs):
    for r in merkle.authenticate(odd_docs, outputs=("root", "proof")).collect():
        assert merkle.fold(r["leaf"], [(p["left"], p["right"]) for p in r["proof"]]) == r["root"]


def test_empty_table(no_docs):
    assert merkle.authenticate(no_docs, outputs=OUTPUTS, changed=merkle.lowered).count() == 0


def test_query_against_sql(spark):
    name = "op11_merkle_traversal"
    same_rows(queries.QUERIES[name](spark, TINY).toPandas(), database(TINY).execute(queries.ORACLE_SQL[name]).fetchdf())
