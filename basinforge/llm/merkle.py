"""Merkle manifest of a dataset: an authentication path for every row, by traversal scheduling.

Nodes have up to eight children.  Each group of rows (a language) is a tree over its rows in
order; the groups' roots are the leaves of one more tree, whose root stands for the dataset.

A tree is worked on in aligned blocks of 512 leaves, which hold three levels.  Going up, a
treehash stack turns each block into its root, and the roots are the leaves of the next layer, until one node is left.
Going down, each block's traversal gives one path after the other: for each level it
holds the run of up to eight nodes that the path goes through, while a treehash stack makes the level's next
run.  A schedule gives every step as many leaves as there are levels, each to the unfinished stack whose
lowest node is lowest, so that a traversal holds a number of nodes that is logarithmic in the block.
The path above a block is the same for all its leaves and is appended to each.

No group is larger than a block: a language with all rows is many blocks, and places in the order
come from ranges and their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basinforge.llm.textcols import checkpointed, forget, tidied

ARITY = 8
#: Levels of a block, which so has 8 ** 3 leaves.
HEIGHT = 3
BLOCK = ARITY**HEIGHT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(nodes: Sequence[str]) -> str:
    """The parent of nodes in hexadecimal: sha256 of their joined text."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


@dataclass
class TreeHash:
    """A stack that takes the leaves from ``at`` to ``stop`` one by one and makes the run of their nodes at ``level``."""

    leaves: Sequence[str]
    level: int
    at: int
    stop: int
    waiting: list[list[str]] = field(init=False)

    def __post_init__(self):
        self.stop = min(self.stop, len(self.leaves))
        self.waiting = [[] for _ in range(self.level + 1)]

    @property
    def done(self) -> bool:
        return self.at >= self.stop

    def lowest(self) -> int:
        """The level of the lowest node that waits; a stack without any counts as at its own level."""
        return next((k for k, nodes in enumerate(self.waiting) if nodes), self.level)

    def held(self) -> int:
        return sum(map(len, self.waiting))

    def advance(self) -> None:
        """Takes one leaf; runs of eight, and at the end shorter ones too, become their parents."""
        self.waiting[0].append(self.leaves[self.at])
        self.at += 1
        for k in range(self.level):
            if len(self.waiting[k]) == ARITY or self.done and self.waiting[k]:
                self.waiting[k + 1].append(digest(self.waiting[k]))
                self.waiting[k] = []
            elif not self.done:
                break

    def run(self) -> list[str]:
        while not self.done:
            self.advance()
        return self.waiting[self.level]


Path = list[tuple[str, str]]


class Traversal:
    """Authentication paths of a block's leaves, in order: for each level, what stands left and what right of the path in its run.

    ``most`` is the greatest number of nodes held at once and ``late`` the leaves that a stack
    had still to take when its run was due.
    """

    def __init__(self, leaves: Sequence[str], height: int):
        self.leaves, self.height, self.most, self.late = leaves, height, 0, 0

    def paths(self) -> Iterator[Path]:
        leaves, height, n = self.leaves, self.height, len(self.leaves)
        width = [ARITY ** (level + 1) for level in range(height)]
        runs = [TreeHash(leaves, level, 0, w).run() for level, w in enumerate(width)]
        ahead = [TreeHash(leaves, level, w, 2 * w) for level, w in enumerate(width)]
        path: Path = [("", "")] * height
        for i in range(n):
            for level in range(height):
                if i % (width[level] // ARITY):
                    break  # this level's node and all above it are as they were
                if i and i % width[level] == 0:
                    self.late += ahead[level].stop - ahead[level].at
                    runs[level] = ahead[level].run()
                    ahead[level] = TreeHash(leaves, level, i + width[level], i + 2 * width[level])
                k = i // (width[level] // ARITY) % ARITY
                path[level] = ("".join(runs[level][:k]), "".join(runs[level][k + 1 :]))
            yield list(path)
            for _ in range(height):
                open_ = [x for x in ahead if not x.done]
                if not open_:
                    break
                min(open_, key=TreeHash.lowest).advance()
            self.most = max(self.most, sum(map(len, runs)) + sum(x.held() for x in ahead))


def fold(node: str, path: Path) -> str:
    """The root that a node has by its path."""
    for left, right in path:
        node = digest((left, node, right))
    return node


# the rows as leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """A row's leaf: sha256 of its values, each as its length in bytes, a colon and itself, or ``-`` for null."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _placed(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos``, the place from 0 in the tree in that order (nulls first), and ``n``, the tree's rows; and the table they are kept in.

    Rows are dealt by ranges of the tree and the order, so a tree with all rows spans all of them.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = checkpointed(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    )
    own = Window.partitionBy(tree)  # a row for each range that holds some of the tree
    counts = dealt.groupBy(tree, "__part").agg(F.count(F.lit(1)).alias("c"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("c").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(tree).alias("__tree"), F.col("__part").alias("__p"), (before - F.col("first")).alias("shift"), F.sum("c").over(own).alias("n"))
    found = dealt.join(counts, dealt[tree].eqNullSafe(F.col("__tree")) & (F.col("__part") == F.col("__p")))
    return found.select(*[F.col(c) for c in rows.columns], (F.col("__at") + F.col("shift")).alias("pos"), "n"), dealt


# trees of nodes: tree, pos, n, node

_PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _height(n: int) -> int:
    return min(HEIGHT, levels(n))


def _block_roots(nodes: DataFrame) -> DataFrame:
    """One node a block: the next layer of the trees."""

    def root(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n = table["n"][0].as_py()
        stack = TreeHash(table["node"].to_pylist(), _height(n), 0, BLOCK)
        (node,) = stack.run()
        return pa.table({"tree": table["tree"][:1], "pos": table["block"][:1], "n": pa.array([-(-n // BLOCK)], pa.int64()), "node": [node]})

    return _in_blocks(nodes).select("tree", "block", "pos", "n", "node").groupBy("tree", "block").applyInArrow(root, "tree long, pos long, n long, node string")


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """The layers above ``nodes``: block roots, theirs, and so on; the last has one node for each tree."""
    out = [checkpointed(_block_roots(nodes))]
    while out[-1].where("n > 1").limit(1).count():
        out.append(checkpointed(_block_roots(out[-1])))
    return out


def _with_paths(nodes: DataFrame, above: DataFrame, keep: T.StructType, emit: Callable[[dict, Path, dict], dict]) -> DataFrame:
    """Every node's path in its block with its block's path behind it, as rows that ``emit`` makes.

    ``above`` has tree, pos, the block's path and what else a block's nodes share; ``emit`` gets a
    node's row, its path and the block's row.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, shared = _sorted(left), right.to_pylist()[0]
        upper = [(x["left"], x["right"]) for x in shared["path"]]
        rows = left.to_pylist()
        traversal = Traversal(left["node"].to_pylist(), _height(rows[0]["n"]))
        made = [emit(row, path + upper, shared) for row, path in zip(rows, traversal.paths())]
        return pa.table({name: pa.array([m[name] for m in made], kind) for name, kind in kinds.items()})

    kinds = {f.name: _ARROW_PATH if f.name in ("path", "proof") else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in keep}
    blocks = above.withColumnRenamed("pos", "block")
    return _in_blocks(nodes).groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_tidied_pair(run), keep)


def _tidied_pair(kernel: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``tidied`` for a kernel of two tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return tidied(lambda both: kernel(*both))((left, right))

    return run


def _down(layers: list[DataFrame], top: DataFrame, shared: list[T.StructField]) -> DataFrame:
    """The lowest layer's nodes with their paths to where ``top``'s paths lead; ``top`` has tree, pos, path and the columns ``shared``."""
    schema = T.StructType([T.StructField("tree", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("path", _PATH), *shared])
    names = [f.name for f in shared]

    def emit(row: dict, path: Path, above: dict) -> dict:
        return {"tree": row["tree"], "pos": row["pos"], "path": [{"left": a, "right": b} for a, b in path]} | {c: above[c] for c in names}

    for layer in reversed(layers[:-1]):
        top = _with_paths(layer, top, schema, emit)
    return top


_OUTPUTS = {"subroot": T.StringType(), "root": T.StringType(), "proof": _PATH, "proof_sha256": T.StringType(), "folded_root": T.StringType(), "verified": T.BooleanType()}


def authenticate(
    rows: DataFrame,
    values: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree_col: str = "lang",
    id_col: str = "doc_id",
    outputs: tuple[str, ...] = ("subroot", "root", "proof"),
    changed: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """The id, ``leaf`` and the ``outputs`` wanted, one row for each of ``rows``.

    ``proof`` is the path to the dataset's root: for each level what stands left and what right of the path's node,
    as joined digests; ``proof_sha256`` is the digest of all of it; ``folded_root`` the root that
    the row's leaf, or the leaf that ``changed`` makes of ``rows`` where it isn't null, has by that path; ``verified`` whether that is the root.

    Nulls: a null value is ``-`` in the leaf; rows without a value in ``tree_col`` are a tree of their own, the first; a row without id stands
    before those with one.  Ties: rows of one id are ordered by their leaves, and equal rows have one leaf in several places, each with its own path.
    Empty and very long texts are values like others; only digests are moved.  An empty table gives no rows.  Other columns are left behind, whatever their names.
    """
    wanted = {*values, tree_col, id_col}
    held = rows.select(*[rows[c].alias(c) for c in rows.columns if c in wanted], (changed(rows) if changed else F.lit(None).cast("string")).alias("__changed"))
    leaves = held.select(F.col(id_col).alias("id"), F.col(tree_col).alias("part"), leaf([F.col(c) for c in values]).alias("node"), F.col("__changed").alias("changed"))
    placed, dealt = _placed(leaves, "part", ["id", "node"])
    # the trees by number, in the order of their values; a tree's number is its place among the subroots
    trees = placed.where("pos = 0").select(F.lit(0).alias("all"), "part")
    numbers, numbered = _placed(trees, "all", ["part"])
    numbers = numbers.select(F.col("part").alias("__of"), F.col("pos").alias("tree"), F.col("n").alias("trees"))
    nodes = checkpointed(placed.join(numbers, placed["part"].eqNullSafe(F.col("__of"))).drop("__of", "part"))
    forget(dealt)
    forget(numbered)
    lower = _layers(nodes)
    subroots = lower[-1].join(nodes.where("pos = 0").select("tree", "trees"), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("n"), "node")
    upper = [checkpointed(subroots), *_layers(subroots)]
    root = T.StructField("root", T.StringType())
    top = upper[-1].select("tree", "pos", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"))
    to_root = _down(upper, top, [root])
    # each tree's own top node is a block of one, whose path is its subroot's
    tops = to_root.join(upper[0].select("pos", F.col("node").alias("subroot")), "pos").select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root", "subroot")
    blocks = _down(lower, tops, [root, T.StructField("subroot", T.StringType())])
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("leaf", T.StringType()), *[T.StructField(o, _OUTPUTS[o]) for o in outputs]])

    def emit(row: dict, path: Path, above: dict) -> dict:
        out = {id_col: row["id"], "leaf": row["node"], "subroot": above["subroot"], "root": above["root"]}
        if "proof" in outputs:
            out["proof"] = [{"left": a, "right": b} for a, b in path]
        if "proof_sha256" in outputs:
            out["proof_sha256"] = digest([x for pair in path for x in pair])
        if "folded_root" in outputs or "verified" in outputs:
            out["folded_root"] = fold(row["changed"] or row["node"], path)
            out["verified"] = out["folded_root"] == above["root"]
        return out

    return _with_paths(nodes, blocks, schema, emit)


def lowered(rows: DataFrame, modulus: int = 3, values: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", id_col: str = "doc_id") -> Column:
    """The leaf of a row with A-Z of its text in lower case, where ``modulus`` divides crc32 of the id as text (a null id is empty text); else null."""
    chosen = F.crc32(F.coalesce(rows[id_col].cast("string"), F.lit("")).cast("binary")) % modulus == 0
    other = [F.translate(rows[c], _UPPER, _LOWER) if c == text_col else rows[c] for c in values]
    return F.when(chosen, leaf(other))
