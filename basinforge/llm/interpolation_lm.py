"""Language-model scores by deleted interpolation.

The probability of a word mixes maximum-likelihood estimates of falling order,

    P(w | v) = a * c(v w) / c(v) + b * c(w) / N + e / (V + 1),

with one set of weights (a, b, e) for each band of the context's frequency c(v)
(its power of two).  The weights are learned by expectation-maximisation on
held-out counts: one part of the training rows (the deleted part) is predicted
from the counts of the others.  The scores then use the counts of all training
rows.  A document's words are followed by one end token and led by a start mark
that is a context only.

How it scales.  Documents are tokenised in blocks.  A block asks for the
counts of its distinct words and word pairs only, in one request for each
bucket of the 64-bit key space; a bucket merges the requests of all blocks and
answers each in its order.  So the keys that move are linear in the input, a frequent
word counts once per block, no count table goes to the driver or to all tasks,
and no task holds more than one block or one bucket.  Words and pairs are known
by 64-bit hashes.

The messages, though, are as many as blocks times buckets: about 150 bytes of each are not
keys.  At 30 GB those are 3 % of what moves.  Past 2 TB blocks and buckets
grow with the input, so that there are at most 2 ** 36 messages: at 100 TB a block stands for
400 MB of text (some 3 GB in its task) and the messages' own bytes come to 10 TB.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinforge.llm.textcols import checkpointed, crc_bucket, release, slices, text_bytes, tidied

END, START = 0, 1  # local ids; words follow
_END_KEY, _START_KEY = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start"))  # no word holds a space
RETAINED, DELETED, HELD_OUT = 0, 1, 2
#: Bins of a power of two in the statistics that the weights are learned from, and the highest bin.
FINE, TOP = 4, 255
DEFAULT_WEIGHTS = (0.4, 0.5, 0.1)
LEAST_WEIGHT = 1e-4


@dataclass(frozen=True)
class InterpolationSpec:
    """Rows whose crc32(id) modulo ``folds`` is ``held_out`` are not learned from; those at ``deleted`` set the weights.

    ``block_bytes`` and ``bucket_bytes`` are the text that a block and a bucket
    stand for; past ``most_buckets`` buckets both grow with the input.
    """

    folds: int = 7
    held_out: int = 2
    deleted: int = 5
    block_bytes: int = 12 << 20
    bucket_bytes: int = 8 << 20
    most_buckets: int = 1 << 18
    rounds: int = 40


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self) + 2
        return i


def _packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


class _Block:
    """Tokenised documents: ids, tokens in local numbers, lengths and each one's part of the rows."""

    def __init__(self):
        self.words, self.ids, self.tokens, self.parts, self.size = _Vocabulary(), [], [], [], 0

    def add(self, key, text: bytes, part: int) -> None:
        words = text.lower().split()
        row = np.empty(len(words) + 1, np.int32)
        row[:-1] = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        row[-1] = END
        self.ids.append(key)
        self.tokens.append(row)
        self.parts.append(part)
        self.size += len(text) + 64

    def packed(self) -> bytes:
        digest = xxhash.xxh64_intdigest
        keys = np.array([_END_KEY, _START_KEY, *map(digest, self.words)], np.uint64)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        tokens = np.concatenate(self.tokens)
        planes = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T)  # equal bytes together
        return _packed(self.ids, np.array(self.parts, np.int8), lengths, planes, keys)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class _Counts:
    """A block's distinct words and pairs, in the order in which they are asked for."""

    def __init__(self, packed: bytes, buckets: int):
        self.ids, self.parts, self.lengths, planes, self.word_keys = _unpacked(packed)
        self.tokens = np.ascontiguousarray(planes.T).view(np.int32).ravel()
        self.ends = np.cumsum(self.lengths)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.r_[0, self.ends[:-1]]] = START
        self.before, width = before, len(self.word_keys)
        pairs, self.pair = np.unique(before * np.int64(width) + self.tokens, return_inverse=True)
        self.pair_keys = _pair_keys(self.word_keys[pairs // width], self.word_keys[pairs % width])
        self.buckets = buckets
        self.word_order, self.word_edges = self._order(self.word_keys)
        self.pair_order, self.pair_edges = self._order(self.pair_keys)

    def _order(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys by bucket, ascending within; where each bucket's begin and end."""
        bucket = ((keys >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(keys, kind="stable")  # buckets are ranges of keys
        return order, np.searchsorted(bucket[order], np.arange(self.buckets + 1))

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """How often training rows have each word and pair."""
        learned = np.repeat(self.parts != HELD_OUT, self.lengths)
        words = np.bincount(self.tokens[learned], minlength=len(self.word_keys))
        words[START] = int((self.parts != HELD_OUT).sum())
        return words, np.bincount(self.pair[learned], minlength=len(self.pair_keys))

    def answered(self, answers: dict[int, tuple], which: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all words and pairs from the buckets' answers; ``which`` 0: all training rows, 1: the retained."""
        words, pairs = np.zeros(len(self.word_keys), np.int64), np.zeros(len(self.pair_keys), np.int64)
        for b, answer in answers.items():
            words[self.word_order[self.word_edges[b] : self.word_edges[b + 1]]] = answer[which][0]
            pairs[self.pair_order[self.pair_edges[b] : self.pair_edges[b + 1]]] = answer[which][1]
        return words, pairs


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the counts."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _packed_keys(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, equal bytes together."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unpacked_keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _rows(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[type(f.dataType)]) for c, f in zip(columns, schema)], names=schema.names)


_BLOCKS = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("learned", T.LongType()), T.StructField("retained", T.LongType()), T.StructField("payload", T.BinaryType())]
)
_REQUESTS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("payload", T.BinaryType())])
_ANSWERS = T.StructType([*_REQUESTS, T.StructField("words", T.LongType())])
_BINS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("band", "pair_bin", "word_bin")] + [T.StructField("n", T.LongType())])


def _tokenise(block_bytes: int):
    """Tokenised blocks; the deleted part's documents have blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first, done = TaskContext.get().partitionId() << 32, 0
        open_blocks = {False: _Block(), True: _Block()}

        def closed(deleted: bool) -> pa.RecordBatch:
            nonlocal done
            block, open_blocks[deleted] = open_blocks[deleted], _Block()
            n = sum(len(t) for t, p in zip(block.tokens, block.parts) if p != HELD_OUT)
            done += 1
            return _rows(_BLOCKS, [(first + done, deleted, n, 0 if deleted else n, block.packed())])

        for batch in slices(batches, 1):
            for key, text, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                deleted = part == DELETED
                open_blocks[deleted].add(key, text, part)
                if open_blocks[deleted].size >= block_bytes:
                    yield closed(deleted)
        for deleted in (False, True):
            if open_blocks[deleted].ids:
                yield closed(deleted)

    return run


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for block, deleted, payload in zip(*(c.to_pylist() for c in batch.columns)):
                c = _Counts(payload, buckets)
                words, pairs = c.training()
                rows = []
                for b in range(buckets):
                    w, p = c.word_order[c.word_edges[b] : c.word_edges[b + 1]], c.pair_order[c.pair_edges[b] : c.pair_edges[b + 1]]
                    if len(w) or len(p):
                        asked = (_packed_keys(c.word_keys[w]), _small(words[w]), _packed_keys(c.pair_keys[p]), _small(pairs[p]))
                        rows.append((b, block, deleted, _packed(*asked)))
                yield _rows(_REQUESTS, rows)

    return run


def _answer(requests: pa.Table) -> pa.Table:
    """One bucket's counts: to each request those of its keys, over all rows and over the retained."""
    asked = [_unpacked(x) for x in requests.column("payload").to_pylist()]
    deleted = requests.column("deleted").to_pylist()
    out: list[list] = [[] for _ in asked]
    distinct = 0
    for kind in (0, 2):
        keys = [_unpacked_keys(a[kind]) for a in asked]
        sizes = [len(k) for k in keys]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([a[kind + 1].astype(np.int64) for a in asked])
        kept = np.repeat(~np.array(deleted, bool), sizes)
        total = np.bincount(at, weights=counts, minlength=len(known)).astype(np.int64)
        retained = np.bincount(at[kept], weights=counts[kept], minlength=len(known)).astype(np.int64)
        if kind == 0:
            distinct = int(((total > 0) & (known != np.uint64(_START_KEY))).sum())
        edges = np.cumsum([0, *sizes])
        for i, d in enumerate(deleted):
            mine = at[edges[i] : edges[i + 1]]
            out[i].append((_small(total[mine]), _small(retained[mine]) if d else None))
    rows = []
    for i, (block, d) in enumerate(zip(requests.column("block").to_pylist(), deleted)):
        (w, wr), (p, pr) = out[i]
        rows.append((requests.column("bucket")[i].as_py(), block, d, _packed((w, p), (wr, pr)), distinct if i == 0 else 0))
    return pa.Table.from_batches([_rows(_ANSWERS, rows)])


def _joined(table: pa.Table, buckets: int, which: int) -> tuple[_Counts, np.ndarray, np.ndarray]:
    """A block and its counts, from the block's row (bucket null) and its answers."""
    answers, block = {}, None
    for b, payload in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()):
        if b is None:
            block = _Counts(payload, buckets)
        else:
            answers[b] = _unpacked(payload)
    return block, *block.answered(answers, which)


def band(context: np.ndarray) -> np.ndarray:
    """The context frequency's bit length: 0 for a context never seen."""
    return np.frexp(context.astype(np.float64))[1] * (context > 0)


def _bins(p: np.ndarray, floor: float) -> np.ndarray:
    """0 where p is 0, else 1 plus its fine binary order above ``floor``."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = np.clip(1 + np.rint(FINE * np.log2(p[some] / floor)), 1, TOP)
    return out


def learn_weights(rows: list[tuple[int, int, int, int]], rounds: int) -> dict[int, tuple[float, float, float]]:
    """Weights (pair, word, uniform) of each band by expectation-maximisation over binned held-out counts."""
    out = {}
    if not rows:
        return out
    data = np.array(rows, np.int64)
    value = np.r_[0.0, 2.0 ** (np.arange(TOP) / FINE)]  # a probability over the uniform one
    for b in np.unique(data[:, 0]).tolist():
        mine = data[data[:, 0] == b]
        p = np.stack([value[mine[:, 1]], value[mine[:, 2]], np.ones(len(mine))])
        n = mine[:, 3].astype(np.float64)
        w = np.array(DEFAULT_WEIGHTS if b else (0.0, 0.8, 0.2))
        for _ in range(rounds):
            shares = w[:, None] * p
            w = (shares / shares.sum(axis=0) * n).sum(axis=1) / n.sum()
        w = np.maximum(w, [0.0 if not b else LEAST_WEIGHT, LEAST_WEIGHT, LEAST_WEIGHT])
        out[b] = tuple((w / w.sum()).tolist())
    return out


def band_weights(learned: dict[int, tuple[float, float, float]], bands: int = 64) -> np.ndarray:
    """(bands, 3); a band without held-out counts has the weights of the nearest below that has some."""
    out = np.empty((bands, 3))
    out[0] = learned.get(0, (0.0, 0.8, 0.2))
    now = DEFAULT_WEIGHTS
    for b in range(1, bands):
        now = out[b] = learned.get(b, now)
    return out


def score(
    docs: DataFrame, spec: InterpolationSpec = InterpolationSpec(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``base_score`` is the add-one unigram log10 probability, ``score`` that of the
    interpolated model.  A null text is empty: its end token alone.  A null id counts
    as empty text in the split.  Repeated rows are counted and scored each.  Without any
    training row all counts are zero and ``score`` is that of the uniform part.
    """
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    fold = crc_bucket(docs[id_col], spec.folds)
    part = F.when(fold == spec.held_out, HELD_OUT).when(fold == spec.deleted, DELETED).otherwise(RETAINED)
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    buckets = max(1, min(-(-size // spec.bucket_bytes), spec.most_buckets))
    block_bytes = max(spec.block_bytes, size // spec.most_buckets)

    blocks = checkpointed(docs.select(docs[id_col].alias("__id"), text_bytes(docs, text_col).alias("__text"), part.alias("__part")).mapInArrow(tidied(_tokenise(block_bytes)), _BLOCKS), packed=True)
    learned, retained = (x or 0 for x in blocks.agg(F.sum("learned"), F.sum("retained")).first())
    requests = blocks.select("block", "deleted", "payload").mapInArrow(tidied(_ask(buckets)), _REQUESTS)
    answers = checkpointed(requests.groupBy("bucket").applyInArrow(tidied(_answer), _ANSWERS), packed=True)
    words = answers.agg(F.sum("words")).first()[0] or 0
    uniform = 1.0 / (words + 1)
    joined = blocks.select("block", "deleted", F.lit(None).cast("int").alias("bucket"), "payload").unionByName(answers.select("block", "deleted", "bucket", "payload"))

    def bins(table: pa.Table) -> pa.Table:
        c, word, pair = _joined(table, buckets, 1)
        context = word[c.before]
        p2 = pair[c.pair] / np.maximum(context, 1)
        p1 = word[c.tokens] / max(retained, 1)
        key = (band(context).astype(np.int64) << 16) | (_bins(p2, uniform) << 8) | _bins(p1, uniform)
        found, n = np.unique(key, return_counts=True)
        return pa.Table.from_batches([_rows(_BINS, list(zip((found >> 16).tolist(), (found >> 8 & 255).tolist(), (found & 255).tolist(), n.tolist())))])

    # at most 64 * 256 * 256 rows come to the driver, whatever the input
    binned = joined.where("deleted").groupBy("block").applyInArrow(tidied(bins), _BINS).groupBy("band", "pair_bin", "word_bin").agg(F.sum("n")).collect()
    weights = band_weights(learn_weights([tuple(r) for r in binned], spec.rounds))

    names = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([id_field] + [T.StructField(n, t) for n, t in names])
    id_kind = pa.schema(docs.select(id_col).limit(0).toArrow().schema).field(0).type

    def scored(table: pa.Table) -> pa.Table:
        c, word, pair = _joined(table, buckets, 0)
        starts = c.ends - c.lengths
        count, context = word[c.tokens], word[c.before]
        base = np.log10((count + 1) / (learned + words + 1))
        w = weights[band(context)]
        p = w[:, 0] * (pair[c.pair] / np.maximum(context, 1)) + w[:, 1] * (count / max(learned, 1)) + w[:, 2] * uniform
        total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has a token
        columns = [c.parts == HELD_OUT, c.lengths, total((count > 0).astype(np.int64)), np.full(len(starts), learned), total(base), total(np.log10(p))]
        return pa.table([pa.array(c.ids, id_kind), *map(pa.array, columns)], names=schema.names)

    return joined.select("block", "bucket", "payload").groupBy("block").applyInArrow(tidied(scored), schema)
