"""Personal data by a skip-chain conditional random field.

Patterns with checks find the base spans.  Beside those stand candidates: runs
of digits, dotted numbers and address-like strings that the patterns leave
out.  Base spans and candidates are the nodes of a field over each document.
Neighbours in the text are joined as in a chain; nodes with equal or similar
text, however far apart, are joined by skip edges.  Loopy message passing
spreads a label over the mentions of one entity, so that a number written once
in full is also found where it is written without its plus sign or with a slip.
Base spans keep their label; a candidate whose best label is not "none" with a
probability over one half is added.

The field's weights (of a node's shape, of chain and of skip edges) maximise a
pseudo-likelihood over a bounded sample of documents.  Each base span is held out in turn and told from its
shape and its neighbours; beside them stand repeats of base spans in another form, which only the skip edge to
their base span gives away, and decoys, numbers like them that are none.  What the candidates are is not
known: their labels are latent, and expectation-maximisation fills them in.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinforge.llm.textcols import release, slices, text_bytes, tidied

KINDS = ("email", "ip", "card", "phone")
NONE = 0  # labels: none, then the kinds

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a number starts where a digit run starts: elsewhere the same run would fail again
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

_NUMBER = re.compile(r"(?<![0-9])\+?[0-9](?:[ ().-]{0,2}[0-9]){6,}+")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){2,}+")
_LONE = re.compile(r"(?<![0-9])[0-9]{12,}+")
_AT = re.compile(r"@|\(at\)|\[at\]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]++)*")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[Span]:
    """Spans by pattern: leftmost, not overlapping within a kind; what fails its check is dropped."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:  # a local part ends at its at sign, so the signs are looked for
        start = _local_start(text, at, last)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def _pieces(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """A run of numbers cut about each long number that stands by itself; pieces of under seven digits are left out."""
    cuts = [start]
    for m in _LONE.finditer(text, start, stop):
        if (m.start() == start or text[m.start() - 1] == " ") and (m.end() == stop or text[m.end()] == " "):
            cuts += m.span()
    for a, b in zip(cuts, [*cuts[1:], stop]):
        while a < b and text[a] in " ().-":
            a += 1
        while a < b and text[b - 1] in " ().-":
            b -= 1
        if len(_NOT_DIGITS.sub("", text[a:b])) >= 7:
            yield a, b


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Places that may hold personal data and that no base span touches; leftmost first, not overlapping."""
    found: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        found += [m.span() for m in _DOTTED.finditer(text)]
        found += [p for m in _NUMBER.finditer(text) for p in _pieces(text, *m.span())]
    last = 0
    for m in _AT.finditer(text):
        start = _local_start(text, m.start(), last)
        if start < m.start() and (host := _HOST.match(text, m.end())):
            found.append((start, host.end()))
            last = host.end()
    if not found:
        return []
    found.sort(key=lambda s: (s[0], -s[1]))
    taken = sorted((s, e) for s, e, _ in base)
    out: list[tuple[int, int]] = []
    k, end, reach = 0, 0, 0
    for start, stop in found:
        while k < len(taken) and taken[k][0] < stop:
            reach = max(reach, taken[k][1])
            k += 1
        if start >= end and start >= reach:
            out.append((start, stop))
            end = stop
    return out


N_FEATURES = 16


def shape(text: str, glued: bool = False) -> list[float]:
    """Features of a node's text, and whether it is part of a word; none of them asks whether a pattern matched."""
    digits = _NOT_DIGITS.sub("", text)
    n = len(digits)
    parts = text.split(".")
    numeric = all(p.isdigit() for p in parts)
    return [
        1.0,
        float("@" in text),
        float("(at)" in text or "[at]" in text),
        float("." in text.rpartition("@")[2]),
        float(text[0] == "+"),
        float(7 <= n <= 8),
        float(9 <= n <= 11),
        float(12 <= n <= 15),
        float(16 <= n <= 19),
        float(n > 19),
        float(12 <= n <= 19 and luhn(digits)),
        float(len(parts) == 4 and numeric),
        float(numeric and len(parts) > 2 and all(len(p) < 4 and int(p) < 256 for p in parts)),
        float("(" in text),
        float(" " in text or "-" in text),
        float(glued),
    ]


def varied(text: str, kind: int, rng: random.Random) -> str:
    """Another way to write a base span: an address spelt out, a number without its marks, a card with a slip."""
    if KINDS[kind] == "email":
        return text.replace("@", rng.choice(["(at)", "[at]"]))
    if KINDS[kind] == "phone":
        digits = _NOT_DIGITS.sub("", text)
        return digits[-10:] if rng.random() < 0.5 else " ".join(_NOT_DIGITS.sub(" ", text).split())
    if KINDS[kind] == "card":
        at = rng.choice([i for i, c in enumerate(text) if c.isdigit()])
        return text[:at] + str((int(text[at]) + rng.randint(1, 9)) % 10) + text[at + 1 :]
    return text


def decoy(text: str, kind: int, rng: random.Random) -> str:
    """Something like a base span that is none: a name without a host's dot, a version, or other digits."""
    if KINDS[kind] == "email":
        return text.rpartition("@")[0] + "@" + rng.choice(["home", "noon", "all"])
    if KINDS[kind] == "ip":
        return ".".join(str(rng.randint(0, 999)) for _ in range(rng.choice([3, 5])))
    n = rng.choice([7, 8, len(_NOT_DIGITS.sub("", text)), rng.randint(9, 20)])
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(n))
        if not (12 <= n <= 19 and luhn(digits)):
            width = rng.choice([n, n, 1, 2, 3, 4])
            return rng.choice(" -").join(digits[i : i + width] for i in range(0, n, width))


def form_of(text: str) -> str:
    """What is compared of a node's text."""
    if _AT.search(text):
        return text.lower().replace("(at)", "@").replace("[at]", "@").replace("(dot)", ".").replace("[dot]", ".")
    if "." in text and _DOTTED.fullmatch(text):
        return text
    return _NOT_DIGITS.sub("", text)


_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def likeness_keys(form: str) -> list[tuple]:
    """Keys of a form; two forms that are alike and not equal have one in common."""
    keys: list[tuple] = []
    if len(form) >= 7:  # a hash of the form without the character at each place
        power, total, parts = 1, 0, []
        for c in form:
            parts.append(ord(c) * power % _PRIME)
            total += parts[-1]
            power = power * _BASE % _PRIME
        keys = [(len(form), i, (total - x) % _PRIME) for i, x in enumerate(parts)]
    if len(form) >= 9:
        keys += [(rest,) for d in range(4) if len(rest := form[d:]) >= 9 and rest.isdigit()]
    return keys


def alike(a: str, b: str) -> bool:
    """Equal, equal but for one character, or one with a country code before the other."""
    if a == b:
        return True
    if len(a) == len(b):
        return len(a) >= 7 and sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(short) >= 9 and len(long) - len(short) <= 3 and short.isdigit() and long.endswith(short)


def alike_forms(forms: list[str]) -> set[tuple[str, str]]:
    """All pairs of distinct forms that are alike.

    Those that share a key differ in one character or by a country code, so that
    a key has few forms, except that very many numbers may end in the same one.
    """
    sharing: dict[tuple, list[str]] = defaultdict(list)
    for f in forms:
        for k in likeness_keys(f):
            sharing[k].append(f)
    out: set[tuple[str, str]] = set()
    for key, members in sharing.items():
        if len(members) > 1:
            # under an ending just the form that it is can be alike to the others by it
            heads = members if len(key) > 1 else [f for f in members if f == key[0]]
            out |= {(min(f, g), max(f, g)) for f in heads for g in members if f != g and alike(f, g)}
    return out


def skip_edges(texts: list[str], base: list[bool]) -> list[tuple[int, int]]:
    """Edges between similar nodes.

    All distinct forms that are alike are joined.  Of the nodes of one form each is joined
    with the one before and with the first base span; of two forms that are alike
    each with the last node of the other form before it and with the other form's first base span.
    """
    if len(texts) < 2:
        return []
    places: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(texts):
        places[form_of(t)].append(i)
    first = {f: next((i for i in at if base[i]), None) for f, at in places.items()}
    out: set[tuple[int, int]] = set()
    for f, at in places.items():
        out |= set(zip(at, at[1:]))
        if first[f] is not None:
            out |= {(min(first[f], i), max(first[f], i)) for i in at if i != first[f]}
    for f, g in alike_forms(list(places)) if len(places) > 1 else ():
        for mine, other, head in ((places[f], places[g], first[g]), (places[g], places[f], first[f])):
            for i in mine:
                if k := bisect_left(other, i):
                    out.add((other[k - 1], i))
                if head is not None:
                    out.add((min(head, i), max(head, i)))
    return sorted(out)


#: Code points within which two nodes that follow each other are chain neighbours.
CHAIN_REACH = 80


@dataclass(frozen=True)
class Field:
    """Weights: labels by features, and what equal labels add over chain and over skip edges."""

    unary: tuple[tuple[float, ...], ...]
    chain: float
    skip: float


@dataclass
class Graph:
    spans: list[tuple[int, int]]
    labels: np.ndarray  # 0 for candidates
    features: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    known: np.ndarray | None = None  # nodes that keep their label; those with one unless told


def graph(text: str, base: list[Span], found: list[tuple[int, int]], learning: bool = False) -> Graph:
    """The field's graph of a text; for ``learning`` with a varied repeat and a decoy of each base span behind it."""
    nodes = sorted([(s, e, k + 1) for s, e, k in base] + [(s, e, NONE) for s, e in found])
    spans = [(s, e) for s, e, _ in nodes]
    texts = [text[s:e] for s, e in spans]
    glued = [text[max(s - 1, 0) : s].isalnum() or text[e : e + 1].isalnum() for s, e in spans]
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if spans[i + 1][0] - spans[i][1] <= CHAIN_REACH]
    labels = [k for *_, k in nodes]
    known = [k != NONE for k in labels]
    marked = list(known)
    if learning:
        rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
        for s, e, k in base:
            for made, label in ((varied(text[s:e], k, rng), k + 1), (decoy(text[s:e], k, rng), NONE)):
                texts.append(made)
                labels.append(label)
                glued.append(label == NONE and rng.random() < 0.5)
        known += [True] * (len(labels) - len(known))
        marked += [False] * (len(labels) - len(marked))
    features = np.array([shape(t, g) for t, g in zip(texts, glued)]).reshape(-1, N_FEATURES)
    return Graph(spans, np.array(labels, np.int64), features, chain, skip_edges(texts, marked), np.array(known, bool))


def marginals(g: Graph, field: Field, rounds: int = 30, damping: float = 0.5) -> np.ndarray:
    """Label probabilities by loopy sum-product; base spans are held to their label."""
    n, k = len(g.labels), len(KINDS) + 1
    unary = g.features @ np.array(field.unary).T
    held = np.flatnonzero(g.labels if g.known is None else g.known)
    unary[held] = -50.0
    unary[held, g.labels[held]] = 0.0
    pairs = g.chain + g.skip
    if pairs:
        src = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
        dst = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        gain = np.expm1(np.array(([field.chain] * len(g.chain) + [field.skip] * len(g.skip)) * 2))[:, None]
        back = np.r_[np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))]
        messages = np.full((len(src), k), 1.0 / k)
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, np.log(messages))
            out = belief[src] - np.log(messages[back])
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out = out.sum(axis=1, keepdims=True) + gain * out  # equal labels weigh exp(gain)
            out /= out.sum(axis=1, keepdims=True)
            moved = np.abs(out - messages).max()
            messages = damping * messages + (1 - damping) * out
            if moved < 1e-5:
                break
        np.add.at(unary, dst, np.log(messages))
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those that the field adds."""
    base = base_spans(text)
    found = candidates(text, base)
    if not found:
        return base, base
    g = graph(text, base, found)
    p = marginals(g, field)
    best = p.argmax(axis=1)
    added = [(*g.spans[i], int(best[i]) - 1) for i in np.flatnonzero((g.labels == NONE) & (best != NONE) & (p.max(axis=1) > 0.5))]
    return base, sorted(base + added, key=lambda s: (s[0], s[2]))


@dataclass(frozen=True)
class FieldSpec:
    """``rows`` bounds the distinct texts that weights are learned from: those with the least hashes."""

    rows: int = 3000
    ridge: float = 0.05
    skip_prior: float = 4.0
    chain_prior: float = 0.0
    prior_weight: float = 20.0
    rounds: int = 150
    filled_in: int = 4


def learn(graphs: list[Graph], spec: FieldSpec) -> Field:
    """Maximises the pseudo-likelihood, given neighbours' labels, by expectation-maximisation over the latent ones.

    The first of ``filled_in`` turns learns from the known nodes alone.  The edges'
    weights have Gaussian priors about those of the spec.
    """
    k = len(KINDS) + 1
    w, edge = np.zeros((k, N_FEATURES)), np.array([spec.chain_prior, spec.skip_prior])
    w[NONE, 0] = 4.0
    field = Field(tuple(map(tuple, w.tolist())), *edge.tolist())
    graphs = [g for g in graphs if len(g.labels)]
    if not graphs:
        return field
    x = np.concatenate([g.features for g in graphs])
    starts = np.cumsum([0, *(len(g.labels) for g in graphs)])
    target = np.eye(k)[np.concatenate([g.labels for g in graphs])]
    latent = [(i, g) for i, g in zip(starts, graphs) if not g.known.all()]
    edges = [np.array([(i + a, i + b) for i, g in zip(starts, graphs) for a, b in pairs(g)], np.int64).reshape(-1, 2) for pairs in (lambda g: g.chain, lambda g: g.skip)]
    prior, n = edge.copy(), len(x)
    weight = np.concatenate([g.known for g in graphs]).astype(np.float64)[:, None]
    for turn in range(spec.filled_in):  # at first the known nodes alone
        for i, g in latent if turn else ():
            open_ = np.flatnonzero(~g.known)
            target[i + open_] = marginals(g, field)[open_]
            weight[i + open_] = 1.0
        near = np.zeros((2, n, k))
        for which, pairs in enumerate(edges):
            np.add.at(near[which], pairs[:, 0], target[pairs[:, 1]])
            np.add.at(near[which], pairs[:, 1], target[pairs[:, 0]])
        speed_w, speed_e = np.zeros_like(w), np.zeros(2)
        for _ in range(spec.rounds):  # gradient ascent with momentum
            z = x @ w.T + np.tensordot(edge, near, 1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            rest = weight * (target - p)
            speed_w = 0.9 * speed_w + (rest.T @ x - spec.ridge * w) / n
            speed_e = 0.9 * speed_e + ((near * rest).sum(axis=(1, 2)) - spec.prior_weight * (edge - prior)) / (n + spec.prior_weight)
            w, edge = w + speed_w, np.maximum(edge + speed_e, 0.0)
        field = Field(tuple(map(tuple, w.tolist())), *edge.tolist())
    return field


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        made = []
        for data in batch.column(0).to_pylist():
            text = data.decode("utf-8", "replace")
            base = base_spans(text)
            found = candidates(text, base)
            if base or found:
                made.append(pickle.dumps(graph(text, base, found, learning=True)))
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["graph"])


def fit(docs: DataFrame, spec: FieldSpec = FieldSpec(), text_col: str = "text") -> Field:
    """Learns the field from at most ``spec.rows`` distinct texts that hold a digit or an at sign, of any length.

    The texts are chosen by their hashes alone, and only their graphs leave the executors.  Nulls
    and texts without either are not learned from; an empty table gives the field of the priors.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    some = docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]|[(\\[]at[)\\]]")).withColumn("h", F.xxhash64("text"))
    last = some.select("h").distinct().orderBy("h").limit(spec.rows).agg(F.max("h")).first()[0]
    if last is None:
        return learn([], spec)
    sample = some.where(F.col("h") <= last).dropDuplicates(["h"]).select(text_bytes(some, "text").alias("text"))
    graphs = [pickle.loads(r[0]) for r in sample.mapInArrow(tidied(_graphs), "graph binary").toLocalIterator()]
    return learn(graphs, spec)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, then longest."""
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"<{KINDS[k]}>"]
        at = e
    return "".join([*out, text[at:]])


_OUTPUTS = {**{f"n_{k}": T.LongType() for k in KINDS}, "base_sha256": T.StringType(), "spans": T.StringType(), "redacted": T.StringType()}


def find_documents(
    docs: DataFrame, field: Field, outputs: tuple[str, ...] = tuple(_OUTPUTS), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The id, the columns in ``keep`` and the ``outputs`` wanted of every row.

    n_email, n_ip, n_card, n_phone and base_sha256 (of kind:start:end, in code points)
    tell of the base spans; ``spans`` of all; ``redacted`` is the text without them.
    A null text has no spans and is redacted to a null; a null id is kept; repeated rows give
    repeated results; an empty table gives no rows.
    """
    columns = [id_col, *keep]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns] + [T.StructField(o, _OUTPUTS[o]) for o in outputs])
    k = len(columns)

    def one(data: bytes | None) -> tuple:
        text = (data or b"").decode("utf-8", "replace")
        base, spans = find(text, field)
        values = {f"n_{kind}": sum(s[2] == i for s in base) for i, kind in enumerate(KINDS)}
        values |= {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)}
        values["redacted"] = None if data is None else redact(text, spans)
        return tuple(values[o] for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, k):
            known: dict[bytes | None, tuple] = {}
            rows = []
            for data in batch.column(k).to_pylist():
                if data not in known:
                    known[data] = one(data)
                rows.append(known[data])
            kinds = [pa.int64() if o.startswith("n_") else pa.string() for o in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=schema.names)

    return docs.select(*[docs[f"`{c}`"].alias(f"__k{i}") for i, c in enumerate(columns)], docs[text_col].cast("string").cast("binary").alias("__text")).mapInArrow(tidied(run), schema)
