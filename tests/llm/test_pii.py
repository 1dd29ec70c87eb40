"""Base spans against the plain patterns, and what the field adds."""

import hashlib
import random
import re

from basinforge.llm import pii_crf as crf

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            luhn = sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
            if (True, all(int(p or 0) <= 255 for p in m.group().split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_against_plain_patterns():
    rng = random.Random(5)
    for _ in range(8000):
        text = "".join(rng.choice("aB1.2-+3 @%45(0)9é_") for _ in range(rng.randint(1, 45)))
        assert crf.base_spans(text) == plain_spans(text)
    known = "mail a.b@c.de, ip 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111, call +1 (389) 555-5010."
    assert [crf.KINDS[k] for *_, k in crf.base_spans(known)] == ["email", "ip", "card", "phone"]


def field():
    rng = random.Random(3)
    graphs = []
    for _ in range(150):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        text = f"call {phone} or order {rng.randint(10**9, 10**10)} at a{rng.randint(0, 99)}@ex.com from 10.0.{rng.randint(0, 255)}.1 card 4111 1111 1111 1111 or {rng.randint(10**15, 10**16)}"
        base = crf.base_spans(text)
        graphs.append(crf.graph(text, base, crf.candidates(text, base), learning=True))
    return crf.learn(graphs, crf.FieldSpec())


def test_the_field_spreads_labels_over_mentions():
    f = field()
    cases = {
        "call +1 (389) 555-5010 now " + "word " * 200 + "or 389 555 5010 later": ["389 555 5010"],
        "card 4111 1111 1111 1111 and 4111 1111 1111 1112": ["4111 1111 1111 1112"],
        "joe@ex.com " + "x " * 300 + "joe(at)ex.com": ["joe(at)ex.com"],
        "order 5551234567 and 1234567 in 1 2 3 4 5 6 7 8 9": [],
        "no data here": [],
        "a +1 (389) 555-5010 4111111111111111 b": ["+1 (389) 555-5010", "4111111111111111"],  # as one number both patterns fail
        "4111111111111111 4000000000000002 x": ["4111111111111111", "4000000000000002"],
        "password=135299847ac0e0f0dc token 0641917ea4": [],
    }
    for text, want in cases.items():
        base, spans = crf.find(text, f)
        assert set(base) <= set(spans)
        assert [text[s:e] for s, e, k in spans if (s, e, k) not in base] == want


def test_loopy_marginals_on_a_tree_are_exact():
    import itertools

    import numpy as np

    f = field()
    text = "1 (389) 555-5010 xx 389 555 5011 yy 10.1.2"
    g = crf.graph(text, [], crf.candidates(text, []))
    n, k = len(g.labels), len(crf.KINDS) + 1
    pairs = [(p, f.chain) for p in g.chain] + [(p, f.skip) for p in g.skip]
    assert n == 3
    tree = crf.Graph(g.spans, g.labels, g.features, g.chain[:2], [])
    pairs = [(p, f.chain) for p in tree.chain]
    unary, want = g.features @ np.array(f.unary).T, np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(x for (a, b), x in pairs if labels[a] == labels[b]))
        for i, y in enumerate(labels):
            want[i, y] += w
    assert np.allclose(crf.marginals(tree, f, rounds=200, damping=0.3), want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1(" * 50_000, "a@" * 50_000, "1 " * 100_000):
        base = crf.base_spans(text)
        crf.candidates(text, base)


def test_redaction():
    text = "a +1 (389) 555-5010 b x@y.zz"
    assert crf.redact(text, crf.base_spans(text)) == "a <phone> b <email>"


def test_odd_documents(odd_docs, no_docs):
    out = crf.find_documents(odd_docs, crf.fit(odd_docs))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and {r.n_email for r in rows} == {0}
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert {r.redacted for r in rows if r.doc_id == 4} == {None}
    assert crf.find_documents(no_docs, crf.fit(no_docs)).count() == 0


def test_skip_edges_join_all_alike_forms():
    rng = random.Random(11)
    texts = []
    for _ in range(60):  # many numbers with the same half, and slips in both halves
        digits = "41111111" + str(rng.randrange(10**8)).zfill(8)
        texts.append(digits)
        if rng.random() < 0.7:
            k = rng.randrange(16)
            texts.append(digits[:k] + str((int(digits[k]) + 1) % 10) + digits[k + 1 :])
        if rng.random() < 0.3:
            texts.append("+49 " + digits)
    rng.shuffle(texts)
    forms = [crf.form_of(t) for t in texts]
    base = [rng.random() < 0.5 for _ in texts]
    joined = {(min(forms[a], forms[b]), max(forms[a], forms[b])) for a, b in crf.skip_edges(texts, base)}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(forms) for b in forms[:i] if crf.alike(a, b)}
    assert joined == want and all(crf.alike(forms[a], forms[b]) for a, b in crf.skip_edges(texts, base))


def test_a_slip_among_cards_of_one_issuer_is_joined():
    cards = ["4111 1111 1111 1111", "4111 1111 2345 6785", "4111 1111 9999 9999", "4111 1111 2345 6786"]
    assert crf.skip_edges(cards, [True, True, True, False]) == [(1, 3)]


def test_what_is_latent_is_filled_in():
    """Candidates that look and stand like held-out base spans get their label; none is taken as a sure "none"."""
    rng = random.Random(7)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [(f"x {phone()} 4111111111111111", f"4111111111111111 x {phone()}", f"x {phone()} y 7654321")[k % 3] for k in range(300)]
    spans = [(t, crf.base_spans(t)) for t in texts]
    f = crf.learn([crf.graph(t, b, crf.candidates(t, b), learning=True) for t, b in spans], crf.FieldSpec())
    added = [len(set(crf.find(t, f)[1]) - set(b)) for t, b in spans]
    assert added == [2 if k % 3 == 0 else 0 for k in range(300)]


def test_the_sample_is_bounded_and_takes_texts_of_any_length(spark):
    rows = [(k, f"a{k}@ex.com " + "word " * (30_000 if k < 3 else 3)) for k in range(40)] * 2 + [(99, None), (98, "no data")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for n in (5, 40, 1000):
        original = crf.learn
        crf.learn = lambda graphs, spec: seen.append(len(graphs)) or original(graphs, spec)
        try:
            crf.fit(docs, crf.FieldSpec(rows=n))
        finally:
            crf.learn = original
    assert seen == [5, 40, 40]
