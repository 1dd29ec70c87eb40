import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from basinforge.llm import queries, token_alignment
from oracle import TINY, database
from texts import prose

FILES = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def encode():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    shown, extra = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            shown[chr(byte)] = byte
        else:
            shown[chr(extra)], extra = byte, extra + 1

    def both(text):
        """[(id, bytes)] of A and of B."""
        ours = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        theirs = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            theirs.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return ours, theirs

    return both


def aligned(encode, text):
    """(ids of A, of B, groups, links) by two pointers, token by token."""
    a, b = encode(text) if text else ([], [])
    if b"".join(x for _, x in a) != (" " + (text or "")).encode() or b"".join(x for _, x in b) != (" " + (text or "")).encode():
        return [], [], [], []
    groups, links, i, j, end_a, end_b, start = [], [], 0, 0, len(a[0][1]), len(b[0][1]), (0, 0)
    while True:
        links.append((a[i][0], b[j][0]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            groups.append(([x for x, _ in a[start[0] : i + 1]], [x for x, _ in b[start[1] : j + 1]]))
            start = (i + 1, j + 1)
        if step_a:
            i += 1
            if i == len(a):
                break
            end_a += len(a[i][1])
        if step_b:
            j += 1
            end_b += len(b[j][1])
    return a, b, groups, links


def plainly(encode, rows):
    found = [(i, *aligned(encode, t)) for i, t in rows]
    docs = Counter(pair for *_, links in found for pair in set(links))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for i, a, b, groups, links in found:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), digest))
    return sorted(out, key=str), docs, most


def ours(docs):
    return sorted(map(tuple, token_alignment.align_documents(docs, *FILES, OUTPUTS).collect()), key=str)


def test_odd_rows(spark, encode, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert ours(odd_docs) == plainly(encode, rows)[0]


def texts():
    rng = random.Random(2)
    odd = [" ", "  two", "tail  ", "\n\n\n", "<|endoftext|> and </s> <s> <unk>", "<0x41> ▁", "a▁b", "ｆｕｌｌ ﬁ", "\U0001f600‍\U0001f600", "é  　x", "0123456789" * 9, "\x00\x01\x7f", "don't I'll", "tab\tand\r\nline"]
    return odd + [prose(rng, rng.randint(1, 120)) for _ in range(30)] + ["same", "same", "same"]


@pytest.mark.parametrize("parts", [1, 6])
def test_corpus_counts_over_slices(spark, encode, parts):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    expected, counts, most = plainly(encode, rows)
    assert ours(docs) == expected
    found = token_alignment.pair_counts(docs, *FILES).collect()
    assert {(r["a"], r["b"]): r["n_docs"] for r in found} == counts
    assert all(r["best"] == (r["n_docs"] == most[r["a"]]) for r in found)


def test_groups_column(spark, encode):
    (r,) = token_alignment.align_documents(spark.createDataFrame([(1, "Aligned tokenizers")], "doc_id long, text string"), *FILES).collect()
    _, _, groups, _ = aligned(encode, "Aligned tokenizers")
    assert r["groups"] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_a_slice_with_a_text_that_its_tokens_do_not_spell(encode):
    made = token_alignment.aligner(*FILES).slice(pa.array(["one two", "a▁b", "three"], pa.large_string()))
    assert made.good.tolist() == [True, False, True]
    assert made.counts["n_links"].tolist() == [len(aligned(encode, t)[3]) for t in ("one two", "three")]


def test_empty_table(no_docs):
    assert token_alignment.align_documents(no_docs, *FILES).count() == 0


def test_query_over_the_whole_table(spark, encode):
    rows = database(TINY).execute("SELECT doc_id, text FROM documents").fetchall()
    found = sorted(map(tuple, queries.QUERIES["op13_token_alignment"](spark, TINY).collect()), key=str)
    assert found == plainly(encode, rows)[0]
