"""Packing and piece encoding against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basinforge.llm import packing, piece_bpe
from basinforge.llm.queries import vocabulary
from basinforge.llm.textcols import Recent

STRANGE = ["", " ", "  ", "   a", "    ", "a    b     c ", "▁x▁▁y", "日本語 漢字", "x" * 200, " " * 100 + "z", "\n\n\n  \t a", "éèê ñ", "😀👍🏽 ok", "\x00a", "1234567890 " * 5, "<s></s><unk><0x0A>", "it's 's 're\n 's", "<|endoftext|> x", "a \nb\n c\t d"]


def texts():
    rng = random.Random(3)
    return STRANGE + ["".join(rng.choice("ab the in er▁ \n$#éñ語0x<>.,ou'") for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def test_pieces_are_the_library_s():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.Encoder(path)
    packed, decimals = ours.documents(pa.array(texts(), pa.large_string()), decimal=True)
    for t, ids, decimal in zip(texts(), packed, decimals):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_eos=True), t
        assert bytes(decimal).decode().split() == list(map(str, library.encode(t, add_eos=True)))
        assert ours.encode(t, end=False) == library.encode(t)
    assert ours.decode(ours.encode("A  b é")) == "A  b é"


def test_backtracking_marks_failed_positions():
    model = piece_bpe.PieceModel(vocabulary("piece_bpe_32k.model"))
    for word in ("▁the", "▁unbelievably", "▁aaaaaaaaaaaaaaaaaaaa", "▁xqzxqzxqz"):
        assert model.pieces(word) == model.merge(word)


def test_encoded_documents(odd_docs, no_docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = piece_bpe.encode_documents(odd_docs, path, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    source = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    for r, s in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.ids_sha256)), sorted(((s.doc_id, library.encode(s.text or "", add_eos=True)) for s in source), key=lambda x: (str(x[0]), hashlib.sha256(" ".join(map(str, x[1])).encode()).hexdigest()))):
        assert r.ids == s[1] and r.n_tokens == len(s[1]) and r.decoded == library.decode(s[1])
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert piece_bpe.encode_documents(no_docs, path).count() == 0


def test_words_give_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), packing.WordIds(path)
    for t, ids in zip(texts(), ours.documents(pa.array(texts(), pa.large_string()))):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    again = ours.documents(pa.array(["", *texts()], pa.large_string()).slice(1))  # from the store, and from a slice of an array
    assert again == ours.documents(pa.array(texts(), pa.large_string()))


def test_runs_of_white_space():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(5)
    parts = ["a", "Bc", " ", " ", "\n", "\n", "\t", "\r", "\u00a0", "\u3000", "\x0b", "\x1c", "\x85", ".", ",", "'s", "1", "\u0301", "<|"]
    runs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", "  ", " \n", "\n\n"]) for _ in range(4000)]
    library, ours = Tokenizer.from_file(path), packing.WordIds(path)
    for t, ids in zip(runs, ours.documents(pa.array(runs, pa.large_string()))):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_store_keeps_what_is_asked_for():
    store = Recent(3, longest=4)
    store.keep(["a", "b", "long one"], [1, 2, 3])
    assert store.get_all(["a", "b", "long one"]) == [1, 2, None]
    store.keep(["c"], [3])
    store.keep(["a", "d", "e"], [1, 4, 5])  # b, not asked for again, goes with its generation
    assert store.get_all(["a", "b", "d"]) == [1, None, 4]


@pytest.mark.parametrize("seed", range(5))
def test_groups_have_no_padding(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 3000, rng.integers(1, 60))
    pieces = packing.pack_group(lengths, 1024)
    at, sizes = {}, {}
    for doc, start, n, seq, offset in pieces:
        at.setdefault(doc, []).append((start, n))
        sizes.setdefault(seq, []).append((offset, n))
    for doc, parts in at.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist()
        assert sum(n for _, n in parts) == lengths[doc]
    assert len(at) == len(lengths)
    for parts in sizes.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total == 1024 or total & (total - 1) == 0


def test_costs_are_balanced():
    lengths = np.array([900, 800, 124, 224, 300, 300, 424] * 8)
    cost, load = {}, lambda n: n + n * n / 1024
    for _, _, n, seq, _ in packing.pack_group(lengths, 1024):
        cost[seq] = cost.get(seq, 0) + load(n)
    full = sorted(cost.values())[1:]
    assert max(full) < 1.6 * min(full)


def test_packed_documents(odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(odd_docs, packing.PackingSpec(path)).collect()
    source = odd_docs.select("doc_id", "text").collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(s.text or "", add_special_tokens=False).ids) + 1 for s in source)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    long = sorted((r.start, r.ids) for r in rows if r.doc_id == 8)
    text = next(s.text for s in source if s.doc_id == 8)
    assert np.frombuffer(b"".join(x for _, x in long), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    assert packing.pack(no_docs, packing.PackingSpec(path)).count() == 0
