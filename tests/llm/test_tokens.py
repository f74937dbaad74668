"""Encoding, decoding and packing against the public libraries."""

import base64
import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from gridlark.llm import bpe, packing  # noqa: E402

from .conftest import ROWS  # noqa: E402

BYTES, WORDS = public.path("byte_bpe_multi_50k.tiktoken"), public.path("word_bpe_49k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "a", "B", "É", "1", "²", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "!", "?", ".", ",", "***", "世", "😀", "\x00", "́", "x'", "'S", "<|endoftext|>", "ß", "İ", "ing"]


def random_texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(n)] + ["", "a" * 700 + "é" * 300, " " * 500]


def test_encode_like_tiktoken_and_back():
    vocabulary = bpe.vocabulary(BYTES)
    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = random_texts(4000)
    packed = vocabulary.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == [library.encode_ordinary(t) for t in texts]
    assert vocabulary.decode(packed) == [t.encode() for t in texts]


def test_encode_rows(docs, no_docs):
    rows = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in rows) == sorted((str(k), t or "") for k, t, _ in ROWS)
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)
    assert bpe.encode(no_docs, BYTES).count() == 0


def test_word_tokens_like_the_library():
    own = packing.WordTokens(WORDS)
    texts = random_texts(4000, 2)
    library = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_plan_places_all_pieces_without_gaps(capacity):
    draw = random.Random(capacity)
    counts = {}
    for _ in range(5000):
        n = min(capacity, 1 + int(draw.expovariate(3 / capacity)))
        counts[n] = counts.get(n, 0) + 1
    bins, seen = {}, {}
    for length, first, end, number, each, at in packing.plan(counts, capacity):
        for r in range(first, end):
            bins.setdefault(number + (r - first) // each, []).append((at + (r - first) % each * length, length))
            seen[length] = seen.get(length, 0) + 1
    assert seen == counts
    for pieces in bins.values():
        place = 0
        for at, length in sorted(pieces):
            assert at == place
            place += length
        assert place <= capacity
    total = sum(n * c for n, c in counts.items())
    assert len(bins) <= -(-total // capacity) * 1.02 + 1


def test_pack_rows(docs, no_docs):
    tokenizer = tokenizers.Tokenizer.from_file(WORDS)
    rows = packing.pack(docs, WORDS, capacity=100, keep_ids=True).collect()
    expected = []
    for k, t, _ in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(str(k), i, at, len(ids[at : at + 100]), zlib.crc32(ids[at : at + 100].tobytes())) for i, at in enumerate(range(0, len(ids), 100))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    for s in {r.sequence_id for r in rows}:
        place = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 100
    assert packing.pack(no_docs, WORDS).count() == 0
