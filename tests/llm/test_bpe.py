from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tidemark.llm import bpe

VOCABULARY, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def both():
    with open(VOCABULARY, "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    return bpe.Codec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_as_the_library(both):
    codec, library = both
    rng = random.Random(1)
    parts = ["a", "th", "the ", "aaaa", "é", "日本", "\n", "  ", "\t", "!!", "%%%", "0", "123", "'s", "'ll", "ab" * 9, "\x1c", "​", "🙂"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 30, 200])))
        assert ids(codec.encode([text])[0]) == library.encode_ordinary(text)
        assert codec.decode(codec.encode([text])[0]) == text.encode()


def test_long_pre_tokens(both):
    codec, library = both
    for text in ("a" * 5000, "ab" * 3000, "thing" * 2000 + "x" * 999):
        assert ids(codec.encode([text])[0]) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(["xyz" * 100_000])[0]) == b"xyz" * 100_000


def test_batches_of_all_sorts(both):
    """Many pre-tokens share the queue, and what is remembered is bounded."""
    codec, library = both
    small = bpe.Codec(codec.encoder.ranks, PATTERN, remembered=50)
    rng = random.Random(8)
    for _ in range(30):
        texts = [None, ""] + ["".join(rng.choice("aabcé th日!0\n") for _ in range(rng.randrange(60))) for _ in range(20)]
        for c in (codec, small):
            assert [ids(x) for x in c.encode(texts)] == [library.encode_ordinary(t or "") for t in texts]


def test_order_inside_a_pre_token():
    """Merges that make pairs of lower ranks, and overlapping pairs, against the plain rule."""
    rng = random.Random(3)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        parts = ["a", "b", "c"]
        for _ in range(rng.randrange(4, 25)):
            joined = rng.choice(parts) + rng.choice(parts)
            parts.append(joined)
            tokens.add(joined.encode())
        shuffled = sorted(tokens)
        rng.shuffle(shuffled)
        ranks = {t: i for i, t in enumerate(shuffled)}
        encoder = bpe.Encoder(ranks)
        pieces = ["".join(rng.choice("abc" if rng.random() < 0.7 else "a") for _ in range(rng.randrange(1, 30))).encode() for _ in range(20)]
        out, offsets = encoder.encode(pieces)
        for piece, a, b in zip(pieces, offsets[:-1], offsets[1:]):
            assert out[a:b].tolist() == plain(piece, ranks)


def plain(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_query(spark, sf_dir, both):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op8_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = np.array(both[1].encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(expected.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "a a", "x"), (2, " \n", "x"), (2, " \n", "x"), (3, "é" * 9000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(frame, VOCABULARY, PATTERN), VOCABULARY, PATTERN).collect()
    assert sorted((bytes(r.decoded) for r in out)) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(frame.limit(0), VOCABULARY, PATTERN).collect() == []
