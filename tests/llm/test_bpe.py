import gc
import hashlib
import random
import struct

import public_tokenizers as public
import pytest
import tiktoken

from corpus import documents, mixed
from ledgerlens.llm import bpe

VOCABULARY = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(VOCABULARY)
    return (bpe.Encoder(ranks, public.PATTERN),
            tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def agree(both, texts):
    ours, theirs = both
    for t, (ids, decoded) in zip(texts, ours.encode(texts), strict=True):
        expected = theirs.encode_ordinary(t)
        assert ids == struct.pack(f"<{len(expected)}I", *expected), t[:80]
        assert decoded == t.encode()


def test_random_texts(both):
    rng = random.Random(3)
    alphabet = "abcdeé ñ\n\t'!.1日 \x1c 　ABs"
    agree(both, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(800)])


def test_long_pieces(both):
    rng = random.Random(4)
    agree(both, ["ab" * 20_000, "a" * 30_000, "-" * 5_000, " " * 3_000 + "x", "".join(rng.choice("abcdefgh") for _ in range(3_000)),
                 "".join(rng.choice("ABCdef0189+/") for _ in range(20_000))])


def test_rows(spark, both):
    rows = mixed(spark)
    out = bpe.encode(documents(spark, rows), VOCABULARY, public.PATTERN, with_ids=True).collect()
    assert len(out) == len(rows)
    theirs = both[1]
    expected = sorted((i or -1, len(e := theirs.encode_ordinary(t or "")), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(),
                       hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == expected
    assert all(len(r.ids) == r.n_tokens for r in out)
    assert bpe.encode(documents(spark, rows).limit(0), VOCABULARY, public.PATTERN).count() == 0


def test_no_cycle_search_while_pieces_are_worked_out():
    encoder = bpe.Encoder(bpe.read_ranks(VOCABULARY), public.PATTERN)
    seen, work_out = [], encoder.pieces.work_out
    encoder.pieces.work_out = lambda pieces: seen.append(gc.isenabled()) or work_out(pieces)
    assert gc.isenabled() and len(list(encoder.encode(["some words, qzxv.", ""]))) == 2
    assert gc.isenabled() and seen and not any(seen)
