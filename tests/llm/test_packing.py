import random
import struct
import zlib

import public_tokenizers as public
from tokenizers import Tokenizer

from corpus import documents, mixed
from ledgerlens.llm import packing

TOKENIZER = public.path("byte_bpe_50k.json")


def test_best_fit_against_plain_search():
    rng = random.Random(2)
    for window in (1, 7, 64, 2048):
        lengths = sorted((rng.randint(1, window) for _ in range(400)), reverse=True)
        number, offset = packing.best_fit(lengths, window)
        room: list[int] = []
        for need, n, o in zip(lengths, number, offset):
            fits = [r for r in room if r >= need]
            if fits:
                assert window - o == min(fits)  # the tightest open window
                room[n] -= need
            else:
                assert n == len(room) and o == 0
                room.append(window - need)
        assert min(room) >= 0


def test_pieces_cover_every_document(spark):
    rows = [(n, t) for n, (_, t) in enumerate(mixed(spark))]
    tok = Tokenizer.from_file(TOKENIZER)
    packed = packing.pack(documents(spark, rows), TOKENIZER, window=128, with_ids=True)
    out = packed.toPandas()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in out[out.id == i].sort_values("start").itertuples():
            part = ids[at:at + p.length]
            assert (p.start, p.doc_tokens, list(p.ids)) == (at, len(ids), part)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).tolist()
        assert g.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 128
    made = packing.sequences(packed)
    assert made.count() == out.sequence_id.nunique()
    assert all(len(r.ids) <= 128 for r in made.collect())


def test_special_strings_repeated_ids_and_empty_tables(spark):
    texts = ["a <|endoftext|> b", "Hello<|endoftext|> world", "<|endoftext|>", " <|endoftext|><|endoftext|>  x <|endoftext|", "one two <|endoftext|>\n y"]
    tok = Tokenizer.from_file(TOKENIZER)
    whole = [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert 50256 in whole[0]
    out = packing.pack(documents(spark, list(enumerate(texts))), TOKENIZER, with_ids=True).toPandas()
    assert [list(out.ids[out.id == i].iloc[0]) for i in range(len(texts))] == whole
    df = documents(spark, [(1, texts[0]), (1, texts[0]), (None, None)], extra=["pos", "grp"])
    out = packing.pack(df, TOKENIZER).toPandas()
    n = len(whole[0])
    assert sorted(out.length) == [1, n, n] and out.sequence_id.nunique() == 1
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0
