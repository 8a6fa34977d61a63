import random
import re

import numpy as np
import pytest

from corpus import documents, mixed, texts
from ledgerlens.llm import ngram_join
from ledgerlens.llm.queries import op13_ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k=5, percent=80):
    """(doc_id, n_shingles, component_id) of every row from all pairs of different sets."""
    sets = [shingles(t, k) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            r = find(s)
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"new{rng.randrange(10 ** 6)}"
        elif kind < 0.7 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"more{rng.randrange(10 ** 6)}")
    return words


def families(seed, sizes, copies, most=6):
    """Texts of many sizes with edited copies on both sides of the similarity, and of different sizes."""
    rng = random.Random(seed)
    out = []
    for size in sizes:
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
        out.append(" ".join(base))
        for _ in range(copies):
            words = edited(rng, base, rng.randint(0, most))
            words = words[:rng.randint(max(1, len(words) * 3 // 4), len(words))] if rng.random() < 0.4 else words
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


def test_query_on_awkward_rows(spark, scratch):
    rows = mixed(spark)
    documents(spark, rows).repartition(3).write.parquet(f"{scratch}/documents.parquet")
    out = op13_ngram_join(spark, scratch)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and [t for _, t in out.dtypes] == ["bigint"] * 3
    assert got(out) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_of_all_sizes(spark, seed):
    rows = families(seed, [*range(1, 40), 55, 80, 120, 300], 7)
    assert got(ngram_join.classes(documents(spark, rows))) == brute(rows)


def test_frequent_passages_and_words(spark):
    """Passages that a third of the texts hold, and texts of one repeated word, link nothing by themselves."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = [f"q{rng.randrange(10 ** 6)}" for _ in range(rng.randint(3, 90))]
        rows.append((i, " ".join(own[:len(own) // 2] + (passage if i % 3 else []) + own[len(own) // 2:])))
    rows += [(1000 + i, "again " * (i + 1)) for i in range(20)]
    rows += [(2000 + i, " ".join(passage + [f"r{rng.randrange(10 ** 6)}" for _ in range(i % 14)])) for i in range(60)]
    assert got(ngram_join.classes(documents(spark, rows, extra=()))) == brute(rows)


def test_large_group_of_near_copies(spark):
    """Copies of one text with few edits each, most of which link only through it."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(1, 8)))) for i in range(250)] + [(777, " ".join(base))]
    assert got(ngram_join.classes(documents(spark, rows))) == brute(rows)


@pytest.mark.parametrize("shingle, percent", [(1, 80), (3, 60), (5, 95)])
def test_other_parameters(spark, shingle, percent):
    rows = families(3, [2, 5, 9, 30, 70], 6) + [(500 + i, t) for i, t in enumerate(texts(40))]
    assert got(ngram_join.classes(documents(spark, rows), shingle=shingle, percent=percent)) == brute(rows, shingle, percent)


def test_empty_table(spark):
    assert got(ngram_join.classes(documents(spark, []))) == []
    assert got(ngram_join.classes(documents(spark, [(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


def meet(a, b, bar, percent=80):
    """Whether the larger token set probes a digest under which the smaller is indexed."""
    bands = ngram_join.Bands.of(max(len(a), len(b)), percent)
    tokens = np.concatenate([np.sort(a), np.sort(b)])
    sets = ngram_join.Sets(tokens, np.array([0, len(a)]), np.array([len(a), len(b)]))
    cost = np.random.default_rng(1).random(ngram_join.SLOTS)
    cost[:ngram_join.SLOTS // 3] = 1000.0  # a third of all tokens is frequent
    value, owner, role, _ = ngram_join.digests(sets, bands, cost, bar)
    large = 0 if len(a) >= len(b) else 1
    probing = {d for d, o, r in zip(value, owner, role) if o == large and r & ngram_join.PROBE}
    return any(d in probing for d, o, r in zip(value, owner, role) if o != large and r & ngram_join.INDEX)


@pytest.mark.parametrize("bar", [np.inf, 500.0, 0.5, 0.0])
def test_every_similar_pair_meets(bar):
    """The index loses no pair: at the bound itself, with cheap, mixed and only frequent tokens."""
    rng = np.random.default_rng(4)
    tried = 0
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 17, 25, 40, 80, 200, 700]:
        for _ in range(40):
            base = rng.integers(0, 2 ** 63, size, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, size, dtype=np.uint64)
            s = int(rng.integers(-(-size * 8 // 10), size + 1))
            both = (size + s - (size + s) * 20 // 180 + 1) // 2  # the fewest common tokens
            if 100 * both < 80 * (size + s - both) or both > s:
                continue
            other = np.concatenate([base[:both], rng.integers(0, 2 ** 63, s - both, dtype=np.uint64)])
            tried += 1
            assert meet(base, other, bar), (size, s, both)
    assert tried > 400


def test_tokens_are_the_distinct_shingles():
    for text in ["a a a a b b b b a a a a", "x", "A b\tC\x0bd  e f", "é É e", "to to to of of of to to to of of to of"]:
        data = np.frombuffer(text.encode(), np.uint8)
        for k in (1, 2, 5):
            sets = ngram_join.sets_of(data, np.array([0, len(data)]), k)
            assert sets.size[0] == len(shingles(text, k)) and (np.diff(sets.tokens.astype(object)) > 0).all()


def test_bitmaps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (1, 30, 255, 257, 900):
        a = np.sort(rng.integers(0, 2 ** 62, n, dtype=np.uint64))
        b = np.sort(np.concatenate([a[n // 5:], rng.integers(0, 2 ** 62, n // 9, dtype=np.uint64)]))
        maps = [np.array(ngram_join.parities(ngram_join.Sets(t, np.array([0]), np.array([len(t)]))).to_pylist()[0]) for t in (a, b)]
        short = min(map(len, maps))
        p, q = (m if len(m) == short else m[:short] ^ m[short:] for m in maps)
        assert np.bitwise_count((p ^ q).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_digests_in_pieces_are_those_of_the_whole(monkeypatch):
    # the working arrays hold VIEW_TOKENS tokens, not those of a whole chunk of texts
    rng = np.random.default_rng(5)
    raw = [" ".join(f"w{k}" for k in rng.integers(0, 300, n)).encode() for n in (0, 3, 40, 400, 41, 90, 400)]
    offsets = np.cumsum([0, *map(len, raw)])
    sets = ngram_join.sets_of(np.frombuffer(b"".join(raw), np.uint8), offsets, 5)
    bands = ngram_join.Bands.of(int(sets.size.max()), 80)
    cost = rng.integers(1, 9, ngram_join.SLOTS).astype(np.float32)
    whole = ngram_join.digests(sets, bands, cost, 6.0)
    seen, one = [], ngram_join._digests_of
    monkeypatch.setattr(ngram_join, "VIEW_TOKENS", 100)
    monkeypatch.setattr(ngram_join, "_digests_of", lambda s, v, *rest: seen.append(int(s.size[v.owner].sum())) or one(s, v, *rest))
    parts = ngram_join.digests(sets, bands, cost, 6.0)
    assert sorted(zip(*(x.tolist() for x in parts))) == sorted(zip(*(x.tolist() for x in whole)))
    assert len(seen) > 3 and max(seen) <= max(100, int(sets.size.max()))


def test_alike_sets_that_do_not_link_are_not_compared_pair_by_pair(spark, monkeypatch):
    """A group of copies with many edits of their own (0.6 to 0.8 alike) beside near ones: few candidate pairs, all links."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    far, near = 90, 40
    rows = [(i, " ".join(edited(rng, base, rng.randint(5, 9) if i < far else rng.randint(1, 2)))) for i in range(far + near)]
    rows += [(500 + i, " ".join(base[:60] + [f"x{i}"] + base[61:i % 7 + 120] + [f"y{i}"])) for i in range(30)]
    tried, found = [], ngram_join._candidates
    monkeypatch.setattr(ngram_join, "_candidates", lambda *rest: tried.append((out := found(*rest)).count()) or out)
    assert got(ngram_join.classes(documents(spark, rows, extra=()))) == brute(rows)
    assert tried[0] < 500  # of 12,720 pairs


def test_pairs_that_share_rare_tokens_only(spark):
    """Far copies of a group that link to each other by edits that two of them share."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = edited(rng, base, rng.randint(6, 9))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, rng.randint(0, 2))))]
    expected = brute(rows)
    assert len({c for _, _, c in expected}) > 20
    assert got(ngram_join.classes(documents(spark, rows, extra=()))) == expected


def test_sets_without_a_sampled_digest_are_compared_with_a_few_first(spark, monkeypatch):
    """Where the sample holds none of a group's digests, the sets still do not meet all of their group."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(1, 2)))) for i in range(60)]
    tried, found = [], ngram_join._candidates
    monkeypatch.setattr(ngram_join, "SAMPLE", 1 << 62)
    monkeypatch.setattr(ngram_join, "_candidates", lambda *rest: tried.append((out := found(*rest)).count()) or out)
    assert got(ngram_join.classes(documents(spark, rows, extra=()))) == brute(rows)
    assert tried[0] < 200  # of 1770 pairs, most of which link


def test_counted_sets_whose_bitmaps_differ_too_much_do_not_pair(spark):
    kind = "digest long, sid long, n int, label long, rare int, longs array<long>"
    sets = {1: [0] * 8, 2: [-1] + [0] * 7, 3: [7] + [0] * 7, 4: [7] + [0] * 15}
    entries = spark.createDataFrame([(9, sid, 100, sid, 0, longs) for sid, longs in sets.items()] + [(9, 5, 100, 5, None, None)], kind)
    pairs = ngram_join._candidates(entries, entries, 80)
    # 64 bits or 61 are more than the 22 tokens in which sets of 100 may differ; a longer bitmap is folded; 5 is not counted
    assert sorted(map(tuple, pairs.collect())) == [(3, 1), (4, 1), (4, 3), (5, 1), (5, 2), (5, 3), (5, 4)]
