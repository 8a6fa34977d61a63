import random
import re

import numpy as np
import xxhash

from corpus import documents, mixed
from ledgerlens.llm import simhash


def brute_fp(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(fps):
    ids = list(range(len(fps)))

    def top(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                ids[max(x, y)] = min(x, y)
    return [top(x) for x in range(len(fps))]


def test_fingerprints():
    for _, t in mixed(None):
        if len(t or "") < 50_000:
            assert simhash.fingerprint(t) == brute_fp(t)


def clustered(n, seed):
    """Fingerprints in chains and dense balls around a few centres, and random ones."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(n):
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            out.append(y)
            if rng.random() < 0.3:
                x = y
    return sorted(set(out))


def test_walk_finds_the_components_of_all_pairs():
    for seed in range(4):
        keys = np.array(clustered(60, seed), dtype=np.uint64)
        lo, hi = np.array([0]), np.array([len(keys)])
        label = simhash.walk(keys, lo, hi, lo, hi, np.zeros(1, np.int64), 0, 3)
        expected = brute_components([int(k) for k in keys])
        assert label.tolist() == expected


def test_links_join_all_pairs_also_when_roots_are_split(spark):
    fps = clustered(50, 9)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = brute_components(fps)
    for limit in (50_000, 5):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, 3, limit)).collect()}
        found = [roots.get(s, s) for s in signed]
        groups = {}
        for f, e in zip(found, expected):
            assert groups.setdefault(f, e) == e
        assert len(groups) == len(set(expected))


def test_documents_against_brute_force(spark):
    rows = [(i, t) for i, t in mixed(spark) if len(t or "") < 50_000]
    out = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    by_fp = {f: least.get(c) for f, c in zip(fps, comp)}
    for r in out:
        assert r.component_id == by_fp[r.fp % (1 << 64)]


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e"), (2, "A  b c d e"), (3, "x y z w"), (3, "x y z w"), (4, None), (5, ""), (9, "other words here")]
    df = documents(spark, rows)
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 9]
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_repeated_ids_are_decided_by_row(spark):
    rows = [(3, "x y z w"), (3, "X  y z w"),                      # one id, two texts, one component: one stays
            (1, "a b c d e"), (1, "quite another text here"),      # one id in two components: both stay
            (5, "a  b c d e"), (3, "quite another text  here"),    # gone: copies of rows of id 1
            (None, "no id at all"), (None, "nothing else like it"), (7, "No id at all")]
    df = documents(spark, rows, extra=["row", "component_id"])
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    kept = sorted((-1 if r.doc_id is None else r.doc_id, simhash_words(r.text)) for r in out.collect())
    assert kept == [(-1, "nothing else like it"), (1, "a b c d e"), (1, "quite another text here"), (3, "x y z w"), (7, "no id at all")]


def simhash_words(text):
    return " ".join(text.lower().split())
