import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpus import WORDS, awkward, documents
from ledgerlens.llm import toxicity

RUDE = ["zork", "blarg", "gnash"]


def rows_and_labels(spark, n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_search_is_exact():
    rng = np.random.default_rng(0)
    terms = {f"t{i}": i for i in range(40)}
    rows = [(i, int(i % 3 == 0), {int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(1, 6), replace=False)}) for i in range(700)]
    model = toxicity._build(rows, terms, rng.uniform(1, 5, 40), 10)
    index = model.index
    for _ in range(60):
        t = np.sort(rng.choice(40, 4, replace=False))
        q = rng.uniform(0.1, 1, 4)
        q /= np.linalg.norm(q)
        sims = np.round(q @ index.weights[t], 9)[:700]
        expected = [r for r in np.lexsort((np.arange(700), -sims))[:10] if sims[r] > 0]
        got, s = index.nearest(t, q, 10)
        assert got.tolist() == expected
        assert np.allclose(s, sims[expected])


def test_search_with_common_terms_and_many_blocks_is_exact():
    """Dense rows, blocks that stay closed and an example left out give what all similarities give."""
    rng = np.random.default_rng(1)
    terms = {f"t{i}": i for i in range(900)}
    rows = [(i, i % 2, {int(t): int(rng.integers(1, 4)) for t in {*rng.choice(8, 3), *(8 + i // 4 % 800 + rng.integers(0, 3, 4))}}) for i in range(1900)]
    index = toxicity._build(rows, terms, rng.uniform(1, 5, 900), 10).index
    assert index.weights.dense.shape[0] and len(set(index.weights.entry_block)) > toxicity.FIRST_BLOCKS
    vectors = [index.vector({f"t{t}": int(n) for t, n in rows[i][2].items()})[:2] for i in range(0, 1900, 19)] + [index.vector({"none": 1})[:2]]
    without = [index.ids.index(i) for i in range(0, 1900, 19)] + [-1]
    for (t, q), row, (got, s) in zip(vectors, without, index.nearest_all(vectors, 10, without)):
        sims = np.round(q @ index.weights[t], 9) if len(t) else np.zeros(1900)
        sims[row] = 0 if row >= 0 else sims[row]
        expected = [r for r in np.lexsort((np.arange(1900), -sims))[:10] if sims[r] > 0]
        assert np.allclose(s, sims[expected])
        assert len(t) == 0 or row not in got


def test_words_of_ascii_texts_are_those_of_the_expression():
    every = "".join(map(chr, range(128)))
    for text in (every, every[::-1], "A_b-c'd\x1ce\x85f".encode("ascii", "ignore").decode(), "x\ny\tz", "ÉTÉ " + every, "", None):
        assert toxicity.words_of(text) == toxicity._WORDS((text or "").lower())


def test_words_of_other_texts_are_those_of_the_expression():
    rng = random.Random(3)
    every = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000]
    some = [" ", "_", "\n", "a", "Z", "9", "\u0301", "\u2019", "\u00e9", "\u0130", "\u03a3", "\u4e2d", "\u00a0", "\u2003", "\U0001f600"]
    texts = ["".join(every), "".join(every[::-1]), "\u00e9\ud800 x"] + ["".join(rng.choices(some, k=30)) for _ in range(300)]
    for _ in range(2):  # the second time all characters are known
        for text in texts:
            assert toxicity.words_of(text) == toxicity._WORDS(text.lower())


def test_no_text_is_searched_by_the_expression_as_a_whole(monkeypatch):
    asked = []
    monkeypatch.setattr(toxicity, "_WORDS", lambda t: asked.append(t) or [t] * t.isalnum())
    monkeypatch.setattr(toxicity, "_WORD_CHARS", set(), raising=False)
    assert toxicity.words_of("caf\u00e9 \u2013 ol\u00e9, x " * 50) == ["caf\u00e9", "ol\u00e9", "x"] * 50
    assert sorted(asked) == ["\u00e9", "\u2013"]


def test_words_are_looked_up_once_and_middling_ones_are_dense():
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, {int(t): 1 for t in {i % 10, *rng.choice(np.arange(10, 60), 3)}}) for i in range(400)]
    model = toxicity._build(rows, {f"t{i}": i for i in range(60)}, rng.uniform(1, 5, 60), 10)
    model.telling_words = np.array([3, 10, 41])
    texts = [({"t3": 2, "t11": 1, "t41": 1, "none": 1}, -1), ({"t12": 1}, -1), ({}, -1)]
    some = {w: texts[0][0][w] for w in ("t3", "t41")}
    by, sims = model.telling.nearest(*model.telling.vector(some)[:2], 10)
    assert (model.index.weights.dense_row[:10] >= 0).all()  # held by one example in ten
    model.telling.terms = None
    features = [r[4] for r in model.votes(texts)]
    assert features[0] == [1.0, 1.0, toxicity.log_odds(sims @ model.telling.toxic[by], sims.sum()), np.log1p(3)]
    assert features[1:] == [[1.0, 0.0, 0.0, 0.0]] * 2


def test_bound_of_the_kth_best():
    rng = np.random.default_rng(4)
    for n in (0, 3, 10, 31, 320, 700, 1900):
        for k in (1, 10, 25):
            for sims in (rng.normal(size=n), np.maximum(rng.normal(size=n).round(1), 0), np.zeros(n)):
                best = max(np.sort(sims)[n - k], 0.0) if n >= k else 0.0
                got = toxicity._kth(sims, k)
                assert got == best if n < 32 * k else 0 <= got <= best
                assert np.count_nonzero(sims >= got) < 8 * k or n < 32 * k or not got or len(set(sims)) < n


def test_held_out_accuracy_and_evidence(spark):
    rows, labels = rows_and_labels(spark)
    docs = documents(spark, rows)
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    assert set(RUDE) <= set(model.index.terms)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "toxicity_score", "toxicity_evidence"]
    found = out.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(found) > 50
    assert all((r.toxicity_score >= 0.5) == (r.toxic == 1) for r in found)
    for r in found:
        assert 0 <= r.toxicity_score <= 1 and len(r.toxicity_evidence) <= 25
        sims = [e.similarity for e in r.toxicity_evidence]
        assert sims == sorted(sims, reverse=True)


def test_awkward_texts_and_filtering(spark):
    rows, labels = rows_and_labels(spark)
    extra = [(1000 + i, t) for i, t in enumerate(awkward())] + [(None, "zork blarg gnash"), (7, rows[7][1])]
    docs = documents(spark, rows + extra)
    model = toxicity.fit(docs, labels)
    stay = toxicity.remove_toxic(docs, model)
    assert stay.columns == docs.columns
    ids = [r.doc_id for r in stay.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted([i for i in range(600) if i % 4] + [7] + [1000 + i for i in range(len(awkward()))])
    assert None not in ids
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs = documents(spark, [(1, "zork"), (2, None)])
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r.toxicity_score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def test_cosine_over_all_words_of_every_text(spark):
    """Neighbours and similarities equal a plain cosine over all words, also those that no example holds."""
    rows, labels = rows_and_labels(spark, 200)
    rows += [(1000, rows[1][1] + " unseen unseen other7"), (1001, "unseen other8"), (1001, "unseen other8")]
    docs = documents(spark, rows)
    seen = labels.filter("doc_id < 120")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, seen)).collect()}
    tf = [Counter(t.split()) for _, t in rows]
    df = Counter(w for c in tf for w in c)
    raw = [{w: (1 + np.log(n)) * (np.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in c.items()} for c in tf]
    unit = [{w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in raw]
    for (i, _), v in zip(rows, unit):
        sims = {j: sum(x * unit[j].get(w, 0.0) for w, x in v.items()) for j in range(120)}
        expected = sorted((s for s in sims.values() if s > 0), reverse=True)[:25]
        assert np.allclose([e.similarity for e in out[i].toxicity_evidence], expected, atol=1e-8)
        assert all(abs(sims[e.example] - e.similarity) < 1e-8 for e in out[i].toxicity_evidence)
    assert out[1001].toxicity_evidence == [] and len(out[1000].toxicity_evidence) == 25
