import random
import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from corpus import documents, mixed
from ledgerlens.llm import quality


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    rng = random.Random(1)
    rows = mixed(spark) + [(500 + i, "".join(rng.choice(["a ", "b ", "c\n", "## ", "\t", "a b c d e f ", "x|y\n", "x|y\n"]) for _ in range(60)))
                           for i in range(60)]
    out = quality.counted(documents(spark, rows), "text").collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), (r.text or "")[:60]


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 40, 0.1), (12, 900, 0.02), (0, 0, 0.02), (5, 5, 0.3)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert abs(got - sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_cutoffs_are_safe_and_strict_per_stratum(spark):
    """Clean text keeps its place; a stratum with few labels gets no cutoff."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, marks = [], []
    for i in range(3000):
        words = [word() for _ in range(30)]
        good = i % 3 > 0
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i < 2900 else "xx"))
        marks.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = quality.judge(df, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    en, few = out[out.stratum == "en"], out[out.stratum == "xx"]
    assert en[en.quality == 1].kept.mean() >= 1 - quality.ALPHA
    assert not en[en.quality == 0].kept.any()
    assert few.kept.all()


def test_base_rules_nulls_and_empty_tables(spark):
    rows = mixed(spark)
    df = documents(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(df, none).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert quality.judge(df.limit(0), none).count() == 0
    plan = quality.judge(df, none)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
