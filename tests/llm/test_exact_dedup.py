import hashlib
import re
from collections import defaultdict

from corpus import documents, mixed
from ledgerlens.llm import exact_dedup


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_against_brute_force(spark):
    rows = mixed(spark)
    out = exact_dedup.decide(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha(t)].append(i)
    for r in out:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None)
        assert r.group_size == len(ids)
        assert not r.kept or r.doc_id == r.keep_id
    kept = [r.text_sha256 for r in out if r.kept]
    assert sorted(kept) == sorted(groups)  # one row of each group, repeated rows too


def test_one_key_with_a_third_of_all_rows_and_other_tree_shapes(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(600)]
    df = documents(spark, rows, extra=[])
    expected = None
    for run_bits, merge_bits in ((6, 3), (5, 2), (0, 3), (3, 3)):
        out = sorted(map(tuple, exact_dedup.decide(df, run_bits=run_bits, merge_bits=merge_bits).drop("pos").collect()))
        assert expected in (None, out)
        expected = out
    assert sum(r[3] for r in expected) == 601


def test_rows_that_stay_keep_all_columns(spark):
    rows = mixed(spark)
    df = documents(spark, rows)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    left = out.select("doc_id", "text").collect()
    assert sorted(sha(r.text) for r in left) == sorted({sha(t) for _, t in rows})
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    plan = exact_dedup.decide(documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
