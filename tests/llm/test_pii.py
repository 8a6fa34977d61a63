import hashlib
import random
import re

from corpus import documents, mixed
from ledgerlens.llm import pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if ((k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(digits) <= 19 and luhn(digits)))
                    or (k == 3 and not 9 <= len(digits) <= 15)):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = ["a@b.c", "_x@d.e", "1.2.3.4", "256.1.1.1", "007.1.1.255", "4785380592391139", "4111 1111 1111 1111", "+1 (743) 555-3824", "+49", "é", "日",
         "😀", " ", ".", "@", "-", "12", "+", "7", "Mr. John Smith", "123-45-6789", "(555) 123-4567", "call ", "\n", "x@y", "..a@b-c.d-",
         'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "DE89 3704 0044 0532 0130 00"]


def rows_of(n=400):
    rng = random.Random(5)
    return [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))) for i in range(n)]


def test_base_spans_against_plain_expressions(spark):
    rows = rows_of() + [(1000 + i, t) for i, (_, t) in enumerate(mixed(spark))]
    rows += [(2000, "1" * 20_000), (2001, "a" * 50_000), (2002, "a@b" + ".c" * 10_000), (2003, "+" + "1 " * 5_000)]
    out = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    assert len(out) == len(rows)
    names = list(pii.KINDS)
    for i, t in rows:
        spans = brute(t)
        listed = [f"{names[k]}:{s}:{e}" for s, k, e in spans]
        r = out[i]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), t[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if x.split(":")[0] in pii.BASE] == listed
        starts = [int(x.split(":")[1]) for x in every]
        assert starts == sorted(starts)


def test_redaction_replaces_every_span(spark):
    rows = rows_of(200) + [(None, None), (401, "a@b.c"), (401, "a@b.c"), (300, "write a@b.c or +1 (743) 555-3824.")]
    df = documents(spark, rows)
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[300] == "write <email> or <phone>." and texts[401] == "<email>" and texts[None] is None
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    for i, t in rows[:200]:
        merged, at, new = [], 0, ""
        for x in spans[i].split(",") if spans[i] else []:
            kind, s, e = x.split(":")
            if int(s) >= at:
                new += t[at:int(s)] + f"<{kind}>"
            at = max(at, int(e))
        assert texts[i] == new + t[at:]


def test_estimates_separate_good_and_bad_labelers():
    # kind 0: three labelers agree on most spans, the fourth abstains
    rows = [(0, 1, 1, 1, -1, 500), (0, 0, 0, 0, -1, 500), (0, 1, 0, 1, -1, 20), (0, 0, 1, 0, -1, 20)]
    post = pii.estimate(rows)
    assert post[(0, 1, 1, 1, -1)] > 0.95 and post[(0, 0, 0, 0, -1)] < 0.05 and post[(0, 1, 0, 1, -1)] > 0.5


def test_empty_tables_and_no_python(spark):
    df = documents(spark, [(1, "a@b.c")])
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
    plan = pii.find(df)._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "Arrow" not in plan


def test_redaction_with_clashing_names(spark):
    names = ["__rid", "__found", "__entries", "rid", "found", "entries", "kind", "c0", "c1"]
    df = spark.createDataFrame([(1, "mail a.b@example.org now", *names), (2, None, *names)], ["doc_id", "text", *names])
    out = pii.redact(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert got[1] == (1, "mail <email> now", *names) and got[2] == (2, None, *names)
