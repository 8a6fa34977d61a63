import hashlib
import zlib

from pyspark.sql import functions as F

from corpus import CLASHING, awkward, documents, texts
from ledgerlens.llm import merkle
from ledgerlens.llm.queries import op11_merkle_manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def reduced(nodes):
    """Levels of digests, lowest first, until one is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, pos):
    out = []
    for level in levels[:-1]:
        run = level[pos // 8 * 8:pos // 8 * 8 + 8]
        out.append(("".join(run[:pos % 8]), "".join(run[pos % 8 + 1:])))
        pos //= 8
    return out


def brute(rows):
    """Expected rows (doc_id, leaf, subroot, root, proof, folded, verified) as a sorted list."""
    def low(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        now = leaf_of(doc_id, source, lang, n_chars, low(text) if hit else text)
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, now))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: r[0])
        trees[g] = reduced([r[2] for r in groups[g]])
    top = reduced([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for pos, (_, doc_id, leaf, now) in enumerate(groups[g]):
            steps = path(trees[g], pos) + path(top, k)
            folded = now
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((str(doc_id), leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0], pos))
    return sorted(out)


def found(spark, rows, scratch):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHING)
    df = spark.createDataFrame([(i, t, g, s, n, *["x"] * len(CLASHING)) for i, s, g, n, t in rows], schema)
    df.repartition(5).write.parquet(f"{scratch}/documents.parquet")
    out = op11_merkle_manifest(spark, scratch)
    assert out.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_query_against_brute_force(spark, scratch):
    rows = [(7 * i, f"src{i % 3}", "en" if i % 3 else None, len(t), t) for i, t in enumerate(texts(700))]
    rows += [(5000 + i, "s", "日本" if i % 2 else "ÉÉ", 1, t) for i, t in enumerate(awkward())]
    rows += [(i, None, f"l{i}", None, "Solo") for i in range(10)]  # groups of one leaf, and enough groups for two top levels
    rows += [(2 ** 62 + 3, "s", "en", 0, "Far"), (-2 ** 62, "s", "en", 0, "Low"), (-1, "s", "en", 0, "Minus")]
    assert found(spark, rows, scratch) == brute(rows)


def test_repeated_and_null_ids(spark, scratch):
    rows = [(3, "s", "en", 1, f"Text {i}") for i in range(40)] + [(3, "s", "en", 1, "Same")] * 30 + [(4, "s", "en", 1, "After")]
    rows += [(None, "s", "en", 1, f"No id {i % 4}") for i in range(9)] + [(64 + i, "s", "en", 1, "T") for i in range(20)]
    assert found(spark, rows, scratch) == brute(rows)


def test_one_leaf_and_none(spark, scratch):
    one = [(1, "s", "en", 1, "Aa")]
    assert found(spark, one, scratch + "/one") == brute(one)
    assert found(spark, [], scratch + "/none") == []


def test_directory_with_several_levels(spark):
    """Ids so far apart that the popcount directory needs all its levels."""
    ids = [(-1) ** i * 7 ** (i % 20) * (i + 1) for i in range(300)]
    df = documents(spark, [(i, "x") for i in ids], extra=())
    rows = merkle.build(merkle.leaves(df)).leaves.select("id", "pos").collect()
    assert sorted((r["pos"], r["id"]) for r in rows) == list(enumerate(sorted(ids)))


def test_no_window_over_a_group(spark):
    """The directory's windows are bounded by the key above; leaves are never sorted as a whole."""
    df = documents(spark, list(enumerate(texts(50))), extra=())
    words = merkle.id_bitmaps(merkle.leaves(df))
    plan = merkle.with_popcounts(words, 0, 1 << 30)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and plan.count("windowspecdefinition(grp") >= 2


def test_verify_flags_only_what_changed(spark):
    df = documents(spark, list(enumerate(texts(30))), extra=())
    out = merkle.verify(merkle.build(merkle.leaves(df, changed={"text": F.when(F.col("doc_id") == 4, F.lit("!")).otherwise(F.col("text"))})))
    assert [r["id"] for r in out.filter("NOT verified").collect()] == [4]
