"""Small inputs for the tests of this folder."""

import random

WORDS = "the of and river stone market open letter seven bright winter paper garden music".split()
CLASHING = ["id", "fp", "text_sha256", "run", "rid", "pos", "__pos", "score", "kind", "grp", "sequence_id", "shard", "hilbert"]


def texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 60))) for _ in range(n)]


def awkward() -> list:
    """Null and empty texts, white space alone, one very long text, a long word, ties and other scripts."""
    return [None, "", " \t\n ", "one", "one two", "x" * 20_000, "word " * 30_000, "日本語 テキスト", "Straße ÉTÉ", "a\x0bb\x0cc\x1cd", "😀 😀"]


def documents(spark, rows, extra=CLASHING):
    """(doc_id, text, lang, source, n_chars) plus extra columns whose names operators use inside."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), *["x"] * len(extra)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame(full, schema)


def mixed(spark):
    """Plain texts, awkward ones, copies, a repeated row and a null id."""
    plain = texts(60)
    rows = list(enumerate(plain)) + [(100 + i, t) for i, t in enumerate(awkward())]
    rows += [(200 + i, plain[3].replace(" ", "  ")) for i in range(30)] + [(5, plain[5])] * 3 + [(None, plain[7]), (None, None)]
    return rows
