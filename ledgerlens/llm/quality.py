"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Each text gets counts (words, symbols, repeated lines, repeated five-word
windows). Fixed base rules come first. On top of them, every rate rule gets a
cutoff per stratum (language) from labelled rows held out for it: among a grid
of candidate cutoffs the strictest is taken for which an exact binomial test
rejects "this rule throws away more than its share of good documents". The
share per rule is the allowed false rejection divided by the number of rules
(a union bound over rules), and the test level is divided by the number of
tests (strata x rules x cutoffs; Bonferroni), so that with probability
1 - ``delta`` no stratum loses more than ``alpha`` of its good documents to the
learnt rules. A stratum with too few labelled good rows gets no cutoff.

Defined results: null and empty texts have no words and fail the base rules; a
null stratum is a stratum of its own; null labels are ignored, and several
labels of one id count as good only if all are; without labels only the base
rules decide; texts of any length are counted whole, in one row and without a
shuffle; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACES, store, text_or_empty

#: share of a stratum's good documents that all learnt rules together may reject
ALPHA = 0.02
#: probability that the guarantee fails anywhere
DELTA = 0.05
#: words of a window
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: rate rules, each rejecting high values
RULES = ["symbols_per_char", "dup_lines_per_word", "repeat_share", "long_words", "short_words"]
#: candidate cutoffs of each rule, the strictest first
GRID = {
    "symbols_per_char": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5],
    "dup_lines_per_word": [0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "repeat_share": [0.01, 0.02, 0.05, 0.1, 0.15],
    "long_words": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
    "short_words": [-4.5, -4.0, -3.5, -3.0, -2.5, -2.0],
}


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Repeated windows are found inside the row: window hashes are sorted with
    their positions, equal neighbours mark repeated positions, and the words
    that the marked windows cover are counted from the sorted positions.
    """
    text = text_or_empty(F.col(f"`{text_col}`"))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    base = df.withColumn("__words", words)
    chars = F.length(F.regexp_replace(text, SPACES, ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACES, "") != "")
    dup_lines = F.when(F.instr(text, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0)
    w = F.col("__words")
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashed = F.transform(starts, lambda i: F.struct(
        F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))
    base = base.withColumn("__hashes", F.when(F.size(w) > WINDOW, F.array_sort(hashed)))
    s = F.col("__hashes")
    # equal hashes count only if the windows' words are equal too
    same = lambda a, b: ((a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, WINDOW) == F.slice(w, b["i"] + 1, WINDOW)))
    marked = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False))
                      | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))
    base = base.withColumn("__at", F.array_sort(F.transform(marked, lambda x: x["i"])))
    at = F.col("__at")
    covered = F.aggregate(
        F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda acc, x: acc + x)
    out = {"n_words": F.size(w), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
           "n_repeat_words": F.coalesce(covered, F.lit(0))}
    return base.withColumns({k: v.cast("long") for k, v in out.items()}).drop("__words", "__hashes", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    per_word = F.col("word_chars") / words
    return {"symbols_per_char": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
            "dup_lines_per_word": F.col("n_dup_lines") / words, "repeat_share": F.col("n_repeat_words") / words,
            "long_words": per_word, "short_words": -per_word}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly term by term in log space."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("log_term"), F.exp(first).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["log_term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("log_term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda acc: acc["total"])


def cutoffs(labelled: DataFrame, stratum: str, good: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, <rule>...): the chosen cutoff per stratum and rule, null where none is safe.

    ``labelled`` holds the counts, the stratum and ``good`` (1 or 0) of the
    held-out labelled rows that pass the base rules. One aggregate with
    map-side combining: per stratum the good rows and, per candidate, those of
    them that it would reject.
    """
    rate = rates()
    tests = sum(len(GRID[r]) for r in RULES)
    ok = F.col(good) == 1
    sums = [F.count_if(ok & (rate[r] > c)).alias(f"k_{r}_{j}") for r in RULES for j, c in enumerate(GRID[r])]
    per = labelled.groupBy(F.col(stratum).alias("stratum")).agg(F.count_if(ok).alias("n"), *sums)
    strata = per.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))  # one row
    candidates = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{r}_{j}").alias("k"))
                                     for r in RULES for j, c in enumerate(GRID[r])]))
    rows = per.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", candidates.alias("t")).select(
        "stratum", "n", "strata", "t.*")
    share = alpha / len(RULES)
    safe = (F.col("k") <= share * F.col("n")) & (
        binomial_tail(F.col("k"), F.col("n"), share) <= F.lit(delta / tests) / F.col("strata"))
    return rows.filter(safe).groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept and the rule that rejected it (null: none)."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"),
                     F.col(f"`{text_col}`").alias("text"))
    rows = store(counted(rows, "text").drop("text").withColumn("base_failed", base_failed()), "quality-counts")
    marks = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("good"))
             .filter("good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good")))
    cuts = cutoffs(rows.filter(~F.col("base_failed")).join(marks, "doc_id"), "stratum", "good", alpha, delta)
    judged = rows.join(cuts.withColumnRenamed("stratum", "__s"), F.col("stratum").eqNullSafe(F.col("__s")), "left")
    rate = rates()
    broken = F.coalesce(*[F.when(rate[r] > F.col(f"cut_{r}"), F.lit(r)) for r in RULES])
    return judged.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & broken.isNull()).alias("kept"),
                         F.when(F.col("base_failed"), F.lit("base")).otherwise(broken).alias("rejected_by"))
