"""Personal data by weak supervision (DataFrame operations only).

Candidate spans come from regular expressions: the four base kinds (email, ip,
card, phone), which always stay if they pass their checks, and further kinds
(names after a title, national ids, account numbers, local phone numbers,
secrets) which the method decides on. Labelers vote on every span (yes, no or
abstain): the strict form of the expression, a gazetteer for the kind, words
in the context before it, and the characters around it.
Expectation-maximisation over the counts of vote patterns estimates how often each
labeler is right per kind and each pattern's probability of being personal
data; a naive Bayes span classifier is trained on those soft labels from
features of the span, and accepts the further spans.

Only vote-pattern and feature counts reach the driver (at most 3**4 patterns
and a few dozen feature values per kind, whatever the number of rows).

Positions are code points, end exclusive. Long runs of one character class are
matched in linear time (possessive quantifiers; starts inside a run that has
already failed are skipped), with the results of the plain expressions.

Defined results: null text is empty (no spans); texts of any length are
scanned whole; repeated rows are each given their spans; an empty table gives
an empty result; extra columns, whatever their names, are carried through by
``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import store, text_or_empty

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (expression, characters a text must hold to be scanned)
KINDS: dict[str, tuple[str, str]] = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "name": (r"(?<![\p{L}0-9])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señor|Señora)\.?\x20"
             r"\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?+", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señor)"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]"),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    "local_phone": (r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", "[0-9]{3}"),
    "secret": (r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+.-]{12,}+\"?+", "[=:]"),
}
BASE = ("email", "ip", "card", "phone")
_NUMBER = {k: i for i, k in enumerate(KINDS)}

#: words before a span that speak for a kind, and words that speak against any
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|address|from", "card": "card|visa|karte|carte|tarjeta|pay",
    "phone": "phone|call|tel|fax|mobile|telefon|llame", "name": "by|contact|signed|dear|von|par|de", "national_id": "ssn|social|security|id",
    "account": "iban|account|konto|compte|cuenta|bank", "local_phone": "phone|call|tel|fax|mobile|contact", "secret": "key|login|config|export|access",
}
AGAINST = "isbn|version|page|chapter|section|invoice|order|figure|table|total|issue"
TOP_LEVEL = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|ch|at|it|nl"
GIVEN = "Anna|Maria|John|James|Robert|Michael|David|Peter|Paul|Thomas|Hans|Karl|Pierre|Jean|Marie|Sophie|José|Juan|Carmen|Ana"
LABELERS = ("strict", "gazetteer", "context", "edges")


def candidates(text: Column) -> Column:
    """All candidate spans of a text: kind number, place among the kind's matches, match, gap since the one before, surroundings."""
    def of(number: int, pattern: str) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), m.alias("match"), F.length(F.get(gaps, i)).cast("long").alias("gap"),
            F.right(F.get(gaps, i), F.lit(40)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")))

    found = []
    for kind, (pattern, needs) in KINDS.items():
        has = F.instr(text, "@") > 0 if needs == "@" else F.regexp_like(text, F.lit(needs))
        found.append(F.when(has, of(_NUMBER[kind], pattern)))
    empty = F.array().cast("array<struct<kind:int,i:int,match:string,gap:bigint,before:string,after:string>>")
    return F.concat(*[F.coalesce(f, empty) for f in found])


def _by_kind(values: dict[str, Column], default: Column) -> Column:
    out = default
    for kind, v in values.items():
        out = F.when(F.col("kind") == _NUMBER[kind], v).otherwise(out)
    return out


def spans(rows: DataFrame) -> DataFrame:
    """One row per candidate of stored ``rows`` (rid, found): positions, base verdict, votes and features."""
    each = rows.select("rid", F.explode("found").alias("s")).select("rid", "s.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("match").cast("long")
    each = each.withColumn("end", F.sum(F.col("gap") + n).over(upto)).withColumn("start", F.col("end") - n)
    m = F.col("match")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n_digits = F.length(digits)
    octets = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"
    passes = _by_kind({"ip": F.regexp_like(m, F.lit(octets)), "card": n_digits.between(12, 19) & F.call_function("luhn_check", digits),
                       "phone": n_digits.between(9, 15)}, F.lit(True))
    each = each.withColumn("base", F.col("kind") < len(BASE)).filter(~F.col("base") | passes)
    near = F.lower("before")

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, 0).otherwise(-1)

    strict = _by_kind({
        "account": F.length(F.regexp_replace(m, " ", "")).between(15, 34).cast("int"),
        "national_id": (~F.regexp_like(m, F.lit("^(?:000|666|9)"))).cast("int"),
        "local_phone": vote(F.regexp_like(m, F.lit(r"^\([0-9]{3}\) ")), F.regexp_like(m, F.lit("^[01]"))),
        "secret": vote(F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]")), F.length(m) < 20),
        "name": vote(F.regexp_like(m, F.lit(r" \p{L}+ \p{L}+$")), F.lit(False))}, F.lit(1))
    gazetteer = _by_kind({
        "email": vote(F.regexp_like(m, F.lit(rf"\.(?:{TOP_LEVEL})$")), F.lit(True)),
        "ip": vote(F.lit(False), F.regexp_like(m, F.lit("^(?:0|127)[.]"))),
        "card": vote(F.regexp_like(m, F.lit("^[3-6]")), F.lit(True)),
        "name": vote(F.regexp_like(m, F.lit(rf" (?:{GIVEN})(?: |$)")), F.lit(False)),
        "account": vote(F.regexp_like(m, F.lit("^(?:DE|FR|ES|GB|IT|NL|CH|AT|BE)")), F.lit(True)),
        "local_phone": vote(F.regexp_like(m, F.lit(r"^\(?[2-9]")), F.lit(True))}, F.lit(-1))
    context = _by_kind({k: vote(F.regexp_like(near, F.lit(rf"\b(?:{w})\b[^\p{{L}}]*$|\b(?:{w})\b.{{0,20}}$")),
                                F.regexp_like(near, F.lit(rf"\b(?:{AGAINST})\b.{{0,10}}$"))) for k, w in CONTEXT.items()}, F.lit(-1))
    glued = F.regexp_like(F.right(F.col("before"), F.lit(1)), F.lit(r"[\p{L}0-9_/$€#]")) | F.regexp_like(F.col("after"), F.lit(r"[\p{L}0-9_/%]"))
    edges = F.when(glued, 0).otherwise(1)
    votes = dict(zip(LABELERS, (strict, gazetteer, context, edges)))
    features = F.array(
        F.concat(F.lit("len:"), F.least(F.floor(F.log2(F.length("match") + 1)), F.lit(8)).cast("string")),
        F.concat(F.lit("digits:"), F.least(n_digits, F.lit(20)).cast("string")),
        F.concat(F.lit("marks:"), F.least(F.length(F.regexp_replace(m, r"[\p{L}0-9]", "")), F.lit(8)).cast("string")),
        F.concat(F.lit("before:"), F.when(F.regexp_like("before", F.lit(r"\p{L}$")), "letter").when(F.regexp_like("before", F.lit(r"\s$|^$")), "space").otherwise("mark")),
        F.concat(F.lit("after:"), F.when(F.regexp_like("after", F.lit(r"\p{L}")), "letter").when(F.regexp_like("after", F.lit(r"\s|^$")), "space").otherwise("mark")))
    return each.select("rid", "kind", "start", "end", "base", *[v.cast("int").alias(k) for k, v in votes.items()], features.alias("features"))


def estimate(patterns: list[tuple], rounds: int = 100) -> dict[tuple, float]:
    """EM per kind over (kind, votes..., count): the probability of each vote pattern being personal data.

    Each labeler has, per class, a probability of voting yes when it does not
    abstain (smoothed; it starts out better than chance), and the classes have a prior.
    """
    out: dict[tuple, float] = {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(p[1:-1], p[-1]) for p in patterns if p[0] == kind]
        prior, yes = 0.5, [[0.3, 0.8] for _ in LABELERS]
        post: dict[tuple, float] = {}
        for _ in range(rounds):
            moved = 0.0
            for v, _ in rows:
                log = [math.log(1 - prior), math.log(prior)]
                for j, x in enumerate(v):
                    if x >= 0:
                        for c in (0, 1):
                            log[c] += math.log(yes[j][c] if x else 1 - yes[j][c])
                p = 1 / (1 + math.exp(max(-60.0, min(60.0, log[0] - log[1]))))
                moved = max(moved, abs(p - post.get(v, 0.0)))
                post[v] = p
            total = sum(n for _, n in rows)
            prior = (sum(n * post[v] for v, n in rows) + 1) / (total + 2)
            for j in range(len(LABELERS)):
                for c in (0, 1):
                    weigh = [(n * (post[v] if c else 1 - post[v]), v[j]) for v, n in rows if v[j] >= 0]
                    start = 8.0 if c else 3.0  # ten imagined votes
                    yes[j][c] = (sum(w for w, x in weigh if x) + start) / (sum(w for w, _ in weigh) + 10)
            if moved < 1e-9:
                break
        out.update({(kind, *v): p for v, p in post.items()})
    return out


def accepted(found: DataFrame) -> DataFrame:
    """(rid, kind, start, end, base): the base spans and the further spans that the trained classifier accepts."""
    counted = found.groupBy("kind", *LABELERS).agg(F.count("*").alias("n"))
    patterns = [tuple(r) for r in counted.collect()]  # at most kinds * 3**labelers rows
    post = estimate(patterns)
    further = found.filter(~F.col("base"))
    keep = ["rid", "kind", "start", "end", "base"]
    if not any(k[0] >= len(BASE) for k in post):
        return found.select(*keep)
    spark = found.sparkSession
    table = F.broadcast(spark.createDataFrame([(*k, p) for k, p in post.items()],
                                              "kind int, " + ", ".join(f"{x} int" for x in LABELERS) + ", p double"))
    soft = further.join(table, ["kind", *LABELERS])
    by_value = soft.select("kind", "p", F.explode("features").alias("f")).groupBy("kind", "f").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    per_kind = soft.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    weights = by_value.join(F.broadcast(per_kind), "kind").select(
        "kind", "f", F.log((F.col("yes") + 1) / (F.col("all_yes") + 10) * (F.col("all_no") + 10) / (F.col("no") + 1)).alias("w"))
    priors = per_kind.select("kind", F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("w0"))
    maps = weights.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("f", "w"))).alias("w"))  # a few dozen values a kind
    model = F.broadcast(maps.join(priors, "kind"))
    total = F.aggregate("features", F.col("w0"), lambda acc, f: acc + F.coalesce(F.element_at(F.col("w"), f), F.lit(0.0)))
    good = further.join(model, "kind").filter(total > 0).select(*keep)
    both = found.filter("base").select(*keep).unionByName(good)
    # a further span gives way to a base span that it touches, and to a further span that starts before it
    order = Window.partitionBy("rid").orderBy("start", "kind")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    other_end = F.max(F.when(~F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    clear = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end")) & (
        F.coalesce(other_end, F.lit(0)) <= F.col("start"))
    return both.withColumn("clear", clear).filter(F.col("base") | F.col("clear")).drop("clear")


def _listed(entries: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(entries), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def per_row(found: DataFrame) -> DataFrame:
    """(rid, n_<kind> for the base kinds, base_list, all_list, entries) of rows that have spans."""
    entry = F.struct("start", "kind", "end")
    return found.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == _NUMBER[k]).alias(f"n_{k}") for k in BASE],
        F.collect_list(F.when(F.col("base"), entry)).alias("base_entries"), F.collect_list(entry).alias("entries")).select(
        "rid", *[f"n_{k}" for k in BASE], _listed(F.col("base_entries")).alias("base_list"), _listed(F.col("entries")).alias("all_list"),
        F.array_sort("entries").alias("entries"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    rows = store(df.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"),
                           candidates(text_or_empty(F.col(f"`{text_col}`"))).alias("found")), "pii-candidates")
    listed = per_row(accepted(store(spans(rows.filter(F.size("found") > 0)), "pii-spans")))
    return rows.select("rid", "doc_id").join(listed, "rid", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base_list", F.lit("")), 256).alias("base_sha256"), F.coalesce("all_list", F.lit("")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span in the text replaced by its kind in angle brackets; spans that overlap become one.

    Inside, the columns have names of their own, so any names of the table may come.
    """
    own = [f"c{i}" for i in range(len(df.columns))]
    held = own[df.columns.index(text_col)]
    text = text_or_empty(F.col(held))
    rows = store(df.toDF(*own).withColumn("__rid", F.monotonically_increasing_id()).withColumn("__found", candidates(text)), "pii-rows")
    has = F.size("__found") > 0
    clean = rows.filter(~has).drop("__rid", "__found")
    found = store(spans(rows.filter(has).select(F.col("__rid").alias("rid"), F.col("__found").alias("found"))), "pii-spans")
    listed = per_row(accepted(found)).select(F.col("rid").alias("__rid"), F.col("entries").alias("__entries"))
    hit = rows.filter(has).drop("__found").join(listed, "__rid", "left")
    e = F.col("__entries")
    names = F.array(*[F.lit(k) for k in KINDS])
    reach = F.array_prepend(F.transform(e, lambda s, i: s["end"]), F.lit(0).cast("long"))
    # each span contributes what lies between the furthest end before it and its start, then its kind
    before = lambda i: F.array_max(F.slice(reach, 1, i + 1))
    parts = F.transform(e, lambda s, i: F.when(
        s["start"] >= before(i),
        F.concat(F.substring(text, before(i).cast("int") + 1, (s["start"] - before(i)).cast("int")), F.lit("<"), F.get(names, s["kind"]), F.lit(">")))
        .otherwise(F.lit("")))
    tail = F.substring(text, F.array_max(reach).cast("int") + 1, F.length(text))
    new = F.when(F.size(e) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(held))
    done = hit.withColumn(held, new).select(*own)
    return clean.unionByName(done).toDF(*df.columns)
