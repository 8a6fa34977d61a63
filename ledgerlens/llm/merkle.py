"""Merkle manifest of a dataset: bitmap ranks place the leaves, keyed slot arrays reduce the levels.

Every row is a leaf (the SHA-256 of its fields). The leaves of a group stand in
the order of their ids, eight consecutive nodes become one until a group's
subroot is left, and the subroots, in the order of the groups, become the root.

Placing without a sort: the ids of a group are one compressed bitmap, kept as
its non-empty 64-bit words (group, id >> 6, bits). Tasks OR their partial words
map-side and the shuffle merges them. A popcount directory above the words
(sums per 4096 keys, and per 4096 of those, until one node holds all) gives each
word the number of leaves before it; a leaf's position is that number plus the
popcount of the lower bits of its word. Every window of the directory spans at
most 8192 rows, so no group, however large, meets in one task.

Reducing: a node goes to slot ``position & 7`` of the slot array keyed by
(group, position >> 3); the digest of an array is a node of the next level. Paths
go back down the same arrays, so a leaf receives its siblings from at most eight
rows at each level.

Defined results: a null field is written ``-``; a null group comes before any
other, a null id before any other of its group; rows that repeat an id of their
group stand side by side in the order of their digests (only these rows are
sorted, by range, whatever their number), equal rows next to each other; an empty
table gives an empty result; columns that are not named as fields are not read, so
their names cannot clash.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import store
from ledgerlens.operators.ids import assign_sequential_ids, materialize_ordered, number_ordered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: children of a node, as a power of two
ARITY_BITS = 3
#: keys under one node of the popcount directory, as a power of two
FAN_BITS = 12
#: the word of a null id, below that of any long
NULL_WORD = -(1 << 57) - 1


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(df: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
           changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, grp, leaf, now): ``now`` is the digest with the fields of ``changed`` put in place of the stored ones."""
    own = {f: F.col(f"`{f}`") for f in fields}
    group = F.col(f"`{group_col}`").cast("string")
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group)).alias("grp"),  # '-' sorts before '='
        leaf_digest(list(own.values())).alias("leaf"),
        leaf_digest(list({**own, **(changed or {})}.values())).alias("now"))


def _word() -> Column:
    return F.coalesce(F.shiftright("id", 6), F.lit(NULL_WORD))


def _bit() -> Column:
    return F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")


def id_bitmaps(placed: DataFrame) -> DataFrame:
    """(grp, key, bits, n): the non-empty words of each group's id bitmap and the rows in each."""
    one = placed.select("grp", _word().alias("key"), _bit().alias("bit"))
    shifted = F.expr("shiftleft(1L, bit)")
    return one.groupBy("grp", "key").agg(F.bit_or(shifted).alias("bits"), F.count(F.lit(1)).alias("n"))


def with_popcounts(counts: DataFrame, low: int, high: int) -> DataFrame:
    """Add ``before`` (rows of the group under smaller keys) and ``total`` (rows of the group) to (grp, key, n, ...)."""
    up = F.shiftright("key", FAN_BITS)
    top = (high >> FAN_BITS) - (low >> FAN_BITS) <= 1  # two nodes at the most: keys on both sides of 0 never meet in one
    siblings = Window.partitionBy("grp", *([] if top else [up]))  # at most 2 ** FAN_BITS rows, twice that at the top
    earlier = F.coalesce(F.sum("n").over(siblings.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if top:
        return counts.withColumns({"before": earlier, "total": F.sum("n").over(siblings)})
    above = counts.groupBy("grp", up.alias("key")).agg(F.sum("n").alias("n"))
    above = with_popcounts(above, low >> FAN_BITS, high >> FAN_BITS).select(
        "grp", F.col("key").alias("__up"), F.col("before").alias("__base"), "total")
    own = counts.withColumn("__earlier", earlier).withColumn("__up", up)
    return (own.join(above, ["grp", "__up"]).withColumn("before", F.col("__base") + F.col("__earlier"))
            .drop("__up", "__base", "__earlier"))


def _placed(found: DataFrame, words: DataFrame) -> DataFrame:
    """Rows with ``pos`` (place in the group, from 0) and ``total``."""
    at = found.withColumns({"key": _word(), "bit": _bit()})
    plain = F.bit_count("bits") == F.col("n")  # no id of the word is repeated
    lower = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    out = at.join(words.filter(plain).drop("n"), ["grp", "key"]).withColumn("pos", F.col("before") + lower).drop("bits", "before", "key", "bit")
    again = words.filter(~plain).drop("bits", "n")
    if again.isEmpty():
        return out
    rows = at.join(again, ["grp", "key"])
    numbered = store(number_ordered(materialize_ordered(
        rows, [F.col("grp"), F.col("id").asc_nulls_first(), F.col("leaf")]), "__number"), "merkle-repeats")
    first = numbered.groupBy("grp", "key").agg(F.min("__number").alias("__first"))
    tied = numbered.join(first, ["grp", "key"]).withColumn("pos", F.col("before") + F.col("__number") - F.col("__first"))
    return out.unionByName(tied.select(*out.columns))


def _level(nodes: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The slot arrays over (grp, pos, total, digest, kept...): one row per run of eight nodes.

    ``many`` tells whether the group had several nodes; a single one passes up as it is.
    """
    slot = F.struct(F.col("pos").bitwiseAND(F.lit((1 << ARITY_BITS) - 1)).cast("int").alias("slot"), "digest", *kept)
    arrays = nodes.groupBy("grp", F.shiftright("pos", ARITY_BITS).alias("pos")).agg(
        F.collect_list(slot).alias("slots"), F.max("total").alias("total"))  # at most eight nodes a key
    arrays = arrays.withColumn("slots", F.sort_array("slots"))
    joined = F.array_join(F.transform("slots", lambda s: s["digest"]), "")
    return arrays.select(
        "grp", "pos", "slots", (F.col("total") > 1).alias("many"),
        F.shiftright(F.col("total") + ((1 << ARITY_BITS) - 1), ARITY_BITS).alias("total"),
        F.when(F.col("total") > 1, F.sha2(joined, 256)).otherwise(F.element_at("slots", 1)["digest"]).alias("digest"))


def _levels(nodes: DataFrame, most: int, kept: Sequence[str], name: str) -> list[DataFrame]:
    """Stored slot arrays of every level; the last has one row per group."""
    out: list[DataFrame] = []
    while most > 1 or not out:
        out.append(store(_level(nodes, () if out else kept), f"merkle-{name}-{len(out)}"))
        nodes, most = out[-1].select("grp", "pos", "total", "digest"), -(-most >> ARITY_BITS)
    return out


def _children(level: DataFrame, kept: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """One row per slot: its place, its kept columns and its path (its siblings, then those of its parent upwards)."""
    def text(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda s: s["digest"]), "")

    def child(s: Column, i: Column) -> Column:
        slots = F.col("slots")
        own = F.struct(text(F.slice(slots, F.lit(1), i)).alias("left"),
                       text(F.slice(slots, i + 2, F.size(slots))).alias("right"))
        return F.struct(s["slot"].alias("slot"), s["digest"].alias("digest"), *[s[k].alias(k) for k in kept], own.alias("own"))

    each = level.select("grp", "pos", "many", "path", *carried, F.explode(F.transform("slots", child)).alias("c"))
    return each.select("grp", (F.shiftleft("pos", ARITY_BITS) + F.col("c.slot")).alias("pos"), *[f"c.{k}" for k in ("digest", *kept)],
                       F.when(F.col("many"), F.concat(F.array("c.own"), F.col("path"))).otherwise(F.col("path")).alias("path"),
                       *carried)


def _down(levels: list[DataFrame], kept: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """From the top level (with ``path`` and the carried columns) down to the children of the lowest."""
    at = levels[-1]
    for below in reversed(levels[:-1]):
        path = _children(at, (), carried).drop("digest")
        at = below.select("grp", "pos", "slots", "many").join(path, ["grp", "pos"])
    return _children(at, kept, carried)


@dataclass
class Manifest:
    """``leaves``: (id, grp, leaf, now, pos, path, subroot, root), a row per leaf; ``groups``: (grp, subroot, root)."""

    leaves: DataFrame
    groups: DataFrame


_PATH = "array<struct<left:string,right:string>>"


def build(found: DataFrame) -> Manifest:
    """The manifest of a table of ``leaves``."""
    found = store(found, "merkle-leaves")
    words = store(id_bitmaps(found), "merkle-bitmaps")
    low, high = words.agg(F.min("key"), F.max("key")).first()
    if low is None:
        none = F.lit(None).cast("string")
        empty = found.withColumns({"pos": F.lit(0).cast("long"), "path": F.lit(None).cast(_PATH), "subroot": none, "root": none})
        return Manifest(empty, empty.select("grp", "subroot", "root"))
    words = store(with_popcounts(words, low, high), "merkle-directory")
    most = words.agg(F.max("total")).first()[0]
    kept = ("id", "now")
    nodes = _placed(found, words).withColumnRenamed("leaf", "digest")
    levels = _levels(nodes.select("grp", "pos", "total", "digest", *kept), most, kept, "level")

    subroots = levels[-1].select("grp", F.col("digest").alias("subroot"))
    placed = store(assign_sequential_ids(subroots, [F.col("grp")], "pos", start=0), "merkle-groups")
    n = placed.count()
    tops = _levels(placed.select(F.lit("").alias("grp"), "pos", F.lit(n).cast("long").alias("total"), F.col("subroot").alias("digest"),
                                 F.col("grp").alias("name")), n, ("name",), "top")
    tops[-1] = tops[-1].withColumns({"path": F.array().cast(_PATH), "root": F.col("digest")})
    groups = _down(tops, ("name",), ("root",)).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "path", "root")
    groups = store(groups, "merkle-subroots")
    levels[-1] = levels[-1].join(groups, "grp")
    rows = _down(levels, kept, ("subroot", "root")).withColumnRenamed("digest", "leaf")
    return Manifest(rows.select("id", "grp", "leaf", "now", "pos", "path", "subroot", "root"), groups.select("grp", "subroot", "root"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verify(manifest: Manifest) -> DataFrame:
    """Per leaf: (id, leaf, subroot, root, proof_sha256, folded_root, verified), its present digest folded with the stored siblings."""
    found = manifest.leaves.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.col("now"), F.col("path"))})
    return found.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"), F.col("pos").alias("position"))


def oracle(levels: int = 7, tops: int = 3) -> str:
    """DuckDB SQL of the query: levels unrolled, for up to 8 ** levels leaves a group and 8 ** tops groups."""
    def h(*parts: str) -> str:
        return "sha256(" + " || ".join(parts) + ")"

    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return h(*[f"({enc(c)})" for c in ("doc_id", "source", "lang", "n_chars", text)])

    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
          lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    sql = [f"""t AS (SELECT *, coalesce('=' || lang, '-') AS grp, {leaf('text')} AS leaf,
               CASE WHEN ({crc}) % 3 = 0 THEN {lower} ELSE text END AS tampered FROM documents)""",
           f"""l0 AS (SELECT grp, doc_id, leaf AS d, {leaf('tampered')} AS now,
               row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS total FROM t)"""]

    def step(src: str, out: str) -> str:
        return f"""{out} AS (SELECT grp, pos // 8 AS pos, max(total) > 1 AS many, list(d ORDER BY pos) AS ds, (max(total) + 7) // 8 AS total,
                   CASE WHEN max(total) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE max(d) END AS d FROM {src} GROUP BY grp, pos // 8)"""

    for k in range(levels):
        sql.append(step(f"l{k}", f"l{k + 1}"))
    sql.append(f"""g0 AS (SELECT '' AS grp, grp AS name, d, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS total FROM l{levels})""")
    for k in range(tops):
        sql.append(step(f"g{k}", f"g{k + 1}"))

    def staged(src: str, prefix: str, count: int, name: str) -> str:
        """Fold one level per CTE, so that expressions stay small."""
        parts, prev = [], src
        for k in range(1, count + 1):
            a, i = f"{prefix}{k}", f"((p.pos // {8 ** (k - 1)}) % 8)"
            left, right = f"array_to_string({a}.ds[1:{i}], '')", f"array_to_string({a}.ds[{i} + 2:], '')"
            parts.append(f"""{name}{k} AS (SELECT p.* EXCLUDE (now, proof), CASE WHEN {a}.many THEN sha256({left} || p.now || {right}) ELSE p.now END AS now,
                CASE WHEN {a}.many THEN p.proof || {left} || {right} ELSE p.proof END AS proof FROM {prev} p
                JOIN {a} ON {a}.grp = p.grp AND {a}.pos = p.pos // {8 ** k})""")
            prev = f"{name}{k}"
        return ",\n".join(parts)

    sql.append("a0 AS (SELECT grp, doc_id, d AS leaf, now, pos, '' AS proof FROM l0)")
    sql.append(staged("a0", "l", levels, "a"))
    sql.append(f"""b0 AS (SELECT g0.grp, a.doc_id, a.leaf, a.now, g0.pos, a.proof, g0.d AS subroot, a.pos AS position
                   FROM a{levels} a JOIN g0 ON g0.name = a.grp)""")
    sql.append(staged("b0", "g", tops, "b"))
    return "WITH " + ",\n".join(sql) + f"""
        SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = r.d AS verified, position
        FROM b{tops} CROSS JOIN g{tops} r"""
