"""SimHash near-dedup by a binary trie self-join.

A 64-bit fingerprint per document, then all pairs of distinct fingerprints
within a Hamming budget, found by walking a binary trie against itself: a pair
of trie nodes is opened together, the bits in which their paths differ are
added up, and the pair is dropped as soon as the budget is exceeded.

Distribution: with budget k, two linked fingerprints agree in at least one of
k+1 equal blocks of bits (pigeonhole). For each block the fingerprints are
rotated so that the block comes first; node pairs whose paths differ inside
the first block are pruned whole, so each value of it is the root of a trie
that one task walks. A root with more than ``root_limit`` fingerprints is split
further into pairs of nodes one level of bits below, again only those within the
budget, so that it is walked by many tasks.

Copies: equal fingerprints are one trie leaf, whatever their number. Tasks
return a spanning forest of their links (never all pairs), and skip node pairs
whose leaves are all known to be connected; large-star/small-star rounds
(Kiverskis et al., "Connected components in MapReduce and beyond", 2014) join
the forests.

Defined results: null text has no words (fingerprint zero); fewer words than
the shingle are one shingle; a null id loses to any other as component id;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep_one_per, ship, smallest_id, store

SHINGLE = 3
MAX_BITS = 3
ROOT_LIMIT = 50_000
SEED = 42
#: node pairs that one step of a walk holds at a time
FRONTIER = 1_000_000
#: node pairs of at most this many leaf pairs are compared leaf by leaf
LEAF_PAIRS = 64

_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if more than half of the shingles' XXH64 values have it set."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    one = xxhash.xxh64_intdigest
    values = np.fromiter((one(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())),
                         np.uint64, n)
    lanes = values.view(np.uint8).reshape(-1, 8)
    fp = 0
    for lane in range(8):
        ones = np.bincount(lanes[:, lane], minlength=256) @ _BIT_OF_BYTE
        for bit in np.flatnonzero(2 * ones > n):
            fp |= 1 << (8 * lane + int(bit))
    return fp


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return ship(picked).mapInArrow(run, f"id {kind}, fp long")


def _connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) after adding the links a-b."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(la[open_], lb[open_]), np.minimum(la[open_], lb[open_]))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def _pairs_of(alo, ahi, blo, bhi, same):
    """All leaf pairs of the given small node pairs (i < j within a node paired with itself)."""
    na, nb = ahi - alo, bhi - blo
    count = na * nb
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    i = alo[owner] + place // nb[owner]
    j = blo[owner] + place % nb[owner]
    good = ~same[owner] | (i < j)
    return i[good], j[good]


def walk(keys: np.ndarray, lo, hi, lo2, hi2, err, depth: int, budget: int) -> np.ndarray:
    """Labels of connected leaves after walking the given node pairs of a sorted, distinct uint64 array.

    A node is a range [lo, hi) of ``keys`` that shares its first ``depth`` bits;
    a pair with equal ranges is a node with itself.
    """
    label = np.arange(len(keys))
    if len(keys) < 2:
        return label
    near = np.flatnonzero(np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget)  # trie neighbours first: most of a dense group
    label = _connect(label, near, near + 1)
    stack = [(depth, lo, hi, lo2, hi2, err)]
    while stack:
        depth, alo, ahi, blo, bhi, e = stack.pop()
        if len(alo) > FRONTIER:  # go deep first, so that the open pairs stay bounded
            for k in range(0, len(alo), FRONTIER):
                part = slice(k, k + FRONTIER)
                stack.append((depth, alo[part], ahi[part], blo[part], bhi[part], e[part]))
            continue
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        known = ((change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (label[alo] == label[blo]))
        alo, ahi, blo, bhi, e = (x[~known] for x in (alo, ahi, blo, bhi, e))
        same = alo == blo
        small = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (depth >= 64)
        if small.any():
            for k in range(0, int(small.sum()), FRONTIER // LEAF_PAIRS):
                at = np.flatnonzero(small)[k:k + FRONTIER // LEAF_PAIRS]
                i, j = _pairs_of(alo[at], ahi[at], blo[at], bhi[at], same[at])
                hit = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                label = _connect(label, i[hit], j[hit])
            alo, ahi, blo, bhi, e, same = (x[~small] for x in (alo, ahi, blo, bhi, e, same))
        if not len(alo):
            continue
        bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
        ones = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        nxt = [(alo, amid, blo, bmid, e), (amid, ahi, bmid, bhi, e), (alo, amid, bmid, bhi, e + 1)]
        cross = ~same  # a node with itself has only one mixed pair of children
        nxt.append(tuple(x[cross] for x in (amid, ahi, blo, bmid, e + 1)))
        alo, ahi, blo, bhi, e = (np.concatenate(x) for x in zip(*nxt))
        live = (e <= budget) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo < 2))
        stack.append((depth + 1, *(x[live] for x in (alo, ahi, blo, bhi, e))))
    return label


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return cut, np.append(cut[1:], len(values))


def _walk_task(budget: int, block: int, sub_bits: int):
    """Per task: rows (turn, part, rot) -> spanning links. ``part`` is -1 for a whole root, else node * 2**sub_bits + node2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not got:
            return
        t = pa.concat_tables(got)
        turn, part = t.column("turn").to_numpy(), t.column("part").to_numpy()
        rot = t.column("rot").to_numpy().view(np.uint64)
        for k in np.unique(turn):
            for whole in (True, False):
                pick = (turn == k) & ((part < 0) == whole)
                if not pick.any():
                    continue
                if whole:
                    keys = np.unique(rot[pick])
                    lo, hi = _runs(keys >> np.uint64(64 - block))
                    many = hi - lo > 1
                    lo, hi = lo[many], hi[many]
                    yield from _links(keys, walk(keys, lo, hi, lo, hi, np.zeros(len(lo), np.int64), block, budget), k, block)
                else:
                    for pair in np.unique(part[pick]):
                        keys = np.unique(rot[pick & (part == pair)])
                        lo, hi = _runs(keys >> np.uint64(64 - block - sub_bits))
                        node = keys[lo] >> np.uint64(64 - block - sub_bits)
                        root = node >> np.uint64(sub_bits)
                        low = (node & np.uint64((1 << sub_bits) - 1)).astype(np.int64)
                        a, b = divmod(int(pair), 1 << sub_bits)
                        ia, ib = np.flatnonzero(low == a), np.flatnonzero(low == b)
                        _, ja, jb = np.intersect1d(root[ia], root[ib], return_indices=True)
                        ia, ib = ia[ja], ib[jb]
                        err = np.full(len(ia), (a ^ b).bit_count(), np.int64)
                        yield from _links(keys, walk(keys, lo[ia], hi[ia], lo[ib], hi[ib], err, block + sub_bits, budget), k, block)

    return run


def _links(keys: np.ndarray, label: np.ndarray, turn: int, block: int) -> Iterator[pa.RecordBatch]:
    child = np.flatnonzero(label != np.arange(len(keys)))
    if not len(child):
        return
    back = np.uint64((int(turn) * block) % 64)

    def unturn(x: np.ndarray) -> np.ndarray:
        x = x if not back else (x >> back) | (x << (np.uint64(64) - back))
        return np.ascontiguousarray(x).view(np.int64)

    yield pa.RecordBatch.from_arrays([pa.array(unturn(keys[child])), pa.array(unturn(keys[label[child]]))], names=["u", "v"])


def links(distinct: DataFrame, budget: int = MAX_BITS, root_limit: int = ROOT_LIMIT) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` whose components are those of all pairs within ``budget``."""
    block, sub_bits = 64 // (budget + 1), 6
    ship(distinct)
    turns = F.explode(F.array(*[F.lit(i) for i in range(budget + 1)]))
    fp = F.col("fp")
    at = distinct.select(fp, turns.alias("turn"))
    rot = F.lit(None).cast("long")
    for i in range(budget, -1, -1):
        s = i * block
        moved = fp if s == 0 else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s))
        rot = F.when(F.col("turn") == i, moved).otherwise(rot)
    at = at.select("turn", rot.alias("rot")).withColumn("root", F.shiftrightunsigned("rot", 64 - block))
    heavy = (at.groupBy("turn", "root").agg(F.count("*").alias("n")).filter(F.col("n") > root_limit)
             .select("turn", "root", F.lit(True).alias("heavy")))  # at most (budget + 1) * fingerprints / root_limit rows
    at = at.join(heavy, ["turn", "root"], "left")
    node = F.shiftrightunsigned("rot", 64 - block - sub_bits).bitwiseAND(F.lit((1 << sub_bits) - 1)).cast("int")
    near = F.array(*[F.lit(m) for m in range(1 << sub_bits) if m.bit_count() <= budget])
    pairs = F.transform(near, lambda m: F.least(node, node.bitwiseXOR(m)) * F.lit(1 << sub_bits)
                        + F.greatest(node, node.bitwiseXOR(m)))
    part = F.when(F.col("heavy"), pairs).otherwise(F.array(F.lit(-1)))
    dealt = at.select("turn", "root", "rot", F.explode(part).alias("part"))
    return (dealt.repartition("turn", "root", "part").select("turn", "part", "rot")
            .mapInArrow(_walk_task(budget, block, sub_bits), "u long, v long"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, by large-star and small-star rounds."""
    cur = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "star")
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        # stored, so that the join's two sides are plain shuffles and a hot centre can be split
        low = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").filter("v <> m").toDF("u", "v").union(low.toDF("u", "v"))
        cur = store(small.distinct(), "star")
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return cur.toDF("node", "root")
        before = state
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    budget: int = MAX_BITS, root_limit: int = ROOT_LIMIT) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest id reachable)."""
    docs = store(fingerprints(df, id_col, text_col, shingle), "simhash-fp")
    distinct = store(docs.groupBy("fp").agg(F.min(smallest_id(F.col("id"))).alias("best")), "simhash-distinct")
    roots = components(links(distinct, budget, root_limit))
    leaf = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "best", F.coalesce("root", "fp").alias("root"))
    top = leaf.groupBy("root").agg(F.min("best").alias("best"))
    ids = store(leaf.select("fp", "root").join(top, "root").select("fp", F.col("best.id").alias("component_id")), "simhash-ids")
    return docs.join(ids, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                budget: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one row per component, that of the smallest id
    (no id: last), of several such rows any one. Where identifiers repeat, a row is decided by itself and
    not by its id, so one id may stand in several components, and rows of one id with other texts in one."""
    if df.groupBy(F.col(f"`{id_col}`")).count().filter("count > 1").isEmpty():
        verdict = store(near_duplicates(df, id_col, text_col, shingle, budget), "simhash-verdicts")
        gone = verdict.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
        return df.join(gone, df[f"`{id_col}`"].eqNullSafe(gone["__id"]), "left_anti")
    row = "row"
    while row in {c.lower() for c in df.columns}:
        row = f"_{row}"
    rows = store(df.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")  # stored, so that a row keeps its number
    verdict = near_duplicates(rows, row, text_col, shingle, budget).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, smallest_id(F.col(f"`{id_col}`")).alias("__least"))
    stay = verdict.join(ids, row).groupBy("component_id").agg(F.min(F.struct("__least", row)).alias("__first"))
    return rows.join(stay.select(F.col(f"__first.{row}").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
