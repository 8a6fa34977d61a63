"""Packing token sequences by best-fit decreasing.

Each document's ids are followed by an end id. Documents longer than a window
are first cut into full windows, which are sequences by themselves; what is
left of each document (shorter than a window) is packed best-fit decreasing: a
segment tree over the remaining capacities finds the tightest open window that
still has room, or a new window is opened.

Distribution: the left-over pieces are dealt, by a hash of their position and
whatever their document, into groups of about ``GROUP_WINDOWS`` windows each
(never more than ``GROUP_PIECES`` pieces), and every group is packed by one
task. A group's cost is at most a few unfilled windows among thousands.

Defined results: a null text is empty and consists of the end id alone; texts
of any length are encoded whole; repeated rows are packed each; pieces of equal
length are packed in input order; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.chunks import ChunkMemory, begins_and_ends_visibly, blocks
from ledgerlens.llm.common import ship, store

WINDOW = 2048
END_ID = 1
GROUP_WINDOWS = 4096
GROUP_PIECES = 250_000
#: chunks that go through the tokenizer as one text
ROW = 64
#: characters encoded at a time
BLOCK = 2_000_000


class CapacityTree:
    """Segment tree over remaining capacities: how many open windows have each."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += change
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need that an open window has."""
        node = self.leaves + need
        if not self.count[node]:
            while node & 1 or not self.count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window number, offset) of each length; the lengths come in decreasing order."""
    tree = CapacityTree(window)
    open_: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset, opened = [], [], 0
    for need in lengths:
        room = tree.tightest(need)
        if room is None:
            w, room = opened, window
            opened += 1
        else:
            w = open_[room].pop()
            tree.add(room, -1)
        number.append(w)
        offset.append(window - room)
        if room > need:
            open_[room - need].append(w)
            tree.add(room - need, 1)
    return number, offset


_MEMORIES: dict[str, ChunkMemory] = {}


def memory(key: str, tokenizer_json: str) -> ChunkMemory:
    """One tokenizer with its remembered chunks per worker process."""
    if key not in _MEMORIES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer_json)
        # an added token's string in a text is that token, as in the library; the cuts below are at
        # spaces, so a token that holds or takes in a space would not survive them
        for added in tok.get_added_tokens_decoder().values():
            if " " in added.content or added.lstrip or added.rstrip or added.single_word:
                raise ValueError(f"added token {added.content!r}: texts cannot be cut at spaces")

        n_bytes = np.zeros(tok.get_vocab_size(), dtype=np.int64)  # byte-level vocabulary: a character stands for a byte
        for token, i in tok.get_vocab().items():
            n_bytes[i] = len(token)

        def alone(chunk_list: list[str]) -> list[bytes]:
            return [struct.pack(f"<{len(ids)}I", *ids)
                    for ids in [e.ids for e in tok.encode_batch_fast(chunk_list, add_special_tokens=False)]]

        def work_out(chunk_list: list[str]) -> list[bytes]:
            """Chunks that begin and end visibly are encoded in rows (no token crosses from one to the next)."""
            out: list = [None] * len(chunk_list)
            plain = [i for i, c in enumerate(chunk_list) if begins_and_ends_visibly(c)]
            odd = sorted(set(range(len(chunk_list))) - set(plain))
            for block in blocks(odd, lambda i: len(chunk_list[i]), BLOCK):
                for i, ids in zip(block, alone([chunk_list[i] for i in block])):
                    out[i] = ids
            rows = [plain[a:a + ROW] for a in range(0, len(plain), ROW)]
            for some in blocks(rows, lambda r: sum(len(chunk_list[i]) for i in r), BLOCK):
                joined = tok.encode_batch_fast(["".join([chunk_list[i] for i in r]) for r in some], add_special_tokens=False)
                for r, ids in zip(some, [e.ids for e in joined]):
                    ids = np.array(ids, dtype="<u4")
                    ends = np.cumsum([len(chunk_list[i].encode()) for i in r])
                    upto = np.cumsum(n_bytes[ids])
                    cut = np.searchsorted(upto, ends)
                    if not np.array_equal(upto[cut], ends):
                        raise ValueError("the tokenizer joined text across a safe space")
                    flat, begin = ids.tobytes(), 0
                    for i, end in zip(r, (4 * cut + 4).tolist()):
                        out[i] = flat[begin:end]
                        begin = end
            return out

        _MEMORIES[key] = ChunkMemory(work_out)
    return _MEMORIES[key]


def pieces_of(key: str, tokenizer_json: str, batch: pa.RecordBatch, window: int, end_id: int, with_ids: bool):
    row, start, length, crc, total, ids = [], [], [], [], [], []
    end = np.array([end_id], dtype="<u4").tobytes()
    place = 0
    for block in blocks([t or "" for t in batch.column(1).to_pylist()], len, BLOCK):
        for values in memory(key, tokenizer_json).values(block):
            encoded = b"".join(values) + end
            n = len(encoded) // 4
            for a in range(0, n, window):
                part = encoded[4 * a:4 * (a + window)]
                row.append(place)
                start.append(a)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
                if with_ids:
                    ids.append(memoryview(part).cast("I").tolist())
            place += 1
    cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    if with_ids:
        cols.append(pa.array(ids, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)


def cut(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
        end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids; all but a document's last are full."""
    tokenizer_json = Path(tokenizer).read_text(encoding="utf-8")
    json.loads(tokenizer_json)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):  # texts turn into Python strings block by block
                yield pieces_of(tokenizer, shared.value, b.slice(a, 1000), window, end_id, with_ids)

    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return ship(picked).mapInArrow(run, out)


def _pack_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not got:
            return
        t = pa.concat_tables(got)
        grp, pos = t.column("grp").to_numpy(), t.column("pos").to_numpy()
        length = t.column("length").to_numpy()
        order = np.lexsort((pos, -length, grp))
        ends = np.append(np.flatnonzero(np.diff(grp[order])) + 1, len(order))
        begin = 0
        for end in ends.tolist():
            at = order[begin:end]
            number, offset = best_fit(length[at].tolist(), window)
            ids = (int(grp[at[0]]) << 32) + np.array(number, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pos[at]), pa.array(ids), pa.array(offset, pa.int64())],
                                             names=["pos", "sequence_id", "offset"])
            begin = end

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for)."""
    pieces = store(cut(df, tokenizer, id_col, text_col, window, end_id, with_ids)
                   .withColumn("pos", F.monotonically_increasing_id()), "packing-pieces")
    full = pieces.filter(F.col("length") == window)
    rest = pieces.filter(F.col("length") < window)
    n, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-tokens // (window * GROUP_WINDOWS)), -(-n // GROUP_PIECES))
    dealt = rest.select("pos", "length", F.pmod(F.xxhash64("pos"), F.lit(groups)).cast("int").alias("grp"))
    placed = (dealt.repartition(groups, "grp").mapInArrow(_pack_task(window), "pos long, sequence_id long, offset long"))
    alone = full.withColumn("sequence_id", F.col("pos") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return rest.join(placed, "pos").unionByName(alone).drop("pos")


def sequences(packed: DataFrame, id_col: str = "id") -> DataFrame:
    """The packed sequences themselves: ids in order with the pieces they consist of (at most a window each)."""
    piece = F.struct("offset", F.col(f"`{id_col}`").alias("doc_id"), "start", "length", "ids")
    ordered = F.array_sort(F.collect_list(piece))
    return packed.groupBy("sequence_id").agg(ordered.alias("pieces")).select(
        "sequence_id", F.flatten(F.col("pieces.ids")).alias("ids"),
        F.transform("pieces", lambda p: F.struct(p["doc_id"], p["start"], p["length"], p["offset"])).alias("pieces"))
