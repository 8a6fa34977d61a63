"""Byte-level BPE by DuckDB recursive queries, run per partition.

A recursive query holds one row per token position of every distinct piece of
text, joins neighbouring tokens to the merge table, contracts each piece's
leftmost pair of the lowest rank and repeats until no pair is left; ordered
aggregation then lists the ids and decodes them again. Short words have one
such contraction per round; in long words a round makes all whose order is
settled: the occurrences of the lowest pair from left to right, up to the first
whose new token opens a lower-ranked pair (that one goes first in the next
round). Either way a pair is also contracted ahead of its turn where the merge
table rules out any other outcome (no merge that could take the left token from
the left, the right token from the right, or the new token, ranks as low). A
piece is cut beforehand between two bytes that no token of the vocabulary holds
side by side. The result is that of contracting one pair at a time.

Texts are cut at safe places (``chunks``) and split by the public pattern;
each distinct piece enters a query once per worker and block of text, so
memory depends on the block and not on the partition.

Defined results: null text is empty (no ids); a text of any length is encoded
whole; repeated rows each give a row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.chunks import ChunkMemory, Memory, blocks
from ledgerlens.llm.common import ship

#: chunks and pieces per generation that a worker remembers, with ids and decoded bytes
REMEMBERED = 600_000
#: characters of text whose new pieces go through one recursive query
BLOCK = 2_000_000

#: one contraction per round and word, besides those that are certain: for the many short words
SHORT_FIXPOINT = """
WITH RECURSIVE u(round, pos, word, tok) AS (
    SELECT 0, pos, word, tok FROM pieces
  UNION ALL
    (WITH pairs AS (
       SELECT round, pos, word, tok, lead(tok) OVER w AS next_tok, lead(word) OVER w AS next_word
       FROM u WINDOW w AS (ORDER BY pos)),
     ranked AS (
       SELECT p.round, p.pos, p.word, p.tok, m.rank, m.certain, m.rank::BIGINT * 4294967296 + p.pos AS turn
       FROM pairs AS p LEFT JOIN merges AS m
         ON m.l = p.tok AND m.r = CASE WHEN p.next_word = p.word THEN p.next_tok END),
     lowest AS (SELECT word, min(turn) AS turn FROM ranked WHERE turn IS NOT NULL GROUP BY word),
     chosen AS (
       SELECT r.round, r.pos, r.word, r.tok, CASE WHEN r.certain OR r.turn = l.turn THEN r.rank END AS made
       FROM ranked AS r JOIN lowest AS l ON l.word = r.word),
     contracted AS (
       SELECT round + 1 AS round, pos, word, coalesce(made, tok) AS tok, lag(made) OVER (ORDER BY pos) AS swallowed_by
       FROM chosen)
     SELECT round, pos, word, tok FROM contracted WHERE swallowed_by IS NULL)
), t AS (
    SELECT u.pos, u.word, u.tok
    FROM u JOIN (SELECT word, max(round) AS round FROM u GROUP BY word) AS last ON last.word = u.word AND last.round = u.round
)
"""

#: all contractions whose order is settled in one round: for long words
LONG_FIXPOINT = """
WITH RECURSIVE t(pos, word, tok) USING KEY (pos) AS (
    SELECT pos, word, tok FROM pieces
  UNION
    (WITH live AS (
       SELECT r.pos, r.word, r.tok FROM recurring.t AS r
       WHERE r.tok IS NOT NULL AND r.word IN (SELECT word FROM t)),
     pairs AS (
       SELECT pos, word, tok, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos, lead(word) OVER w AS next_word,
              lag(tok) OVER w AS left_tok, lag(word) OVER w AS left_word,
              lead(tok, 2) OVER w AS right_tok, lead(word, 2) OVER w AS right_word, row_number() OVER w AS k
       FROM live WINDOW w AS (ORDER BY pos)),
     ranked AS (
       SELECT p.pos, p.word, p.next_pos, p.k, m.rank, m.certain,
              CASE WHEN p.left_word = p.word THEN p.left_tok END AS left_tok,
              CASE WHEN p.right_word = p.word THEN p.right_tok END AS right_tok
       FROM pairs AS p JOIN merges AS m ON m.l = p.tok AND m.r = p.next_tok WHERE p.next_word = p.word),
     lowest AS (SELECT word, min(rank) AS rank FROM ranked GROUP BY word),
     hits AS (
       SELECT r.*, r.k - row_number() OVER (ORDER BY r.pos) AS run
       FROM ranked AS r JOIN lowest AS l ON l.word = r.word AND l.rank = r.rank WHERE NOT r.certain),
     apart AS (
       SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY run ORDER BY pos) % 2 = 1),
     placed AS (
       SELECT pos, word, next_pos, right_tok, rank,
              CASE WHEN k - lag(k) OVER (ORDER BY pos) = 2 AND lag(word) OVER (ORDER BY pos) = word THEN rank
                   ELSE left_tok END AS left_tok
       FROM apart),
     judged AS (
       SELECT p.pos, p.word, p.next_pos, p.rank, coalesce(a.rank < p.rank, false) OR coalesce(b.rank < p.rank, false) AS opens_lower
       FROM placed AS p
       LEFT JOIN merges AS a ON a.l = p.left_tok AND a.r = p.rank
       LEFT JOIN merges AS b ON b.l = p.rank AND b.r = p.right_tok),
     in_turn AS (
       SELECT pos, word, next_pos, rank FROM judged
       QUALIFY coalesce(sum(opens_lower::INTEGER) OVER (
         PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0),
     contracted AS (
       FROM in_turn
       UNION ALL
       SELECT pos, word, next_pos, rank FROM ranked WHERE certain)
     SELECT pos, word, rank FROM contracted
     UNION ALL
     SELECT next_pos, word, CAST(NULL AS INTEGER) FROM contracted)
)
"""

#: ordered aggregation lists the ids and decodes them
LISTED = """
SELECT t.word, list(t.tok ORDER BY t.pos) AS ids, string_agg(v.hex, '' ORDER BY t.pos) AS decoded
FROM t JOIN vocabulary AS v ON v.tok = t.tok
GROUP BY t.word ORDER BY t.word
"""

#: bytes of a word that counts as long
LONG = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with Path(path).open("rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """A vocabulary in an in-memory DuckDB, for the pieces of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import numpy as np
        import regex

        self.ranks = ranks
        # the pattern's white space is Unicode White_Space, without the four separators that Python adds
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        none = len(ranks) + 1
        as_left, as_right = {}, {}  # lowest rank of the merges in which a token is the left or the right part
        for a, b, r in merges:
            as_left[a] = min(r, as_left.get(a, none))
            as_right[b] = min(r, as_right.get(b, none))
        lasting = [min(as_left.get(r, none), as_right.get(r, none)) > r for _, _, r in merges]
        certain = [ok and as_right.get(a, none) > r and as_left.get(b, none) > r for (a, b, r), ok in zip(merges, lasting)]
        self.joined = np.zeros((256, 256), dtype=bool)  # two bytes side by side in some token
        for t in ranks:
            for i in range(len(t) - 1):
                self.joined[t[i], t[i + 1]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        table = pa.table({"l": pa.array([m[0] for m in merges], pa.int32()), "r": pa.array([m[1] for m in merges], pa.int32()),
                          "rank": pa.array([m[2] for m in merges], pa.int32()),
                          "certain": pa.array(certain)})
        words = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db.register("merges_in", table)
        self.db.register("words_in", words)
        self.db.execute("CREATE TABLE merges AS FROM merges_in; CREATE TABLE vocabulary AS FROM words_in")
        self.pieces = Memory(self.encode_pieces, limit=REMEMBERED)
        self.memory = ChunkMemory(self.encode_chunks, limit=REMEMBERED)

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """piece -> (ids as little-endian unsigned 32-bit integers, decoded bytes)."""
        import numpy as np

        raw = [p.encode() for p in pieces]
        out = {}
        open_ = []
        for p, b in zip(pieces, raw):
            whole = self.ranks.get(b)  # a piece that is a token itself needs no merges
            if whole is None:
                open_.append((p, b))
            else:
                out[p] = (whole.to_bytes(4, "little"), b)
        if not open_:
            return out
        joined = np.frombuffer(b"".join(b for _, b in open_), dtype=np.uint8)
        head = np.zeros(len(joined), dtype=bool)
        ends = np.cumsum([len(b) for _, b in open_])
        head[1:] = ~self.joined[joined[:-1], joined[1:]]
        head[ends[:-1]] = True
        head[0] = True
        word = np.cumsum(head).astype(np.int32) - 1
        starts = np.flatnonzero(head)
        long_word = np.diff(np.append(starts, len(joined))) > LONG
        ids_of: list = [b""] * len(starts)
        decoded_of: list = [b""] * len(starts)
        for query, pick in ((SHORT_FIXPOINT, ~long_word), (LONG_FIXPOINT, long_word)):
            if not pick.any():
                continue
            at = np.flatnonzero(pick[word]).astype(np.int32)
            self.db.register("pieces", pa.table({"pos": at, "word": word[at], "tok": self.byte_ids[joined[at]]}))
            found = self.db.sql(query + LISTED).to_arrow_table()
            self.db.unregister("pieces")
            ids = found.column("ids").combine_chunks()
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            hexed = found.column("decoded")
            decoded = bytes.fromhex("".join(hexed.to_pylist()))
            begin = first = 0
            for w, end, last in zip(found.column("word").to_pylist(), (4 * np.cumsum(np.asarray(ids.value_lengths()))).tolist(),
                                    (np.cumsum(pc.binary_length(hexed).to_numpy()) // 2).tolist()):
                ids_of[w], decoded_of[w], begin, first = flat[begin:end], decoded[first:last], end, last
        first = 0
        for (p, _), end in zip(open_, (word[ends - 1] + 1).tolist()):  # a piece is one word or several in a row
            if end == first + 1:
                out[p] = (ids_of[first], decoded_of[first])
            else:
                out[p] = (b"".join(ids_of[first:end]), b"".join(decoded_of[first:end]))
            first = end
        return out

    def encode_chunks(self, chunk_list: list[str]) -> list[tuple[bytes, bytes]]:
        # a space and ASCII letters are one piece of either public pattern
        split = [c if (w := c[1:] if c[:1] == " " else c).isascii() and w.isalpha() else self.split(c) for c in chunk_list]
        several = [s for s in split if s.__class__ is list]
        known = self.pieces.values_of({s for s in split if s.__class__ is str}.union(*several))
        several = iter([join_parts([known[p] for p in s]) for s in several])
        return [known[s] if s.__class__ is str else next(several) for s in split]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        for block in blocks(texts, len, BLOCK):
            with no_collector():
                found = [join_parts(values) for values in self.memory.values(block)]
            yield from found


@contextmanager
def no_collector() -> Iterator[None]:
    """Without the search for reference cycles, which walks all that is remembered: strings and bytes form none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def join_parts(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """The ids and decoded bytes of consecutive pieces as one."""
    if len(parts) == 1:
        return parts[0]
    ids, decoded = zip(*parts) if parts else ((), ())
    return b"".join(ids), b"".join(decoded)


_ENCODERS: dict[str, Encoder] = {}


def encoder(key: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def digest_batch(key: str, ranks, pattern: str, batch: pa.RecordBatch, with_ids: bool) -> pa.RecordBatch:
    texts = [t or "" for t in batch.column(1).to_pylist()]
    n, ids_sha, decoded_sha, ids = [], [], [], []
    for encoded, decoded in encoder(key, ranks, pattern).encode(texts):
        n.append(len(encoded) // 4)
        ids_sha.append(hashlib.sha256(encoded).hexdigest())
        decoded_sha.append(hashlib.sha256(decoded).hexdigest())
        if with_ids:
            ids.append(memoryview(encoded).cast("I").tolist())
    cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        cols.append(pa.array(ids, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    ``vocabulary`` is the path of a tiktoken rank file; the driver reads it and
    sends the ranks along, so workers need not have the file.
    """
    ranks = read_ranks(vocabulary)
    key = f"{vocabulary}|{pattern}"
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield digest_batch(key, shared.value, pattern, b, with_ids)

    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return ship(picked).mapInArrow(run, out)
