"""N-gram Jaccard join by partitioning the universe of shingles.

A document is the set of its distinct word shingles, each a 64-bit token. Two sets
r and s of sizes r >= s reach the similarity t only if they differ in at most
H(r, s) = (1 - t) / (1 + t) * (r + s) tokens. Sizes fall into bands; in a band the
universe is cut by token hash into m > H segments, so a set that differs from
another in at most H tokens has equal tokens in all but H segments.

Index: a set stands, in its own band, under the digest of its tokens in each
segment, and in the first few segments also under the digests with one token left
out. Probe: the larger set of a pair looks up its segments in each band that holds
sizes it may be similar to; any H + 1 segments suffice, and m leaves some to choose
from. Which ones is settled by cost: a count of all tokens by hash slot bounds how
many sets can hold a segment's tokens, and the H + 1 segments of the least bound are
probed, those with tokens of the set's own before those of shared passages. Where
even some of these hold frequent tokens only, cheap segments are probed with one
deletion instead (such a segment covers one differing token and counts for two), and
where that does not suffice either, the frequent ones are probed after all, by a
join that splits hot keys.

Verification drops a pair if the parity bitmaps of the two sets (each token flips one
bit) differ in more than H bits, since every differing bit takes a differing token,
and then compares the tokens themselves. Within groups of alike sets not all
pairs are compared: in each of a few rounds every set is compared with the
best-connected set, of another component, that its digests lead to, which joins the
bulk of each group; then only pairs in different components are verified. Of sets
that share a crowded digest, all tokens are counted: a set differs from any other that
shares none of its rare tokens (those of at most RARE of these sets) in all of them, so
a pair is compared only if neither has more than similar sets of their sizes may, or if
it shares rare tokens, which a join on these finds. The sets of the fewest rare tokens
are compared first, which joins what is left of each group: by a sample of the digests, then,
for sets that this left out, by all of them. Alike sets that do not link, such as
copies with too many edits of their own, thus do not meet pair by pair. All links
between different components are found this way, so the components are those of all
pairs.

Distribution: digests travel packed, some bytes each, to buckets that grow in number
with the tokens; a bucket returns only digests that several sets share, digests of
frequent tokens do not pass through buckets. Equal sets are one set throughout.

Defined results: null text has no words; fewer words than the shingle are one
shingle; a set without tokens links with nothing, its component is its own id; a
null id loses to any other as component id; an empty table gives an empty result;
other columns are not read. Tokens are 64-bit hashes: two different shingles of one
pair of texts of 20,000 words share one with probability 1e-10.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep_one_per, ship, smallest_id, store
from ledgerlens.llm.simhash import components

SHINGLE = 5
#: similarity in percent
PERCENT = 80
#: bytes of text that are hashed at a time, and texts (a place in a packed digest has 12 bits)
CHUNK_BYTES = 1 << 20
CHUNK_TEXTS = 1 << 12
#: bytes whose words are hashed at a time, however long a text is (a longer word is taken alone)
HASH_BYTES = 1 << 18
#: tokens, once per band that sees them, whose digests are worked out at a time (at least one set in one band)
VIEW_TOKENS = 1 << 17
#: slots of the token counts
SLOTS = 1 << 20
#: slots that travel in one row
SLOT_RUN = 1 << 14
#: digests a bucket is meant to hold
BUCKET = 1_500_000
#: digests of texts whose copies a task recognises while it counts tokens
SEEN = 100_000
#: rounds in which sets are compared with one other set each
ROUNDS = 2
#: sets of a crowded digest with which each of the others is compared before all that may be similar
HUBS = 8
#: of the digests, one in so many serves those rounds
SAMPLE = 8
#: a digest of more sets is crowded: its pairs are compared only if their rare tokens allow it
CROWD = 16
#: most sets of crowded digests that hold a rare token
RARE = 16
INDEX, PROBE = 1, 2

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) % 2 ** 64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: odd factors of the words of a shingle, by place
_PLACES = mix(np.arange(64, dtype=_U), 40) | _U(1)


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Wrapping sums of values[start:end]."""
    total = np.concatenate((np.zeros(1, _U), np.cumsum(values, dtype=_U)))
    return total[end] - total[start]


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


@dataclass
class Sets:
    """Sorted distinct tokens of some texts, one text after another."""

    tokens: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of each set, whatever the order of the text."""
        end = self.start + self.size
        size = self.size.astype(_U)
        return tuple(mix(_sums(mix(self.tokens, salt), self.start, end) + size, salt) for salt in (11, 12))


#: powers of each base and of its inverse, as far as a worker has needed them
_POWERS: list[list[np.ndarray]] = [[np.zeros(0, _U)] * 2 for _ in _BASES]


def _powers(which: int, n: int) -> list[np.ndarray]:
    if len(_POWERS[which][0]) < n:
        base = _BASES[which]
        for k, factor in enumerate((base, pow(base, -1, 1 << 64))):
            power = np.full(n, factor, _U)
            power[0] = 1
            _POWERS[which][k] = np.cumprod(power, dtype=_U)
    return _POWERS[which]


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words data[start:end] under two bases, mixed into one."""
    out = np.zeros(len(start), _U)
    a = 0
    while a < len(start):  # a word's hash does not depend on where it stands
        b = max(a + 1, int(np.searchsorted(end, start[a] + HASH_BYTES, "right")))
        first = start[a]
        value = data[first:end[b - 1]].astype(_U) + _U(1)
        for which in range(len(_BASES)):
            power, back = _powers(which, len(value))
            words = _sums(value * power[:len(value)], start[a:b] - first, end[a:b] - first)
            out[a:b] = mix(out[a:b] + words * back[start[a:b] - first], which)
        a = b
    return out


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Sets:
    """The token sets of UTF-8 texts data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    data = _LOWER[data]
    space = _SPACE[data]
    first, last = np.empty(len(data), bool), np.empty(len(data), bool)
    first[1:], last[:-1] = space[:-1], space[1:]
    held = offsets[1:] > offsets[:-1]
    first[offsets[:-1][held]] = True
    last[offsets[1:][held] - 1] = True
    start, end = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    words = _word_hashes(data, start, end)
    at = np.searchsorted(start, offsets)  # first word of each text
    count = np.diff(at)
    shingles = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(int))
    whole = _spans(at[:-1], np.where(count >= shingle, shingles, 0))
    tokens = np.zeros(len(whole), _U)
    for k in range(shingle):
        tokens += words[whole + k] * _PLACES[k % 64]
    tokens = mix(tokens, 21)
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):  # one token for the whole sequence, salted by its length
        place = np.cumsum(shingles) - shingles
        merged = np.zeros(int(shingles.sum()), _U)
        long_at = np.ones(len(merged), bool)
        long_at[place[short]] = False
        merged[long_at] = tokens
        for i in short:
            own = words[at[i]:at[i + 1]]
            merged[place[i]] = mix((own * _PLACES[:len(own)]).sum(dtype=_U, keepdims=True), 30 + len(own))[0]
        tokens = merged
    end = np.cumsum(shingles)
    begin = end - shingles
    for a, b in zip(begin[shingles > 1].tolist(), end[shingles > 1].tolist()):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[begin[shingles > 0]] = True
    kept = np.concatenate((np.zeros(1, int), np.cumsum(new)))
    return Sets(tokens[new], kept[begin], kept[end] - kept[begin])


def chunked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts; null texts are empty."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    a = 0
    while a < len(column):
        b = int(np.searchsorted(ends, ends[a] + CHUNK_BYTES, "right")) - 1
        b = min(max(b, a + 1), a + CHUNK_TEXTS, len(column))
        some = pc.fill_null(column.slice(a, b - a).cast(pa.large_string()), "")  # a copy of one run, not of the whole batch
        offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset:some.offset + len(some) + 1]
        raw = some.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        yield a, b, data[offsets[0]:offsets[-1]], offsets - offsets[0]
        a = b


@dataclass
class Bands:
    """Size bands: band k holds the sizes edge[k] .. edge[k + 1] - 1 and has segments[k] segments."""

    percent: int
    edge: np.ndarray
    segments: np.ndarray

    @classmethod
    def of(cls, largest: int, percent: int) -> Bands:
        edge = [1]
        while edge[-1] <= largest:
            edge.append(edge[-1] + max(1, edge[-1] * (100 - percent) // percent))
        edges = np.array(edge)
        top = edges[1:] - 1
        h = cls.differing(top * 100 // percent, top, percent)
        return cls(percent, edges, h + 1 + cls.slack(h))

    @staticmethod
    def differing(r, s, percent: int):
        """The most tokens in which similar sets of these sizes differ."""
        return (100 - percent) * (r + s) // (100 + percent)

    @staticmethod
    def slack(h):
        """Segments that need not be probed."""
        return 1 + (h + 1) // 4

    def deletions(self, band: np.ndarray) -> np.ndarray:
        """Segments indexed with one token left out as well: all of few, some of many."""
        m = self.segments[band]
        return np.maximum(np.minimum(m, 8), 1 + m // 16)

    def of_size(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, size, "right") - 1


@dataclass
class Views:
    """Sets seen by a band: (set, band, whether it is the set's own)."""

    owner: np.ndarray
    band: np.ndarray
    own: np.ndarray


def views(size: np.ndarray, bands: Bands) -> Views:
    """Each set in every band that holds sizes from percent of its own up to its own."""
    held = np.flatnonzero(size > 0)
    n = size[held]
    top = bands.of_size(n)
    low = bands.of_size(-(-n * bands.percent // 100))
    count = top - low + 1
    owner, band = np.repeat(held, count), _spans(low, count)
    return Views(owner, band, band == np.repeat(top, count))


def digests(sets: Sets, bands: Bands, cost: np.ndarray, bar: float):
    """All index and probe digests of some sets.

    Returns (digest, set, role, cheap); digests that are not cheap are of frequent tokens or none.
    """
    v = views(sets.size, bands)
    end = np.cumsum(sets.size[v.owner])
    out, a = [], 0
    while a < len(end) or not out:  # the digests of a view do not depend on the others
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + VIEW_TOKENS, "right")))
        out.append(_digests_of(sets, Views(v.owner[a:b], v.band[a:b], v.own[a:b]), bands, cost, bar))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out))


def _digests_of(sets: Sets, v: Views, bands: Bands, cost: np.ndarray, bar: float):
    m = bands.segments[v.band]
    count = sets.size[v.owner]
    h = Bands.differing(count, np.minimum(count, bands.edge[v.band + 1] - 1), bands.percent)
    token = sets.tokens[_spans(sets.start[v.owner], count)]
    view = np.repeat(np.arange(len(m)), count)
    segment = ((token >> _U(32)) * np.repeat(m, count).astype(_U) >> _U(32)).astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (view[1:] != view[:-1]) | (segment[1:] != segment[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(token))
    first = np.cumsum(m) - m  # a row for every segment of every view
    row = first[view[start]] + segment[start]
    rows = int(m.sum())
    total, least = np.zeros(rows, _U), np.full(rows, np.inf)
    mixed, own_cost = mix(token, 5), cost[(token & _U(SLOTS - 1)).astype(np.int64)].astype(np.float64)
    if len(start):
        total[row], least[row] = _sums(mixed, start, end), np.minimum.reduceat(own_cost, start)
    row_view = np.repeat(np.arange(len(m)), m)
    place = np.arange(rows) - first[row_view]
    base = mix((v.band[row_view].astype(_U) << _U(32)) + place.astype(_U), 6)
    cheap = least < bar
    order = np.lexsort((least, row_view))
    probed = np.zeros(rows, bool)
    probed[order] = place <= h[row_view]  # the h + 1 cheapest: within a view, ``place`` counts the order too
    reach = bands.deletions(v.band)
    lacking = np.bincount(row_view, probed & ~cheap, minlength=len(m)).astype(np.int64)
    shortened = np.zeros(rows, bool)
    if lacking.any():
        loose = np.zeros(rows, bool)
        loose[row] = _second_least(own_cost, start, end) < bar  # whichever token is left out, a rare one stays
        for k in np.flatnonzero(lacking).tolist():
            mine = np.arange(first[k], first[k] + m[k])
            up = mine[probed[mine] & loose[mine] & (place[mine] < reach[k])][:lacking[k]]
            shortened[up] = True
            dear = mine[probed[mine] & ~cheap[mine]]
            probed[dear[np.argsort(-least[dear], kind="stable")][:len(up)]] = False
    role = np.where(v.own[row_view], INDEX, 0) | np.where(probed, PROBE, 0)
    use = role > 0
    out = [(mix(total + base)[use], v.owner[row_view][use], role[use], cheap[use])]
    if len(start):  # with one token left out; digests of frequent tokens are never probed so
        token_row = np.repeat(row, end - start)
        rest = _least_without(own_cost, start, end) < bar
        for pick, kind in ((v.own[view] & (segment < reach[view]), INDEX), (shortened[token_row], PROBE)):
            left = np.flatnonzero(pick & rest)
            d = mix(total[token_row[left]] - mixed[left] + base[token_row[left]])
            out.append((d, v.owner[view[left]], np.full(len(left), kind), np.ones(len(left), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _second_least(cost: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The second smallest cost of each segment, infinite where it has one token."""
    rest = _least_without(cost, start, end)
    return np.maximum.reduceat(rest, start) if len(start) else np.zeros(0)


def _least_without(cost: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each token, the smallest cost among the others of its segment."""
    count = end - start
    least = np.minimum.reduceat(cost, start)
    segment = np.repeat(np.arange(len(start)), count)
    lowest = cost == least[segment]
    once = np.bincount(segment, lowest, minlength=len(start)) == 1
    other = np.minimum.reduceat(np.where(lowest, np.inf, cost), start)
    return np.where(lowest & once[segment], other[segment], least[segment])


# --- over tables ---------------------------------------------------------------

def _described(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, n, d1, d2) of every text, and rows (run, seen) that count tokens by slot; copies met by one task count once."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int32)
        met: set = set()
        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for a, e, data, offsets in chunked(b.column(1)):
                sets = sets_of(data, offsets, shingle)
                d1, d2 = sets.digests()
                fresh = np.array([k not in met for k in d1.tolist()])
                if len(met) < SEEN:
                    met.update(d1.tolist())
                counted = sets.tokens[np.repeat(fresh, sets.size)]
                np.add.at(seen, (counted & _U(SLOTS - 1)).astype(np.int64), 1)
                none = pa.nulls(e - a, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, e - a), pa.array(sets.size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), none, pa.nulls(e - a, counts)],
                    names=["id", "n", "d1", "d2", "run", "seen"])
        if id_type is not None:
            runs = SLOTS // SLOT_RUN
            none = pa.nulls(runs, pa.int64())
            cut = pa.array(np.arange(runs + 1) * SLOT_RUN, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(runs, id_type), none, none, none, pa.array(np.arange(runs), pa.int32()),
                                              pa.ListArray.from_arrays(cut, pa.array(seen))], names=["id", "n", "d1", "d2", "run", "seen"])

    counts = pa.list_(pa.int32())
    return ship(picked).mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, run int, seen array<int>")


_PACKED = ("bucket int, low array<int>, who array<short>, dear array<long>, dear_who array<short>, "
           "d1 array<long>, d2 array<long>, n array<int>")


def _packed(texts: DataFrame, shingle: int, bands: Bands, cost: np.ndarray, bar: float, buckets: int) -> DataFrame:
    """Digests packed by bucket. ``who`` is a place in the row's table of sets times four plus the role."""
    shared = texts.sparkSession.sparkContext.broadcast(cost)  # a fixed number of slots

    def lists(values: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))

    def rows(group, value, owner, role, named, size, dear: bool) -> pa.RecordBatch:
        order = np.lexsort((owner, group))
        group, value, owner, role = group[order], value[order], owner[order], role[order]
        tables, where = np.unique(group * CHUNK_TEXTS + owner, return_inverse=True)
        t_owner = tables % CHUNK_TEXTS
        present, counts = np.unique(group, return_counts=True)
        cut = np.concatenate(([0], np.cumsum(counts)))
        t_cut = np.concatenate((np.searchsorted(tables // CHUNK_TEXTS, present), [len(tables)]))
        who = lists((where - np.repeat(t_cut[:-1], counts)) * 4 + role, cut, pa.int16())
        none = np.zeros(len(present) + 1, int)
        if dear:
            digest = [lists(none[:0], none, pa.int32()), lists(none[:0], none, pa.int16()), lists(value.view(np.int64), cut, pa.int64()), who]
        else:
            low = (value & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            digest = [lists(low, cut, pa.int32()), who, lists(none[:0], none, pa.int64()), lists(none[:0], none, pa.int16())]
        d1, d2 = named
        return pa.RecordBatch.from_arrays(
            [pa.array(present, pa.int32()), *digest, lists(d1[t_owner].view(np.int64), t_cut, pa.int64()),
             lists(d2[t_owner].view(np.int64), t_cut, pa.int64()), lists(size[t_owner], t_cut, pa.int32())],
            names=["bucket", "low", "who", "dear", "dear_who", "d1", "d2", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in chunked(b.column(0)):
                sets = sets_of(data, offsets, shingle)
                value, owner, role, cheap = digests(sets, bands, shared.value, bar)
                bucket = ((value >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                named = sets.digests()
                if cheap.any():
                    yield rows(bucket[cheap], value[cheap], owner[cheap], role[cheap], named, sets.size, False)
                if not cheap.all():  # digests of frequent tokens go anywhere, to be joined by their whole value
                    anywhere = np.full(int((~cheap).sum()), int(named[0][0] % _U(buckets)), np.int64)
                    yield rows(anywhere, value[~cheap], owner[~cheap], role[~cheap], named, sets.size, True)

    return texts.mapInArrow(run, _PACKED)


_ENTRY = "digest long, d1 long, d2 long, n int, role int, dear boolean"


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """Digests of a bucket that several sets share, some of them probing and some indexed; and all digests of frequent tokens."""
    def flat(b: pa.RecordBatch, name: str) -> np.ndarray:
        return b.column(name).flatten().to_numpy(zero_copy_only=False)

    def table(batches: list[pa.RecordBatch], digest: str, who: str, wanted: np.ndarray | None = None):
        """(digest, d1, d2, n, role) of each entry, or of those whose digest is among the wanted (sorted)."""
        parts = []
        for b in batches:
            sizes = np.array(pc.list_value_length(b.column("n")))
            cut = np.cumsum(sizes) - sizes
            counts = np.array(pc.list_value_length(b.column(who)))
            value, packed_who, cut = flat(b, digest), flat(b, who), np.repeat(cut, counts)
            if wanted is not None:
                place = np.minimum(np.searchsorted(wanted, value), max(len(wanted) - 1, 0))
                use = np.flatnonzero(wanted[place] == value) if len(wanted) else np.zeros(0, int)
                value, packed_who, cut = value[use], packed_who[use], cut[use]
            packed_who = packed_who.astype(np.int64)
            at = (packed_who >> 2) + cut
            parts.append((value.astype(np.int64), *[flat(b, c)[at] for c in ("d1", "d2", "n")], packed_who & 3))
        return [np.concatenate(x) for x in zip(*parts)]

    def rows(digest, d1, d2, n, role, dear: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int32()),
             pa.array(role, pa.int32()), pa.array(np.full(len(digest), dear))], names=["digest", "d1", "d2", "n", "role", "dear"])

    def bucket_rows(bucket: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.sort(np.concatenate([flat(b, "low") for b in batches]))
        again = low[1:] == low[:-1]  # a digest met once is shared by nobody: its set is not looked up
        digest, d1, d2, n, role = table(batches, "low", "who", np.unique(low[1:][again]))
        order = np.lexsort((d2, d1, digest))
        digest, d1, d2, n, role = (x[order] for x in (digest, d1, d2, n, role))
        same_digest = np.concatenate(([False], digest[1:] == digest[:-1]))
        same = same_digest.copy()
        same[1:] &= (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
        kept = np.flatnonzero(~same)  # copies of a set are one
        role = np.bitwise_or.reduceat(role, kept) if len(kept) else role
        digest, d1, d2, n, same_digest = (x[kept] for x in (digest, d1, d2, n, same_digest))
        start = np.flatnonzero(~same_digest)
        if not len(start):
            return
        size = np.diff(np.append(start, len(digest)))
        probing = np.bitwise_or.reduceat(role, start) == INDEX | PROBE
        several = (np.maximum.reduceat(d1, start) != np.minimum.reduceat(d1, start)) | (np.maximum.reduceat(d2, start) != np.minimum.reduceat(d2, start))
        use = np.repeat(several & probing, size)
        if use.any():
            yield rows((bucket << 32) | (digest[use] & 0xFFFFFFFF), d1[use], d2[use], n[use], role[use], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, waiting = -1, []
        for b in batches:
            dear = b.filter(pc.greater(pc.list_value_length(b.column("dear")), 0))
            if len(dear):
                yield rows(*table([dear], "dear", "dear_who"), True)
            b = b.filter(pc.greater(pc.list_value_length(b.column("low")), 0))
            if not len(b):
                continue
            bucket = b.column("bucket").to_numpy()
            cut = np.flatnonzero(np.diff(bucket)) + 1
            for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(b)]):
                if int(bucket[a]) != open_bucket and waiting:
                    yield from bucket_rows(open_bucket, waiting)
                    waiting = []
                open_bucket = int(bucket[a])
                waiting.append(b.slice(a, e - a))
        if waiting:
            yield from bucket_rows(open_bucket, waiting)

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ENTRY)


def parities(sets: Sets) -> pa.Array:
    """A bitmap per set, a power of two of at least 512 bits and twice its size, in which each token flips one bit."""
    spot = mix(sets.tokens, 50)
    words, cut = [], [0]
    for a, n in zip(sets.start.tolist(), sets.size.tolist()):
        bits = max(512, 1 << (2 * n - 1).bit_length()) if n else 512
        odd = np.bincount((spot[a:a + n] & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
        words.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
        cut.append(cut[-1] + bits // 64)
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)))


def _token_lists(sets: Sets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(sets.start, len(sets.tokens)), pa.int32()), pa.array(sets.tokens.view(np.int64)))


def _of_texts(df: DataFrame, wanted: DataFrame, reps: DataFrame, id_col: str, text_col: str, shingle: int, made, name: str) -> DataFrame:
    """(sid, longs): what ``made`` gives for the wanted sets (sid, d1, d2), hashed again from their representatives' texts.

    A bitmap of hashed ids (a fixed number of words) leaves out most texts before they are moved.
    """
    slots = 1 << 20
    ids = wanted.join(reps, ["d1", "d2"]).select(F.col("best.id").alias("rep"))
    spot = F.pmod(F.xxhash64(F.col("rep").cast("string")), F.lit(slots))
    words = ids.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))  # at most slots / 64 rows
    picked = df.select(F.col(f"`{id_col}`").cast("string").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("text"))
    near = picked.withColumn("spot", spot).withColumn("word", F.shiftright("spot", 6)).join(F.broadcast(words), "word")
    near = near.filter(F.expr("bits & shiftleft(1L, cast(spot & 63 as int))") != 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in chunked(b.column(0)):
                sets = sets_of(data, offsets, shingle)
                d1, d2 = sets.digests()
                yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), made(sets)], names=["d1", "d2", "longs"])

    hashed = near.mapInArrow(run, "d1 long, d2 long, longs array<long>")
    return store(keep_one_per(hashed.join(wanted, ["d1", "d2"]).select("sid", "longs"), ["sid"]), name)


def _bits_allow(percent: int):
    """Whether the bitmaps a and b of sets of sizes nu and nv differ in no more bits than similar sets may in tokens."""
    least = F.least(F.size("a"), F.size("b"))  # lengths of sets of like size are equal or one is twice the other

    def folded(x: str):
        return F.when(F.size(x) == least, F.col(x)).otherwise(F.transform(F.slice(x, 1, least), lambda w, i: w.bitwiseXOR(F.get(x, i + least))))

    differing = F.aggregate(F.zip_with(folded("a"), folded("b"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, n: acc + n)
    return differing <= F.expr(f"({100 - percent} * (nu + nv)) div {100 + percent}")


def _perhaps(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose bitmaps (sid, n, longs) allow it."""
    sided = pairs.join(bitmaps.toDF("v", "nv", "b"), "v").join(bitmaps.toDF("u", "nu", "a"), "u")
    return sided.filter(_bits_allow(percent)).select("u", "v")


def _linked(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose tokens reach the similarity."""
    sided = pairs.join(tokens.toDF("v", "b"), "v").join(tokens.toDF("u", "a"), "u")
    both = F.size(F.array_intersect("a", "b"))
    either = F.size("a") + F.size("b") - both
    return store(sided.filter(100 * both >= percent * either).select("u", "v"), "ngram-links")


def _near(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _allowed(rare_u: str, rare_v: str, percent: int):
    """Whether sets u and v of sizes nu and nv may be similar when they hold so many tokens that the other lacks."""
    h = f"({100 - percent} * (nu + nv)) div {100 + percent}"
    return F.expr(f"2 * ({rare_u}) <= {h} + nu - nv AND 2 * ({rare_v}) <= {h} + nv - nu")


def _candidates(probes: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that meet; u probes and is the larger (of equal sizes: the later).

    ``rare`` (null: not counted): the tokens that few sets hold; pairs with one in common are found by these. Where both
    sets are counted, their bitmaps (``longs``) are compared as they meet, so that only pairs that may be similar become rows.
    """
    own = probes.select("digest", F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu"), F.col("rare").alias("ru"), F.col("longs").alias("a"))
    other = index.select("digest", F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("label").alias("lv"), F.col("rare").alias("rv"), F.col("longs").alias("b"))
    met = own.join(other, "digest").filter("lu <> lv AND (nu > nv OR (nu = nv AND u > v))").filter(_near("nu", "nv", percent))
    return met.filter(F.expr("ru IS NULL OR rv IS NULL") | (_allowed("ru", "rv", percent) & _bits_allow(percent))).select("u", "v").distinct()


def _crowded(entries: DataFrame) -> DataFrame:
    """(sid, n, label) of the sets that share a digest with many."""
    crowds = entries.groupBy("digest").agg(F.count(F.lit(1)).alias("crowd")).filter(F.col("crowd") > CROWD).select("digest")
    return entries.join(crowds, "digest").select("sid", "n", "label").distinct()


def _rare_tokens(crowded: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the crowded sets, whose tokens are given: (sid, n, label, rare), the number of rare tokens; and (token, sid) of
    the rare ones that several hold."""
    held = tokens.select("sid", F.explode("longs").alias("token"))
    holders = held.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") <= RARE)
    rare = store(held.join(holders, "token"), "ngram-rare-tokens")
    counted = crowded.join(rare.groupBy("sid").agg(F.count(F.lit(1)).cast("int").alias("rare")), "sid", "left")
    return store(counted.fillna(0, ["rare"]), "ngram-crowded"), rare.filter("holders > 1").select("token", "sid")


def _rare_pairs(counted: DataFrame, several: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that share rare tokens, and enough of them."""
    own = several.join(counted.select("sid", "n", "label", "rare"), "sid")
    sides = [own.select("token", *[F.col(c).alias(c2) for c, c2 in zip(("sid", "n", "label", "rare"), names)])
             for names in (("u", "nu", "lu", "ru"), ("v", "nv", "lv", "rv"))]
    met = sides[0].join(sides[1], "token").filter("lu <> lv AND (nu > nv OR (nu = nv AND u > v))").filter(_near("nu", "nv", percent))
    shared = met.groupBy("u", "v", "nu", "nv", "ru", "rv").agg(F.count(F.lit(1)).alias("both"))
    return shared.filter(_allowed("ru - both", "rv - both", percent)).select("u", "v")


def _unsettled(entries: DataFrame, links: DataFrame) -> DataFrame:
    """The entries, with ``label`` (the component so far), of the digests that sets of several components share."""
    label = components(links).toDF("sid", "label")
    labelled = entries.drop("label").join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = labelled.groupBy("digest").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_or("role").alias("roles"))
    mixed = mixed.filter(f"lo <> hi AND roles = {INDEX | PROBE}").select("digest")
    return store(labelled.join(mixed, "digest"), "ngram-unsettled")


def _first_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each set with the best-connected set of another component to which most of its digests lead.

    Every SAMPLE-th digest will do: what these pairs leave open is compared afterwards.
    """
    entries = entries.filter(F.pmod("digest", F.lit(SAMPLE)) == 0)
    crowd = entries.groupBy("digest").agg(F.count(F.lit(1)).alias("crowd"))
    weight = entries.join(crowd, "digest").groupBy("sid").agg(F.sum("crowd").alias("weight"))
    hub = entries.join(weight, "sid").groupBy("digest").agg(F.max(F.struct("weight", "sid", "label", "n")).alias("hub"))
    met = entries.join(hub, "digest").filter("label <> hub.label").filter(_near("n", "hub.n", percent))
    best = met.groupBy("sid", F.col("hub.sid").alias("hub")).agg(F.count(F.lit(1)).alias("c"))
    best = best.groupBy("sid").agg(F.max(F.struct("c", "hub")).alias("b"))
    return best.select(F.greatest("sid", "b.hub").alias("u"), F.least("sid", "b.hub").alias("v")).distinct()


def _closest_pairs(entries: DataFrame, percent: int, sample: int) -> DataFrame:
    """Each crowded set with the sets of other components, one of each of HUBS parts, that lead most of its digests,
    of which one in ``sample`` serves: a digest is led by the set of the fewest rare tokens, which is the closest to
    what its sets have in common."""
    entries = entries.filter(F.col("rare").isNotNull() & (F.pmod("digest", F.lit(sample)) == 0))
    hub = entries.groupBy("digest", F.pmod(F.xxhash64("sid"), F.lit(HUBS)).alias("part")).agg(
        F.min(F.struct("rare", "sid", "label", "n")).alias("hub"))
    met = entries.join(hub, "digest").filter("label <> hub.label").filter(_near("n", "hub.n", percent))
    met = met.select("sid", "part", F.col("hub.sid").alias("hub"), F.col("rare").alias("ru"), F.col("hub.rare").alias("rv"),
                     F.col("n").alias("nu"), F.col("hub.n").alias("nv")).filter(_allowed("ru", "rv", percent))
    best = met.groupBy("sid", "part", "hub", "rv").agg(F.count(F.lit(1)).alias("c"))
    best = best.groupBy("sid", "part").agg(F.max(F.struct("c", -F.col("rv"), "hub")).alias("b"))
    return best.select(F.greatest("sid", "b.hub").alias("u"), F.least("sid", "b.hub").alias("v")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    described = store(_described(df, id_col, text_col, shingle), "ngram-sets")
    sets = described.filter("run IS NULL").drop("run", "seen")
    reps = store(sets.filter("n > 0").groupBy("d1", "d2").agg(F.any_value("n").alias("n"), F.min(smallest_id(F.col("id"))).alias("best")), "ngram-representatives")
    found = _components(df, described, reps, id_col, text_col, shingle, percent)
    named = reps.select("d1", "d2", "best") if found is None else reps.join(found, ["d1", "d2"], "left").select(
        "d1", "d2", F.coalesce("of_all", "best").alias("best"))
    return sets.join(named, ["d1", "d2"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("best.id")).otherwise(F.col("id")).alias("component_id"))


def token_costs(described: DataFrame) -> tuple[np.ndarray, float]:
    """(how often tokens of each slot occur, the bound from which they count as frequent)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # the runs of this task
        for b in batches:
            for k, seen in zip(b.column("run").to_pylist(), b.column("seen")):
                total[k] = total.get(k, 0) + seen.values.to_numpy().astype(np.float32)
        for k, seen in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen], pa.list_(pa.float32()))], names=["run", "seen"])

    cost = np.zeros(SLOTS, np.float32)
    runs = described.filter("run IS NOT NULL").select("run", "seen").repartition("run").mapInArrow(run, "run int, seen array<float>")
    for b in runs.toArrow().to_batches():  # a fixed number of slots
        for k, seen in zip(b.column("run").to_pylist(), b.column("seen")):
            cost[k * SLOT_RUN:(k + 1) * SLOT_RUN] = seen.values.to_numpy()
    return cost, 64.0 + 8.0 * float(cost.mean())


def _components(df: DataFrame, described: DataFrame, reps: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame | None:
    """(d1, d2, of_all): the smallest id of the component, for sets that link with another; None if there are none."""
    largest, total = reps.agg(F.max("n"), F.sum("n")).first()
    if largest is None:
        return None
    bands = Bands.of(largest, percent)
    cost, bar = token_costs(described)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, int(total * 0.6 / BUCKET) + 1)  # about 0.6 digests a token
    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    entries = store(_shared(_packed(texts, shingle, bands, cost, bar, buckets), buckets), "ngram-shared")
    dear = entries.filter("dear")
    asked = dear.filter(f"role & {PROBE} <> 0").select("digest").distinct()
    entries = entries.filter("NOT dear").union(dear.join(asked, "digest").select(*entries.columns).distinct()).drop("dear")
    if entries.isEmpty():
        return None
    nodes = store(entries.select("d1", "d2").distinct().withColumn("sid", F.monotonically_increasing_id()), "ngram-nodes")
    entries = store(entries.join(nodes, ["d1", "d2"]).drop("d1", "d2"), "ngram-entries")

    sizes = nodes.join(reps.select("d1", "d2", F.col("n").cast("int").alias("n")), ["d1", "d2"]).select("sid", "n")
    bitmaps = _of_texts(df, nodes, reps, id_col, text_col, shingle, parities, "ngram-bitmaps")
    bitmaps = store(sizes.join(bitmaps, "sid"), "ngram-sized-bitmaps")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = store(_perhaps(pairs, bitmaps, percent), name)
        tokens = _of_texts(df, _named(pairs, nodes), reps, id_col, text_col, shingle, _token_lists, "ngram-tokens")
        return _linked(pairs, tokens, percent)

    rest = entries.withColumn("label", F.col("sid"))
    links = None
    for _ in range(ROUNDS):  # the bulk of each group
        found = verified(_first_pairs(rest, percent), "ngram-first-pairs")
        links = found if links is None else links.union(found)
        rest = _unsettled(rest, links)
    crowded = store(_crowded(rest), "ngram-crowded-sets")
    tokens = _of_texts(df, crowded.select("sid").join(nodes, "sid"), reps, id_col, text_col, shingle, _token_lists, "ngram-crowded-tokens")
    counted, several = _rare_tokens(crowded, tokens)

    def with_rare(entries: DataFrame) -> DataFrame:
        return entries.join(counted.select("sid", "rare"), "sid", "left")

    for sample in (SAMPLE, 1):  # a set none of whose digests was sampled would meet all of its group
        close = store(_perhaps(_closest_pairs(with_rare(rest), percent, sample), bitmaps, percent), "ngram-closest-pairs")
        links = links.union(_linked(close, tokens, percent))
        rest = _unsettled(rest, links)
    rest = rest.join(counted.select("sid", "rare").join(bitmaps.select("sid", "longs"), "sid"), "sid", "left")
    label = rest.select("sid", F.col("label").alias("now")).distinct()
    counted = counted.join(label, "sid").withColumn("label", F.col("now")).drop("now")
    pairs = _candidates(rest.filter(f"role & {PROBE} <> 0"), rest.filter(f"role & {INDEX} <> 0"), percent)
    links = links.union(verified(pairs.union(_rare_pairs(counted, several, percent)).distinct(), "ngram-pairs"))

    roots = components(links).toDF("sid", "root")
    roots = roots.union(roots.select("root", "root")).distinct()
    members = store(roots.join(nodes, "sid").join(reps.select("d1", "d2", "best"), ["d1", "d2"]), "ngram-members")
    smallest = members.groupBy("root").agg(F.min("best").alias("of_all"))
    return members.select("d1", "d2", "root").join(smallest, "root").select("d1", "d2", "of_all")


def _named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(nodes, "sid")
