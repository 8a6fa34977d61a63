"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Labelled examples form a block-max inverted index over all their words: the
postings of a word are cut into blocks of examples, each with the largest weight
it holds. A document's possible similarity to a block is bounded by the block
maxima of its words, so blocks are opened best bound first and the search ends
when no unopened block can still reach the k-th best: the k nearest are exact.
Neighbours vote by similarity and are the evidence. A second vote is taken by the
same search over the words that go with the label alone (chi-square), since few
words of a text tell; a logistic fit on leave-one-out votes of the examples makes
both a probability.

What is bounded: the examples (``max_examples``, drawn from the labelled rows
by a hash of their id) and the words of the second vote (``max_terms``, those of
at least MIN_CHI2). Document frequencies come from all documents; those of words
that no example holds stay a table, which is joined to the documents' other words,
so every text is normed over all its words.

Defined results: a text with no word of any example (null and empty texts too) has
no neighbours: with words it scores the share of toxic examples among all, without any
the share among examples without words, drawn to that of all as by PRIOR rows; equal similarities are ordered by the examples'
order; several labels of one id count as toxic if any does; null labels are ignored;
without any labelled row every score is 0; repeated rows are scored each; an empty
table gives an empty result; extra columns, whatever their names, are carried through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import keep_one_per, ship, store

MAX_EXAMPLES = 8192
MAX_TERMS = 1024
NEIGHBOURS = 25
BLOCK = 1024
#: terms that one example in so many holds are dense rows
DENSE = 16
#: texts whose common terms are multiplied at once
TOGETHER = 64
#: examples, far apart, of which only the best counts where a bound of the k-th best is sought
CHUNK = 32
#: blocks opened before the k-th best is first known
FIRST_BLOCKS = 1
#: chi-square (one degree of freedom) that a term must reach: about p = 4e-8
MIN_CHI2 = 30.0
#: terms taken by rank alone if fewer reach the bar
FALLBACK_TERMS = 64
#: rows that the share among all examples counts for beside the examples without words
PRIOR = 50
#: words a task of the document frequencies holds before it hands its counts on
HELD_TERMS = 300_000

EVIDENCE = "array<struct<example:{id},similarity:double,toxic:int>>"
_WORDS = re.compile(r"\w+").findall


#: what the expression above does not count as part of a word becomes a space
_ASCII_GAPS = {i: " " for i in range(128) if not _WORDS(chr(i))}
_ASCII = bytes(range(128))
_BYTE_GAPS = bytes(32 if i in _ASCII_GAPS else i for i in range(256))
#: characters beyond ASCII that were met and are part of a word
_WORD_CHARS: set[str] = set()


def words_of(text: str | None) -> list[str]:
    """What ``_WORDS`` finds in the lower-cased text, faster: all that is not part of a word becomes a space."""
    text = (text or "").lower()
    if text.isascii():
        return text.translate(_ASCII_GAPS).split()
    data = text.encode("utf-8", "surrogatepass")
    text = data.translate(_BYTE_GAPS).decode("utf-8", "surrogatepass")
    for c in set(data.translate(None, _ASCII).decode("utf-8", "surrogatepass")):
        if c not in _WORD_CHARS and not _WORDS(c):
            text = text.replace(c, " ")
        else:
            _WORD_CHARS.add(c)
    return text.split()


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges start .. start + count, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _kth(sims: np.ndarray, k: int) -> float:
    """At most the k-th largest, and close to it: the k-th largest of the maxima of CHUNK places each; 0 if fewer are above 0."""
    if len(sims) >= CHUNK * k:
        sims = sims[:len(sims) // CHUNK * CHUNK].reshape(CHUNK, -1).max(axis=0)
    return max(float(np.partition(sims, len(sims) - k)[len(sims) - k]), 0.0) if len(sims) >= k else 0.0


@dataclass
class Postings:
    """Terms x examples, sorted by term and example; the postings of a term in a block are one entry with its maximum.

    Terms that at least one example in DENSE holds are dense rows beside it, multiplied for many texts at once.
    """

    width: int
    rows: np.ndarray
    values: np.ndarray
    entry_block: np.ndarray
    entry_max: np.ndarray
    entry_start: np.ndarray  # first posting of each entry, and the end
    term_start: np.ndarray  # first entry of each term, and the end
    dense_row: np.ndarray  # of each term, -1 if it has none
    dense: np.ndarray

    @classmethod
    def of(cls, width: int, start: np.ndarray, rows: np.ndarray, values: np.ndarray) -> Postings:
        """``start``: first posting of each term, and the end."""
        held = np.diff(start)
        term = np.repeat(np.arange(len(held)), held)
        new = np.flatnonzero(np.diff(term * (width // BLOCK + 1) + rows // BLOCK, prepend=-1))
        common = np.flatnonzero(held * DENSE >= max(width, DENSE))
        dense_row = np.full(len(held), -1)
        dense_row[common] = np.arange(len(common))
        dense = np.zeros((len(common), width))
        at = np.flatnonzero(dense_row[term] >= 0)
        dense[dense_row[term[at]], rows[at]] = values[at]
        return cls(width, rows, values, rows[new] // BLOCK, np.maximum.reduceat(values, new) if len(new) else np.zeros(0),
                   np.append(new, len(rows)), np.searchsorted(term[new], np.arange(len(start))), dense_row, dense)

    def opened(self, entries: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Per example, the weighted sum of its postings in the entries."""
        start = self.entry_start[entries]
        held = self.entry_start[entries + 1] - start
        at = _spans(start, held)
        return np.bincount(self.rows[at], np.repeat(weight, held) * self.values[at], minlength=self.width)

    def common_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Texts x examples: the similarity that the dense terms give."""
        q = np.zeros((len(vectors), len(self.dense)))
        for i, (t, w) in enumerate(vectors):
            at = self.dense_row[t]
            q[i, at[at >= 0]] = w[at >= 0]
        return q @ self.dense

    def __getitem__(self, terms: np.ndarray) -> np.ndarray:
        """The dense rows of some terms."""
        out = np.zeros((len(terms), self.width))
        for i, t in enumerate(terms):
            at = slice(self.entry_start[self.term_start[t]], self.entry_start[self.term_start[t + 1]])
            out[i, self.rows[at]] = self.values[at]
        return out


@dataclass
class Index:
    """Block-max inverted index over unit vectors; examples ordered so that like stands with like."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: list
    toxic: np.ndarray
    weights: Postings = field(repr=False)

    def vector(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Of counted words: (terms, tf-idf weights of unit length, their squared length before)."""
        return self.unit(*self.counts(words))

    def counts(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Of counted words: (terms, how often each occurs), by term."""
        t = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        tf = np.fromiter(words.values(), np.float64, len(words))[t >= 0]
        t = t[t >= 0]
        order = np.argsort(t)
        return t[order], tf[order]

    def unit(self, t: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of counted terms: (terms, tf-idf weights of unit length, their squared length before)."""
        if not len(t):
            return t, np.zeros(0), 0.0
        w = (1 + np.log(tf)) * self.idf[t]
        square = float((w * w).sum())
        return t, w / np.sqrt(square), square

    def nearest(self, t: np.ndarray, q: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples with similarity above 0: (rows, similarities), exact, ties by row."""
        return self.nearest_all([(t, q)], k, [without])[0]

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        common = self.weights.common_part(vectors)
        return [self._nearest(t, q, k, row, sims) for (t, q), row, sims in zip(vectors, without, common)]

    def _nearest(self, t: np.ndarray, q: np.ndarray, k: int, without: int, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``sims``: the common terms' part, which is known of every example; blocks are opened for the other terms."""
        p = self.weights
        if not len(t) or not p.width:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        rare = p.dense_row[t] < 0
        t, q = t[rare], q[rare]
        counts = p.term_start[t + 1] - p.term_start[t]
        entries, weight = _spans(p.term_start[t], counts), np.repeat(q, counts)
        block = p.entry_block[entries]
        rest = np.bincount(block, weight * p.entry_max[entries], minlength=-(-p.width // BLOCK))
        bound = rest + np.maximum.reduceat(sims, np.arange(0, p.width, BLOCK))
        first = np.zeros(len(bound), bool)
        first[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        live = first[block]
        sims = sims + p.opened(entries[live], weight[live])
        if without >= 0:
            sims[without] = 0.0
        more = (bound >= max(_kth(sims, k) - 1e-9, 1e-300)) & ~first & (rest > 0)
        if more.any():
            live = more[block]
            sims += p.opened(entries[live], weight[live])
            if without >= 0:
                sims[without] = 0.0
        # a closed block's sums are too low, yet below the k-th best with what was left out; a few rows too many are sorted away
        rows = np.flatnonzero(sims >= max(_kth(sims, k) - 1e-9, 1e-300))
        sims = np.round(sims[rows], 9)
        rows, sims = rows[sims > 0], sims[sims > 0]
        top = np.lexsort((rows, -sims))[:k]
        return rows[top], sims[top]


@dataclass
class Examples:
    """The labelled examples as integer arrays, which is what the driver holds and broadcasts; tasks build the index from them."""

    words: pa.Array
    idf: np.ndarray
    ids: list
    toxic: np.ndarray
    start: np.ndarray  # first posting of each word, and the end
    rows: np.ndarray
    tf: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, idf: np.ndarray, ids: list, toxic: np.ndarray, held: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Examples:
        """From ``held`` (term, tf) of each example in turn; those without any are left out."""
        row = np.repeat(np.arange(len(ids), dtype=np.int32), held)
        weight = (1 + np.log(tf)) * idf[term]
        by_weight = np.lexsort((-term, weight, row))  # the last of each example is its strongest, the first of equals
        strongest = term[by_weight[np.cumsum(held) - 1]] if len(term) else np.zeros(len(ids), np.int64)
        # examples with the same strongest term share blocks, which keeps the block maxima sharp
        order = sorted(np.flatnonzero(held > 0).tolist(), key=lambda r: (int(strongest[r]), str(ids[r])))
        place = np.zeros(len(ids), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        by_term = np.lexsort((place[row], term))
        return cls(words, idf, [ids[r] for r in order], toxic[order], np.searchsorted(term[by_term], np.arange(len(idf) + 1)),
                   place[row[by_term]], tf[by_term].astype(np.int32))

    def index(self, only: np.ndarray | None = None) -> Index:
        """Over all words, or over ``only`` some (ascending)."""
        terms = np.arange(len(self.idf)) if only is None else only
        held = self.start[terms + 1] - self.start[terms]
        at = slice(None) if only is None else _spans(self.start[terms], held)
        rows, idf = self.rows[at], self.idf[terms]
        weight = (1 + np.log(self.tf[at])) * np.repeat(idf, held)
        norm = np.sqrt(np.bincount(rows, weight * weight, minlength=len(self.ids)))
        common_first = np.argsort(idf, kind="stable")  # so that words looked up often lie together
        names = self.words.take(pa.array(terms[common_first])).to_pylist()
        return Index(dict(zip(names, common_first.tolist())), idf, self.ids, self.toxic,
                     Postings.of(len(self.ids), np.append(0, np.cumsum(held)), rows, weight / norm[rows]))


@dataclass
class Model:
    examples: Examples
    telling_words: np.ndarray  # the words that go with the label
    k: int
    no_neighbour: float  # score of a text with words, none of which any example holds
    no_words: float  # score of a text without words
    slope: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0, 0.0]))
    """log-odds of the vote; intercept, then with telling words: constant, log-odds of their vote, their log count"""
    others: DataFrame | None = field(repr=False, default=None)  # (term, df) of words that no example holds
    documents: int = 0

    @cached_property
    def index(self) -> Index:
        return self.examples.index()

    @cached_property
    def telling(self) -> Index:
        """The same examples over the telling words."""
        return self.examples.index(self.telling_words)

    @cached_property
    def told(self) -> np.ndarray:
        """Of each word of the examples, its place among the telling ones, -1 if it is none."""
        place = np.full(len(self.examples.idf), -1)
        place[self.telling_words] = np.arange(len(self.telling_words))
        return place

    def votes(self, counted: Iterable[tuple[dict[str, int], int]]) -> Iterator[tuple[dict[str, int], np.ndarray, np.ndarray, float, list[float]]]:
        """Of each text's (counted words, example to leave out or -1), held TOGETHER at a time: (words, nearest examples,
        similarities, squared length of its known words, features of the second vote)."""
        for some in batched(counted, TOGETHER):
            rows = [row for _, row in some]
            counts = [self.index.counts(words) for words, _ in some]
            vectors = [self.index.unit(t, tf) for t, tf in counts]
            near = self.index.nearest_all([v[:2] for v in vectors], self.k, rows)
            told = [(at[at >= 0], tf[at >= 0]) for t, tf in counts for at in [self.told[t]]]
            second = self.telling.nearest_all([self.telling.unit(t, tf)[:2] for t, tf in told], self.k, rows)
            for (words, _), v, (_, few), found, (by, sims) in zip(some, vectors, told, near, second):
                features = [1.0, 0.0, 0.0, 0.0]
                if len(by):
                    features = [1.0, 1.0, log_odds(sims @ self.telling.toxic[by], sims.sum()), np.log1p(few.sum())]
                yield words, *found, v[2], features


def log_odds(toxic: float, total: float) -> float:
    return float(np.log((toxic + 0.5) / (total - toxic + 0.5)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge that keeps separable data finite."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _term_rows(df: DataFrame, text: str, extra: list[str]) -> DataFrame:
    """(extra..., terms): the distinct words of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.array([sorted(set(words_of(t))) for t in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], kept], names=[*extra, "terms"])

    picked = df.select(*extra, F.col(text).alias("text"))
    fields = [picked.schema[c] for c in extra] + [T.StructField("terms", T.ArrayType(T.StringType()))]
    return picked.mapInArrow(run, T.StructType(fields))


def corpus_frequencies(df: DataFrame, text: str) -> tuple[int, DataFrame]:
    """Over all documents: their number, and the stored table (term, df) of every word.

    One pass; each task returns its counts whenever it holds HELD_TERMS words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        n = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(["", *met]), pa.array([n, *met.values()], pa.int64())], names=["term", "df"])

        for b in batches:
            for t in b.column(0):
                n += 1
                met.update(set(words_of(t.as_py())))
                if len(met) > HELD_TERMS:
                    yield out()
                    met, n = Counter(), 0
        yield out()

    table = store(df.select(F.col(text).alias("text")).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")),
                  "toxicity-frequencies")
    total = table.filter("term = ''").select(F.sum("df")).first()[0]
    return total or 0, table.filter("term <> ''")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, k: int = NEIGHBOURS) -> Model:
    """Learn from the given labelled rows (the caller leaves out the held-out ones)."""
    ship(docs)
    marked = (labels.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{label_col}`").cast("int").alias("label"))
              .filter("lid IS NOT NULL AND label IS NOT NULL").groupBy("lid").agg(F.max("label").alias("label")))
    chosen = marked.orderBy(F.xxhash64("lid"), "lid").limit(max_examples)
    texts = docs.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = store(keep_one_per(texts.join(F.broadcast(chosen), "lid"), ["lid"]), "toxicity-sample")  # at most max_examples rows
    distinct = keep_one_per(sample, ["text"])  # copies of one text speak once for its words
    found = _term_rows(distinct, "text", ["lid", "label"])
    n, pos = distinct.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").cast("double").alias("df"), F.sum("label").cast("double").alias("a")).filter("df >= 5")
    chi2 = F.expr(f"{n}D * pow(a * ({n - pos}D - (df - a)) - (df - a) * ({pos}D - a), 2)"
                  f" / (df * ({n}D - df) * {pos}D * {n - pos}D)")
    ranked = (counts.filter(F.col("df") < n).withColumn("chi2", chi2).orderBy(F.desc("chi2"), "term").limit(max_terms).collect()
              if 0 < pos < n else [])
    strong = [r["term"] for r in ranked if r["chi2"] is not None and r["chi2"] >= MIN_CHI2]
    telling = sorted(strong or [r["term"] for r in ranked[:FALLBACK_TERMS]])
    if not n:
        return _model([], np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0), k)
    total, frequencies = corpus_frequencies(texts, "text")
    spoken = store(_term_rows(sample, "text", []).select(F.explode("terms").alias("term")).distinct(), "toxicity-words")
    known = frequencies.join(spoken, "term").toArrow().sort_by("term")  # bounded: the words of max_examples texts
    words = known["term"].combine_chunks()
    idf = np.log((1 + total) / (1 + known["df"].to_numpy())) + 1
    vocabulary = docs.sparkSession.sparkContext.broadcast(words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(vocabulary.value.to_pylist())}
        for b in batches:
            t, tf = [], []
            for text in b.column("text"):
                words = Counter(words_of(text.as_py()))
                t.append(np.fromiter((at[w] for w in words), np.int32, len(words)))
                tf.append(np.fromiter(words.values(), np.int32, len(words)))
            yield pa.RecordBatch.from_arrays([b.column("lid"), b.column("label"), pa.array(t, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))],
                                             names=["lid", "label", "t", "tf"])

    kind = sample.schema["lid"].dataType.simpleString()
    rows = sample.select("lid", "label", "text").mapInArrow(counted, f"lid {kind}, label int, t array<int>, tf array<int>").toArrow()
    vocabulary.unpersist()
    t, tf = rows["t"].combine_chunks(), rows["tf"].combine_chunks()  # bounded: the integers of max_examples texts
    told = pc.index_in(pa.array(telling, pa.string()), words).to_numpy(zero_copy_only=False).astype(np.int64)
    model = _model(rows["lid"].to_pylist(), rows["label"].to_numpy().astype(float), np.diff(t.offsets.to_numpy()),
                   t.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy(), words, idf, k, np.sort(told))
    model.slope = _calibrated(sample, model)
    model.others, model.documents = store(frequencies.join(spoken, "term", "left_anti"), "toxicity-other-words"), total
    return model


def _model(ids: list, label: np.ndarray, held: np.ndarray, term: np.ndarray, tf: np.ndarray, words: pa.Array, idf: np.ndarray, k: int,
           telling: np.ndarray | None = None) -> Model:
    """Not yet calibrated; ``held`` (term, tf) of each example in turn."""
    bare = label[held == 0]
    share = (label.sum() + 0.5) / (len(ids) + 1.0) if ids else 0.0
    no_words = (bare.sum() + PRIOR * share) / (len(bare) + PRIOR)
    return Model(Examples.of(words, idf, ids, label, held, term, tf), np.zeros(0, np.int64) if telling is None else telling, k, share, no_words)


def _build(rows: list, at: dict[str, int], idf: np.ndarray, k: int) -> Model:
    """From (id, label, {term: tf}) rows in memory."""
    return _model([r[0] for r in rows], np.array([float(r[1]) for r in rows]), np.array([len(r[2]) for r in rows]),
                  np.array([t for r in rows for t in r[2]]), np.array([n for r in rows for n in r[2].values()]), pa.array(list(at)), idf, k)


def _calibrated(sample: DataFrame, model: Model) -> np.ndarray:
    """Logistic fit on the examples' votes without themselves, which the tasks find; the driver gets five numbers of each example."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {lid: row for row, lid in enumerate(m.examples.ids)}
        for b in batches:
            counts = ((Counter(words_of(t.as_py())), place.get(lid.as_py(), -1)) for lid, t in zip(b.column("lid"), b.column("text")))
            kept = [[log_odds(sims @ m.index.toxic[near], sims.sum()), *features] if len(near) else None
                    for _, near, sims, _, features in m.votes(counts)]
            yield pa.RecordBatch.from_arrays([b.column("lid"), b.column("label"), pa.array(kept, pa.list_(pa.float64()))], names=["lid", "label", "x"])

    kind = sample.schema["lid"].dataType.simpleString()
    found = sample.select("lid", "label", "text").mapInArrow(run, f"lid {kind}, label int, x array<double>").filter("x IS NOT NULL")
    got = sorted(found.collect(), key=lambda r: str(r["lid"]))  # bounded by max_examples; in one order, so that sums agree
    shared.unpersist()
    slope = model.slope.copy()
    if len({r["label"] for r in got}) == 2:
        order = [1, 0, 2, 3, 4]  # the intercept first, which the ridge leaves out
        slope[order] = _logistic(np.array([r["x"] for r in got])[:, order], np.array([float(r["label"]) for r in got]))
    return slope


def other_words(df: DataFrame, model: Model) -> DataFrame:
    """(key, square): for each text with words that no example holds, the sum of their squared weights."""
    shared = df.sparkSession.sparkContext.broadcast(model.examples.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(shared.value.to_pylist())
        for b in batches:
            keys, starts, words, counts = [], [0], [], []
            for i, t in enumerate(b.column("text")):
                if other := Counter(w for w in words_of(t.as_py()) if w not in known):
                    keys.append(i)
                    words += other.keys()
                    counts += other.values()
                    starts.append(len(words))
            flat = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int32())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(keys, pa.int64())), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)],
                                             names=["key", "terms"])

    kind = df.schema["key"].dataType.simpleString()
    rows = df.mapInArrow(run, f"key {kind}, terms array<struct<term:string,tf:int>>")
    one = rows.groupBy("key").agg(F.any_value("terms").alias("terms")).select("key", F.inline("terms"))  # copies of a text once
    idf = F.log((1.0 + model.documents) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    return one.join(model.others, "term", "left").groupBy("key").agg(F.sum(F.pow((1.0 + F.log("tf")) * idf, 2.0)).alias("square"))


def score(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "toxicity") -> DataFrame:
    """Append ``<prefix>_score`` and ``<prefix>_evidence`` (the nearest examples) to every row."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(replace(model, others=None))  # bounded by max_examples
    place = df.columns.index(text_col)
    names = [f"c{i}" for i in range(len(df.columns))]
    ids = pa.array(model.examples.ids) if model.examples.ids else pa.array([], pa.int64())
    kind = "long" if pa.types.is_integer(ids.type) else "string"
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields)]
    out = T.StructType([*fields, T.StructField("own", T.DoubleType()), T.StructField("toxic", T.DoubleType()),
                        T.StructField("total", T.DoubleType()), T.StructField("second", T.DoubleType()),
                        T.StructField("evidence", T._parse_datatype_string(EVIDENCE.format(id=kind)))])
    near = pa.struct([("example", pa.int64() if kind == "long" else pa.string()),
                               ("similarity", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            numbers, found, similar = [], [], []
            texts = (t.as_py() for t in b.column(place))
            counts = ((Counter(words_of(t if t is None or isinstance(t, str) else str(t))), -1) for t in texts)
            for words, rows, sims, own, features in m.votes(counts):
                numbers.append((own if words else -1.0, float(sims @ m.index.toxic[rows]), float(sims.sum()), float(m.slope[1:] @ features)))
                found.append(rows)
                similar.append(sims)
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            held = pa.array(np.append(0, np.cumsum([len(r) for r in found])).astype(np.int32))
            examples = pa.array([m.index.ids[r] if kind == "long" else str(m.index.ids[r]) for r in at.tolist()], near[0].type)
            flat = pa.StructArray.from_arrays([examples, pa.array(np.concatenate(similar) if similar else np.zeros(0)),
                                               pa.array(m.index.toxic[at].astype(np.int32))], fields=list(near))
            evidence = pa.ListArray.from_arrays(held, flat)
            parts = [pa.array(list(x), pa.float64()) for x in (zip(*numbers) if numbers else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *parts, evidence],
                                             names=[*names, "own", "toxic", "total", "second", "evidence"])

    plain = ship(df).toDF(*names)
    found = plain.mapInArrow(run, out)
    if model.others is not None:
        text = F.coalesce(F.col(names[place]).cast("string"), F.lit(""))
        key = F.struct(F.xxhash64(text).alias("a"), F.crc32(text.cast("binary")).alias("b"), F.length(text).alias("n"))
        rest = other_words(plain.select(key.alias("key"), text.alias("text")), model)
        found = found.withColumn("key", key).join(rest, "key", "left")
    else:
        found = found.withColumn("square", F.lit(0.0))
    # similarities so far are to the text's words that examples hold; over all its words they are smaller by this factor
    found = found.withColumn("f", F.when(F.col("own") > 0, F.sqrt(F.col("own") / (F.col("own") + F.coalesce("square", F.lit(0.0))))).otherwise(0.0))
    vote = F.log((F.expr("toxic * f") + 0.5) / (F.expr("(total - toxic) * f") + 0.5))
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("second") + float(model.slope[0]) * vote))
    scored = found.select(
        *names, F.when(F.size("evidence") == 0, F.when(F.col("own") < 0, F.lit(float(model.no_words))).otherwise(F.lit(float(model.no_neighbour)))).otherwise(1.0 / (1.0 + F.exp(-x))).alias("score"),
        F.expr("transform(evidence, e -> named_struct('example', e.example, 'similarity', round(e.similarity * f, 9), 'toxic', e.toxic))"))
    return scored.toDF(*df.columns, f"{prefix}_score", f"{prefix}_evidence")


def held_out(doc_id, folds: int = 5):
    """Rows whose labels are never learnt from: crc32 of the id as text is a multiple of ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def remove_toxic(docs: DataFrame, model: Model, text_col: str = "text", bar: float = 0.5) -> DataFrame:
    """The rows that score below the bar, with their own columns only."""
    scored = score(docs, model, text_col, prefix="__toxicity")
    return scored.filter(F.col("__toxicity_score") < bar).drop("__toxicity_score", "__toxicity_evidence")
