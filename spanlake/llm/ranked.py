"""Ranked lexical search: an index in shards of compressed posting blocks, searched by Block-Max MaxScore.

Each task cuts its documents into index shards. A shard has a dictionary of terms (64-bit hashes), and for each term
blocks of at most BLOCK postings. Beside every block stand its last document, its largest term frequency and its
shortest document, from which the best score in it is bounded; the postings themselves (steps between documents and
frequencies) are stored in as few bytes as the block's largest value needs.

A query works through a shard's lists from the highest bound down. Once the lists not yet opened can't together reach
the k-th score known so far, they are non-essential: they add no documents. They are then only asked about documents
that are still in question, and a document is rejected by the bound of the block it would be in before that block is
decompressed. The k best of all shards of a task are one heap per query, and the heaps of tasks meet in a ranked limit.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.llm import words
from spanlake.llm.batches import bound_batches
from spanlake.session import cut_lineage

BLOCK = 128
SHARD_POSTINGS = 1 << 19
QUERY_BLOCK = 512
_NO_ID = np.iinfo(np.int64).max
#: Every byte but letters and digits of ASCII and the bytes of other characters ends a term.
_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Shard:
    """Postings of some documents: what a search reads whole as arrays, and the packed blocks apart."""

    ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    df: np.ndarray
    #: Of each block its last document, largest frequency and shortest document.
    last_doc: np.ndarray
    most: np.ndarray
    shortest: np.ndarray
    #: Bytes in which a block's steps and frequencies are packed.
    widths: tuple[np.ndarray, np.ndarray]
    packed: tuple[bytes, bytes]

    def __post_init__(self):
        blocks = -(-self.df // BLOCK)
        #: Of each term the first of its blocks, and one behind the last.
        self.first_block = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int32)
        within = np.arange(len(self.last_doc), dtype=np.int32) - np.repeat(self.first_block[:-1], blocks)
        self.count = np.minimum(BLOCK, np.repeat(self.df, blocks) - within * BLOCK).astype(np.int32)
        self.before = np.where(within > 0, np.roll(self.last_doc, 1), 0)
        self.places = tuple(_places(w, self.count) for w in self.widths)

    def postings(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of a block, decompressed."""
        steps, tf = (np.frombuffer(p, f"<u{w[block]}", int(self.count[block]), int(at[block])) for p, w, at in zip(self.packed, self.widths, self.places, strict=True))
        return np.cumsum(steps, dtype=np.int32) + self.before[block], tf.astype(np.int64)

    def stored(self) -> bytes:
        return pickle.dumps((self.ids, self.lengths, self.last_doc, self.most, self.shortest, self.widths, self.packed), 5)

    @classmethod
    def read(cls, dictionary: bytes, stored: bytes) -> Shard:
        ids, lengths, last_doc, most, shortest, widths, packed = pickle.loads(stored)
        return cls(ids, lengths, *pickle.loads(dictionary), last_doc, most, shortest, widths, packed)


def _places(widths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each block is packed: the blocks of one byte a value first, then those of two, then of four."""
    out, at = np.zeros(len(widths), np.int64), 0
    for width in (1, 2, 4):
        own = widths == width
        sizes = counts[own].astype(np.int64) * width
        out[own] = at + np.cumsum(sizes) - sizes
        at += int(sizes.sum())
    return out


def _pack(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Each block's values in 1, 2 or 4 bytes, as its largest needs."""
    most = np.maximum.reduceat(values, first) if len(first) else np.empty(0, np.int64)
    widths = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)
    of = np.repeat(widths, counts)
    return widths, b"".join(values[of == width].astype(f"<u{width}").tobytes() for width in (1, 2, 4))


def pack_shard(ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> Shard:
    """The shard of postings (term, doc, tf) in the order of documents; ids and lengths by document."""
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order].astype(np.int32), tf[order].astype(np.int32)
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
    df = np.diff(start, append=len(term)).astype(np.int32)
    blocks = -(-df // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum())) - np.repeat(first_block, blocks)
    first = np.repeat(start, blocks) + within * BLOCK
    counts = np.minimum(BLOCK, np.repeat(df, blocks) - within * BLOCK)
    steps = np.diff(doc, prepend=np.int32(0))
    steps[start] = doc[start]
    (step_widths, packed_steps), (tf_widths, packed_tf) = _pack(steps, first, counts), _pack(tf, first, counts)
    reduced = lambda f, v: f.reduceat(v, first).astype(np.int32) if len(first) else np.empty(0, np.int32)
    return Shard(ids, lengths.astype(np.int32), term[start], df, doc[first + counts - 1], reduced(np.maximum, tf), reduced(np.minimum, lengths[doc]), (step_widths, tf_widths), (packed_steps, packed_tf))


def _terms(piece: words.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of some texts, and the text it stands in."""
    starts, ends = piece.word_bounds(_SEPARATORS)
    return piece.hashes(starts, ends, lower=True), piece.doc_of(starts)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the documents (id, text), each as soon as it has SHARD_POSTINGS postings."""
    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("dictionary", pa.binary()), ("shard", pa.binary())])
    held: list[tuple[np.ndarray, ...]] = []
    ids: list[np.ndarray] = []
    n_docs = n_postings = 0

    def flush():
        lengths, term, doc, tf = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        shard = pack_shard(np.concatenate(ids), lengths, term, doc, tf)
        row = [int((lengths > 0).sum()), int(lengths.sum()), pickle.dumps((shard.terms, shard.df), 5), shard.stored()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    for batch in batches:
        known = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for piece in words.slices(batch.column(1)):
            n = len(piece.offsets) - 1
            hashes, of = _terms(piece)
            order = np.lexsort((hashes, of))
            hashes, of = hashes[order], of[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            held.append((np.bincount(of, minlength=n).astype(np.int64), hashes[at], (of[at] + n_docs).astype(np.int32), np.diff(at, append=len(hashes)).astype(np.int32)))
            ids.append(known[piece.first_row : piece.first_row + n])
            n_docs, n_postings = n_docs + n, n_postings + len(at)
            if n_postings >= SHARD_POSTINGS:
                yield flush()
                ids, n_docs, n_postings = [], 0, 0
    if held:
        yield flush()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(n_docs, n_terms, dictionary, shard): the stored index of every row's whole text, one row per shard.

    A term is a run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Null and empty
    texts have none. Rows repeating an id are documents of their own.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return cut_lineage(rows.mapInArrow(_index, "n_docs long, n_terms long, dictionary binary, shard binary"))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, term, times) of each (q, text)."""
    for batch in batches:
        for piece in words.slices(batch.column(1)):
            hashes, of = _terms(piece)
            both, times = np.unique(np.stack([of.astype(np.uint64), hashes]), axis=1, return_counts=True) if len(of) else (np.empty((2, 0), np.uint64), np.empty(0, np.int64))
            q = batch.column(0).to_numpy(zero_copy_only=False)[piece.first_row + both[0].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(both[1].view(np.int64)), pa.array(times.astype(np.int64))], names=["q", "term", "times"])


def _frequencies(asked: np.ndarray):
    """(term, df) of the terms asked for, shard by shard."""

    def run(batches):
        for batch in batches:
            for stored in batch.column(0).to_pylist():
                terms, df = pickle.loads(stored)
                at = np.searchsorted(terms, asked)
                there = (at < len(terms)) & (terms[np.minimum(at, max(len(terms) - 1, 0))] == asked) if len(terms) else np.zeros(len(asked), bool)
                yield pa.RecordBatch.from_arrays([pa.array(asked[there].view(np.int64)), pa.array(df[at[there]].astype(np.int64))], names=["term", "df"])

    return run


@dataclass
class Scoring:
    """Integer BM25: the part of a posting's score that its term's weight multiplies."""

    n_docs: int
    n_terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def part(self, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 75 + (25 * lengths * self.n_docs) // max(self.n_terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Best:
    """The k best (score, id) of one query so far; ties go to the smaller id."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def floor(self) -> int:
        """What a document needs at least; a document that only ties may have the smaller id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class ShardSearch:
    """Searches one shard; blocks that were decompressed for one query serve the next."""

    def __init__(self, shard: Shard, scoring: Scoring):
        self.shard, self.scoring = shard, scoring
        self.block_bound = scoring.part(shard.most.astype(np.int64), shard.shortest.astype(np.int64))
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decompressed = 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.opened:
            doc, tf = self.shard.postings(b)
            self.opened[b] = doc, self.scoring.part(tf, self.shard.lengths[doc].astype(np.int64)).astype(np.int32)
            self.decompressed += 1
        return self.opened[b]

    def whole(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t not in self.lists:
            parts = [self.block(b) for b in range(self.shard.first_block[t], self.shard.first_block[t + 1])]
            if len(parts) == 1:
                return parts[0]
            self.lists[t] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self.lists[t]

    def query(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Merge this shard's documents into ``best``. terms: sorted hashes; weights: w times the term's repeats."""
        shard = self.shard
        if not len(shard.terms):
            return
        at = np.minimum(np.searchsorted(shard.terms, terms), len(shard.terms) - 1)
        there = (shard.terms[at] == terms) & (weights > 0)
        at, weights = at[there], weights[there]
        if not len(at):
            return
        bounds = np.array([self.block_bound[shard.first_block[t] : shard.first_block[t + 1]].max() for t in at]) * weights
        order = np.argsort(-bounds, kind="stable")
        at, weights, bounds = at[order], weights[order], bounds[order]
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1][1:], [0]])
        scores = np.zeros(len(shard.ids), np.int64)
        floor, n, todo = best.floor, 0, int(rest[0] + bounds[0])
        while n < len(at) and todo >= floor:  # essential lists: a document in none of them can't reach the floor
            doc, part = self.whole(int(at[n]))
            scores[doc] += part.astype(np.int64) * weights[n]
            todo = int(rest[n])
            n += 1
            if n < len(at) and len(scores) > best.k:  # what is found so far only grows
                floor = max(floor, int(np.partition(scores, -best.k)[-best.k]))
        found = np.flatnonzero(scores)
        for k in range(n, len(at)):  # non-essential lists
            so_far = scores[found]
            found = found[so_far + int(rest[k] + bounds[k]) >= floor]
            if not len(found):
                return
            first, end = int(shard.first_block[at[k]]), int(shard.first_block[at[k] + 1])
            b = first + np.searchsorted(shard.last_doc[first:end], found)
            inside = b < end
            limit = np.where(inside, self.block_bound[np.minimum(b, end - 1)] * weights[k], 0)
            alive = scores[found] + limit + int(rest[k]) >= floor
            found, b, inside = found[alive], b[alive], inside[alive]
            asked, of = found[inside], b[inside]
            for one in np.unique(of):
                doc, part = self.block(int(one))
                want = asked[of == one]
                p = np.minimum(np.searchsorted(doc, want), len(doc) - 1)
                hit = doc[p] == want
                scores[want[hit]] += part[p[hit]].astype(np.int64) * weights[k]
            if len(found) > best.k:
                floor = max(floor, int(np.partition(scores[found], -best.k)[-best.k]))
        found = found[scores[found] >= max(floor, 1)]
        best.merge(scores[found], shard.ids[found])


def _search(queries: dict[int, tuple[np.ndarray, np.ndarray]], scoring: Scoring, k: int):
    schema = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        best = {q: Best(k) for q in queries}
        for batch in batches:
            for dictionary, stored in zip(*batch.columns, strict=True):
                search = ShardSearch(Shard.read(dictionary.as_buffer(), stored.as_buffer()), scoring)
                for q, (terms, weights) in queries.items():
                    search.query(terms, weights, best[q])
        for q, b in best.items():
            if len(b.ids):
                ids = pa.array(b.ids, mask=b.ids == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), q)), ids, pa.array(b.scores)], schema=schema)

    return run


def search_index(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by doc_id.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), its part of a score w * (10^9 tf div (1000 tf + 12 m)) with m =
    75 + (25 n N div L). Items without a term, and items of an empty index, have no rows; of rows repeating an item_id
    the smallest text counts; documents without an id come last among equals. Items are searched in blocks of
    QUERY_BLOCK, whose terms are sent to every task; the index is read once for each block.
    """
    spark = index.sparkSession
    bound_batches(spark)
    one = items.groupBy(F.col(item_id).alias("item_id")).agg(F.min(F.col(text).cast("string")).alias("text"))
    numbered = cut_lineage(one.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"))
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    scoring = Scoring(n_docs, n_terms)
    found = None
    for block in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "text")
        rows = own.mapInArrow(_item_terms, "q long, term long, times long").toArrow()  # a block of queries
        q, term, times = (rows.column(c).to_numpy() for c in ("q", "term", "times"))
        asked = np.unique(term.view(np.uint64))
        counted = index.select("dictionary").mapInArrow(_frequencies(asked), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        weight = {t: scoring.weight(df) for t, df in zip(counted.column("term").to_pylist(), counted.column("df").to_pylist(), strict=True)}
        weights = times * np.array([weight.get(t, 0) for t in term.tolist()], np.int64)
        queries = {}
        for one_q in np.unique(q).tolist():
            of = np.flatnonzero((q == one_q) & (weights > 0))
            of = of[np.argsort(term[of].view(np.uint64))]
            queries[one_q] = term[of].view(np.uint64), weights[of]
        part = cut_lineage(index.select("dictionary", "shard").mapInArrow(_search(queries, scoring, k), "q long, doc_id long, score long"))
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(numbered.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
