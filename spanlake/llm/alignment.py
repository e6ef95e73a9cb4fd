"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, and how many documents say so.

Both tokenisations of a text cover the same bytes; the offsets at which tokens of both end cut them into groups, and
every token of one side of a group is linked with every token of the other. No token of either side reaches over a
space behind a character that is no white space, so texts are encoded chunk by chunk, each distinct chunk once. A first
pass encodes and aligns the documents, stores their ids and collects the distinct linked pairs. These get a minimal perfect hash: pairs are dealt to segments by a hash, and in
each segment levels of bits give every pair a slot of its own (a pair whose bit no other pair of its level wants is
settled there, the others go on to the next level; the slot is the rank of the bit). With it, counts need no keys: each
task adds its documents into dense vectors indexed by slot, and the vectors are summed segment by segment in a tree of
fixed fan-in. A second pass aligns the documents again from their stored ids and looks the counts up; the pair stored
at a slot is compared, so a pair that has none is not mistaken for another.

Tables of segments are handed to tasks in pieces of at most PIECE_BYTES, one piece at a time, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.batches import bound_batches, portions
from spanlake.session import cut_lineage

SEGMENT_PAIRS = 4096
PIECE_BYTES = 64 << 20
FAN_IN = 64
HELD_PAIRS = 1 << 20
LINK_BLOCK = 1 << 20
MEMO_CHUNKS = 120_000
LINE_CHUNKS = 16
PORTION_BYTES = 1 << 20
PORTION_IDS = 1 << 18
CACHED_COUNTS = 1 << 17
_GAMMA = 2
_MAX_LEVELS = 64
#: Bits of a pair that hold the second id.
_B_BITS = 22
#: Bits of a pair; documents of one portion are counted above them.
_PAIR_BITS = 44
#: The public pattern that splits a text into words before the merges of byte-level BPE.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Labels:
    """The bytes of every token of a vocabulary, joined, with where each begins."""

    def __init__(self, labels: list[bytes]):
        self.lengths = np.array([len(x) for x in labels], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(labels), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        return self.data[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class BytePairs:
    """A byte-level BPE vocabulary file; strings of added tokens are plain text. Ids are those of the file."""

    def __init__(self, definition: str):
        import json

        import tiktoken

        model = json.loads(definition)["model"]
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        byte_of = {chr(b if b in plain else next(spare)): b for b in range(256)}
        spelled = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = {bytes(byte_of[c] for c in token): 256 + rank for rank, token in enumerate(merged)} | {bytes([b]): b for b in range(256)}
        self.ids = np.zeros(len(order), np.int64)
        for token, rank in order.items():
            self.ids[rank] = spelled[token]
        self.encoding = tiktoken.Encoding("pairs", pat_str=_SPLIT, mergeable_ranks=order, special_tokens={})
        known = {i: t for t, i in spelled.items()}
        self.labels = Labels([known.get(i, b"") for i in range(max(known) + 1)])

    def encode(self, text: str) -> np.ndarray:
        return self.ids[np.array(self.encoding.encode_ordinary(text), np.int64)]


class Pieces:
    """A BPE piece model."""

    def __init__(self, definition: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=definition)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.labels = Labels([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        #: No piece has a space mark behind another character, so pieces never reach over one.
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> np.ndarray:
        """The ids of all texts, one after the other."""
        return np.fromiter(chain.from_iterable(self.model.encode(texts, num_threads=1)), np.int64)


def _runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with these starts and counts, one after the other."""
    return values[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]


class Chunks:
    """Both encodings of the chunks met lately. A chunk begins with a space and goes on to the next space behind no white space."""

    _spaces = regex.compile(r"\s\s|^\s|\s$")
    _cut = regex.compile(r"(?<=\S)(?= )")

    def __init__(self, one: BytePairs, two: Pieces):
        self.one, self.two = one, two
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.counts, self.good = [np.empty(0, np.int64)] * 2, [np.empty(0, np.int64)] * 2, np.empty(0, bool)

    def split(self, text: str) -> list[str]:
        """The chunks of " " + text; an empty text has none."""
        if not text:
            return []
        if not self.two.by_word:
            return [" " + text]
        if self._spaces.search(text):
            return self._cut.split(" " + text)
        return [" " + word for word in text.split(" ")]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], Aligned | None]:
        """Per side the ids of all texts, and how many each has (none where bytes differ); the groups of the chunks that were new."""
        split = [self.split(text) for text in texts]
        new = list(set(chain.from_iterable(split)) - self.index.keys())
        fresh = self._add(new) if new else None
        n = np.array([len(parts) for parts in split])
        chunk = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(texts)), n)
        sound = np.bincount(of[~self.good[chunk]], minlength=len(texts)) == 0
        chunk, of = chunk[sound[of]], of[sound[of]]
        ids, counts = [], []
        for flat, each in zip(self.ids, self.counts, strict=True):
            starts = np.cumsum(each) - each
            ids.append(_runs(flat, starts[chunk], each[chunk]))
            counts.append(np.bincount(of, each[chunk], minlength=len(texts)).astype(np.int64))
        if len(self.index) > MEMO_CHUNKS:
            self.forget()
        return ids, counts, fresh

    def _add(self, new: list[str]) -> Aligned:
        # chunks that end in white space or have the piece model's own space mark stand alone; all others are read as one text
        alone, joined = [], []
        for c in new:
            (alone if c[-1].isspace() or "▁" in c else joined).append(c)
        found = self._together(joined) if joined and self.two.by_word else None
        if found is None:
            alone, joined, found = new, [], ([np.empty(0, np.int64)] * 2, [np.empty(0, np.int64)] * 2, np.empty(0, bool))
        ids, counts, good = found
        single = [self._alone(c) for c in alone]
        for side in (0, 1):
            ids[side] = np.concatenate([ids[side], *(x[side] for x in single)])
            counts[side] = np.concatenate([counts[side], [len(x[side]) for x in single]]).astype(np.int64)
        self.index |= dict(zip(joined + alone, range(len(self.good), len(self.good) + len(new)), strict=True))
        self.ids = [np.concatenate(x) for x in zip(self.ids, ids, strict=True)]
        self.counts = [np.concatenate(x) for x in zip(self.counts, counts, strict=True)]
        self.good = np.concatenate([self.good, good, [len(a) > 0 for a, _ in single]]).astype(bool)
        return Aligned(ids[0], np.cumsum(counts[0]), ids[1], np.cumsum(counts[1]), self.one.labels.lengths, self.two.labels.lengths)

    def _together(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray] | None:
        """Ids and counts of chunks read as one text, or None if a token reaches over a chunk or bytes differ."""
        text = "".join(chunks)
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks)))
        # the piece model sorts all merges of a text, so many short ones are read faster than a long one
        lines = ["".join(chunks[k : k + LINE_CHUNKS])[1:] for k in range(0, len(chunks), LINE_CHUNKS)]
        ids, counts = [self.one.encode(text), self.two.encode(lines)], []
        for side, labels in zip(ids, (self.one.labels, self.two.labels), strict=True):
            at = np.cumsum(labels.lengths[side])
            last = np.searchsorted(at, ends)
            if not len(at) or last[-1] >= len(at) or (at[last] != ends).any() or not np.array_equal(labels.join(side), data):
                return None
            counts.append(np.diff(last + 1, prepend=0))
        return ids, counts, np.ones(len(chunks), bool)

    def _alone(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        # the model puts no space in front of an empty text, which would be all of a lone space
        a, b = self.one.encode(chunk), self.two.encode([chunk[1:]]) if len(chunk) > 1 else np.array([self.two.model.piece_to_id("▁")])
        data = np.frombuffer(chunk.encode(), np.uint8)
        same = np.array_equal(self.one.labels.join(a), data) and np.array_equal(self.two.labels.join(b), data)
        return (a, b) if same else (a[:0], b[:0])


class Aligned:
    """Groups and links of some documents from their token ids, both sides of a document covering the same bytes."""

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray):
        """a, b: the ids of all documents; a_ends, b_ends: behind the last id of each document."""
        self.a, self.b, self.docs = a, b, len(a_ends)
        at_a, at_b = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
        size = int(at_a[-1]) + 1 if len(a) else 1
        of_a, of_b = np.zeros(size, bool), np.zeros(size, bool)
        of_a[at_a], of_b[at_b] = True, True
        # a document's last tokens end together, so groups never span documents
        a_last, b_last = of_b[at_a], of_a[at_b]
        self.a_group, self.b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_cut, b_cut = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        self.n_a, self.n_b = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
        self.a_last, self.b_last = a_last, b_last
        self.doc = np.searchsorted(a_ends, a_cut - 1, "right")

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, pair) of every link, in portions of about LINK_BLOCK links."""
        first_b = np.cumsum(self.n_b) - self.n_b
        partners = self.n_b[self.a_group]
        total = np.cumsum(partners)
        i = 0
        while i < len(self.a):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + LINK_BLOCK, "right")))
            n, group = partners[i:j], self.a_group[i:j]
            yield np.repeat(self.doc[group], n), (np.repeat(self.a[i:j], n) << _B_BITS) | _runs(self.b, first_b[group], n)
            i = j

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, pair), each once; links are made distinct portion by portion."""
        keys = [np.unique((doc << _PAIR_BITS) | pair) for doc, pair in self.blocks()]
        keys = np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0] if keys else np.empty(0, np.int64)
        return keys >> _PAIR_BITS, keys & ((1 << _PAIR_BITS) - 1)


def _binary(values: np.ndarray, counts: np.ndarray, kind: type) -> pa.Array:
    """A binary column of the runs of ``values``."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.astype(kind))])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column without nulls, and where each row ends."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(column) else np.empty(0, np.uint8)
    return data.view(kind).astype(np.int64), (offsets[1:] - offsets[0]).astype(np.int64) // np.dtype(kind).itemsize


def _width(labels: np.ndarray) -> type:
    return np.uint16 if len(labels) <= 1 << 16 else np.uint32


# -- minimal perfect hash -------------------------------------------------------------------------------------------


def _mix(pairs: np.ndarray, salt: int) -> np.ndarray:
    x = (pairs.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def segment_of(pairs: np.ndarray, segments: int) -> np.ndarray:
    return (_mix(pairs, 0) % np.uint64(segments)).astype(np.int64)


def build_levels(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of all levels, sizes of the levels) of distinct pairs: every pair has a bit of its own in one level."""
    levels, sizes, left = [], [], pairs
    while len(left):
        if len(levels) == _MAX_LEVELS:
            raise RuntimeError("pairs repeat, or the hash is broken")
        size = max(8, -(-_GAMMA * len(left) // 8) * 8)
        at = (_mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
        wanted = np.bincount(at, minlength=size)
        levels.append(wanted == 1)
        sizes.append(size)
        left = left[wanted[at] > 1]
    return np.concatenate(levels) if levels else np.empty(0, bool), np.array(sizes, np.int64)


class PairTable:
    """The hash of some segments: where a pair's slot is, and what is stored there."""

    def __init__(self, rows: pa.Table, segments: int):
        rows = rows.sort_by("segment")
        self.segments = segments
        self.segment = rows.column("segment").to_numpy()
        self.size = rows.column("n").to_numpy()
        sizes = [np.frombuffer(x, np.int64) for x in rows.column("levels").to_pylist()]
        deepest = max(map(len, sizes), default=0)
        # of each segment and level its size, and the place of its first bit
        self.level_size = np.zeros((len(sizes), deepest), np.int64)
        for k, s in enumerate(sizes):
            self.level_size[k, : len(s)] = s
        flat = self.level_size.ravel()
        self.level_start = (np.cumsum(flat) - flat).reshape(self.level_size.shape)
        self.bits = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8)) for x in rows.column("bits").to_pylist()]) if len(sizes) else np.empty(0, np.uint8)
        self.rank = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])[:-1].astype(np.int32) if len(self.bits) else np.empty(0, np.int32)
        read = lambda name: np.concatenate([np.frombuffer(x, np.int64) for x in rows.column(name).to_pylist()]) if name in rows.column_names and len(sizes) else None
        self.pairs, self.counts = read("pairs"), read("counts")
        # pairs counted lately, one per place
        self.asked, self.answer = np.full(CACHED_COUNTS, -1, np.int64), np.zeros(CACHED_COUNTS, np.int64)

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """The slot of each pair, counted over all segments of the table; -1 for pairs of other segments."""
        out = np.full(len(pairs), -1, np.int64)
        if not len(self.segment):
            return out
        segment = segment_of(pairs, self.segments)
        row = np.minimum(np.searchsorted(self.segment, segment), len(self.segment) - 1)
        open_ = np.flatnonzero(self.segment[row] == segment)
        for level in range(self.level_size.shape[1]):
            size = self.level_size[row[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            at = self.level_start[row[open_], level] + (_mix(pairs[open_], level + 1) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[at] == 1
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def count(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 for a pair that is not the one stored at its slot."""
        place = (pairs * 0x9E3779B97F4A7C1) >> 20 & (CACHED_COUNTS - 1)
        out = self.answer[place]
        new = np.flatnonzero(self.asked[place] != pairs)
        if len(new):
            asked, at = pairs[new], place[new]
            slots = self.slots(asked)
            known = slots >= 0
            known[known] = self.pairs[slots[known]] == asked[known]
            out[new] = 0
            out[new[known]] = self.counts[slots[known]]
            # of several pairs that share a place one stays, with its own count
            self.asked[at] = asked
            stays = self.asked[at] == asked
            self.answer[at[stays]] = out[new[stays]]
        return out


# -- passes ---------------------------------------------------------------------------------------------------------


def _encode(a_definition, b_definition) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, a, b, pairs) of each (doc_id, text): the ids of both sides; further rows hold distinct linked pairs of the task."""

    def run(batches):
        chunks = Chunks(BytePairs(a_definition.value), Pieces(b_definition.value))
        kinds = [_width(x.labels.lengths) for x in (chunks.one, chunks.two)]
        held, fresh = np.empty(0, np.int64), []
        schema = pa.schema([("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("pairs", pa.binary())])

        def pairs():
            row = [pa.nulls(1, t) for t in schema.types[:3]] + [pa.array([held.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, schema=schema)

        for batch in portions(batches, 1, PORTION_BYTES):
            ids, counts, new = chunks.encode(batch.column(1).fill_null("").to_pylist())
            if new is not None:
                fresh.append(np.unique(np.concatenate([np.empty(0, np.int64), *(np.unique(p) for _, p in new.blocks())])))
            columns = [_binary(i, n, kind) for i, n, kind in zip(ids, counts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.nulls(batch.num_rows, pa.binary())], schema=schema)
            if sum(map(len, fresh)) > HELD_PAIRS:
                held, fresh = np.unique(np.concatenate([held, *fresh])), []
                if len(held) > HELD_PAIRS:
                    yield pairs()
                    held = held[:0]
        held = np.unique(np.concatenate([held, *fresh]))
        if len(held):
            yield pairs()

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row.as_buffer(), np.int64))], names=["pair"])


class _Documents:
    """The stored ids of documents, a portion of them at a time, aligned anew."""

    def __init__(self, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.lengths, self.kinds = (a_lengths, b_lengths), (_width(a_lengths), _width(b_lengths))

    def read(self, batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Aligned]]:
        for batch in portions(batches, a, PORTION_IDS * np.dtype(self.kinds[0]).itemsize):
            (one, one_ends), (two, two_ends) = (_unpacked(batch.column(k), kind) for k, kind in zip((a, b), self.kinds, strict=True))
            yield batch, one_ends, two_ends, Aligned(one, one_ends, two, two_ends, *self.lengths)


_HASHED = "segment long, n long, levels binary, bits binary, pairs binary"


def _build(table: pa.Table) -> pa.Table:
    """One segment: its levels, and its pairs in the order of their slots."""
    pairs = np.sort(table.column("pair").to_numpy())
    bits, sizes = build_levels(pairs)
    row = {"segment": table.column("segment")[:1], "n": [len(pairs)], "levels": [sizes.tobytes()], "bits": [np.packbits(bits).tobytes()]}
    own = PairTable(pa.table({**row, "segment": pa.array([0])}), 1)
    ordered = np.empty_like(pairs)
    ordered[own.slots(pairs)] = pairs
    return pa.table({**row, "pairs": [ordered.tobytes()]})


def _piece(rows: DataFrame, columns: list[str]):
    """Some segments as a broadcast value (their number is bounded by PIECE_BYTES)."""
    return rows.sparkSession.sparkContext.broadcast(rows.select(*columns).toArrow())


def _add(piece, segments: int, documents: _Documents) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, segment, counts): the dense count vectors of a task's documents, for the segments that they touch."""

    def run(batches):
        from pyspark import TaskContext

        table = PairTable(piece.value, segments)
        if not len(table.segment):
            return
        vector = np.zeros(int(table.size.sum()), np.int64)
        for *_, aligned in documents.read(batches, 0, 1):
            slots = table.slots(aligned.distinct()[1])
            vector += np.bincount(slots[slots >= 0], minlength=len(vector))
        part = TaskContext.get().partitionId()
        for segment, own in zip(table.segment.tolist(), np.split(vector, np.cumsum(table.size)[:-1]), strict=True):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([segment], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["part", "segment", "counts"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    total = np.frombuffer(table.column("counts")[0].as_buffer(), np.int64).copy()
    for x in table.column("counts")[1:]:
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"part": table.column("part")[:1], "segment": table.column("segment")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _tree_sum(vectors: DataFrame, parts: int) -> DataFrame:
    """(segment, counts): the sum of a segment's vectors, FAN_IN of them at a time."""
    schema = "part long, segment long, counts binary"
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("segment", "part").applyInArrow(_sum, schema)
    return vectors.groupBy("segment").applyInArrow(_sum, schema).select("segment", "counts")


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, best): the highest count of each first id, segment by segment."""
    for batch in batches:
        for pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, n = np.frombuffer(pairs, np.int64) >> _B_BITS, np.frombuffer(counts, np.int64)
            order = np.lexsort((-n, a))
            ids, first = np.unique(a[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[order][first])], names=["a", "best"])


_KEPT = "doc_id long, a binary, b binary, n_best long, count_sum long"
_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"


def _look_up(piece, segments: int, highest, documents: _Documents, last: bool):
    """Adds to n_best and count_sum of each document the links whose pairs are in this piece; the last piece also describes the groups."""

    def run(batches):
        table = PairTable(piece.value, segments)
        best = np.full(len(documents.lengths[0]), -1, np.int64)
        ids, counts = highest.value
        best[ids] = counts
        numbers = Labels([b"%d," % i for i in range(max(map(len, documents.lengths)))])
        for batch, a_ends, b_ends, aligned in documents.read(batches, 1, 2):
            n_best, count_sum = (batch.column(k).to_numpy(zero_copy_only=False).copy() for k in (3, 4))
            for doc, pair in aligned.blocks():
                count = table.count(pair)
                is_best = (count > 0) & (count == best[pair >> _B_BITS])
                # counts stay below 2^53 in sums, so floats hold them exactly
                count_sum += np.bincount(doc, count, minlength=aligned.docs).astype(np.int64)
                n_best += np.bincount(doc[is_best], minlength=aligned.docs)
            added = [pa.array(n_best), pa.array(count_sum)]
            if last:
                per_doc = lambda v: np.bincount(aligned.doc, v, minlength=aligned.docs).astype(np.int64)  # noqa: B023, E731
                sizes = [np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0), per_doc(None), per_doc(aligned.n_a * aligned.n_b)]
                columns = [*map(pa.array, sizes), _described(aligned, a_ends + b_ends, numbers)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *added], names=[c.split()[0] for c in _FOUND.split(", ")])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], names=[c.split()[0] for c in _KEPT.split(", ")])

    return run


def _described(aligned: Aligned, ends: np.ndarray, numbers: Labels) -> pa.Array:
    """The groups of each document as text, written for all documents at once."""
    # every id with the character behind it, in the order of groups and its first side first
    before_a, before_b = np.cumsum(aligned.n_b) - aligned.n_b, np.cumsum(aligned.n_a)
    at_a, at_b = np.arange(len(aligned.a)) + before_a[aligned.a_group], np.arange(len(aligned.b)) + before_b[aligned.b_group]
    ids, behind = np.empty(len(aligned.a) + len(aligned.b), np.int64), np.empty(len(aligned.a) + len(aligned.b), np.uint8)
    ids[at_a], ids[at_b] = aligned.a, aligned.b
    behind[at_a], behind[at_b] = np.where(aligned.a_last, ord("|"), ord(",")), np.where(aligned.b_last, ord(";"), ord(","))
    text, at = numbers.join(ids), np.cumsum(numbers.lengths[ids])
    text[at - 1] = behind
    offsets = np.concatenate([[0], at])[np.concatenate([[0], ends])]
    full = np.diff(offsets) > 0
    keep = np.ones(len(text), bool)
    keep[offsets[1:][full] - 1] = False  # the last group has no character behind it
    offsets -= np.concatenate([[0], np.cumsum(full)])
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text[keep])])


def encode_both(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b, pairs): packed ids of " " + text by the byte-level vocabulary and of the text by the piece model.

    Stored once; rows whose a is null hold distinct linked pairs instead of a document. Null and empty texts, and texts that one of the two can't give back byte by byte, have empty lists.
    Strings of special tokens are plain text. Repeated rows and rows without id are documents of their own.
    """
    bound_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        definitions = context.broadcast(a.read()), context.broadcast(b.read())
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return cut_lineage(rows.mapInArrow(_encode(*definitions), "doc_id long, a binary, b binary, pairs binary"))


def count_pairs(encoded: DataFrame, documents: _Documents) -> tuple[DataFrame, int]:
    """(segment, n, levels, bits, pairs, counts) stored, and the number of segments; counts: documents that link each pair."""
    distinct = cut_lineage(encoded.where("pairs is not null").select("pairs").mapInArrow(_each, "pair long").distinct())
    stored = encoded.where("a is not null").select("a", "b")
    segments = max(1, -(-distinct.count() // SEGMENT_PAIRS))

    def dealt(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(batch.column(0).to_numpy(), segments)), batch.column(0)], names=["segment", "pair"])

    hashed = cut_lineage(distinct.mapInArrow(dealt, "segment long, pair long").groupBy("segment").applyInArrow(_build, _HASHED))
    parts = stored.select(F.spark_partition_id().alias("part")).agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    counted = None
    for own in pieces(hashed, segments):
        piece = _piece(own, ["segment", "n", "levels", "bits"])
        vectors = stored.mapInArrow(_add(piece, segments, documents), "part long, segment long, counts binary")
        summed = cut_lineage(_tree_sum(vectors, parts))
        counted = summed if counted is None else counted.unionByName(summed)
    return cut_lineage(hashed.join(counted, "segment")), segments


def pieces(table: DataFrame, segments: int) -> list[DataFrame]:
    """The segments of a table in ranges that take at most about PIECE_BYTES each."""
    per_piece = max(1, PIECE_BYTES // (SEGMENT_PAIRS * 18))
    return [table.where((F.col("segment") >= k) & (F.col("segment") < k + per_piece)) for k in range(0, segments, per_piece)]


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) for each row of ``docs``.

    groups: the ids of each group, ``a1,a2|b1;a3|b2,b3``. n_best: links whose pair is linked by as many documents as any
    pair of its first id; count_sum: over all links, how many documents link the pair. Rows without tokens have zeros and ''.
    """
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        documents = _Documents(BytePairs(a.read()).labels.lengths, Pieces(b.read()).labels.lengths)
    encoded = encode_both(docs, a_path, b_path, doc_id, text)
    counted, segments = count_pairs(encoded, documents)
    best = counted.select("pairs", "counts").mapInArrow(_highest, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toArrow()  # a row per id of the vocabulary
    highest = docs.sparkSession.sparkContext.broadcast((best.column("a").to_numpy(), best.column("best").to_numpy()))
    zero = F.lit(0).cast("long")
    found = encoded.where("a is not null").select("doc_id", "a", "b", zero.alias("n_best"), zero.alias("count_sum"))
    ranges = pieces(counted, segments)
    for own in ranges[:-1]:
        piece = _piece(own, ["segment", "n", "levels", "bits", "pairs", "counts"])
        found = cut_lineage(found.mapInArrow(_look_up(piece, segments, highest, documents, False), _KEPT))
    piece = _piece(ranges[-1], ["segment", "n", "levels", "bits", "pairs", "counts"])
    return found.mapInArrow(_look_up(piece, segments, highest, documents, True), _FOUND)
