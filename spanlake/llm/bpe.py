"""Byte-level BPE as a deterministic automaton over tokens, compiled from the merge list by one gadget per merge.

The automaton starts with one state, from which every byte leads back to it. The gadget of a merge (a, b) gives the
arcs a a state of their own, which is the one they led to without the arc b, and adds an arc ab wherever a and then b
could be walked; it leads where b led. After all gadgets a path is a correct tokenisation exactly if all its arcs
exist, and every text has one such path.

Compiled, a state is the list of arcs it lacks. Once b is cut from a state, no arc made later out of b appears there,
and so on for what is made out of those; numbered in the order "b, then what was made out of it, latest first, each
followed by its own", the arcs that one gadget takes away from a state are an interval. So the table is three arrays:
the state behind each token, and for each state the beginnings and ends of the intervals it lacks.

A word is encoded by reading its bytes once: at each position exactly one of the tokens that end there has an arc from
the state where it began, and this arc leads to the only state alive at that position. All distinct words of a portion
of text are read at the same time, position by position, with array operations. Decoding emits the bytes of the labels.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.batches import bound_batches, portions, tidied

#: The public pattern that splits a text into words before the merges of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 20_000
PORTION_BYTES = 1 << 20
WORD_BYTES = 1 << 18
_SHIFT = 24


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in plain else extra))
        extra += byte not in plain
    return out


def _split_pattern(data: dict) -> tuple[str | None, bool]:
    """The pattern that the file asks for (None: texts are not split), and whether texts get a space in front."""
    if data.get("normalizer"):
        raise ValueError("a vocabulary with a normalizer is not supported")
    pattern, spaced = None, False
    first = data.get("pre_tokenizer") or {}
    for step in first.get("pretokenizers", [first] if first else []):
        if step["type"] == "ByteLevel":
            spaced |= step.get("add_prefix_space", False)
            pattern = pattern or (SPLIT if step.get("use_regex", True) else None)
        elif step["type"] == "Split" and "Regex" in step["pattern"] and step.get("behavior") == "Isolated" and not step.get("invert"):
            pattern = f"{step['pattern']['Regex']}|(?s:.)"
        else:
            raise ValueError(f"unknown splitting step {step['type']}")
    return pattern, spaced


class Gadgets:
    """The compiled table of a merge list over numbered tokens: 0-255 are the bytes, 256 + k is what merge k makes."""

    def __init__(self, merges: np.ndarray, arises: np.ndarray):
        """merges: (k, 2) numbers of the two tokens that merge k joins, both made before; arises: whether each token is ever made."""
        n = 256 + len(merges)
        made_of = np.concatenate([np.full((256, 2), -1), merges.reshape(-1, 2)])
        left, right = made_of[:, 0], made_of[:, 1]
        self.number, size = _numbered(left)
        children = np.lexsort((np.arange(256, n), left[256:])) + 256
        by_left = left[children] * n + children  # sorted: the tokens made out of each, oldest first

        def lacks_until(b: np.ndarray, time: np.ndarray) -> np.ndarray:
            """End of the interval of b and all that is made out of it after ``time``."""
            at = np.searchsorted(by_left, b * n + time, "right") - 1
            older = (at >= 0) & (left[children[at]] == b)
            return np.where(older, self.number[children[at]], self.number[b] + size[b])

        # A gadget that finds nothing to join cuts nothing. Runs of one token pair up from the left, so none stands
        # before its own pair: the gadget of such a pair takes both arcs away.
        time = np.arange(256, n)[arises[256:]]
        begin, end = self.number[right[time]], lacks_until(right[time], time - (left[time] == right[time]))
        by_state = np.argsort(left[time], kind="stable")
        first = np.searchsorted(left[time][by_state], np.arange(n + 1))
        cut_at = left[time][by_state] * n + time[by_state]
        # A token's state: the one its right part had when it was made, less what was cut from its own since.
        token, low, high = [np.arange(n)], [first[:-1]], [first[1:]]
        whose, part = np.arange(n), np.arange(n)
        while True:
            whose, made = whose[part >= 256], part[part >= 256]
            if not len(made):
                break
            part = right[made]
            token.append(whose)
            low.append(first[part])
            high.append(np.searchsorted(cut_at, part * n + made))
        token, low, high = (np.concatenate(x) for x in (token, low, high))
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        token, begin, end = np.repeat(token, counts), begin[by_state][at], end[by_state][at]
        order = np.lexsort((begin, token))
        token, begin, end = token[order], begin[order], end[order]
        # Tokens that lack the same arcs share a state.
        cuts = np.searchsorted(token, np.arange(n + 1))
        known: dict[bytes, int] = {}
        both = np.stack([begin, end], axis=1).astype(np.int32)
        of_token = [known.setdefault(both[i:j].tobytes(), len(known)) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        lists = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in known]
        state = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.empty((0, 2), np.int32)
        self.state = np.array(of_token, np.int32)
        # one unreachable entry in front, so that every look-up finds something
        self.begins = np.concatenate([[-1], (state.astype(np.int64) << _SHIFT) | flat[:, 0]])
        self.ends = np.concatenate([[-1], (state.astype(np.int64) << _SHIFT) | flat[:, 1]])
        # arcs looked up lately, one per place
        self.asked, self.answer = np.full(1 << 17, -1, np.int64), np.zeros(1 << 17, bool)

    def walks(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state behind each ``before`` has the arc ``token``."""
        arc = (self.state[before].astype(np.int64) << _SHIFT) | self.number[token]
        place = (arc * 0x9E3779B97F4A7C1) >> 20 & (len(self.asked) - 1)
        out = self.answer[place]
        new = np.flatnonzero(self.asked[place] != arc)
        if len(new):
            asked, at = arc[new], place[new]
            out[new] = asked >= self.ends[np.searchsorted(self.begins, asked, "right") - 1]
            # of several arcs that share a place one stays, with its own answer
            self.asked[at] = asked
            stays = self.asked[at] == asked
            self.answer[at[stays]] = out[new[stays]]
        return out


def _can_arise(merges: list[tuple[int, int]]) -> list[bool]:
    """Whether each token is ever made: only if its gadget finds the second token behind the first at its time."""
    cut: dict[tuple[int, int], int] = {}
    out = [True] * 256
    for made, (u, v) in enumerate(merges, 256):
        a, b, time, there = u, v, made, out[u] and out[v]
        while there:
            there = cut.get((a, b), time) >= time
            if a < 256 and b < 256:
                break
            # the later of the two tells when to look on: a began where its right part did, b came with its left part
            a, b, time = (merges[a - 256][1], b, a) if a >= 256 and a >= b else (a, merges[b - 256][0], b)
        out.append(there)
        cut[u, v] = made
        if u == v:
            cut[u, made] = made
    return out


def _numbered(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's number and how many are made out of it, itself included: a token first, then what it begins, latest first."""
    size, made_of = [1] * len(left), left.tolist()
    for token in range(len(left) - 1, 255, -1):
        size[made_of[token]] += size[token]
    number, free, at = [0] * len(left), [0] * len(left), 0
    for byte in range(256):
        number[byte], at = at, at + size[byte]
        free[byte] = at
    for token in range(256, len(left)):  # older ones are placed from the end of their token's interval
        parent = made_of[token]
        free[parent] -= size[token]
        number[token] = free[parent]
        free[token] = number[token] + size[token]
    return np.array(number), np.array(size)


class Labels:
    """A tree of the labels as arrays: the node behind each pair of bytes, then (node, byte) -> node."""

    def __init__(self, labels: list[bytes]):
        nodes: dict[bytes, int] = {b"": 0}
        parents, at_byte, token = [0], [0], [-1]
        for k, label in sorted(enumerate(labels), key=lambda x: len(x[1])):
            node = 0
            for i in range(len(label)):
                prefix = label[: i + 1]
                if prefix not in nodes:
                    nodes[prefix] = len(parents)
                    parents.append(node)
                    at_byte.append(label[i])
                    token.append(-1)
                node = nodes[prefix]
            if label:
                token[node] = k
        keys = np.array(parents, np.int64) * 256 + np.array(at_byte)
        keys[0] = -1
        self.child = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.child]
        self.token = np.array(token, np.int32)
        self.pairs = np.zeros(1 << 16, np.int32)
        single = {p[0]: node for p, node in nodes.items() if len(p) == 1}
        self.single = np.array([single.get(b, 0) for b in range(256)], np.int32)
        for p, node in nodes.items():
            if len(p) == 2:
                self.pairs[p[0] << 8 | p[1]] = node

    def down(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node at a byte, 0 where there is none."""
        key = node.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], 0)

    def matches(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where, length, token) of every label found in the bytes; room: bytes left in the word at each position."""
        where, length, token = [], [], []
        at = np.arange(len(data), dtype=np.int32)
        node = self.single[data]
        n = 1
        while len(at):
            known = self.token[node]
            hit = known >= 0
            where.append(at[hit])
            token.append(known[hit])
            length.append(np.full(int(hit.sum()), n, np.int32))
            more = room[at] > n
            at, node = at[more], node[more]
            following = data[at + n]
            node = self.pairs[data[at].astype(np.int64) << 8 | following] if n == 1 else self.down(node, following)
            at, node = at[node > 0], node[node > 0]
            n += 1
        return np.concatenate(where), np.concatenate(length), np.concatenate(token)


class Automaton:
    """The compiled merges of a vocabulary file (the JSON text of a byte-level BPE tokenizer).

    Two merges that make the same token, or a merge that uses a token before it is made, have no automaton of this
    form; words are then merged by rank, one by one.
    """

    def __init__(self, definition: str):
        data = json.loads(definition)
        model = data["model"]
        byte_of = {c: b for b, c in enumerate(_byte_characters())}
        spell = lambda part: bytes(byte_of[c] for c in part)
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        ids = {spell(token): i for token, i in model["vocab"].items() if token not in added}
        self.added = added
        pattern, self.spaced = _split_pattern(data)
        self.split = regex.compile(pattern) if pattern else None
        self.at_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        merges = [tuple(spell(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        number = {bytes([b]): b for b in range(256)}
        rows, self.ranks = [], None
        for rank, (a, b) in enumerate(merges):
            if a not in number or b not in number or a + b in number:
                self.ranks = {pair: k for k, pair in enumerate(merges)}
                break
            rows.append((number[a], number[b]))
            number[a + b] = 256 + rank
        labels = list(number) if self.ranks is None else [bytes([b]) for b in range(256)]
        self.ids = np.array([ids[label] for label in labels], np.int32)
        self.id_of = ids if self.ranks is not None else {}
        self.sizes = np.array([len(label) for label in labels], np.int32)
        if self.ranks is None:
            arises = _can_arise(rows)
            self.gadgets = Gadgets(np.array(rows, np.int64).reshape(-1, 2), np.array(arises))
            self.labels = Labels([label if there else b"" for label, there in zip(labels, arises, strict=True)])
        # for decoding: the bytes of every id, joined
        by_id = {i: label for label, i in ids.items()} | {i: text.encode() for text, i in added.items()}
        self.label_sizes = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], np.int64)
        self.label_starts = np.cumsum(self.label_sizes) - self.label_sizes
        self.label_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(max(by_id) + 1)), np.uint8)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none may be empty), and how many each has: all words are read in step, one position at a time."""
        if self.ranks is not None:
            found = [self._merge(w) for w in words]
            return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(f) for f in found])
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int32)
        ends = np.cumsum(sizes, dtype=np.int32)
        starts = ends - sizes
        start = np.repeat(starts, sizes)
        where, length, token = self.labels.matches(data, np.repeat(ends, sizes) - np.arange(len(data), dtype=np.int32))
        position = where - start[where] + length
        order = np.argsort(position, kind="stable")
        where, length, token = where[order], length[order], token[order]
        fresh = where == start[where]
        cuts = np.searchsorted(position[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        behind = np.zeros(len(data), np.int32)  # the token that ends with each byte, on the one path that ends there
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            w, t = where[i:j], token[i:j]
            good = fresh[i:j] | self.gadgets.walks(behind[w - 1], t)
            behind[w[good] + length[i:j][good] - 1] = t[good]
        # from the ends of the words back to their starts
        last = np.zeros(len(data), bool)
        at = ends
        while len(at):
            last[at - 1] = True
            at = at - self.sizes[behind[at - 1]]
            at = at[at > start[at]] if len(at) and at[-1] < len(data) else at
        taken = np.flatnonzero(last)
        return self.ids[behind[taken]], np.diff(np.searchsorted(taken, ends), prepend=0)

    def _merge(self, word: bytes) -> list[int]:
        """Ids by merging the lowest rank first, leftmost first among equals."""
        parts: list[bytes | None] = [bytes([b]) for b in word]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or self.ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (parts[a], parts[b]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[parts[a], parts[b]], a))
        return [self.id_of[p] for p in parts if p is not None]

    def words(self, text: str) -> list[str | int]:
        """The words of a text in order; strings of added tokens are their ids."""
        out: list[str | int] = []
        for part in self.at_added.split(text) if self.at_added else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                part = " " + part if self.spaced and part[0] != " " else part
                out += self.split.findall(part) if self.split else [part]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the labels."""
        return _gather(self.label_bytes, self.label_starts[ids], self.label_sizes[ids]).tobytes()


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with these starts and counts, one after the other."""
    return values[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]


class Encoder:
    """Encodes portions of texts, and keeps up to KEPT_WORDS words that it met for as long as a task runs."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.kept: dict[str | int, int] = {}
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.automaton.words(text) for text in texts]
        new = list(set(chain.from_iterable(split)) - self.kept.keys())
        added = [w for w in new if isinstance(w, int)]
        new = [w for w in new if not isinstance(w, int)]
        spelled = [w.encode("utf-8", "replace") for w in new]
        sizes = np.cumsum([len(w) for w in spelled])
        # the kept words, then the new ones, then ids of added tokens
        ids, counts, i = [self.ids], [self.counts], 0
        while i < len(new):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + WORD_BYTES, "right")))
            some, each = self.automaton.encode_words(spelled[i:j])
            ids.append(some)
            counts.append(each)
            i = j
        flat, counts = np.concatenate([*ids, np.array(added, np.int32)]), np.concatenate([*counts, np.ones(len(added), np.int64)])
        place = self.kept | dict(zip(new + added, range(len(self.kept), len(counts)), strict=True))
        n_words = np.array([len(words) for words in split])
        word = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        starts = np.cumsum(counts) - counts
        out = _gather(flat, starts[word], counts[word])
        ends = np.concatenate([[0], np.cumsum(counts[word])])[np.cumsum(n_words)]
        if len(self.kept) < KEPT_WORDS and len(new):
            # words met often are met early; long ones are rare
            often = np.bincount(word, minlength=len(counts))[len(self.kept) : len(self.kept) + len(new)]
            best = np.argsort(-often, kind="stable")[: KEPT_WORDS - len(self.kept)]
            best = [k for k in best.tolist() if len(new[k]) <= 64]
            rows = np.array(best, np.int64) + len(self.kept)
            self.ids, self.counts = np.concatenate([self.ids, _gather(flat, starts[rows], counts[rows])]), np.concatenate([self.counts, counts[rows]])
            self.kept |= {new[k]: len(self.kept) + n for n, k in enumerate(best)}
        return np.split(out, ends[:-1]) if len(texts) else []


def compile_vocabulary(df: DataFrame, path: str):
    """The automaton of a vocabulary file as a broadcast value: some megabytes of arrays, whatever the corpus. ``path`` is read on the driver."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(Automaton(file.read()))


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def encode_texts(docs: DataFrame, path: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids (array<int>) of each whole text; a null or empty text has none. Other columns stay.

    With ``decoded``, that column gets what the ids decode to, in the same pass (one Python worker per task, not two);
    bytes that are no UTF-8 become U+FFFD. Columns of ``docs`` named ``into`` or ``decoded`` are replaced, any others
    may have any name. Repeated rows are encoded each, very long texts whole.
    """
    bound_batches(docs.sparkSession)
    automaton = compile_vocabulary(docs, path)
    kept = [c for c in docs.columns if c not in (into, decoded)]
    rows = docs.select(F.col(f"`{text}`").cast("string"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("row", rows.schema[1].dataType), *([T.StructField("decoded", T.StringType())] if decoded else [])])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(automaton.value)
        for batch in portions(batches, 0, PORTION_BYTES):
            found = encoder.encode(batch.column(0).fill_null("").to_pylist())
            columns = [_lists(found), batch.column(1)]
            if decoded:
                columns.append(pa.array([automaton.value.decode(ids).decode("utf-8", "replace") for ids in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "row", "decoded"][: len(columns)])

    both = rows.mapInArrow(tidied(encoded), schema)
    return both.select(*[F.col("row")[c].alias(c) for c in kept], F.col("ids").alias(into), *([F.col("decoded").alias(decoded)] if decoded else []))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id list; null and empty lists give an empty text."""
    bound_batches(docs.sparkSession)
    automaton = compile_vocabulary(docs, path)

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return pa.array([automaton.value.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    rest = [F.col(f"`{c}`") for c in docs.columns if c != into]
    return docs.select(*rest, decoded(F.col(ids).cast("array<long>")).alias(into))


def digest_ids(ids: str = "ids"):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
