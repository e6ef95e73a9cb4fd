"""Ranked search, sharding and cross-tokenizer alignment against plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from spanlake.llm import alignment, queries, ranked, sharding

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [
    (1, "Word word other", "x", 1), (1, "Word word other", "x", 1), (2, None, None, None), (3, "", "y", 2), (None, "word lost", "y", 3), (4, "long text " * 40000, "z", 4),
    (5, "!! -- ..", "z", 5), (6, "ünïcode 日本 WORD\0nul", "z", 6), (7, "▁ <s> <|endoftext|> <0x41>", "z", 7), (8, "  a   b  \n", "z", 8),
]
COLUMNS = "doc_id long, text string, shard string, size int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_search(docs, items, k):
    found = [(d, Counter(t), len(t)) for d, t in ((d, TERM.findall(lowered(x))) for d, x in docs)]
    n_docs, n_terms = sum(n > 0 for _, _, n in found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, tf, n in found:
            m = 75 + 25 * n * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in TERM.findall(lowered(text)) if t in tf)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def search(spark, docs, items, k):
    index = ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = ranked.search_index(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in rows]


@pytest.mark.parametrize(("block", "postings", "query_block"), [(4, 200, 3), (128, 1 << 21, 512)])
def test_ranked_search_equals_scoring_everything(spark, monkeypatch, block, postings, query_block):
    for name, value in (("BLOCK", block), ("SHARD_POSTINGS", postings), ("QUERY_BLOCK", query_block)):
        monkeypatch.setattr(ranked, name, value)
    r = random.Random(3)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 20, 300])))) for i in range(300)] + [(i, "w1 w2 w3 same") for i in range(400, 440)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(8)] + [(50, "w1 w1 SAME"), (51, None), (52, "!!"), (53, "absent"), (54, "w1"), (None, "w2 w3")]
    got = search(spark, docs, items, 10)
    assert sorted(got, key=str) == sorted(plain_search(docs, items, 10), key=str) and len(got) > 80


def test_blocks_are_rejected_before_they_are_decompressed():
    r = np.random.default_rng(1)
    n, k = 20_000, 10
    lengths = r.integers(20, 400, n)
    lists = {t: np.flatnonzero(r.random(n) < p) for t, p in ((1, 0.002), (2, 0.05), (3, 0.5), (4, 0.9))}
    term, doc = (np.concatenate(x) for x in ([np.full(len(d), t, np.uint64) for t, d in lists.items()], list(lists.values())))
    order = np.lexsort((term, doc))
    tf = r.integers(1, 4, len(doc))
    shard = ranked.pack_shard(np.arange(n), lengths, term[order], doc[order].astype(np.int32), tf[order].astype(np.int32))
    scoring = ranked.Scoring(n, int(lengths.sum()))
    one = ranked.ShardSearch(shard, scoring)
    best = ranked.Best(k)
    terms = np.array([1, 2, 3, 4], np.uint64)
    weights = np.array([scoring.weight(len(lists[t])) for t in (1, 2, 3, 4)])
    one.query(terms, weights, best)
    scores = np.zeros(n, np.int64)
    for t, w in zip((1, 2, 3, 4), weights, strict=True):
        own = term == t
        scores[doc[own]] += w * scoring.part(tf[own].astype(np.int64), lengths[doc[own]])
    assert best.scores.tolist() == sorted(scores.tolist(), reverse=True)[:k]
    assert one.decompressed < 0.6 * len(shard.count)


def test_ranked_search_odd_rows(spark):
    docs = [(d, t) for d, t, _, _ in ODD]
    items = [(1, "word"), (2, "WORD lost 日本"), (3, "nul")]
    assert sorted(search(spark, docs, items, 20), key=str) == sorted(plain_search(docs, items, 20), key=str)
    assert search(spark, [], items, 5) == [] and search(spark, docs, [], 5) == []


def plain_shards(sizes: dict, shards: int) -> list[int]:
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes.values(), reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_heap_in_bulk_equals_one_by_one():
    r = random.Random(5)
    for _ in range(60):
        shards = r.randint(1, 9)
        bulk, heap = sharding.LoadHeap(shards), [(0, s) for s in range(shards)]
        for size in sorted((r.randint(0, 50) for _ in range(12)), reverse=True):
            count, taken = r.choice([1, 3, 40, 200]), [0] * shards
            for _ in range(count):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                taken[s] += 1
            assert bulk.place(size, count) == taken and sorted(bulk.heap) == sorted(heap)


@pytest.mark.parametrize("cell", [1, 5000])
def test_shards_are_largest_first(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    r = random.Random(2)
    rows = [(i, f"text {r.randint(0, 200)} " * r.randint(1, 4), "mine", 1) for i in range(700)] + ODD
    docs = spark.createDataFrame(rows, COLUMNS)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    got = sharding.assign_shards(docs, F.col("text"), size, 7, into=("bytes", "where", "slot")).collect()
    assert len(got) == len(rows) and Counter((x.doc_id, x.text, x.shard, x.size) for x in got) == Counter(rows)
    sizes, where = Counter(), {}
    for x in got:
        sizes[x.text] += len((x.text or "").encode()) + 8
        assert where.setdefault(x.text, x["where"]) == x["where"] and x.bytes == len((x.text or "").encode()) + 8
    loads = Counter()
    for text, n in sizes.items():
        loads[where[text]] += n
    assert [loads[s] for s in range(7)] == plain_shards(sizes, 7)
    for s in range(7):
        assert sorted(x.slot for x in got if x["where"] == s) == list(range(sum(x["where"] == s for x in got)))
    assert sharding.assign_shards(docs.limit(0), F.col("text"), size, 7).count() == 0


def test_shard_query_and_files(spark, tmp_path):
    rows = contract.queries()["op12_lpt_shards"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    data = {d: (t or "").encode() for d, t in texts.items()}
    assert len(rows) == len(texts) and all(r.size == len(data[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(data[r.doc_id]) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 for r in rows)
    loads, sizes = Counter(), Counter()
    for r in rows:
        loads[r.shard] += r.size
        sizes[texts[r.doc_id]] += r.size
    assert [loads[s] for s in range(24)] == plain_shards(sizes, 24)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(sharding.assign_shards(docs, F.col("text"), F.lit(1), 3), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 50 and {r.shard for r in back.collect()} == {0, 1, 2}


def plain_alignment(rows):
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    one = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    byte_of = {chr(b if b in plain else next(spare)): b for b in range(256)}
    spelled = {i: t for t, i in one.get_vocab().items()}
    found, counts = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            of_a = [bytes(byte_of[c] for c in spelled[i]) for i in a]
            of_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [two.id_to_piece(i)]]
            if b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
                cuts = [0, *sorted(set(ends_a) & set(ends_b))]
                groups = [([i for i, e in zip(a, ends_a) if x < e <= y], [i for i, e in zip(b, ends_b) if x < e <= y]) for x, y in zip(cuts, cuts[1:])] if len(text) < 5000 else None
        if groups is None:  # the same groups, in one walk
            groups, i, j = [], 0, 0
            for y in cuts[1:]:
                k, m = i, j
                while k < len(a) and ends_a[k] <= y:
                    k += 1
                while m < len(b) and ends_b[m] <= y:
                    m += 1
                groups.append((a[i:k], b[j:m]))
                i, j = k, m
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        counts.update(set(links))
        found.append((doc, groups, links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_plain_walk(spark, monkeypatch, small):
    if small:  # many segments, pieces, blocks of links, levels of the tree of sums
        for name, value in (("SEGMENT_PAIRS", 16), ("PIECE_BYTES", 16 * 18 * 5), ("FAN_IN", 2), ("LINK_BLOCK", 50), ("HELD_PAIRS", 100), ("MEMO_CHUNKS", 30), ("PORTION_BYTES", 60), ("PORTION_IDS", 20), ("CACHED_COUNTS", 8)):
            monkeypatch.setattr(alignment, name, value)
    r = random.Random(9)
    pieces = ["a", "the ", "ing", " ", "  ", "\n", "é", "日本", "1", "<|endoftext|>", "<s>", "</s>", "!!", "aaaa", "'s", "\t", "x", "--", "🙂", "▁", "<0x41>", "Wörter ", "tion "]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))) for i in range(120)] + [(d, t) for d, t, _, _ in ODD]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], COLUMNS).repartition(5)
    got = [tuple(x[c] for c in NAMES) + (hashlib.sha256(x.groups.encode()).hexdigest() if x.groups else "",) for x in alignment.align_tokenizers(docs, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")).collect()]
    assert sorted(got, key=str) == sorted(plain_alignment(rows), key=str)


def test_alignment_query(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = [tuple(x[c] for c in [*NAMES, "groups_sha256"]) for x in contract.queries()["op13_token_alignment"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(plain_alignment(rows))


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, None, "x", 1), (None, "", "x", 1)]):
        got = alignment.align_tokenizers(spark.createDataFrame(rows, COLUMNS), queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")).collect()
        assert len(got) == len(rows) and all(x.n_links == 0 and x.groups == "" for x in got)


def test_perfect_hash_is_minimal_and_verified():
    pairs = np.unique(np.random.default_rng(4).integers(0, 1 << 50, 5000))
    bits, sizes = alignment.build_levels(pairs)
    import pyarrow as pa

    row = {"segment": pa.array([0]), "n": [len(pairs)], "levels": [sizes.tobytes()], "bits": [np.packbits(bits).tobytes()]}
    table = alignment.PairTable(pa.table(row), 1)
    assert sorted(table.slots(pairs).tolist()) == list(range(len(pairs)))
    ordered = np.empty_like(pairs)
    ordered[table.slots(pairs)] = pairs
    full = alignment.PairTable(pa.table({**row, "pairs": [ordered.tobytes()], "counts": [(ordered % 97 + 1).tobytes()]}), 1)
    other = np.setdiff1d(np.random.default_rng(5).integers(0, 1 << 50, 5000), pairs)
    assert (full.count(pairs) == pairs % 97 + 1).all() and (full.count(other) == 0).all()
