"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

Two small collections of band hashes A and B are made per document, and the key of hash table (i, j) is the pair
(A_i, B_j): ``bands`` squared tables from 2 * bands * rows minhashes instead of bands^2 * 2 * rows. Two documents of
similarity s meet unless no A or no B agrees, which happens with probability 2 * (1 - s^rows)^bands at most:
0.00001 at s = 0.8 with the defaults, less above.

How it runs, and why no step needs all pairs of a bucket:

1. One pass over the texts gives each document the size and fingerprint of its set and its band hashes. Copies (equal sets) fold into their smallest doc_id before anything else.
2. A table key is only formed from band hashes that at least two documents share: most documents drop out here.
3. Each document is compared with one document, the smallest of its buckets. Confirmed links give components. In some
   further turns each document of a bucket with several components is compared with another one, chosen by hash.
4. The documents of buckets that still hold several components are joined exactly: similar sets share one of the
   rarest shingles of each, so documents that merely hold the same passage don't meet, however many they are. The groups
   of such a shingle are searched whole, in blocks of members that bound a task. Only similar pairs of different
   components come out; they are confirmed and the components are formed again. No bucket or candidate is capped.

The output is one row per document; links inside a known component are never written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.batches import bound_batches, tidied
from spanlake.llm.components import connected_components
from spanlake.llm.groups import sorted_groups
from spanlake.llm.words import mix, slices, windows
from spanlake.session import cut_lineage

BLOCK = 1024
STAR_TURNS = 1


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the column ``text``, in row order."""
    for piece in slices(batch.column(batch.schema.get_field_index("text"))):
        starts, ends = piece.word_bounds()
        hashes = piece.hashes(starts, ends, lower=True)
        cuts = np.searchsorted(starts, piece.offsets)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            words = hashes[a:b]
            if len(words) == 0:
                yield np.empty(0, np.uint64)
            elif len(words) < size:
                yield windows(words, len(words)) ^ np.uint64(len(words))
            else:
                yield np.unique(windows(words, size))


def minhashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        part = shingles[k : k + 2048, None] * factors[None, :]
        np.minimum(best, (part ^ (part >> np.uint64(32))).min(axis=0), out=best)
    return best


def _profiles(words: int, bands: int, rows: int):
    count = 2 * bands * rows
    factors = np.random.default_rng(7).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = mix(np.arange(1, 2 * bands + 1, dtype=np.uint64))
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            prints, sizes, keys = [], [], []
            for shingles in shingle_sets(batch, words):
                sizes.append(len(shingles))
                if not len(shingles):
                    prints.append(None), keys.append(None)
                    continue
                prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                least = minhashes(shingles, factors)
                banded = least.reshape(2 * bands, rows)
                key = salt.copy()
                for k in range(rows):
                    key = mix(key * np.uint64(3) + banded[:, k])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((prints, sizes, keys), schema.types[1:], strict=True))], schema=schema)

    return run


def _sets(words: int):
    schema = pa.schema([("rep", pa.int64()), ("fingerprint", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            sets = [x.view(np.int64) for x in shingle_sets(batch, words)]
            prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sets, schema.types[2])], schema=schema)

    return run


def _linked_pairs(percent: int):
    """Pairs of different components in one block pair of a group whose sets, folded to 31 bits, are similar enough.

    Folding can only add to what two sets share, so no similar pair is missed.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for group in sorted_groups(batches, ["key", "p", "q"]):
            side = group.column("block").to_numpy()
            p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
            ids, comp, n = (group.column(c).to_numpy() for c in ("rep", "component", "n_shingles"))
            folded = group.column("folded").combine_chunks()
            sizes = folded.value_lengths().to_numpy()
            names, values = np.unique(folded.flatten().to_numpy(), return_inverse=True)
            sets = np.split(values, np.cumsum(sizes)[:-1])
            left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)
            both, cuts = np.concatenate([sets[r] for r in right]), np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
            flags = np.zeros(len(names), np.int32)
            found = []
            for i in left:
                if (comp[right] == comp[i]).all():
                    continue
                flags[sets[i]] = 1
                common = np.add.reduceat(flags[both], cuts)
                flags[sets[i]] = 0
                good = (comp[right] != comp[i]) & (100 * common >= percent * (n[right] + n[i] - common))
                if p == q:
                    good &= right > i
                found.append(np.stack([np.full(good.sum(), ids[i]), ids[right[good]]]))
            if found:
                u, v = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=schema)

    return run


def _bucketed_sets(reps: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the representatives ``reps`` (rep, fingerprint), from the whole texts that bear their ids."""
    named = texts.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    sets = named.mapInArrow(tidied(_sets(words)), "rep long, fingerprint binary, shingles array<long>").join(reps, ["rep", "fingerprint"], "left_semi")
    return cut_lineage(sets.groupBy("rep", "fingerprint").agg(F.any_value("shingles").alias("shingles")).drop("fingerprint"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v").distinct()


def _shared_shingles(sets: DataFrame) -> DataFrame:
    """(rep, n, s): the shingles of each set that another one holds too, as (count, key) from the rarest on."""
    each = sets.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    held = sets.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    return each.join(held, "key").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("s"))


def _rare_prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(key, rep): the shingles by which a set must meet any set similar enough.

    Ordered by how many sets hold it, a set of n shingles shares one of its first n - ceil(n * percent / 100) + 1 with
    each such set. Those that no other set holds take up places but are not returned.
    """
    places = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - F.size("s"))
    return shared.where(places > 0).select("rep", F.explode(F.slice("s", 1, places)).alias("s")).select(F.col("s.key").alias("key"), "rep").distinct()


def _with_components(links: DataFrame, table: DataFrame) -> DataFrame:
    found = connected_components(links).withColumnRenamed("id", "rep")
    return cut_lineage(table.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")))


def near_duplicate_classes(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 12, rows: int = 2) -> DataFrame:
    """Class of each document: columns doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id (integer) and text; further columns are ignored, whatever their names. Words are lower-cased
    in A-Z. A text with fewer than ``words`` words has its whole sequence as its one shingle; a null or empty text has
    none and is linked with nothing. Documents are linked if 100 * common >= percent * union of their sets;
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks the document bearing it. Repeated rows
    each come back with the class of their text. A row without doc_id can't be named as a class: its component_id is
    null and it is kept. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = cut_lineage(columns.mapInArrow(tidied(_profiles(words, bands, rows)), "doc_id long, fingerprint binary, n_shingles long, bands array<long>"))
    named = profile.where("doc_id is not null and n_shingles > 0")
    reps = cut_lineage(
        named.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n_shingles", "bands")])
    )
    # Band hashes that two documents share, then the table keys that are pairs of them.
    hashes = reps.select("rep", F.posexplode("bands").alias("i", "h"))
    shared = hashes.groupBy("i", "h").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").select("i", "h")
    kept = hashes.join(shared, ["i", "h"], "left_semi")
    sides = kept.groupBy("rep").agg(
        F.collect_list(F.when(F.col("i") < bands, F.col("h"))).alias("a"), F.collect_list(F.when(F.col("i") >= bands, F.col("h"))).alias("b")
    )
    tables = sides.select("rep", F.explode("a").alias("a"), "b").select("rep", F.explode(F.transform("b", lambda b: F.xxhash64(F.col("a"), b))).alias("key"))
    tables = cut_lineage(tables)
    buckets = tables.groupBy("key").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).where("u < top").select("key", "u")
    stars = tables.join(buckets, "key").where("rep > u").groupBy(F.col("rep").alias("v")).agg(F.min("u").alias("u")).select("u", "v")
    members = cut_lineage(tables.join(buckets.select("key"), "key", "left_semi"))
    met = cut_lineage(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "fingerprint", "n_shingles"))
    sets = _bucketed_sets(met.select("rep", "fingerprint"), columns, words)
    links = cut_lineage(_confirmed(stars, sets, percent))
    classed = _with_components(links, met)
    # Further centres, chosen by hash, as long as they join components up.
    still = members
    for turn in range(STAR_TURNS):
        placed = still.join(classed.select("rep", "component"), "rep")
        centres = placed.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("rep", "component"), F.xxhash64("rep", F.lit(turn))).alias("c")
        ).where("lo < hi").select("key", "c")
        opened = cut_lineage(placed.join(centres, "key"))
        tried = opened.where("component <> c.component").groupBy("rep").agg(F.min_by("c.rep", F.xxhash64("c.rep", F.lit(turn))).alias("centre"))
        found = cut_lineage(_confirmed(tried.select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v")).distinct(), sets, percent))
        still = opened.select("key", "rep")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        classed = _with_components(links, met)
    # Then the documents of buckets which that has not joined up: all their pairs, through the rarest shingles.
    member = still.join(classed.select("rep", "component"), "rep")
    unsettled = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest_ids = cut_lineage(still.join(unsettled, "key", "left_semi").select("rep").distinct())
    shared = cut_lineage(_shared_shingles(sets.join(rest_ids, "rep", "left_semi")))
    prefixes = cut_lineage(_rare_prefixes(shared, percent))
    folded = shared.select("rep", F.transform("s", lambda x: x["key"].bitwiseAND(0x7FFFFFFF).cast("int")).alias("folded"))
    member = prefixes.join(classed.select("rep", "component"), "rep")
    open_groups = (
        member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("same"))
        .where("lo < hi").groupBy("size", "same").agg(F.min("key").alias("key")).select("key", "size")
    )
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows_ = (
        prefixes.join(cut_lineage(open_groups), "key").join(classed, "rep").join(folded, "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "component", "n_shingles", "folded")
    )
    dealt = rows_.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    rest = cut_lineage(dealt.mapInArrow(tidied(_linked_pairs(percent)), "u long, v long").distinct())
    first = classed.select("rep", "component")
    if not rest.isEmpty():
        first = _with_components(links.unionByName(_confirmed(rest, sets, percent)), met).select("rep", "component")
    folded = reps.select("fingerprint", "rep").join(first.distinct(), "rep", "left")
    folded = folded.select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    out = profile.select("doc_id", "n_shingles", "fingerprint").join(folded, "fingerprint", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest doc_id, once.

    All columns stay, whatever their names. Rows without doc_id stay. Of rows repeating the doc_id that stays, one is kept.
    """
    classes = near_duplicate_classes(docs.select("doc_id", "text"), words, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.where("id is not null").join(cut_lineage(classes), "id", "left_semi").dropDuplicates(["id"])
    return named.unionByName(rows.where("id is null")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
