"""Exact top-k by inner product with M-trees, searched best first.

Vectors are dealt to cells by their nearest routing vector (a bounded sample), cells to pages by the distance to it, and
each page is one stored row with its radius and a small M-tree: routing objects with covering radius and distance to
the parent's, entries with distance to their leaf's. For a query q and a ball around c of radius r no inner product exceeds q.c + |q| r, and
for a node or entry at distance d from its parent p none exceeds q.p + |q| (d + r), which needs no product of its own.

A query first searches one page of its best cell, which gives a k-th score, and then only pages whose ball can reach
that. All queries of a page go down its tree in blocks, so what is left to compute are products of matrices.

Of equal vectors only the k + 1 smallest ids can be in an answer, and equal queries are searched once; so copies, however many, are
never compared with one another.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.llm.groups import sorted_groups
from spanlake.session import cut_lineage

PAGE_ROWS = 4096
LEAF_ROWS = 32
FANOUT = 8
MAX_CELLS = 256
MAX_RINGS = 64
QUERY_BLOCK = 2048


class Answers:
    """The k best (score, id) of each of some queries so far, and the score that a further one needs at least."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.astype(float)
        self.held = [np.empty(0, np.int64)] * 3
        self.fresh: list[list[np.ndarray]] = [[], [], []]
        self.n = 0

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for column, part in zip(self.fresh, (query, scores, ids), strict=True):
            column.append(part)
        self.n += len(query)
        if self.n > 2 * self.k * len(self.floors) + (1 << 16):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """(query, score, id), the k best of each query; ties go to the smaller id."""
        query, scores, ids = (np.concatenate([h, *f]) for h, f in zip(self.held, self.fresh, strict=True))
        order = np.lexsort((ids, -scores, query))
        query, scores, ids = query[order], scores[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        full = rank == self.k - 1
        self.floors[query[full]] = np.maximum(self.floors[query[full]], scores[full])
        self.held = [column[rank < self.k] for column in (query, scores, ids)]
        self.fresh, self.n = [[], [], []], 0
        return self.held


class MTree:
    """A bulk-loaded M-tree over one page of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        top = int(np.abs(vectors).max(initial=0))
        self.vectors = vectors.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))
        self.exact_floats = float(top) ** 2 * max(vectors.shape[1], 1) < 2.0**52
        self.points = vectors.astype(float)
        self.nodes: list[dict] = []
        self._build(np.arange(len(ids)), self._middle(np.arange(len(ids))), 0.0)
        self.computed = self.asked = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "points"}

    def __setstate__(self, state):
        self.__dict__ = state | {"points": state["vectors"].astype(float)}

    def _middle(self, rows: np.ndarray) -> int:
        """The row nearest to the mean: its ball tends to be small."""
        return int(rows[((self.points[rows] - self.points[rows].mean(axis=0)) ** 2).sum(axis=1).argmin()])

    def _build(self, rows: np.ndarray, centre: int, parent_distance: float) -> int:
        apart = np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))
        at = len(self.nodes)
        node = {"centre": centre, "radius": float(apart.max()), "parent_distance": parent_distance}
        self.nodes.append(node)
        if len(rows) > LEAF_ROWS and node["radius"] > 0:
            routes = [int(rows[apart.argmax()])]
            near = np.full(len(rows), np.inf)
            owner = np.zeros(len(rows), int)
            for k in range(FANOUT):
                d = ((self.points[rows] - self.points[routes[k]]) ** 2).sum(axis=1)
                owner[d < near] = k
                near = np.minimum(near, d)
                if k + 1 == FANOUT or near.max() == 0:
                    break
                routes.append(int(rows[near.argmax()]))
            children = []
            for k in range(len(routes)):
                part = rows[owner == k]
                if len(part):
                    c = self._middle(part)
                    children.append(self._build(part, c, float(np.sqrt(((self.points[c] - self.points[centre]) ** 2).sum()))))
            node["children"] = np.array(children)
            node["centres"] = np.array([self.nodes[c]["centre"] for c in children])
            node["radii"] = np.array([self.nodes[c]["radius"] for c in children])
            node["reach"] = np.array([self.nodes[c]["parent_distance"] + self.nodes[c]["radius"] for c in children])
        else:
            node["rows"], node["apart"] = rows, apart
        return at

    def search(self, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[np.ndarray]:
        """(query, score, id) of the k best of each query, ties to the smaller id; those below ``floors`` may be missing.

        The queries go down the tree together. A node is opened only for the queries whose bound reaches their floor,
        and the node in which some query's bound exceeds its floor most is opened first.
        """
        q = queries.astype(float)
        lengths = np.sqrt((q**2).sum(axis=1))
        answers = Answers(np.full(len(q), -np.inf) if floors is None else floors, k)
        exact = self.exact_floats and float(np.abs(q).max(initial=0)) ** 2 * max(q.shape[1], 1) < 2.0**52

        def bound(dots, lengths, reach):
            return dots + np.where(reach > 0, lengths * reach * (1 + 1e-9) + 1e-6, 0.0)

        everyone, root = np.arange(len(q)), self.nodes[0]
        dots = q @ self.points[root["centre"]]
        heap, pushed = [(-np.inf, 0, 0, everyone, dots, bound(dots, lengths, np.float64(root["radius"])))], 1
        self.asked += len(q) * len(self.ids)
        while heap:
            _, _, at, active, dots, bounds = heapq.heappop(heap)
            open_ = bounds >= answers.floors[active]
            active, dots = active[open_], dots[open_]
            if not len(active):
                continue
            node, floor, length = self.nodes[at], answers.floors[active][:, None], lengths[active][:, None]
            reach = node["reach"] if "children" in node else node["apart"]
            needed = bound(dots[:, None], length, reach[None, :]) >= floor
            who, which = np.flatnonzero(needed.any(axis=1)), np.flatnonzero(needed.any(axis=0))
            if not len(who):
                continue
            needed, asking = needed[np.ix_(who, which)], active[who]
            self.computed += len(who) * len(which)
            if "children" in node:
                found = q[asking] @ self.points[node["centres"][which]].T
                limits = bound(found, lengths[asking][:, None], node["radii"][which][None, :])
                alive = needed & (limits >= floor[who])
                for j, child in enumerate(node["children"][which].tolist()):
                    own = np.flatnonzero(alive[:, j])
                    if len(own):
                        slack = float((limits[own, j] - answers.floors[asking[own]]).max())
                        heapq.heappush(heap, (-slack, pushed, child, asking[own], found[own, j], limits[own, j]))
                        pushed += 1
                continue
            rows = node["rows"][which]
            found = q[asking] @ self.points[rows].T if exact else queries[asking].astype(np.int64) @ self.vectors[rows].astype(np.int64).T
            i, j = np.nonzero(needed & (found >= floor[who]))
            answers.add(asking[i], found[i, j].astype(np.int64), self.ids[rows[j]])
        return answers.settle()


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x). Rows without id or vector, and vectors with a null or non-finite
    component, are left out. Of rows repeating an id the smallest vector counts. Empty vectors are vectors of length 0."""
    clean = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    sound = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = clean.where(sound).select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return whole.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(flat), dim)


def _route(routes: dict[int, np.ndarray]):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("dim", pa.int32()), ("cell", pa.int32()), ("apart", pa.float64())])

    def run(batches):
        for batch in batches:
            dims = np.array([len(x) for x in batch.column(1)])
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                points = _matrix(part.column(1), dim).astype(float)
                centres = routes.get(int(dim), np.zeros((1, int(dim))))
                nearest, apart = np.zeros(len(points), int), np.full(len(points), np.inf)
                for k, c in enumerate(centres):
                    d = np.sqrt(((points - c) ** 2).sum(axis=1))
                    nearest[d < apart] = k
                    apart = np.minimum(apart, d)
                n = len(points)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(n, dim, np.int32)), pa.array(nearest.astype(np.int32)), pa.array(apart)], schema=schema)

    return run


def _plant(batches):
    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("page", pa.int64()), ("reach", pa.float64()), ("tree", pa.binary())])
    for group in sorted_groups(batches, ["dim", "cell", "page"]):
        dim = group.column("dim")[0].as_py()
        tree = MTree(group.column("vec_id").to_numpy(), _matrix(group.column("v"), dim))
        row = [group.column("dim")[0], group.column("cell")[0], group.column("page")[0], pc.max(group.column("apart")), pa.scalar(pickle.dumps(tree, 5))]
        yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)


def build_index(vectors: DataFrame, k: int) -> tuple[DataFrame, dict[int, np.ndarray], DataFrame]:
    """The stored pages (dim, cell, page, tree), the routing vectors per dimension, and the table (dim, cell, page, reach).

    Routing vectors are at most MAX_CELLS sampled rows. A cell larger than a page is split by the distance to its
    routing vector into at most MAX_RINGS rings, each with the radius of its outermost vector, and a ring that is
    still larger by hash.
    """
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    kept = cut_lineage(vectors.withColumn("_n", rank).where(F.col("_n") <= k + 1).drop("_n"))
    rows = kept.count()
    cells = min(MAX_CELLS, max(1, -(-rows // PAGE_ROWS)))
    sample = kept.orderBy(F.xxhash64("v"), "vec_id").limit(cells).select("v").collect()
    routes: dict[int, list] = {}
    for r in sample:
        routes.setdefault(len(r.v), []).append(r.v)
    centres = {d: np.array(v, float).reshape(len(v), d) for d, v in routes.items()}
    placed = cut_lineage(kept.mapInArrow(_route(centres), "vec_id long, v array<long>, dim int, cell int, apart double"))
    quantiles = F.percentile_approx("apart", [n / MAX_RINGS for n in range(1, MAX_RINGS)], 1000)
    sized = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / PAGE_ROWS).alias("pages"), quantiles.alias("marks"))
    # of the 63 marks those that cut a cell into as many rings as it has pages
    rings = F.least("pages", F.lit(MAX_RINGS))
    cuts = F.filter("marks", lambda m, i: F.floor((i + 1) * rings / MAX_RINGS) > F.floor(i * rings / MAX_RINGS))
    sized = cut_lineage(sized.select("dim", "cell", cuts.alias("cuts"), F.ceil(F.col("pages") / MAX_RINGS).alias("deals")))
    ring = F.size(F.filter("cuts", lambda m: m < F.col("apart"))).cast("long")
    page = ring * F.col("deals") + F.pmod(F.xxhash64("vec_id"), "deals")
    paged = placed.join(sized, ["dim", "cell"]).select("dim", "cell", page.alias("page"), "vec_id", "v", "apart")
    dealt = paged.repartition("dim", "cell", "page").sortWithinPartitions("dim", "cell", "page", "vec_id")
    index = cut_lineage(dealt.mapInArrow(_plant, "dim int, cell int, page long, reach double, tree binary"))
    # stored apart from the trees, so that its size is known to be small
    return index, centres, cut_lineage(index.select("dim", "cell", "page", "reach"))


def _choose_cells(centres: dict[int, np.ndarray], radii: dict[tuple[int, int], float], only_best: bool):
    """Cells of each query (q, v, floor and any further columns), with its product with their centre and its length: the best cell, or all whose ball reaches the floor."""
    found = [("dim", pa.int32()), ("cell", pa.int32()), ("dot", pa.float64()), ("length", pa.float64())]

    def run(batches):
        for batch in batches:
            schema = pa.schema([*batch.schema, *map(pa.field, *zip(*found, strict=True))])
            floors = batch.column(2).to_numpy(zero_copy_only=False)
            dims = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                q = _matrix(batch.column(1).take(pa.array(own)), dim).astype(float)
                known = centres.get(dim, np.zeros((1, dim)))
                radius = np.array([radii.get((dim, c), -1.0) for c in range(len(known))])
                there = np.flatnonzero(radius >= 0)
                if not len(there):
                    continue
                dots, lengths = q @ known[there].T, np.sqrt((q**2).sum(axis=1))
                if only_best:
                    chosen = np.zeros(dots.shape, bool)
                    chosen[np.arange(len(q)), dots.argmax(axis=1)] = True
                else:
                    chosen = dots + lengths[:, None] * radius[there] * (1 + 1e-9) + 1e-6 >= floors[own][:, None]
                i, j = np.nonzero(chosen)
                taken = batch.take(pa.array(own[i]))
                more = [np.full(len(i), dim, np.int32), there[j].astype(np.int32), dots[i, j], lengths[i]]
                yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, more)], schema=schema)

    return run


def _search(k: int):
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        place = tree = None
        for group in sorted_groups(batches, ["dim", "cell", "page", "lane", "block"]):
            here = tuple(group.column(c)[0].as_py() for c in ("dim", "cell", "page", "lane"))
            if group.column("block")[0].as_py() < 0:  # the page itself, which comes before its queries
                place, tree = here, group.column("tree")[0].as_py()
                continue
            if place != here:
                continue
            if isinstance(tree, bytes):
                tree = pickle.loads(tree)
            query, scores, ids = tree.search(_matrix(group.column("v"), here[0]), k, group.column("floor").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(group.column("q").to_numpy()[query]), pa.array(ids), pa.array(scores)], schema=schema)

    return run


def _lanes(blocks: int, pages: int, partitions: int) -> int:
    """Tasks that share the queries of a page, each with a copy of it: as many as use all tasks, and else few compared with the blocks of queries."""
    return min(blocks, max(-(-2 * partitions // max(pages, 1)), math.isqrt(blocks - 1) + 1))


def _ask(index: DataFrame, chosen: DataFrame, blocks: int, lanes: int, k: int) -> DataFrame:
    """Search the pages that ``chosen`` (q, v, floor, dim, cell, page) names, a block of queries at a time."""
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    asked = chosen.select("dim", "cell", "page", (block % lanes).alias("lane"), block.alias("block"), "q", "v", "floor", F.lit(None).cast("binary").alias("tree"))
    nothing = {"q": "long", "v": "array<long>", "floor": "double"}
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    stored = index.select("dim", "cell", "page", lane, F.lit(-1).alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "tree")
    keys = ["dim", "cell", "page", "lane"]
    both = asked.unionByName(stored).repartition(*keys).sortWithinPartitions(*keys, "block")
    return both.mapInArrow(_search(k), "q long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, v) the k best of ``vectors`` (vec_id, v) but its own id.

    Scores are integer inner products (they must fit a long), ties go to the smaller vec_id; a query with fewer than k
    candidates gets all. Vectors of other lengths than the query's are no candidates. Ids are unique in both tables
    (``integer_vectors`` sees to it).
    """
    index, centres, table = build_index(vectors, k)
    radii = {(r.dim, r.cell): r.radius for r in table.groupBy("dim", "cell").agg(F.max("reach").alias("radius")).collect()}  # MAX_CELLS rows and one per further length
    groups = cut_lineage(queries.groupBy("v").agg(F.min("vec_id").alias("q")))
    blocks = max(1, -(-groups.count() // QUERY_BLOCK))
    lanes = _lanes(blocks, table.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = groups.select("q", "v", F.lit(float("-inf")).alias("floor"))
    columns = "dim int, cell int, dot double, length double"
    # A row for each page: of PAGE_ROWS vectors, or the last of a ring or of a length. A query meets up to all cells, which
    # Spark's estimate doesn't see, so the pages are named as the side to broadcast.
    pages = F.broadcast(table.groupBy("dim", "cell").agg(F.sort_array(F.collect_list("page")).alias("pages")))
    home = asked.mapInArrow(_choose_cells(centres, radii, True), f"q long, v array<long>, floor double, {columns}").join(pages, ["dim", "cell"])
    one = F.element_at("pages", (F.pmod(F.xxhash64("q"), F.size("pages")) + 1).cast("int"))
    home = cut_lineage(home.select("q", "v", "floor", "dim", "cell", one.alias("page")))
    first = cut_lineage(_ask(index, home, blocks, lanes, k + 1))
    reached = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    # a query that has no page at home has none anywhere
    floor = F.when(F.col("n") > k, F.col("least").cast("double")).otherwise(float("-inf")).alias("floor")
    floors = home.drop("floor").join(reached, "q", "left").select("q", "v", floor, F.col("cell").alias("home_cell"), F.col("page").alias("home_page"))
    others = floors.mapInArrow(_choose_cells(centres, radii, False), f"q long, v array<long>, floor double, home_cell int, home_page long, {columns}")
    others = others.join(F.broadcast(table), ["dim", "cell"]).where((F.col("cell") != F.col("home_cell")) | (F.col("page") != F.col("home_page")))
    others = others.where(F.col("dot") + F.col("length") * F.col("reach") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
    found = first.unionByName(_ask(index, others, blocks, lanes, k + 1))
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = cut_lineage(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n"))
    each = queries.join(groups, "v").select(F.col("vec_id").alias("query_id"), "q")
    answer = each.join(best, "q").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answer.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
