"""Exact top-k by inner product with M-trees and best-first search.

A further component makes all vectors equally long (for a query it is 0), so the largest inner product is the smallest
Euclidean distance, which is a metric. Rows are dealt to the nearest of a bounded number of routing objects and, where one
draws many, over several trees. A tree's nodes hold a routing object, its covering radius and its distance to the
parent's; leaves are pages of rows with their distances to the page's object. The search takes the node with the least
possible distance first; the triangle inequality with the stored distances rules children and rows out before any
distance to them is computed, and ends the search once no node can hold a better row.

Queries first search the trees of their own routing object; the k-th score found there rules out routing objects whose
covering radius leaves no better row; the rest are searched with that score as the bound. Blocks of queries meet trees.

Cases: vectors that are null, or hold nulls or non-finite components, and rows without id take no part; vectors of other
dimensions than the query's aren't its candidates; ties go to the smaller id, equal ids count as the rows they are; a query with
fewer than k candidates gets all. Scores are exact integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

SCALE = 256.0
#: Rows of a leaf, children of a node, rows of a tree, queries of a block; and at most so many routing objects.
LEAF, FAN, TREE_ROWS, QUERY_BLOCK, MOST_ROUTES = 256, 16, 4096, 512, 1024
SLACK = 1e-3
ROWS = "row long, vec_id long, dim int, v binary, norm2 double"


def quantise(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Rows that take part, with floor(scale * x) of each component as little-endian int64."""

    def work(batches):
        for batch in batches:
            rows, ids, dims, out, norms = [], [], [], [], []
            for row, i, v in zip(*(batch.column(k) for k in range(3)), strict=True):
                if not v.is_valid or not i.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(x * scale)
                rows.append(row.as_py())
                ids.append(i.as_py())
                dims.append(len(q))
                out.append(q.astype("<i8").tobytes())
                norms.append(float(q @ q))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], names=["row", "vec_id", "dim", "v", "norm2"])

    return vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long"), vector).mapInArrow(work, ROWS)


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors from a binary column: int64, a row each."""
    return np.frombuffer(b"".join(column), "<i8").reshape(-1, dim)


def _working(v: np.ndarray) -> np.ndarray:
    """As float64 where all inner products are exact in it, else the integers themselves."""
    top = float(np.abs(v).max(initial=0))
    return v.astype(np.float64) if top * top * max(1, v.shape[1]) < 2**52 else v


class Tree:
    """An M-tree over rows of integer vectors; ``most`` is the squared length that all get."""

    def __init__(self, v: np.ndarray, most: float):
        self.v, self.most = _working(v), most
        self.extra = np.sqrt(np.maximum(0.0, most - (v.astype(np.float64) ** 2).sum(axis=1)))
        #: Of each node: routing row, covering radius, distance to the parent's, first child or -1, and the end; leaves: their rows' range.
        self.nodes: list[tuple] = []
        self.order = np.arange(len(v))
        self.own = np.zeros(len(v))
        self._build()
        self.by_node = [np.array(c) for c in zip(*self.nodes, strict=True)]

    def _between(self, rows: np.ndarray, at: int) -> np.ndarray:
        s = self.v[rows] @ self.v[at] + self.extra[rows] * self.extra[at]
        return np.sqrt(np.maximum(0.0, 2.0 * self.most - 2.0 * s))

    def _build(self) -> None:
        order, end = [], 0
        self.nodes.append(None)
        todo = [(0, np.arange(len(self.v)), 0, 0.0)]
        while todo:
            at, rows, centre, to_parent = todo.pop()
            d = self._between(rows, centre)
            radius = float(d.max(initial=0.0))
            if len(rows) <= LEAF or radius == 0.0 and len(rows) <= 4 * LEAF:
                self.nodes[at] = (centre, radius, to_parent, -1, end, end + len(rows))
                self.own[rows] = d
                order.append(rows)
                end += len(rows)
                continue
            # Routing objects far from each other; each row goes to the nearest.
            picks, near, which = [centre], d.copy(), np.zeros(len(rows), np.int64)
            while len(picks) < min(FAN, -(-len(rows) // (LEAF // 2))):
                far = int(near.argmax())
                if near[far] == 0.0:
                    break
                picks.append(int(rows[far]))
                e = self._between(rows, picks[-1])
                closer = e < near
                which[closer], near[closer] = len(picks) - 1, e[closer]
            if len(picks) == 1:  # all alike: pages of equal rows
                parts = [(centre, p) for p in np.array_split(rows, -(-len(rows) // LEAF))]
            else:
                parts = [(p, rows[which == k]) for k, p in enumerate(picks)]
            first = len(self.nodes)
            self.nodes[at] = (centre, radius, to_parent, first, first, first + len(parts))
            self.nodes += [None] * len(parts)
            todo += [(first + k, part, p, float(self._between(np.array([p]), centre)[0])) for k, (p, part) in enumerate(parts)]
        self.order = np.concatenate(order) if order else self.order

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, own_row: int, rows: np.ndarray, floor: float | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) by score, then id; ``floor``: a score that k other rows are known to reach."""
        centre, radius, parent, child, first, last = self.by_node
        dtype = self.v.dtype
        q = q.astype(dtype)
        length = float((q.astype(np.float64) ** 2).sum()) + self.most
        away = lambda s: np.sqrt(np.maximum(0.0, length - 2.0 * s))
        best: list[tuple[int, int]] = []  # a heap: the worst is the first; ids are negated
        bound = float("inf") if floor is None else float(away(np.float64(floor))) + SLACK
        d0 = float(away(np.float64(self.v[centre[0]] @ q)))
        heap = [(max(0.0, d0 - radius[0]), 0, d0)]
        while heap:
            least, node, d = heapq.heappop(heap)
            if least > bound:
                break
            a, b = first[node], last[node]
            if child[node] < 0:
                at = self.order[a:b]
                if bound < float("inf"):
                    at = at[np.abs(d - self.own[at]) <= bound]
                if not len(at):
                    continue
                scores = self.v[at] @ q
                if len(best) == k:
                    fine = scores >= best[0][0]
                    at, scores = at[fine], scores[fine]
                elif len(at) > k:
                    cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    fine = scores >= cut
                    at, scores = at[fine], scores[fine]
                for s, i, r in zip(scores.tolist(), ids[at].tolist(), rows[at].tolist(), strict=True):
                    if r == own_row:
                        continue
                    entry = (int(s), -i)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    bound = min(bound, float(away(np.float64(best[0][0]))) + SLACK)
                continue
            kids = np.arange(a, b)
            if bound < float("inf"):
                kids = kids[np.abs(d - parent[kids]) - radius[kids] <= bound]
            if len(kids):
                to = away((self.v[centre[kids]] @ q).astype(np.float64))
                low = np.maximum(0.0, to - radius[kids])
                for x, n, e in zip(low.tolist(), kids.tolist(), to.tolist(), strict=True):
                    if x <= bound:
                        heapq.heappush(heap, (x, n, e))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _search_all(trees: DataFrame, pairs: DataFrame, k: int, most: float) -> DataFrame:
    """pairs: (tree, query rows with a floor or null); returns (query, query_id, vec_id, score), at most k a tree and query."""

    def work(key, left, right):
        if not left.num_rows or not right.num_rows:
            return
        dim = left.column("dim")[0].as_py()
        v = _matrix(left.column("v").to_pylist(), dim)
        tree = Tree(v, most)
        ids, rows = left.column("vec_id").to_numpy(), left.column("row").to_numpy()
        qs = _matrix(right.column("q_v").to_pylist(), dim)
        out: list[tuple] = []
        for row, i, floor, q in zip(right.column("q_row").to_pylist(), right.column("q_vec_id").to_pylist(), right.column("q_floor").to_pylist(), qs, strict=True):
            out += [(row, i, j, s) for s, j in tree.search(q, k, ids, row, rows, floor)]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query", "query_id", "vec_id", "score"])

    # A block of queries and a tree make a task's group: both are bounded. The tree's rows go to each block that asks for them.
    pairs = pairs.select(*[F.col(c).alias(f"q_{c}") for c in ("tree", "part", "row", "vec_id", "v", "floor")])
    asked = pairs.select(F.col("q_tree").alias("tree"), F.col("q_part").alias("part")).distinct()
    left = trees.join(asked, "tree").select("tree", "part", "row", "vec_id", "dim", "v")
    return left.groupBy("tree", "part").cogroup(pairs.groupBy("q_tree", "q_part")).applyInArrow(lambda key, a, b: pa.Table.from_batches(list(work(key, a, b)), pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "score")])), "query long, query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best other rows."""
    rows = stage(quantise(vectors, vec_id, vector), "mtree-rows")
    facts = rows.groupBy("dim").agg(F.max("norm2").alias("most"), F.count("*").alias("n")).collect()  # a row for each dimension
    outs = []
    for f in facts:
        outs.append(_top_k_of(rows.where(F.col("dim") == f["dim"]), f["dim"], f["most"], f["n"], k, every))
    out = outs[0] if outs else rows.selectExpr("vec_id as query_id", "dim as rank", "vec_id", "row as score")
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def _top_k_of(rows: DataFrame, dim: int, most: float, n: int, k: int, every: int) -> DataFrame:
    # Routing objects: a bounded sample; every row is dealt to one.
    routes = max(1, min(MOST_ROUTES, n // TREE_ROWS))
    picked = rows.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(routes).collect()
    centres = _matrix([bytes(r["v"]) for r in picked], dim)

    def nearest(batches):
        c = _working(centres)
        extra = np.sqrt(np.maximum(0.0, most - (centres.astype(np.float64) ** 2).sum(axis=1)))
        for batch in batches:
            v = _matrix(batch.column(3).to_pylist(), dim)
            own = np.sqrt(np.maximum(0.0, most - (v.astype(np.float64) ** 2).sum(axis=1)))
            d = np.sqrt(np.maximum(0.0, 2.0 * most - 2.0 * ((v.astype(c.dtype) @ c.T).astype(np.float64) + np.outer(own, extra))))
            which = d.argmin(axis=1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which.astype(np.int32)), pa.array(d[np.arange(len(v)), which])], names=[*batch.schema.names, "route", "away"])

    dealt = stage(rows.mapInArrow(nearest, ROWS + ", route int, away double"), "mtree-routes")
    sizes = dealt.groupBy("route").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row for each routing object
    spread = {r["route"]: max(1, -(-r["n"] // TREE_ROWS)) for r in sizes}
    radius = {r["route"]: r["radius"] for r in sizes}
    trees_of = F.element_at(F.create_map(*[F.lit(x) for kv in spread.items() for x in kv]), F.col("route"))
    trees = dealt.withColumn("tree", F.concat_ws("-", "route", F.pmod(F.xxhash64("row"), trees_of)))

    queries = dealt.where(F.col("vec_id") % every == 0)
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("part")
    own = queries.select("row", "vec_id", "v", "route", F.lit(None).cast("double").alias("floor"), part)
    at_home = own.withColumn("tree", F.explode(F.transform(F.sequence(F.lit(0), trees_of.cast("int") - 1), lambda i: F.concat_ws("-", "route", i))))
    first = stage(_search_all(trees, at_home.select("tree", "part", "row", "vec_id", "v", "floor"), k, most), "mtree-home")
    if len(spread) == 1:
        return _top(first, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    floors = _top(first, k).groupBy("query").agg(F.min("score").cast("double").alias("found"), F.count("*").alias("c")).select("query", F.when(F.col("c") == k, F.col("found")).alias("least"))

    def elsewhere(batches):
        c = _working(centres)
        order = np.array(sorted(radius))
        r = np.array([radius[i] for i in order])
        for batch in batches:
            v = _matrix(batch.column(2).to_pylist(), dim)
            length = (v.astype(np.float64) ** 2).sum(axis=1) + most
            d = np.sqrt(np.maximum(0.0, length[:, None] - 2.0 * (v.astype(c.dtype) @ c[order].T).astype(np.float64)))
            low = np.maximum(0.0, d - r - SLACK)
            least = np.array([-np.inf if x is None else x for x in batch.column(4).to_pylist()], np.float64)
            open_ = (length[:, None] - low**2) / 2.0 >= least[:, None]
            home = np.array(batch.column(3).to_pylist())
            routes = [[int(order[j]) for j in np.flatnonzero(o) if order[j] != h] for o, h in zip(open_, home, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.list_(pa.int32()))], names=[*batch.schema.names, "routes"])

    asked = own.join(floors, F.col("row") == F.col("query"), "left").select("row", "vec_id", "v", "route", "least", "part")
    asked = asked.mapInArrow(elsewhere, "row long, vec_id long, v binary, route int, least double, part int, routes array<int>")
    asked = asked.select("row", "vec_id", "v", "part", F.col("least").alias("floor"), F.explode("routes").alias("route"))
    asked = asked.withColumn("tree", F.explode(F.transform(F.sequence(F.lit(0), trees_of.cast("int") - 1), lambda i: F.concat_ws("-", "route", i))))
    rest = _search_all(trees, asked.select("tree", "part", "row", "vec_id", "v", "floor"), k, most)
    return _top(first.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
