"""Exact top-k inner products by best-first search of M-trees.

With one more component, sqrt(M - |x|^2), all candidates lie on a sphere and the largest inner products are the
smallest distances; so a metric tree serves. Candidates go to the cell of their nearest pivot, of a bounded sample; each
cell has a covering radius, and as many trees of bounded size as its candidates need. A tree's pages hold routing objects
with covering radii and distances to their parents. A query first searches the cell of its nearest pivot, and then those
others whose radius lets them hold something better than its k-th score, by the same bound that leaves out pages. Within
a tree it goes nearest page first; stored distances and the triangle inequality leave out pages and distance
computations. Scores of what is left are exact integers, and pages are left out only if they are worse by more than
rounding can make up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Vectors of a tree, of a page, queries of a block, and pivots at most.
TREE, PAGE, BLOCK, MOST_PIVOTS = 8192, 128, 16384, 2048
#: Relative slack of distances for rounding: the root of what double products of 64-bit numbers are off by.
SLACK = 1e-6


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that is null or holds null or non-finite ones."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


class Node:
    """A page: its entries' vectors, and either the vectors' own places (leaf) or, for each, a child page and its radius."""

    __slots__ = ("rows", "parent_distance", "radius", "children")

    def __init__(self, rows: np.ndarray, parent_distance: np.ndarray, radius: np.ndarray | None, children: list[Node] | None) -> None:
        self.rows, self.parent_distance, self.radius, self.children = rows, parent_distance, radius, children


class MTree:
    """Bulk-loaded over integer vectors (n, d), lifted to the sphere of the squared radius `top`."""

    def __init__(self, vectors: np.ndarray, top: int, page: int = PAGE) -> None:
        self.whole, self.vectors = vectors, vectors.astype(np.float64)
        self.norm = (self.vectors**2).sum(1)
        self.lift = np.sqrt(np.maximum(top - self.norm, 0.0))
        self.top, self.page, self.computed = float(top), page, 0
        rows = np.arange(len(vectors))
        self.root = self._build(rows, np.zeros(len(rows)))

    def _between(self, rows: np.ndarray, one: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.top - 2 * (self.vectors[rows] @ self.vectors[one] + self.lift[rows] * self.lift[one]), 0.0))

    def _build(self, rows: np.ndarray, to_parent: np.ndarray) -> Node:
        if len(rows) <= self.page:
            return Node(rows, to_parent, None, None)
        fan = min(self.page, max(2, -(-len(rows) * 2 // self.page)))
        chosen = [0]
        nearest = self._between(rows, rows[0])
        whose = np.zeros(len(rows), np.int64)
        for i in range(1, fan):  # each next routing object is the one farthest from those before
            far = int(nearest.argmax())
            if nearest[far] == 0:
                break
            d = self._between(rows, rows[far])
            closer = d < nearest
            nearest[closer], whose[closer] = d[closer], i
            chosen.append(far)
        if len(chosen) == 1:  # all alike: pages of equal vectors
            parts = [np.arange(len(rows))[i : i + self.page] for i in range(0, len(rows), self.page)]
            chosen = [int(p[0]) for p in parts]
        else:
            parts = [np.flatnonzero(whose == i) for i in range(len(chosen))]
        children, radius = [], []
        for part in parts:
            radius.append(float(nearest[part].max()))
            children.append(self._build(rows[part], nearest[part]))
        chosen = np.array(chosen)
        return Node(rows[chosen], to_parent[chosen], np.array(radius), children)

    def search(self, query: np.ndarray, k: int, banned: set[int] = frozenset()) -> list[tuple[int, int]]:
        """(score, row), best first, of at least the k best rows outside banned, with all that tie with the last."""
        q, scale = query.astype(np.float64), self.top + float((query.astype(np.float64) ** 2).sum())
        best: list[int] = []  # a heap of the k best scores
        found: list[tuple[int, int]] = []
        bound, slack = np.inf, SLACK * (1 + np.sqrt(scale))
        heap: list[tuple[float, int, Node, float | None]] = [(0.0, 0, self.root, None)]
        pushed = 1
        while heap:
            least, _, node, from_parent = heapq.heappop(heap)
            if least > bound + slack:
                break
            rows, radius = node.rows, node.radius
            if from_parent is not None and bound < np.inf:
                near = np.abs(from_parent - node.parent_distance) - (0 if radius is None else radius) <= bound + slack
                at = np.flatnonzero(near)
                if not len(at):
                    continue
            else:
                at = slice(None)
            rows = rows[at]
            self.computed += len(rows)
            if node.children is None:
                dots = self.vectors[rows] @ q if scale < 2**53 else self.whole[rows] @ query  # whole numbers either way
                if len(best) == k:
                    hold = dots >= best[0]
                    rows, dots = rows[hold], dots[hold]
                for score, row in zip(dots.tolist(), rows.tolist(), strict=True):
                    if row in banned:
                        continue
                    score = int(score)
                    if len(best) < k:
                        heapq.heappush(best, score)
                    elif score > best[0]:
                        heapq.heapreplace(best, score)
                    elif score < best[0]:
                        continue
                    found.append((score, row))
                if len(best) == k:
                    bound = np.sqrt(max(scale - 2 * best[0], 0.0))
            else:
                d = np.sqrt(np.maximum(scale - 2 * (self.vectors[rows] @ q), 0.0))
                lower = np.maximum(d - radius[at], 0.0)
                children = node.children
                index = range(len(children)) if isinstance(at, slice) else at.tolist()
                for low, i, distance in zip(lower.tolist(), index, d.tolist(), strict=True):
                    if low <= bound + slack:
                        heapq.heappush(heap, (low, pushed, children[i], distance))
                        pushed += 1
        if len(best) == k:
            found = [x for x in found if x[0] >= best[0]]
        return sorted(found, key=lambda x: -x[0])


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists.to_pylist()):
        out[i, : len(x)] = x[:width]
    return out


class Cells:
    """Pivots on the sphere of the squared radius top, and each cell's covering radius."""

    def __init__(self, pivots: np.ndarray, top: int) -> None:
        self.pivots, self.top = pivots.astype(np.float64), float(top)
        self.lift = np.sqrt(np.maximum(top - (self.pivots**2).sum(1), 0.0))
        self.radius = np.zeros(len(pivots))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of candidates."""
        v = vectors.astype(np.float64)
        lift = np.sqrt(np.maximum(self.top - (v**2).sum(1), 0.0))
        d = np.sqrt(np.maximum(2 * self.top - 2 * (v @ self.pivots.T + lift[:, None] * self.lift), 0.0))
        cell = d.argmin(1)
        return cell, d[np.arange(len(v)), cell]

    def least(self, queries: np.ndarray) -> np.ndarray:
        """The least distance, less the slack, that each query can have from something in each cell."""
        q = queries.astype(np.float64)
        scale = self.top + (q**2).sum(1)
        d = np.sqrt(np.maximum(scale[:, None] - 2 * (q @ self.pivots.T), 0.0))
        return d - self.radius - SLACK * (1 + np.sqrt(scale))[:, None]

    def reach(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance of each query from what has the score."""
        return np.sqrt(np.maximum(self.top + (queries.astype(np.float64) ** 2).sum(1) - 2 * scores, 0.0))


def _searched(members: DataFrame, sent: DataFrame, block: int, width: int, top: int, k: int) -> DataFrame:
    """(query_id, id, score): k best of each tree for each query that is sent to its cell; blocks of queries share a tree built once."""
    blocks = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("blocks"))
    asked = sent.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    parts = members.groupBy("cell").agg(F.collect_set("part").alias("parts"))
    queried = asked.join(parts, "cell").select("cell", F.explode("parts").alias("part"), "block", "id", "v").toDF("to_cell", "to_part", "to_block", "id", "v")
    held = members.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cell", "part", "block", "id", "v")

    def run(own: pa.Table, queried: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if own.num_rows and queried.num_rows:
            ids = own.column("id").to_numpy()
            m = MTree(_matrix(own.column("v").combine_chunks(), width), top)
            places: dict[int, set[int]] = {}
            for row, one in enumerate(ids.tolist()):
                places.setdefault(one, set()).add(row)
            for q, v in zip(queried.column("id").to_pylist(), _matrix(queried.column("v").combine_chunks(), width), strict=True):
                got = sorted(((-s, int(ids[r])) for s, r in m.search(v, k, places.get(q, frozenset()))))[:k]
                out.extend((q, one, -s) for s, one in got)
        a = np.array(out, np.int64).reshape(-1, 3)
        return pa.table({name: a[:, j] for j, name in enumerate(("query_id", "id", "score"))})

    return held.groupBy("cell", "part", "block").cogroup(queried.groupBy("to_cell", "to_part", "to_block")).applyInArrow(run, "query_id long, id long, score long")


def exact_top(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "vector", tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank from 1, key, score): each query's k highest inner products, ties to smaller keys, in integers.

    vectors and queries have whole-number arrays; null ones and null keys take no part, shorter ones count as filled up
    with 0. A query's own key is no candidate for it. Fewer than k candidates: all. Repeated rows are candidates each;
    a key asked more than once is one query, of its smallest vector. Components of a query past the candidates' length
    meet nothing. Empty tables give no rows. Vectors whose scores might not fit in 64 bits are refused (ValueError).
    """
    candidates = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    candidates, asked = cut(candidates), cut(asked)
    spark = candidates.sparkSession
    largest = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    sizes = [d.agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("m"), F.max(F.size("v")).alias("width")).first() for d in (candidates, asked)]
    if not sizes[0]["n"] or not sizes[1]["n"]:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    width = max(sizes[0]["width"], 1)
    if max(s["m"] for s in sizes) ** 2 * max(width, sizes[1]["width"]) >= 2.0**62:
        raise ValueError("these vectors' inner products might not fit in 64 bits")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    top = candidates.agg(F.max(norm)).first()[0]
    some = candidates.orderBy(F.xxhash64("v"), "id").limit(min(MOST_PIVOTS, -(-sizes[0]["n"] // tree))).select("v").collect()
    cells = Cells(np.unique(_matrix(pa.array([r["v"] for r in some], pa.list_(pa.int64())), width), axis=0), top)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = cells.nearest(_matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(distance), batch.column("id"), batch.column("v")], ["cell", "distance", "id", "v"])

    kind = candidates.schema["v"].dataType.simpleString()
    placed = cut(candidates.mapInArrow(place, f"cell int, distance double, id long, v {kind}"))
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"))
    for r in counted.collect():  # a row for each pivot
        cells.radius[r["cell"]] = r["radius"]
    parts = counted.select("cell", F.ceil(F.col("n") / F.lit(tree)).alias("parts"))
    members = cut(placed.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id", "v"), F.col("parts")).alias("part"), "id", "v"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to the cell that may hold what is nearest; with a score, to all others that may hold as good ones."""
        for batch in batches:
            q = _matrix(batch.column("v"), width)
            least = cells.least(q)
            home = least.argmin(1)
            wanted = np.zeros(least.shape, bool)
            if "score" in batch.schema.names:
                known = batch.column("score")
                reach = np.where(known.is_valid().to_numpy(False), cells.reach(q, known.fill_null(0).to_numpy()), np.inf)
                wanted = least <= reach[:, None]
                wanted[np.arange(len(q)), home] = False
            else:
                wanted[np.arange(len(q)), home] = True
            row, cell = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row))], ["cell", "id", "v"])

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    schema = f"cell int, id long, v {asked.schema['v'].dataType.simpleString()}"
    first = cut(ranked(_searched(members, asked.mapInArrow(go, schema), block, width, top, k)))
    last = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    sent = cut(asked.join(last, "id", "left").mapInArrow(go, schema))
    second = cut(_searched(members, sent, block, width, top, k))
    discard(candidates, asked, placed, members, sent)
    return ranked(first.drop("rank").union(second)).select("query_id", "rank", F.col("id").alias(key), "score")
