"""Exact top-k by inner product with a KD-tree for each shard.

Vectors are dealt to shards by space: the upper levels of one KD-tree, built
from a bounded sample (``SAMPLE``), give at most ``CELLS`` cells, and a cell with
too many rows is cut by a hash of the id.  A shard's task builds the lower
levels (median splits of the widest dimension, tight boxes) and searches them
best first: nodes come off a heap by the greatest inner product that their box
allows, until that is less than the query's kth score.

A query first searches its own shard; the kth score found there goes with it
to those other shards whose cell's box can reach it, where it prunes from the
start.  Queries stream past the tree, ``QUERY_ROWS`` of them to a copy of it, so
``n`` vectors and ``q`` queries move ``n q (1 / QUERY_ROWS + 1 / SHARD_ROWS)`` rows
at most.  Partial results (k rows a query and shard) are merged by rank.

Equal vectors of a shard are one point of the tree with the ids of least
number, as many as can be among the k best, so copies cost no comparisons.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id; vectors are compared with those of
their own dimension; of an id with several vectors the greatest counts (in the
order of their components), and an id is never its own partner; equal scores
go to the lesser id; components and scores beyond 64 bits are held at the
limit; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width
from .words import runs_of

#: Rows of a shard at most, and at least where the table is small; queries that share a copy of a tree; points of a leaf.
SHARD_ROWS, LEAST_ROWS, QUERY_ROWS, LEAF = 65_536, 4096, 65_536, 512
#: Vectors that place the cells, and cells: what tasks get with them is a few megabytes.
SAMPLE, CELLS = 32_768, 4096
FOUND = "query_id long, vec_id long, score long"
PLACED = "dim int, cell int, vec_id long, v array<long>"
_MOST = (1 << 63) - 1


def matrix_of(batch: pa.RecordBatch, a: int, b: int, dim: int) -> np.ndarray:
    """Rows ``a`` to ``b``, all of ``dim`` components, of the column ``v``."""
    return batch.column("v").slice(a, b - a).flatten().to_numpy().reshape(b - a, dim)


def kind_for(points: int, queries: int, dim: int) -> type:
    """The plainest numbers in which all inner products of components up to these sizes are exact."""
    most = points * queries * max(dim, 1)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def greatest(v: np.ndarray) -> int:
    return max(int(v.max()), -int(v.min())) if v.size else 0


def box_bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Greatest inner product of each query with any point of each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Cells:
    """The upper levels of a KD-tree: splits in arrays; a leaf is a cell."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim: list[int] = []
        self.value: list[int] = []
        self.child: list[list[int]] = []
        self.cells = 0
        self._grow(sample, cells)

    def _grow(self, rows: np.ndarray, cells: int) -> int:
        """The number of the node made; cells are numbered by -1, -2 and so on."""
        if cells > 1 and len(rows) > 1:
            dim = int((rows.max(axis=0) - rows.min(axis=0)).argmax()) if rows.shape[1] else 0
            column = np.sort(rows[:, dim]) if rows.shape[1] else np.zeros(0)
            cut = column[len(rows) * (cells // 2) // cells] if len(column) else 0
            if len(column) and column[0] < cut:
                node = len(self.dim)
                self.dim.append(dim), self.value.append(int(cut)), self.child.append([0, 0])
                left = rows[:, dim] < cut
                self.child[node] = [self._grow(rows[left], cells // 2), self._grow(rows[~left], cells - cells // 2)]
                return node
        self.cells += 1
        return -self.cells

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.zeros(len(rows), np.int64) if self.dim else np.full(len(rows), -1)
        dim, value, child = np.array(self.dim), np.array(self.value), np.array(self.child)
        while len(open_ := np.flatnonzero(at >= 0)):
            node = at[open_]
            at[open_] = child[node, (rows[open_, dim[node]] >= value[node]).astype(int)]
        return -at - 1


class Tree:
    """KD-tree over distinct integer vectors; nodes in arrays, leaves as slices of ``points``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        distinct, place = np.unique(vectors, axis=0, return_inverse=True)
        place = place.reshape(-1)
        order = np.lexsort((ids, place))
        place, ids = place[order], ids[order]
        first = np.searchsorted(place, np.arange(len(distinct)))
        rank = np.arange(len(place)) - first[place]
        keep = rank <= k  # one more than k: the query itself may be one of them
        self.ids, place = ids[keep], place[keep]
        at = np.searchsorted(place, np.arange(len(distinct) + 1))
        low, high, self.child, self.span = [], [], [], []
        rows = np.arange(len(distinct))
        waiting = [(0, len(distinct), -1, 0)]
        while waiting:
            a, b, parent, side = waiting.pop()
            own = distinct[rows[a:b]]
            node = len(self.span)
            low.append(own.min(axis=0)), high.append(own.max(axis=0)), self.child.append([-1, -1]), self.span.append((a, b))
            if parent >= 0:
                self.child[parent][side] = node
            if b - a > LEAF:
                middle = (b - a) // 2
                dim = int((high[node] - low[node]).argmax())
                rows[a:b] = rows[a:b][np.argpartition(own[:, dim], middle)]
                waiting += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.made = {np.int64: (distinct[rows], np.array(low), np.array(high))}
        self.most = greatest(distinct)
        self.copies = [self.ids[at[r] : at[r + 1]] for r in rows]
        self.single = bool(len(self.ids) == len(distinct))
        self.first = self.ids[at[rows]] if len(rows) else self.ids

    def search_all(self, query_ids: list[int], queries: np.ndarray, leasts: list[int | None], k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query ``(score, id)`` of the k best, best first, but none under its least."""
        kind = kind_for(self.most, greatest(queries), queries.shape[1])
        if kind not in self.made:
            self.made[kind] = tuple(x.astype(kind) for x in self.made[np.int64])
        points, low, high = self.made[kind]
        queries = queries.astype(kind)
        for query_id, query, bound, least in zip(query_ids, queries, box_bounds(low, high, queries), leasts):
            yield query_id, self.search(points, query_id, query, bound.tolist(), k, -(1 << 200) if least is None else least)

    def search(self, points: np.ndarray, query_id: int, query: np.ndarray, bound: list, k: int, least: int) -> list[tuple[int, int]]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0, points.dtype)
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:
                break
            left, right = self.child[node]
            if left >= 0:
                for c in (left, right):
                    if bound[c] >= least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.span[node]
            found = points[a:b] @ query
            good = np.flatnonzero(found >= least)
            if not len(good):
                continue
            if self.single:
                own, value = self.first[a:b][good], found[good]
            else:
                lists = [self.copies[a + g] for g in good]
                own, value = np.concatenate(lists), np.repeat(found[good], [len(x) for x in lists])
            other = own != query_id
            ids, scores = np.concatenate([ids, own[other]]), np.concatenate([scores, value[other]])
            if len(ids) >= k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                least = max(least, int(scores[-1]))
        best = np.lexsort((ids, -scores))[:k]
        return [(int(s), int(i)) for s, i in zip(scores[best], ids[best])]


def _search_shards(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, tree = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "sub", "part", "role")])
            vec = batch.column("vec_id").to_numpy(zero_copy_only=False)
            leasts = batch.column("least")
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            out: list[list[int]] = [[], [], []]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                dim, *rest, role = keys[:, a].tolist()
                if (dim, *rest) != shard:
                    shard, ids, vectors, tree = (dim, *rest), [], [], None
                v = matrix_of(batch, a, b, dim)
                if role == 0:
                    ids.append(vec[a:b])
                    vectors.append(v)
                    continue
                if tree is None and ids:
                    tree = Tree(np.concatenate(ids), np.concatenate(vectors), k)
                    vectors = []
                if tree is not None:
                    for query_id, found in tree.search_all(vec[a:b].tolist(), v, leasts.slice(a, b - a).to_pylist(), k):
                        for score, other in found:
                            for column, value in zip(out, (query_id, other, max(-_MOST, min(_MOST, score)))):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return run


def _place(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            order = np.argsort(dims, kind="stable")
            batch = batch.take(pa.array(order))
            at = np.zeros(batch.num_rows, np.int64)
            for a, b in zip(*runs_of(dims[order])):
                dim = int(dims[order][a])
                if dim in cells:
                    at[a:b] = cells[dim].of(matrix_of(batch, a, b, dim))
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(at, pa.int32()), batch.column("vec_id"), batch.column("v")], ["dim", "cell", "vec_id", "v"])

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and box of each cell a task has seen: from vectors, or from such rows."""
    seen: dict[tuple[int, int], list] = {}
    for batch in batches:
        made = "n" in batch.schema.names
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell")])
        order = np.lexsort(keys[::-1])
        batch, keys = batch.take(pa.array(order)), keys[:, order]
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            dim, cell = keys[:, a].tolist()
            if made:
                low, high = (batch.column(c).slice(a, b - a).flatten().to_numpy().reshape(b - a, dim) for c in ("low", "high"))
                n = sum(batch.column("n").slice(a, b - a).to_pylist())
            else:
                low = high = matrix_of(batch, a, b, dim)
                n = b - a
            old = seen.get((dim, cell))
            low, high = low.min(axis=0), high.max(axis=0)
            seen[dim, cell] = [n, low, high] if old is None else [n + old[0], np.minimum(low, old[1]), np.maximum(high, old[2])]
    keys, rows = list(seen), list(seen.values())
    numbers = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tolist() for r in rows], numbers), pa.array([r[2].tolist() for r in rows], numbers)],
        ["dim", "cell", "n", "low", "high"],
    )


def _reach(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """Each query with every shard but its own whose cell's box can reach its kth score; ``boxes``: cells, parts, lows and highs by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            order = np.argsort(dims, kind="stable")
            batch, dims = batch.take(pa.array(order)), dims[order]
            home = batch.column("cell").to_numpy(zero_copy_only=False), batch.column("sub").to_numpy(zero_copy_only=False)
            leasts = batch.column("least").to_pylist()
            for a, b in zip(*runs_of(dims)):
                cell, subs, low, high = boxes[int(dims[a])]
                queries = matrix_of(batch, a, b, int(dims[a]))
                kind = kind_for(max(greatest(low), greatest(high)), greatest(queries), queries.shape[1])
                bound = box_bounds(low.astype(kind), high.astype(kind), queries.astype(kind))
                known = np.array([x is not None for x in leasts[a:b]])
                least = np.array([x or 0 for x in leasts[a:b]], object if kind is object else np.int64)
                row, at = np.nonzero((bound >= least[:, None]) | ~known[:, None])
                many = subs[at]
                row, at = np.repeat(row, many), np.repeat(at, many)
                sub = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                away = (cell[at] != home[0][a + row]) | (sub != home[1][a + row])
                row, at, sub = row[away], at[away], sub[away]
                for x in range(0, len(row), 4096):
                    part = batch.take(pa.array(a + row[x : x + 4096]))
                    yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(cell[at[x : x + 4096]], pa.int32()), pa.array(sub[x : x + 4096], pa.int32()), part.column("vec_id"), part.column("v"), part.column("least")], ["dim", "cell", "sub", "vec_id", "v", "least"])

    return run


def exact_top_k(table: DataFrame, k: int = 20, scale: int = 64, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``query_every`` its k best partners."""
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    v = F.col("_v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    whole = v.isNotNull() & F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.where(whole & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.max(F.transform("_v", lambda x: F.floor(x * scale))).alias("v"))
    rows = scratch.save(rows.withColumn("dim", F.size("v")).select("vec_id", "dim", "v"), "vectors")
    n = rows.count()
    share = max(LEAST_ROWS, min(SHARD_ROWS, -(-n // shuffle_width(spark))))
    cells: dict[int, Cells] = {}
    if n > share:
        seen: dict[int, list] = {}
        # A bounded sample; it decides balance and pruning, never what is found.
        for dim, vector in rows.select("dim", "v").sample(min(1.0, 1.2 * SAMPLE / n), seed=5).limit(SAMPLE).collect():
            seen.setdefault(dim, []).append(vector)
        total = sum(map(len, seen.values()))
        cells = {dim: Cells(np.array(x, np.int64).reshape(len(x), dim), max(1, min(CELLS, n // share) * len(x) // total)) for dim, x in seen.items()}
    placed = scratch.save(rows.mapInArrow(_place(cells), PLACED), "placed")
    scratch.drop("vectors")
    kind = "dim int, cell int, n long, low array<long>, high array<long>"
    # One row a cell.
    known = placed.mapInArrow(_boxes, kind).repartition("dim", "cell").mapInArrow(_boxes, kind).collect()
    subs = {(r.dim, r.cell): -(-r.n // (2 * share)) for r in known}
    boxes = {dim: tuple(map(np.array, zip(*((r.cell, subs[dim, r.cell], r.low, r.high) for r in known if r.dim == dim)))) for dim in {r.dim for r in known}}
    split = F.broadcast(spark.createDataFrame([(*key, x) for key, x in subs.items()], "dim int, cell int, subs long"))
    own = F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")
    placed = placed.join(split, ["dim", "cell"]).withColumn("sub", own).drop("subs")
    queries = placed.where(F.col("vec_id") % query_every == 0)
    parts = max(1, -(-queries.count() // QUERY_ROWS))

    def searched(asked: DataFrame, name: str) -> DataFrame:
        held = placed.select("dim", "cell", "sub", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("role"), "vec_id", "v", F.lit(None).cast("long").alias("least"))
        part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")
        asked = asked.select("dim", "cell", "sub", part.alias("part"), F.lit(1).alias("role"), "vec_id", "v", F.col("least").cast("long").alias("least"))
        dealt = held.unionAll(asked).repartition("dim", "cell", "sub", "part").sortWithinPartitions("dim", "cell", "sub", "part", "role")
        return scratch.save(dealt.mapInArrow(_search_shards(k), FOUND), name)

    home = searched(queries.withColumn("least", F.lit(None)), "home")
    found = home
    if sum(subs.values()) > 1:
        kth = home.groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        asked = queries.join(kth, F.col("vec_id") == F.col("_q"), "left").select("dim", "cell", "sub", "vec_id", "v", "least")
        away = asked.mapInArrow(_reach(boxes), "dim int, cell int, sub int, vec_id long, v array<long>, least long")
        found = home.unionAll(searched(away, "away"))
    scratch.drop("placed")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
