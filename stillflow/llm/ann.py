r"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a cell. There are as many centroids as make
cells of about CELL_ROWS rows, while the sample that they come from (MAX_SAMPLE rows, by a hash of vec_id) has
SAMPLE_ROWS for each. A query visits cells in the order of the summed distances of its halves to the cells' centroids,
taken from a heap, until the cells seen hold a number of rows; the rows are reranked by exact distances on the original
vectors. Every row is indexed. That number is measured on all rows: it is what SAMPLE_QUERIES queries need for the
target recall against brute force, so it follows how the whole table lies, not the sample.

Cells are gathered into bins of bounded size, and cells beyond that size are cut by a hash of vec_id; a query goes to each
bin once, with the cells that it visits there. A bin is copied only to the groups of queries that come to it, one for each
QUERY_ROWS of them. So neither a cell that holds a third of all rows (one very common vector) nor a large query set lands
in one task. What a task sends on is each query's best rows in its bin.

Defined cases. A vector that is null, empty, zero, or has null or non-finite components takes no part, nor does one
whose length differs from the most common (the shortest of such); a null vec_id neither. Rows that repeat a vec_id are
candidates each, and queries each, with a list of their own; a query never finds rows of its own vec_id. Ties go to the
smaller vec_id. A query with fewer candidates than asked for finds all of them. An empty table, or one without queries,
gives an empty result. There are no texts; long vectors are whole. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillflow.llm.common import partitions, scratch, written
from stillflow.llm.words import mix

#: Rows that centroids come from, at most, and rows of them for each centroid, at least.
MAX_SAMPLE, SAMPLE_ROWS = 20_000, 40
#: Rows that a cell should have.
CELL_ROWS = 100
#: Queries that the visited number is measured with, and the recall that it must give them.
SAMPLE_QUERIES, TARGET_RECALL = 200, 0.97
#: Rows of a bin, at least and at most; queries that a task compares with one.
LEAST_BIN, BIN_ROWS, QUERY_ROWS = 1_024, 8_192, 4_096


@dataclass(frozen=True)
class Index:
    """Centroids of the two halves, the number of rows of each cell, the number of rows that a query visits at least."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray | None = None
    visited: float = 0.0

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the vectors' halves to the centroids."""
        return _squared(vectors[:, : self.half], self.left), _squared(vectors[:, self.half :], self.right)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.distances(vectors)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def visits(self, left: np.ndarray, right: np.ndarray, least: float) -> list[int]:
        """Cells in the order of summed distances, until they hold least rows; cells without rows are passed over."""
        a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        heap, seen, out, rows = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and rows < least:
            _, i, j = heapq.heappop(heap)
            cell = int(a[i]) * len(right) + int(b[j])
            if self.counts[cell]:
                out.append(cell)
                rows += int(self.counts[cell])
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(a) and q < len(b) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (left[a[p]] + right[b[q]], p, q))
        return out

    def bins(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first bin of each cell, and how many bins it is cut into: small cells share one, in their order."""
        cut = np.maximum(1, -(-self.counts // size))
        first, number, room = np.zeros(len(cut), np.int64), 0, size
        for c in np.flatnonzero(self.counts):
            n = int(self.counts[c])
            if cut[c] > 1 or n > room:
                number, room = number + (room < size), size
            first[c] = number
            if cut[c] > 1:
                number += int(cut[c])
            else:
                room -= n
        return first, cut


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


def _centroids(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from distinct rows spread by a fixed random order."""
    rows = np.unique(x, axis=0)
    centers = rows[np.random.default_rng(4).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        at = _squared(x, centers).argmin(1)
        size = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers[size > 0] = sums[size > 0] / size[size > 0, None]
    return centers


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, open_: np.ndarray | None = None, together: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, distance) of each query's k nearest rows of other ids, ties to smaller ids. open_: which rows a query may find."""
    scale = 1e-9 * (1 + (queries**2).sum(1).max(initial=0) + (rows**2).sum(1).max(initial=0))
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for begin in range(0, len(queries), together):
        some = slice(begin, begin + together)
        rough = _squared(queries[some], rows)
        rough[query_ids[some, None] == ids] = np.inf
        if open_ is not None:
            rough[~open_[some]] = np.inf
        for i, line in enumerate(rough, begin):
            if len(line) > k:
                at = np.flatnonzero(line <= np.partition(line, k - 1)[k - 1] + scale)
            else:
                at = np.arange(len(line))
            at = at[np.isfinite(line[at])]
            exact = np.sqrt(((rows[at] - queries[i]) ** 2).sum(1))
            best = np.lexsort((ids[at], exact))[:k]
            out.append((np.full(len(best), i), at[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding (doubles) of the rows that take part, and their width."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)
    width = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    return (rows.filter(F.size("embedding") == width["width"]), width["width"]) if width else (rows, 0)


def fit(rows: DataFrame, width: int, n: int, bound: int = MAX_SAMPLE, cell_rows: int = CELL_ROWS) -> Index:
    """Centroids from a bounded sample of the n rows."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).select("embedding").toArrow()
    x = _vectors(sample.column("embedding").combine_chunks(), width)
    centroids = max(2, min(math.ceil(math.sqrt(n / cell_rows)), bound // SAMPLE_ROWS))
    half = max(1, width // 2)
    return Index(_centroids(x[:, :half], centroids), _centroids(x[:, half:], centroids))


def _found(queries: np.ndarray, query_ids: np.ndarray, width: int, k: int):
    """The k nearest rows of a partition for each of a few queries, with their cells."""

    def run(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = (none, none, none, np.zeros(0))  # query, id, cell, distance
        for batch in batches_:
            if batch.num_rows:
                ids, cells = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
                q, row, d = nearest(queries, query_ids, _vectors(batch.column("embedding"), width), ids, k)
                best = tuple(np.concatenate(x) for x in zip(best, (q, ids[row], cells[row], d), strict=True))
                order = np.lexsort((best[1], best[3], best[0]))
                place = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
                best = tuple(x[order[place < k]] for x in best)
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.int32()), pa.array(best[3])], ["query", "vec_id", "cell", "score"])

    return run


def rows_needed(indexed: DataFrame, index: Index, width: int, k: int, target: float) -> float:
    """Rows that a query must visit for the target recall, from brute force of a few queries against all rows."""
    sample = indexed.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(SAMPLE_QUERIES).select("vec_id", "embedding").toArrow()
    queries, ids = _vectors(sample.column("embedding").combine_chunks(), width), sample.column("vec_id").to_numpy()
    near = indexed.mapInArrow(_found(queries, ids, width, k), "query long, vec_id long, cell int, score double")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    true = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "cell").collect()
    a, b = index.distances(queries)
    needed, place = [], {}
    for q in sorted({r["query"] for r in true}):
        cells = index.visits(a[q], b[q], np.inf)
        place[q] = dict(zip(cells, np.cumsum(index.counts[cells]), strict=True))
    needed = [place[r["query"]][r["cell"]] for r in true]
    return float(np.quantile(needed, target, method="higher")) if needed else 0.0


def _bin_of(ids: np.ndarray, cells: np.ndarray, first: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return first[cells] + (mix(ids.astype(np.int64).view(np.uint64)) % cut[cells].astype(np.uint64)).astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 10, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest rows found for each row that is_query holds for."""
    with scratch(vectors.sparkSession):
        return written(_search(vectors, is_query, k, target), "ann-result", stays=True)


def _search(vectors: DataFrame, is_query: Column, k: int, target: float) -> DataFrame:
    rows, width = usable(vectors)
    if not width:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "cast(0 as double) as score").filter("false")
    n = rows.count()
    fitted = fit(rows, width, n)

    def assign(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            if batch.num_rows:
                cells = fitted.cells(_vectors(batch.column("embedding"), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["vec_id", "embedding", "cell"])

    indexed = written(rows.select("vec_id", "embedding").mapInArrow(assign, "vec_id long, embedding array<double>, cell int"), "ann-index")
    counts = np.zeros(len(fitted.left) * len(fitted.right), np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # as many rows as cells at most
        counts[r["cell"]] = r["n"]
    index = Index(fitted.left, fitted.right, counts)
    index = Index(fitted.left, fitted.right, counts, max(k + 1.0, rows_needed(indexed, index, width, k, target)))
    first, cut = index.bins(int(np.clip(n // (4 * partitions(vectors)), LEAST_BIN, BIN_ROWS)))
    # Every row that is a query has a list of its own.
    queries = indexed.filter(is_query).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))

    def route(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for begin in range(0, batch.num_rows, 512):
                some = batch.slice(begin, 512)
                a, b = index.distances(_vectors(some.column("vector"), width))
                which, bins, cells = [], [], []
                for i in range(some.num_rows):
                    seen = np.array(index.visits(a[i], b[i], index.visited), np.int64)
                    to = np.repeat(first[seen], cut[seen]) + np.concatenate([np.arange(c) for c in cut[seen]])
                    seen = np.repeat(seen, cut[seen])
                    order = np.argsort(to, kind="stable")
                    begins = np.flatnonzero(np.diff(to[order], prepend=-1))
                    which += [i] * len(begins)
                    bins += to[order][begins].tolist()
                    cells += [x.tolist() for x in np.split(seen[order], begins[1:])]
                taken = some.take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bins, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["query", "query_id", "vector", "bin", "cells"])

    def place(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            bins = _bin_of(batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy(), first, cut)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64())], ["vec_id", "embedding", "cell", "bin"])

    routed = written(queries.mapInArrow(route, "query long, query_id long, vector array<double>, bin long, cells array<int>"), "ann-queries")
    # Queries that come to one bin are dealt to as many groups as they need; the bin goes to these.
    groups = routed.groupBy("bin").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
    asking = routed.join(groups, "bin").withColumn("part", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).drop("groups")
    placed = indexed.mapInArrow(place, "vec_id long, embedding array<double>, cell int, bin long")
    dealt = placed.join(groups, "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids, numbers = right.column("vec_id").to_numpy(), left.column("query_id").to_numpy(), left.column("query").to_numpy()
        q, x = (_vectors(t.column(c).combine_chunks(), width) for t, c in ((left, "vector"), (right, "embedding")))
        cells, at = np.unique(right.column("cell").to_numpy(), return_inverse=True)
        seen = left.column("cells").combine_chunks()
        to = np.minimum(np.searchsorted(cells, seen.flatten().to_numpy()), len(cells) - 1)
        # A cell that is cut by a hash may have no row here.
        real = cells[to] == seen.flatten().to_numpy()
        open_ = np.zeros((len(q), len(cells)), bool)
        open_[np.repeat(np.arange(len(q)), seen.value_lengths().to_numpy())[real], to[real]] = True
        which, row, score = nearest(q, query_ids, x, ids, k, open_[:, at])
        return pa.table({"query": numbers[which], "query_id": query_ids[which], "vec_id": ids[row], "score": score})

    near = asking.groupBy("bin", "part").cogroup(dealt.groupBy("bin", "part")).applyInArrow(rerank, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
