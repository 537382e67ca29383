"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Both halves of the vectors are quantised separately (k-means on at most ``max_sample`` vectors, those with the smallest
hash of vec_id); a cell is a pair of centroids and every vector is indexed. For a query the pairs are visited with a heap in
the order of their summed distance, which for this measure is the negative inner product of the query's halves with the
centroids, until the cells hold a share of all vectors (and enough for k). The share is measured on the sample: the least that
reaches ``recall`` of the exact neighbours there. Entries of the cells are then reranked exactly, in double precision on the
original vectors, summed component by component.

Cells lie in blocks of about ``block_rows`` vectors; a cell larger than that is cut by hash of vec_id, so equal vectors in any
number never meet in one task. Queries go to the blocks of their cells in groups of ``query_rows``.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null
ids. Ties go to the smaller vec_id. Repeated rows are candidates each, so one id may stand in a list as often as in the table;
rows with the query's own id are none. A query id has one list, that of its smallest vector if it has several. A table without
valid vectors gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 8192
#: Cells for each so many vectors, and the most centroids of a half.
IN_CELL, MOST = 12, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Quantiser:
    first: np.ndarray
    second: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        near = lambda y, c: ((c * c).sum(1) - 2 * y @ c.T).argmin(1)
        return near(x[:, : self.half], self.first) * len(self.second) + near(x[:, self.half :], self.second)

    def visit(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
        """Cells by summed distance until they hold ``wanted`` vectors."""
        a, b = -(self.first @ q[: self.half]), -(self.second @ q[self.half :])
        by_a, by_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b, sizes, n = np.sort(a).tolist(), np.sort(b).tolist(), sizes.tolist(), len(b)
        heap, reached, out, held = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = by_a[i] * n + by_b[j]
            if sizes[cell]:
                out.append(cell)
                held += sizes[cell]
            reached[i] = j + 1
            # a pair is reachable once the pairs before it in its row and in its column were visited
            if j + 1 < n and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i + 1 < len(a) and reached[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        return out


def measured_share(x: np.ndarray, quantiser: Quantiser, total: int, k: int, recall: float, queries: int = 256) -> float:
    """Share of the vectors to visit so that ``recall`` of the k nearest of ``total`` lie in the cells, from a sample ``x``.

    Of a sample, the nearest k * len(x) / total stand for the k nearest of all.
    """
    near = int(np.clip(round(k * len(x) / total), 1, len(x) - 1))
    half = quantiser.half
    cells = quantiser.cells(x)
    first, second = np.divmod(cells, len(quantiser.second))
    own = np.arange(0, len(x), max(1, len(x) // queries))
    reached = []
    for i in own.tolist():
        cost = -(quantiser.first @ x[i, :half])[first] - (quantiser.second @ x[i, half:])[second]
        score = x @ x[i]
        score[i] = -np.inf
        nearest = np.argpartition(-score, near - 1)[:near]
        reached += np.searchsorted(np.sort(cost), cost[nearest], side="right").tolist()
    return float(np.quantile(reached, recall)) / len(x)


def valid_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v double[]) of the vectors that take part, and their length (0: none)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("embedding") == d).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the candidates, exactly scored."""
    score = x @ q
    score[ids == own] = -np.inf
    if len(score) > k:
        least = np.partition(score, -k)[-k]
        # the product of matrices may round otherwise than the exact sum: keep what is that close
        keep = np.flatnonzero(score >= least - 1e-9 * (1 + np.abs(least)))
    else:
        keep = np.arange(len(score))
    keep = keep[ids[keep] != own]
    exact = np.zeros(len(keep))
    for j in range(len(q)):
        exact += x[keep, j] * q[j]
    by = np.lexsort((ids[keep], -exact))[:k]
    return ids[keep][by], exact[by]


def search(embeddings: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, max_sample: int = SAMPLE, block_rows: int = 4096, query_rows: int = 8192) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``: (query_id, rank, vec_id, score)."""
    spark = embeddings.sparkSession
    rows, d = valid_vectors(embeddings)
    out = "query_id long, rank int, vec_id long, score double"
    if d < 2:
        # one component has no two halves; with none there is nothing to search
        if not d:
            return spark.createDataFrame([], out)
        rows, d = rows.withColumn("v", F.array_append("v", F.lit(0.0))), 2
    total = rows.count()
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("v").collect()])
    centroids = int(np.clip(round((total / IN_CELL) ** 0.5), 8, MOST))
    quantiser = Quantiser(kmeans(sample[:, : d // 2], centroids), kmeans(sample[:, d // 2 :], centroids))
    share = measured_share(sample, quantiser, total, k, recall) if len(sample) > 1 else 1.0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(quantiser.cells(matrix(b.column(1), d)).astype(np.int64))], ["vec_id", "v", "cell"])

    indexed = rows.mapInArrow(assign, "vec_id long, v array<double>, cell long")
    sizes = np.zeros(len(quantiser.first) * len(quantiser.second), np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # as many rows as pairs of centroids at most
        sizes[r["cell"]] = r["n"]
    parts = np.maximum(1, -(-sizes // block_rows))
    # small cells share a block, the parts of a large one have a block each
    block, at, filled = np.zeros(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if filled and (filled + n > block_rows):
            at, filled = at + 1, 0
        block[c] = at
        filled += n
        if parts[c] > 1:
            at, filled = at + int(parts[c]), 0
    groups = max(1, -(-(total // every) // query_rows))
    wanted = max(k + 1, int(np.ceil(share * total)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ids = b.column(2).to_numpy(), b.column(0).to_numpy()
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block[cell] + (mixed % parts[cell].astype(np.uint64)).astype(np.int64))], ["vec_id", "v", "cell", "block"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), d)
            for i, (own, v) in enumerate(zip(b.column(0).to_pylist(), x)):
                cells = np.array(quantiser.visit(v, sizes, wanted), np.int64)
                to = np.repeat(block[cells], parts[cells])
                shift = np.arange(len(to)) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                to, cells = to + shift, np.repeat(cells, parts[cells])
                by = np.argsort(to, kind="stable")
                to, cells = to[by], cells[by]
                cut = np.flatnonzero(np.diff(to)) + 1
                first = np.r_[0, cut] if len(to) else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(to)), pa.int32()), pa.array(cells))
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(to[first]), pa.array([own] * n, pa.int64()), pa.array([v.tolist()] * n, pa.list_(pa.float64())), lists], ["block", "query_id", "q", "cells"])

    index = indexed.mapInArrow(placed, "vec_id long, v array<double>, cell long, block long").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    own = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = own.mapInArrow(asked, "block long, query_id long, q array<double>, cells array<long>")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if len(left) and len(right):
            ids, x, cell = left["vec_id"].to_numpy(), matrix(left["v"].combine_chunks(), d), left["cell"].to_numpy()
            for own, q, cells in zip(right["query_id"].to_pylist(), matrix(right["q"].combine_chunks(), d), right["cells"]):
                rows_ = np.flatnonzero(np.isin(cell, cells.values.to_numpy()))
                found, score = best(q, ids[rows_], x[rows_], own, k)
                made.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": score}))
        made = pd.concat(made) if made else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pa.table({"query_id": pa.array(made["query_id"], pa.int64()), "vec_id": pa.array(made["vec_id"], pa.int64()), "score": pa.array(made["score"], pa.float64())})

    found = index.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
