"""Exact inner-product search of a query set against all vectors, in blocks that are passed over if they can't matter.

A bounded sample of the base (``PIVOTS`` rows, least hashes first) parts it: where vectors are read, each joins the pivot
it is nearest to, and those of a pivot become blocks of up to ``BLOCK``, with their centre and the greatest distance from it.
A vector of a block has at most q . centre + |q| * radius with a query q. The sample is of the base, so its k-th best score
is one to reach from the start; tasks raise theirs as they read. A block is multiplied with the queries that it can still
give something, if any. Candidates are restricted before the search.

Queries go to tasks in blocks of ``QUERIES``, each a pass over the blocks; what is shuffled is what beats a task's k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.bm25 import ranked
from tessel.session import settle, spread

BLOCK, PIVOTS, QUERIES, TOGETHER = 256, 128, 1024, 8192
_SLACK = 1e-6  # scores are rounded to 8 places
_BLOCKS = "ids array<long>, vecs binary, centre array<double>, radius double"


def _matrix(column: pa.ChunkedArray | pa.ListArray) -> np.ndarray:
    """Rows of numbers from lists of one length, without a Python object for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _cut(pivots: np.ndarray):
    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, TOGETHER) for x in rows for i in range(0, x.num_rows, TOGETHER)):
            x, ids = _matrix(batch.column("vec")), batch.column("id").to_numpy()
            near = np.argmax(x @ pivots.T - (pivots * pivots).sum(1) / 2, 1)
            order = np.argsort(near, kind="stable")
            starts = np.flatnonzero(np.diff(near[order], prepend=-1))
            parts = [order[a:b][i : i + BLOCK] for a, b in zip(starts, [*starts[1:], len(order)], strict=True) for i in range(0, b - a, BLOCK)]
            centres = [x[p].mean(0) for p in parts]
            radius = [float(np.sqrt(((x[p] - c) ** 2).sum(1).max())) for p, c in zip(parts, centres, strict=True)]
            columns = [pa.array([ids[p] for p in parts], pa.list_(pa.int64())), pa.array([x[p].tobytes() for p in parts], pa.binary()), pa.array(centres, pa.list_(pa.float64())), pa.array(radius, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "vecs", "centre", "radius"])

    return cut


def blocks(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``vectors(id, vec)`` in blocks (ids, vecs, centre, radius), settled, and the pivots; null vectors are left out."""
    rows = vectors.select("id", "vec").filter("id is not null and vec is not null")
    pivots = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toArrow().column("vec"))  # of fixed number
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], _BLOCKS), pivots
    return settle(spread(rows).mapInArrow(_cut(pivots), _BLOCKS), "vector-blocks"), pivots


def _search(ids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, passed: list[int] | None = None):
    """The best of each block; ``reach`` is a score that each query's k-th best has at least. ``passed`` gets what was passed over."""
    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, best = np.sqrt((q * q).sum(1)), np.repeat(reach[:, None], k, 1)
        for batch in rows:
            centres, radius = _matrix(batch.column("centre")), batch.column("radius").to_numpy()
            bound = q @ centres.T + length[:, None] * radius
            for b in np.argsort(-bound.max(0), kind="stable"):
                on = np.flatnonzero(bound[:, b] + _SLACK >= best.min(1))
                if not len(on):
                    if passed is not None:
                        passed.append(int(b))
                    continue
                names = batch.column("ids")[int(b)].values.to_numpy()
                scores = np.round(q[on] @ np.frombuffer(batch.column("vecs")[int(b)].as_py()).reshape(len(names), -1).T, 8)
                i, j = np.nonzero(scores >= best[on].min(1)[:, None])
                order = np.lexsort((names[j], -scores[i, j], i))
                i, j = i[order], j[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                best[on] = np.partition(np.concatenate([best[on], scores], 1), len(names), axis=1)[:, len(names) :]
                yield pa.RecordBatch.from_arrays([pa.array(ids[on[i]]), pa.array(names[j]), pa.array(scores[i, j])], ["query_id", "doc_id", "score"])

    return search


def top_k(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k greatest inner products of ``queries(id, vec)`` with ``base(id, vec)``."""
    held, pivots = blocks(base)
    queries = settle(queries.select("id", "vec").filter("id is not null and vec is not null"), "query-vectors")
    parts, found = max(1, -(-queries.count() // QUERIES)), []
    for part in range(parts):
        asked = queries.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()  # a block of queries
        if not asked.num_rows or not len(pivots):
            continue
        q = _matrix(asked.column("vec"))
        # the sample is of the base: its k-th best score is one to reach
        own = np.round(q @ pivots.T, 8)
        reach = np.partition(own, len(pivots) - k, 1)[:, len(pivots) - k] if len(pivots) >= k else np.full(len(q), -np.inf)
        found.append(held.mapInArrow(_search(asked.column("id").to_numpy(), q, reach - _SLACK, k), "query_id long, doc_id long, score double"))
    none = queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    return ranked(reduce(DataFrame.unionByName, found, none), k)
