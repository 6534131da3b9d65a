"""Block-wise vector search against all products, and the blocks it passes over."""

import numpy as np
import pyarrow as pa
import pytest

from tessel.operators import vectors


def clustered(n, dim=8, clusters=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 4
    return centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.1


def brute(q, x, k):
    out = set()
    for i, row in enumerate(np.round(q @ x.T, 8)):
        out |= {(i, int(j), float(row[j]), place) for place, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j))[:k], 1)}
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("k,block,queries", [(1, 256, 1024), (5, 16, 7), (400, 64, 1024)])
def test_as_all_products(spark, monkeypatch, k, block, queries):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES", queries)
    x = clustered(300)
    x[10] = x[20] = x[30]  # ties go by id
    x[40] = 0
    q = np.concatenate([x[[10, 40, 77]], clustered(20, seed=4)])
    base = frame(spark, x).unionByName(spark.createDataFrame([(900, None)], "id long, vec array<double>"))
    got = {(r.query_id, r.doc_id, round(r.score, 8), r["rank"]) for r in vectors.top_k(frame(spark, q), base, k).collect()}
    assert got == {(i, j, round(s, 8), p) for i, j, s, p in brute(q, x, k)}


def test_blocks_that_give_nothing_are_passed_over():
    x, k = clustered(2000), 5
    pivots = x[:64]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x.tolist())], ["id", "vec"])
    cut = list(vectors._cut(pivots)(iter([batch])))
    q = x[[5, 50, 500]]
    reach, passed = np.sort(np.round(q @ pivots.T, 8), 1)[:, -k], []
    found = pa.Table.from_batches(list(vectors._search(np.arange(3), q, reach, k, passed)(iter(cut))))
    assert len(passed) > 0.6 * sum(c.num_rows for c in cut)
    best = {i: sorted((-s, d) for qi, d, s in zip(*(found.column(c).to_pylist() for c in found.column_names), strict=True) if qi == i)[:k] for i in range(3)}
    assert {(i, d, -s, p) for i, rows in best.items() for p, (s, d) in enumerate(rows, 1)} == brute(q, x, k)


def test_no_vectors(spark):
    x = frame(spark, clustered(5))
    assert vectors.top_k(x, x.limit(0), 3).collect() == [] and vectors.top_k(x.limit(0), x, 3).collect() == []
