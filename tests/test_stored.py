"""Tables that plans write, models in tasks, evaluation of a search, places in a global order, own logistic regression."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.operators import logistic, metrics, models
from tessel.operators.ranks import placed, values_at
from tessel.operators.stored import VectorTable, snapshot, upsert_partitions
from tessel.plans import QUERIES


def vectors(spark, *ids, dim=2):
    return spark.createDataFrame([(i, [float(len(i))] * dim) for i in ids], "id string, vec array<double>").repartition(3)


def test_vector_table_never_gives_an_id_twice(spark, tmp_path):
    path = str(tmp_path / "v")
    held = VectorTable(spark, path, 2)
    assert held.add(vectors(spark, "a", "b", "c")) == 3 and held.remove(vectors(spark, "b", "x")) == 1
    first = {r.id: r.int_id for r in held.rows.collect()}
    again = VectorTable.load(spark, path)
    assert again.add(vectors(spark, "b", "d")) == 2
    second = {r.id: r.int_id for r in again.rows.collect()}
    assert sorted(second.values()) == sorted({*first.values(), 3, 4}) and {i: second[i] for i in first} == first
    for bad in (vectors(spark, "e", "a"), vectors(spark, "e", "e"), vectors(spark, "f", dim=3), spark.createDataFrame([(None, [1.0, 2.0])], "id string, vec array<double>")):
        with pytest.raises(ValueError):
            again.add(bad)
    assert {r.id: r.int_id for r in VectorTable.load(spark, path).rows.collect()} == second  # a refused batch leaves all as it was
    again.clear()
    assert VectorTable.load(spark, path).rows.count() == 0 and again.add(vectors(spark, "a")) == 1
    with pytest.raises(FileNotFoundError):
        VectorTable.load(spark, str(tmp_path / "none"))


def test_upsert_writes_touched_partitions_only(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string, p string"
    spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, None, "z")], schema).write.partitionBy("p").parquet(path)
    files = lambda p: sorted(f for f in os.listdir(f"{path}/p={p}") if f.endswith(".parquet"))
    y = files("y")
    new = spark.createDataFrame([(1, "A", "x"), (2, "b", "x"), (5, "e", "x"), (4, None, "z"), (6, "f", "w")], schema)
    before = sorted(map(tuple, spark.read.parquet(path).collect()), key=repr)
    dry = upsert_partitions(spark, path, new, "k", "p", dry_run=True)
    assert dry == {"inserted": 2, "updated": 1, "same": 2} and sorted(map(tuple, spark.read.parquet(path).collect()), key=repr) == before
    broken = new.withColumn("v", F.when(F.col("k") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("v")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        upsert_partitions(spark, path, broken, "k", "p")
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=repr) == before
    assert upsert_partitions(spark, path, new, "k", "p") == dry and files("y") == y
    assert sorted(tuple(r) for r in spark.read.parquet(path).fillna("-", ["v"]).collect()) == [(1, "A", "x"), (2, "b", "x"), (3, "c", "y"), (4, "-", "z"), (5, "e", "x"), (6, "f", "w")]


def test_snapshots_of_the_newest_days_stay(spark, tmp_path):
    path = str(tmp_path / "s")
    for day in ("2024-01-03", "2024-01-01", "2024-01-02"):
        left = snapshot(spark.range(3), path, day, keep=2)
    assert left == ["2024-01-03", "2024-01-02"] and sorted(os.listdir(path)) == ["day=2024-01-02", "day=2024-01-03"]
    snapshot(spark.range(9), path, "2024-01-03", keep=2)
    assert spark.read.parquet(f"{path}/day=2024-01-03").count() == 3  # one a day


def test_models_are_loaded_once_a_task_and_see_each_text_once(spark, tmp_path):
    log = str(tmp_path)

    def load():
        with open(f"{log}/loads", "a") as f:
            f.write("x")

        def encode(texts):
            with open(f"{log}/sizes", "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[len(t), 0.0] for t in texts])

        return encode

    rows = spark.createDataFrame([(i, f"text {i % 50}" if i % 50 else None) for i in range(400)], "id int, text string").repartition(4)
    got = {r.id: (r.text, list(r.vector)) for r in models.encode(rows, "text", load, batch=8).collect()}
    sizes = list(map(int, open(f"{log}/sizes").read().split()))
    loads = len(open(f"{log}/loads").read())
    assert len(got) == 400 and sum(sizes) == 50 and max(sizes) == 8
    assert loads <= spark.sparkContext.defaultParallelism and sum(s < 8 for s in sizes) <= loads  # one short batch a task at most
    assert got[0] == (None, [0.0, 0.0]) and got[7] == ("text 7", [1.0, 0.0])
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), (None, "c")], "q string, t string")
    scored = models.rerank(pairs, "q", "t", lambda: lambda ps: np.array([len(q + t) for q, t in ps], float))
    assert sorted((r.q or "", r.sigma) for r in scored.collect()) == [("", 1.0), ("a", 2.0), ("a", 2.0)]


def test_models_take_a_few_texts_of_a_batch_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i} " + "x" * 20_000 for i in range(1000)])], ["t"])
    run = models._batched(lambda: lambda texts: np.array([len(t) for t in texts], float), ["t"], 32, lambda x: pa.array(x, pa.float64()), "n")
    tracemalloc.start()
    sizes = [out.num_rows for out in run(iter([batch.slice(0, 40), batch.slice(40)]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [32] * 31 + [8] and most < 5_000_000  # of 20,000,000


def test_pairs_to_rerank_are_written_before_they_are_read_twice(spark, sf_dir):
    assert not any("documents.parquet" in f for f in QUERIES["rerank_batched"](spark, sf_dir).inputFiles())


def test_any_search_is_evaluated(spark):
    questions = spark.createDataFrame([(1, "x", [10, 11]), (2, "y", []), (3, "z", [12]), (4, "nothing", None)], "query_id int, query string, want array<int>")
    found = spark.createDataFrame([("x", 11, 2), ("x", 5, 1), ("x", 10, 9), ("y", 1, 1)], "query string, doc_id int, rank int")
    got = {r.query_id: (r.got, r.recall, r.recall_all, r.rr) for r in models.evaluate(lambda asked: asked.join(found, "query"), questions).collect()}
    assert got == {1: ([5, 11], 0.5, 0.5, 0.5), 2: ([1], None, None, 0.0), 3: ([], 0.0, 0.0, 0.0), 4: ([], None, None, 1.0)}


def hot_rows(spark, n=3000):
    """A third of all rows in one group, all of one value; nulls too."""
    rng = random.Random(4)
    return [("hot", 1.0) if i % 3 == 0 else (f"g{rng.randrange(40)}", rng.choice([None, rng.randrange(50) / 4])) for i in range(n)]


def test_places_of_equal_rows_are_dealt_evenly(spark):
    rows = hot_rows(spark)
    at, n = placed(spark.createDataFrame(rows, "g string, v double"), ["v"], parts=8)
    got = at.orderBy("place").collect()
    assert n == 3000 and [r.place for r in got] == list(range(1, 3001))
    assert [r.v for r in got] == sorted((v for _, v in rows), key=lambda v: (v is not None, v or 0))
    sizes = [r["count"] for r in spark.read.parquet(at.inputFiles()[0].rsplit("/", 1)[0]).groupBy(F.shiftright("__at", 33)).count().collect()]
    assert max(sizes) < 3 * 3000 / 8  # no range holds the third of equal rows


def test_values_at_places_of_groups(spark):
    rows = hot_rows(spark)
    n = F.col("n")
    got = {r.g: r for r in values_at(spark.createDataFrame(rows, "g string, v double").dropna(), "v", ["g"], {"low": F.floor(n * 0.25), "last": n - 1}).collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert {g: (r.n, r.low, r["last"]) for g, r in got.items()} == {g: (len(v), sorted(v)[len(v) // 4], max(v)) for g, v in by.items()}
    q = {r.g: r.m for r in metrics.interpolated(spark.createDataFrame(rows, "g string, v double").dropna(), "v", ["g"], {"m": 0.3}).collect()}
    assert q == pytest.approx({g: float(np.quantile(v, 0.3)) for g, v in by.items()})


def test_auc_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, 0.5, i % 2) for i in range(1)] + [(i, 0.5, int(i < 10)) for i in range(2, 40)], "id int, s double, y int")
    r = metrics.auc_ordinal(rows, "s", "y", "id").first()
    assert (r.n_pos, r.n_neg, r.auc) == (8, 31, pytest.approx(1 / 31))  # positives but one negative come first by id


def test_logistic_regression_as_plain_descent(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(5, 3, 300), rng.normal(-1, 0.1, 300), np.full(300, 7.0)], 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.8 * (x[:, 0] - 5) + 6 * (x[:, 1] + 1) - 0.5)))).astype(float)
    mean, dev = x.mean(0), np.where(x.std(0) < 1e-9, 1, x.std(0))
    z, w, b = (x - mean) / dev, np.zeros(3), 0.0
    for _ in range(8000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w, b = w - 0.05 * (z.T @ (p - y) / 300 + 1e-2 * w), b - 0.05 * (p - y).mean()
    rows = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1)], "a double, b double, c double, y int").repartition(3)
    weights, bias, steps = logistic.fit(rows, ["a", "b", "c"], "y")
    assert weights == pytest.approx(w / dev, abs=1e-5) and bias == pytest.approx(b - (w * mean / dev).sum(), abs=1e-4) and steps < 12
    assert logistic.fit(rows.limit(0), ["a"], "y")[1] == 0.0
