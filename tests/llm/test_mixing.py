from pyspark.sql import functions as F

from tessel.llm import mixing
from tests.llm.helpers import SCHEMA, TEXTS, awkward, empty, prose


def filled(sizes: dict, weights=(3, 1, 2)) -> dict:
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_copies(spark):
    rows = [(i, prose(i, 20 + 13 * (i % 37)), "en", ["a", "b", "c", None, "é", "zz"][min(5, i % 11)], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by: dict = {}
    for r in got:
        s = by.setdefault(r["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] > 0
    want = filled({s: v[0] for s, v in by.items()})
    for s, (_, taken, target) in by.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken - target) < 0.06 * target + 500
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_rows_follow_the_plan(spark):
    docs = awkward(spark, TEXTS)
    plan = mixing.mix_sources(docs)
    assert plan.count() == docs.count() and plan.filter("size = 0 and taken <> 0").count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r["n"] for r in plan.filter("size > 0").groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_empty_tables(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 1)], SCHEMA)
    assert {r["taken"] for r in mixing.mix_sources(blank).collect()} == {0}


def test_rows_that_share_an_id_are_taken_by_their_texts(spark):
    rows = [(7, prose(i, 30 + i), "en", "a", 0) for i in range(40)] + [(7, None, "en", "a", 0), (None, prose(99, 35), "en", None, 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing._plan(docs, mixing.WEIGHTS, mixing.SEED)
    want = sorted((r["size"], r["n"]) for r in plan.groupBy("size").agg(F.sum("copies").alias("n")).collect() if r["n"])
    got = mixing.mixed_documents(docs).withColumn("size", F.regexp_count("text", F.lit(mixing.WORD)).cast("long")).groupBy("size").count().collect()
    assert sorted((r["size"], r["count"]) for r in got) == want
