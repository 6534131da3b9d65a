"""Exact cases: tokens, BM25 on tiny corpora, gates, fusion, filters, tables, metrics, streams."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions import values as V
from tessel.operators import bm25, fusion, metrics, privacy, tables, vectors
from tessel.plans import QUERIES
from tessel.streaming import events

TOKENS = [
    ("Hello, World 123!", ["hello", "world", "123"]), ("Dr. Zhang's class — A+", ["dr", "zhang", "class"]), ("应用 AI fundamentals", ["ai", "fundamentals", "应用"]),
    ("机器学习", ["机器", "器学", "学习"]), ("学 AI", ["ai", "学"]), ("the and of", []), ("AI fundamentals and search algorithms", ["ai", "fundamentals", "search", "algorithms"]),
]


@pytest.mark.parametrize("text,want", TOKENS)
def test_tokens(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.tokenize(F.col("t"))).first()[0] == want


def ranked(spark, docs, query, allowed=None, k=10):
    corpus = bm25.corpus_of(spark.createDataFrame(docs, "doc_id string, text string"))
    asked = bm25.queries_of(spark.createDataFrame([(1, query)], "id int, q string"), "q", "id")
    allow = None if allowed is None else spark.createDataFrame([(x,) for x in allowed], "doc_id string")
    return bm25.ranked(bm25.score(corpus, asked, allow), k).orderBy("rank").collect()


FOUR = [("c1", "graph algorithms BFS DFS shortest paths"), ("c2", "k-means clustering dimensionality reduction"), ("c3", "neural network training backpropagation"), ("c4", "convex optimization Lagrangian duality")]


def test_bm25_only_matches(spark):
    assert [r["doc_id"] for r in ranked(spark, FOUR, "BFS DFS")] == ["c1"]


def test_bm25_zero_idf_still_matches(spark):
    found = ranked(spark, [("c1", "graph algorithms"), ("c2", "neural networks")], "graph")
    assert [(r["doc_id"], r["score"]) for r in found] == [("c1", 0.0)]


def test_bm25_allowed_before_top_k(spark):
    assert [r["doc_id"] for r in ranked(spark, FOUR, "graph network", ["c3"], 1)] == ["c3"]


def test_bm25_early_outs(spark):
    assert ranked(spark, FOUR, "the of") == [] and ranked(spark, FOUR, "zebra") == [] and ranked(spark, [], "graph") == []


def test_bm25_empty_document_counts(spark):
    found = ranked(spark, [*FOUR, ("c5", None)], "graph")
    n, df, tf, dl, avgdl = 5, 1, 1, 6, (6 + 5 + 4 + 4 + 1) / 5
    want = (math.log(n - df + 0.5) - math.log(df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert found[0]["score"] == pytest.approx(want, abs=1e-7)


def test_vector_search_small_sets(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id long, vec array<float>")
    got = vectors.top_k(base.filter("id = 3"), base, 5).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(3, 1), (2, 2), (1, 3)]
    assert vectors.top_k(base.filter("id = 9"), base, 5).count() == 0


def test_zscore_of_equals_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.3), (1, 2, 0.5, 0.3)], "query_id int, doc_id int, score double, sigma double")
    assert {r["blended"] for r in fusion.blend(df, 0.4).collect()} == {0.0}


def test_convex_needs_weight_in_range():
    with pytest.raises(ValueError):
        fusion.convex(None, None, 1.5)


def test_gate_is_monotone(spark):
    df = spark.range(10).select((F.col("id") / 10.0).alias("s"))
    p = [r[0] for r in df.orderBy("s").select(fusion.p_answerable(F.col("s"), F.lit(3.0), F.lit(0.5), F.lit(False), F.lit(False))).collect()]
    assert p == sorted(p)
    code = df.limit(1).select(fusion.p_answerable(F.lit(0.9), F.lit(3.0), F.lit(0.5), F.lit(True), F.lit(False))).first()[0]
    assert code < df.limit(1).select(fusion.p_answerable(F.lit(0.9), F.lit(3.0), F.lit(0.5), F.lit(False), F.lit(False))).first()[0]


@pytest.mark.parametrize("q,want", [("what about this course?", True), ("AAI 6620 和这门课比怎么样", False), ("这门课难吗", True), ("graph theory", False), ("", False), ("is it hard", True)])
def test_followup(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(T.is_followup(F.col("q"))).first()[0] is want


@pytest.mark.parametrize("q,prefix,rest", [("any info on AAI courses", "AAI", "any info on courses"), ("class topics", "", "class topics"), ("那aai课", "AAI", "那课"), ("INFO info", "INFO", "info"), ("  ", "", "")])
def test_prefix(spark, q, prefix, rest):
    r = spark.createDataFrame([(q,)], "q string").select(T.program_prefix(F.col("q")), T.without_prefix(F.col("q"))).first()
    assert tuple(r) == (prefix, rest)


def test_redaction(spark):
    t = "mail a.b@campus.example.edu or +1 (617) 555-1234, see https://github.com/someone"
    assert spark.createDataFrame([(t,)], "t string").select(V.redact(F.col("t"))).first()[0] == "mail [EMAIL] or [PHONE], see [URL]"


def test_upsert_keeps_text_if_null(spark):
    old = spark.createDataFrame([(1, "a", "old", 5), (2, "b", "x", 6)], "id int, name string, raw string, v int")
    new = spark.createDataFrame([(1, "A", None), (3, "C", "y")], "id int, name string, raw string")
    got = {r["id"]: tuple(r)[1:] for r in tables.upsert(old, new, "id", keep_if_null=("raw",)).collect()}
    assert got == {1: ("A", "old", 5), 2: ("b", "x", 6), 3: ("C", "y", None)}


def test_insert_or_ignore_first_wins(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, tables.insert_or_ignore(old, new, ["k"], ["v"]).collect())) == [("a", 1), ("b", 2)]


def test_k_anonymity_counts_nulls_together(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "c", "x")], "id int, company string, role string")
    got = {r["id"]: (r["group_size"], r["publishable"]) for r in privacy.k_anonymous(df, ["company", "role"]).collect()}
    assert got == {1: (2, True), 2: (2, True), 3: (1, False)}


def test_recall_and_reciprocal_rank(spark):
    rows = [([1, 2], [2, 9, 1]), ([], []), ([], [3]), ([5], [1]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "want array<int>, got array<int>")
    got = [tuple(r) for r in df.select(metrics.recall_capped(F.col("want"), F.col("got"), 5), metrics.recall_uncapped(F.col("want"), F.col("got"), 5), metrics.reciprocal_rank(F.col("want"), F.col("got"))).collect()]
    assert got == [(1.0, 1.0, 1.0), (None, None, 1.0), (None, None, 0.0), (0.0, 0.0, 0.0), (1.0, 5 / 6, 1.0)]


def test_auc_with_ties_is_ordinal(spark):
    df = spark.createDataFrame([(1, 0.5, 0), (2, 0.5, 1), (3, 0.1, 0), (4, 0.9, 1)], "id int, s double, y int")
    assert metrics.auc_ordinal(df, "s", "y", "id").first()["auc"] == 1.0


def test_winner_tiers(spark):
    df = spark.createDataFrame([(1, 0.63, 0.9), (2, 0.64, 0.61)], "c int, recall double, mrr double")
    assert metrics.winner(df).first()["c"] == 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    stream = events.tumbling(events.read_events(spark, str(folder)))
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["start"], r["event_type"], r["n"]) for r in spark.table("tumbled").collect())
    assert got == sorted((r["start"], r["event_type"], r["n"]) for r in events.tumbling(batch).collect())


def test_append_log_resumes(spark, sf_dir, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.filter("event_id % 2 = 0").write.parquet(folder)
    for part in (None, 1):
        if part:
            batch.filter("event_id % 2 = 1").write.mode("append").parquet(folder)
        events.append_log(events.read_events(spark, folder), out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == batch.count()


def test_shared_pairs_of_hot_and_small_groups(spark):
    rng = random.Random(3)
    rows = [("hot", i) for i in range(60)] + [(f"g{rng.randrange(25)}", rng.randrange(80)) for _ in range(300)] + [("two", 1), ("two", 2), ("few", 1), ("few", 2), (None, 1), (None, 2), ("g1", None)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "g string, x int")
    for k in (1, 3):
        members = {}
        for g, x in rows:
            if g is not None and x is not None:
                members.setdefault(g, set()).add(x)
        counts = Counter(p for m in members.values() if len(m) >= k for p in combinations(sorted(m), 2))
        got = {(r["a"], r["b"]): r["shared"] for r in tables.shared_pairs(df, "g", "x", 2, k, size=7).collect()}
        assert got == {p: n for p, n in counts.items() if n >= 2}


def test_pair_overlap_reads_the_whole_table(spark, sf_dir):
    members = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        members.setdefault(r[0], set()).add(r[1])
    counts = Counter(p for m in members.values() if len(m) >= 3 for p in combinations(sorted(m), 2))
    got = {(r["part_a"], r["part_b"]): r["shared"] for r in QUERIES["pair_overlap_whole"](spark, sf_dir).collect()}
    assert got == {p: n for p, n in counts.items() if n >= 2}


def test_first_matches_of_hot_terms_shuffle_no_pairs(spark):
    asked = [(q, pos, t) for q in range(60) for pos, t in ((0, f"c{q % 7}"), (1, "hot"), (2, f"c{q % 7}" if q % 2 else None))] + [(None, 0, "c1"), (3, 0, "hot")]
    known = [("hot", i) for i in range(40)] + [(f"c{i % 9}", i) for i in range(50)] + [("hot", 3), (None, 4), ("c2", None)]
    got = tables.first_matches(spark.createDataFrame(asked, "query_id long, pos int, term string"), spark.createDataFrame(known, "term string, id long"), size=6)
    want = {}
    for q, pos, t in asked:
        for u, i in known:
            if t is not None and t == u:
                want[q, i] = min(pos, want.get((q, i), pos))
    rows = got.collect()
    assert len(rows) == len(want) and {(r["query_id"], r["id"]): r["pos"] for r in rows} == want
    # pairs come out of the join itself, nothing groups them afterwards
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_shared_pairs_are_not_shuffled(spark, sf_dir):
    plan = tables.shared_pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_partkey", 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_shared_pairs_are_written_and_sent_as_packed_rows(spark, tmp_path, monkeypatch):
    """Members in order of nothing, doubles, negative and far items, items of other types: the pairs are the same, and files hold a byte or two an item."""
    written, own = {}, tables.settle
    monkeypatch.setattr(tables, "settle", lambda df, name="step": written.update({name: own(df, name)}) or written[name])
    monkeypatch.setattr(tables, "ROWS", 500)
    monkeypatch.setattr(tables, "LEAVE", 3)
    rows = [(g, g * 10**12 + (x * 7919) % 1500 - 3) for g in (-1, 0, 2**20) for x in range(150)] * 2 + [(None, 5), (7, None), (7, -(2**63)), (7, 2**63 - 1), (8, -(2**63)), (8, 2**63 - 1)]
    df = spark.createDataFrame(rows, "g long, x long").repartition(3)
    members = {}
    for g, x in rows:
        if g is not None and x is not None:
            members.setdefault(g, set()).add(x)
    want = Counter(p for m in members.values() for p in combinations(sorted(m), 2))
    assert {(r["a"], r["b"]): r["shared"] for r in tables.shared_pairs(df, "g", "x", 1, 1, size=400).collect()} == want
    assert written["dealt-members"].selectExpr("sum(length(xs)) / sum(m)").first()[0] < 2.5
    text = spark.createDataFrame([(g, f"ü{x % 5}-{x}") for g in range(4) for x in range(g, 9)], "g int, x string")
    got = {(r["a"], r["b"]): r["shared"] for r in tables.shared_pairs(text, "g", "x", 2, 6, size=2).collect()}
    sets = [{f"ü{x % 5}-{x}" for x in range(g, 9)} for g in range(4)]
    counts = Counter(p for m in sets if len(m) >= 6 for p in combinations(sorted(m), 2))
    assert got == {p: n for p, n in counts.items() if n >= 2}
    assert tables.shared_pairs(df.limit(0), "g", "x").collect() == []


def test_first_matches_send_a_row_to_few_blocks_whatever_the_number_of_pairs(spark, monkeypatch):
    asked = spark.range(3000).selectExpr("id AS query_id", "1 AS pos", "'hot' AS term").unionByName(spark.range(3000).selectExpr("id AS query_id", "0 AS pos", "concat('c', id % 50) AS term"))
    known = spark.range(2500).selectExpr("'hot' AS term", "id").unionByName(spark.range(2500).selectExpr("concat('c', id % 60) AS term", "id"))
    seen, own, written, settled = [], tables.SIDES, {}, tables.settle
    monkeypatch.setattr(tables, "settle", lambda df, name="step": written.update({name: settled(df, name)}) or written[name])
    for sides in ((100, 100), (100, own[1])):  # all joins of 100 by 100; as large as leaves the cores enough of them
        monkeypatch.setattr(tables, "SIDES", sides)
        got = tables.first_matches(asked, known)
        seen.append(got.selectExpr("count(*)", "sum(xxhash64(query_id, id, pos) % 1000)").first())
        assert "string" not in written["asked-terms"].dtypes[3][1] + written["known-terms"].dtypes[1][1]  # numbers are sent, no texts
    assert seen[0] == seen[1] and seen[0][0] == 3000 * 2500
    assert own[0] <= 2000 and own[1] >= 16384
