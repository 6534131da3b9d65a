"""The stored index: its tokens, statistics and scores against BM25 over the texts, its blocks, and growth by segments."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import bm25, lexical
from tessel.operators.lexical import LexicalIndex
from tessel.operators.rescue import reranked, rescue
from tessel.plans import QUERIES, retrieval
from tessel.session import at_path, scratch, settle, shared_path, table


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked_of(spark, texts):
    return bm25.queries_of(spark.createDataFrame(list(enumerate(texts)), "id int, q string"), "q", "id")


def corpus(seed, n, topics=6):
    """Documents of a few topics, each with words of its own besides common ones."""
    rng = random.Random(seed)
    words = lambda t: " ".join(rng.choice([f"t{t}w{rng.randrange(40)}", f"c{rng.randrange(20)}"]) for _ in range(rng.randrange(1, 80)))
    return [(i, words(rng.randrange(topics))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "the of and"), (n + 3, "机器学习 AI")]


def rows(df, places=6):
    return sorted(tuple(round(x, places) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_tokens_as_the_column_functions(spark):
    rng, letters = random.Random(3), "abzAZ09 .,-'éÉİKÅ应用学 机器\n\x0bthe AND"
    texts = [("".join(rng.choice(letters) for _ in range(rng.randrange(60))),) for _ in range(500)] + [(None,), ("",)]
    for r in spark.createDataFrame(texts, "t string").select("t", bm25.tokens_or_empty(F.col("t")).alias("k")).collect():
        assert r.k == lexical.tokens(r.t)


@pytest.fixture(scope="module")
def found(spark):
    docs = docs_of(spark, corpus(1, 400)).repartition(3)
    queries = asked_of(spark, ["t1w3 t1w7 t1w9", "c1 c2 t2w5", "t3w1", "机器学习", "the of", "nowhere", "t0w1 t0w1 t4w2 c3"])
    return docs, queries, LexicalIndex.build(docs, shared_path(spark, "index"), block=8)


def test_statistics_and_scores_as_bm25(spark, found):
    docs, queries, index = found
    plain = bm25.corpus_of(docs)
    assert rows(index.term_stats()) == rows(bm25.term_stats(plain))
    assert rows(index.score(queries)) == rows(bm25.score(plain, queries))
    allowed = docs.filter("doc_id % 3 = 0").select("doc_id")
    for k in (1, 5, 1000):
        assert rows(index.top_k(queries, k)) == rows(bm25.ranked(bm25.score(plain, queries), k))
        assert rows(index.top_k(queries, k, allowed)) == rows(bm25.ranked(bm25.score(plain, queries, allowed), k))


def test_blocks_that_cannot_reach_the_kth_are_passed_over(spark, found):
    docs, queries, index = found
    best, blocks = index.search(queries, 3, first=2)
    assert rows(best) == rows(bm25.ranked(bm25.score(bm25.corpus_of(docs), queries), 3))
    counts = {r.read: r["count"] for r in blocks.groupBy("read").count().collect()}
    assert counts[False] > 0.2 * blocks.count()
    # every bound is one: no document of a block scores more
    block_of = index.table("postings").select("block", F.explode("docs").alias("doc_id")).distinct()
    over = index.score(queries).join(block_of, "doc_id").join(blocks, ["query_id", "block"]).filter("score > bound + 1e-6")
    assert over.count() == 0


def test_segments_add_up_to_the_whole(spark):
    data = corpus(2, 120)
    docs, whole = docs_of(spark, data), LexicalIndex.build(docs_of(spark, data), shared_path(spark, "index"))
    grown = LexicalIndex.build(docs.filter("doc_id < 50"), shared_path(spark, "index"))
    for _ in range(2):  # a segment written again replaces itself
        grown.add(docs.filter("doc_id >= 50"), "1")
    loaded = LexicalIndex.load(spark, grown.path)
    queries = asked_of(spark, ["t1w3 c1", "t2w2 t5w1"])
    assert rows(loaded.term_stats()) == rows(whole.term_stats()) and loaded.totals() == whole.totals()
    assert rows(loaded.top_k(queries, 7)) == rows(whole.top_k(queries, 7))
    # without the mark that ends it a segment doesn't count
    files, at = at_path(spark, f"{grown.path}/segments/segment=1/_SUCCESS")
    files.delete(at, False)
    assert LexicalIndex.load(spark, grown.path).totals()[0] == 50


def test_missing_and_taken_paths_are_errors(spark, found):
    with pytest.raises(FileNotFoundError):
        LexicalIndex.load(spark, shared_path(spark, "none"))
    with pytest.raises(FileExistsError):
        LexicalIndex.build(found[0], found[2].path)


def test_no_documents(spark):
    index = LexicalIndex.build(docs_of(spark, []), shared_path(spark, "index"))
    assert index.totals() == (0, 0.0) and index.top_k(asked_of(spark, ["a"]), 3).collect() == []


def test_rescue_asks_the_gate_first(spark):
    gated = spark.createDataFrame([(1, "plain words", 0.05), (2, "plain words", 0.2), (3, "plain words", 0.4), (4, "CS 5800 load", 0.2), (5, "declined", 0.2), (6, "no gate", None)], "query_id int, query string, p double")
    seen = []

    def search(asked):
        seen.extend((r.query_id, r.query) for r in asked.collect())
        return asked.select("query_id", F.explode(F.array(F.lit(10), F.lit(11))).alias("doc_id"), F.lit(1.0).alias("score"))

    texts = spark.createDataFrame([(10, "nothing"), (11, "plain words no gate")], "doc_id int, text string")
    expand = lambda q: F.when(q != "declined", F.concat(F.lit("more "), q))
    out = rescue(gated, search, texts, expand, lambda q, t: F.when(F.contains(t, q), 0.01).otherwise(0.0))
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in out.collect())
    assert sorted(seen) == [(2, "plain words\n\nmore plain words"), (6, "no gate\n\nmore no gate")]
    assert got == [(2, 1, 11), (2, 2, 10), (6, 1, 11), (6, 2, 10)]  # by scores of the query itself, none too low


def test_scratch_of_one_thread_leaves_the_others_alone(spark):
    kept, errors, gate = [], [], threading.Barrier(2)

    def work(n):
        try:
            with scratch(spark) as keep:
                first = settle(spark.range(n), "mine")
                gate.wait(60)
                second = settle(first.selectExpr("id + 1 AS id"), "mine")
                if n == 5:
                    gate.wait(60)  # the other one's scratch has ended
                keep.append(settle(first.unionByName(second), "mine"))
            if n == 4:
                gate.wait(60)
            kept.append((n, keep[0].count()))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in (4, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not errors and sorted(kept) == [(4, 8), (5, 10)]


def test_two_queries_at_a_time_as_one_by_one(spark, sf_dir):
    names = ["hybrid_search", "recall_at_k"]
    alone = {n: rows(QUERIES[n](spark, sf_dir)) for n in names}
    together, threads = {}, []
    for n in names:
        threads.append(threading.Thread(target=lambda n=n: together.__setitem__(n, rows(QUERIES[n](spark, sf_dir)))))
        threads[-1].start()
    for t in threads:
        t.join(300)
    assert together == alone


def test_tasks_hold_few_texts_and_give_small_batches():
    texts = ["w " * n for n in (10, 40_000, 5, 90_000, 7, 7)] + [None, ""] + [" ".join(f"x{i}y{j}" for j in range(200)) for i in range(300)]
    batch = lexical.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    lexical_text, lexical.TEXT = lexical.TEXT, 60_000
    try:
        cut = [x.column("text").to_pylist() for x in lexical._portions(iter([batch]))]
        assert [t for c in cut for t in c] == texts
        assert all(len(c) == 1 or sum(len(t or "") for t in c) <= 60_000 for c in cut)
        out = list(lexical._blocks(32)(iter([batch])))
    finally:
        lexical.TEXT = lexical_text
    # a row per block and term: a reader's batch of rows holds few documents, whatever a block holds
    assert max(x.num_rows for x in out) <= lexical.ENTRIES
    assert all(len(d) <= 32 for x in out for d in x.column("docs").to_pylist())
    docs = sorted(d for x in out for t, ds in zip(x.column("term").to_pylist(), x.column("docs").to_pylist(), strict=True) if t is None for d in ds)
    assert docs == list(range(len(texts)))


def test_entries_leave_tasks_in_order_with_bounds_and_counts(spark):
    data = corpus(4, 90)
    batch = lexical.pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in data], "text": [t for _, t in data]})
    out = [r for x in lexical._blocks(8)(iter([batch])) for r in x.to_pylist()]
    postings = [r for r in out if r["term"] is not None and r["block"] is not None]
    assert [r["term"] for r in postings] == sorted(r["term"] for r in postings)
    assert all((r["most"], r["least"]) == (max(r["tfs"]), min(r["lengths"])) for r in postings)
    counts = {r["term"]: (r["df"], r["cf"]) for r in out if r["block"] is None}
    texts = [lexical.tokens(t) for _, t in data]
    assert counts == {w: (sum(w in t for t in texts), sum(t.count(w) for t in texts)) for w in set(sum(texts, []))}
    # what a task gives is what is stored: nothing is sorted or written a second time
    index = LexicalIndex.build(docs_of(spark, data), shared_path(spark, "index"), block=8)
    files, at = at_path(spark, index.path)
    assert sorted(x.getPath().getName() for x in files.listStatus(at)) == ["documents", "entries", "segments", "terms"]
    assert index.table("postings").count() == index.table("entries").filter("size(tfs) > 0").count() > 0


def test_tasks_keep_the_best_of_blocks_whatever_their_batches():
    """What a task sends on is k a query, not a row for each query and document, and blocks may straddle batches."""
    rng = random.Random(5)
    rows_of = [{"term": f"w{t}", "block": b, "docs": [b * 8 + d for d in range(8)], "tfs": [rng.randrange(1, 4) for _ in range(8)], "lengths": [20 + d for d in range(8)]} for b in range(60) for t in range(6) if rng.random() < 0.7]
    schema = lexical.pa.schema([("term", "string"), ("block", "int64"), ("docs", lexical.pa.list_(lexical.pa.int64())), ("tfs", lexical.pa.list_(lexical.pa.int32())), ("lengths", lexical.pa.list_(lexical.pa.int32()))])
    asked = [(q, f"w{t}", (q % 3 - 1) * 1.5 if t == 0 else 1.0 + t + q / 7) for q in range(5) for t in range(q, 6)]
    want = {}
    for q, term, weight in asked:
        for r in rows_of:
            for doc, tf, n in zip(*(r[c] for c in ("docs", "tfs", "lengths")), strict=True) if r["term"] == term else ():
                want[q, doc] = want.get((q, doc), 0.0) + weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 25.0))
    given = lexical.pa.table({c: [a[i] for a in asked] for i, c in enumerate(("query_id", "term", "weight"))})
    batches = [lexical.pa.RecordBatch.from_pylist(rows_of[i : i + 7], schema) for i in range(0, len(rows_of), 7)]
    at_once, lexical.AT_ONCE = lexical.AT_ONCE, 2
    try:
        every = [r for x in lexical._Asked(given, 25.0, False, None).all(iter(batches)) for r in x.to_pylist()]
        best = [r for x in lexical._Asked(given, 25.0, False, 3).best(iter(batches)) for r in x.to_pylist()]
    finally:
        lexical.AT_ONCE = at_once
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in every} == pytest.approx(want, abs=1e-7) and len(every) == len(want)
    first = {q: [d for _, d in sorted((-round(v, 8), d) for (p, d), v in want.items() if p == q)[:3]] for q in range(5)}
    assert len(best) == 15 and {q: [r["doc_id"] for r in best if r["query_id"] == q] for q in range(5)} == first


def test_queries_in_parts_and_allowed_documents_as_bm25(spark, found, monkeypatch):
    docs, queries, index = found
    monkeypatch.setattr(lexical, "ASKED", 6)
    allowed, plain = docs.filter("doc_id % 3 = 0").select("doc_id"), bm25.corpus_of(docs)
    assert rows(index.top_k(queries, 5, allowed)) == rows(bm25.ranked(bm25.score(plain, queries, allowed), 5))


def test_tasks_not_what_each_sorts_grow_with_the_index(spark, found, monkeypatch):
    docs, queries, index = found
    (n, average), before = index.totals(), index.score(queries).rdd.getNumPartitions()
    monkeypatch.setattr(lexical, "TOKENS", 1000)
    more = math.ceil(n * average / 1000) - spark.sparkContext.defaultParallelism
    assert more > 0 and index.score(queries).rdd.getNumPartitions() == before + more
    assert rows(index.top_k(queries, 5)) == rows(bm25.ranked(bm25.score(bm25.corpus_of(docs), queries), 5))


def test_statistics_of_some_terms(spark, found):
    _, _, index = found
    of = spark.createDataFrame([("t1w3", 1), ("t1w3", 2), ("c1", 1), ("nowhere", 1)], "term string, query_id int")
    assert rows(index.term_stats(of)) == [r for r in rows(index.term_stats()) if r[0] in ("t1w3", "c1")]


def test_passages_are_found_by_statistics_of_their_own_terms(spark, sf_dir, monkeypatch):
    asked, own = [], LexicalIndex.term_stats
    monkeypatch.setattr(LexicalIndex, "term_stats", lambda self, of=None: asked.append(of) or own(self, of))
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    assert rows(retrieval.passage_hits(spark, sf_dir)) == rows(docs.join(items, F.contains("text", "passage")).select("item_id", "doc_id"))
    assert asked and None not in asked


def test_candidates_are_sent_to_the_texts(spark, sf_dir):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "60k")  # what is larger, as the documents, isn't sent
    try:
        plan = retrieval.pool(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_queries_of_the_same_terms_are_asked_once(spark, found, monkeypatch):
    docs, _, index = found
    queries, asked, own = asked_of(spark, ["t1w3 c1", "c1 t1w3 nowhere", "c1 c1 t1w3", "t1w3 c1", "nowhere"]), [], LexicalIndex._scored
    monkeypatch.setattr(LexicalIndex, "_scored", lambda self, of, *rest: asked.append(of.select("query_id").distinct().count()) or own(self, of, *rest))
    assert rows(index.top_k(queries, 4)) == rows(bm25.ranked(bm25.score(bm25.corpus_of(docs), queries), 4))
    assert asked == [2]


@pytest.mark.parametrize("often", [1, 2, 1000])
def test_frequent_and_rare_terms_and_few_postings_at_once_as_bm25(spark, found, often, monkeypatch):
    docs, queries, index = found
    monkeypatch.setattr(lexical, "OFTEN", often)
    monkeypatch.setattr(lexical, "POSTINGS", 50)
    monkeypatch.setattr(lexical, "LEAVE", 7)
    plain = bm25.score(bm25.corpus_of(docs), queries)
    assert rows(index.top_k(queries, 5)) == rows(bm25.ranked(plain, 5)) and rows(index.score(queries)) == rows(plain)


def test_rerankers_in_parts_prepare_texts_before_the_pairs(spark):
    pairs = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5), (2, 10, 0.5), (2, 12, 0.5)], "query_id int, doc_id int, score double")
    asked = spark.createDataFrame([(1, "Red  cat"), (2, "dog")], "query_id int, query string")
    texts = spark.createDataFrame([(10, "the red dog"), (11, "CAT red\ncat"), (12, None)], "doc_id int, text string")
    got = reranked(pairs, asked, texts, T.overlap)
    assert rows(got) == rows(reranked(pairs, asked, texts, lambda q, t: T.overlap(q, t))) == [(1, 10, 0.5, 0.5), (1, 11, 0.5, 1.0), (2, 10, 0.5, 1.0), (2, 12, 0.5, 0.0)]
    assert "split" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
