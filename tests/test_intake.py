"""Readers of seeds, links and posts, incremental indexes, and operators on records, on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from tessel.operators import bm25, privacy, tables
from tessel.plans import intake
from tessel.sources import html
from tessel.sources import json as J
from tessel.streaming import events

RECORDS = [{"title": "a", "_note": "x", "pay": 1}, {"title": "b"}, {}]


@pytest.mark.parametrize("document", [RECORDS, {"records": RECORDS, "_about": "seed"}])
def test_records_of_either_shape(spark, tmp_path, document):
    (tmp_path / "seed.json").write_text(json.dumps(document, indent=1))
    rows = J.read_records(spark, str(tmp_path / "seed.json")).select("pos", F.array_sort(F.map_keys("record")).alias("k"), F.col("record")["title"].cast("string").alias("t")).orderBy("pos")
    assert [tuple(r) for r in rows.collect()] == [(0, ["pay", "title"], "a"), (1, ["title"], "b"), (2, [], None)]


def test_records_of_another_shape_give_none(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"other": 1}')
    assert J.read_records(spark, str(tmp_path / "seed.json")).count() == 0


def test_program_with_both_arrays(spark, tmp_path):
    seed = {"program": {"program_id": "p1", "name": "P"}, "required_courses": [{"code": "A 1", "semester": 1}, {"code": "A 2", "semester": 2}], "prerequisites": [{"code": "A 2", "prereq": "A 1"}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed, indent=1))
    program, courses, needs = J.read_program(spark, str(tmp_path / "seed.json"))
    assert [tuple(r) for r in program.collect()] == [("p1", "P")]
    assert sorted(tuple(r) for r in courses.collect()) == [("p1", "A 1", 1), ("p1", "A 2", 2)]
    assert [tuple(r) for r in needs.collect()] == [("p1", "A 2", "A 1")]


def test_posts_without_values(spark):
    rows = spark.createDataFrame([("1", None, None, None, None), ("2", "t", "b", "me", 3)], "id string, title string, body string, author string, score int")
    assert sorted(tuple(r) for r in J.post_records(rows, "t1").collect()) == [("t1_1", "", "", "[deleted]", 0), ("t1_2", "t", "b", "me", 3)]


def test_index_links_match_whole_and_once(spark):
    page = '<a href="/list/cs/">x</a><a href="/list/cs">y</a><a href="/list/CS">z</a><a href="/list/ds/more">q</a><a href="/list/ds">w</a>'
    got = html.index_links(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"), "/list/([a-z]{2,8})/?")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "cs", 1), (1, "ds", 5)]


def test_incremental_index_takes_each_document_once(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, f"word{i}") for i in ids], "doc_id long, text string")
    run = lambda: events.incremental_index(
        spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "state"), bm25.corpus_of
    ).awaitTermination()
    rows(1, 2).write.parquet(str(tmp_path / "in"))
    run()
    rows(3).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [1, 2, 3]


def test_batch_without_ids(spark):
    assert tables.get_batch(spark.range(3), [], "id").count() == 0
    assert [r[0] for r in tables.get_batch(spark.range(3), [2, 9, None], "id").collect()] == [2]


def test_corpus_text_without_expansion(spark):
    rows = spark.createDataFrame([("x", "ok"), (None, "ok"), ("y", "old")], "text string, status string")
    assert sorted(r["text"] for r in bm25.corpus_text(rows, "ok").collect()) == ["", "x"]


def test_merge_keeps_what_is_empty_or_not_listed(spark):
    old = spark.createDataFrame([(1, "a", 5, "n"), (2, "b", 6, "n")], "id int, t string, x int, name string")
    new = spark.createDataFrame([(1, " ", 99, "other"), (2, "c", None, None), (7, "q", 1, "q")], "id int, t string, x int, name string")
    got = tables.merge_fields(old, new, "id", ["t", "x"], {"x": F.col("x") < 10})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 5, "n"), (2, "c", 6, "n")]


def test_violations_pass_nulls(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (3, -1, None), (4, 9, None)], "id int, x int, u string")
    target = spark.createDataFrame([(5,), (-1,)], "x int")
    got = tables.violations(rows, "id", {"positive": F.col("x") > 0}, {"unique": ["u"]}, {"refers": ("x", target)})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "unique"), (2, "unique"), (3, "positive"), (4, "refers")]


def test_queue_releases_whole_groups(spark):
    rows = lambda x: spark.createDataFrame(x, "id int, company string, role string")
    queue, arrived = rows([(1, "a", "r"), (2, "b", "r"), (3, None, "s")]), rows([(4, "a", "r")])
    got = privacy.release_queue(queue, arrived, ["company", "role"], {"company": F.lit("any")}, 2)
    assert sorted((r["id"], r["decision"], r["released_keys"]) for r in got.collect()) == [(1, "released", "a|r"), (2, "generalized", "any|r"), (3, "held", None), (4, "released", "a|r")]


def test_texts_are_encoded_once(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, None)], "id int, text string")
    plan = intake.encode_distinct(rows, "text", lambda t: F.array(F.lit(1.0), F.rand() + 1))
    got = {r["id"]: tuple(r["vector"]) for r in plan.collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3]


def test_protected_columns_never_leave(spark):
    assert intake.without_protected(spark.range(1).selectExpr("id", "1 AS redaction_audit", "2 AS contributor_user_id")).columns == ["id"]
