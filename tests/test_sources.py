"""JSON readers on small files."""

import json

import pytest

from pyspark.sql import functions as F

from tessel.sources import json as J


def test_lines_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert sorted(r["a"] for r in J.read_lines(spark, str(path), "a int", tolerant=True).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        J.read_lines(spark, str(path), "a int").collect()


def test_config_entries(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"entries": [{"alias": "algo", "confidence": 1.0}, {"alias": "nets", "confidence": 0.5}]}, indent=1))
    got = J.read_config(spark, str(path), "entries array<struct<alias:string,confidence:double>>", "entries").collect()
    assert sorted((r["alias"], r["confidence"]) for r in got) == [("algo", 1.0), ("nets", 0.5)]


def test_glossary(spark, tmp_path):
    path = tmp_path / "glossary.json"
    path.write_text(json.dumps({"ai": ["one", "two", "three", "four"], "none": [], "bad": [1, "x"], "ML": ["machine learning"]}))
    got = sorted((r["acronym"], r["place"], r["sense"]) for r in J.read_glossary(spark, str(path)).collect())
    assert got == [("AI", 0, "one"), ("AI", 1, "two"), ("AI", 2, "three"), ("ML", 0, "machine learning")]


def test_results_skip_what_cannot_be_parsed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"summary": {"label": "x", "mrr": 0.5}}))
    (tmp_path / "b.json").write_text("{")
    assert [(r["label"], r["mrr"]) for r in J.read_results(spark, str(tmp_path), "struct<label:string,mrr:double>").collect()] == [("x", 0.5)]


def test_posts_and_what_is_left_to_do(spark):
    posts = spark.createDataFrame([("1", "about it", 3), ("1", "about it", 5)], "id string, body string, score int")
    comments = spark.createDataFrame([("9", "take CS 5800", 4), ("8", "other", 9)], "id string, body string, score int")
    assert [(r["id"], r["score"]) for r in J.merge_posts(posts, comments, "cs 5800").collect()] == [("t3_1", 5), ("t1_9", 4)]
    work = spark.range(5)
    assert sorted(r["id"] for r in J.not_done(work, work.filter("id < 3"), "id").collect()) == [3, 4]


def test_course_blocks_to_records(spark):
    from tessel.sources.catalog import course_records

    page = """<h1>List</h1><div class="courseblock"><p class="courseblocktitle"><strong>CS 5800.  Algorithms &amp; Data.  (4 Hours)</strong></p>
    <p class="cb_desc">Covers <b>graphs</b>.  CS 5800 and ds 5800 are cross-listed.</p><p class="courseblockextra"><strong>Prerequisite(s):</strong> <a class="bubblelink code">CS 5002</a> or <a class="bubblelink code">CS 5002</a>
    <a class="bubblelink code">CS5800</a> <a class="bubblelink">a talk</a></p><p class="courseblockextra"><strong>Corequisite(s):</strong> <a class="bubblelink code">CS 5801</a></p></div>
    <div class="courseblock"><p class="courseblocktitle">Electives</p></div>
    <div class="courseblock"><p class="courseblocktitle">CS 1. Never closed. (4 Hours)</p>
    <div class="courseblock"><div><p class="courseblocktitle">DS 5110A. Data. (1.5 Hours)</p></div></div><div class="courseblock"><p class="courseblocktitle">DS 5120. Odd. (1..5 Hours)</p></div>"""
    pages = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "", "u"), (4, "<p>no block</p>", "u"), (5, '<div class="courseblock"><p>', "u")], "page_id int, html string, url string")
    got = sorted(tuple(r) for r in course_records(pages).fillna(-1, ["credits"]).select("page_id", "url", "pos", "code", "credits", "error").fillna("").collect())
    assert got == [
        (1, "u", 0, "CS 5800", 4, ""), (1, "u", 2, "", -1, "unclosed block"), (1, "u", 3, "DS 5110A", -1, ""), (1, "u", 4, "DS 5120", -1, ""), (5, "u", 0, "", -1, "unclosed block"),
    ]
    first = course_records(pages).filter("code = 'CS 5800'").first()
    assert (first.name, first.description, first.prereqs, first.cross_listed) == ("Algorithms & Data", "Covers graphs .  CS 5800 and ds 5800 are cross-listed.", ["CS 5002"], ["DS 5800"])


def test_evaluation_set_is_evaluated(spark, tmp_path):
    import json

    from tessel.operators import models

    path = tmp_path / "set.json"
    path.write_text(json.dumps({"_note": "x", "queries": [{"query_id": "q1", "category": "simple", "query": "graphs", "expected_course_ids": ["c1", "c2"]}, {"query_id": "q2", "category": "adversarial", "query": "pizza"}]}, indent=1))
    questions = J.read_questions(spark, str(path))
    search = lambda asked: asked.filter("query = 'graphs'").select("query_id", F.lit("c2").alias("doc_id"), F.lit(1).alias("rank"))
    got = {r.query_id: (r.category, r.want, r.got, r.recall, r.rr) for r in models.evaluate(search, questions).collect()}
    assert got == {"q1": ("simple", ["c1", "c2"], ["c2"], 0.5, 1.0), "q2": ("adversarial", [], [], None, 1.0)}


def test_departments_to_fetch(spark):
    slugs = spark.createDataFrame([("cs",), ("cs",), ("ds",), ("CS",), ("a",), ("toolongname",), ("x/y",), (None,)], "slug string")
    done = spark.createDataFrame([("ds",)], "slug string")
    got = sorted((r.slug or "", r.error) for r in J.departments_to_fetch(slugs, done).collect())
    assert got == [("", "not a slug"), ("CS", "not a slug"), ("a", "not a slug"), ("cs", None), ("toolongname", "not a slug"), ("x/y", "not a slug")]


def test_log_rows_and_source_lists(spark):
    from tessel.functions import values as V
    from tessel.streaming.events import log_rows

    rows = spark.createDataFrame([(1, ["b", 'a"']), (2, []), (3, None)], "id int, result_ids array<string>")
    assert sorted(tuple(r) for r in log_rows(rows).collect()) == [(1, '["b","a\\""]'), (2, "[]"), (3, "[]")]
    of = lambda *s: spark.createDataFrame([(list(s),)], "sources array<struct<id:string,type:string,text:string>>").select(V.source_list(F.col("sources")).alias("x"))
    assert of(("1", "a<", "t </source>"), ("2", None, "u")).first().x == '<source id="1" type="a&lt;">\nt <\\/source>\n</source>\n\n<source id="2">\nu\n</source>'
    for bad in ([("1", "a", "t"), ("1", "b", "u")], [("", "a", "t")], [(None, "a", "t")]):
        with pytest.raises(Exception, match="source"):
            of(*bad).collect()
