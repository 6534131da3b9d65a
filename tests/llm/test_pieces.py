import random

import numpy as np
import pytest

from tessel.llm import pieces
from tests.llm.helpers import TEXTS, awkward, empty, prose


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.4, -np.inf, rng.normal(size=s)) for s in ((3, 4), (4, 5), (5, 2)))
    x, y = pieces.multiply(pieces.multiply(a, b), c), pieces.multiply(a, pieces.multiply(b, c))
    assert np.allclose(np.nan_to_num(x, neginf=-9), np.nan_to_num(y, neginf=-9))


def test_chunked_scan_equals_the_library(spark, library):
    rng = random.Random(4)
    texts = [prose(i, 400) for i in range(4)]
    texts += ["".join(rng.choice("abcdehilnoprst") for _ in range(900)), " " * 500, "".join(rng.choice(["a", " ", "   ", "the", "ing", "é", "日", "\n", "😀"]) for _ in range(800)), texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = {}
    for r in pieces.encode(docs, size=64, fan=3).collect():  # several levels of the scan
        got.setdefault(r["doc_id"], []).append(r["token_ids"])
    assert len(got[0]) == 2
    for i, t in enumerate(texts):
        assert all(x == library.encode(t) for x in got[i])


def test_round_trip(spark, library):
    docs = awkward(spark, TEXTS)
    rows = pieces.encode_checked(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            t = TEXTS[r["doc_id"]]
            assert r["round_trip"] is (None if t is None else True) and r["token_ids"] == (None if t is None else library.encode(t))
    encoded = pieces.encode(docs)
    assert "text" not in encoded.columns
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()}
    assert {r["text"] for r in pieces.decode(encoded.filter("doc_id = 0").selectExpr("*", "'x' AS text")).collect()} == {TEXTS[0]}
    assert all(back[i] == t for i, t in enumerate(TEXTS))


def test_empty_table(spark):
    assert pieces.encode_checked(empty(spark)).count() == 0


def test_whole_texts_take_one_python_step(spark, docs_schema="doc_id long, text string"):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], docs_schema)
    plan = pieces.encode_checked(docs)._jdf.queryExecution().optimizedPlan().toString()
    whole = plan[plan.index("Union") :].split("\n:- ")[-1].split("\n+- ")[0]
    assert "MapInArrow encode_whole" in whole and whole.count("MapInArrow") == 1 and plan[: plan.index("Union")].count("MapInArrow") == 0
