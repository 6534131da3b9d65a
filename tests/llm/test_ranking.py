import math
import re
from collections import Counter

import pytest

from tessel.llm import ranking
from tests.llm.helpers import TEXTS, awkward, empty, prose
from tests.oracle import connect, same

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for i, wanted in asked.items():
        scored = []
        for at, (d, b) in enumerate(bags):
            m = 10 + (90 * sum(b.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in wanted if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, at, d))
        out |= {(i, rank, x[4], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)}
    return out


ITEMS = [(1, "w3 w5, W7 w3"), (2, None), (3, ""), (4, "?!"), (5, "nowhere-to-be-found"), (6, "ünïcode 日本語 w1"), (7, prose(2, 300)), (1, "w9"), (None, "w2 w4")]


@pytest.mark.parametrize("bits,postings,cells", [(ranking.BITS, ranking.POSTINGS, ranking.CELLS), (1 << 15, 40, 64)])
def test_as_brute_force(spark, monkeypatch, bits, postings, cells):
    """Also with a bitmap so small that other terms pass it, blocks of few postings and small slices."""
    for name, value in (("BITS", bits), ("POSTINGS", postings), ("CELLS", cells)):
        monkeypatch.setattr(ranking, name, value)
    texts = [*TEXTS, *[prose(s, 20 + s) for s in range(5, 40)], *["w1 w2 w3"] * 25, *["w3 w1 w2"] * 4, "W1 w2;w3"]
    docs, items = awkward(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranking.rank(docs, items).collect()
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    assert {tuple(r) for r in got} == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


def test_equal_bags_are_one_class_with_its_least_ids(spark):
    docs = spark.createDataFrame([(i, "b a b" if i % 2 else "B, b a") for i in range(40, 0, -1)] + [(99, "a b")], "doc_id long, text string")
    bags = ranking.bags_of(docs, ranking.bitmap(ranking.item_terms(spark.createDataFrame([(1, "a b")], "item_id long, text string"))))
    classes = sorted((r.bag, r.members) for r in ranking.classes_of(bags, (41, 122)).collect())
    assert classes == [("a 1 b 1", [99]), ("a 1 b 2", list(range(1, 11)))]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.rank(empty(spark), items).collect() == []
    assert ranking.rank(awkward(spark, TEXTS), items.limit(0)).collect() == []


def test_query_as_sql(spark, sf_dir):
    same(ranking.lexical_ranking(spark, sf_dir), connect(sf_dir), ranking.SQL)
