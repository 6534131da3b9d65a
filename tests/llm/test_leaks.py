import random
import re

import numpy as np
import pytest

from tessel.llm import leaks
from tests.llm.helpers import TEXTS, awkward, empty, prose
from tests.oracle import connect, same

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        for i in range(max(1, len(p) - window + 1)) if p else ():
            x = p[i : i + window]
            for at in range(len(w) - len(x) + 1):
                if w[at : at + len(x)] == x:
                    hit |= set(range(at, at + len(x)))
                    found |= {item} - {None}
    return hit, found


def index_of(pieces):
    return leaks.FMIndex(**leaks.build(pieces))


@pytest.mark.parametrize("seed", range(25))
def test_places_of_phrases(seed):
    rng = random.Random(seed)
    pieces = [[b"%d" % rng.randrange(rng.choice([1, 2, 30])) for _ in range(rng.choice([0, 1, 5, 40, 200]))] for _ in range(rng.randrange(1, 6))]
    pieces += pieces if rng.random() < 0.5 else []
    index, starts = index_of(pieces), np.cumsum([0, *(len(p) + 1 for p in pieces)])
    asked = [[b"%d" % rng.randrange(3) for _ in range(rng.randrange(1, 8))] for _ in range(10)]
    asked += [p[i : i + 6] for p in pieces for i in range(0, len(p) - 6, 37)] + [[b"none", b"0"], [b"0", b"none"]]
    table = np.zeros((len(asked), 8), np.int64)
    for i, p in enumerate(asked):
        table[i, : len(p)] = [index.code.get(w, 0) for w in p]
    for p, lo, hi in zip(asked, *index.ranges(table, np.array(list(map(len, asked)))), strict=True):
        want = [int(a) + i for a, x in zip(starts, pieces, strict=False) for i in range(len(x) - len(p) + 1) if x[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(lo, max(lo, hi))).tolist()) == want


def test_suffixes_in_order():
    text = np.array([3, 1, 2, 1, 2, 1, 2, 0, 1, 2, 1, 2, 1, 2, 0, 0, 5, 5, 5, 5, 0])
    stops = np.flatnonzero(text == 0)
    rank = [int(np.searchsorted(stops, i)) if c == 0 else int(c) + 100 for i, c in enumerate(text)]
    assert leaks.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: rank[i:])


LONG = " ".join(f"x{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Short ITEM here"), (3, None), (4, ""), (5, "?!"), (6, "one"), (7, prose(2, 30)), (8, "x3 x4 x5 x6 x7 x8 x9 x10 x11 x12"), (None, "ünïcode"), (1, "no id")]


@pytest.mark.parametrize("shard,phrases", [(leaks.SHARD, leaks.PHRASES), (40, 5)])
def test_as_brute_force(spark, monkeypatch, shard, phrases):
    """Also with texts in pieces, an index of many shards and phrases in many blocks."""
    monkeypatch.setattr(leaks, "SHARD", shard)
    monkeypatch.setattr(leaks, "PHRASES", phrases)
    texts = [*TEXTS, f"before {LONG.upper()} after", f"{LONG} {LONG}", " ".join(LONG.split()[5:19]), "a short item: here, one; Short item here", prose(9, 90) + " " + LONG + " " + prose(8, 70), *[LONG] * 20]
    docs, items = awkward(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = leaks.find(leaks.index_of(docs), items).collect()
    want = {r.doc_id: (r.text, *brute(r.text, ITEMS)) for r in docs.collect()}
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for r in docs.collect())
    for r in got:
        text, hit, found = want[r.doc_id]
        assert (r.n_words, set(r.item_ids)) == (len(words(text)), found)
        spans = [(s.start, s.end) for s in r.spans]
        assert {i for a, b in spans for i in range(a, b)} == hit
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_empty_tables_and_long_windows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaks.find(leaks.index_of(empty(spark)), items).collect() == []
    index = leaks.index_of(awkward(spark, TEXTS))
    assert all(r.spans == [] for r in leaks.find(index, items.limit(0)).collect())
    with pytest.raises(ValueError):
        leaks.phrases_of(items, leaks.LONGEST + 1)


def test_query_as_sql(spark, sf_dir):
    same(leaks.decontamination(spark, sf_dir), connect(sf_dir), leaks.SQL)
