import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tessel.llm import periods
from tests.llm.helpers import TEXTS, awkward, empty
from tests.oracle import connect, same


def brute(words):
    """Runs by comparing each word with the one q later, for all q."""
    least = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if (length := i - start + q) >= max(6, 4 * q):
                least[start, length] = min(q, least.get((start, length), q))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, kinds = rng.choice([0, 1, 5, 6, 7, 20, 80, 300]), rng.choice([1, 2, 3, 30])
    words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 5))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_as_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(periods, "SLICE", 7)
    texts = [random_words(rng) for _ in range(rng.randrange(1, 8))]
    assert [[tuple(r) for r in found.tolist()] for found in periods.runs_of(texts)] == [brute(w) for w in texts]


def test_extensions_as_words_agree():
    rng = random.Random(1)
    words = np.array([0] + [rng.randrange(2, 4) for _ in range(400)] + [2, 3] * 100 + [2] * 150 + [1])
    rounds = periods.recompress(words, 2)
    assert sum(len(r.symbols) for r in rounds) < 10 * len(words) and len(rounds[-1].symbols) < 20
    i, j = (np.array([rng.randrange(1, len(words) - 1) for _ in range(3000)]) for _ in range(2))
    i, j = i[i != j], j[i != j]
    for way in (1, -1):
        for a, b, got in zip(i, j, periods.extend(rounds, i, j, way), strict=True):
            n = 0
            while words[a + way * n] == words[b + way * n] > 1:
                n += 1
            assert got == n


def test_one_word_a_million_times():
    assert periods.runs_of([[b"a"] * 300_000])[0].tolist() == [[0, 300_000, 1]]


def looped(doc_id, text):
    words, h = text.encode().split() if text else [], zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_awkward_rows(spark):
    docs = awkward(spark, [*TEXTS, "a b c " * 9, "x " * 7 + "y", "p q p q p q p q r r r r r r"] * 3)
    got = periods.periodic_runs(docs.select(docs.doc_id, periods.looped(docs.doc_id, docs.text).alias("text"), "kept")).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        words = looped(r.doc_id, by_id[r.doc_id])
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
        assert r.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert periods.periodic_runs(empty(spark)).collect() == []


def test_query_as_sql(spark, sf_dir):
    found = periods.period_detection(spark, sf_dir)
    same(found, connect(sf_dir), periods.SQL)
    assert found.filter(f"n_runs = 0 and runs_sha256 = '{sha256(b'').hexdigest()}'").count() and found.filter("n_runs > 0").count()
