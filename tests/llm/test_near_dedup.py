import numpy as np

from tessel.llm import near_dedup as nd
from tests.llm.helpers import TEXTS, awkward, empty, prose


def truth(texts):
    """Least index of each text's component of links, by all pairs that share a window."""
    sets, up = [nd.weighted_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = {}
    for i in range(len(texts)):
        found = {j for k in sets[i][0].tolist() for j in seen.get(k, ())}  # texts that share no window aren't similar
        for k in sets[i][0].tolist():
            seen.setdefault(k, []).append(i)
        for j in sorted(found):
            if nd.similarity(sets[i], sets[j]) >= nd.SIMILARITY:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def family(seed, n, words=120, edits=(0, 1, 2, 3, 5, 8)):
    """Copies of one text with some words replaced: many pairs lie near the bound."""
    rng = np.random.default_rng(seed)
    base, out = prose(seed, words).split(), []
    for i in range(n):
        w = list(base)
        for at in rng.choice(len(w), edits[i % len(edits)], replace=False):
            w[at] = f"e{rng.integers(60)}"
        out.append(" ".join(w))
    return out


def test_classes_equal_all_pairs(spark):
    texts = [*family(1, 90), *family(2, 30), *[prose(50 + i, 100) for i in range(20)], "a b c", "a b c", "a b", *family(3, 20, 9, (0, 1))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == truth(texts)


def test_awkward_rows(spark):
    docs = awkward(spark, TEXTS)
    got = nd.near_classes(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got}
    assert by[0] == by[6] == (0, 3) and by[None] == (None, 1)
    assert all(by[i] == (i, 1) for i in (1, 2, 3))
    kept = nd.deduplicate(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [i for i in range(len(TEXTS)) if i != 6]
    assert nd.near_classes(empty(spark)).count() == 0 and nd.deduplicate(empty(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        keys = rng.integers(0, 2**63, 400).astype(np.uint64)
        a = rng.uniform(0.2, 3, 400)
        b = np.where(rng.random(400) < share, a, a * rng.uniform(0.1, 1, 400))
        same = np.mean(nd.dart_minhash(keys, a, 2000) == nd.dart_minhash(keys, b, 2000))
        assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_few_and_many_elements_agree():
    keys = np.array([5, 9], np.uint64)
    few = nd.dart_minhash(keys, np.array([1.0, 1.0]), 130)
    assert len(few) == 130 and (few == nd.dart_minhash(keys[::-1], np.array([1.0, 1.0]), 130)).all()


def test_components_of_a_chain(spark):
    nodes = [bytes([i]) for i in range(40)]
    edges = spark.createDataFrame([(nodes[i], nodes[i + 1]) for i in range(29)] + [(nodes[39], nodes[35])], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["label"]) for r in nd.components(edges).collect()}
    assert all(got[n] == nodes[0] for n in nodes[:30]) and got[nodes[39]] == got[nodes[35]] == nodes[35]


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    docs = spark.createDataFrame([(1, a), (1, b), (2, c), (2, c), (None, a), (None, prose(4, 60)), (None, prose(4, 60)), (3, b + " more")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"]) for r in nd.near_classes(docs).collect()) == [(0, 0, 2), (0, 0, 2), (0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 2), (2, 2, 2), (3, 1, 2)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in nd.deduplicate(docs).collect())
    assert kept == sorted([(1, a), (1, b), (2, c), (0, prose(4, 60))])


def test_recall_on_the_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = truth([t for _, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(docs).collect()}
    linked = [i for i, root in enumerate(want) if root != i]
    assert len(linked) > 50
    assert sum(got[rows[i][0]] == got[rows[want[i]][0]] for i in linked) >= 0.9 * len(linked)
    assert all(want[i] == want[j] for i, (d, _) in enumerate(rows) for j in [next(k for k, (e, _) in enumerate(rows) if e == got[d])])
