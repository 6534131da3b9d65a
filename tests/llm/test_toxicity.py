import numpy as np
from pyspark.sql import functions as F

from tessel.llm import toxicity
from tests.llm.helpers import TEXTS, awkward, empty, prose


def index(n=300, seed=0, groups=1):
    """An index of random examples; those of a group have terms of their own besides common ones."""
    rng = np.random.default_rng(seed)
    counts = []
    for i in range(n):
        own = [f"g{i % groups}t{j}" for j in rng.choice(30, 6, replace=False)]
        counts.append({t: int(rng.integers(1, 4)) for t in [*own, *(f"t{j}" for j in rng.choice(40, rng.integers(0, 5), replace=False))]} if i % 50 else {})
    row = np.repeat(np.arange(n), [len(c) for c in counts])
    return toxicity.Index(list(range(n)), rng.integers(0, 2, n), row, [t for c in counts for t in c], np.array([k for c in counts for k in c.values()])), counts


def plain_weights(counts, toxic):
    """TF-IDF weights times correlation with the label, computed again."""
    n, out = len(counts), {}
    for t in {t for c in counts for t in c}:
        has = np.array([t in c for c in counts])
        d, a, p = has.sum(), toxic[has].sum(), toxic.sum()
        phi = max(0.0, abs(a - d * p / n) - 0.5) * n / np.sqrt(max(d * (n - d), 1) * p * (n - p))
        out[t] = (np.log((1 + n) / (1 + d)) + 1) * (phi + toxicity.FLOOR)
    return out


def test_nearest_equals_brute_force():
    ix, counts = index(700, groups=12)
    toxic = np.empty(len(counts))
    toxic[ix.number] = ix.toxic
    w = plain_weights(counts, toxic)

    def vector(c):
        v = {t: (1 + np.log(k)) * w[t] for t, k in c.items() if t in w}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    vectors = [vector(c) for c in counts]
    rng, asked = np.random.default_rng(1), 100
    for i in range(asked):
        c = {f"g{i % 12}t{j}": int(rng.integers(1, 5)) for j in rng.choice(30, 8, replace=False)} | {f"t{j}": 1 for j in rng.choice(40, 3, replace=False)} | {"unknown": 3}
        q = vector(c)
        sims = [(-round(sum(x * v.get(t, 0.0) for t, x in q.items()), 12), j) for j, v in enumerate(vectors)]
        want = sorted(s for s in sims if s[0] < 0)[: toxicity.K]
        at, near = ix.nearest(*ix.vector(c))
        assert np.allclose(near, [-s for s, _ in want]) and [ix.ids[a] for a in at] == [j for _, j in want]
    assert ix.read < 0.6 * asked * ix.blocks  # blocks are passed over


def test_equal_texts_are_their_own_evidence():
    ix, counts = index(400, groups=7)
    for i in range(1, 400, 37):
        if counts[i]:
            at, near = ix.nearest(*ix.vector(counts[i]))
            assert near[0] > 1 - 1e-9 and counts[ix.ids[at[0]]] == counts[i]


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(spark, "/root/testdata/sf0.01")
    assert got.count() == docs.count()
    r = got.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.94 and 0 <= r[1] <= r[2] <= 1
    worded = got.join(docs.filter(F.length("text") > 40), "doc_id", "left_semi")
    assert worded.filter(F.size("evidence") > 0).count() >= 0.99 * worded.count()
    assert got.select("score").distinct().count() > 0.5 * got.count()


def test_awkward_rows(spark):
    bad = [prose(i, 40) + " awful" for i in range(20)]
    texts = [*bad, *[prose(60 + i, 40) for i in range(60)], *TEXTS, "AWFUL thing"]
    docs = awkward(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(80)] + [(None, 1), (3, 1), (25, None)], "doc_id long, toxic int")
    docs = docs.union(docs.filter("doc_id in (4, 30)"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert min(got[i] for i in range(20)) > 0.5 > max(got[i] for i in range(20, 80)) and got[len(texts) - 1] > 0.5
    assert got[81] == got[82] == got[83]


def test_without_labels(spark):
    docs = awkward(spark, TEXTS)
    ix = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, ix).collect()} == {0.0}
    assert toxicity.score_toxicity(empty(spark), ix).count() == 0
