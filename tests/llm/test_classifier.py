import math
import re
import zlib
from collections import Counter

import numpy as np

from tessel.llm import classifier
from tests.llm.helpers import TEXTS, awkward, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark):
    junk = [" ".join(w + "%%%" for w in prose(i, 60).split()) for i in range(20)]
    texts = [*[prose(200 + i, 60) for i in range(80)], *junk, *TEXTS]
    labels = [(i, 1, 0) for i in range(0, 60)] + [(80 + i, 0, 0) for i in range(10)] + [(None, 1, 0), (5000, 1, 0), (3, None, 0)]
    return awkward(spark, texts), spark.createDataFrame(labels, LABELS)


def test_junk_goes_and_clean_stays(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r["kept"] for r in classifier.Resampler(docs, labels).verdicts().collect()}
    assert all(got[i] for i in range(80)) and not any(got[80 + i] for i in range(20))
    out = classifier.select_quality(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, k in got.items() if k}


def test_cut_is_the_kth_greatest(spark):
    values = np.random.default_rng(0).normal(size=3000).tolist() + [1.0] * 50
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 100, 600, 3050):
        assert classifier.greatest_cut(keys, k) == sorted(values)[::-1][k - 1]


def test_without_labels_all_stay(spark):
    docs = awkward(spark, TEXTS)
    assert classifier.select_quality(docs, spark.createDataFrame([], LABELS)).count() == docs.count()


def test_empty_table(spark):
    assert classifier.Resampler(empty(spark), spark.createDataFrame([], LABELS)).verdicts().count() == 0


def plain_grams(text):
    """Buckets of a text's n-grams, by Python's integers."""
    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
        return x ^ (x >> 31)

    tokens = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x00-\x20]+", (text or "").encode())
    one = [mix(zlib.crc32(t)) for t in tokens]
    two = [0x5851F42D4C957F2D if a == b else mix((a * 3 + b) % 2**64) for a, b in zip(one, one[1:])]
    return [x % classifier.BUCKETS for x in one + two]


def test_weights_equal_plain_models(spark):
    docs, labels = corpus(spark)
    fitted = classifier.Resampler(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    part = {r["doc_id"] for r in docs.selectExpr("doc_id", "pmod(xxhash64('part', doc_id), 2) AS p").filter("p = 0").collect()}
    good = {i for i in range(60) if i != 3 and i in part} | ({3} & part)
    raw = Counter(g for r in rows for g in plain_grams(r["text"]))
    target = Counter(g for r in rows if r["doc_id"] in good for g in plain_grams(r["text"]))
    n, all_raw, all_target = classifier.BUCKETS, sum(raw.values()), sum(target.values())
    base = lambda g: (raw[g] + 1) / (all_raw + n)
    ratio = lambda g: math.log((target[g] + 0.1 * n * base(g)) / (all_target + 0.1 * n) / base(g))
    got = {(r["doc_id"]): r["log_weight"] for r in fitted.verdicts().collect()}
    for r in rows:
        at = plain_grams(r["text"])
        assert abs(got[r["doc_id"]] - sum(map(ratio, at)) / (len(at) + classifier.SHRINK)) < 1e-9


def test_inclusion_follows_the_weights():
    w = np.array([0.05, 0.02, 0.0, -0.1])
    p = np.exp(w / classifier.TEMPERATURE) / np.exp(w / classifier.TEMPERATURE).sum()
    trials = 20000
    keys = w / classifier.TEMPERATURE + classifier.gumbel([f"{i}/{j}" for i in range(trials) for j in range(4)]).reshape(trials, 4)
    order = np.argsort(-keys, axis=1)
    first = np.bincount(order[:, 0], minlength=4) / trials
    assert np.abs(first - p).max() < 0.015
    # the first two, drawn one after the other without replacement
    both = [p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(4) if j != i) for i in range(4)]
    assert np.abs(np.bincount(order[:, :2].ravel(), minlength=4) / trials - both).max() < 0.015


def test_k_is_a_parameter(spark):
    docs, labels = corpus(spark)
    verdicts = classifier.Resampler(docs, labels, k=30).verdicts()
    assert verdicts.filter("kept").count() == 30
    assert verdicts.filter("kept AND doc_id BETWEEN 80 AND 99").count() == 0
