"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one of target text (documents labelled good) and one of the raw
text (all documents). A document's log importance weight is the mean, over its n-grams and ``SHRINK`` neutral ones, of
the log ratio of the two: by the n-gram, so that long texts' sums don't drown the draw, and shrunk, so that few n-grams
say little. The documents to stay are sampled without replacement, with probabilities that follow the weights, by Gumbel
top-k: a Gumbel variate, hashed from the doc_id, is added to each log weight over ``TEMPERATURE``, and the k greatest
keys stay. Two documents alike in weight have like chances; one that lies d below another goes first with odds of
exp(d / ``TEMPERATURE``), which makes junk all but sure to go.

N-grams are single tokens and pairs, tokens being runs of letters, of digits or of other characters; a token equal to
the one before is written as a mark of repetition, so that stuttering text has a bucket of its own. k is a parameter; by
default it is the number of all documents whose weight isn't ``SPREAD`` deviations below the mean of good examples that
the model wasn't fitted on. Rows labelled bad play no part.

The good examples are bounded by ``SAMPLE`` label rows (least hashes first); counts of raw text, weights, k and the cut
take in all documents. What comes to the driver: ``BUCKETS`` counts, two moments, and histograms of ``BINS`` bins by
which the k-th greatest key is closed in on. Documents whose keys tie with it stay.

Cases: a null or empty text has no n-grams and log weight 0; without labelled good documents there is no target, all
weights are 0 and all documents stay; a doc_id labelled both ways isn't good; rows that share a doc_id share its variate;
an empty table gives an empty result; columns besides doc_id and text are kept by ``select_quality``, whatever their
names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.words import batches, mix64
from tessel.session import release, settle, table

BUCKETS, SAMPLE, TEMPERATURE = 1 << 15, 8000, 0.05
SHRINK, SPREAD = 20, 4.0
BINS = 4096
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x00-\x20]+")
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def grams(text: str | None) -> np.ndarray:
    """Buckets of a text's tokens and pairs of tokens."""
    tokens = _TOKEN.findall(text.encode()) if text else []
    one = mix64(np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens)))
    two = np.where(one[1:] == one[:-1], _REPEAT, mix64(one[:-1] * np.uint64(3) + one[1:]))
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for _, texts in batches(rows):
        for t in texts:
            np.add.at(total, grams(t), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over all documents, summed up in tasks first."""
    counts = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the models' probabilities; each bucket starts with one occurrence, shared out as in raw text."""
    if not target.sum():
        return np.zeros(len(target))
    base = (raw + 1) / (raw + 1).sum()
    p = (target + len(target) * base * 0.1) / (target.sum() + len(target) * 0.1)
    return np.log(p / base)


def _scorer(ratios: np.ndarray) -> Callable[[str | None], float]:
    def score(text: str | None) -> float:
        at = grams(text)
        return float(ratios[at].sum() / (len(at) + SHRINK))

    return score


def gumbel(ids: list) -> np.ndarray:
    """Gumbel variates hashed from ids."""
    h = mix64(np.fromiter((zlib.crc32(str(i).encode()) | (zlib.adler32(str(i).encode()) << 32) for i in ids), np.uint64, len(ids)))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53))


def greatest_cut(keys: DataFrame, k: int) -> float:
    """The k-th greatest of ``keys(key)``, by histograms of ever narrower ranges."""
    if k <= 0:
        return np.inf
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return -np.inf
    above = 0
    while high > low:
        step = (high - low) / BINS
        if low + step <= low:
            break
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / step).cast("int"))
        found = keys.filter(F.col("key").between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                if above + r["n"] == k:
                    return low
                break
            above += r["n"]
    return low


class Resampler:
    """Models and cut fitted on a corpus and its labels; ``k`` documents stay."""

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = SAMPLE):
        of = docs.schema["doc_id"].dataType.simpleString()
        by = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast(of).alias("doc_id")).agg(F.min("quality").alias("quality"))
        chosen = settle(by.filter("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "good-labels")  # rows of bounded number
        good = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "good-examples")
        fitted = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)) == 0
        self.ratios = log_ratios(gram_counts(good.filter(fitted)), gram_counts(docs))
        self.scored = settle(self._weigh(docs), "weights")
        self.k = self._count(self._weigh(good.filter(~fitted))) if k is None else k
        self.cut = float(greatest_cut(self.scored.select("key"), self.k))
        release(chosen, good)

    def _count(self, held_back: DataFrame) -> int:
        """Documents within ``SPREAD`` deviations of the good examples' mean, or above; all without such examples."""
        mean, dev = held_back.agg(F.avg("log_weight"), F.stddev_pop("log_weight")).first()
        return self.scored.count() if mean is None else self.scored.filter(F.col("log_weight") >= mean - SPREAD * dev).count()

    def _weigh(self, docs: DataFrame) -> DataFrame:
        of, score = docs.schema["doc_id"].dataType.simpleString(), _scorer(self.ratios)

        def weigh(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in batches(rows):
                w = np.fromiter(map(score, texts), float, len(texts))
                keys = w / TEMPERATURE + gumbel(batch.column("doc_id").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w), pa.array(keys)], ["doc_id", "log_weight", "key"])

        return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {of}, log_weight double, key double")

    def verdicts(self) -> DataFrame:
        """doc_id, log_weight, key, kept."""
        return self.scored.withColumn("kept", F.col("key") >= self.cut)

    def select(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that stay; weights are computed again rather than joined, which moves no texts."""
        score, cut = _scorer(self.ratios), self.cut

        def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in batches(rows):
                keys = np.fromiter(map(score, texts), float, len(texts)) / TEMPERATURE + gumbel(batch.column("doc_id").to_pylist())
                yield batch.filter(pa.array(keys >= cut))

        return docs.mapInArrow(keep, docs.schema)


def select_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return Resampler(docs, labels).select(docs)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: weights and verdicts of all ``documents``."""
    return Resampler(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).verdicts()
