"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Examples are a bounded sample of labelled documents (``EXAMPLES`` rows, least hashes first); a third of them calibrates,
the others are the index. Terms are lower-case runs of letters, and all terms of the examples are indexed. A term's
weight is (1 + ln tf) * idf * (phi + ``FLOOR``), phi being the correlation of its presence with the label over the
examples: no term is left out, but topics, which say nothing about toxicity, don't decide who is near (with idf alone a
quarter of the toxic documents is found, see README). Vectors have length 1.

Examples are put in order of their weightiest term, so that alike ones share a block of ``BLOCK``. For each term and
block the index holds the greatest weight; with these every block has an upper bound for a query. The ``FIRST`` blocks
by falling bound are scored exactly, then, in two more rounds, those of the rest whose bound can still reach the ``K``-th
best cosine found: the K nearest examples are exact, which the tests hold against brute force, and postings in blocks
passed over are never read.

Votes weigh by similarity, with a pseudo-vote of the base rate that counts as ``PRIOR`` neighbours of similarity 1. The
vote's score is calibrated by a logistic curve fitted on the labelled rows that are no examples. The nearest examples'
ids are the evidence.

Index and vocabulary are of bounded size and go to the tasks with the function; documents aren't shuffled.

Cases: null and empty texts and such without a known term get the calibrated base rate; without labelled rows all score
0; a doc_id labelled both ways counts as toxic; of several texts under a labelled doc_id the one of least hash is the
example; equal similarities take the lesser doc_id first; repeated rows get equal results; an empty table gives an empty
result; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.words import batches
from tessel.session import settle, table

EXAMPLES, CALIBRATE = 3000, 3
K, BLOCK, FIRST, PRIOR, FLOOR = 15, 32, 4, 0.5, 0.01
_TERM = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


def ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, stop), one range after the other."""
    n = stops - starts
    if not n.sum():
        return np.empty(0, np.int64)
    return np.repeat(stops - np.cumsum(n), n) + np.arange(n.sum())


class Index:
    """Examples' vectors in blocks, each term's greatest weight in each block, and what votes need."""

    def __init__(self, ids: list, toxic: np.ndarray, row: np.ndarray, term: list[str], count: np.ndarray):
        """``ids`` in order, their labels, and (row, term, count) of what they hold."""
        n = len(ids)
        names, at = np.unique(np.array(term, dtype=object).astype(str), return_inverse=True) if len(term) else (np.empty(0, str), np.empty(0, np.int64))
        toxic = np.asarray(toxic, float)
        self.base = float(toxic.mean()) if n else 0.0
        self.curve: tuple[float, float] | None = None
        df, pos = np.bincount(at, minlength=len(names)), np.bincount(at, toxic[row], len(names))
        spread = np.sqrt(np.maximum(df * (n - df), 1) * max(self.base * (1 - self.base), 1e-12)) * n**0.5
        phi = np.maximum(0.0, np.abs(pos - df * self.base) - 0.5) * n**0.5 / spread if n else np.empty(0)
        self.weight = (np.log((1 + n) / (1 + df)) + 1) * (phi + FLOOR)
        self.code = {t: i for i, t in enumerate(names.tolist())}
        value = (1 + np.log(count)) * self.weight[at]
        value = value / np.sqrt(np.bincount(row, value * value, n))[row]

        # examples in order of their weightiest term
        best = np.full(n, -1)
        by = np.lexsort((-value, row))
        best[row[by][np.flatnonzero(np.diff(row[by], prepend=-1))]] = at[by][np.flatnonzero(np.diff(row[by], prepend=-1))] if len(by) else 0
        order = np.lexsort((np.arange(n), best))
        place = np.argsort(order)
        self.number, self.ids, self.toxic = order, [ids[i] for i in order], toxic[order]
        self.blocks = -(-n // BLOCK)
        # postings by term and example; those of a term in a block are an entry, of which the greatest weight is held
        by = np.lexsort((place[row], at))
        self.place, self.value = place[row][by].astype(np.int32), value[by]
        key = at[by] * max(1, self.blocks) + self.place // BLOCK
        self.start = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        self.top = np.maximum.reduceat(self.value, self.start[:-1]) if len(key) else np.empty(0)
        self.block = (key[self.start[:-1]] % max(1, self.blocks)).astype(np.int32)
        self.entry = np.searchsorted(key[self.start[:-1]], np.arange(len(names) + 1) * max(1, self.blocks))
        self.read = 0  # blocks scored

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms that examples have, and their weights in a vector of length 1."""
        known = sorted((self.code[t], k) for t, k in counts.items() if t in self.code)
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        at = np.array([c for c, _ in known])
        v = (1 + np.log([k for _, k in known])) * self.weight[at]
        return at, v / np.sqrt(v @ v)

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k examples (their places) of greatest cosine above 0 and their cosines; ties by doc_id."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0)
        entries, n = ranges(self.entry[at], self.entry[at + 1]), self.entry[at + 1] - self.entry[at]
        block, weight = self.block[entries], np.repeat(v, n)
        bound = np.bincount(block, self.top[entries] * weight, self.blocks)
        order = np.argsort(-bound, kind="stable")
        scores, done = np.zeros(len(self.ids)), 0
        for width in (FIRST, 4 * FIRST, len(order)):
            # what isn't within the bounds' order yet is scored, as far as it can reach the k-th best
            kth = float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0.0
            take = order[done : done + width]
            take = take[bound[take] > max(kth - 1e-12, 0.0)]
            if not len(take):
                break
            mask = np.zeros(self.blocks, bool)
            mask[take] = True
            chosen = mask[block]
            lo, hi = self.start[entries[chosen]], self.start[entries[chosen] + 1]
            p = ranges(lo, hi)
            scores += np.bincount(self.place[p], self.value[p] * np.repeat(weight[chosen], hi - lo), len(scores))
            self.read += len(take)
            done += width
        found = np.flatnonzero(scores)
        best = found[np.lexsort((self.number[found], -np.round(scores[found], 12)))[:k]]
        return best, scores[best]

    def vote(self, counts: dict[str, int]) -> tuple[float, list]:
        """The vote's score, not calibrated, and the evidence."""
        at, near = self.nearest(*self.vector(counts))
        return float((near @ self.toxic[at] + PRIOR * self.base) / (near.sum() + PRIOR)), [self.ids[i] for i in at[:3]]

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Fit score = 1 / (1 + exp(-(a + b * logit(vote)))) by Newton's steps, with a weak pull towards the vote itself."""
        if len(set(toxic.tolist())) < 2:
            return
        x = np.stack([np.ones(len(votes)), logit(votes)], 1)
        c, pull = np.array([0.0, 1.0]), np.eye(2)
        for _ in range(200):
            p = sigmoid(x @ c)
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (toxic - p) - pull @ (c - [0.0, 1.0]))
            step /= max(1.0, 2 * np.abs(step).max())  # short steps don't overshoot where the classes part cleanly
            c = c + step
            if np.abs(step).max() < 1e-10:
                break
        self.curve = float(c[0]), float(max(c[1], 0.0))

    def score(self, vote: float) -> float:
        return vote if self.curve is None else float(sigmoid(self.curve[0] + self.curve[1] * logit(vote)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """An index of the labelled rows of ``labels(doc_id, toxic)`` that ``docs`` has, calibrated, from up to ``examples`` of them."""
    of = docs.schema["doc_id"].dataType.simpleString()
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast(of).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = settle(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "chosen-labels")  # rows of bounded number
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.withColumn("part", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(CALIBRATE)) == 0))
    counted = settle(rows.mapInArrow(_term_counts, f"doc_id {of}, toxic int, part boolean, terms array<string>, counts array<int>"), "examples")
    found = counted.filter("not part").orderBy("doc_id").toArrow()
    terms, counts = (found.column(c).combine_chunks() for c in ("terms", "counts"))
    row = np.repeat(np.arange(found.num_rows), np.diff(terms.offsets.to_numpy())) if found.num_rows else np.empty(0, np.int64)
    index = Index(found.column("doc_id").to_pylist(), np.array(found.column("toxic").to_pylist()), row, terms.values.to_pylist() if found.num_rows else [], counts.values.to_numpy() if found.num_rows else np.empty(0))
    rest = counted.filter("part").mapInArrow(_votes(index), "vote double, toxic int").toArrow()
    index.calibrate(rest.column("vote").to_numpy(), rest.column("toxic").to_numpy())
    return index


def _term_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(rows):
        counted = [Counter(terms_of(t)) for t in texts]
        lists = [pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "part")), *lists], ["doc_id", "toxic", "part", "terms", "counts"])


def _votes(index: Index):
    def votes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [index.vote(dict(zip(t, c, strict=True)))[0] for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("toxic")], ["vote", "toxic"])

    return votes


def score_toxicity(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, evidence (ids of the nearest examples) for each row of ``docs``."""
    of = docs.schema["doc_id"].dataType.simpleString()

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[float, list]] = {}
        for batch, texts in batches(rows):
            out = []
            for t in texts:
                if t not in held:
                    if len(held) >= 256:
                        held.clear()
                    vote, evidence = index.vote(Counter(terms_of(t)))
                    held[t] = index.score(vote), evidence
                out.append(held[t])
            evidence = pa.array([e for _, e in out], pa.list_(batch.column("doc_id").type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {of}, score double, evidence array<{of}>")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: scores of all ``documents``, learnt from labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    index = fit(docs, labels.filter(fold != 0))
    return score_toxicity(docs, index).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
