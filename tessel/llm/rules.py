"""Quality rules by weak supervision.

Rules look at a document and vote good (1) or bad (0) or abstain (-1). Their accuracies aren't known beforehand: the
counts of all patterns of votes over all documents go to expectation maximisation of a two-class model in which rules
err independently given the class. A document's quality is its pattern's posterior probability of being good, which
takes the place of asking that all rules pass. What reaches the driver is a count for each pattern that occurs, at most
3^10 whatever the number of documents; the posteriors go back as a broadcast table of that size.

Cases: a null or empty text has no words, so all counts are 0, ``base_failed`` holds and no rule votes but the one on
length; repeated rows count once each and get equal results; an empty table gives an empty result; columns besides
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.words import batches, word_hashes
from tessel.session import settle, table

SYMBOLS = b"#*$%&|<>"
_RUNS = re.compile(rb"[#*$%&|<>]+")
_CAPITALS = bytes(range(65, 91))
#: ASCII characters that aren't letters; all others count as letters.
_OTHER = bytes(x for x in range(128) if not chr(x).isalpha())
WINDOW = 5
#: Posterior from which a document is kept.
KEEP_FROM = 0.5
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_distinct long, n_lines long, n_symbol_runs long, n_letters long, n_stutters long"


def repeat_words(hashes: np.ndarray, n: int = WINDOW) -> int:
    """Words that lie in a window of ``n`` words found twice or more in the text."""
    m = len(hashes) - n + 1
    if m < 2:
        return 0
    keys = hashes[:m].copy()
    for i in range(1, n):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text."""
    if not text:
        return (0,) * 11
    raw = text.encode()
    words = raw.split()
    glued = b"".join(words)
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    hashes = word_hashes(words)
    return (
        len(words), len(glued.decode()), len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat_words(hashes),
        len(glued) - len(glued.translate(None, _CAPITALS)), len(np.unique(hashes)), lines, len(_RUNS.findall(raw)),
        len(glued.translate(None, _OTHER).decode()), int((hashes[1:] == hashes[:-1]).sum()),
    )


def measure_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for batch, texts in batches(rows):
        columns = zip(*map(measure, texts), strict=True) if texts else [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(value: Column, good_below: float, bad_from: float) -> Column:
    """Good below one bound, bad from the other on, no vote between."""
    return F.when(value < good_below, 1).when(value >= bad_from, 0).otherwise(-1)


def rules() -> dict[str, Column]:
    """The rules' votes from the measures; but for ``length`` they abstain on documents without words."""
    length = F.when(F.col("n_words") >= 10, F.when(F.col("n_words") >= 50, 1).otherwise(-1)).otherwise(0)
    some = F.col("n_words") > 0
    return {"length": length} | {
        k: F.when(some, v).otherwise(-1)
        for k, v in {
            "symbols": _vote(_per("n_symbols", "n_words"), 0.02, 0.1),
            "repeats": _vote(_per("n_repeat_words", "n_words"), 0.1, 0.2),
            "lines": _vote(_per("n_dup_lines", "n_lines"), 0.1, 0.3),
            "capitals": _vote(_per("n_upper", "word_chars"), 0.15, 0.4),
            "word_length": F.when(_per("word_chars", "n_words").between(2.5, 9), 1).when(_per("word_chars", "n_words").between(2, 14), -1).otherwise(0),
            "variety": F.when(F.col("n_words") < 30, -1).otherwise(_vote(-_per("n_distinct", "n_words"), -0.3, -0.15)),
            "symbol_words": _vote(_per("n_symbol_runs", "n_words"), 0.02, 0.1),
            "letters": _vote(-_per("n_letters", "word_chars"), -0.9, -0.7),
            "stutters": _vote(_per("n_stutters", "n_words"), 0.1, 0.3),
        }.items()
    }


def fit_accuracies(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over patterns of votes: the share of good, and for each rule P(vote good | good, voted), P(vote bad | bad, voted).

    Starts from mostly good documents, few of which get a bad vote, and rules that catch half of the bad ones; a weak
    Beta prior about that start keeps rules that hardly vote where they are.
    """
    good, bad, n = (votes == 1).astype(float), (votes == 0).astype(float), counts.astype(float)
    share, right_g, right_b = 0.8, np.full(votes.shape[1], 0.95), np.full(votes.shape[1], 0.5)
    for _ in range(rounds):
        p = posterior(votes, share, right_g, right_b)
        wg, wb = n * p, n * (1 - p)
        old = share
        share = (wg.sum() + 8) / (n.sum() + 10)
        right_g = np.clip((wg @ good + 9.5) / (wg @ (good + bad) + 10), 0.5, 0.999)
        right_b = np.clip((wb @ bad + 5) / (wb @ (good + bad) + 10), 0.05, 0.999)
        if abs(share - old) < 1e-10:
            break
    return share, right_g, right_b


def posterior(votes: np.ndarray, share: float, right_g: np.ndarray, right_b: np.ndarray) -> np.ndarray:
    good, bad = votes == 1, votes == 0
    odds = np.log(share / (1 - share)) + good @ np.log(right_g / (1 - right_b)) + bad @ np.log((1 - right_g) / right_b)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge_quality(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the measures, base_failed, posterior, kept for each row of ``docs``."""
    spark, names = docs.sparkSession, list(rules())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", "text").mapInArrow(measure_batches, f"doc_id {id_type}, {MEASURES}")
    voted = settle(measured.select("*", *[v.cast("int").alias(f"v_{k}") for k, v in rules().items()]), "rules")
    keys = [f"v_{k}" for k in names]
    patterns = voted.groupBy(*keys).count().collect()
    votes = np.array([[r[k] for k in keys] for r in patterns], int).reshape(-1, len(keys))
    share, right_g, right_b = fit_accuracies(votes, np.array([r["count"] for r in patterns]))
    p = posterior(votes, share, right_g, right_b)
    posteriors = spark.createDataFrame(
        [(*map(int, v), round(float(x), 9)) for v, x in zip(votes, p, strict=True)], ", ".join(f"{k} int" for k in keys) + ", posterior double"
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.join(F.broadcast(posteriors), keys).select(
        "doc_id", *[x.split()[0] for x in MEASURES.split(", ")[:5]], failed.alias("base_failed"), "posterior",
        (~failed & (F.col("posterior") >= keep_from)).alias("kept"),
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: verdicts on all ``documents``."""
    return judge_quality(table(spark, sf_dir, "documents"))
