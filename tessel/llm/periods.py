"""Periodic runs of words, found by recompression.

A run is a stretch of words of smallest period q, at least ``COPIES`` * q and ``LEAST`` words long, that no neighbour
extends. Texts of a batch are one sequence of word numbers with a separator of its own about each text. It is compressed
in rounds: blocks of equal symbols become one symbol, then pairs of a left and a right symbol do, sides being hash bits
drawn anew each round. Symbols that read alike get the same number, so the rounds are a run-length grammar of the batch,
some four times as long as the texts, without suffix arrays.

Where a symbol ends depends on its two neighbours only. So two places are extended together by climbing the grammar while
their symbols agree, with one step aside a round, and by descending from the first symbols that differ, with one step a
round: an extension takes time by the number of rounds, however long it is. All queries of a batch climb and descend at
once.

Candidates for period q are every (COPIES - 1) * q-th place: a run holds one whose word equals the one q later, as its
words equal those q later on a stretch of (COPIES - 1) * q at least. That is a harmonic number of places a text, n / 3 *
ln(n / 4). Each is extended both ways; what is long enough is a run. A stretch found for several periods has the least of
them, as the others are its multiples (by Fine and Wilf).

Texts are handled where they are read and nothing is shuffled; a task holds the grammar of about ``BATCH`` characters of
texts, or of one longer text, and candidates in slices of ``SLICE``.

Cases: null and empty texts, and those without words, have no runs and an empty collapsed text; rows without doc_id and
rows that share one are rows as all others; repeated rows get equal results; an empty table gives an empty result;
columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.words import mix64, slices, words_of
from tessel.session import table

COPIES, LEAST = 4, 6
BATCH, SLICE = 1 << 20, 1 << 18
_SIDE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Round:
    """A round's symbols; ``first`` holds the place of each one's first child in the round before, ``parent`` the reverse."""

    symbols: np.ndarray
    first: np.ndarray | None = None
    parent: np.ndarray | None = None
    block: bool = False


def _shrink(symbols: np.ndarray, starts: np.ndarray, other: np.ndarray, fresh: int, block: bool) -> tuple[Round, int]:
    """The next round: symbols begin at ``starts``; those of several children are numbered by (child, other)."""
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, len(symbols)))
    out = symbols[first].copy()
    many = np.flatnonzero(size > 1)
    key, number = np.unique(out[many].astype(np.int64) << 32 | other[first[many]] if not block else out[many].astype(np.int64) << 32 | size[many], return_inverse=True)
    out[many] = fresh + number
    parent = (np.cumsum(starts) - 1).astype(np.int32)
    return Round(out, np.append(first, len(symbols)).astype(np.int32), parent, block), fresh + len(key)


def recompress(words: np.ndarray, fixed: int) -> list[Round]:
    """Rounds of block and pair compression of ``words``; symbols under ``fixed`` occur once and stay as they are."""
    rounds, fresh, idle = [Round(words.astype(np.int32))], int(words.max(initial=0)) + 1, 0
    while idle < 16 and len(rounds[-1].symbols) > 2 * fixed:
        n = len(rounds[-1].symbols)
        for block in (True, False):
            s = rounds[-1].symbols
            if block:
                joined, other = s[1:] == s[:-1], s
                if not joined.any():
                    continue
            else:
                side = (mix64(s.astype(np.uint64) * _SIDE + np.uint64(len(rounds))) & np.uint64(1)).astype(bool)
                joined, other = (~side & (s >= fixed))[:-1] & (side & (s >= fixed))[1:], np.append(s[1:], 0)
            below, fresh = _shrink(s, np.append(True, ~joined), other, fresh, block)
            rounds.append(below)
        idle = idle + 1 if len(rounds[-1].symbols) == n else 0
    return rounds


def extend(rounds: list[Round], i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
    """How many words agree from places i and j on (``way`` 1) or back (-1), each pair in time by the number of rounds."""
    began, i, j = i, i.copy(), j.copy()
    depth, on = np.zeros(len(i), np.int32), np.arange(len(i))
    for k, level in enumerate(rounds):
        a, b, s = i[on], j[on], level.symbols
        if k + 1 < len(rounds):
            up = rounds[k + 1]
            agree = s[a] == s[b]
            on_, a, b = on[agree], a[agree], b[agree]
            p, q = up.parent[a], up.parent[b]
            if way > 0:
                aside, left = (up.first[p] != a) | (up.first[q] != b), np.minimum(up.first[p + 1] - a, up.first[q + 1] - b)
            else:
                aside, left = (up.first[p + 1] - 1 != a) | (up.first[q + 1] - 1 != b), np.minimum(a - up.first[p], b - up.first[q]) + 1
            step = np.where(aside, way * left, 0)
            a, b = a + step, b + step
            depth[on] = k
            agree = ~aside | (s[a] == s[b])
            i[on_], j[on_] = np.where(agree, up.parent[a], a), np.where(agree, up.parent[b], b)
            on = on_[agree]
        else:
            depth[on] = k
            while len(on):
                agree = s[a] == s[b]
                i[on], j[on] = a, b
                on, a, b = on[agree], a[agree] + way, b[agree] + way
    for k in range(len(rounds) - 1, 0, -1):
        on = np.flatnonzero(depth >= k)
        if len(on):
            level, s = rounds[k], rounds[k - 1].symbols
            a, b = i[on], j[on]
            size = np.minimum(level.first[a + 1] - level.first[a], level.first[b + 1] - level.first[b]) if level.block else 1
            a, b = (level.first[a], level.first[b]) if way > 0 else (level.first[a + 1] - 1, level.first[b + 1] - 1)
            step = way * np.where(s[a] == s[b], size, 0)
            i[on], j[on] = a + step, b + step
    return (i - began) * way


def candidates(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of a text of n words, in slices: every (COPIES - 1) * q-th place for each period q."""
    q = np.arange(1, n // COPIES + 1)
    count = -(-(n - q) // ((COPIES - 1) * q))
    cuts = np.unique(np.searchsorted(np.cumsum(count), np.arange(0, count.sum() + SLICE, SLICE)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        c = count[lo:hi]
        period = np.repeat(q[lo:hi], c)
        yield (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)) * (COPIES - 1) * period, period


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    at = np.cumsum([0, *(len(w) + 1 for w in texts)])  # a separator is before each text, and one after all
    codes: dict[bytes, int] = {}
    words = np.empty(at[-1] + 1, np.int32)
    words[at] = np.arange(len(at))
    for a, w in zip(at, texts, strict=False):
        words[a + 1 : a + 1 + len(w)] = [codes.setdefault(x, len(codes)) for x in w]
    inner = np.ones(len(words), bool)
    inner[at] = False
    words[inner] += len(at)
    rounds = recompress(words, len(at))
    kept, size = [np.empty((0, 3), np.int64)], 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> None:
        i, q = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        left = extend(rounds, i - 1, i + q - 1, -1)
        length = left + q + extend(rounds, i, i + q, 1)
        ok = length >= np.maximum(LEAST, COPIES * q)
        kept.append(np.unique(np.stack([i - left, length, q], 1)[ok], axis=0))

    for a, w in zip(at, texts, strict=False):
        for i, q in candidates(len(w)):
            i = i + a + 1
            hit = words[i] == words[i + q]
            if hit.any():
                held.append((i[hit], q[hit]))
                size += len(held[-1][0])
                if size >= SLICE:
                    flush()
                    size = 0
    if held:
        flush()
    found = np.unique(np.concatenate(kept), axis=0)  # by start, length, period
    found = found[np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(1))] if len(found) else found
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    of = np.searchsorted(at, found[:, 0]) - 1
    found[:, 0] -= at[of] + 1
    return np.split(found, np.searchsorted(of, np.arange(1, len(texts)))) if texts else []


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but for those that a run has after its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def _groups(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH characters."""
    for batch in slices(rows):
        sizes, lo = np.cumsum([len(t or "") for t in batch.column("text").to_pylist()]), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BATCH)))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _groups(rows):
        texts = [words_of(t) for t in batch.column("text").to_pylist()]
        found = runs_of(texts)
        flat = np.concatenate([np.empty((0, 3), np.int64), *found])
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)], ["start", "length", "period"]))
        out = pa.array([collapsed(w, r).decode() for w, r in zip(texts, found, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), runs, out], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text for each row of ``docs``."""
    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {of}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The query's texts: where crc32(doc_id) ends in 0, words from some place on repeat with some period; null ids don't."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        # as a lambda's argument each is computed once
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(F.transform(w, lambda v, i: F.when(i < x["a"], v).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))[0]

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(F.array(words), loop)[0]).otherwise(text)


def period_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: runs of all ``documents``, some of them looped, and digests of runs and collapsed texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Equal words q apart, in stretches; crc32 byte by byte, a byte's eight steps as -1.
SQL = r"""
WITH w0 AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h0 AS (SELECT *, len(w) AS n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM w0),
h1 AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h0),
h2 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM h1),
d AS (SELECT row, doc_id, n, CASE WHEN n > 0 AND h % 10 = 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM h2),
t AS (SELECT row, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
e AS (SELECT a.row, a.n, b.i - a.i AS q, a.i FROM t a JOIN t b ON a.row = b.row AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM e) GROUP BY row, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT row, start, length, min(q) AS period FROM s GROUP BY row, start, length),
g AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, first(r ORDER BY length DESC, start, period) AS best FROM r GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length) // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN g USING (row) LEFT JOIN kept USING (row)"""
