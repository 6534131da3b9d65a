"""Benchmark decontamination by FM-indexes of the training texts.

Texts are dealt, where they are read, to shards of about ``SHARD`` words; a longer text is cut into pieces that overlap
by ``LONGEST`` - 1 words. A shard is one sequence of word numbers with a separator after each piece. Its suffixes are sorted by
prefix doubling, only those still equal in each round; separators count as different, so no suffix is compared beyond its
piece. The shard's row holds its words, the transform of Burrows and Wheeler as a wavelet matrix (one plane of bits for
each bit of a word number), and the places of suffixes that begin at each ``SAMPLE``-th word of a piece. Shards are
written as Parquet: an index is built once and searched for any phrases of up to ``LONGEST`` words.

Phrases are searched backwards, all of a block at once: a step narrows each phrase's range of suffixes by two ranks per
plane, and phrases without a suffix left are out. Occurrences are located by stepping back to a sampled place. Hits within a piece
become merged spans, a document's spans are merged over its pieces and over blocks of phrases, and removal takes
their words out.

Phrases go to tasks in blocks of about ``PHRASES`` pairs of a phrase and an item, each a pass over the index; what moves is one row per piece with
hits.

Cases: null texts and texts without words have no hits; null, empty and wordless items give no phrase; an item of fewer
words than a window is one phrase; rows of one item_id count as one item, rows without item_id hit words but count as no
item; rows of ``docs`` are told apart whatever their doc_id, so null and repeated ids and repeated rows stay rows; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.words import slices
from tessel.session import scratch, settle, table

WINDOW, LONGEST = 10, 32
SHARD, SAMPLE, PHRASES = 1 << 18, 16, 1 << 17
#: Bytes of words, A-Z as a-z; all others part words. Those of characters beyond ASCII are of words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of suffixes in order; zeros are separators, each less than the next one and all words, and the last symbol is one."""
    n, stops = len(text), np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(stops)
    rank[stops] = np.arange(len(stops))
    bits = int(rank.max()).bit_length() or 1
    h = 63 // bits
    padded = np.append(rank, np.zeros(h, np.int64))
    key = padded[:n].copy()
    for i in range(1, h):
        key = key << bits | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    group = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    rank = np.empty(n, np.int64)  # the place of the first suffix that agrees in h symbols
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    while True:
        ranks = rank[order]
        tied = ranks[:-1] == ranks[1:]
        open_ = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
        if not len(open_):
            return order
        of = order[open_]
        key = ranks[open_] * n + rank[of + h]  # a tie has no separator in its first h symbols, so there are h more
        at = np.argsort(key, kind="stable")
        of, key = of[at], key[at]
        order[open_] = of
        new = np.append(True, np.diff(key) != 0)
        rank[of] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        h *= 2


@dataclass
class Plane:
    """Bits with counts of ones before each 64."""

    bits: np.ndarray
    ones: np.ndarray
    zeros: int

    @staticmethod
    def of(packed: bytes, n: int) -> Plane:
        bits = np.frombuffer(packed, np.uint64)
        ones = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64))
        return Plane(bits, ones, n - int(ones[-1]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before places i."""
        at = i >> 6
        return self.ones[at] + np.bitwise_count(self.bits[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.bits[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _pack(bits: np.ndarray) -> bytes:
    """Bits, the lowest first, in 64-bit words with a whole one to spare."""
    packed = np.packbits(bits, bitorder="little").tobytes()
    return packed + bytes(16 - len(packed) % 8)


def wavelet(symbols: np.ndarray, depth: int) -> list[bytes]:
    """Planes of bits, the highest first, each in the order of the planes above it."""
    out = []
    for k in range(depth - 1, -1, -1):
        bit = (symbols >> k & 1).astype(bool)
        out.append(_pack(bit))
        symbols = np.concatenate([symbols[~bit], symbols[bit]])
    return out


def build(pieces: list[list[bytes]]) -> dict:
    """The index of a shard as plain columns."""
    codes: dict[bytes, int] = {}
    starts = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    text = np.zeros(starts[-1], np.int32)
    for a, p in zip(starts, pieces, strict=False):
        text[a : a + len(p)] = [codes.setdefault(w, len(codes) + 1) for w in p]
    order = suffix_array(text)
    piece = np.searchsorted(starts, order, "right") - 1
    sampled = (order - starts[piece]) % SAMPLE == 0
    return {"vocabulary": list(codes), "starts": starts, "planes": wavelet(text[order - 1], len(codes).bit_length()), "marks": _pack(sampled), "places": order[sampled].astype(np.int32)}


class FMIndex:
    """A shard's index to search."""

    def __init__(self, vocabulary: list[bytes], starts: np.ndarray, planes: list[bytes], marks: bytes, places: np.ndarray):
        self.n, self.starts, self.places = int(starts[-1]), starts, places
        self.code = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.planes, self.marks = [Plane.of(p, self.n) for p in planes], Plane.of(marks, self.n)
        self.steps = 0  # ranges narrowed
        # where each symbol begins among the sorted suffixes and below the planes
        symbols = np.arange(len(vocabulary) + 1)
        self.below = self._down(symbols, np.zeros(len(symbols), np.int64))
        count = self._down(symbols, np.full(len(symbols), self.n)) - self.below
        self.begin = np.cumsum(count) - count

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Places i in the transform to those below the planes, as of ``symbol``."""
        for k, plane in enumerate(self.planes):
            ones = plane.rank(i)
            i = np.where(symbol >> (len(self.planes) - 1 - k) & 1, plane.zeros + ones, i - ones)
        return i

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the sorted suffixes that begin with each phrase; rows of ``phrases`` hold word numbers, 0 unknown."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        left = lengths.astype(np.int64)
        hi[(phrases == 0).sum(1) > phrases.shape[1] - left] = 0
        while True:
            on = np.flatnonzero((lo < hi) & (left > 0))
            if not len(on):
                return lo, hi
            self.steps += len(on)
            left[on] -= 1
            c = phrases[on, left[on]]
            ends = self._down(np.concatenate([c, c]), np.concatenate([lo[on], hi[on]])) + np.tile(self.begin[c] - self.below[c], 2)
            lo[on], hi[on] = ends[: len(on)], ends[len(on) :]

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Places in the text of sorted suffixes i."""
        i, out, steps, on = i.copy(), np.empty(len(i), np.int64), 0, np.arange(len(i))
        while len(on):
            at = i[on]
            known = self.marks.get(at)
            out[on[known]] = self.places[self.marks.rank(at[known])] + steps
            on, at = on[~known], at[~known]
            symbol, j = np.zeros(len(at), np.int64), at
            for plane in self.planes:
                bit, ones = plane.get(j), plane.rank(j)
                symbol = symbol << 1 | bit
                j = np.where(bit, plane.zeros + ones, j - ones)
            i[on] = self.begin[symbol] + j - self.below[symbol]
            steps += 1
        return out


_SHARD = "shard struct<vocabulary:array<binary>,starts:array<bigint>,planes:array<binary>,marks:binary,places:array<int>>"


def _index(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: list[list[bytes]] = []
    about: list[tuple] = []  # (row, doc_id, offset in the row, words of the row)
    size, made, serial, kind = 0, uuid.uuid4().hex, 0, None

    def flush() -> pa.RecordBatch:
        of = pa.array([dict(zip(("row", "doc_id", "offset", "n_words"), x, strict=True)) for x in about], kind)
        shard = pa.array([build(pieces)], pa.struct([("vocabulary", pa.list_(pa.binary())), ("starts", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("marks", pa.binary()), ("places", pa.list_(pa.int32()))]))
        pieces.clear()
        about.clear()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of), shard], ["pieces", "shard"])

    for batch in slices(rows):
        kind = pa.struct([("row", pa.string()), ("doc_id", batch.schema.field("doc_id").type), ("offset", pa.int64()), ("n_words", pa.int64())])
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words, serial = words_of(text), serial + 1
            for lo in range(0, max(1, len(words) - LONGEST + 1), SHARD):
                piece = words[lo : lo + SHARD + LONGEST - 1]
                if size and size + len(piece) > SHARD:
                    yield flush()
                    size = 0
                pieces.append(piece)
                about.append((f"{made}-{serial}", doc_id, lo, len(words)))
                size += len(piece) + 1
    if about:
        yield flush()


def index_of(docs: DataFrame) -> DataFrame:
    """Shards of ``docs(doc_id, text)`` as rows (pieces, shard), settled: an index to keep and to search again."""
    of = docs.schema["doc_id"].dataType.simpleString()
    return settle(docs.select("doc_id", "text").mapInArrow(_index, f"pieces array<struct<row:string,doc_id:{of},offset:long,n_words:long>>, {_SHARD}"), "fm-index")


def _windows(window: int):
    def windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            at, phrases = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                found = {b" ".join(words[j : j + window]) for j in range(max(1, len(words) - window + 1))} if words else ()
                phrases += found
                at += [i] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at, pa.int64())), pa.array(phrases, pa.binary())], ["item_id", "phrase"])

    return windows


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, item_ids): windows of the items' words, each once, settled."""
    if window > LONGEST:
        raise ValueError(f"an index finds phrases of up to {LONGEST} words")
    of = items.schema["item_id"].dataType.simpleString()
    each = items.select("item_id", "text").mapInArrow(_windows(window), f"item_id {of}, phrase binary")
    return settle(each.groupBy("phrase").agg(F.collect_set("item_id").alias("item_ids")), "phrases")


def _search(phrases: list[bytes], owners: pa.Array):
    """Spans of ``phrases`` in shards; ``owners`` holds the item ids of each."""
    split = [p.split(b" ") for p in phrases]
    lengths = np.array(list(map(len, split)), np.int64)
    words: dict[bytes, int] = {}
    table_ = np.full((len(split), int(lengths.max(initial=0))), -1, np.int64)
    for i, p in enumerate(split):
        table_[i, : len(p)] = [words.setdefault(w, len(words)) for w in p]

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, 1):
            s, about = batch.column("shard"), batch.column("pieces")
            take = lambda name: s.field(name)[0].values
            index = FMIndex(take("vocabulary").to_pylist(), take("starts").to_numpy(), take("planes").to_pylist(), s.field("marks")[0].as_py(), take("places").to_numpy())
            # numbers of the phrases' words in this shard, 0 if it has none or the phrase has ended
            code = np.array([*(index.code.get(w, 0) for w in words), 0], np.int64)
            lo, hi = index.ranges(code[table_], lengths)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            place = index.locate(np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum()))
            order = np.argsort(place, kind="stable")
            which, place = which[order], place[order]
            piece = np.searchsorted(index.starts, place, "right") - 1
            out, spans, ids, of = [], [], [], about[0].values
            offset = of.field("offset").to_numpy()
            for a in np.flatnonzero(np.diff(piece, prepend=-1)):
                k = piece[a]
                b = int(np.searchsorted(piece, k, "right"))
                begin = place[a:b] - index.starts[k] + offset[k]
                out.append(k)
                spans.append(merged(begin, begin + lengths[which[a:b]]))
                ids.append(pa.concat_arrays([owners[i].values for i in np.unique(which[a:b]).tolist()]).unique())
            if out:
                bounds = [pa.array(np.concatenate([x[:, c] for x in spans]), pa.int64()) for c in (0, 1)]
                cut = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
                items = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.concat_arrays(ids))
                yield pa.RecordBatch.from_arrays([of.field("row").take(pa.array(out)), pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(bounds, ["start", "end"])), items], ["row", "spans", "items"])

    return search


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans, by start, that overlap or touch as one; rows (start, end)."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    return np.stack([begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)]], 1)


def _merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        spans = []
        for x in batch.column("spans").to_pylist():
            flat = np.array([(s["start"], s["end"]) for part in x or () for s in part], np.int64).reshape(-1, 2)
            spans.append([{"start": int(a), "end": int(b)} for a, b in merged(flat[:, 0], flat[:, 1])] if len(flat) else [])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(spans, kind) if c == "spans" else batch.column(c) for c in batch.schema.names], batch.schema.names)


def find(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (start, end; words, end exclusive, merged) and item_ids for each row that ``index`` was built of."""
    doc, of = index.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    phrases = phrases_of(items, window)
    blocks = max(1, -(-(phrases.agg(F.sum(F.greatest(F.lit(1), F.size("item_ids")))).first()[0] or 0) // PHRASES))
    part = index.select(F.explode("pieces").alias("p")).filter("p.offset = 0").select("p.row", "p.doc_id", "p.n_words", F.expr("cast(null as array<struct<start:long,end:long>>)").alias("spans"), F.expr(f"cast(null as array<{of}>)").alias("items"))
    for b in range(blocks):
        asked = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).toArrow()  # a block of phrases
        if asked.num_rows:
            search = _search(asked.column("phrase").to_pylist(), asked.column("item_ids").combine_chunks())
            hits = index.mapInArrow(search, f"row string, spans array<struct<start:long,end:long>>, items array<{of}>")
            part = part.unionByName(hits.selectExpr("row", f"cast(null as {doc}) as doc_id", "cast(null as long) as n_words", "spans", "items"))
    rows = part.groupBy("row").agg(F.max_by("doc_id", "n_words").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("item_ids"))
    return rows.select("doc_id", "n_words", "spans", "item_ids").mapInArrow(_merge, f"doc_id {doc}, n_words long, spans array<struct<start:long,end:long>>, item_ids array<{of}>")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: hits of ``benchmark`` windows in all ``documents``."""
    with scratch(spark) as keep:
        found = find(index_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
        keep.append(settle(found, "contaminated"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return keep[0].select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"coalesce(regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format(c='text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS phrase, least(len(w), {WINDOW}) AS n FROM (SELECT *, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS i FROM b WHERE len(w) > 0)),
t AS (SELECT row, w, unnest(range(len(w))) AS i FROM d),
f AS (SELECT DISTINCT n FROM p),
h AS (SELECT row, i, n, item_id FROM (SELECT row, i, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase FROM t, f WHERE i + n <= len(w)) JOIN p USING (phrase, n)),
x AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS j FROM h) GROUP BY row),
y AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (row) LEFT JOIN y USING (row)"""
