"""SentencePiece encoding and decoding, giant documents by a parallel max-plus scan.

The vocabulary file is a BPE model with byte fallback. A sequence of pieces is the encoding of its text just if each
two neighbours are: if merging the joined text of both ends in these two again. So the encoding is the one path through
the lattice of pieces whose steps all weigh 0, where a step between neighbours that don't last weighs -inf, and it can
be found by max-plus algebra: a giant document is split into chunks; a boundary's states are the pieces that may cover
the character before it; a chunk's transfer matrix holds for each state at its start and end the greatest weight of a
path between them. Matrices are multiplied (max of sums, associative) in groups of ``FAN``, and the products again,
until one per document is left; the states so fixed go down again, and each chunk is traced back by itself.

No piece of the vocabulary continues over the start of a run of spaces, so between the first and the last such start in
a chunk all paths meet, and that part is encoded by the library as a whole; documents of up to ``CHUNK`` characters are
a chunk of their own. Only chunks without any space walk their lattice throughout.

Decoding gives back the text, but for U+2581 (the vocabulary's mark of a space), which decodes to a space.

Cases: a null text has null token ids, an empty one none; repeated rows are encoded once and returned as often; an
empty table gives an empty result; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessel.llm.words import batches, slices
from tessel.session import settle, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, FAN = 16384, 64
#: No piece has more characters.
MARGIN = 16
#: Pairs of neighbours that a task remembers.
LASTING = 50_000
SPACE = "▁"


class Pieces:
    """The vocabulary for walking lattices: piece scores and which neighbours last."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        normal = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in normal}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in normal}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        assert self.longest <= MARGIN
        self.lasting: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scoring neighbours merge first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def lasts(self, a: str, b: str) -> bool:
        if (a, b) not in self.lasting:
            if len(self.lasting) > LASTING:
                self.lasting.clear()
            self.lasting[a, b] = self.merged(a + b) == [a, b]
        return self.lasting[a, b]

    def states(self, s: str, cut: int, end: int) -> list[tuple[int, int]]:
        """Places (start, stop) of pieces that may cover the character before ``cut``; the text's ends are cuts without choice."""
        if cut == 0:
            return [(0, 0)]
        lo = max(0, cut - self.longest)
        found = [(a, e) for a in range(lo, cut) for e in range(cut, min(end, a + self.longest) + 1) if e - a == 1 or s[a:e] in self.scores]
        return [(a, e) for a, e in found if end != cut or e == end]

    def walk(self, s: str, starts: list[tuple[int, int]], stop: int, end: int) -> dict[tuple[int, int], int]:
        """Pieces reachable from ``starts`` that begin before ``stop``: to the set of starts they are reached from, as bits."""
        reached: dict[tuple[int, int], int] = {}
        by_end: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(starts):
            reached[x] = reached.get(x, 0) | 1 << i
            by_end.setdefault(x[1], []).append(x)
        for a in range(min(by_end, default=stop), stop):
            for x in by_end.get(a, ()):
                left = s[x[0] : x[1]]
                for e in range(a + 1, min(end, a + self.longest) + 1):
                    right = s[a:e]
                    if (e - a == 1 or right in self.scores) and (not left or self.lasts(left, right)):
                        y = (a, e)
                        if y not in reached:
                            by_end.setdefault(e, []).append(y)
                        reached[y] = reached.get(y, 0) | reached[x]
        return reached

    def transfer(self, s: str, lo: int, hi: int, end: int) -> np.ndarray:
        """The chunk's matrix: weights of the best paths from states at ``lo`` to states at ``hi``."""
        ins, outs = self.states(s, lo, end), self.states(s, hi, end)
        meet = meeting(s, lo + self.longest, hi - self.longest)
        if meet:
            first, last = meet[0], meet[-1]
            to = self.walk(s, ins, first, first)
            bits = 0
            for (_, e), b in to.items():
                bits |= b if e == first else 0
            right = self.walk(s, [(last, last)], hi, end)
            reach = {y: bits for y in right}
        else:
            reach = self.walk(s, ins, hi, end)
        return np.array([[0.0 if reach.get(y, 0) >> i & 1 else -np.inf for y in outs] for i in range(len(ins))])

    def trace(self, s: str, lo: int, hi: int, end: int, entry: int, leave: int) -> list[int]:
        """Token ids of the pieces after the state ``entry`` at ``lo``, up to and with the state ``leave`` at ``hi``."""
        start, goal = self.states(s, lo, end)[entry], self.states(s, hi, end)[leave]
        meet = meeting(s, lo + self.longest, hi - self.longest)
        if not meet:
            return self.path(s, start, goal, end)
        first, last = meet[0], meet[-1]
        head = self.path(s, start, (first, first), first)
        body = self.model.encode(s[first + 1 : last].replace(SPACE, " ")) if last > first else []
        return head + body + self.path(s, (last, last), goal, end)

    def path(self, s: str, start: tuple[int, int], goal: tuple[int, int], end: int) -> list[int]:
        if start == goal or goal[0] == goal[1] and start[1] == goal[1]:
            return []
        reached = self.walk(s, [start], goal[0] + (goal[1] > goal[0]), end)
        by_end: dict[int, list[tuple[int, int]]] = {}
        for x in reached:
            by_end.setdefault(x[1], []).append(x)
        parts, at = [], goal
        while at != start:
            text = s[at[0] : at[1]]
            if text:
                parts.append(text)
            at = next(x for x in by_end[at[0]] if x == start or x[0] < x[1] and (not text or self.lasts(s[x[0] : x[1]], text)))
            if at != start and at[0] < start[1]:
                raise ValueError("no path")
        return [t for p in reversed(parts) for t in self.tokens(p)]

    def tokens(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]


def meeting(s: str, lo: int, hi: int) -> list[int]:
    """The first and the last start of a run of spaces in s[lo:hi], where every path has a boundary; none if there is none."""
    first = lo
    while (first := s.find(SPACE, first, hi)) > 0 and s[first - 1] == SPACE:
        first += 1
    if first < 0:
        return []
    last = s.rfind(SPACE, first, hi)
    while s[last - 1] == SPACE:
        last = s.rfind(SPACE, first, last)
    return [first, last] if last > first else [first]


def normalized(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def _matrix(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, float)


KEY, MATRIX = "doc_id {of}, t binary", "array<array<double>>"
_WINDOW = "no long, n long, s string, lo int, hi int, stop int"


def _split(size: int):
    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with a margin of text on both sides; lo, hi and stop (the text's end) count from the slice's start."""
        for batch, texts in batches(rows):
            for i, t in enumerate(texts):
                s = normalized(t)
                n = max(1, -(-len(s) // size))
                for first in range(0, n, 256):
                    cells = []
                    for no in range(first, min(n, first + 256)):
                        lo, hi = no * size, min(len(s), (no + 1) * size)
                        at, to = max(0, lo - 2 * MARGIN), min(len(s), hi + 2 * MARGIN)
                        cells.append((no, n, s[at:to], lo - at, hi - at, to - at))
                    idx = pa.array([i] * len(cells))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                    columns = [pa.array(c, k) for c, k in zip(zip(*cells, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(idx), batch.column("t").take(idx), batch.column("copies").take(idx), *columns], ["doc_id", "t", "copies", "no", "n", "s", "lo", "hi", "stop"])

    return split


def _fold(rows: list[dict]) -> np.ndarray:
    out = None
    for r in rows:
        m = _matrix(r["m"])
        out = m if out is None else multiply(out, m)
    return out


def _products(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [_fold(x).tolist() for x in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "t", "no")] + [pa.array(found, pa.list_(pa.list_(pa.float64())))], ["doc_id", "t", "no", "m"])


def _states(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at each part's start and end, from those at the group's: forward reach, then back from the end."""
    for batch in rows:
        at, nos, entries, leaves = [], [], [], []
        for i, (parts, entry, leave) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("parts", "entry", "leave")), strict=True)):
            mats = [_matrix(p["m"]) for p in parts]
            reach = [np.where(np.arange(mats[0].shape[0]) == entry, 0.0, -np.inf)]
            for m in mats:
                reach.append((reach[-1][:, None] + m).max(0))
            state = leave if leave is not None else int(np.argmax(reach[-1]))
            for p, m, before in reversed(list(zip(parts, mats, reach, strict=False))):
                previous = int(np.argmax(before + m[:, state]))
                at.append(i)
                nos.append(p["no"])
                entries.append(previous)
                leaves.append(state)
                state = previous
        idx = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(idx), batch.column("t").take(idx), pa.array(nos, pa.int64()), pa.array(entries, pa.int32()), pa.array(leaves, pa.int32())], ["doc_id", "t", "no", "entry", "leave"]
        )


def _same(a: DataFrame, b: DataFrame, *more: str) -> Column:
    cond = F.equal_null(a["doc_id"], b["doc_id"]) & (a["t"] == b["t"])
    for c in more:
        cond = cond & (a[c] == b[c])
    return cond


def scan(mats: DataFrame, of: str, fan: int = FAN) -> DataFrame:
    """(doc_id, t, no, m) to (doc_id, t, no, entry, leave): the states that the whole document's best path has."""
    groups = mats.groupBy("doc_id", "t", F.floor(F.col("no") / fan).alias("g")).agg(F.array_sort(F.collect_list(F.struct("no", "m"))).alias("parts"))
    groups = settle(groups, "scan-groups")
    key, schema = f"doc_id {of}, t binary", "no long, entry int, leave int"
    if groups.filter("g > 0").isEmpty():
        ready = groups.select("doc_id", "t", "parts", F.lit(0).alias("entry"), F.lit(None).cast("int").alias("leave"))
    else:
        up = settle(groups.select("doc_id", "t", F.col("g").alias("no"), "parts").mapInArrow(_products, f"{key}, no long, m {MATRIX}"), "scan-products")
        above = scan(up, of, fan).withColumnRenamed("no", "g")
        ready = groups.join(above, _same(groups, above, "g")).select(groups["doc_id"], groups["t"], "parts", "entry", "leave")
    return settle(ready.mapInArrow(_states, f"{key}, {schema}"), "scan-states")


def encode_giants(giants: DataFrame, path: str = MODEL, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, t, copies, text) to (doc_id, t, copies, token_ids) by chunks; (doc_id, t) must be distinct."""
    of = giants.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {of}, t binary"
    chunks = settle(giants.mapInArrow(_split(size), f"{key}, copies long, {_WINDOW}"), "chunks")

    def transfers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in slices(rows, 32):
            found = [pieces.transfer(*x).tolist() for x in zip(*(batch.column(c).to_pylist() for c in ("s", "lo", "hi", "stop")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "t", "no")] + [pa.array(found, pa.list_(pa.list_(pa.float64())))], ["doc_id", "t", "no", "m"])

    def traces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in slices(rows, 32):
            found = [pieces.trace(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("s", "lo", "hi", "stop", "entry", "leave")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "t", "copies", "no")] + [pa.array(found, pa.list_(pa.int32()))], ["doc_id", "t", "copies", "no", "ids"])

    mats = chunks.select("doc_id", "t", "no", "s", "lo", "hi", "stop").mapInArrow(transfers, f"{key}, no long, m {MATRIX}")
    states = scan(mats, of, fan)
    traced = chunks.join(states, _same(chunks, states, "no")).select(*[chunks[c] for c in ("doc_id", "t", "copies", "no", "s", "lo", "hi", "stop")], "entry", "leave")
    ids = traced.mapInArrow(traces, f"{key}, copies long, no long, ids array<int>")
    whole = ids.groupBy("doc_id", "t", "copies").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return whole.select("doc_id", "t", "copies", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"))


def _same_text(model: sentencepiece.SentencePieceProcessor, ids: list[list[int] | None], digests: pa.Array) -> pa.Array:
    """Whether token ids decode to the text of the MD5 digest; null for a null text."""
    return pa.array([None if x is None else hashlib.md5(model.decode(x).encode()).digest() == t for x, t in zip(ids, digests.to_pylist(), strict=True)], pa.bool_())


def encode(docs: DataFrame, path: str = MODEL, size: int = CHUNK, fan: int = FAN, check: bool = False) -> DataFrame:
    """(doc_id, t, token_ids) for each row of ``docs``; t is the text's MD5. With ``check`` also round_trip.

    Whole texts are encoded and checked in one Python step: a second one would be a further process for each core.
    """
    of = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("t"), "text")
    giant = F.length("text") > size
    names = ["doc_id", "t", "token_ids", *["round_trip"] * check]
    schema = f"doc_id {of}, t binary, token_ids array<int>" + ", round_trip boolean" * check

    def encode_whole(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch, texts in batches(batched):
            ids = [None if t is None else model.encode(t) for t in texts]
            more = [_same_text(model, ids, batch.column("t"))] if check else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(ids, pa.list_(pa.int32())), *more], names)

    def check_giants(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in slices(batched, 32):
            same = _same_text(model, batch.column("token_ids").to_pylist(), batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "t", "token_ids")] + [same], names)

    small = rows.filter(~giant | F.col("text").isNull()).mapInArrow(encode_whole, schema)
    giants = rows.filter(giant).groupBy("doc_id", "t").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    found = encode_giants(giants, path, size, fan)
    copies = found.select("doc_id", "t", "token_ids", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("col")
    return small.unionByName(copies.mapInArrow(check_giants, schema) if check else copies)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with its token ids' text, in place of a column ``text`` that it has."""
    encoded = encoded.drop("text")
    names = encoded.columns

    def decode_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in slices(rows):
            texts = [None if x is None else model.decode(x) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    return encoded.mapInArrow(decode_rows, StructType([*encoded.schema.fields, StructField("text", StringType())]))


def encode_checked(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip (whether the ids decode to the text) for each row of ``docs``."""
    checked = encode(docs, path, check=True)
    return checked.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: token ids of all ``documents``, and whether they decode to the texts."""
    return encode_checked(table(spark, sf_dir, "documents"))
