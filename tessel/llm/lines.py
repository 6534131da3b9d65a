"""Line dedup by a deletion-neighbourhood join.

A line (between line feeds) is its sequence of words. Lines with a word repeat an earlier line if they are equal to it,
or if one unit inserted, left out or replaced makes them equal (an edit distance of 1). The unit is a word in lines of
``NEAR`` words or more; in shorter ones a word is too much of the line, and the unit is a character if the line has two
words and ``LONG`` characters or more. A line stays if no line of its kind before it, by doc_id and place, is within
that bound.

All variants within the bound are emitted as hashed keys: each line without one of its units, with the place of that
unit, and the line itself. Equal variants at equal places come from lines that differ in that unit at most; a variant
equal to a whole line comes from a line one unit longer. So the least position in each group of equal keys settles all
its members, without pairs, and a group of any size is pre-aggregated. The earliest partner found is verified by its
edit distance.

Only lines that can have a partner emit variants: lines within one edit share their first or their last half, so halves
are hashed first and lines whose halves no other line has are out. What is shuffled is hashes and places; texts move
once for the lines that emit variants and once to take lines out of their documents.

Cases: a null text stays null; lines without a word stay; rows with equal doc_id and text are documents one after the
other, of which the first (any of them, as they are alike) keeps its lines; rows without doc_id come last in order; ties
in doc_id are broken by the text's hash; an empty table gives an empty result; columns besides doc_id and text are kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from tessel.llm.words import batches, mix64, slices, word_hashes
from tessel.session import release, scratch, settle, table

LEAST, NEAR, LONG = 1, 5, 20
WORD = r"[^\x20\x09-\x0D]"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def units(words: list[bytes]) -> list[bytes] | None:
    """What edits of a line count: its words, or its characters if it has few words; None if only equal lines repeat it."""
    if len(words) >= NEAR:
        return words
    line = b" ".join(words).decode()
    return [b"\0" + c.encode() for c in line] if len(words) >= 2 and len(line) >= LONG else None


def half_keys(parts: list[bytes]) -> list[int]:
    """Hashes of the first and last half, for partners of equal length, and for partners one unit shorter."""
    out = []
    for n in (len(parts), len(parts) - 1):
        k = n // 2
        for side, part in enumerate((parts[:k], parts[-k:])):
            out.append(xxhash.xxh3_64_intdigest(b" ".join(part), 2 * n + side) - (1 << 63))
    return out


def _records(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(rows):
        at, pos, key, halves = [], [], [], []
        for i, t in enumerate(texts):
            for p, line in enumerate(t.encode().split(b"\n") if t else ()):
                words = line.split()
                if len(words) >= LEAST:
                    at.append(i)
                    pos.append(p)
                    key.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    of = units(words)
                    halves.append(half_keys(of) if of else None)
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("t").take(at), pa.array(pos, pa.int32()), pa.array(key, pa.binary()), pa.array(halves, pa.list_(pa.int64()))],
            ["doc_id", "t", "pos", "line", "halves"],
        )


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the line without word (or other unit) i, for each i, and of the whole line last; as arrays (n + 1, 2)."""
    h, n = word_hashes(words), len(words)
    out = np.empty((n + 1, 2), np.uint64)
    for c, base in enumerate(_BASES):
        powers = np.cumprod(np.full(n, base)) if n else np.empty(0, np.uint64)
        x = mix64(h + base)
        before = np.concatenate([[np.uint64(0)], np.cumsum(x * powers)])  # word i at power i + 1
        shifted = np.concatenate([[np.uint64(0)], np.cumsum(x[1:] * powers[:-1])]) if n > 1 else np.zeros(1, np.uint64)
        out[:n, c] = before[:n] + shifted[n - 1] - shifted[np.arange(n)]
        out[n, c] = before[n]
    return out


def _emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate line: (a, b, place) with place -1 for whole lines and for variants as whole lines."""
    for batch in slices(rows):
        line, kind, place, keys = [], [], [], []
        for i, (text, hit) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hit").to_pylist(), strict=True)):
            parts = units(text.encode().split())
            n, v = len(parts), variants(parts)
            same, longer = np.zeros(n, bool), np.zeros(n, bool)
            k, k1 = n // 2, (n - 1) // 2
            if hit[0]:
                same[k:] = True
            if hit[1]:
                same[: n - k] = True
            if hit[2]:
                longer[k1:] = True
            if hit[3]:
                longer[: n - k1] = True
            same, longer = np.flatnonzero(same), np.flatnonzero(longer)
            keys.append(np.concatenate([v[same], v[longer], v[n:]]))
            line.append(np.full(len(keys[-1]), i))
            kind.append(np.repeat([0, 1, 2], [len(same), len(longer), 1]))
            place.append(np.concatenate([same, np.full(len(longer) + 1, -1)]))
        key = np.concatenate(keys) if keys else np.empty((0, 2), np.uint64)
        at = pa.array(np.concatenate(line) if line else [], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), pa.array(np.concatenate(place) if place else [], pa.int32()),
                pa.array(np.concatenate(kind) if kind else [], pa.int32()), batch.column("line").take(at), batch.column("first").take(at),
            ],
            ["a", "b", "place", "kind", "line", "first"],
        )


def edit_distance_1(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two sequences of words are within one insertion, deletion or replacement."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(rows):
        pairs = zip(batch.column("text").to_pylist(), batch.column("partner_text").to_pylist(), strict=True)
        yield batch.select(["line"]).filter(pa.array([edit_distance_1(units(a.encode().split()), units(b.encode().split())) for a, b in pairs], pa.bool_()))


def _cut_lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines at the places ``at`` with their keys."""
    for batch, texts in batches(rows):
        out = []
        for t, cs in zip(texts, batch.column("candidates").to_pylist(), strict=True):
            of = t.split("\n")
            out += [(c["line"], c["first"], c["hit"], of[c["pos"]]) for c in cs]
        columns = list(zip(*out, strict=True)) or [()] * 4
        first = pa.array(columns[1], batch.schema.field("candidates").type.value_type.field("first").type)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), first, pa.array(columns[2], pa.list_(pa.bool_())), pa.array(columns[3], pa.string())], ["line", "first", "hit", "text"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, places): the places of lines that repeat an earlier one, by document, settled; t is xxhash64 of the text."""
    of = docs.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession) as keep:
        rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
        records = settle(rows.mapInArrow(_records, f"doc_id {of}, t long, pos int, line binary, halves array<bigint>"), "lines")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "pos")
        firsts = settle(records.groupBy("line").agg(F.min(order).alias("first"), F.first("halves").alias("halves")), "line-firsts")

        halves = firsts.filter("halves is not null").select("line", F.posexplode("halves").alias("n", "half"))
        shared = settle(halves.groupBy("half").agg(F.min("line").alias("x"), F.max("line").alias("y")).filter("x <> y").select("half"), "shared-halves")
        hits = halves.join(shared, "half", "left_semi").groupBy("line").agg(*[F.max(F.col("n") == i).alias(f"h{i}") for i in range(4)])
        candidates = firsts.join(hits, "line").select("line", "first", F.array("h0", "h1", "h2", "h3").alias("hit"))
        by_doc = settle(
            candidates.select(F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t"), F.struct(F.col("first.pos").alias("pos"), "line", "first", "hit").alias("c"))
            .groupBy("doc_id", "t").agg(F.collect_list("c").alias("candidates")), "line-candidates",
        )
        release(shared)
        texts = rows.join(by_doc.hint("shuffle_hash"), F.equal_null(rows["doc_id"], by_doc["doc_id"]) & (rows["t"] == by_doc["t"])).select("text", "candidates")
        first_type = firsts.schema["first"].dataType.simpleString()
        cut = settle(texts.mapInArrow(_cut_lines, f"line binary, first {first_type}, hit array<boolean>, text string").dropDuplicates(["line"]), "candidate-lines")
        release(by_doc)

        emitted = settle(cut.mapInArrow(_emit, f"a long, b long, place int, kind int, line binary, first {first_type}"), "variants")
        whole = F.struct("first", "line")
        groups = emitted.groupBy("a", "b", "place").agg(
            F.min(F.when(F.col("kind") == 1, whole)).alias("shorter"), F.min(F.when(F.col("kind") != 1, whole)).alias("other"), F.min("line").alias("x"), F.max("line").alias("y")
        ).filter("x <> y").drop("x", "y")
        met = emitted.join(groups, ["a", "b", "place"]).select(
            "line", "first",
            # replaced unit: the earliest of the group; one unit less: the whole line; a whole line: the earliest that has a unit more
            F.when(F.col("kind") == 2, F.col("shorter")).otherwise(F.col("other")).alias("partner"),
        )
        earlier = settle(met.filter(F.col("partner.first") < F.col("first")).groupBy("line").agg(F.min("partner").alias("partner")), "earlier-lines")
        release(emitted)
        pairs = earlier.join(cut.select("line", "text"), "line").join(cut.select(F.col("line").alias("p"), F.col("text").alias("partner_text")), F.col("partner.line") == F.col("p"))
        near = settle(pairs.select("line", "text", "partner_text").mapInArrow(_verify, "line binary"), "near-lines")
        release(cut)

        verdicts = records.join(firsts.select("line", "first").join(near.withColumn("near", F.lit(True)), "line", "left"), "line")
        dropped = verdicts.filter((order != F.col("first")) | F.col("near"))
        keep.append(settle(dropped.select("doc_id", "t", "pos").distinct().groupBy("doc_id", "t").agg(F.collect_list("pos").alias("places")), "repeated-lines"))
    return keep[0]


def repeated_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t) of texts with a word that two rows or more of one doc_id have, settled."""
    worded = docs.filter(F.col("text").rlike(WORD)).select("doc_id", F.xxhash64("text").alias("t"))
    return settle(worded.groupBy("doc_id", "t").count().filter("count > 1").select("doc_id", "t"), "repeated-rows")


def dedup_lines(docs: DataFrame, emptied: str = "keep") -> DataFrame:
    """``docs`` without lines that repeat earlier ones, plus n_dropped.

    ``emptied`` says what becomes of documents that had lines with words and have none left: "keep" or "drop".
    """
    found = repeated_lines(docs).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("places").alias("__places"))
    same = F.equal_null(docs["doc_id"], F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__t"))
    # the texts are hashed to the narrow side, not sorted
    joined = docs.join(found.hint("shuffle_hash"), same, "left").withColumn("__again", F.lit(False))
    twice = repeated_rows(docs)
    if not twice.isEmpty():
        named = twice.select(F.col("doc_id").alias("__id2"), F.col("t").alias("__t2"), F.lit(True).alias("__twice"))
        marked = joined.join(named, F.equal_null(docs["doc_id"], F.col("__id2")) & (F.xxhash64(docs["text"]) == F.col("__t2")), "left")
        later = F.row_number().over(W.partitionBy("__id2", "__t2").orderBy(F.lit(1))) > 1
        joined = marked.filter("__twice is null").unionByName(marked.filter("__twice").withColumn("__again", later))
    schema = StructType([*docs.schema.fields, StructField("n_dropped", IntegerType(), False)])
    return joined.select(*docs.columns, "__places", "__again").mapInArrow(_take_out(emptied == "drop"), schema)


def _take_out(drop: bool):
    def take_out(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without the lines at ``__places``, or without any line with a word if ``__again``."""
        for batch, texts in batches(rows):
            n, stay = [0] * len(texts), [True] * len(texts)
            for i, (places, again) in enumerate(zip(batch.column("__places").to_pylist(), batch.column("__again").to_pylist(), strict=True)):
                if places or again:
                    of = texts[i].split("\n")
                    gone = set(places or ())
                    left = [x for p, x in enumerate(of) if p not in gone] if not again else [x for x in of if not x.encode().split()]
                    n[i], texts[i] = len(of) - len(left), "\n".join(left)
                    stay[i] = not drop or bool(texts[i].encode().split())
            names = batch.schema.names[:-2]
            out = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names] + [pa.array(n, pa.int32())], [*names, "n_dropped"])
            yield out.filter(pa.array(stay, pa.bool_())) if drop else out

    return take_out


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: doc_id, text without repeated lines and n_dropped for all ``documents``."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
