"""Ranked lexical search by bag deduplication.

A document's score for an item depends on nothing but m, which its length gives, and how often it has each of the items'
terms. So documents are restricted to the items' vocabulary, in order of terms, and those of equal m and equal bag are a
class: Spark groups them by a hash and, as the bag is a key too, by what it stands for. Classes are scored once. An
item's best ten classes by falling score, then least doc_id, hold its best ten documents: of a class only the ten least
doc_ids can be among them, and each class before an eleventh one has a document before that one's. Those are expanded and
ranked by ascending doc_id.

Texts are read once. To their tasks goes a bitmap of fixed size (``BITS``) of the hashes of the items' terms. A term that
passes it by chance stays in its bag; it may part two classes, but no item asks for it, so results stand. Items are scored
in blocks of about ``POSTINGS`` (item, term) postings, or one longer item, which is what a task holds of them; each block
is a pass over the classes. A task returns ten classes an item.

All numbers are whole: a score is a sum of 64-bit products.

Cases: null texts and texts without terms count for nothing; null and empty items and those without terms in documents
have no rows; rows of one item_id are one item with the terms of all; rows of one doc_id are ranked as rows; rows without
doc_id come after equal scores of others; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.llm.words import batches, slices
from tessel.session import scratch, settle, table

TOP = 10
BITS = 1 << 24
POSTINGS = 1 << 20
CELLS = 1 << 20
#: Bytes in terms, A-Z as a-z; all others part them. Those of characters beyond ASCII are in terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def _bit(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % BITS


def _item_terms(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(rows):
        found = [[t.decode() for t in dict.fromkeys(terms_of(t))] for t in texts]
        at = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))), pa.int64())
        flat = [t for f in found for t in f]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(at), pa.array(flat, pa.string()), pa.array([_bit(t.encode()) for t in flat], pa.int64())], ["item_id", "term", "bit"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, bit), each once, settled."""
    of = items.schema["item_id"].dataType.simpleString()
    return settle(items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {of}, term string, bit long").distinct(), "item-terms")


def bitmap(wanted: DataFrame) -> np.ndarray:
    """The bits of all terms, BITS / 8 bytes whatever their number."""
    cut = wanted.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in cut.collect():  # of fixed size: BITS / 32768 buckets at most
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _bags(bits: np.ndarray):
    def bags(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, bool] = {}
        for batch, texts in batches(rows):
            n, out = [], []
            for text in texts:
                words = terms_of(text)
                counts = Counter(words)
                for t in counts:
                    if t not in asked:
                        b = _bit(t)
                        asked[t] = bool(bits[b >> 3] >> (b & 7) & 1)
                out.append(" ".join(f"{t.decode()} {counts[t]}" for t in sorted(t for t in counts if asked[t])))
                n.append(len(words))
                if len(asked) > 1 << 17:
                    asked.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n", "bag"])

    return bags


def bags_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, n terms and the bag ``term times term times ...`` of terms that pass ``bits``, for rows with a term, settled."""
    of = docs.schema["doc_id"].dataType.simpleString()
    return settle(docs.select("doc_id", "text").mapInArrow(_bags(bits), f"doc_id {of}, n long, bag string").filter("n > 0"), "bags")


def classes_of(bags: DataFrame, total: tuple[int, int], top: int = TOP) -> DataFrame:
    """(m, bag, members): documents of equal m and bag, members being the ``top`` least doc_ids in order, settled."""
    documents, length = total
    m = F.lit(100 - 90) + F.expr(f"(90 * n * {documents}L) div {max(1, length)}L")
    rows = bags.filter("bag <> ''").select("doc_id", m.cast("long").alias("m"), "bag").withColumn("hash", F.xxhash64("m", "bag"))
    of = W.partitionBy("hash", "m", "bag")
    # a task passes on no more than its own least ones
    least = rows.withColumn("place", F.row_number().over(of.orderBy(F.col("doc_id").asc_nulls_last()))).filter(F.col("place") <= top)
    return settle(least.groupBy("hash", "m", "bag").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("members")).select("m", "bag", F.col("members.doc_id").alias("members")), "classes")


def weights(bags: DataFrame, wanted: DataFrame, documents: int) -> DataFrame:
    """(item_id, term, w) of the items' terms that documents have, settled."""
    terms = F.transform(F.array(F.split("bag", " ")), lambda x: F.filter(x, lambda t, i: i % 2 == 0))[0]
    df = bags.filter("bag <> ''").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    return settle(wanted.join(df, "term").select("item_id", "term", w.cast("long").alias("w")), "item-weights")


def _score(items: pa.Array, item: np.ndarray, terms: pa.Array, w: np.ndarray, top: int):
    """Scores classes for a block of ``items``: postings are (place in items, term, w); gives each task's best classes of an item."""
    names = terms.dictionary_encode()
    code = {t.encode(): i for i, t in enumerate(names.dictionary.to_pylist())}
    of = names.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    begin, item, w = np.searchsorted(of[order], np.arange(len(code) + 1)), item[order], w[order]

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(items), top), np.int64)  # an item's best scores so far
        for batch in slices(rows, max(1, min(256, CELLS // max(1, len(items))))):
            row, at, tf = [], [], []
            for i, bag in enumerate(batch.column("bag").to_pylist()):
                parts = bag.encode().split(b" ")
                known = [(code[t], int(k)) for t, k in zip(parts[::2], parts[1::2], strict=True) if t in code]
                row += [i] * len(known)
                at += [c for c, _ in known]
                tf += [k for _, k in known]
            row, at, tf, m = (np.array(x, np.int64) for x in (row, at, tf, batch.column("m").to_pylist()))
            value, n = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row]), begin[at + 1] - begin[at]
            scores = np.zeros((len(items), batch.num_rows), np.int64)
            cuts = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), CELLS)), len(n)))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # a slice of postings at a time
                c = n[lo:hi]
                p = np.repeat(begin[at[lo:hi]] - np.cumsum(c) + c, c) + np.arange(c.sum())
                np.add.at(scores.reshape(-1), item[p] * batch.num_rows + np.repeat(row[lo:hi], c), w[p] * np.repeat(value[lo:hi], c))
            first = np.asarray(pc.rank(batch.column("first"), sort_keys="ascending", null_placement="at_end", tiebreaker="first"))
            i, b = np.nonzero((scores > 0) & (scores >= best.min(1)[:, None]))
            order = np.lexsort((first[b], -scores[i, b], i))
            i, b = i[order], b[order]
            near = np.arange(len(i)) - np.searchsorted(i, i) < top
            i, b = i[near], b[near]
            best = np.partition(np.concatenate([best, scores], 1), batch.num_rows, axis=1)[:, batch.num_rows :]
            yield pa.RecordBatch.from_arrays([items.take(pa.array(i)), pa.array(scores[i, b]), *(batch.column(c).take(pa.array(b)) for c in ("first", "members"))], ["item_id", "score", "first", "members"])

    return score


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0, settled."""
    spark = docs.sparkSession
    doc, of = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    with scratch(spark) as keep:
        wanted = item_terms(items)
        bags = bags_of(docs, bitmap(wanted))
        documents, length = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        classes, weighted = classes_of(bags, (documents, length), top), weights(bags, wanted, documents)
        blocks, found = max(1, -(-weighted.count() // POSTINGS)), []
        for b in range(blocks):
            part = weighted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").toArrow()  # a block of items
            ids = part.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
            scorer = _score(ids.dictionary, ids.indices.to_numpy().astype(np.int64), part.column("term").combine_chunks(), part.column("w").to_numpy(), top)
            scored = classes.select("m", "bag", F.get("members", F.lit(0)).alias("first"), "members").mapInArrow(scorer, f"item_id {of}, score long, first {doc}, members array<{doc}>")
            found.append(_first(scored, "first", top))
        each = reduce(DataFrame.unionByName, found).select("item_id", "score", F.explode("members").alias("doc_id"))
        keep.append(settle(_first(each, "doc_id", top).select("item_id", "rank", "doc_id", "score"), "ranked"))
    return keep[0]


def _first(rows: DataFrame, by: str, top: int) -> DataFrame:
    """The first rows of each item by falling score, then ``by``; tasks pass on no more than their own first ones."""
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col(by).asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the ten best of all ``documents`` for each ``benchmark`` item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format(c='text')} AS t FROM documents),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
m AS (SELECT row, doc_id, 100 - 90 + (90 * len(t) * n) // l AS m FROM d, c WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(c='text')}) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), c),
s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM w JOIN p USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}"""
