"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source gets a target of words by weight, capped at ``cap`` times its size. Within a source every document with
words has the same expected copies (target / size). The expected copies are prefix-summed along a fixed order, one
offset per source is added, and a document is emitted once per integer boundary that its interval crosses. Runs over
one source hold ``floor`` or ``ceil`` of their expected copies, so the words taken stay close to the target; the order
goes by size, which spreads short and long documents evenly.

The prefix sum is distributed: documents fall into (source, size band, salt) cells, the cells' counts are summed up
per source (at most 64 bands times ``MAX_SALTS`` rows), and a document's position is its cell's start plus its rank in
the cell. A source with a third of all rows is split over its salts.

Cases: a null text has no words; documents without words are returned with ``taken`` 0; a null source is a source of
its own, last in order; repeated rows are rows like others, each sampled by itself; an empty table gives an empty
result; columns besides doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.session import scratch, settle, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SEED = "mix-1"
#: Documents to a salt, and salts to a size band at most.
SALT_ROWS, MAX_SALTS = 200, 4096


def _hex(c: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, per_200: int = 3, cap: int = 2) -> DataFrame:
    """``sizes(src, src_null, size)`` to a row per source: n_docs with words, source_size, target (double).

    The sum of targets is ``per_200 / 2`` of all words. Sources whose share exceeds ``cap`` times their size stop
    there and the excess is dealt out by weight among the others until none is above: the level at which that settles
    is found by sorting sources by cap over weight and summing caps and weights along that order. Needs
    ``cap * 2 >= per_200``. The windows here run over sources, not over documents.
    """
    by = sizes.groupBy("src", "src_null").agg(
        F.count_if(F.col("size") > 0).alias("n_docs"), F.sum("size").alias("source_size")
    )
    order = W.orderBy("src_null", "src")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.select("*", weight.cast("long").alias("w"))
    fill = W.orderBy(F.col("source_size") / F.col("w"), "src_null", "src")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    by = by.select(
        "*",
        (per_200 * F.sum("source_size").over(W.partitionBy()) - 2 * cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left2"),
        F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing)).alias("w_left"),
    )
    # left2 / 2 is what is left for this source and all later ones; the first that isn't filled up fixes the level
    open_ = F.col("left2") * F.col("w") <= 2 * cap * F.col("source_size") * F.col("w_left")
    first = F.min(F.when(open_, F.struct(F.col("source_size") / F.col("w"), "src_null", "src", "left2", "w_left"))).over(W.partitionBy())
    by = by.select("*", open_.alias("open"), first.alias("at"))
    return by.select(
        "src", "src_null", "n_docs", "source_size",
        F.when(F.col("open"), F.col("at.left2") * F.col("w") / (F.lit(2.0) * F.col("at.w_left")))
        .otherwise(F.lit(float(cap)) * F.col("source_size")).alias("target"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of ``docs``."""
    return _plan(docs, weights, seed).drop("t", "src", "src_null")


def _plan(docs: DataFrame, weights: tuple[int, ...], seed: str) -> DataFrame:
    """``mix_sources`` with what tells its rows apart: the text's hash t and the source."""
    sized = docs.select(
        "doc_id",
        F.xxhash64("text").alias("t"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("src_null"),
    )
    sized = settle(sized, "mix-sizes")  # the texts are read once
    sources = settle(source_targets(sized, weights), "mix-sources")

    salts = F.least(F.lit(MAX_SALTS), 1 + F.floor(F.col("n_docs") / SALT_ROWS))
    cells = sized.join(sources, ["src", "src_null"]).select(
        "*",
        F.length(F.bin("size")).alias("band"),
        F.pmod(_hex(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string")), 8), salts).alias("salt"),
    )
    key = ["src", "src_null", "band", "salt"]
    starts = (
        cells.filter("size > 0").groupBy(*key).count()
        .select(*key, F.coalesce(F.sum("count").over(W.partitionBy("src", "src_null").orderBy("band", "salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    )
    ranked = cells.filter("size > 0").withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("size", "doc_id", "t")))
    offset = _hex(F.concat_ws("/", F.lit(seed), F.col("src_null").cast("string"), "src"), 8) / F.lit(4294967296.0)
    rate = F.col("target") / F.col("source_size")
    to = F.col("start") + F.col("rank")
    copies = F.floor(to * rate + offset) - F.floor((to - 1) * rate + offset)
    out = ["doc_id", "t", "src", "src_null", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"]
    return (
        ranked.join(starts, key).withColumn("copies", copies).select(*out)
        .unionByName(cells.filter("size = 0").withColumn("copies", F.lit(0).cast("long")).select(*out))
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """``docs`` with each document as often as the mix takes it (never, once or more).

    The texts move once, hashed to a narrow table of copies by doc_id, text and source. Rows that are equal in all three
    are interchangeable; what the mix takes of them in all is dealt out among them by their rank.
    """
    with scratch(docs.sparkSession) as keep:
        plan = _plan(docs, weights, seed).filter("size > 0")
        need = plan.groupBy("doc_id", "t", "src", "src_null").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).filter("__copies > 0")
        need = need.withColumnsRenamed({"doc_id": "__id", "t": "__t", "src": "__src", "src_null": "__src_null"})
        keep.append(settle(need, "mix-copies"))
    need = keep[0]
    same = F.equal_null(docs["doc_id"], F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__t"))
    same = same & (F.coalesce(docs["source"], F.lit("")) == F.col("__src")) & (docs["source"].isNull() == F.col("__src_null"))
    both = docs.join(need.hint("shuffle_hash"), same)
    if not need.filter("__rows > 1").isEmpty():
        rank = F.row_number().over(W.partitionBy("__id", "__t", "__src", "__src_null").orderBy("__rows"))
        part = lambda n: F.floor(n * F.col("__copies") / F.col("__rows"))
        many = both.filter("__rows > 1").withColumn("__n", rank)
        many = many.withColumn("__copies", part(F.col("__n")) - part(F.col("__n") - 1)).drop("__n")
        both = both.filter("__rows = 1").unionByName(many)
    return both.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


#: DuckDB SQL of ``mix_sources`` (all columns).
MIX_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  coalesce(source, '') AS src, source IS NULL AS src_null FROM {{docs}}),
s AS (SELECT src, src_null, count(*) FILTER (WHERE size > 0) AS n_docs, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY src_null, src) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
s2 AS (SELECT *, (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left2,
              (sum(w) OVER (ORDER BY source_size / w, src_null, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left FROM s1),
s3 AS (SELECT *, left2 * w <= 4 * source_size * w_left AS open FROM s2),
lev AS (SELECT left2 AS l2, w_left AS wl FROM s3 WHERE open ORDER BY source_size / w, src_null, src LIMIT 1),
t AS (SELECT src, src_null, n_docs, source_size, CASE WHEN open THEN (l2 * w)::DOUBLE / (2.0 * wl)::DOUBLE ELSE 2.0::DOUBLE * source_size END::DOUBLE AS target FROM s3 LEFT JOIN lev ON true),
c AS (SELECT d.*, n_docs, source_size, target, length(bin(size)) AS band,
             ('0x' || md5(concat_ws('/', '{SEED}', doc_id::VARCHAR))[1:8])::BIGINT % least({MAX_SALTS}, 1 + n_docs // {SALT_ROWS}) AS salt
      FROM d JOIN t USING (src, src_null)),
p AS (SELECT *, row_number() OVER (PARTITION BY src, src_null ORDER BY band, salt, size, doc_id NULLS FIRST) AS rn,
             ('0x' || md5(concat_ws('/', '{SEED}', src_null::VARCHAR, src))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u
      FROM c WHERE size > 0),
k AS (SELECT doc_id, size, source_size, target, (floor(rn * (target / source_size) + u) - floor((rn - 1) * (target / source_size) + u))::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM k
UNION ALL SELECT doc_id, size, source_size, target, 0, 0 FROM c WHERE size = 0
"""


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the mix of all ``documents``."""
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = MIX_SQL.format(docs="documents")
