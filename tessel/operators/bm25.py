"""BM25 (Okapi) over a corpus as postings, for many queries at once.

Statistics take in the whole corpus; allowed documents restrict the ranking before the top k, not after it. A document
is eligible if it shares a token with the query, whatever its score (it may be 0 or negative). Terms with a negative idf
get a quarter of the mean idf of all terms. An empty document counts as one token of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.functions.text import tokenize
from tessel.session import settle

K1, B, EPSILON = 1.5, 0.75, 0.25
EMPTY = "__empty__"


def tokens_or_empty(text: Column) -> Column:
    # as a lambda's argument the tokens are computed once
    return F.transform(F.array(tokenize(F.coalesce(text, F.lit("")))), lambda t: F.when(F.size(t) == 0, F.array(F.lit(EMPTY))).otherwise(t))[0]


def term_stats(corpus: DataFrame) -> DataFrame:
    """``corpus(doc_id, tokens)`` to (term, df, cf, idf), idf with its floor.

    Both counts go by term alone, so they combine before they move: what is shuffled is a row per term and task.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    counted = corpus.select(F.explode(F.array_distinct("tokens")).alias("term"), one.alias("df"), none.alias("cf"))
    counted = counted.unionByName(corpus.select(F.explode("tokens").alias("term"), none.alias("df"), one.alias("cf")))
    stats = settle(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "term-counts")
    n = corpus.agg(F.count("*").alias("n"))
    raw = stats.join(F.broadcast(n)).select("term", "df", "cf", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", "cf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def score(corpus: DataFrame, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Scores (query_id, doc_id, score) of ``queries(query_id, tokens)`` against ``corpus(doc_id, tokens)``.

    Only postings of query terms are kept, so rows grow with matches rather than with the corpus's tokens. What is about
    query terms is settled first: with its true size Spark sends it to the postings if it is small, and else not.
    """
    wanted = settle(queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "query-terms")
    terms = settle(wanted.select("term").distinct(), "terms")
    stats = settle(term_stats(corpus).select("term", "idf").join(terms, "term", "left_semi"), "query-idf")
    average = corpus.agg(F.avg(F.size("tokens")).alias("avgdl"))
    ranked = corpus if allowed is None else corpus.join(allowed, "doc_id", "left_semi")
    postings = (
        ranked.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .join(terms, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    )
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        postings.join(stats, "term").join(wanted, "term").join(F.broadcast(average)).withColumn("part", part)
        .groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("score"))
    )


def ranked(scores: DataFrame, k: int | None = None, by: str = "score") -> DataFrame:
    """Rank by falling score, ties by doc_id; the first k. Spark prunes each partition to k before it shuffles."""
    out = scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(by), "doc_id")))
    return out if k is None else out.filter(F.col("rank") <= k)


def corpus_of(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_).alias("doc_id"), tokens_or_empty(F.col(text)).alias("tokens"))


def queries_of(rows: DataFrame, text: str, id_: str) -> DataFrame:
    return rows.select(F.col(id_).alias("query_id"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def corpus_text(rows: DataFrame, status: str | None = None, text: str = "text", expansion: str = "search_expansion") -> DataFrame:
    """``rows`` of one status with ``text`` and its expansion as one text; a table of an older form may lack the expansion."""
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    more = [F.coalesce(F.col(expansion), F.lit(""))] if expansion in rows.columns else []
    return rows.withColumn(text, F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), *more))
