"""Whole request paths over many queries: tiers are disjoint subsets of the queries, joined again at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.functions import text as T
from tessel.operators import bm25, fusion
from tessel.plans import retrieval as R
from tessel.plans.registry import query
from tessel.session import settle, table



def _questions(spark, sf_dir) -> DataFrame:
    """Benchmark passages; every fourth names document ``item_id`` by its code and is answered by the alias tier."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), "text", F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("DOC "), F.lpad(F.col("item_id").cast("string"), 4, "0"))).alias("code"))


_ASKED = "asked AS (SELECT item_id AS query_id, text, CASE WHEN item_id % 4 = 0 THEN item_id END AS named FROM benchmark)"
_SEARCH_SQL = f"""WITH {R.BM25_SQL.format(where='')}, {_ASKED}, {R._SIGMA}, {R._BLEND.format(a=0.4)},
alias AS (SELECT query_id, doc_id, 1.0::DOUBLE AS score, 'alias' AS matched_via FROM asked JOIN documents ON doc_id = named),
rest AS (SELECT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM alias)),
mx AS (SELECT query_id, max(sigma) AS x FROM sg GROUP BY 1),
hits AS (SELECT query_id, doc_id, round(blended, 6) AS score, 'hybrid' AS matched_via FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, doc_id) AS rk FROM bl) JOIN rest USING (query_id) JOIN mx USING (query_id) WHERE x >= 0.5 AND rk <= 3),
gone AS (SELECT query_id, NULL::BIGINT, NULL::DOUBLE, CASE WHEN x IS NULL THEN 'empty' ELSE 'rejected' END FROM rest LEFT JOIN mx USING (query_id) WHERE x IS NULL OR x < 0.5)
SELECT * FROM alias UNION ALL SELECT * FROM hits UNION ALL SELECT * FROM gone"""


@query("search_pipeline", _SEARCH_SQL)
def search_pipeline(spark, sf_dir, bound: float = 0.5, k: int = 3):
    """Alias tier, then retrieval, rerank with blend, and the reject gate on raw scores."""
    asked = _questions(spark, sf_dir)
    codes = table(spark, sf_dir, "documents").select("doc_id", T.ascii_fold(F.concat(F.lit("DOC "), F.lpad(F.col("doc_id").cast("string"), F.greatest(F.lit(4), F.length(F.col("doc_id").cast("string"))), F.lit("0")))).alias("term"))
    alias = asked.withColumn("term", T.ascii_fold(F.col("code"))).join(codes, "term").select("query_id", "doc_id", F.lit(1.0).alias("score"), F.lit("alias").alias("matched_via"))
    alias = settle(alias, "alias-hits")
    rest = asked.join(alias.select("query_id"), "query_id", "left_anti").select("query_id")
    pool = settle(R.pool(spark, sf_dir), "pool")
    top = pool.groupBy("query_id").agg(F.max("sigma").alias("x"))
    blended = bm25.ranked(fusion.blend(pool, 0.4), k, "blended")
    hits = blended.join(rest, "query_id").join(top.filter(F.col("x") >= bound), "query_id").select("query_id", "doc_id", F.round("blended", 6).alias("score"), F.lit("hybrid").alias("matched_via"))
    gone = rest.join(top, "query_id", "left").filter(F.col("x").isNull() | (F.col("x") < bound)).select(
        "query_id", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.when(F.col("x").isNull(), "empty").otherwise("rejected").alias("matched_via")
    )
    return alias.unionByName(hits).unionByName(gone)


@query(
    "rescue_pass",
    f"""WITH {R.BM25_SQL.format(where='')}, {R._SIGMA}, mx AS (SELECT query_id, max(sigma) AS x FROM sg GROUP BY 1)
        SELECT item_id AS query_id, coalesce(x, 0) < 0.75 AS rejected, coalesce(x, 0) < 0.75 AND NOT ({R._DUCK_CODE.format(c='text')}) AS rescued,
        CASE WHEN coalesce(x, 0) < 0.75 AND NOT ({R._DUCK_CODE.format(c='text')}) THEN text || chr(10) || chr(10) || lower(text) ELSE text END AS second_query FROM benchmark LEFT JOIN mx ON query_id = item_id""",
)
def rescue_pass(spark, sf_dir, expand=F.lower, bound: float = 0.75):
    """Rejected queries without a code get an expanded second query; ``expand`` stands in for a language model."""
    top = R.pool(spark, sf_dir).groupBy("query_id").agg(F.max("sigma").alias("x"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(top, "query_id", "left")
    rejected = F.coalesce("x", F.lit(0.0)) < bound
    rescued = rejected & ~T.names_code(F.col("text"))
    return items.select("query_id", rejected.alias("rejected"), rescued.alias("rescued"), F.when(rescued, F.concat_ws("\n\n", "text", expand("text"))).otherwise(F.col("text")).alias("second_query"))


@query(
    "chat_context_tier",
    r"""WITH u AS (SELECT conv_id, turn, NOT regexp_matches(text, '[A-Za-z]{2,4}\s?[0-9]{3,4}') AND regexp_matches(text, '(?i)(?:\bthis (?:course|class|one)\b|\bthat (?:course|class|one)\b|\bthe (?:course|class)\b|\bit\b|\bthem\b|\bthese\b|\bboth\b)') AS followup FROM conversations WHERE role = 'user'),
       a AS (SELECT u.conv_id, u.turn, max(c.turn) AS before FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn < u.turn AND c.role = 'assistant' GROUP BY ALL)
       SELECT u.conv_id, u.turn, CASE WHEN followup AND before IS NOT NULL THEN 'context' ELSE 'retrieval' END AS tier, CASE WHEN followup THEN before END AS evidence_turn FROM u LEFT JOIN a USING (conv_id, turn)""",
)
def chat_context_tier(spark, sf_dir):
    """Follow-ups are answered from the last assistant turn before them, all else from retrieval."""
    turns = table(spark, sf_dir, "conversations")
    before = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    rows = turns.withColumn("before", before).filter("role = 'user'").withColumn("followup", T.is_followup(F.col("text")))
    return rows.select(
        "conv_id", "turn", F.when(F.col("followup") & F.col("before").isNotNull(), "context").otherwise("retrieval").alias("tier"), F.when(F.col("followup"), F.col("before")).alias("evidence_turn")
    )


@query(
    "context_membership",
    "WITH g AS (SELECT conv_id, list(turn * 7 ORDER BY turn)[1:5] AS ids FROM conversations GROUP BY 1) SELECT conv_id, i - 1 AS place, ids[i] AS doc_id, 1.0::DOUBLE AS score FROM (SELECT conv_id, ids, unnest(generate_series(1, len(ids))) AS i FROM g) JOIN documents ON doc_id = ids[i]",
)
def context_membership(spark, sf_dir, k: int = 5):
    """The first k given ids in their order, unknown ones left out."""
    ids = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.col("turn") * 7)), 1, k).alias("ids"))
    each = ids.select("conv_id", F.posexplode("ids").alias("place", "doc_id"))
    return each.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("conv_id", "place", "doc_id", F.lit(1.0).alias("score"))


@query(
    "hits_with_fallback_text",
    "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_type END, ''), p_name) AS text FROM part",
)
def hits_with_fallback_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    texts = part.filter("p_size % 4 IN (0, 1)").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type")).alias("raw_text"))
    return part.join(texts, "p_partkey", "left").select("p_partkey", F.coalesce(F.nullif("raw_text", F.lit("")), "p_name").alias("text"))


@query(
    "judged_pool",
    f"""WITH {R.BM25_SQL.format(where='')}, want AS (SELECT item_id AS query_id, doc_id FROM benchmark bm JOIN documents dd ON contains(dd.text, bm.text))
        SELECT query_id, doc_id, min(o) AS origin FROM (SELECT query_id, doc_id, 0 AS o FROM want UNION ALL SELECT query_id, doc_id, rank FROM b WHERE rank <= 5) GROUP BY ALL""",
)
def judged_pool(spark, sf_dir):
    """Expected documents and hits, each once, with the first place it came from (0: expected)."""
    want = R.passage_hits(spark, sf_dir).select("query_id", "doc_id", F.lit(0).alias("o"))
    hits = R.index(spark, sf_dir).top_k(R.questions(spark, sf_dir), 5).select("query_id", "doc_id", F.col("rank").alias("o"))
    return want.unionByName(hits).groupBy("query_id", "doc_id").agg(F.min("o").alias("origin"))


@query(
    "graded_relevance",
    """WITH g AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, (l_quantity::INT % 4) AS grade FROM lineitem), s AS (SELECT query_id, max(doc_id) AS source FROM g GROUP BY 1),
       j AS (SELECT g.*, source FROM g JOIN s USING (query_id)), bad AS (SELECT DISTINCT query_id FROM j WHERE doc_id = source AND grade = 0)
       SELECT query_id, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS relevant FROM j WHERE query_id NOT IN (SELECT query_id FROM bad) AND (grade >= 2 OR (doc_id = source AND grade >= 1)) GROUP BY 1""",
)
def graded_relevance(spark, sf_dir):
    """Relevant: grade 2 or more, and the source from grade 1; a query whose source has grade 0 is dropped."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_quantity").cast("int") % 4).alias("grade"))
    source = g.groupBy("query_id").agg(F.max("doc_id").alias("source"))
    j = g.join(source, "query_id")
    bad = j.filter("doc_id = source AND grade = 0").select("query_id").distinct()
    kept = j.join(bad, "query_id", "left_anti").filter("grade >= 2 OR (doc_id = source AND grade >= 1)")
    return kept.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))), ",").alias("relevant"))
