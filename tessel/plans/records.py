"""Queries on records: strict inserts, status updates, vector tables, index rebuilds, request and record validation, choices
among configurations and generated queries. Parts stand in for records, events for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import tables
from tessel.operators.lexical import LexicalIndex
from tessel.operators.stored import VectorTable, upsert_partitions
from tessel.operators.rescue import LEAST_P, reranked, rescue
from tessel.plans import retrieval as R
from tessel.plans.catalog import hard_filters
from tessel.plans.registry import literal_rows, over, query
from tessel.session import keep_until_exit, settle, shared_path, table


@query(
    "insert_strict",
    """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN 'indexed' ELSE 'pending' END AS status,
       CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 'duplicate key' END AS error FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""",
)
def insert_strict(spark, sf_dir):
    """New rows come in as pending; one whose key is taken changes nothing and is reported."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    old = part.filter("id % 3 <> 0").withColumn("status", F.lit("indexed"))
    new = part.filter("id % 2 = 0").withColumn("status", F.lit("approved"))
    return tables.insert_strict(old, new, "id", {"status": F.lit("pending")})


@query(
    "review_status_update",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'approved' ELSE 'pending' END AS status, NULL::VARCHAR AS error FROM part
       UNION ALL SELECT -1 - p_partkey, NULL, 'unknown id' FROM part WHERE p_partkey % 100 = 0""",
)
def review_status_update(spark, sf_dir):
    """Any status to any other; ids that don't exist are reported."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("pending").alias("status"))
    wanted = rows.filter("id % 4 = 0").select("id", F.lit("approved").alias("to_status"))
    wanted = wanted.unionByName(rows.filter("id % 100 = 0").select((-1 - F.col("id")).alias("id"), F.lit("rejected").alias("to_status")))
    return tables.update_any(rows, wanted, "id", "status")


@query(
    "vector_table_add",
    """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 63 ELSE 64 END AS dim FROM embeddings)
       SELECT vec_id AS id, 64 AS dim, NULL::VARCHAR AS error FROM embeddings WHERE vec_id % 2 = 0
       UNION ALL SELECT vec_id, dim, CASE WHEN dim <> 64 THEN 'dimension' WHEN vec_id % 2 = 0 THEN 'duplicate id' END FROM e WHERE vec_id % 3 = 0""",
)
def vector_table_add(spark, sf_dir):
    """Vectors of the table's length and a new id are added, the others reported."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    new = v.filter("id % 3 = 0").withColumn("vec", F.when(F.col("id") % 7 == 0, F.slice("vec", 1, 63)).otherwise(F.col("vec")))
    return tables.add_vectors(v.filter("id % 2 = 0"), new, 64).select("id", F.size("vec").alias("dim"), "error")


@query("vector_table_remove", "SELECT vec_id AS id FROM embeddings WHERE label <> 0")
def vector_table_remove(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    gone = v.filter("label = 0").select(F.col("vec_id").alias("id"))
    return tables.delete_cascade(v.select(F.col("vec_id").alias("id")), gone, "id")


@query(
    "vector_table_ids",
    """SELECT count(*) FILTER (WHERE vec_id % 2 = 1 OR label <> 0) AS vectors, count(*) FILTER (WHERE vec_id % 2 = 1 OR label <> 0) AS ids, count(*) FILTER (WHERE vec_id % 2 = 0 AND label = 0) AS removed,
       count(*) + count(*) FILTER (WHERE vec_id % 2 = 0 AND label = 0 AND vec_id % 4 = 0) AS next_id, count(*) FILTER (WHERE vec_id % 2 = 0 AND label = 0 AND vec_id % 4 = 0) AS again FROM embeddings""",
)
def vector_table_ids(spark, sf_dir):
    """A stored table of vectors: half of them added, some removed, the rest and some of those removed added again; ids are new ones each time."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    path = shared_path(spark, "vector-table")
    keep_until_exit(spark, path)
    held = VectorTable(spark, path, v.select(F.size("vec")).first()[0])
    held.add(v.filter("id % 2 = 0"))
    removed = held.remove(v.filter("label = 0").select("id"))
    held.add(v.filter("id % 2 = 1"))
    held = VectorTable.load(spark, path)
    back = v.filter("id % 2 = 0 and label = 0 and id % 4 = 0")
    again = held.add(back)
    held.remove(back.select("id"))
    return held.rows.agg(F.count("*").alias("vectors"), F.count_distinct("int_id").alias("ids")).select("vectors", "ids", F.lit(removed).cast("long").alias("removed"), F.lit(held.next_id).cast("long").alias("next_id"), F.lit(again).cast("long").alias("again"))


@query(
    "partition_upsert",
    """WITH n AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS p, o_totalprice AS was FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0),
       i AS (SELECT count(*) AS n, sum(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0)
       SELECT (SELECT n FROM i) AS inserted, count(*) FILTER (WHERE p <> was) AS updated, count(*) FILTER (WHERE p = was) AS same, true AS as_planned, (SELECT count(*) FROM orders) + (SELECT n FROM i) AS rows,
       round((SELECT sum(o_totalprice) FROM orders) + coalesce((SELECT p FROM i), 0) + sum(p - was), 2) AS total FROM n""",
)
def partition_upsert(spark, sf_dir):
    """An upsert into a stored table in folders by status, first as a dry run, which counts what the write then does."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = shared_path(spark, "orders-by-status")
    keep_until_exit(spark, path)
    orders.write.partitionBy("o_orderstatus").parquet(path)
    finished = orders.filter("o_orderstatus = 'F'")
    new = finished.filter("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0))
    new = new.unionByName(finished.filter("o_orderkey % 7 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    planned = upsert_partitions(spark, path, new, "o_orderkey", "o_orderstatus", dry_run=True)
    done = upsert_partitions(spark, path, new, "o_orderkey", "o_orderstatus")
    after = spark.read.parquet(path).agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return after.select(*[F.lit(done[c]).cast("long").alias(c) for c in ("inserted", "updated", "same")], F.lit(planned == done).alias("as_planned"), "rows", "total")


@query(
    "index_rebuild",
    f"""WITH r AS (SELECT *, {R.duck_tokens('text')} AS t FROM documents WHERE lang IN ('en', 'de')), f AS (SELECT * FROM r WHERE length(trim(coalesce(text, ''))) > 0)
       SELECT (SELECT count(*) FROM r) AS seen, count(*) AS indexed, (SELECT count(*) FROM r) - count(*) AS skipped, min(doc_id) AS first_id, sum(greatest(len(t), 1))::BIGINT AS tokens,
       (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM f UNION ALL SELECT '__empty__' FROM f WHERE len(t) = 0)) AS terms FROM f""",
)
def index_rebuild(spark, sf_dir):
    """A new index of the rows of some status, blank ones skipped: what it took in, read from the index itself."""
    rows = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de"))
    full = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    index = LexicalIndex.build(rows.filter(full), shared_path(spark, "rebuilt-index"))
    keep_until_exit(spark, index.path)
    held = index.table("documents").agg(F.count("*").alias("indexed"), F.min("doc_id").alias("first_id"), F.sum("length").alias("tokens"))
    terms = index.term_stats().agg(F.count("*").alias("terms"))
    counts = rows.agg(F.count("*").alias("seen"), F.count_if(~full).alias("skipped"))
    return counts.join(F.broadcast(held)).join(F.broadcast(terms))  # one row each


@query(
    "dry_run_plan",
    """SELECT 'insert' AS action, count(*) AS n FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0 UNION ALL SELECT 'update', count(*) FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND p_name <> upper(p_name)
       UNION ALL SELECT 'same', count(*) FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND p_name = upper(p_name)""",
)
def dry_run_plan(spark, sf_dir):
    """What an upsert would do, counted without writing."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("new_name"))
    kind = F.when(F.col("name").isNull(), "insert").when(F.col("name") == F.col("new_name"), "same").otherwise("update")
    counts = new.join(old, "id", "left").groupBy(kind.alias("action")).agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([("insert",), ("update",), ("same",)], "action string")
    return kinds.join(counts, "action", "left").fillna(0, ["n"])


_REQUESTS = literal_rows([(1, "graphs", 5, "search", "{}"), (2, "", 5, "search", "{}"), (3, "x" * 501, 5, "search", "{}"), (4, "ml", 51, "search", "{}"), (5, "ml", 21, "chat", "{}"), (6, "ml", 20, "chat", '{"credits": 13}'), (7, "ml", 1, "chat", '{"credits": 12, "page": 2}'), (8, None, 3, "search", "{}"), (9, "ok", 50, "browse", "{}")], "id, query, k, route, filters")


# turns as requests: the text asks, places and roles give the rest
_ALL_REQUESTS = f"""(SELECT cast(id AS bigint) AS id, query, k, route, filters FROM {_REQUESTS} UNION ALL SELECT 1000 + conv_id * 1000 + turn, CASE WHEN conv_id % 9 = 0 THEN '' ELSE text END, cast((conv_id * 7 + turn * 11) % 60 AS int), CASE role WHEN 'user' THEN 'search' WHEN 'assistant' THEN 'chat' ELSE role END,
CASE conv_id % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"credits": 13}}' WHEN 2 THEN '{{"credits": 4, "term": "fall"}}' ELSE '{{"credits": 12, "page": 2}}' END FROM conversations) AS t(id, query, k, route, filters)"""


@query(
    "request_errors",
    f"""WITH r AS (SELECT *, TRY_CAST(json_extract_string(filters, '$.credits') AS DOUBLE) AS c FROM {_ALL_REQUESTS})
       SELECT id, 'query' AS error FROM r WHERE query IS NULL OR length(query) NOT BETWEEN 1 AND 500 UNION ALL SELECT id, 'k' FROM r WHERE k < 1 OR k > CASE WHEN route = 'chat' THEN 20 ELSE 50 END
       UNION ALL SELECT id, 'route' FROM r WHERE route NOT IN ('search', 'chat') UNION ALL SELECT id, 'credits' FROM r WHERE c < 0 OR c > 12
       UNION ALL SELECT id, 'unknown key' FROM r WHERE len(list_filter(json_keys(filters), lambda x: x NOT IN ('credits', 'term'))) > 0""",
)
def request_errors(spark, sf_dir):
    """Bounds, enumerations and unknown keys of requests; a row per fault."""
    rows = over(spark, sf_dir, "conversations", _ALL_REQUESTS)
    credits = F.get_json_object("filters", "$.credits").try_cast("double")
    most = F.when(F.col("route") == "chat", 20).otherwise(50)
    faults = {
        "query": ~F.coalesce(F.length("query").between(1, 500), F.lit(False)), "k": ~F.col("k").between(F.lit(1), most), "route": ~F.col("route").isin("search", "chat"),
        "credits": F.coalesce(~credits.between(0, 12), F.lit(False)), "unknown key": F.size(F.array_except(F.json_object_keys("filters"), F.array(F.lit("credits"), F.lit("term")))) > 0,
    }
    found = F.filter(F.array(*[F.when(c, k) for k, c in faults.items()]), lambda x: x.isNotNull())
    return rows.select("id", F.explode(found).alias("error"))


@query("hard_filter_null", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = NULL")
def hard_filter_null(spark, sf_dir):
    """A filter given as null equals nothing; one that isn't given doesn't restrict."""
    return hard_filters(table(spark, sf_dir, "documents"), {"lang": "en", "source": None}).select("doc_id")


@query("global_counts", "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM events) AS queries")
def global_counts(spark, sf_dir):
    users = table(spark, sf_dir, "customer").agg(F.count("*").alias("users"))
    return users.join(F.broadcast(table(spark, sf_dir, "events").agg(F.count("*").alias("queries"))))  # one row each


@query("referenced_ids", "SELECT l_partkey AS id FROM lineitem UNION SELECT p_partkey FROM part WHERE p_size > 45")
def referenced_ids(spark, sf_dir):
    """Ids named in either place, once."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return a.unionByName(table(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_partkey").alias("id"))).distinct()


@query("score_gap", "SELECT round(min(value) FILTER (WHERE event_type <> 'view') - max(value) FILTER (WHERE event_type = 'view'), 6) AS gap FROM events")
def score_gap(spark, sf_dir):
    """The least score of one kind over the greatest of another."""
    kind = F.col("event_type") == "view"
    return table(spark, sf_dir, "events").agg(F.round(F.min(F.when(~kind, F.col("value"))) - F.max(F.when(kind, F.col("value"))), 6).alias("gap"))


@query("best_configuration", "SELECT p_brand AS config, avg(p_size) AS recall, avg(p_retailprice) AS mrr FROM part GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1")
def best_configuration(spark, sf_dir):
    """The configuration of greatest recall, then reciprocal rank."""
    by = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("config")).agg(F.avg("p_size").alias("recall"), F.avg("p_retailprice").alias("mrr"))
    return by.orderBy(F.desc("recall"), F.desc("mrr"), "config").limit(1)


@query(
    "informative_tokens",
    """SELECT doc_id, array_to_string(list_filter(x, lambda t, i: (i - 1) % greatest(len(x) // 4, 1) = 0)[1:4], ' ') AS picks FROM
       (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: length(t) > 4)[4:] AS x FROM documents)""",
)
def informative_tokens(spark, sf_dir, n: int = 4):
    """Words of over four characters but the first three, n of them at even steps."""
    words = F.filter(F.split("text", r"\s+"), lambda t: F.length(t) > 4)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.slice(words, 4, F.greatest(F.size(words), F.lit(1))).alias("x"))
    stride = F.greatest(F.floor(F.size("x") / n), F.lit(1))
    return rows.select("doc_id", F.array_join(F.slice(F.filter("x", lambda t, i: i % stride == 0), 1, n), " ").alias("picks"))


@query(
    "generated_query_pruning",
    r"""WITH g AS (SELECT d.doc_id, d.text, i AS pos, CASE WHEN i = 1 THEN left(d.text, 60) ELSE b.text END AS q FROM documents d JOIN benchmark b ON b.item_id = d.doc_id, (VALUES (1), (2)) t(i)),
       w AS (SELECT doc_id, pos, q, list_filter(list_distinct(regexp_split_to_array(lower(q), '\s+')), lambda x: x <> '') AS qw, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS dw FROM g)
       SELECT doc_id, md5(string_agg(q, chr(10) ORDER BY pos)) AS kept_md5, count(*) AS kept FROM w WHERE len(list_intersect(qw, dw)) / greatest(len(qw), 1)::DOUBLE >= 0.2 GROUP BY 1""",
)
def generated_query_pruning(spark, sf_dir, rerank=T.overlap, least: float = 0.2):
    """Generated queries stay if the reranker scores them ``least`` or more against their own document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("other"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(items, "doc_id")
    each = docs.select("doc_id", "text", F.posexplode(F.array(F.left("text", F.lit(60)), "other")).alias("pos", "q")).filter(rerank(F.col("q"), F.col("text")) >= least)
    kept = F.array_sort(F.collect_list(F.struct("pos", "q")))
    return each.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(kept, lambda x: x["q"]), "\n")).alias("kept_md5"), F.count("*").alias("kept"))


# user turns with all words but the first one spelt backwards, which the expansion puts right; short ones get none
_MISSPELT = "array_to_string(list_transform(regexp_split_to_array(text, '\\s+'), lambda w, i: CASE WHEN i = 1 THEN w ELSE reverse(w) END), ' ')"
_ASKED = f"asked AS (SELECT conv_id * 1000 + turn AS item_id, {_MISSPELT} AS text FROM conversations WHERE role = 'user')"
_RIGHT = _MISSPELT.replace("text,", "asked.text,")
_GATED = f"""{R.BM25_SQL.format(where='').replace('FROM benchmark)', 'FROM asked)')}, {R._SIGMA.replace('benchmark', 'asked')},
g AS (SELECT item_id AS query_id, text, least(greatest(coalesce((SELECT max(sigma) FROM sg WHERE sg.query_id = item_id), 0), 1e-6), 1 - 1e-6)::DOUBLE AS x,
     coalesce((SELECT max(score) FROM b WHERE b.query_id = item_id AND rank <= 20), 0)::DOUBLE AS bt, ({R._DUCK_CODE.format(c='text')})::INT AS code, ({R._DUCK_CJK.format(c='text')})::INT AS cjk FROM asked),
gp AS (SELECT query_id, text, code, round(1 / (1 + exp(-(-1.6277::DOUBLE + 0.5944::DOUBLE * ln(x / (1 - x)) + 0.7822::DOUBLE * ln(1 + greatest(bt, 0)) * (1 - cjk) - 3.4026::DOUBLE * code + 1.7244::DOUBLE * cjk))), 8) AS p FROM g)"""


def _misspelt(query):
    return F.array_join(F.transform(F.split(query, r"\s+"), lambda w, i: F.when(i == 0, w).otherwise(F.reverse(w))), " ")


def _expansion(query):
    """The stand-in of a language model: the words spelt right, nothing for queries of fewer than four words."""
    return F.when(F.size(F.split(query, r"\s+")) >= 4, _misspelt(query))


def gated_turns(spark, sf_dir, rerank=T.overlap):
    """(query_id, query, p) of misspelt user turns: the calibrated gate on the first 20 by BM25."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), _misspelt(F.col("text")).alias("query"))
    found = R.index(spark, sf_dir).top_k(R.bm25.queries_of(asked, "query", "query_id"), 20)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tops = reranked(found.select("query_id", "doc_id", "score"), asked, docs, rerank).groupBy("query_id").agg(F.max("sigma").alias("x"), F.max("score").alias("bt"))
    zero = F.lit(0.0)
    p = R.fusion.p_answerable(F.coalesce("x", zero), F.coalesce("bt", zero), zero, T.names_code(F.col("query")), T.cjk_dominant(F.col("query")))
    return asked.join(tops, "query_id", "left").select("query_id", "query", p.alias("p"))


@query("rescue_gate", f"WITH {_ASKED}, {_GATED} SELECT query_id, round(p, 6) AS p, p < 0.4 AS rejected, p < 0.4 AND p >= 0.08 AND code = 0 AND len(regexp_split_to_array(text, '\\s+')) >= 4 AS rescued FROM gp")
def rescue_gate(spark, sf_dir):
    """Which queries the gate rejects, and which of those get a second pass."""
    p = F.col("p")
    rejected = p < R.fusion.REJECT_BELOW
    rescued = rejected & (p >= LEAST_P) & ~T.names_code(F.col("query")) & _expansion(F.col("query")).isNotNull()
    return gated_turns(spark, sf_dir).select("query_id", F.round("p", 6).alias("p"), rejected.alias("rejected"), rescued.alias("rescued"))


@query(
    "rescue_search",
    f"""WITH {_ASKED}, {_GATED},
       r AS (SELECT query_id, asked.text || chr(10) || chr(10) || {_RIGHT} AS text FROM gp JOIN asked ON query_id = item_id WHERE p < 0.4 AND p >= 0.08 AND code = 0 AND len(regexp_split_to_array(asked.text, '\\s+')) >= 4),
       b2 AS (SELECT q2.query_id, p.doc_id, round(sum(times2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / (SELECT avg(len(toks)) FROM d)))), 8) AS score
              FROM (SELECT query_id, term, count(*) AS times2 FROM (SELECT query_id, unnest({R.duck_tokens('text')}) AS term FROM r) GROUP BY ALL) q2 JOIN p USING (term) JOIN idf USING (term) JOIN d USING (doc_id) GROUP BY ALL),
       k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b2),
       s2 AS (SELECT query_id, doc_id, score, len(list_intersect(qw, dw)) / greatest(len(qw), 1)::DOUBLE AS sigma FROM (SELECT k2.*, {R._DUCK_WORDS.format(c='asked.text')} AS qw, {R._DUCK_WORDS.format(c='documents.text')} AS dw
              FROM k2 JOIN asked ON query_id = item_id JOIN documents USING (doc_id) WHERE rank <= 20)),
       bl2 AS (SELECT query_id, doc_id, round(0.4::DOUBLE * {R._Z.format(c='score')} + (1 - 0.4::DOUBLE) * {R._Z.format(c='sigma')}, 8) AS blended FROM s2 WINDOW w AS (PARTITION BY query_id))
       SELECT query_id, doc_id, round(blended, 6) AS blended, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, doc_id) AS rank FROM bl2) WHERE rank <= 5""",
)
def rescue_search(spark, sf_dir, expand=_expansion, rerank=T.overlap):
    """The second pass of queries that the gate rejects without being sure, on the expanded text; these queries have no vectors."""
    index = R.index(spark, sf_dir)
    search = lambda q: index.top_k(R.bm25.queries_of(q, "query", "query_id"), 20)
    gated = settle(gated_turns(spark, sf_dir, rerank), "gated")
    out = rescue(gated, search, table(spark, sf_dir, "documents").select("doc_id", "text"), expand, rerank)
    return out.withColumn("blended", F.round("blended", 6))
