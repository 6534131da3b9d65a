"""Queries on table states: privacy, inserts, upserts, transitions, migrations, logs. Analogs: customers and orders for
contributors and contributions, events for the query log, parts for records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.functions import values as V
from tessel.operators import privacy, tables
from tessel.plans.registry import literal_rows, over, query
from tessel.session import table

_COOP = """coop AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'company' || (c_custkey % 40) END AS company, CASE c_custkey % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'data' END AS role,
  c_mktsegment AS term, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '50-60' END AS salary, CASE WHEN c_custkey % 7 = 0 THEN 'notes' END AS interview, CASE WHEN c_custkey % 2 = 0 THEN 'graphs' ELSE '' END AS technical FROM customer),
readers AS (SELECT o_custkey AS reader_id, count(*) AS contributions FROM orders GROUP BY 1)"""


def coop(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 11 != 0, F.concat(F.lit("company"), (k % 40).cast("string"))).alias("company"), F.when(k % 3 == 0, "eng").when(k % 3 == 1, "data").alias("role"),
        F.col("c_mktsegment").alias("term"), F.when(k % 5 == 0, "").when(k % 5 == 1, "50-60").alias("salary"), F.when(k % 7 == 0, "notes").alias("interview"), F.when(k % 2 == 0, "graphs").otherwise("").alias("technical"),
    )


def readers(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("reader_id")).agg(F.count("*").alias("contributions"))


@query("k_anonymity", f"WITH {_COOP} SELECT id, count(*) OVER (PARTITION BY company, role, term) AS group_size, count(*) OVER (PARTITION BY company, role, term) >= 2 AS publishable FROM coop")
def k_anonymity(spark, sf_dir):
    return privacy.k_anonymous(coop(spark, sf_dir), ["company", "role", "term"]).select("id", "group_size", "publishable")


@query(
    "k_anon_release",
    f"""WITH {_COOP}, o AS (SELECT id, company, role, term, count(*) OVER w AS n, max(id) OVER w AS last FROM coop WINDOW w AS (PARTITION BY company, role, term))
        SELECT company, role, term, max(n) AS held, CASE WHEN max(n) >= 3 THEN max(last) END AS released_with FROM o GROUP BY ALL""",
)
def k_anon_release(spark, sf_dir, k: int = 3):
    """Held groups and the arrival that completed them (records arrive by id)."""
    g = coop(spark, sf_dir).groupBy("company", "role", "term").agg(F.count("*").alias("held"), F.max("id").alias("last"))
    return g.select("company", "role", "term", "held", F.when(F.col("held") >= k, F.col("last")).alias("released_with"))


_VIS = "CASE WHEN coalesce(salary, '') <> '' THEN 2 WHEN coalesce(interview, '') <> '' OR coalesce(technical, '') <> '' THEN 1 ELSE 0 END"


@query("visibility_derive", f"WITH {_COOP} SELECT id, {_VIS} AS visibility FROM coop")
def visibility_derive(spark, sf_dir):
    return coop(spark, sf_dir).select("id", V.visibility(F.col("salary"), F.col("interview"), F.col("technical")).alias("visibility"))


@query("visibility_filter", f"WITH {_COOP} SELECT id, {_VIS} AS visibility FROM coop LEFT JOIN readers ON reader_id = id WHERE {_VIS} <= coalesce(contributions, 0)")
def visibility_filter(spark, sf_dir):
    rows = coop(spark, sf_dir).select("id", F.col("id").alias("reader_id"), V.visibility(F.col("salary"), F.col("interview"), F.col("technical")).alias("visibility"))
    return privacy.visible_to(rows, readers(spark, sf_dir), "visibility").select("id", "visibility")


@query(
    "tier_redaction",
    f"""WITH {_COOP}, t AS (SELECT *, least(coalesce(contributions, 0), 2) AS tier FROM coop LEFT JOIN readers ON reader_id = id)
        SELECT id, CASE WHEN tier >= 1 THEN interview END AS interview, CASE WHEN tier >= 1 THEN technical END AS technical, CASE WHEN tier >= 2 THEN salary END AS salary FROM t""",
)
def tier_redaction(spark, sf_dir):
    rows = coop(spark, sf_dir).join(readers(spark, sf_dir), F.col("id") == F.col("reader_id"), "left")
    shown = privacy.redact_by_tier(F.col("contributions"), {"interview": 1, "technical": 1, "salary": 2})
    return rows.select("id", *[c.alias(k) for k, c in shown.items()])


_UP = """old AS (SELECT p_partkey AS id, p_name AS name, p_brand AS raw_text, 'indexed' AS status, p_size AS version FROM part WHERE p_partkey % 3 <> 0),
new AS (SELECT p_partkey AS id, upper(p_name) AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS raw_text FROM part WHERE p_partkey % 2 = 0)"""


def states(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("raw_text"), F.lit("indexed").alias("status"), F.col("p_size").alias("version"))
    new = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("raw_text"))
    return old, new


@query(
    "upsert_coalesce",
    f"""WITH {_UP} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN o.raw_text ELSE coalesce(n.raw_text, o.raw_text) END AS raw_text,
        CASE WHEN n.id IS NULL THEN o.status ELSE 'pending' END AS status, o.version FROM old o FULL JOIN new n USING (id)""",
)
def upsert_coalesce(spark, sf_dir):
    old, new = states(spark, sf_dir)
    return tables.upsert(old, new, "id", keep_if_null=("raw_text",), fixed={"status": F.lit("pending")})


@query("upsert_overwrite", f"WITH {_UP} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, coalesce(o.version, -1) AS version FROM old o FULL JOIN new n USING (id)")
def upsert_overwrite(spark, sf_dir):
    old, new = states(spark, sf_dir)
    out = tables.upsert(old.select("id", "name", "version"), new.select("id", "name", F.lit(-1).alias("version")), "id", untouched=("version",))
    return out


_INS = """old AS (SELECT p_brand AS alias, p_size AS target, min(p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
new AS (SELECT p_brand AS alias, p_size AS target, p_partkey AS id FROM part WHERE p_partkey % 2 = 1)"""


@query("insert_or_ignore", f"WITH {_INS} SELECT alias, target, id FROM old UNION ALL SELECT alias, target, min(id) FROM new WHERE NOT EXISTS (FROM old o WHERE o.alias = new.alias AND o.target = new.target) GROUP BY ALL")
def insert_or_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("alias"), F.col("p_size").alias("target"), F.col("p_partkey").alias("id"))
    old = rows.filter("id % 2 = 0").groupBy("alias", "target").agg(F.min("id").alias("id"))
    return tables.insert_or_ignore(old, rows.filter("id % 2 = 1"), ["alias", "target"], ["id"])


_TR = """r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'indexed' ELSE 'failed' END AS status FROM orders),
w AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'indexed' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' END AS to_status FROM orders WHERE o_orderkey % 5 <> 0)"""


@query(
    "state_transition",
    f"""WITH {_TR}, j AS (SELECT r.id, status, to_status, coalesce((status = 'pending' AND to_status IN ('indexed', 'failed')) OR (status = 'failed' AND to_status = 'pending'), false) AS ok FROM r LEFT JOIN w USING (id))
        SELECT id, CASE WHEN ok THEN to_status ELSE status END AS status, CASE WHEN to_status IS NOT NULL AND NOT ok THEN 'invalid transition' END AS error FROM j""",
)
def state_transition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "indexed").otherwise("failed").alias("status"))
    to = F.when(F.col("id") % 4 == 0, "indexed").when(F.col("id") % 4 == 1, "failed").when(F.col("id") % 4 == 2, "pending")
    wanted = rows.filter("id % 5 <> 0").select("id", to.alias("to_status"))
    return tables.transition(rows, wanted, "id", {"indexed": "pending", "failed": "pending", "pending": "failed"})


@query("bulk_transition", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(trim(coalesce(text, ''))) > 0 THEN 'indexed' WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'failed' END AS status FROM documents")
def bulk_transition(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("failed").alias("status"))
    ready = (F.col("status") == "pending") & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return rows.select("doc_id", F.when(ready, "indexed").otherwise(F.col("status")).alias("status"))


@query("schema_migrate", "SELECT p_partkey, coalesce(p_brand, '') AS p_brand, '1.1' AS schema_version, 0 AS difficulty, p_size < 25 AS migrated FROM part")
def schema_migrate(spark, sf_dir):
    """Old rows (sizes under 25) lack the version; both kinds come out with all columns."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") >= 25, "1.1").alias("schema_version"), (F.col("p_size") < 25).alias("migrated"))
    return tables.with_columns(part, {"schema_version": F.lit("1.1"), "difficulty": F.lit(0), "p_brand": F.lit("")}).select("p_partkey", "p_brand", "schema_version", "difficulty", "migrated")


@query("migration_counts", "SELECT count(*) FILTER (WHERE p_size >= 25) AS already_current, count(*) FILTER (WHERE p_size < 25) AS migrated, 0 AS errors FROM part")
def migration_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count_if(F.col("p_size") >= 25).alias("already_current"), F.count_if(F.col("p_size") < 25).alias("migrated"), F.count_if(F.col("p_size").isNull()).cast("int").alias("errors"))


@query("soft_delete_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def soft_delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.delete_cascade(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("delete_set_null", "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")
def delete_set_null(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    return tables.delete_set_null(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


@query("counter_increment", "SELECT c_custkey, c_nationkey + coalesce(n, 0) AS contribution_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def counter_increment(spark, sf_dir):
    added = readers(spark, sf_dir)
    return table(spark, sf_dir, "customer").join(added, F.col("c_custkey") == F.col("reader_id"), "left").select("c_custkey", (F.col("c_nationkey") + F.coalesce("contributions", F.lit(0))).alias("contribution_count"))


@query("query_log_export", "SELECT event_id, to_json({'user_id': user_id, 'route': event_type, 'latency_ms': value}) AS line FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def query_log_export(spark, sf_dir):
    return (
        table(spark, sf_dir, "events").filter(F.col("ts") >= F.to_timestamp(F.lit("2024-01-15")))
        .select("event_id", F.to_json(F.struct("user_id", F.col("event_type").alias("route"), F.col("value").alias("latency_ms"))).alias("line"))
    )


@query("organic_filter", "SELECT event_type, count(*) AS n FROM (SELECT *, CASE WHEN user_id % 4 = 0 THEN 'eval:' || user_id WHEN user_id % 4 = 1 THEN user_id::VARCHAR END AS tag FROM events) WHERE tag IS NULL GROUP BY 1")
def organic_filter(spark, sf_dir):
    tag = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("eval:"), F.col("user_id").cast("string"))).when(F.col("user_id") % 4 == 1, F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").withColumn("tag", tag).filter("tag IS NULL").groupBy("event_type").agg(F.count("*").alias("n"))


@query("retention", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events ORDER BY 1 DESC LIMIT 14")
def retention(spark, sf_dir):
    """The newest 14 daily snapshots."""
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return tables.keep_newest(days, "day", 14)


@query("pending_age", "SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def pending_age(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = e.agg(F.min("event_type").alias("first_type"), F.max("ts").alias("now"))
    return e.join(F.broadcast(at), (F.col("event_type") == F.col("first_type")) & (F.col("ts") < F.col("now") - F.expr("INTERVAL 24 HOURS"))).select("event_id")


@query(
    "record_diff",
    """WITH l AS (SELECT p_partkey, p_name, p_brand FROM part), r AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_name) END AS p_name, p_type FROM part WHERE p_partkey % 10 <> 0),
       a AS (SELECT p_partkey, unnest(['p_name', 'p_brand']) AS field, unnest([p_name, p_brand]) AS left_value FROM l), b AS (SELECT p_partkey, unnest(['p_name', 'p_type']) AS field, unnest([p_name, p_type]) AS right_value FROM r)
       SELECT p_partkey, field, left_value IS NOT DISTINCT FROM right_value AS equal FROM a FULL JOIN b USING (p_partkey, field)""",
)
def record_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    right = part.filter("p_partkey % 10 <> 0").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("p_name"), "p_type")
    return tables.diff(part.select("p_partkey", "p_name", "p_brand"), right, "p_partkey").select("p_partkey", "field", "equal")


@query("soft_field_evidence", "SELECT p_partkey, p_size % 2 = 0 OR p_size % 3 = 0 AS valid FROM part")
def soft_field_evidence(spark, sf_dir):
    """A populated soft field (odd sizes have one) needs a snippet that names it (sizes divisible by 3 have it)."""
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 2 == 1, F.col("p_type")).alias("topic"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.struct(F.lit("topic").alias("field")))).otherwise(F.array(F.struct(F.lit("other").alias("field")))).alias("evidence"),
    )
    named = F.exists("evidence", lambda e: e["field"] == "topic")
    return rows.select("p_partkey", (F.col("topic").isNull() | named).alias("valid"))


@query("interval_rules", "SELECT l_orderkey, l_linenumber, l_shipdate >= o_orderdate AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def interval_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", (F.col("l_shipdate") >= F.col("o_orderdate")).alias("ordered"))


@query("unique_violations", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


@query("audit_string", "SELECT p_partkey, 'reviewed_by=' || p_brand || ' | redacted=' || p_size || ' | bucketed=' || (p_size > 10)::VARCHAR AS audit FROM part")
def audit_string(spark, sf_dir):
    parts = {"reviewed_by": F.col("p_brand"), "redacted": F.col("p_size").cast("string"), "bucketed": (F.col("p_size") > 10).cast("string")}
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" | ", *[F.concat(F.lit(k + "="), v) for k, v in parts.items()]).alias("audit"))


_EXP = literal_rows([(1, "graphs|trees", " bfs |", "图"), (2, None, None, None), (3, "", "dfs", None)], "id, queries, keywords, zh")


_EXP_ALL = f"(SELECT cast(id AS bigint) AS id, queries, keywords, cast(zh AS varchar(99)) AS zh FROM {_EXP} UNION ALL SELECT 1000 + p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE replace(p_name, ' ', ' | ') END, CASE WHEN p_size % 3 = 0 THEN p_type || '| ' WHEN p_size % 3 = 1 THEN '' END, CASE WHEN p_size % 5 = 0 THEN ' 图 ' END FROM part) AS t(id, queries, keywords, zh)"


@query("expansion_text", rf"SELECT * FROM (SELECT id, array_to_string(list_filter(list_transform(list_concat(coalesce(string_split(queries, '|'), []), coalesce(string_split(keywords, '|'), []), CASE WHEN zh IS NULL THEN [] ELSE [zh] END), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS expansion FROM {_EXP_ALL}) WHERE expansion <> ''")
def expansion_text(spark, sf_dir):
    """Generated texts in one field, trimmed, blanks left out; rows without any are skipped."""
    none = F.array().cast("array<string>")
    split = lambda c: F.coalesce(F.split(c, r"\|"), none)
    parts = F.concat(split(F.col("queries")), split(F.col("keywords")), F.coalesce(F.array("zh"), none))
    text = F.array_join(F.filter(F.transform(F.filter(parts, lambda x: x.isNotNull()), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    return over(spark, sf_dir, "part", _EXP_ALL).select("id", text.alias("expansion")).filter("expansion <> ''")


_PAIRS = """WITH g AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS x FROM lineitem), k AS (SELECT g FROM g GROUP BY g HAVING count(*) >= 3), r AS (SELECT g.* FROM g JOIN k USING (g))
SELECT a.x AS part_a, b.x AS part_b, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.x < b.x GROUP BY ALL HAVING count(*) >= 2"""


@query("pair_overlap", "SELECT shared, count(*) AS pairs, sum(part_a) AS sum_a, sum(part_b) AS sum_b FROM (" + _PAIRS + ") GROUP BY shared")
def pair_overlap(spark, sf_dir):
    """Of all pairs that share two groups of three members or more: how many share how many."""
    by = pair_overlap_whole(spark, sf_dir).groupBy("shared")
    return by.agg(F.count("*").alias("pairs"), F.sum("part_a").alias("sum_a"), F.sum("part_b").alias("sum_b"))


@query("pair_overlap_whole", _PAIRS)
def pair_overlap_whole(spark, sf_dir):
    """Pairs that share two groups of three members or more, over all rows."""
    pairs = tables.shared_pairs(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", least=2, k=3)
    return pairs.withColumnsRenamed({"a": "part_a", "b": "part_b"})
