"""Queries on single values and records: parsing, formatting, validation. Their inputs are the tables' texts, parts and orders, with
literal cases besides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import values as V
from tessel.operators import tables
from tessel.plans.registry import and_texts, and_texts_sql, literal_rows, over, query
from tessel.session import table

_TITLES = literal_rows([(1, "GEO 4107.  Rivers and Their Valleys.  (3 Hours)"), (2, "CS5800. Algorithms. (4 Hours)"), (3, "DS 5220. Supervised ML. (1.5 Hour)"), (4, "not a title"), (5, "BINF 6200A. Methods. Part 2. (0 Hours)")], "id, t")
# The pattern of a catalog title.
_TITLE = r"^([A-Z]{2,4})\s?([0-9]{4}[A-Z]?)\.\s+(.+?)\.\s+\(([0-9.]+)\s*Hours?\)\s*$"


_TITLES_ALL = f"(SELECT cast(id AS bigint) AS id, t FROM {_TITLES} UNION ALL SELECT 1000 + p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE 'PT ' || lpad(cast(p_partkey % 10000 AS varchar(9)), 4, '0') || '.  ' || p_name || '. ' || p_type || '.  (' || cast(p_size AS varchar(9)) || CASE WHEN p_partkey % 3 = 0 THEN '.5' ELSE '' END || ' Hours)' END FROM part) AS t(id, t)"


@query(
    "title_parse",
    rf"SELECT id, regexp_extract(t, '{_TITLE}', 1) || ' ' || regexp_extract(t, '{_TITLE}', 2) AS code, regexp_extract(t, '{_TITLE}', 3) AS name, CASE WHEN regexp_extract(t, '{_TITLE}', 4)::DOUBLE = floor(regexp_extract(t, '{_TITLE}', 4)::DOUBLE) THEN regexp_extract(t, '{_TITLE}', 4)::DOUBLE::INT END AS credits FROM {_TITLES_ALL} WHERE regexp_matches(t, '{_TITLE}')",
)
def title_parse(spark, sf_dir):
    part = lambda i: F.regexp_extract("t", _TITLE, i)
    rows = over(spark, sf_dir, "part", _TITLES_ALL).filter(F.col("t").rlike(_TITLE))
    return rows.select("id", F.concat_ws(" ", part(1), part(2)).alias("code"), part(3).alias("name"), V.whole_credits(part(4)).alias("credits"))


_CROSS = literal_rows([(1, "CS 5800 and DS 5800 are cross-listed. AAI6600 and CS 6600 are crosslisted"), (2, "nothing"), (3, "cs 1000 AND ds 2000 are cross-listed")], "id, t")
# The pattern of a cross-listing.
_PAIR = r"\b([A-Z]{2,4})\s?([0-9]{4}[A-Z]?)\s+and\s+([A-Z]{2,4})\s?([0-9]{4}[A-Z]?)\s+are\s+cross-?listed"


@query(
    "cross_listed",
    rf"SELECT id, upper(a[i]) || ' ' || upper(b[i]) AS code_a, upper(c[i]) || ' ' || upper(d[i]) AS code_b FROM (SELECT *, unnest(generate_series(1, len(a))) AS i FROM (SELECT id, "
    + ", ".join(rf"regexp_extract_all(t, '(?i){_PAIR}', {i}) AS {c}" for i, c in enumerate("abcd", 1))
    + f" FROM {and_texts_sql(_CROSS, 't')}))",
)
def cross_listed(spark, sf_dir):
    groups = [F.regexp_extract_all("t", F.lit(f"(?i){_PAIR}"), i).alias(c) for i, c in enumerate("abcd", 1)]
    rows = and_texts(spark, sf_dir, _CROSS, "t").select("id", F.explode(F.arrays_zip(*groups)).alias("m"))
    code = lambda x, y: F.concat_ws(" ", F.upper(F.col(f"m.{x}")), F.upper(F.col(f"m.{y}")))
    return rows.select("id", code("a", "b").alias("code_a"), code("c", "d").alias("code_b"))


_SYLLABUS = literal_rows([(1, "CS 5800 Algorithms\nSpring 2026\nCredit hours: 3\nInstructor: Dr. Ada Lovelace"), (2, "AAI6600 summer II 2025, 4 credits"), (3, "no facts"), (4, "Professor: Alan M. Turing\nFALL 2024"), (5, "Full name: Mary O'Brien-Lee\n12 credits")], "id, t")
# Patterns of term, credits and instructor.
_TERM = r"\b(Spring|Summer(?:\s+[I]{1,2})?|Fall|Winter)\s+([0-9]{4})\b"
_CREDITS = r"(?:Credit\s+hours?|Credits?)\s*[:=]?\s*([0-9]{1,2})\b|\b([0-9]{1,2})\s+credits?\b"
_TEACHER = r"(?:Instructor|Full\s+name|Professor)\s*[:=]\s*([A-Z][A-Za-z.'\-]+(?:[ \t]+[A-Z][A-Za-z.'\-]+)+)"


_TEACHER_SQL = _TEACHER.replace("'", "''")


@query(
    "syllabus_guess",
    rf"""WITH r AS (SELECT id, left(t, 2000) AS t FROM {and_texts_sql(_SYLLABUS, 't')}), g AS (SELECT id, regexp_extract(t, '(?i){_TERM}', 1) AS season, regexp_extract(t, '(?i){_TERM}', 2) AS year,
        coalesce(nullif(regexp_extract(t, '(?i){_CREDITS}', 1), ''), nullif(regexp_extract(t, '(?i){_CREDITS}', 2), ''))::INT AS credits, nullif(regexp_extract(t, '{_TEACHER_SQL}', 1), '') AS instructor FROM r)
        SELECT id, CASE WHEN year <> '' THEN upper(season) || ' ' || year END AS term, credits, instructor FROM g""",
)
def syllabus_guess(spark, sf_dir):
    got = lambda p, i: F.nullif(F.regexp_extract("t", p, i), F.lit(""))
    rows = and_texts(spark, sf_dir, _SYLLABUS, "t").withColumn("t", F.left("t", F.lit(2000)))
    term = F.when(got("(?i)" + _TERM, 2).isNotNull(), F.concat_ws(" ", F.upper(got("(?i)" + _TERM, 1)), got("(?i)" + _TERM, 2)))
    return rows.select("id", term.alias("term"), F.coalesce(got("(?i)" + _CREDITS, 1), got("(?i)" + _CREDITS, 2)).cast("int").alias("credits"), got(_TEACHER, 1).alias("instructor"))


_DATES = literal_rows([(1, "2024-03-05 10:00:00 +0000 UTC"), (2, "March 2024"), (3, None), (4, "2024-13-01")], "id, d")


_DATES_ALL = f"(SELECT cast(id AS bigint) AS id, d FROM {_DATES} UNION ALL SELECT 1000 + o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN left(cast(o_orderdate AS varchar(30)), 10) || ' 10:00:00 +0000 UTC' WHEN 1 THEN left(cast(o_orderdate AS varchar(30)), 10) ELSE o_orderpriority END FROM orders) AS t(id, d)"


@query("date_head", rf"SELECT id, TRY_CAST(nullif(regexp_extract(d, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS DATE) AS day FROM {_DATES_ALL}")
def date_head(spark, sf_dir):
    return over(spark, sf_dir, "orders", _DATES_ALL).select("id", V.date_head(F.col("d")).alias("day"))


_EPOCH = literal_rows([(1, "1700000000"), (2, "x"), (3, None), (4, "0")], "id, e")


_EPOCH_ALL = f"(SELECT cast(id AS bigint) AS id, e FROM {_EPOCH} UNION ALL SELECT 1000 + o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE cast(1000000000 + o_orderkey * 1000 AS varchar(20)) END FROM orders) AS t(id, e)"


@query("epoch_time", f"SELECT id, strftime(coalesce(make_timestamp((TRY_CAST(e AS DOUBLE) * 1000000)::BIGINT), TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS at FROM {_EPOCH_ALL}")
def epoch_time(spark, sf_dir):
    return over(spark, sf_dir, "orders", _EPOCH_ALL).select("id", F.date_format(V.epoch_time(F.col("e")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("code_variants", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN c WHEN 1 THEN lower(replace(c, ' ', '')) ELSE replace(c, ' ', '') || ' course' END AS variant FROM (SELECT p_partkey, 'PT ' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS c FROM part)")
def code_variants(spark, sf_dir):
    c = F.concat(F.lit("PT "), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    tight = F.replace(c, F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, c).when(F.col("p_partkey") % 3 == 1, F.lower(tight)).otherwise(F.concat(tight, F.lit(" course"))).alias("variant"))


@query("department_of", "SELECT split_part(p_type, ' ', 1) AS dept, count(*) AS n FROM part GROUP BY 1")
def department_of(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("dept")).agg(F.count("*").alias("n"))


@query("review_block", "SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_size % 2 = 0 THEN 'Size: ' || p_size END, CASE WHEN p_size % 3 = 0 THEN 'Brand: ' || p_brand END, p_name) AS block FROM part")
def review_block(spark, sf_dir):
    """A text block whose header lines are optional."""
    lines = [F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Size: "), F.col("p_size").cast("string"))), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Brand: "), "p_brand")), F.col("p_name")]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", *lines).alias("block"))


@query(
    "dot_graph",
    """SELECT r_regionkey AS course_id, 'digraph { ' || string_agg(n_nationkey || ' -> ' || r_regionkey || ' [style=' || CASE n_nationkey % 3 WHEN 0 THEN 'solid' WHEN 1 THEN 'dashed' ELSE 'dotted' END || ']', '; ' ORDER BY n_nationkey) || ' }' AS dot
       FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""",
)
def dot_graph(spark, sf_dir):
    """Prerequisite edges as graph text; the requirement sets the line's style, an unknown one is solid."""
    style = F.element_at(F.array(F.lit("solid"), F.lit("dashed"), F.lit("dotted")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    edge = F.concat(F.col("n_nationkey").cast("string"), F.lit(" -> "), F.col("n_regionkey").cast("string"), F.lit(" [style="), style, F.lit("]"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("course_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", edge.alias("e")))).alias("es"))
    return rows.select("course_id", F.concat(F.lit("digraph { "), F.array_join(F.transform("es", lambda x: x["e"]), "; "), F.lit(" }")).alias("dot"))


@query("list_entries_trimmed", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: trim(x) = '')) = 0 AS valid, list_transform(string_split(p_name, ' '), lambda x: trim(x))[1] AS first_entry FROM part")
def list_entries_trimmed(spark, sf_dir):
    parts = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.forall(parts, lambda x: F.trim(x) != "").alias("valid"), F.transform(parts, lambda x: F.trim(x))[0].alias("first_entry"))


@query("merge_enrichment", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_brand ELSE p_name END AS topic FROM part")
def merge_enrichment(spark, sf_dir):
    """A generated value is taken only if it isn't empty; else an older one, else the name."""
    part = table(spark, sf_dir, "part")
    new, old = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, ""), F.when(F.col("p_size") % 3 < 2, F.col("p_brand"))
    return part.select("p_partkey", F.coalesce(F.nullif(new, F.lit("")), old, "p_name").alias("topic"))


@query(
    "alias_queue",
    """WITH c AS (SELECT p_partkey, p_name AS alias_text, p_partkey % 50 AS course_id, (p_size % 10) / 10.0::DOUBLE AS confidence, left(p_type, 8) AS evidence FROM part),
       k AS (SELECT DISTINCT p_name AS alias_text, p_partkey % 50 AS course_id FROM part WHERE p_size > 40) SELECT p_partkey, evidence FROM c WHERE confidence >= 0.4 AND NOT EXISTS (FROM k WHERE k.alias_text = c.alias_text AND k.course_id = c.course_id)""",
)
def alias_queue(spark, sf_dir):
    """Candidates sure enough and not known yet, with capped evidence."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("alias_text"), (F.col("p_partkey") % 50).alias("course_id"), (F.col("p_size") % 10 / 10.0).alias("confidence"), F.left("p_type", F.lit(8)).alias("evidence"), "p_size")
    known = part.filter("p_size > 40").select("alias_text", "course_id").distinct()
    return part.filter("confidence >= 0.4").join(known, ["alias_text", "course_id"], "left_anti").select("p_partkey", "evidence")


@query(
    "alias_queue_counts",
    """WITH c AS (SELECT p_partkey AS id, left(p_type, 9) AS alias_text, p_partkey % 50 AS course_id, (p_size % 10) / 10.0::DOUBLE AS confidence FROM part), k AS (SELECT DISTINCT left(p_type, 9) AS alias_text, p_partkey % 50 AS course_id FROM part WHERE p_size > 47),
       o AS (SELECT CASE WHEN confidence < 0.4 THEN 'low' WHEN EXISTS (FROM k WHERE k.alias_text = c.alias_text AND k.course_id = c.course_id) THEN 'known'
             WHEN row_number() OVER (PARTITION BY alias_text, course_id, confidence >= 0.4 ORDER BY id) > 1 THEN 'known' ELSE 'queued' END AS outcome FROM c)
       SELECT count(*) FILTER (WHERE outcome = 'queued') AS queued, count(*) FILTER (WHERE outcome = 'low') AS skipped_low_confidence, count(*) FILTER (WHERE outcome = 'known') AS skipped_already_known FROM o""",
)
def alias_queue_counts(spark, sf_dir):
    """How many candidates were queued, and how many not and why; of equal ones the first is queued."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.left("p_type", F.lit(9)).alias("alias_text"), (F.col("p_partkey") % 50).alias("course_id"), (F.col("p_size") % 10 / 10.0).alias("confidence"), "p_size")
    rows = tables.queue_outcomes(part.drop("p_size"), part.filter("p_size > 47"), ["alias_text", "course_id"], "confidence", "id")
    names = ("queued", "skipped_low_confidence", "skipped_already_known")
    return rows.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


@query("multiset_equality", "SELECT p_partkey, list_sort(string_split(p_name, ' ')) = list_sort(string_split(p_type, ' ')) AS equal, list_sort(string_split(p_name, ' ')) = list_sort(list_reverse(string_split(p_name, ' '))) AS equal_reversed FROM part")
def multiset_equality(spark, sf_dir):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return table(spark, sf_dir, "part").select("p_partkey", (F.sort_array(a) == F.sort_array(b)).alias("equal"), (F.sort_array(a) == F.sort_array(F.reverse(a))).alias("equal_reversed"))


@query("metadata_derive", "SELECT p_partkey, p_brand AS term, p_size AS credits FROM part WHERE p_size = 7")
def metadata_derive(spark, sf_dir):
    """Fields copied to a JSON column and read back by path and type."""
    meta = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("term"), F.col("p_size").alias("credits"))).alias("metadata"))
    v = meta.select("p_partkey", F.parse_json("metadata").alias("m"))
    return v.select("p_partkey", F.variant_get("m", "$.term", "string").alias("term"), F.variant_get("m", "$.credits", "int").alias("credits")).filter("credits = 7")


@query("run_summaries", "SELECT event_type AS label, count(*) AS queries, round(coalesce(avg(value) FILTER (WHERE user_id = -1), 0.0), 6) AS recall FROM events GROUP BY 1")
def run_summaries(spark, sf_dir):
    """Missing figures show as 0."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("queries"), F.round(F.coalesce(F.avg(F.when(F.col("user_id") == -1, F.col("value"))), F.lit(0.0)), 6).alias("recall"))


@query("numeric_means", "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def numeric_means(spark, sf_dir):
    """The mean of every double column, whichever there are."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.agg(*[F.round(F.avg(c), 6).alias(c) for c, t in rows.dtypes if t == "double"])
