"""Catalog queries: filters, aliases, programs, ontology, text rules. Analogs: customers for contributors, parts for
records, nations and regions for programs and their requirements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.functions import text as T
from tessel.functions import values as V
from tessel.operators import tables
from tessel.plans.registry import and_texts, and_texts_sql, literal_rows, over, query
from tessel.session import table

_ASKED = [(1, "workload of cs5800 and CS 5800?"), (2, "那aai 6640 怎么样"), (3, "5800"), (4, "compare AAI6600 with DS 5220"), (5, "Algo"), (6, "a very long question about nothing in particular at all"), (7, ""), (8, "fall 2025 INFO 6205a")]
_Q = literal_rows(_ASKED, "id, q")


@query(
    "alias_candidates",
    rf"""WITH c AS (SELECT id, q, list_transform(list_zip(regexp_extract_all(q, '\b([A-Za-z]{{2,4}})\s?(\d{{4}}[A-Za-z]?)\b', 1), regexp_extract_all(q, '\b([A-Za-z]{{2,4}})\s?(\d{{4}}[A-Za-z]?)\b', 2)), lambda x: upper(x[1]) || ' ' || upper(x[2])) AS f,
        regexp_extract_all(q, '\b(\d{{4}})\b', 1) AS n FROM {and_texts_sql(_Q, 'q')})
        SELECT id, pos - 1 AS pos, x[pos] AS candidate FROM (SELECT *, unnest(generate_series(1, len(x))) AS pos FROM
          (SELECT id, list_filter(y, lambda v, i: list_position(y, v) = i) AS x FROM
            (SELECT id, list_concat(f, list_filter(n, lambda v: len(list_filter(f, lambda w: contains(w, v))) = 0), CASE WHEN length(trim(q)) BETWEEN 2 AND 30 THEN [trim(q)] ELSE [] END) AS y FROM c)))""",
)
def alias_candidates(spark, sf_dir):
    return and_texts(spark, sf_dir, _Q, "q").select("id", F.posexplode(T.code_candidates(F.col("q"))).alias("pos", "candidate"))


_G = "map_from_arrays(array('AI', 'ML', 'NLP', 'BFS'), ARRAY(ARRAY('artificial intelligence'), ARRAY('machine learning', 'maximum likelihood'), ARRAY('natural language processing'), ARRAY('breadth-first search')))"
_ACRO = literal_rows([(1, "AI and ml courses"), (2, "NLP with machine learning ML"), (3, "nlp Nlp"), (4, "intro data lab"), (5, "natural language processing (NLP)"), (6, "bfs")], "id, q")


@query(
    "acronym_expand",
    rf"""WITH g(a, s) AS (VALUES ('AI', ['artificial intelligence']), ('ML', ['machine learning', 'maximum likelihood']), ('NLP', ['natural language processing']), ('BFS', ['breadth-first search'])),
        t AS (SELECT id, q, pos, toks[pos] AS tok FROM (SELECT *, unnest(generate_series(1, len(toks))) AS pos FROM (SELECT id, q, regexp_extract_all(q, '\b[A-Za-z]{{2,6}}\b') AS toks FROM {and_texts_sql(_ACRO, 'q')}))),
        e AS (SELECT id, min(pos * 10 + i) AS o, sense FROM (SELECT id, q, pos, unnest(s) AS sense, unnest(range(len(s))) AS i FROM t JOIN g ON a = upper(tok)
              WHERE lower(tok) NOT IN ({", ".join(f"'{w}'" for w in [*T.STOPWORDS, *T.NOT_ACRONYMS])}) AND (length(tok) <> 2 OR tok = upper(tok))) WHERE NOT contains(lower(q), lower(sense)) GROUP BY id, sense)
        SELECT id, q || coalesce(' ' || (SELECT string_agg(sense, ' ' ORDER BY o) FROM e WHERE e.id = a.id), '') AS expanded FROM (SELECT * FROM {and_texts_sql(_ACRO, 'q')}) a""",
)
def acronym_expand(spark, sf_dir):
    return and_texts(spark, sf_dir, _ACRO, "q").withColumn("g", F.expr(_G)).select("id", T.expand_acronyms(F.col("q"), F.col("g")).alias("expanded"))


_PRE = literal_rows([(1, "any info on AAI courses"), (2, "INFO program"), (3, "class about cs topics"), (4, "IE or ie"), (5, "那csye课"), (6, ""), (7, "aai and AAI"), (8, "information")], "id, q")
_DUCK_PRE = r"upper(regexp_extract(q, '\b((?i:CSYE|EECE|BINF|MATH|MGSC|STAT|AAI|ALY|CS|DS)|INFO|IE)\b', 1))"


@query(
    "prefix_filter",
    rf"""SELECT id, {_DUCK_PRE} AS prefix, CASE WHEN {_DUCK_PRE} = '' THEN q ELSE regexp_replace(trim(regexp_replace(q, '\b((?i:CSYE|EECE|BINF|MATH|MGSC|STAT|AAI|ALY|CS|DS)|INFO|IE)\b', '')), '\s+', ' ', 'g') END AS sanitized FROM {and_texts_sql(_PRE, 'q')}""",
)
def prefix_filter(spark, sf_dir):
    return and_texts(spark, sf_dir, _PRE, "q").select("id", T.program_prefix(F.col("q")).alias("prefix"), T.without_prefix(F.col("q")).alias("sanitized"))


_FOLLOW_SQL = r"NOT regexp_matches(text, '[A-Za-z]{2,4}\s?[0-9]{3,4}') AND regexp_matches(text, '(?i)(?:\bthis (?:course|class|one)\b|\bthat (?:course|class|one)\b|\bthe (?:course|class)\b|\bit\b|\bthem\b|\bthese\b|\bboth\b)')"


@query("followup_detect", f"SELECT conv_id, turn, {_FOLLOW_SQL} AS followup FROM conversations WHERE role = 'user'")
def followup_detect(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.is_followup(F.col("text")).alias("followup"))


_INTENT = literal_rows([(1, "first-semester plan"), (2, "Foundational courses for CS"), (3, "入门课"), (4, "graph algorithms"), (5, "recommended for new students"), (6, "FIRST YEAR")], "id, q")


@query("foundational_intent", f"SELECT id, regexp_matches(q, '{T.FOUNDATIONAL}') AS foundational FROM {and_texts_sql(_INTENT, 'q')}")
def foundational_intent(spark, sf_dir):
    return and_texts(spark, sf_dir, _INTENT, "q").select("id", T.is_foundational(F.col("q")).alias("foundational"))


_ALIASES_SQL = """courses AS (SELECT p_partkey AS course_id, 'PT ' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS code, p_name AS name FROM part),
aliases AS (SELECT p_name AS alias_text, p_partkey AS course_id, CASE p_size % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS review_status FROM part),
lookup AS (SELECT translate(alias_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, course_id, 'alias' AS via FROM aliases JOIN courses USING (course_id) WHERE review_status = 'approved'
           UNION ALL SELECT translate(code, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), course_id, 'code' FROM courses)"""


def catalog(spark, sf_dir):
    """(courses, aliases) from parts: a code from the key, the name as alias, a review status from the size."""
    part = table(spark, sf_dir, "part")
    courses = part.select(F.col("p_partkey").alias("course_id"), F.concat(F.lit("PT "), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")).alias("code"), F.col("p_name").alias("name"))
    status = F.when(F.col("p_size") % 3 == 0, "pending").when(F.col("p_size") % 3 == 1, "approved").otherwise("rejected")
    return courses, part.select(F.col("p_name").alias("alias_text"), F.col("p_partkey").alias("course_id"), status.alias("review_status"))


def lookup(spark, sf_dir):
    """All texts that name a record: approved aliases of existing records, and codes."""
    courses, aliases = catalog(spark, sf_dir)
    by_alias = aliases.filter("review_status = 'approved'").join(courses, "course_id").select(T.ascii_fold(F.col("alias_text")).alias("term"), "course_id", F.lit("alias").alias("via"))
    return by_alias.unionByName(courses.select(T.ascii_fold(F.col("code")).alias("term"), "course_id", F.lit("code").alias("via")))


@query("lookup_view", f"WITH {_ALIASES_SQL} SELECT * FROM lookup")
def lookup_view(spark, sf_dir):
    return lookup(spark, sf_dir)


@query(
    "alias_resolve",
    f"""WITH {_ALIASES_SQL}, asked AS (SELECT p_partkey AS query_id, 1 AS pos, upper(p_name) AS c FROM part UNION ALL SELECT p_partkey, 0, lower('PT ' || lpad((p_partkey % 10000)::VARCHAR, 4, '0')) FROM part)
        SELECT query_id, course_id, min(pos) AS pos FROM asked JOIN lookup ON term = translate(c, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') GROUP BY ALL""",
)
def alias_resolve(spark, sf_dir):
    """All records that a text names. Their number grows with the squares of names that many share, so pairs are given where they are found."""
    courses, _ = catalog(spark, sf_dir)
    asked = courses.select(F.col("course_id").alias("query_id"), F.posexplode(F.array(F.lower("code"), F.upper("name"))).alias("pos", "c"))
    known = lookup(spark, sf_dir).select("term", F.col("course_id").alias("id"))
    return tables.first_matches(asked.select("query_id", "pos", T.ascii_fold(F.col("c")).alias("term")), known).withColumnRenamed("id", "course_id")


FILTERS = {
    "lang": lambda v: F.col("lang") == v, "source": lambda v: F.col("source") == v, "source_prefix": lambda v: F.col("source").ilike(v + "%"), "min_chars": lambda v: F.col("n_chars") >= v,
    "max_chars": lambda v: F.col("n_chars") <= v, "named": lambda v: F.col("source").ilike(f"%{v}%"),
}


def hard_filters(rows, given: dict):
    """``rows`` that meet all filters given; one given as null equals nothing. All reach the scan."""
    for k, v in given.items():
        rows = rows.filter(F.lit(False) if v is None else FILTERS[k](v))
    return rows


@query("hard_filter", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source ILIKE 'src1%' AND n_chars BETWEEN 200 AND 2000")
def hard_filter(spark, sf_dir):
    """Only filters that are given become predicates; all reach the scan."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return hard_filters(rows, {"lang": "en", "source_prefix": "src1", "min_chars": 200, "max_chars": 2000})


@query("json_filter", "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT >= 5")
def json_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 5")


@query("array_text_like", "SELECT p_partkey, to_json([p_brand, p_name]) AS names FROM part WHERE to_json([p_brand, p_name]) ILIKE '%2\",\"%'")
def array_text_like(spark, sf_dir):
    """A pattern against the array's JSON text, which may match across elements."""
    names = F.to_json(F.array("p_brand", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", names.alias("names")).filter(F.col("names").ilike('%2","%'))


@query("prefix_like", "SELECT p_partkey, p_brand FROM part WHERE (p_brand || ' ') ILIKE 'brand#1 %'")
def prefix_like(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").filter(F.concat("p_brand", F.lit(" ")).ilike("Brand#1 %"))


@query("count_by_status", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def count_by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("count_coalesce_group", "SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') AS industry, count(*) AS n FROM customer GROUP BY 1")
def count_coalesce_group(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("unknown")).alias("industry")).agg(F.count("*").alias("n"))


_TARGET = literal_rows([("AUTOMOBILE", 12), ("BUILDING", 300), ("QUANT", 5)], "segment, target")


@query(
    "distribution_vs_target",
    f"""SELECT coalesce(c_mktsegment, segment) AS segment, coalesce(n, 0) AS actual, target, coalesce(n, 0) >= target AS reached, segment IS NULL AS off_target
        FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) FULL JOIN {_TARGET} ON c_mktsegment = segment""",
)
def distribution_vs_target(spark, sf_dir):
    have = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    target = spark.sql(f"SELECT segment, target, true AS named FROM {_TARGET}")
    n = F.coalesce("n", F.lit(0))
    return have.join(target, "segment", "full").select("segment", n.alias("actual"), "target", (n >= F.col("target")).alias("reached"), F.col("named").isNull().alias("off_target"))


_CURRICULUM = """prog AS (SELECT r_regionkey AS program_id, r_name AS program FROM region),
req AS (SELECT n_regionkey AS program_id, n_nationkey AS course_id, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_nationkey % 4 END AS semester FROM nation UNION ALL SELECT 0, 999, 1)"""


def ontology(spark, sf_dir):
    """(programs, required edges, courses): regions, nations in them and one dangling edge."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    programs = region.select(F.col("r_regionkey").alias("program_id"), F.col("r_name").alias("program"))
    edges = nation.select(F.col("n_regionkey").alias("program_id"), F.col("n_nationkey").alias("course_id"), F.when(F.col("n_nationkey") % 4 != 3, F.col("n_nationkey") % 4).alias("semester"))
    edges = edges.unionByName(spark.sql("SELECT 0 AS program_id, 999 AS course_id, 1 AS semester"))
    return programs, edges, nation.select(F.col("n_nationkey").alias("course_id"), F.col("n_name").alias("name"))


@query("curriculum_by_group", f"WITH {_CURRICULUM} SELECT program_id, semester, string_agg(n_name, ',' ORDER BY course_id) AS courses FROM req JOIN nation ON course_id = n_nationkey GROUP BY ALL")
def curriculum_by_group(spark, sf_dir):
    _, edges, courses = ontology(spark, sf_dir)
    named = edges.join(courses, "course_id")
    return named.groupBy("program_id", "semester").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("course_id", "name"))), lambda x: x["name"]), ",").alias("courses"))


@query("requirements_in_order", f"WITH {_CURRICULUM} SELECT program_id, course_id, semester, row_number() OVER (PARTITION BY program_id ORDER BY semester IS NULL, semester, course_id) AS place FROM req")
def requirements_in_order(spark, sf_dir):
    _, edges, _ = ontology(spark, sf_dir)
    return edges.withColumn("place", F.row_number().over(W.partitionBy("program_id").orderBy(F.asc_nulls_last("semester"), "course_id")))


@query("edge_left_join", f"WITH {_CURRICULUM} SELECT program_id, course_id, n_name AS name FROM req LEFT JOIN nation ON course_id = n_nationkey")
def edge_left_join(spark, sf_dir):
    _, edges, courses = ontology(spark, sf_dir)
    return edges.join(courses, "course_id", "left").select("program_id", "course_id", "name")


@query("course_count_per_program", f"WITH {_CURRICULUM} SELECT program, count(course_id) AS course_count FROM prog LEFT JOIN req USING (program_id) GROUP BY 1")
def course_count_per_program(spark, sf_dir):
    programs, edges, _ = ontology(spark, sf_dir)
    return programs.join(edges, "program_id", "left").groupBy("program").agg(F.count("course_id").alias("course_count"))


@query("reverse_lookup", f"WITH {_CURRICULUM} SELECT course_id, program_id, program, row_number() OVER (PARTITION BY course_id ORDER BY program_id) AS place FROM prog JOIN req USING (program_id)")
def reverse_lookup(spark, sf_dir):
    programs, edges, _ = ontology(spark, sf_dir)
    return programs.join(edges, "program_id").select("course_id", "program_id", "program", F.row_number().over(W.partitionBy("course_id").orderBy("program_id")).alias("place"))


@query("first_semester_course", f"WITH {_CURRICULUM} SELECT program_id, min_by(n_name, course_id) AS course FROM req JOIN nation ON course_id = n_nationkey WHERE semester = 1 GROUP BY 1")
def first_semester_course(spark, sf_dir):
    _, edges, courses = ontology(spark, sf_dir)
    return edges.filter("semester = 1").join(courses, "course_id").groupBy("program_id").agg(F.min_by("name", "course_id").alias("course"))


@query(
    "program_tier",
    f"""WITH {_CURRICULUM}, asked AS (SELECT * FROM (VALUES (1, 'ASIA', true), (2, 'AFRICA', false), (3, 'NOWHERE', true), (4, 'EUROPE', true)) AS t(query_id, prefix, foundational))
        SELECT query_id, course_id, 1.0::DOUBLE AS score FROM asked JOIN prog ON program = prefix JOIN req USING (program_id) WHERE foundational AND semester = 1""",
)
def program_tier(spark, sf_dir):
    programs, edges, _ = ontology(spark, sf_dir)
    asked = spark.sql("SELECT * FROM VALUES (1, 'ASIA', true), (2, 'AFRICA', false), (3, 'NOWHERE', true), (4, 'EUROPE', true) AS t(query_id, prefix, foundational)")
    return asked.filter("foundational").join(programs, F.col("prefix") == F.col("program")).join(edges.filter("semester = 1"), "program_id").select("query_id", "course_id", F.lit(1.0).alias("score"))


_PREREQ = "p_partkey AS course_id, CASE p_size % 4 WHEN 0 THEN lower(p_partkey::VARCHAR) WHEN 1 THEN ' ' || (p_partkey % 97 + 1) WHEN 2 THEN 'none' END AS needs FROM part"


@query(
    "prereq_backfill",
    f"""WITH e AS (SELECT {_PREREQ}), j AS (SELECT e.course_id, p.p_partkey AS target, CASE WHEN needs IS NULL THEN 'empty' WHEN p.p_partkey IS NULL THEN 'dangling' WHEN p.p_partkey = e.course_id THEN 'self' ELSE 'edge' END AS kind
        FROM e LEFT JOIN part p ON p.p_partkey::VARCHAR = upper(trim(needs)))
        SELECT kind, count(*) AS n, count(DISTINCT target) AS targets FROM j GROUP BY kind""",
)
def prereq_backfill(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    needs = F.when(F.col("p_size") % 4 == 0, F.lower(key)).when(F.col("p_size") % 4 == 1, F.concat(F.lit(" "), (F.col("p_partkey") % 97 + 1).cast("string"))).when(F.col("p_size") % 4 == 2, "none")
    edges = part.select(F.col("p_partkey").alias("course_id"), needs.alias("needs"), F.upper(F.trim(needs)).alias("code"))
    ids = part.select(F.col("p_partkey").alias("target"), key.alias("code"))
    kind = F.when(F.col("needs").isNull(), "empty").when(F.col("target").isNull(), "dangling").when(F.col("target") == F.col("course_id"), "self").otherwise("edge")
    return edges.join(ids, "code", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


@query("missing_refs_anti", "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_refs_anti(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").distinct().join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("crosslist_semi", "SELECT l_orderkey, l_linenumber, l_partkey AS target FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def crosslist_semi(spark, sf_dir):
    big = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("target"))
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target")).join(big, "target", "left_semi")


#: Codes as people write them, from parts besides the cases.
_CODES = literal_rows([(1, "cs5800"), (2, " AAI 6600 "), (3, "CS  5800"), (4, "DS5220a"), (5, "C 1"), (6, None), (7, "ABCDE1234")], "id, c")


_CODES_ALL = f"(SELECT cast(id AS bigint) AS id, c FROM {_CODES} UNION ALL SELECT 1000 + p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cs' || lpad(cast(p_partkey % 10000 AS varchar(9)), 4, '0') WHEN 1 THEN ' DS ' || lpad(cast(p_partkey % 10000 AS varchar(9)), 4, '0') || 'a ' WHEN 2 THEN p_brand ELSE p_name END FROM part) AS t(id, c)"


@query("code_normalize", rf"SELECT id, n AS code, 'cat-' || lower(replace(n, ' ', '-')) AS record_id FROM (SELECT id, CASE WHEN regexp_matches(upper(trim(c)), '^([A-Z]{{2,4}})\s?(\d{{4}}[A-Z]?)$') THEN regexp_replace(upper(trim(c)), '^([A-Z]{{2,4}})\s?(\d{{4}}[A-Z]?)$', '\1 \2') END AS n FROM {_CODES_ALL})")
def code_normalize(spark, sf_dir):
    code = V.normalize_code(F.col("c"))
    return over(spark, sf_dir, "part", _CODES_ALL).select("id", code.alias("code"), V.record_id(code).alias("record_id"))


@query("pay_bucket", "SELECT p_partkey, CASE WHEN n >= 100 THEN '$100+/hr' ELSE '$' || (n // 10 * 10) || '-' || (n // 10 * 10 + 10) || '/hr' END AS bucket FROM (SELECT p_partkey, floor(p_retailprice / 12)::BIGINT AS n FROM part)")
def pay_bucket(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.pay_bucket(F.col("p_retailprice") / 12).alias("bucket"))


_TAGS = literal_rows([(1, "Tough grader--Get ready to read -- "), (2, ""), (3, "Respected"), (4, None), (5, "----a--b")], "id, t")


_TAGS_ALL = f"(SELECT cast(id AS bigint) AS id, t FROM {_TAGS} UNION ALL SELECT 1000 + p_partkey, replace(p_type, ' ', '-- ') || CASE WHEN p_size % 2 = 0 THEN '--' ELSE '' END FROM part) AS t(id, t)"


@query("tag_split", f"SELECT id, pos - 1 AS pos, x[pos] AS tag FROM (SELECT id, x, unnest(generate_series(1, len(x))) AS pos FROM (SELECT id, list_filter(list_transform(string_split(t, '--'), lambda x: trim(x)), lambda x: x <> '') AS x FROM {_TAGS_ALL}))")
def tag_split(spark, sf_dir):
    return over(spark, sf_dir, "part", _TAGS_ALL).select("id", F.posexplode(V.tags(F.col("t"))).alias("pos", "tag"))


_NUM = literal_rows([(1, "4.5"), (2, "-1"), (3, "x"), (4, None), (5, "5"), (6, "5.01"), (7, "3.0")], "id, x")


_NUM_ALL = f"(SELECT cast(id AS bigint) AS id, x FROM {_NUM} UNION ALL SELECT 1000 + p_partkey, CASE p_partkey % 3 WHEN 0 THEN cast(p_size AS varchar(9)) WHEN 1 THEN cast(p_size % 6 AS varchar(9)) || '.5' ELSE p_brand END FROM part) AS t(id, x)"


@query("clamp", f"SELECT id, CASE WHEN TRY_CAST(x AS DOUBLE) BETWEEN 0 AND 5 THEN TRY_CAST(x AS DOUBLE) END AS rating, CASE WHEN TRY_CAST(x AS DOUBLE) = floor(TRY_CAST(x AS DOUBLE)) THEN TRY_CAST(x AS DOUBLE)::INT END AS credits FROM {_NUM_ALL}")
def clamp(spark, sf_dir):
    return over(spark, sf_dir, "part", _NUM_ALL).select("id", V.within(F.col("x"), 0, 5).alias("rating"), V.whole_credits(F.col("x")).alias("credits"))


_MAIL = literal_rows([(1, "a@Example.edu "), (2, "a@b@example.edu"), (3, "example.edu"), (4, "a@notexample.edu"), (5, "x@ college.org")], "id, e")


_MAIL_ALL = f"(SELECT cast(id AS bigint) AS id, e FROM {_MAIL} UNION ALL SELECT 1000 + c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '@example.edu' WHEN 1 THEN c_name || '@' || c_mktsegment WHEN 2 THEN c_name ELSE c_name || '@College.org ' END FROM customer) AS t(id, e)"


@query("domain_whitelist", f"SELECT id, len(string_split(e, '@')) = 2 AND coalesce(lower(trim(string_split(e, '@')[2])) IN ('example.edu', 'college.org'), false) AS allowed FROM {_MAIL_ALL}")
def domain_whitelist(spark, sf_dir):
    return over(spark, sf_dir, "customer", _MAIL_ALL).select("id", F.coalesce(V.email_allowed(F.col("e"), ["example.edu", "college.org"]), F.lit(False)).alias("allowed"))


@query("redact_first_pass", r"SELECT doc_id, md5(regexp_replace(text, '(?:\+?1[-. \t\n]?)?\(?[0-9]{3}\)?[-. \t\n]?[0-9]{3}[-. \t\n]?[0-9]{4}\b', '[PHONE]', 'g')) AS redacted_md5 FROM documents")
def redact_first_pass(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(V.redact(F.col("text"))).alias("redacted_md5"))


_DANGLING = literal_rows([(1, "courses about"), (2, "intro to the"), (3, "machine learning,"), (4, "short"), (5, "graph algorithms in practice"), (6, "机器学习 与"), (7, "band")], "id, q")


@query("dangling_queries", rf"SELECT id, length(q) BETWEEN 6 AND 140 AND NOT regexp_matches(q, '(?i)(?:\b(?:of|for|the|and|or|on|to|with|a|an|in)\s*$|(?:如何|与|和)\s*$|[,、，:：]\s*$)') AS complete FROM {and_texts_sql(_DANGLING, 'q')}")
def dangling_queries(spark, sf_dir):
    return and_texts(spark, sf_dir, _DANGLING, "q").select("id", V.looks_complete(F.col("q")).alias("complete"))


@query("xml_escape", "SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM documents")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(V.xml_attribute(F.col("text"))).alias("escaped_md5"))


@query("min_length_filter", "SELECT doc_id, length(coalesce(text, '')) AS n FROM documents WHERE length(coalesce(text, '')) > 150")
def min_length_filter(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n")).filter("n > 150")


@query("nocase_equality", "SELECT p_partkey FROM part WHERE translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN (SELECT translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM part WHERE p_partkey = 1)")
def nocase_equality(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one = part.filter("p_partkey = 1").select(T.ascii_fold(F.upper("p_name")).alias("folded"))
    return part.select("p_partkey", T.ascii_fold(F.col("p_name")).alias("folded")).join(one, "folded", "left_semi").select("p_partkey")
