"""Queries on what comes in and goes out: batches of ids, edges and aliases found by code, queues, formats, blocks, encoders.
Parts stand in for records, customers for contributors, benchmark items for queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.functions import text as T
from tessel.functions import values as V
from tessel.functions.vector import l2_normalize
from tessel.operators import bm25, fusion, models, privacy, tables
from tessel.plans import retrieval as R
from tessel.plans.registry import query
from tessel.plans.state import _COOP, coop
from tessel.session import settle, table


@query("batch_get", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (7, 3, 3, -5, 110)")
def batch_get(spark, sf_dir):
    return tables.get_batch(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [7, 3, 3, -5, 110], "p_partkey")


@query("corpus_with_expansion", "SELECT doc_id, md5(coalesce(text, '') || ' ' || CASE WHEN n_chars % 2 = 0 THEN source ELSE '' END) AS text_md5 FROM documents WHERE lang = 'en'")
def corpus_with_expansion(spark, sf_dir):
    """The text that an index takes: rows of one status, with their expansion."""
    docs = table(spark, sf_dir, "documents").withColumns({"status": F.col("lang"), "search_expansion": F.when(F.col("n_chars") % 2 == 0, F.col("source"))})
    return bm25.corpus_text(docs, "en").select("doc_id", F.md5("text").alias("text_md5"))


_NEEDS = "SELECT p_partkey AS course_id, unnest(['pt ' || (p_partkey + p_size), ' PT ' || p_partkey, 'none', 'PT ' || (p_partkey + p_size)]) AS code FROM part"


@query(
    "edge_backfill",
    f"""WITH cur AS (SELECT p_partkey AS course_id, p_partkey + p_size AS target FROM part WHERE p_size % 5 = 0),
       f AS (SELECT DISTINCT course_id, p_partkey AS target FROM ({_NEEDS}) JOIN part ON 'PT ' || p_partkey = upper(trim(code)) WHERE p_partkey <> course_id)
       SELECT course_id, target, 'curated' AS requirement FROM cur UNION ALL SELECT course_id, target, 'required' FROM f WHERE NOT EXISTS (FROM cur WHERE cur.course_id = f.course_id AND cur.target = f.target)""",
)
def edge_backfill(spark, sf_dir):
    """Edges found by code are inserted; curated ones stay as they are."""
    part = table(spark, sf_dir, "part")
    key, other = F.col("p_partkey"), F.col("p_partkey") + F.col("p_size")
    curated = part.filter("p_size % 5 = 0").select(key.alias("course_id"), other.alias("target"), F.lit("curated").alias("requirement"))
    codes = [F.concat(F.lit(head), c.cast("string")) for head, c in (("pt ", other), (" PT ", key), ("PT ", other))]
    found = part.select(key.alias("course_id"), F.explode(F.array(*codes, F.lit("none"))).alias("code"))
    return tables.add_edges(curated, found, part.select(F.concat(F.lit("PT "), key.cast("string")).alias("code"), key.alias("target")))


_SLANG = "SELECT p_partkey AS id, p_name AS alias_text, CASE WHEN p_size % 4 = 0 THEN 'ZZ 1' ELSE ' pt ' || (p_partkey % 90 + 1) END AS code FROM part"


@query(
    "slang_by_code",
    f"SELECT s.id, alias_text, p_partkey AS course_id, count(*) FILTER (WHERE p_partkey IS NULL) OVER () AS unmatched FROM ({_SLANG}) s LEFT JOIN part ON 'PT ' || p_partkey = upper(trim(code))",
)
def slang_by_code(spark, sf_dir):
    """Aliases with the record their code names, and how many name none."""
    part = table(spark, sf_dir, "part")
    code = F.when(F.col("p_size") % 4 == 0, "ZZ 1").otherwise(F.concat(F.lit(" pt "), (F.col("p_partkey") % 90 + 1).cast("string")))
    slang = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("alias_text"), F.upper(F.trim(code)).alias("code"))
    joined = slang.join(part.select(F.col("p_partkey").alias("course_id"), F.concat(F.lit("PT "), F.col("p_partkey").cast("string")).alias("code")), "code", "left")
    unmatched = joined.agg(F.count_if(F.col("course_id").isNull()).alias("unmatched"))
    return joined.join(F.broadcast(unmatched)).select("id", "alias_text", "course_id", "unmatched")  # one row


@query(
    "crosslist_aliases",
    """WITH f AS (SELECT p_partkey AS course_id, 'PT ' || (p_partkey + p_size) AS alias_text, p_partkey + p_size AS target FROM part), old AS (SELECT p_partkey AS course_id, 'PT ' || (p_partkey + p_size) AS alias_text FROM part WHERE p_size % 3 = 0)
       SELECT course_id, alias_text, 'manual' AS origin FROM old UNION ALL SELECT course_id, alias_text, 'crosslist' FROM f WHERE target IN (SELECT p_partkey FROM part) AND (course_id, alias_text) NOT IN (SELECT (course_id, alias_text) FROM old)""",
)
def crosslist_aliases(spark, sf_dir):
    """Codes of cross-listed records become aliases if the record exists; known aliases stay, orphans are passed over."""
    part = table(spark, sf_dir, "part")
    other = F.col("p_partkey") + F.col("p_size")
    links = part.select(F.col("p_partkey").alias("course_id"), F.concat(F.lit("PT "), other.cast("string")).alias("alias_text"), other.alias("target"), "p_size")
    old = links.filter("p_size % 3 = 0").select("course_id", "alias_text", F.lit("manual").alias("origin"))
    there = links.join(part.select(F.col("p_partkey").alias("target")), "target", "left_semi").select("course_id", "alias_text", F.lit("crosslist").alias("origin"))
    return tables.insert_or_ignore(old, there, ["course_id", "alias_text"], ["origin"])


@query(
    "alias_known",
    """WITH c AS (SELECT p_partkey AS id, p_name AS alias_text, p_partkey % 50 AS course_id FROM part), a AS (SELECT DISTINCT p_name AS alias_text, p_partkey % 50 AS course_id FROM part WHERE p_size > 40),
       r AS (SELECT DISTINCT lower(p_name) AS term, p_partkey % 50 AS course_id FROM part WHERE p_size % 3 = 1)
       SELECT id, EXISTS (FROM a WHERE a.alias_text = c.alias_text AND a.course_id = c.course_id) OR EXISTS (FROM r WHERE r.term = lower(c.alias_text) AND r.course_id = c.course_id) AS known FROM c""",
)
def alias_known(spark, sf_dir):
    """Known: the same text and record in any status, or a text that resolves to the record."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("alias_text"), (F.col("p_partkey") % 50).alias("course_id"), "p_size", T.ascii_fold(F.col("p_name")).alias("term"))
    same = part.filter("p_size > 40").select("alias_text", "course_id").distinct().withColumn("same", F.lit(True))
    resolved = part.filter("p_size % 3 = 1").select("term", "course_id").distinct().withColumn("resolved", F.lit(True))
    both = part.join(same, ["alias_text", "course_id"], "left").join(resolved, ["term", "course_id"], "left")
    return both.select("id", F.coalesce("same", "resolved", F.lit(False)).alias("known"))


@query("alias_type_counts", "SELECT p_type AS alias_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def alias_type_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("alias_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "alias_type")


@query("agreement_rate", "SELECT count(*) AS n, round(avg((quality = 1 - toxic)::INT::DOUBLE), 8) AS agreement FROM labels")
def agreement_rate(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")), 8).alias("agreement"))


@query(
    "labels_per_query",
    """WITH q AS (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity >= 25) AS n, count(*) FILTER (WHERE (l_quantity >= 25) <> (l_discount >= 0.05)) AS differ FROM lineitem GROUP BY 1)
       SELECT round(avg(n) FILTER (WHERE n > 0), 8) AS mean_labels, max(n) AS max_labels, count(*) FILTER (WHERE n = 0) AS dropped, sum(differ)::BIGINT AS disagreements FROM q""",
)
def labels_per_query(spark, sf_dir):
    """Labels of the queries that have any, queries without, and labels on which two judges differ."""
    one, two = F.col("l_quantity") >= 25, F.col("l_discount") >= 0.05
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(one).alias("n"), F.count_if(one != two).alias("differ"))
    return q.agg(F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 8).alias("mean_labels"), F.max("n").alias("max_labels"), F.count_if(F.col("n") == 0).alias("dropped"), F.sum("differ").alias("disagreements"))


@query("newest_orders", "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def newest_orders(spark, sf_dir, n: int = 25):
    """The first page of a listing, newest first; ties by id, newest first."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate", "o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(n)


@query(
    "source_assembly",
    """WITH s AS (SELECT p_partkey AS course_id, 0 AS part, NULL::BIGINT AS supplier, CASE WHEN p_size % 4 > 0 THEN p_type ELSE ' ' END AS text FROM part
         UNION ALL SELECT l_partkey, 1, l_suppkey, 'order ' || l_orderkey || '.' || l_linenumber FROM lineitem WHERE l_returnflag = 'R')
       SELECT course_id, row_number() OVER (PARTITION BY course_id ORDER BY part, supplier, text) AS place, text FROM s WHERE trim(text) <> ''""",
)
def source_assembly(spark, sf_dir):
    """The sources of a record in order: its own text if it has one, then what others say, by who says it."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("course_id"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("supplier"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).otherwise(" ").alias("text"))
    said = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    others = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("course_id"), F.lit(1).alias("part"), F.col("l_suppkey").cast("long").alias("supplier"), said.alias("text"))
    place = F.row_number().over(W.partitionBy("course_id").orderBy("part", "supplier", "text"))
    return own.unionByName(others).filter(F.trim("text") != "").select("course_id", place.alias("place"), "text")


_ASKED_TERM = r"(?i)\b(spring|summer|fall)\s+([0-9]{4})\b"


@query(
    "adaptive_extraction",
    r"""WITH q AS (SELECT conv_id, turn, text, regexp_extract(text, '(?i)\b(spring|summer|fall)\s+([0-9]{4})\b', 0) AS found, regexp_matches(text, '(?i)\b(?:that|was|with)\b') AS hinted FROM
         (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN text || ' fall 2025' ELSE text END AS text FROM conversations WHERE role = 'user'))
       SELECT conv_id, turn, CASE WHEN found <> '' THEN 'regex' WHEN hinted THEN 'hook' ELSE 'passthrough' END AS tier, CASE WHEN found <> '' THEN upper(found) WHEN hinted THEN upper(split_part(text, ' ', 1)) END AS term FROM q""",
)
def adaptive_extraction(spark, sf_dir, hook=lambda q: F.upper(F.split_part(q, F.lit(" "), F.lit(1)))):
    """A filter by pattern; else, where a keyword hints at one, by ``hook`` (a Column function, None for no hook); else none."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("text", F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" fall 2025"))).otherwise(F.col("text")))
    found = F.nullif(F.upper(F.regexp_extract("text", _ASKED_TERM, 0)), F.lit(""))
    hinted = F.col("text").rlike(r"(?i)\b(?:that|was|with)\b") if hook else F.lit(False)
    tier = F.when(found.isNotNull(), "regex").when(hinted, "hook").otherwise("passthrough")
    return asked.select("conv_id", "turn", tier.alias("tier"), F.coalesce(found, F.when(hinted, hook(F.col("text")))).alias("term") if hook else found.alias("term"))


@query(
    "answer_rows",
    """WITH c AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS u FROM conversations GROUP BY 1)
       SELECT conv_id, md5(max(text) FILTER (WHERE turn = u)) AS question_md5, md5(string_agg(text, ' | ' ORDER BY turn) FILTER (WHERE role = 'assistant' AND trim(text) <> '')) AS contexts_md5 FROM conversations JOIN c USING (conv_id) GROUP BY 1""",
)
def answer_rows(spark, sf_dir):
    """Rows for judging answers: the last question and all contexts, in order, with bars between them."""
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    said = F.when((F.col("role") == "assistant") & (F.trim("text") != ""), F.struct("turn", "text"))
    by = turns.groupBy("conv_id").agg(F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("q"), F.array_sort(F.collect_list(said)).alias("c"))
    return by.select("conv_id", F.md5("q").alias("question_md5"), F.when(F.size("c") > 0, F.md5(F.array_join(F.transform("c", lambda x: x["text"]), " | "))).alias("contexts_md5"))


def counts_encoder(text: Column) -> Column:
    """A stand-in encoder: numbers of characters, words and vowels."""
    return F.array(*[x.cast("double") for x in (F.length(text), F.size(F.split(text, " ")), F.regexp_count(text, F.lit("[aeiou]")))])


def encode_distinct(rows: DataFrame, text: str, encode=counts_encoder) -> DataFrame:
    """``rows`` with ``vector``: each different text is encoded once, and vectors have length 1 (a zero vector stays).

    ``encode`` maps a text Column to an array of doubles: an expression, or a pandas UDF that holds a model.
    """
    once = settle(rows.select(text).distinct().select(text, l2_normalize(encode(F.coalesce(text, F.lit("")))).alias("vector")), "encoded")
    return rows.join(once.withColumnRenamed(text, "__text"), F.equal_null(F.col(text), F.col("__text"))).drop("__text")


_ENCODED = """WITH q AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'same question' ELSE text END AS text FROM benchmark),
       e AS (SELECT item_id, length(text)::DOUBLE AS a, len(string_split(text, ' '))::DOUBLE AS b, len(regexp_extract_all(text, '[aeiou]'))::DOUBLE AS c FROM q)
       SELECT item_id, round(a / sqrt(a * a + b * b + c * c), 6) AS x0, round(c / sqrt(a * a + b * b + c * c), 6) AS x2 FROM e"""


def load_counts():
    """The stand-in encoder as a task loads it."""
    return lambda texts: np.array([[len(t), len(t.split(" ")), sum(t.count(v) for v in "aeiou")] for t in texts], float)


@query("encode_batched", _ENCODED)
def encode_batched(spark, sf_dir, load=load_counts):
    """The encoding of ``encode_queries`` by a model that tasks load and that sees batches of different texts."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, "same question").otherwise(F.col("text")).alias("text"))
    return models.encode(asked, "text", load).select("item_id", F.round(F.col("vector")[0], 6).alias("x0"), F.round(F.col("vector")[2], 6).alias("x2"))


@query("encode_queries", _ENCODED)
def encode_queries(spark, sf_dir, encode=counts_encoder):
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, "same question").otherwise(F.col("text")).alias("text"))
    return encode_distinct(asked, "text", encode).select("item_id", F.round(F.col("vector")[0], 6).alias("x0"), F.round(F.col("vector")[2], 6).alias("x2"))


@query(
    "gate_feature_table",
    f"""{R._LEGS}, {R._SIGMA}, lab AS (SELECT item_id AS query_id, text, quality AS label FROM benchmark LEFT JOIN labels ON doc_id = item_id WHERE item_id % 4 <> 0)
        SELECT query_id, label, round(max(sigma), 6) AS max_sigma, round((SELECT max(score) FROM bk WHERE bk.query_id = lab.query_id), 6) AS bm25_top, round(coalesce((SELECT max(score) FROM vk WHERE vk.query_id = lab.query_id), 0.0), 6) AS vec_top,
        {R._DUCK_CODE.format(c='text')} AS code_miss, {R._DUCK_CJK.format(c='text')} AS cjk FROM lab JOIN sg USING (query_id) GROUP BY query_id, label, text""",
)
def gate_feature_table(spark, sf_dir, rerank=T.overlap):
    """The features a gate is fitted on, by query; those that an alias answers or that find nothing are left out."""
    scored = R.scores(spark, sf_dir)
    sigma = R.pool(spark, sf_dir, scored=scored, rerank=rerank).groupBy("query_id").agg(F.max("sigma").alias("x"))
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 4 <> 0").select(F.col("item_id").alias("query_id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").alias("label"))
    rows = asked.join(labels, "query_id", "left").join(sigma, "query_id").join(R._evidence(spark, sf_dir, scored), "query_id")
    return rows.select(
        "query_id", "label", F.round("x", 6).alias("max_sigma"), F.round("bm25_top", 6).alias("bm25_top"), F.round("vec_top", 6).alias("vec_top"),
        T.names_code(F.col("text")).alias("code_miss"), T.cjk_dominant(F.col("text")).alias("cjk"),
    )


@query(
    "hybrid_search_expanded",
    f"""WITH {R.BM25_SQL.format(where='').replace('FROM benchmark)', "FROM (SELECT item_id, text || ' ' || split_part(text, ' ', 1) AS text FROM benchmark))")}, {R.VECTOR_SQL.format(where=R.PAIRED)},
        vk AS (SELECT * FROM v WHERE rank <= 15), bk AS (SELECT * FROM b WHERE rank <= 15), {R._CONVEX} {R._TOP.format(of='cx').replace('<= 10', '<= 5')}""",
)
def hybrid_search_expanded(spark, sf_dir, expand=lambda q: F.concat_ws(" ", q, F.split_part(q, F.lit(" "), F.lit(1))), k: int = 5):
    """Hybrid search whose legs see an expanded query; three times k candidates a leg. The vectors of queries are given."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", expand(F.col("text")).alias("text"))
    scored = R.index(spark, sf_dir).top_k(bm25.queries_of(asked, "text", "item_id"), 3 * k).drop("rank")
    return bm25.ranked(fusion.convex(*R.legs(spark, sf_dir, 3 * k, scored=scored), w=0.7), k).withColumn("score", F.round("score", 6))


@query("percent_clamp", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 3 - 10 BETWEEN 0 AND 100 THEN l_quantity * 3 - 10 END AS percent FROM lineitem")
def percent_clamp(spark, sf_dir):
    """Numbers given as texts; those outside 0 to 100 are void."""
    given = (F.col("l_quantity") * 3 - 10).cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.within(given, 0, 100).alias("percent"))


@query("industry_map", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'vehicles' WHEN 'MACHINERY' THEN 'vehicles' WHEN 'FURNITURE' THEN 'home' WHEN 'HOUSEHOLD' THEN 'home' ELSE 'other' END AS industry FROM customer")
def industry_map(spark, sf_dir):
    groups = {"vehicles": ["Automobile", "Machinery"], "home": ["Furniture", "Household"]}
    return table(spark, sf_dir, "customer").select("c_custkey", V.industry(F.col("c_mktsegment"), groups).alias("industry"))


@query(
    "seed_format",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'full' WHEN p_size % 3 = 1 THEN 'brief' ELSE 'unknown' END AS format FROM part""",
)
def seed_format(spark, sf_dir):
    """Seed records by the keys they have: with pay the full form, with a title alone the brief one, else neither."""
    size = F.col("p_size") % 3
    record = F.when(size == 0, F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_retailprice").alias("pay")))).when(size == 1, F.to_json(F.struct(F.col("p_name").alias("title")))).otherwise(F.to_json(F.struct("p_size")))
    keys = F.json_object_keys(record)
    kind = F.when(F.array_contains(keys, "pay"), "full").when(F.array_contains(keys, "title"), "brief").otherwise("unknown")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("format"))


@query(
    "source_blocks",
    """SELECT doc_id, md5('<source' || coalesce(' id="' || doc_id || '"', '') || coalesce(' lang="' || lang || '"', '') || coalesce(' name="' || replace(replace(replace(replace(source, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '"', '') || '>' || chr(10)
       || regexp_replace(text || ' </Source>', '(?i)</(\\s*source)', '<\\\\/\\1', 'g') || chr(10) || '</source>') AS block_md5 FROM documents""",
)
def source_blocks(spark, sf_dir):
    """Texts as elements for a prompt; an end tag within a text doesn't close its element."""
    block = V.source_block(F.concat("text", F.lit(" </Source>")), {"name": F.col("source"), "lang": F.col("lang"), "id": F.col("doc_id")})
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(block).alias("block_md5"))


@query(
    "source_list",
    """SELECT conv_id, md5(string_agg('<source id="t' || turn || '" type="' || role || '">' || chr(10) || text || chr(10) || '</source>', chr(10) || chr(10) ORDER BY turn)) AS sources_md5 FROM conversations GROUP BY 1""",
)
def source_list(spark, sf_dir):
    """The turns of a conversation as the sources of a prompt; an id that comes twice would be an error."""
    each = F.struct("turn", F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("type"), "text").alias("source"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["source"]).alias("sources"))
    return rows.select("conv_id", F.md5(V.source_list(F.col("sources"))).alias("sources_md5"))


@query(
    "bullet_block",
    """WITH p AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN len(w) > 0 THEN '- words: ' || array_to_string(w[1:8], ', ') END,
       CASE WHEN len(list_filter(w, lambda x: length(x) > 6)) > 0 THEN '- long: ' || array_to_string(list_filter(w, lambda x: length(x) > 6)[1:6], ', ') END,
       CASE WHEN len(list_filter(w, lambda x: length(x) < 3)) > 0 THEN '- short: ' || array_to_string(list_filter(w, lambda x: length(x) < 3)[1:4], ', ') END)) AS block_md5 FROM p""",
)
def bullet_block(spark, sf_dir):
    """Lists as lines, eight, six and four entries at most; a list without entries has no line."""
    words = F.split("text", " ")
    lists = {"words": (words, 8), "long": (F.filter(words, lambda x: F.length(x) > 6), 6), "short": (F.filter(words, lambda x: F.length(x) < 3), 4)}
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(V.bullets(lists)).alias("block_md5"))


@query("capped_texts", "SELECT doc_id, left(text, 500) AS evidence, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS value FROM documents")
def capped_texts(spark, sf_dir):
    """Evidence is cut at 500 characters; a shown value at 80, with a mark."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(500)).alias("evidence"), V.capped(F.col("text"), 80).alias("value"))


@query("json_arrays_decoded", "SELECT p_partkey, i - 1 AS pos, w[i] AS entry FROM (SELECT p_partkey, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))")
def json_arrays_decoded(spark, sf_dir):
    """Arrays kept as JSON text, read back."""
    kept = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.split("p_name", " ")).alias("json"))
    return kept.select("p_partkey", F.posexplode(F.from_json("json", "array<string>")).alias("pos", "entry"))


@query(
    "last_evidence_ids",
    """WITH a AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: length(x) > 8)[1:10] AS ids FROM conversations WHERE role = 'assistant')
       SELECT conv_id, max(turn) AS turn, array_to_string(max_by(ids, turn), ',') AS ids FROM a WHERE len(ids) > 0 GROUP BY 1""",
)
def last_evidence_ids(spark, sf_dir):
    """The last assistant turn that has evidence, and its first ten ids (long words stand in)."""
    ids = F.slice(F.filter(F.split("text", " "), lambda x: F.length(x) > 8), 1, 10)
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", ids.alias("ids")).filter(F.size("ids") > 0)
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.array_join(F.max_by("ids", "turn"), ",").alias("ids"))


@query(
    "enrichment_merge",
    """SELECT o.p_partkey AS id, CASE WHEN trim(n.p_brand) <> '' AND n.p_size % 2 = 0 THEN n.p_brand ELSE o.p_type END AS topic, CASE WHEN n.p_size BETWEEN 1 AND 30 THEN n.p_size ELSE o.p_size END AS level,
       array_to_string(CASE WHEN n.p_size % 3 = 0 THEN string_split(n.p_name, ' ') ELSE ['old'] END, ',') AS tags, o.p_name AS name FROM part o LEFT JOIN part n ON n.p_partkey = o.p_partkey AND n.p_size % 5 <> 0""",
)
def enrichment_merge(spark, sf_dir):
    """Generated fields are merged into records: listed fields only, no empty or invalid values, nothing else touched."""
    part = table(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("topic"), F.col("p_size").alias("level"), F.array(F.lit("old")).alias("tags"), F.col("p_name").alias("name"))
    tags = F.when(F.col("p_size") % 3 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    new = part.filter("p_size % 5 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("topic"), F.col("p_size").alias("level"), tags.alias("tags"), F.lit("ignored").alias("name"))
    merged = tables.merge_fields(old, new, "id", ["topic", "level", "tags"], {"level": F.col("level").between(1, 30)})
    return merged.withColumn("tags", F.array_join("tags", ","))


@query(
    "constraint_violations",
    """SELECT p_partkey AS id, 'size' AS rule FROM part WHERE NOT (p_size < 45) UNION ALL SELECT p_partkey, 'price' FROM part WHERE NOT (p_retailprice > 905)
       UNION ALL SELECT p_partkey, 'unique' FROM part WHERE (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM part GROUP BY p_brand, p_type HAVING count(*) > 1)
       UNION ALL SELECT p_partkey, 'nation' FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)""",
)
def constraint_violations(spark, sf_dir):
    """Rows that break a check, a uniqueness or a reference, with the rule."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    checks = {"size": F.col("p_size") < 45, "price": F.col("p_retailprice") > 905}
    return tables.violations(part, "id", checks, {"unique": ["p_brand", "p_type"]}, {"nation": ("p_size", table(spark, sf_dir, "nation").select("n_nationkey"))})


K_ANON_SQL = f"""WITH {_COOP}, n AS (SELECT id, company, role, term, count(*) OVER (PARTITION BY company, role, term) AS e, count(*) OVER (PARTITION BY CASE WHEN company IS NULL THEN 'none' ELSE 'some' END, role, term) AS c FROM coop)
        SELECT id, CASE WHEN e >= 3 THEN 'released' WHEN c >= 3 THEN 'generalized' ELSE 'held' END AS decision,
        CASE WHEN e >= 3 THEN coalesce(company, '') || '|' || coalesce(role, '') || '|' || coalesce(term, '') WHEN c >= 3 THEN CASE WHEN company IS NULL THEN 'none' ELSE 'some' END || '|' || coalesce(role, '') || '|' || coalesce(term, '') END AS released_keys FROM n"""


@query("k_anon_queue", K_ANON_SQL)
def k_anon_queue(spark, sf_dir):
    """Held records and new ones: released as groups, with a coarser company, or held on. A null key equals null and shows as ''."""
    rows = coop(spark, sf_dir).select("id", "company", "role", "term")
    bucket = {"company": F.when(F.col("company").isNull(), "none").otherwise("some")}
    return privacy.release_queue(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["company", "role", "term"], bucket, 3).select("id", "decision", "released_keys")


PROTECTED = ("contributor_user_id", "redaction_audit")


def without_protected(rows: DataFrame) -> DataFrame:
    """``rows`` without the columns that never leave the engine."""
    return rows.drop(*PROTECTED)


@query("evidence_projection", "SELECT conv_id, count(*) AS n, md5(string_agg(turn || ':' || role, ',' ORDER BY turn)) AS evidence_md5 FROM conversations GROUP BY 1")
def evidence_projection(spark, sf_dir):
    """Results as arrays of structs, cut down to what evidence shows; protected columns go before anything is built."""
    rows = without_protected(table(spark, sf_dir, "conversations").withColumns({"contributor_user_id": F.col("conv_id"), "redaction_audit": F.lit("x")}))
    results = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("results"))
    shown = F.transform("results", lambda r: F.struct(r["turn"].alias("id"), r["role"].alias("name")))
    return results.select("conv_id", F.size(shown).alias("n"), F.md5(F.array_join(F.transform(shown, lambda r: F.concat_ws(":", r["id"].cast("string"), r["name"])), ",")).alias("evidence_md5"))


@query(
    "login_upsert",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE 'old' || c_custkey END AS email, CASE WHEN c_custkey % 6 = 0 THEN 'N' ELSE c_name END AS display_name, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 > 0 THEN c_nationkey END AS contributions,
       CASE WHEN c_custkey % 3 = 0 THEN 'now' ELSE 'before' END AS login FROM customer""",
)
def login_upsert(spark, sf_dir):
    """A login overwrites the address, keeps a name where none is given, leaves counts alone and stamps the time."""
    c = table(spark, sf_dir, "customer")
    name = lambda head: F.concat(F.lit(head), F.col("c_custkey").cast("string"))
    count = F.when((F.col("c_custkey") % 2 == 0) | (F.col("c_custkey") % 3 > 0), F.col("c_nationkey"))
    old = c.select(F.col("c_custkey").alias("id"), name("old").alias("email"), F.col("c_name").alias("display_name"), count.alias("contributions"), F.lit("before").alias("login"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), name("new").alias("email"), F.when(F.col("c_custkey") % 6 == 0, "N").alias("display_name"), F.lit(0).alias("contributions"))
    return tables.upsert(old, new, "id", ("display_name",), ("contributions",), {"login": F.lit("now")})
