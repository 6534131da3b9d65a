"""Retrieval queries: tokens, BM25, vectors, fusion, rerank, gates, hybrid search."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions.vector import l2_normalize, norm
from tessel.operators import bm25, fusion, vectors
from tessel.operators.lexical import FORMAT, LexicalIndex
from tessel.plans.registry import and_texts, and_texts_sql, literal_rows, query
from tessel.session import at_path, keep_until_exit, settle, shared_dir, shared_path, table

_building = threading.Lock()
_open: dict[str, LexicalIndex] = {}

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def duck_tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda x: NOT list_contains({STOP}, x))"


#: Corpus tokens d(doc_id, toks), query tokens q(query_id, term, times) and BM25 scores s(query_id, doc_id, score).
BM25_SQL = f"""
d AS (SELECT doc_id, lang, source, text, CASE WHEN len(t) = 0 THEN ['__empty__'] ELSE t END AS toks FROM (SELECT *, {duck_tokens('text')} AS t FROM documents)),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term),
raw AS (SELECT term, df, cf, ln((SELECT count(*) FROM d) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df),
idf AS (SELECT term, df, cf, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({duck_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, p.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / (SELECT avg(len(toks)) FROM d)))), 8) AS score
      FROM p JOIN q USING (term) JOIN idf USING (term) JOIN d USING (doc_id) {{where}} GROUP BY query_id, p.doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""
VECTOR_SQL = """
vs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) AS score
       FROM embeddings a, embeddings b WHERE {where}),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs)"""
QUERY_SET = "a.vec_id % 50 = 0"
PAIRED = "a.vec_id IN (SELECT item_id FROM benchmark)"


def index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The stored index of ``documents``, built when it is first asked for.

    Its folder is named after the table's files, so a changed table gets another one, and queries and sessions that share
    a folder share the index. It stays in a folder that ``spark.checkpoint.dir`` names, else it goes with the driver.
    """
    files, at = at_path(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    found, names = files.listFiles(at, True), [f"{FORMAT} {sf_dir}"]
    while found.hasNext():
        of = found.next()
        names.append(f"{of.getPath().getName()} {of.getLen()} {of.getModificationTime()}")
    name = hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark).rstrip('/')}/lexical-index-{name}"
    with _building:
        try:
            if (kept := _open.get(path)) is None or kept.spark is not spark:
                kept = _open[path] = LexicalIndex.load(spark, path)
            return kept
        except FileNotFoundError:
            new = LexicalIndex.build(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "index-being-built"))
            _open[path] = new.move_to(path, keep=spark.conf.get("spark.checkpoint.dir", None) is not None)
            return _open[path]


def scores(spark: SparkSession, sf_dir: str, allowed: DataFrame | None = None, k: int = 30) -> DataFrame:
    """BM25 scores of the first k documents of each benchmark item."""
    return index(spark, sf_dir).top_k(questions(spark, sf_dir), k, allowed).drop("rank")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.queries_of(table(spark, sf_dir, "benchmark"), "text", "item_id")


def passage_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id) of the documents whose text holds a benchmark item's text.

    Tokens within a passage, its first and last one aside, are whole tokens of any text that holds it. So the rarest of
    them has all such documents in its postings, and the text decides. Passages without one are compared with all documents.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    raw = F.regexp_extract_all(F.lower("passage"), F.lit("([a-z0-9]+)"), 1)
    inner = F.filter(F.slice(raw, 2, F.greatest(F.size(raw) - 2, F.lit(0))), lambda t: ~t.isin(T.STOPWORDS))
    items = settle(items.withColumn("inner", inner), "passages")
    found, docs = index(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text")
    inner = settle(items.select("query_id", F.explode("inner").alias("term")), "inner-tokens")
    each = inner.join(found.term_stats(inner).select("term", "df"), "term", "left")
    rarest = settle(each.groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term")), "rarest")
    candidates = settle(found.postings(rarest).select("query_id", "doc_id"), "passage-candidates")
    held = candidates.join(docs, "doc_id").join(items, "query_id").filter(F.contains("text", "passage")).select("query_id", "doc_id")
    short = items.filter(F.size("inner") == 0)
    if short.isEmpty():
        return held
    return held.unionByName(docs.join(short, F.contains("text", "passage")).select("query_id", "doc_id"))


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(
    "tokenize_ascii",
    f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {duck_tokens('text')} AS t FROM documents)",
)
def tokenize_ascii(spark, sf_dir):
    t = T.ascii_tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


_CJK = literal_rows([(1, "Hello, World 123!"), (2, "Dr. Zhang's class — A+"), (3, "应用 AI fundamentals"), (4, "机器学习"), (5, "学 AI"), (6, "the and of"), (7, "AI fundamentals and search algorithms")], "id, t")


@query(
    "tokenize_cjk_bigrams",
    f"""SELECT id, array_to_string(list_concat({duck_tokens('t')}, flatten(list_transform(regexp_extract_all(t, '[一-鿿]+'),
        lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i:i + 1]) END))), '|') AS tokens FROM {and_texts_sql(_CJK, 't')}""",
)
def tokenize_cjk_bigrams(spark, sf_dir):
    return and_texts(spark, sf_dir, _CJK, "t").select("id", F.array_join(T.tokenize(F.col("t")), "|").alias("tokens"))


@query("bm25_term_stats", f"WITH {BM25_SQL.format(where='')} SELECT term, df, cf, round(idf, 8) AS idf FROM idf")
def bm25_term_stats(spark, sf_dir):
    return index(spark, sf_dir).term_stats().select("term", "df", "cf", F.round("idf", 8).alias("idf"))


@query("bm25_topk", f"WITH {BM25_SQL.format(where='')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM b WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return index(spark, sf_dir).top_k(questions(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("bm25_filtered_topk", f"WITH {BM25_SQL.format(where='''WHERE lang = 'de' ''')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM b WHERE rank <= 3")
def bm25_filtered_topk(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id")
    return index(spark, sf_dir).top_k(questions(spark, sf_dir), 3, allowed).withColumn("score", F.round("score", 6))


@query("bm25_zero_overlap_excluded", f"WITH {BM25_SQL.format(where='')} SELECT query_id, count(*) AS eligible, count(*) FILTER (WHERE score <= 0) AS not_positive FROM s GROUP BY query_id")
def bm25_zero_overlap_excluded(spark, sf_dir):
    s = index(spark, sf_dir).score(questions(spark, sf_dir))
    return s.groupBy("query_id").agg(F.count("*").alias("eligible"), F.count_if(F.col("score") <= 0).alias("not_positive"))


@query("vector_topk", f"WITH {VECTOR_SQL.format(where=QUERY_SET)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM v WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return vectors.top_k(v.filter("id % 50 = 0"), v, 10).withColumn("score", F.round("score", 6))


@query("vector_prefiltered_topk", f"WITH {VECTOR_SQL.format(where=QUERY_SET + ' AND b.label = 1')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM v WHERE rank <= 5")
def vector_prefiltered_topk(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return vectors.top_k(v.filter("id % 50 = 0"), v.filter("label = 1"), 5).withColumn("score", F.round("score", 6))


@query(
    "l2_normalize",
    """SELECT vec_id, round(n, 6) AS norm, round(CASE WHEN n = 0 THEN e[1] ELSE e[1] / n END, 6) AS first_value
       FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
)
def l2_normalize_q(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(v), 6).alias("norm"), F.round(l2_normalize(v)[0], 6).alias("first_value"))


def legs(spark, sf_dir, k: int = 30, allowed: DataFrame | None = None, scored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first k by vectors and by BM25 of each benchmark item; item i's query vector is vector i, document i has vector i.

    ``scored``: BM25 scores of the first k or more, if the caller has them.
    """
    v = vectors_of(spark, sf_dir)
    asked = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi")
    base = v if allowed is None else v.join(allowed.select(F.col("doc_id").alias("id")), "id", "left_semi")
    lexical = bm25.ranked(scores(spark, sf_dir, allowed, k) if scored is None else scored, k)
    return vectors.top_k(asked, base, k), lexical


_LEGS = f"WITH {BM25_SQL.format(where='')}, {VECTOR_SQL.format(where=PAIRED)}, vk AS (SELECT * FROM v WHERE rank <= 30), bk AS (SELECT * FROM b WHERE rank <= 30)"
_RRF = "rrf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM (SELECT query_id, doc_id, rank FROM vk UNION ALL SELECT query_id, doc_id, rank FROM bk) GROUP BY ALL)"
_MINMAX = "(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END)::DOUBLE"
_CONVEX = f"""mv AS (SELECT query_id, doc_id, {_MINMAX} AS v FROM vk WINDOW w AS (PARTITION BY query_id)),
mb AS (SELECT query_id, doc_id, {_MINMAX} AS b FROM bk WINDOW w AS (PARTITION BY query_id)),
cx AS (SELECT query_id, doc_id, round(0.7::DOUBLE * coalesce(v, 0) + (1 - 0.7::DOUBLE) * coalesce(b, 0), 10) AS score FROM mv FULL JOIN mb USING (query_id, doc_id))"""
_TOP = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {of}) WHERE rank <= 10"


@query("rrf_fusion", f"{_LEGS}, {_RRF} {_TOP.format(of='rrf')}")
def rrf_fusion(spark, sf_dir):
    return bm25.ranked(fusion.rrf(*legs(spark, sf_dir)), 10).withColumn("score", F.round("score", 6))


@query("convex_fusion", f"{_LEGS}, {_CONVEX} {_TOP.format(of='cx')}")
def convex_fusion(spark, sf_dir):
    return bm25.ranked(fusion.convex(*legs(spark, sf_dir), w=0.7), 10).withColumn("score", F.round("score", 6))


@query(
    "top1_evidence",
    f"""{_LEGS} SELECT item_id AS query_id, round(coalesce((SELECT max(score) FROM vk WHERE vk.query_id = item_id), 0.0), 6) AS vec_top,
        round(coalesce((SELECT max(score) FROM bk WHERE bk.query_id = item_id), 0.0), 6) AS bm25_top FROM benchmark""",
)
def top1_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select("query_id", F.round("vec_top", 6).alias("vec_top"), F.round("bm25_top", 6).alias("bm25_top"))


def _evidence(spark, sf_dir, scored: DataFrame | None = None) -> DataFrame:
    v, b = legs(spark, sf_dir, scored=scored)
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    tops = [x.groupBy("query_id").agg(F.max("score").alias(n)) for x, n in ((v, "vec_top"), (b, "bm25_top"))]
    return ids.join(tops[0], "query_id", "left").join(tops[1], "query_id", "left").fillna(0.0, ["vec_top", "bm25_top"])


_DUCK_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower({c}), '\\s+')), lambda x: x <> '')"
_SIGMA = f"""pool AS (SELECT query_id, doc_id, score FROM b WHERE rank <= 20),
w AS (SELECT pool.*, {_DUCK_WORDS.format(c='benchmark.text')} AS qw, {_DUCK_WORDS.format(c='documents.text')} AS dw
      FROM pool JOIN benchmark ON query_id = item_id JOIN documents USING (doc_id)),
sg AS (SELECT query_id, doc_id, score, len(list_intersect(qw, dw)) / greatest(len(qw), 1)::DOUBLE AS sigma FROM w)"""


def candidates(spark, sf_dir, k: int = 20, scored: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, query, text): the first k by BM25 with the texts of both.

    They meet the documents first: by their written size they are sent to the texts, which stay where they are.
    """
    found = settle(bm25.ranked(scores(spark, sf_dir, k=k) if scored is None else scored, k).drop("rank"), "candidates")  # k rows a query
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = found.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return texts.join(asked, "query_id").select("query_id", "doc_id", "score", "query", "text")


def pool(spark, sf_dir, k: int = 20, scored: DataFrame | None = None, rerank=T.overlap) -> DataFrame:
    """(query_id, doc_id, score, sigma): the first k by BM25 with the reranker's score; ``rerank`` maps query and text to it."""
    return candidates(spark, sf_dir, k, scored).select("query_id", "doc_id", "score", rerank(F.col("query"), F.col("text")).alias("sigma"))


@query(
    "rerank_overlap",
    f"""WITH {BM25_SQL.format(where='')}, {_SIGMA} SELECT query_id, doc_id, round(sigma, 6) AS score, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sigma DESC, doc_id) AS rank FROM sg) WHERE rank <= 5""",
)
def rerank_overlap(spark, sf_dir):
    return bm25.ranked(pool(spark, sf_dir).select("query_id", "doc_id", F.col("sigma").alias("score")), 5).withColumn("score", F.round("score", 6))


_Z = "(CASE WHEN stddev_pop({c}) OVER w <= 1e-12 THEN 0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END)"
_BLEND = f"bl AS (SELECT query_id, doc_id, sigma, round({{a}}::DOUBLE * {_Z.format(c='score')} + (1 - {{a}}::DOUBLE) * {_Z.format(c='sigma')}, 8) AS blended FROM sg WINDOW w AS (PARTITION BY query_id))"


@query(
    "zscore_blend",
    f"""WITH {BM25_SQL.format(where='')}, {_SIGMA}, {_BLEND.format(a=0.4)} SELECT query_id, doc_id, round(blended, 6) AS blended, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, doc_id) AS rank FROM bl) WHERE rank <= 10""",
)
def zscore_blend(spark, sf_dir):
    b = fusion.blend(pool(spark, sf_dir), 0.4)
    return bm25.ranked(b, 10, "blended").select("query_id", "doc_id", F.round("blended", 6).alias("blended"), "rank")


@query(
    "threshold_reject",
    f"""WITH {BM25_SQL.format(where='')}, {_SIGMA}, m AS (SELECT query_id, max(sigma) AS x, count(*) AS n, count(*) FILTER (WHERE sigma >= 0.75) AS above FROM sg GROUP BY query_id)
        SELECT item_id AS query_id, coalesce(x < 0.75, false) AS rejected, CASE WHEN x IS NULL THEN 'no_candidates' WHEN x < 0.75 THEN 'below_threshold' END AS reason,
        round(coalesce(x, 0.0), 6) AS max_sigmoid, coalesce(n, 0) AS n_candidates, CASE WHEN x < 0.75 THEN 0 ELSE coalesce(above, 0) END AS n_above FROM benchmark LEFT JOIN m ON query_id = item_id""",
)
def threshold_reject(spark, sf_dir, bound: float = 0.75):
    m = pool(spark, sf_dir).groupBy("query_id").agg(F.max("sigma").alias("x"), F.count("*").alias("n"), F.count_if(F.col("sigma") >= bound).alias("above"))
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    low = F.coalesce(F.col("x") < bound, F.lit(False))
    return ids.join(m, "query_id", "left").select(
        "query_id", low.alias("rejected"), F.when(F.col("x").isNull(), "no_candidates").when(low, "below_threshold").alias("reason"),
        F.round(F.coalesce("x", F.lit(0.0)), 6).alias("max_sigmoid"), F.coalesce("n", F.lit(0)).alias("n_candidates"), F.when(low, 0).otherwise(F.coalesce("above", F.lit(0))).alias("n_above"),
    )


_DUCK_CODE = r"len(list_filter(regexp_extract_all({c}, '\b([A-Za-z]{{2,5}})[ \t\n]?\d{{4,5}}\b', 1), lambda x: lower(x) NOT IN ('fall', 'spring', 'summer', 'winter', 'autumn', 'term', 'year', 'since'))) > 0"
_DUCK_CJK = r"coalesce(length(regexp_replace({c}, '[^一-鿿㐀-䶿]', '', 'g')) / nullif(length(regexp_replace({c}, '\s', '', 'g')), 0)::DOUBLE > 0.3, false)"


@query(
    "calibrated_gate",
    f"""{_LEGS}, {_SIGMA}, f AS (SELECT item_id AS query_id, least(greatest(coalesce((SELECT max(sigma) FROM sg WHERE sg.query_id = item_id), 0), 1e-6), 1 - 1e-6)::DOUBLE AS x,
        coalesce((SELECT max(score) FROM vk WHERE vk.query_id = item_id), 0)::DOUBLE AS vt, coalesce((SELECT max(score) FROM bk WHERE bk.query_id = item_id), 0)::DOUBLE AS bt,
        ({_DUCK_CODE.format(c='text')})::INT AS code, ({_DUCK_CJK.format(c='text')})::INT AS cjk FROM benchmark),
        z AS (SELECT *, round(1 / (1 + exp(-(-1.6277::DOUBLE + 0.5944::DOUBLE * ln(x / (1 - x)) + 0.7822::DOUBLE * ln(1 + greatest(bt, 0)) * (1 - cjk) + 2.9949::DOUBLE * vt - 3.4026::DOUBLE * code + 1.7244::DOUBLE * cjk))), 8) AS p FROM f)
        SELECT query_id, round(p, 6) AS p_answerable, p < 0.4 AS rejected, format('p_answerable={{:.3f}}', p) AS reason FROM z""",
)
def calibrated_gate(spark, sf_dir):
    scored = scores(spark, sf_dir)
    sigma = pool(spark, sf_dir, scored=scored).groupBy("query_id").agg(F.max("sigma").alias("x"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rows = asked.join(_evidence(spark, sf_dir, scored), "query_id").join(sigma, "query_id", "left")
    p = fusion.p_answerable(F.coalesce("x", F.lit(0.0)), F.col("bm25_top"), F.col("vec_top"), T.names_code(F.col("text")), T.cjk_dominant(F.col("text")))
    return rows.withColumn("p", p).select("query_id", F.round("p", 6).alias("p_answerable"), (F.col("p") < fusion.REJECT_BELOW).alias("rejected"), F.format_string("p_answerable=%.3f", "p").alias("reason"))


_GATE = literal_rows([(1, "CS 5800 workload"), (2, "fall 2025 courses"), (3, "机器学习 课程"), (4, "学 AI fundamentals search"), (5, ""), (6, "那aai 6640"), (7, "XYZ99999 spring 2026"), (8, "see CSYE6225 or term 2024")], "id, q")


@query("gate_features", f"SELECT id, {_DUCK_CODE.format(c='q')} AS code_miss, {_DUCK_CJK.format(c='q')} AS cjk FROM (SELECT * FROM {_GATE}) UNION ALL SELECT 1000 + item_id, {_DUCK_CODE.format(c='text')}, {_DUCK_CJK.format(c='text')} FROM benchmark")
def gate_features(spark, sf_dir):
    rows = spark.sql(f"SELECT cast(id AS bigint) AS id, q FROM {_GATE}").unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("id"), F.col("text").alias("q")))
    return rows.select("id", T.names_code(F.col("q")).alias("code_miss"), T.cjk_dominant(F.col("q")).alias("cjk"))


@query(
    "hybrid_search",
    f"""WITH {BM25_SQL.format(where='''WHERE lang = 'en' ''')}, {VECTOR_SQL.format(where=PAIRED + ''' AND b.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')''')},
        vk AS (SELECT * FROM v WHERE rank <= 15), bk AS (SELECT * FROM b WHERE rank <= 15), {_CONVEX}
        SELECT query_id, rank, doc_id, source, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cx) JOIN documents USING (doc_id) WHERE rank <= 5""",
)
def hybrid_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fused = fusion.convex(*legs(spark, sf_dir, 15, docs.filter("lang = 'en'").select("doc_id")), w=0.7)
    return bm25.ranked(fused, 5).join(docs.select("doc_id", "source"), "doc_id").select("query_id", "rank", "doc_id", "source", F.round("score", 6).alias("score"))


_SCOPED = "scoped AS (SELECT * FROM documents WHERE n_chars % 3 <> 0)"


@query(
    "hybrid_indexed_only",
    f"""WITH {_SCOPED}, {BM25_SQL.format(where='').replace('FROM documents)', 'FROM scoped)')}, {VECTOR_SQL.format(where=PAIRED + ' AND b.vec_id IN (SELECT doc_id FROM scoped)')},
        vk AS (SELECT * FROM v WHERE rank <= 15), bk AS (SELECT * FROM b WHERE rank <= 15), {_CONVEX} {_TOP.format(of='cx').replace('<= 10', '<= 5')}""",
)
def hybrid_indexed_only(spark, sf_dir, k: int = 5):
    """Hybrid search over the rows of one status: the lexical statistics, too, are those of these rows, and both legs see the same."""
    rows = table(spark, sf_dir, "documents").withColumn("status", F.when(F.col("n_chars") % 3 != 0, "indexed").otherwise("pending")).filter("status = 'indexed'")
    own = LexicalIndex.build(rows.select("doc_id", "text"), shared_path(spark, "indexed-only"))
    keep_until_exit(spark, own.path)
    v = vectors_of(spark, sf_dir)
    asked = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi")
    near = vectors.top_k(asked, v.join(rows.select(F.col("doc_id").alias("id")), "id", "left_semi"), 3 * k)
    fused = fusion.convex(near, own.top_k(questions(spark, sf_dir), 3 * k), w=0.7)
    return bm25.ranked(fused, k).withColumn("score", F.round("score", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return bm25_topk(spark, sf_dir)
