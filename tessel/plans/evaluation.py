"""Evaluation queries: metrics, sweeps, percentiles, samples, conversations, pages, streams as batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessel.operators import bm25, fusion, logistic, metrics, models
from tessel.operators.ranks import placed, values_at
from tessel.plans import retrieval as R
from tessel.plans.registry import literal_rows, over, query
from tessel.session import settle, table
from tessel.sources.catalog import course_records
from tessel.sources.html import block_rows, link_rows
from tessel.streaming.events import conversation_events, tumbling

# expected documents of a benchmark passage: those that hold it
_TRUTH = f"""WITH {R.BM25_SQL.format(where='')}, top5 AS (SELECT query_id, list(doc_id ORDER BY rank) AS got FROM b WHERE rank <= 5 GROUP BY 1),
ex AS (SELECT item_id AS query_id, list(doc_id ORDER BY doc_id) AS want FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
e AS (SELECT item_id AS query_id, coalesce(want, []) AS want, coalesce(got, []) AS got, CASE WHEN length(text) % 2 = 0 THEN 'simple' ELSE 'complex' END AS category FROM benchmark LEFT JOIN ex ON ex.query_id = item_id LEFT JOIN top5 ON top5.query_id = item_id),
m AS (SELECT *, CASE WHEN len(want) > 0 THEN len(list_filter(want, lambda x: list_contains(got, x))) / least(len(want), 5)::DOUBLE END AS recall,
      CASE WHEN len(want) > 0 THEN len(list_filter(want, lambda x: list_contains(got, x))) / len(want)::DOUBLE END AS recall_all,
      CASE WHEN len(want) > 0 THEN coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(got, lambda x, i: CASE WHEN list_contains(want, x) THEN i END), lambda p: p IS NOT NULL)), 0)
           WHEN len(got) = 0 THEN 1.0 ELSE 0.0 END AS rr FROM e)"""


def judged(spark, sf_dir) -> DataFrame:
    """(query_id, query, category, want): benchmark items with the documents that hold them."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.when(F.length("text") % 2 == 0, "simple").otherwise("complex").alias("category"))
    want = R.passage_hits(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("want"))
    return items.join(want, "query_id", "left")


def lexical_search(spark, sf_dir, k: int = 5):
    """A search to evaluate: (query_id, query) to the first k by BM25."""
    return lambda asked: R.index(spark, sf_dir).top_k(bm25.queries_of(asked, "query", "query_id"), k)


def measured(spark, sf_dir, search=None) -> DataFrame:
    return models.evaluate(search or lexical_search(spark, sf_dir), judged(spark, sf_dir))


@query("recall_at_k", _TRUTH + " SELECT query_id, round(recall, 6) AS recall, round(recall_all, 6) AS recall_all FROM m")
def recall_at_k(spark, sf_dir):
    return measured(spark, sf_dir).select("query_id", F.round("recall", 6).alias("recall"), F.round("recall_all", 6).alias("recall_all"))


@query("mrr", _TRUTH + " SELECT round(avg(recall), 6) AS recall, round(avg(rr) FILTER (WHERE len(want) > 0), 6) AS mrr, count(*) FILTER (WHERE len(want) > 0) AS scored, count(*) AS queries FROM m")
def mrr(spark, sf_dir):
    has = F.size("want") > 0
    return measured(spark, sf_dir).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.when(has, F.col("rr"))), 6).alias("mrr"), F.count_if(has).alias("scored"), F.count("*").alias("queries"))


@query("eval_by_category", _TRUTH + " SELECT category, round(avg(recall), 6) AS recall, count(*) AS n FROM m GROUP BY 1")
def eval_by_category(spark, sf_dir):
    return measured(spark, sf_dir).groupBy("category").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n"))


_SWEEP = f"""WITH {R.BM25_SQL.format(where='')}, {R._SIGMA}, x AS (SELECT item_id AS query_id, coalesce(max(sigma), 0)::DOUBLE AS x FROM benchmark LEFT JOIN sg ON query_id = item_id GROUP BY 1),
real AS (SELECT DISTINCT item_id AS query_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(0, 21) r(i))"""


@query(
    "threshold_sweep",
    _SWEEP + """ SELECT threshold, count(*) FILTER (WHERE is_real AND x < threshold) AS false_rejections, count(*) FILTER (WHERE NOT is_real AND x < threshold) AS caught,
        count(*) FILTER (WHERE is_real) AS n_real, count(*) FILTER (WHERE NOT is_real) AS n_adv FROM t, (SELECT x.*, real.query_id IS NOT NULL AS is_real FROM x LEFT JOIN real USING (query_id)) GROUP BY 1""",
)
def threshold_sweep(spark, sf_dir):
    x = R.pool(spark, sf_dir).groupBy("query_id").agg(F.max("sigma").alias("x"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    real = R.passage_hits(spark, sf_dir).select("query_id").distinct().withColumn("real", F.lit(True))
    rows = settle(items.select("query_id").join(x, "query_id", "left").join(real, "query_id", "left").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("real", F.lit(False)).alias("real")), "sweep")
    grid = spark.range(21).select((F.col("id") / 20.0).alias("threshold"))
    low = F.col("x") < F.col("threshold")
    return rows.join(F.broadcast(grid)).groupBy("threshold").agg(
        F.count_if(F.col("real") & low).alias("false_rejections"), F.count_if(~F.col("real") & low).alias("caught"), F.count_if(F.col("real")).alias("n_real"), F.count_if(~F.col("real")).alias("n_adv")
    )


_ALPHAS = " UNION ALL ".join(f"SELECT {a} AS alpha, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, doc_id) AS rank FROM bl{i}" for i, a in enumerate((0.0, 0.4, 1.0)))


@query(
    "alpha_sweep",
    f"WITH {R.BM25_SQL.format(where='')}, {R._SIGMA}, " + ", ".join(R._BLEND.format(a=a).replace("bl AS", f"bl{i} AS", 1) for i, a in enumerate((0.0, 0.4, 1.0)))
    + f" SELECT alpha::DOUBLE AS alpha, query_id, doc_id FROM ({_ALPHAS}) WHERE rank = 1",
)
def alpha_sweep(spark, sf_dir):
    """The winner of each query under several weights, over one scored pool."""
    scored = settle(R.pool(spark, sf_dir), "pool")
    first, *rest = [bm25.ranked(fusion.blend(scored, a), 1, "blended").select(F.lit(a).alias("alpha"), "query_id", "doc_id") for a in (0.0, 0.4, 1.0)]
    for x in rest:
        first = first.unionByName(x)
    return first


# a grid of configurations: the cases, and one for each brand of parts
_CASES = literal_rows([(0.1, 0.62, 0.61), (0.2, 0.64, 0.605), (0.3, 0.65, 0.60), (0.4, 0.637, 0.606), (0.5, 0.5, 0.7)], "alpha, recall, mrr")


_GRID = f"(SELECT 'case' || cast(alpha AS varchar(9)) AS config, cast(alpha AS double) AS alpha, cast(recall AS double) AS recall, cast(mrr AS double) AS mrr FROM {_CASES} UNION ALL SELECT p_brand, avg(p_size) / 50, avg(p_size) / 42, avg(p_retailprice) / 2400 FROM part GROUP BY p_brand) AS t(config, alpha, recall, mrr)"


@query(
    "pareto_winner",
    f"""SELECT config, round(alpha, 8) AS alpha, round(recall, 8) AS recall, round(mrr, 8) AS mrr, CASE WHEN recall >= 0.636 AND mrr >= 0.603 THEN 0 WHEN recall >= 0.62 THEN 1 ELSE 2 END AS tier FROM {_GRID}
        ORDER BY tier, mrr DESC, recall DESC LIMIT 1""",
)
def pareto_winner(spark, sf_dir):
    best = metrics.winner(over(spark, sf_dir, "part", _GRID))
    return best.select("config", *[F.round(c, 8).alias(c) for c in ("alpha", "recall", "mrr")], "tier")


@query(
    "auc",
    """WITH r AS (SELECT n_chars, quality, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents JOIN labels USING (doc_id)),
       c AS (SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg, sum(rank) FILTER (WHERE quality = 1) AS s FROM r)
       SELECT n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2)::DOUBLE / (n_pos * n_neg), 8) AS auc FROM c""",
)
def auc(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return metrics.auc_ordinal(rows, "n_chars", "quality", "doc_id")


@query(
    "latency_pctl_floor",
    """SELECT event_type, list_sort(list(value))[(least(count(*) - 1, floor(count(*) * 0.5)::BIGINT) + 1)::BIGINT] AS p50, list_sort(list(value))[(least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1)::BIGINT] AS p95,
       list_sort(list(value))[(greatest(0, floor(count(*) * 0.95)::BIGINT - 1) + 1)::BIGINT] AS p95_low FROM events GROUP BY 1""",
)
def latency_pctl_floor(spark, sf_dir):
    n = F.col("n")
    at = lambda p: F.least(n - 1, F.floor(n * p))
    return values_at(table(spark, sf_dir, "events"), "value", ["event_type"], {"p50": at(0.5), "p95": at(0.95), "p95_low": F.greatest(F.lit(0), F.floor(n * 0.95) - 1)}).drop("n")


@query("latency_pctl_interp", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def latency_pctl_interp(spark, sf_dir):
    r = lambda c: F.round(c, 6)
    rows = table(spark, sf_dir, "events")
    means = rows.groupBy("event_type").agg(r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("stdev"))
    quantiles = metrics.interpolated(rows.filter("value is not null"), "value", ["event_type"], {"p95": 0.95, "median": 0.5})
    return means.join(quantiles, "event_type", "left").select("event_type", r("p95").alias("p95"), "mean", "stdev", r("median").alias("median"))


@query("matched_via_dist", "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY 1")
def matched_via_dist(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "event_type")))


@query("strided_sample", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE rn % greatest(n // 20, 1) = 0 ORDER BY doc_id LIMIT 20")
def strided_sample(spark, sf_dir, m: int = 20):
    """Every n/m-th by id, the first m: the sampling is the feature. Ids are ranked by ranges, not in one task."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    rows, n = placed(ids, ["doc_id"])
    return rows.filter((F.col("place") - 1) % max(n // m, 1) == 0).select("doc_id").orderBy("doc_id").limit(m)


@query("stratified_round_robin", "SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 50")
def stratified_round_robin(spark, sf_dir, m: int = 50):
    """One of each source in turn until ``m``; Spark prunes each source to its first m ranks before sorting."""
    rn = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", rn.alias("rn")).filter(F.col("rn") <= m).orderBy("rn", "source").limit(m)


@query("last_n_turns", "SELECT conv_id, turn, role, left(text, 4000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6 AND length(trim(text)) > 0")
def last_n_turns(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = table(spark, sf_dir, "conversations").withColumn("rn", rn).filter("rn <= 6")
    return last.filter(F.length(F.trim("text")) > 0).select("conv_id", "turn", "role", F.left("text", F.lit(4000)).alias("text"))


@query("last_evidence_turn", "SELECT conv_id, max(turn) AS turn, md5(max_by(text, turn)) AS evidence_md5 FROM conversations WHERE role = 'assistant' AND length(text) > 0 GROUP BY 1")
def last_evidence_turn(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant' AND length(text) > 0")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.md5(F.max_by("text", "turn")).alias("evidence_md5"))


@query("history_transcript", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS transcript_md5 FROM conversations GROUP BY 1")
def history_transcript(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda t: t["line"]), "\n")).alias("transcript_md5"))


@query("ndjson_events", "SELECT conv_id, turn AS seq, CASE WHEN turn = min(turn) OVER w THEN 'meta' WHEN turn = max(turn) OVER w THEN 'done' ELSE 'token' END AS kind FROM conversations WINDOW w AS (PARTITION BY conv_id)")
def ndjson_events(spark, sf_dir):
    return conversation_events(table(spark, sf_dir, "conversations")).select("conv_id", "seq", "kind")


@query(
    "rarest_terms",
    f"""WITH {R.BM25_SQL.format(where='')} SELECT doc_id, term, rank FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(idf, 8) DESC, term) AS rank FROM p JOIN idf USING (term) WHERE term <> '__empty__') WHERE rank <= 3""",
)
def rarest_terms(spark, sf_dir):
    index = R.index(spark, sf_dir)
    terms = index.postings(index.term_stats().filter("term <> '__empty__'").select("term", F.round("idf", 8).alias("idf")))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("idf"), "term"))
    return terms.select("doc_id", "term", rank.alias("rank")).filter("rank <= 3")


@query("acronym_glossary", "WITH c AS (SELECT p_brand AS k, lower(p_name) AS sense, count(*) AS n FROM part GROUP BY ALL) SELECT k, sense, rn FROM (SELECT k, sense, row_number() OVER (PARTITION BY k ORDER BY n DESC, sense) AS rn FROM c) WHERE rn <= 3")
def acronym_glossary(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k"), F.lower("p_name").alias("sense")).agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(F.desc("n"), "sense"))).filter("rn <= 3").select("k", "sense", "rn")


@query(
    "html_links",
    """SELECT page_id, href, min(i) AS first_pos, count(*) AS n FROM (SELECT page_id, hs[i] AS href, i FROM (SELECT page_id, hs, unnest(generate_series(1, len(hs))) AS i FROM
       (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages))) GROUP BY ALL""",
)
def html_links(spark, sf_dir):
    return link_rows(table(spark, sf_dir, "pages")).groupBy("page_id", "href").agg(F.min("pos").cast("long").alias("first_pos"), F.count("*").alias("n"))


_BLOCKS = "regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<p>(.*?)</p>', 1)"


@query("html_blocks", f"SELECT page_id, i - 1 AS pos, md5(bs[i]) AS block_md5 FROM (SELECT page_id, bs, unnest(generate_series(1, len(bs))) AS i FROM (SELECT page_id, {_BLOCKS} AS bs FROM pages))")
def html_blocks(spark, sf_dir):
    return block_rows(table(spark, sf_dir, "pages")).select("page_id", "pos", F.md5("block").alias("block_md5"))


@query(
    "kappa",
    """WITH c AS (SELECT quality AS a, 1 - toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE a = b) AS same FROM c),
       ma AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), mb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), e AS (SELECT sum(ma.n * mb.n) AS e FROM ma JOIN mb ON a = b)
       SELECT round((same / t.n - e / (t.n * t.n)) / (1 - e / (t.n * t.n)), 8) AS kappa FROM t, e""",
)
def kappa(spark, sf_dir):
    """Cohen's kappa of two binary annotators, from the four cells."""
    one = lambda x: F.sum(F.when(x, 1.0).otherwise(0.0))
    a, b = F.col("quality"), 1 - F.col("toxic")
    s = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), one(a == b).alias("same"), one(a == 1).alias("a1"), one(b == 1).alias("b1"))
    chance = (F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1"))) / (F.col("n") * F.col("n"))
    return s.select(F.round((F.col("same") / F.col("n") - chance) / (1 - chance), 8).alias("kappa"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> ''))"
_WORDS2 = "list_distinct(list_filter(regexp_split_to_array(lower(p_type), '\\s+'), lambda x: x <> ''))"


@query("set_iou", f"SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 8) AS iou FROM (SELECT p_partkey, {_WORDS} AS a, {_WORDS2} AS b FROM part)")
def set_iou(spark, sf_dir):
    a, b = (F.array_remove(F.array_distinct(F.split(F.lower(c), r"\s+")), "") for c in ("p_name", "p_type"))
    both = F.size(F.array_union(a, b))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both), 8).alias("iou"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return tumbling(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


_EDGES = "e AS (SELECT n_nationkey AS course_id, n_regionkey + 20 AS prereq_id FROM nation UNION ALL SELECT n_nationkey + 1, n_nationkey FROM nation WHERE n_nationkey BETWEEN 20 AND 23)"


@query("prereq_closure", f"WITH RECURSIVE {_EDGES}, c AS (SELECT course_id, prereq_id, 1 AS depth FROM e UNION ALL SELECT c.course_id, e.prereq_id, depth + 1 FROM c JOIN e ON c.prereq_id = e.course_id WHERE depth < 10 AND e.prereq_id <> e.course_id) SELECT course_id, prereq_id, min(depth) AS depth FROM c GROUP BY ALL")
def prereq_closure(spark, sf_dir):
    """All prerequisites over any number of steps up to ten, with the least number."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation_closure")
    edges = _EDGES.replace("FROM nation", "FROM nation_closure")
    return spark.sql(
        f"""WITH RECURSIVE {edges}, c(course_id, prereq_id, depth) AS (SELECT course_id, prereq_id, 1 FROM e UNION ALL
            SELECT c.course_id, e.prereq_id, depth + 1 FROM c JOIN e ON c.prereq_id = e.course_id WHERE depth < 10 AND e.prereq_id <> e.course_id)
            SELECT course_id, prereq_id, min(depth) AS depth FROM c GROUP BY course_id, prereq_id"""
    )


@query("logreg_fit")
def logreg_fit(spark, sf_dir):
    """Logistic regression of quality on two features of texts; coefficients by name. Iterative: no SQL twin."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("quality").alias("label"), F.log1p(F.col("n_chars")).alias("log_chars"), (F.length(F.regexp_replace("text", "[A-Za-z ]", "")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("other_share")
    )
    names = ["log_chars", "other_share"]
    weights, bias, _ = logistic.fit(rows, names, "label")
    return spark.createDataFrame([*zip(names, map(float, weights), strict=True), ("bias", bias)], "name string, weight double")


def load_overlap():
    """A stand-in reranker as a task loads it: the share of the query's words that the text has."""
    words = lambda t: {w for w in t.lower().split() if w}
    return lambda pairs: np.array([len(words(q) & words(t)) / max(1, len(words(q))) for q, t in pairs])


@query(
    "rerank_batched",
    f"""WITH {R.BM25_SQL.format(where='')}, {R._SIGMA} SELECT query_id, doc_id, round(sigma, 6) AS score, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sigma DESC, doc_id) AS rank FROM sg) WHERE rank <= 5""",
)
def rerank_batched(spark, sf_dir, load=load_overlap):
    """The rerank of ``rerank_overlap`` by a model that tasks load and that sees batches of pairs."""
    pool = settle(R.candidates(spark, sf_dir), "pairs")  # read twice: for the different pairs and for all
    scored = models.rerank(pool, "query", "text", load).select("query_id", "doc_id", F.col("sigma").alias("score"))
    return bm25.ranked(scored, 5).withColumn("score", F.round("score", 6))


# each paragraph of a page as a course block; every seventh isn't closed, every fifth has no course's title
_COURSES = f"""WITH b AS (SELECT page_id, i - 1 AS pos, md5(bs[i]) AS h FROM (SELECT page_id, bs, unnest(generate_series(1, len(bs))) AS i FROM (SELECT page_id, {_BLOCKS} AS bs FROM pages)))
SELECT page_id, pos::INT AS pos, CASE WHEN pos % 7 <> 6 THEN 'PT ' || lpad(pos::VARCHAR, 4, '0') END AS code, CASE WHEN pos % 7 <> 6 THEN 'Part ' || left(h, 6) END AS name, CASE WHEN pos % 7 <> 6 AND pos % 2 = 0 THEN (pos % 6)::INT END AS credits,
       CASE WHEN pos % 7 <> 6 THEN h || ' & more' END AS description, CASE WHEN pos % 7 <> 6 THEN 'DS 1000' || CASE WHEN pos % 3 = 0 THEN ',CS 2000A' ELSE '' END END AS prereqs, CASE WHEN pos % 7 = 6 THEN 'unclosed block' END AS error
FROM b WHERE pos % 7 = 6 OR pos % 5 <> 4"""


@query("course_records", _COURSES)
def course_records_q(spark, sf_dir):
    """Records of catalog pages that hold the paragraphs of the pages, an error row for each bad block."""
    pos, h = F.col("pos"), F.md5("block")
    title = F.concat(F.when(pos % 5 == 4, "Section ").otherwise("PT "), F.lpad(pos.cast("string"), 4, "0"), F.lit(". Part "), F.left(h, F.lit(6)), F.lit(". ("), (pos % 6).cast("string"), F.when(pos % 2 == 0, "").otherwise(".5"), F.lit(" Hours)"))
    link = lambda code: f'<a class="bubblelink code" href="/x">{code}</a>'
    extra = F.concat(F.lit('<p class="courseblockextra"><strong>Prerequisite(s):</strong> ' + link("DS1000")), F.when(pos % 3 == 0, link("CS 2000A")).otherwise(link("none of these")), F.lit("</p>"))
    html = F.concat(F.lit('<div class="courseblock wide"><p class="courseblocktitle"><strong>'), title, F.lit('</strong></p><p class="cb_desc">'), h, F.lit(" &amp; <i>more</i></p><div>"), extra, F.lit("</div>"), F.when(pos % 7 == 6, "").otherwise("</div>"))
    blocks = block_rows(table(spark, sf_dir, "pages")).select("page_id", "pos", html.alias("html"))
    pages = blocks.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "").alias("html"))
    return course_records(pages).select("page_id", "pos", "code", "name", "credits", "description", F.array_join("prereqs", ",").alias("prereqs"), "error")
