"""Queries that run a stream over the given tables to its end; their SQL states what its batch twin gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.plans.intake import K_ANON_SQL
from tessel.plans.registry import query
from tessel.plans.state import coop
from tessel.session import at_path, keep_until_exit, settle, shared_path, table
from tessel.streaming import stateful as S


def finished(stream: DataFrame, out: str) -> DataFrame:
    """All that ``stream`` gives for the input there is."""
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def _folder(spark, name: str) -> str:
    out = shared_path(spark, name)
    files, at = at_path(spark, out)
    files.mkdirs(at)
    keep_until_exit(spark, out)
    return out


@query(
    "index_states",
    """WITH d AS (SELECT doc_id, length(trim(coalesce(text, ''))) = 0 AS blank FROM documents)
       SELECT doc_id, CASE WHEN blank THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN NOT blank THEN 1700000000 + doc_id END AS indexed_at, CASE WHEN blank THEN 'empty text' END AS error FROM d""",
)
def index_states(spark, sf_dir):
    """Documents as a stream, file by file, into an index: what became of each."""
    path, docs = _folder(spark, "index-stream"), table(spark, sf_dir, "documents")
    files, at = at_path(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    reader = S.stream_session(spark).readStream.schema(docs.schema).option("maxFilesPerTrigger", 4)
    # a stream's source is a folder: the table's own, or that of its one file
    stream = reader.parquet(str(at)) if files.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    records = stream.select("doc_id", "text", F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")).alias("arrived"))
    S.index_stream(records, path, f"{path}/state").awaitTermination()
    return S.statuses(spark, path).select("doc_id", "status", F.unix_seconds("indexed_at").alias("indexed_at"), "error")


@query("k_anon_stream", K_ANON_SQL)
def k_anon_stream(spark, sf_dir):
    """The queue of ``k_anon_queue`` as a stream: rows are held until the third of their group arrives."""
    rows = settle(coop(spark, sf_dir).select("id", "company", "role", "term").repartition(4), "arrivals")
    stream = S.stream_session(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(rows.settled_at)
    bucket = {"company": F.when(F.col("company").isNull(), "none").otherwise("some")}
    return S.decided(finished(S.deferred_release(stream, "id", ["company", "role", "term"], bucket, 3), _folder(spark, "release-stream")), "id")


_PARTS = """c AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS final FROM conversations),
e AS (SELECT conv_id, turn AS n, CASE WHEN turn = 0 THEN 'meta' ELSE 'token' END AS kind, text FROM c
      UNION ALL SELECT conv_id, final + 1, 'done', NULL FROM c WHERE turn = final AND conv_id % 3 = 0
      UNION ALL SELECT conv_id, final + 1, 'error', CASE WHEN conv_id % 3 = 1 THEN 'backend' ELSE 'timeout' END FROM c WHERE turn = final AND conv_id % 3 <> 0
      UNION ALL SELECT conv_id, final + 2, 'done', NULL FROM c WHERE turn = final AND conv_id % 3 <> 0)"""
_RESPONSES = f"WITH {_PARTS} SELECT conv_id, n, kind, md5(text) AS text_md5 FROM e"


def parts(spark, sf_dir) -> DataFrame:
    """Conversations as parts of responses: a third of them ends, a third has a fault, from a third nothing more comes."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("seq"), "text")
    each = turns.select("conv_id", "seq", F.when(F.col("seq") == 0, "start").otherwise("chunk").alias("part"), "text")
    final = turns.filter("conv_id % 3 <> 2").groupBy("conv_id").agg((F.max("seq") + 1).alias("seq"))
    ends = final.select("conv_id", "seq", F.when(F.col("conv_id") % 3 == 0, "end").otherwise("fault").alias("part"), F.when(F.col("conv_id") % 3 == 1, "backend").alias("text"))
    return each.unionByName(ends).withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("seq")))


@query("response_events", _RESPONSES)
def response_events(spark, sf_dir):
    """Events of responses, each ended by one done, after an error if it failed or fell silent."""
    return S.response_events(parts(spark, sf_dir)).select("conv_id", "n", "kind", F.md5("text").alias("text_md5"))


@query("response_stream", _RESPONSES)
def response_stream(spark, sf_dir):
    """The same as a stream with state and timers; a part an hour later, of a response of its own, lets the silent ones time out."""
    rows = parts(spark, sf_dir)
    late = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).alias("seq"), F.lit("start").alias("part"), F.lit(None).cast("string").alias("text"), F.timestamp_seconds(F.lit(1700003600)).alias("ts"))
    path = _folder(spark, "response-parts")
    # two batches, of every other part each, so many come early; each in as many files as there are cores
    files = spark.sparkContext.defaultParallelism
    for i in (0, 1):
        rows.filter(F.col("seq") % 2 == i).repartition(files).write.mode("append").parquet(path)
    late.coalesce(1).write.mode("append").parquet(path)
    stream = S.stream_session(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    return finished(S.response_stream(stream), _folder(spark, "response-stream")).filter("conv_id >= 0").select("conv_id", "n", "kind", F.md5("text").alias("text_md5"))
