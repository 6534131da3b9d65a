"""Streams with state: an index that takes in records once, releases held back until enough arrive, response events.

Each has a batch twin, which its result equals however the input was cut into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessel.operators.lexical import LexicalIndex
from tessel.session import at_path, settle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that can hold such state; the caller's own settings stay as they are."""
    out = spark.newSession()
    out.conf.set(_STORE, _ROCKSDB)
    out.conf.set(_PARTITIONS, spark.conf.get(_PARTITIONS))
    return out


# --- an index that grows by micro-batches


def record_faults(rows: DataFrame, held: DataFrame | None) -> DataFrame:
    """``rows(doc_id, text)`` with ``error``, null for those that can be indexed; ``held(doc_id)`` are indexed already.

    Of rows that share an id the first by text, blank ones last, is the record; the others are repeats.
    """
    known = rows.sparkSession.createDataFrame([], rows.select("doc_id").schema) if held is None else held.select("doc_id")
    known = known.withColumn("__held", F.lit(True))
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    again = F.row_number().over(W.partitionBy("doc_id").orderBy(blank, "text"))
    error = F.when(F.col("doc_id").isNull(), "no id").when(F.col("__held") | (F.col("__again") > 1), "duplicate id").when(blank, "empty text")
    return rows.withColumn("__again", again).join(known, "doc_id", "left").withColumn("error", error).drop("__again", "__held")


def _log(path: str, batch: int, step: str) -> str:
    return f"{path}/statuses/batch={batch}/step={step}"


def take_in(rows: DataFrame, batch: int, path: str) -> None:
    """One batch of ``rows(doc_id, text, arrived)``: pending, then indexed or failed.

    The index's segment is named after the batch and the statuses are written after it. So a batch that is repeated before
    its end does the same again, and one that is repeated after it does nothing.
    """
    spark = rows.sparkSession
    files, done = at_path(spark, f"{_log(path, batch, 'end')}/_SUCCESS")
    if files.exists(done):
        return
    earlier = LexicalIndex.load(spark, f"{path}/index").table("documents", before=_segment(batch)) if _has_index(spark, path, batch) else None
    checked = settle(record_faults(rows, earlier), "checked-records")
    fresh = F.coalesce(F.col("error") != "duplicate id", F.lit(True)) & F.col("doc_id").isNotNull()
    status = checked.filter(fresh).select("doc_id", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(None).cast("string").alias("error"))
    status.write.mode("overwrite").parquet(_log(path, batch, "begin"))
    LexicalIndex(spark, f"{path}/index").add(checked.filter("error is null").select("doc_id", "text"), _segment(batch))
    ok = F.col("error").isNull()
    ended = checked.select("doc_id", F.when(ok, "indexed").otherwise("failed").alias("status"), F.when(ok, F.col("arrived")).alias("indexed_at"), "error")
    ended.write.mode("overwrite").parquet(_log(path, batch, "end"))


def _segment(batch: int) -> str:
    return f"batch-{batch:012d}"


def _has_index(spark: SparkSession, path: str, batch: int) -> bool:
    files, at = at_path(spark, f"{path}/index/segments")
    return files.exists(at) and any(x.getPath().getName() < f"segment={_segment(batch)}" for x in files.listStatus(at))


def index_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Index a stream ``records(doc_id, text, arrived)`` into ``path``: an index in ``index``, a log of statuses in ``statuses``.

    ``indexed_at`` is the time the record arrived, not a clock's: a repeated batch writes the same.
    """
    return records.writeStream.foreachBatch(lambda rows, n: take_in(rows, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, status, indexed_at, error) of each record, the last it got; repeats of its id don't change it."""
    log = spark.read.parquet(f"{path}/statuses").filter("doc_id is not null and (error is null or error <> 'duplicate id')")
    last = F.max_by(F.struct("status", "indexed_at", "error"), F.struct("batch", F.col("step") == "end"))
    return log.groupBy("doc_id").agg(last.alias("x")).select("doc_id", "x.*")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, error, n) of records that failed, those without id or of a taken one too."""
    return spark.read.parquet(f"{path}/statuses").filter("step = 'end' and error is not null").groupBy("doc_id", "error").agg(F.count("*").alias("n"))


# --- releases that wait for enough


class _Release(StatefulProcessor):
    """State of one coarse key: how many rows each exact key has, and the rows of those with fewer than k."""

    def __init__(self, k: int, id_type: str):
        self.k, self.id_type = k, id_type

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", "n long")
        self.counts = handle.getMapState("counts", "exact string", "n long")
        self.held = handle.getMapState("held", "exact string", f"ids array<{self.id_type}>, shown string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        before = (self.total.get() or (0,))[0]
        total, coarse = before, None
        new: dict[str, list] = {}
        for r in rows:
            total, coarse = total + 1, r.coarse_shown
            new.setdefault(r.exact, [r.shown, []])[1].append(r.id)
        self.total.update((total,))
        for exact, (shown, ids) in new.items():
            name = (exact,)
            had = self.counts.getValue(name)[0] if self.counts.containsKey(name) else 0
            self.counts.updateValue(name, (had + len(ids),))
            if had + len(ids) >= self.k:
                if self.held.containsKey(name):
                    ids = [*self.held.getValue(name)[0], *ids]
                    self.held.removeKey(name)
                yield from (Row(id=i, decision="released", released_keys=shown) for i in ids)
            else:
                held = [*self.held.getValue(name)[0], *ids] if self.held.containsKey(name) else ids
                self.held.updateValue(name, (held, shown))
                if before >= self.k:
                    yield from (Row(id=i, decision="generalized", released_keys=coarse) for i in ids)
                elif total < self.k:
                    yield from (Row(id=i, decision="held", released_keys=None) for i in ids)
        if before < self.k <= total:  # all that is still held goes out under the coarser key
            for _, (ids, _) in self.held.iterator():
                yield from (Row(id=i, decision="generalized", released_keys=coarse) for i in ids)

    def close(self) -> None:
        pass


def deferred_release(stream: DataFrame, key: str, keys: list[str], bucket: dict[str, Column], k: int = 2) -> DataFrame:
    """A stream of decisions (key, decision, released_keys) on ``stream``; a later one of a row may go further than an earlier.

    A row is held until ``k`` rows share its ``keys``, then all those go out; until then rows whose keys, with the
    ``bucket`` columns coarser, are shared by ``k`` rows go out so. ``decided`` gives each row's last decision, which is
    that of ``privacy.release_queue`` over all rows, in whatever order and batches they came.
    """
    exact = {c: F.col(c) for c in keys}
    text = lambda of: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in of.values()])
    name = lambda of: F.to_json(F.array(*[c.cast("string") for c in of.values()]))
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("id"), name(exact).alias("exact"), text(exact).alias("shown"), name(exact | bucket).alias("coarse"), text(exact | bucket).alias("coarse_shown"))
    out = rows.groupBy("coarse").transformWithState(_Release(k, kind), f"id {kind}, decision string, released_keys string", "Append", "None")
    return out.withColumnRenamed("id", key)


def decided(decisions: DataFrame, key: str) -> DataFrame:
    """Each row's decision that goes furthest: released, else generalized, else held."""
    order = F.array_position(F.array(F.lit("held"), F.lit("generalized"), F.lit("released")), F.col("decision"))
    return decisions.groupBy(key).agg(F.max_by(F.struct("decision", "released_keys"), order).alias("x")).select(key, "x.*")


# --- events of responses

_EVENTS = "conv_id long, n int, kind string, text string"


class _Response(StatefulProcessor):
    """State of one response: the next part it waits for, parts that came early, how many events it has given.

    Each use of state goes to the executor and back, so parts in their turn don't touch it: only those that stay early do.
    """

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next int, given int, ended boolean, waiting boolean, timer long")
        self.early = handle.getMapState("early", "seq int", "part string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        wanted, given, ended, waiting, timer = self.at.get() or (0, 0, False, False, None)
        latest, new = 0, {}
        for r in rows:
            latest = max(latest, int(r.ts.timestamp() * 1000))
            if not ended and r.seq >= wanted:
                new[r.seq] = r.part, r.text
        while not ended:
            if wanted in new:
                part, text = new.pop(wanted)
                if waiting and self.early.containsKey((wanted,)):
                    self.early.removeKey((wanted,))
            elif waiting and self.early.containsKey((wanted,)):
                part, text = self.early.getValue((wanted,))
                self.early.removeKey((wanted,))
            else:
                break
            wanted += 1
            for kind, text_ in _events(part, text):
                yield Row(conv_id=key[0], n=given, kind=kind, text=text_)
                given += 1
            ended = part in ("end", "fault")
        if not ended:
            for seq, kept in new.items():
                self.early.updateValue((seq,), kept)
            waiting = waiting or bool(new)
        elif waiting:
            self.early.clear()
            waiting = False
        next_ = None if ended else latest + self.patience
        if timer != next_:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if next_ is not None:
                self.handle.registerTimer(next_)
        self.at.update((wanted, given, ended, waiting, next_))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        wanted, given, ended, waiting, _ = self.at.get() or (0, 0, False, False, None)
        if not ended:
            for i, (kind, text) in enumerate(_events("fault", "timeout")):
                yield Row(conv_id=key[0], n=given + i, kind=kind, text=text)
            if waiting:
                self.early.clear()
            self.at.update((wanted, given + 2, True, False, None))

    def close(self) -> None:
        pass


def _events(part: str, text: str | None) -> list[tuple[str, str | None]]:
    """Events of a part of a response: a fault ends it with an error before its done."""
    return {"start": [("meta", text)], "chunk": [("token", text)], "end": [("done", None)], "fault": [("error", text), ("done", None)]}[part]


def response_stream(parts: DataFrame, patience: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Events (conv_id, n, kind, text) of a stream ``parts(conv_id, seq, part, text, ts)``, part being start, chunk, end or fault.

    A response's parts take effect in order of seq from 0, early ones wait. It ends by exactly one done, after an error if
    it had a fault or if no part came for ``patience`` of event time; what comes later is ignored.
    """
    seconds = F.expr(f"INTERVAL {patience}")
    ms = int(parts.sparkSession.range(1).select((F.unix_seconds(F.timestamp_seconds(F.lit(0)) + seconds) * 1000).alias("ms")).first()[0])
    return parts.withWatermark("ts", late).groupBy("conv_id").transformWithState(_Response(ms), _EVENTS, "Append", "EventTime")


def response_events(parts: DataFrame) -> DataFrame:
    """The batch twin of ``response_stream`` after all time has passed: what hasn't ended has timed out."""
    w = W.partitionBy("conv_id").orderBy("seq")
    # parts up to the first gap, and up to the first end
    whole = parts.dropDuplicates(["conv_id", "seq"]).withColumn("place", F.row_number().over(w) - 1).filter("place = seq")
    final = F.col("part").isin("end", "fault")
    before = F.sum(F.when(final, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    kept = whole.withColumn("before", F.coalesce(before, F.lit(0))).filter("before = 0").select("conv_id", "seq", "part", "text")
    open_ = parts.select("conv_id").distinct().join(kept.filter(final).select("conv_id"), "conv_id", "left_anti")
    last = kept.groupBy("conv_id").agg(F.max("seq").alias("seq"))
    timed_out = open_.join(last, "conv_id", "left").select("conv_id", (F.coalesce("seq", F.lit(-1)) + 1).alias("seq"), F.lit("fault").alias("part"), F.lit("timeout").alias("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    none, text = F.lit(None), F.col("text")
    events = (
        F.when(F.col("part") == "start", F.array(event("meta", text))).when(F.col("part") == "chunk", F.array(event("token", text)))
        .when(F.col("part") == "end", F.array(event("done", none))).otherwise(F.array(event("error", text), event("done", none)))
    )
    each = kept.unionByName(timed_out).select("conv_id", "seq", F.posexplode(events).alias("i", "e"))
    # an end's second event follows its first: nothing comes after it
    return each.select("conv_id", (F.col("seq") + F.col("i")).cast("int").alias("n"), "e.kind", "e.text")
