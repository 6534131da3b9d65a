"""Streams with state against their batch twins: replays, restarts, faults, timeouts, any order of arrival."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import privacy
from tessel.operators.lexical import LexicalIndex
from tessel.plans.streams import finished
from tessel.session import at_path, shared_path
from tessel.streaming import stateful as S


def arrive(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


RECORDS = "doc_id long, text string, arrived timestamp"


def records(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("arrived", F.timestamp_seconds(F.lit(1000) + F.coalesce("doc_id", F.lit(0))))


def states(spark, path):
    return sorted((r.doc_id, r.status, r.indexed_at is not None, r.error) for r in S.statuses(spark, path).collect())


def test_index_stream(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    source = S.stream_session(spark).readStream.schema(RECORDS).option("maxFilesPerTrigger", 1)

    def run():
        S.index_stream(source.parquet(folder), path, f"{path}/state").awaitTermination()

    arrive(records(spark, [(1, "graph search"), (2, " "), (None, "no id"), (3, "neural nets"), (3, "repeat"), (4, None)]), folder)
    run()
    first = [(1, "indexed", True, None), (2, "failed", False, "empty text"), (3, "indexed", True, None), (4, "failed", False, "empty text")]
    assert states(spark, path) == first
    arrive(records(spark, [(1, "again"), (2, "now with text"), (5, "graph theory")]), folder)
    run()
    run()  # nothing new
    second = [(1, "indexed", True, None), (2, "indexed", True, None), (3, "indexed", True, None), (4, "failed", False, "empty text"), (5, "indexed", True, None)]
    assert states(spark, path) == second
    assert sorted((r.doc_id or 0, r.error, r.n) for r in S.rejected(spark, path).collect()) == [(0, "no id", 1), (1, "duplicate id", 1), (2, "empty text", 1), (3, "duplicate id", 1), (4, "empty text", 1)]
    # statistics are those of a rebuild
    whole = LexicalIndex.build(spark.createDataFrame([(1, "graph search"), (2, "now with text"), (3, "neural nets"), (5, "graph theory")], "doc_id long, text string"), shared_path(spark, "whole"))
    stats = lambda index: sorted(tuple(r) for r in index.term_stats().collect())
    grown = LexicalIndex.load(spark, f"{path}/index")
    assert stats(grown) == stats(whole) and grown.totals() == whole.totals()
    # a batch that comes again after its end changes nothing; one cut off before its end does the same again
    batch = records(spark, [(1, "again"), (2, "now with text"), (5, "graph theory")])
    S.take_in(batch, 1, path)
    assert states(spark, path) == second and LexicalIndex.load(spark, f"{path}/index").totals() == whole.totals()
    files, done = at_path(spark, f"{path}/statuses/batch=1/step=end")
    files.delete(done, True)
    assert dict((r[0], r[1]) for r in states(spark, path))[5] == "pending"
    S.take_in(batch, 1, path)
    assert states(spark, path) == second and stats(LexicalIndex.load(spark, f"{path}/index")) == stats(whole)


@pytest.mark.parametrize("seed", [1, 2])
def test_releases_in_any_order_and_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["r", "s", None])) for i in range(60)] + [(100 + i, "only", f"x{i % 4}") for i in range(7)]
    schema, folder, out = "id long, company string, role string", str(tmp_path / "in"), str(tmp_path / "out")
    bucket, keys = {"company": F.when(F.col("company").isNull(), "none").otherwise("some")}, ["company", "role"]
    source = S.stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1)
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    twin = lambda some: sorted(map(tuple, privacy.release_queue(spark.createDataFrame(some, schema), spark.createDataFrame([], schema), keys, bucket, 3).select("id", "decision", "released_keys").collect()))
    for n in (2, 4):  # two runs: the second goes on from the first one's state
        for part in parts[n - 2 : n]:
            arrive(spark.createDataFrame(part, schema), folder)
        decisions = finished(S.deferred_release(source.parquet(folder), "id", keys, bucket, 3), out)
        assert sorted(map(tuple, S.decided(decisions, "id").collect())) == twin([r for p in parts[:n] for r in p])
    assert decisions.filter("decision = 'released'").groupBy("id").count().filter("count > 1").count() == 0


PARTS = "conv_id long, seq int, part string, text string, ts timestamp"


def parts(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq int, part string, text string, s long").select("conv_id", "seq", "part", "text", F.timestamp_seconds(F.col("s") + 1700000000).alias("ts"))


def test_responses(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [
        (1, 0, "start", "m", 0), (1, 2, "chunk", "b", 2), (1, 1, "chunk", "a", 1), (1, 3, "end", None, 3),  # out of order
        (2, 0, "start", "m", 0), (2, 1, "chunk", "a", 1), (2, 2, "fault", "broken", 2), (2, 3, "chunk", "late", 3),  # a fault, and a part after it
        (3, 0, "start", "m", 0), (3, 1, "chunk", "a", 1),  # falls silent
        (4, 0, "start", "m", 0), (4, 2, "end", None, 2),  # a part is missing
        (5, 0, "start", "m", 0),  # goes on in the second batch
        (6, 0, "fault", "at once", 0), (6, 0, "fault", "at once", 0),
    ]
    second = [(5, 1, "chunk", "a", 60), (5, 2, "end", None, 61), (1, 4, "chunk", "after the end", 61)]
    later = [(7, 0, "start", "m", 9000), (7, 1, "end", None, 9001)]
    last = [(3, 2, "chunk", "too late", 9002)]
    source = S.stream_session(spark).readStream.schema(PARTS).option("maxFilesPerTrigger", 1)
    for batch in (first, second, later, last):
        arrive(parts(spark, batch), folder)
        events = finished(S.response_stream(source.parquet(folder)), out)
    got = sorted((r.conv_id, r.n, r.kind, r.text) for r in events.collect())
    twin = S.response_events(parts(spark, first + second + later))
    assert got == sorted((r.conv_id, r.n, r.kind, r.text) for r in twin.collect())
    kinds = {}
    for c, _, kind, text in got:
        kinds.setdefault(c, []).append(text if kind in ("token", "error") else kind)
    assert kinds == {
        1: ["meta", "a", "b", "done"], 2: ["meta", "a", "broken", "done"], 3: ["meta", "a", "timeout", "done"], 4: ["meta", "timeout", "done"],
        5: ["meta", "a", "done"], 6: ["at once", "done"], 7: ["meta", "done"],
    }


class _State:
    """Stands in for the state of one key; counts what would go to the executor and back."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k],
                "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "clear": self.map.clear,
                "listTimers": lambda: list(self.timers), "registerTimer": self.timers.add, "deleteTimer": self.timers.remove,
            }[name](*args)

        if name.startswith("get") and name.endswith("State"):
            return lambda *args: self
        return call


def test_parts_in_their_turn_leave_the_state_alone():
    row = lambda seq, kind: S.Row(seq=seq, part=kind, text=str(seq), ts=datetime.datetime.fromtimestamp(1700000000 + seq))
    whole = [row(0, "start"), *(row(i, "chunk") for i in range(1, 30)), row(30, "end")]

    def run(batches):
        state, out = _State(), []
        response = S._Response(600_000)
        response.init(state)
        for b in batches:
            out += [(r.n, r.kind) for r in response.handleInputRows((1,), iter(b), None)]
        return out, state

    want, state = run([whole])
    assert [n for n, _ in want] == list(range(31)) and want[-1][1] == "done"
    assert state.calls <= 4 and not state.map and not state.timers
    rng = random.Random(5)
    for _ in range(20):
        mixed = rng.sample(whole, len(whole))
        cuts = sorted(rng.sample(range(len(whole)), 4))
        got, state = run([mixed[i:j] for i, j in zip([0, *cuts], [*cuts, len(whole)], strict=True)])
        assert got == want and not state.map and not state.timers
