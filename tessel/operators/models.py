"""Models in tasks, and evaluation of a search: a model is loaded once a task and sees texts in batches of one size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import metrics
from tessel.session import settle

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], np.ndarray]


def _batched(load: Callable[[], Callable[[list], np.ndarray]], columns: list[str], size: int, finish: Callable[[np.ndarray], pa.Array], name: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = None, []

        def out(some: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*some, strict=True)), finish(np.asarray(model([s[0] if len(columns) == 1 else s for s in some])))], [*columns, name])

        for batch in (x.slice(i, size) for x in rows for i in range(0, x.num_rows, size)):  # few texts at a time become Python's
            held += zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            if len(held) >= size:
                model = model or load()  # a task without rows loads none
                yield out(held[:size])
                held = held[size:]
        if held:
            model = model or load()
            yield out(held)

    return run


def _unit(vectors: np.ndarray) -> pa.Array:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return pa.array((vectors / np.where(length > 0, length, 1.0)).tolist(), pa.list_(pa.float64()))


def encode(rows: DataFrame, text: str, load: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """``rows`` with ``vector``, of length 1 but for zeros: each different text is encoded once, a null one as ''."""
    asked = rows.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    once = settle(asked.select("__text").distinct().mapInArrow(_batched(load, ["__text"], batch, _unit, "vector"), "__text string, vector array<double>"), "encoded")
    return asked.join(once, "__text").drop("__text")


def rerank(pairs: DataFrame, query: str, text: str, load: Callable[[], Scorer], batch: int = 32) -> DataFrame:
    """``pairs`` with ``sigma``: each different pair of texts is scored once."""
    asked = pairs.withColumns({"__query": F.coalesce(F.col(query), F.lit("")), "__text": F.coalesce(F.col(text), F.lit(""))})
    score = _batched(load, ["__query", "__text"], batch, lambda x: pa.array(x, pa.float64()), "sigma")
    once = settle(asked.select("__query", "__text").distinct().mapInArrow(score, "__query string, __text string, sigma double"), "scored-pairs")
    return asked.join(once, ["__query", "__text"]).drop("__query", "__text")


def evaluate(search: Callable[[DataFrame], DataFrame], questions: DataFrame, k: int = 5) -> DataFrame:
    """``questions(query_id, query, want, ...)`` with got, recall, recall_all and rr of any ``search``.

    ``search`` maps (query_id, query) of all questions to (query_id, doc_id, rank); ``want`` is an array of doc_ids.
    """
    found = search(questions.select("query_id", "query")).filter(F.col("rank") <= k)
    got = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("got"))
    none = F.array().cast(questions.schema["want"].dataType)
    rows = questions.join(got, "query_id", "left").withColumns({"want": F.coalesce("want", none), "got": F.coalesce("got", none)})
    want, got = F.col("want"), F.col("got")
    return rows.withColumns({"recall": metrics.recall_capped(want, got, k), "recall_all": metrics.recall_uncapped(want, got, k), "rr": metrics.reciprocal_rank(want, got)})
