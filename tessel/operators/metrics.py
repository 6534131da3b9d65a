"""Retrieval metrics, percentiles, AUC and choices among configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.ranks import placed, values_at


def recall_capped(expected: Column, retrieved: Column, k: int) -> Column:
    """Hits among the first k over min(|expected|, k); repeated expectations count."""
    hits = F.size(F.filter(expected, lambda e: F.array_contains(F.slice(retrieved, 1, k), e)))
    return F.when(F.size(expected) > 0, hits / F.least(F.size(expected), F.lit(k)))


def recall_uncapped(expected: Column, retrieved: Column, k: int) -> Column:
    hits = F.size(F.filter(expected, lambda e: F.array_contains(F.slice(retrieved, 1, k), e)))
    return F.when(F.size(expected) > 0, hits / F.size(expected))


def reciprocal_rank(expected: Column, retrieved: Column) -> Column:
    """1 / rank of the first expected; without expectations 1 if nothing was retrieved, else 0."""
    places = F.filter(F.transform(retrieved, lambda r, i: F.when(F.array_contains(expected, r), i + 1)), lambda p: p.isNotNull())
    found = F.coalesce(1.0 / F.array_min(places), F.lit(0.0))
    return F.when(F.size(expected) > 0, found).otherwise(F.when(F.size(retrieved) == 0, 1.0).otherwise(0.0))


def interpolated(rows: DataFrame, value: str, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(by, names): quantiles by linear interpolation between the two places next to q * (n - 1)."""
    at = lambda q: F.lit(q) * (F.col("n") - 1)
    ends = {f"__{end}_{name}": f(at(q)) for name, q in quantiles.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    low, high = (lambda n: F.col(f"__low_{n}")), (lambda n: F.col(f"__high_{n}"))
    return values_at(rows, value, by, ends).select(*by, *[(low(n) + (high(n) - low(n)) * (at(q) - F.floor(at(q)))).alias(n) for n, q in quantiles.items()])


def auc_ordinal(rows: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Mann-Whitney AUC on ordinal ranks, ties in order of ``tie``."""
    at, _ = placed(rows.select(score, label, tie), [score, tie])
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    ranks = F.sum(F.when(F.col(label) == 1, F.col("place")))
    return at.agg(pos.alias("n_pos"), neg.alias("n_neg"), F.round((ranks - pos * (pos + 1) / 2) / (pos * neg), 8).alias("auc"))


def winner(rows: DataFrame, mrr: str = "mrr", recall: str = "recall", soft: tuple[float, float] = (0.636, 0.603), floor: float = 0.62) -> DataFrame:
    """The best configuration: both bounds met, else the floor on recall, else any; then mrr, then recall."""
    tier = F.when((F.col(recall) >= soft[0]) & (F.col(mrr) >= soft[1]), 0).when(F.col(recall) >= floor, 1).otherwise(2)
    return rows.withColumn("tier", tier).orderBy("tier", F.desc(mrr), F.desc(recall)).limit(1)
