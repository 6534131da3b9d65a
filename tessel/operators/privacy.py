"""Anonymity, redaction by tier, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def k_anonymous(rows: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """``rows`` with ``group_size`` and ``publishable``; nulls in keys equal each other.

    Counts are pre-aggregated and joined back, so a group of any size stays split over tasks.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("group_size"))
    names = [f"__{c}" for c in keys]
    sizes = sizes.toDF(*names, "group_size")
    same = [F.equal_null(F.col(c), F.col(n)) for c, n in zip(keys, names, strict=True)]
    joined = rows.join(sizes, same).drop(*names)
    return joined.withColumn("publishable", F.col("group_size") >= k)


def redact_by_tier(contributions: Column, tiers: dict[str, int]) -> dict[str, Column]:
    """Columns by name, null unless the reader's tier (contributions, at most 2) reaches the column's."""
    tier = F.least(F.coalesce(contributions, F.lit(0)), F.lit(2))
    return {c: F.when(tier >= t, F.col(c)) for c, t in tiers.items()}


def visible_to(rows: DataFrame, readers: DataFrame, level: str) -> DataFrame:
    """Rows whose ``level`` is at most the reader's ``contributions`` (unknown readers: 0)."""
    return rows.join(readers, "reader_id", "left").filter(F.col(level) <= F.coalesce("contributions", F.lit(0)))


def release_queue(queue: DataFrame, arrived: DataFrame, keys: list[str], bucket: dict[str, Column], k: int = 2) -> DataFrame:
    """``queue`` and ``arrived`` with ``decision`` and ``released_keys``: whole groups of ``k`` rows or more are released;
    a smaller one whose keys, with the ``bucket`` columns coarser, are shared by ``k`` rows or more is released so; the rest is held."""
    rows = queue.unionByName(arrived)
    by = lambda of, name: rows.groupBy(*[c.alias(f"__{n}") for n, c in of.items()]).agg(F.count("*").alias(name))
    exact = {c: F.col(c) for c in keys}
    coarse = exact | bucket
    for of, name in ((exact, "__exact"), (coarse, "__coarse")):
        sizes = by(of, name)
        rows = rows.join(sizes, [F.equal_null(c, F.col(f"__{n}")) for n, c in of.items()]).drop(*[f"__{n}" for n in of])
    decision = F.when(F.col("__exact") >= k, "released").when(F.col("__coarse") >= k, "generalized").otherwise("held")
    text = lambda of: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in of.values()])
    shown = F.when(F.col("__exact") >= k, text(exact)).when(F.col("__coarse") >= k, text(coarse))
    return rows.withColumns({"decision": decision, "released_keys": shown}).drop("__exact", "__coarse")
