"""Queries by name with their DuckDB SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def literal_rows(values: list[tuple], columns: str) -> str:
    """A VALUES table for either engine, with columns named."""
    def lit(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, v)) + ')' for v in values)}) AS t({columns})"


#: Texts of the given tables with ids that don't meet: each query text function runs over these besides its own cases.
TEXTS = """SELECT 1000 + item_id AS id, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations
UNION ALL SELECT 1000000000 + doc_id, text FROM documents"""


def and_texts_sql(cases: str, column: str) -> str:
    """The cases, the table's texts, and user turns that begin with a case, as a table expression of DuckDB."""
    of = f"(SELECT id AS case_id, {column} AS case_text FROM {cases})"
    return f"""(SELECT id, {column} FROM {cases} UNION ALL SELECT * FROM ({TEXTS}) UNION ALL
        SELECT 2000000000 + conv_id * 1000 + turn, case_text || ' ' || text FROM conversations JOIN {of} ON case_id = 1 + conv_id % (SELECT count(*) FROM {cases}) WHERE role = 'user') AS t(id, {column})"""


def and_texts(spark: SparkSession, sf_dir: str, cases: str, column: str) -> DataFrame:
    """The same in Spark."""
    rows = spark.sql(f"SELECT cast(id AS bigint) AS id, {column} FROM {cases}")
    read = lambda name, id_: table(spark, sf_dir, name).select(F.expr(id_).alias("id"), F.col("text").alias(column))
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    begun = turns.join(F.broadcast(rows.toDF("case_id", "case_text")), F.col("case_id") == 1 + F.col("conv_id") % spark.sql(f"SELECT * FROM {cases}").count())  # a few literal rows
    begun = begun.select((2000000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("case_text", F.lit(" "), "text").alias(column))
    for x in (read("benchmark", "1000 + item_id"), read("conversations", "1000000 + conv_id * 1000 + turn"), read("documents", "1000000000 + doc_id"), begun):
        rows = rows.unionByName(x)
    return rows


def over(spark: SparkSession, sf_dir: str, name: str, expression: str) -> DataFrame:
    """A table expression that both engines read, over one of the given tables."""
    view = f"{name}_{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    out = spark.sql(f"SELECT * FROM {re.sub(rf'(?<=FROM ){name}(?![a-z_])', view, expression)}")
    spark.catalog.dropTempView(view)
    return out
