"""Tables that plans write: vectors with integer ids that are never given twice, upserts of the partitions they touch, daily snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import at_path, settle


class VectorTable:
    """Vectors at a path: rows (int_id, id, vec) in folders by state, and a mark above all integer ids ever given.

    A change is a new state; the file that names it is written last, so a change that fails leaves the old state.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self.state, self.next_id = 0, 0
        self.rows: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorTable:
        files, at = at_path(spark, f"{path.rstrip('/')}/states")
        if not files.exists(at):
            raise FileNotFoundError(path)
        last = spark.read.parquet(f"{path.rstrip('/')}/states").orderBy(F.desc("state")).first()
        out = cls(spark, path, last["dim"])
        out.state, out.next_id = last["state"], last["next_id"]
        out.rows = spark.read.parquet(f"{out.path}/vectors/state={out.state}")
        return out

    def _save(self, rows: DataFrame, next_id: int) -> None:
        state = self.state + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/vectors/state={state}")
        mark = self.spark.createDataFrame([(state, next_id, self.dim)], "state long, next_id long, dim int")
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/states")
        self.state, self.next_id, self.rows = state, next_id, self.spark.read.schema(rows.schema).parquet(f"{self.path}/vectors/state={state}")

    def add(self, new: DataFrame) -> int:
        """Take in ``new(id, vec)`` and give each an integer id; a wrong length, a null or a taken id refuses all of it."""
        new = settle(new.select("id", "vec"), "new-vectors")
        if new.filter(F.col("id").isNull() | F.col("vec").isNull() | (F.size("vec") != self.dim)).limit(1).count():
            raise ValueError(f"vectors of {self.dim} numbers with an id are wanted")
        twice = new.groupBy("id").count().filter("count > 1").select("id")
        taken = twice if self.rows is None else twice.unionByName(new.select("id").join(self.rows.select("id"), "id", "left_semi"))
        if (one := taken.first()) is not None:
            raise ValueError(f"id {one[0]!r} is there already: remove it first")
        # numbers within a part follow the counts of the parts before
        numbered = settle(new.withColumn("__at", F.monotonically_increasing_id()), "numbered-vectors")
        part = F.shiftright("__at", 33)
        before, bounds = self.next_id, []
        for r in numbered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a part
            bounds.append((r["part"], before))
            before += r["count"]
        starts = self.spark.createDataFrame(bounds, "__part long, __first long")
        added = numbered.withColumn("__part", part).join(F.broadcast(starts), "__part").select((F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("int_id"), "id", "vec")
        n = before - self.next_id
        self._save(added if self.rows is None else self.rows.unionByName(added), before)
        return n

    def remove(self, ids: DataFrame) -> int:
        """Take out ``ids(id)``; how many there were."""
        if self.rows is None:
            return 0
        before = self.rows.count()
        self._save(self.rows.join(ids.select("id").distinct(), "id", "left_anti").select("int_id", "id", "vec"), self.next_id)
        return before - self.rows.count()

    def clear(self) -> None:
        """Take out all; integer ids begin at 0 again, as nothing is left that has one."""
        if self.rows is not None:
            self._save(self.rows.limit(0), 0)


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, key: str, by: str, dry_run: bool = False) -> dict[str, int]:
    """Upsert ``new`` by ``key`` into a table in folders by ``by``; counts of rows inserted, updated and left the same.

    Only the partitions that ``new`` touches are read and written, by dynamic overwrite: others stay as they are. A key
    stays in its partition. With ``dry_run`` nothing is written and the counts are those of the write.
    """
    old = spark.read.parquet(path)
    new = settle(new.select(*old.columns), "upsert-rows")
    touched = settle(old.join(new.select(by).distinct(), by, "left_semi").select(*old.columns), "touched-partitions")
    values = [c for c in old.columns if c not in (key, by)]
    was = touched.select(F.col(key), F.col(by), F.lit(True).alias("__old"), *[F.col(c).alias(f"__o_{c}") for c in values])
    same = [F.equal_null(F.col(c), F.col(f"__o_{c}")) for c in values]
    kind = F.when(F.col("__old").isNull(), "inserted")
    for s in same:
        kind = kind.when(~s, "updated")
    counts = {r["kind"]: r["count"] for r in new.join(was, [key, by], "left").groupBy(kind.otherwise("same").alias("kind")).count().collect()}
    out = {k: counts.get(k, 0) for k in ("inserted", "updated", "same")}
    if not dry_run and out["inserted"] + out["updated"]:
        state = touched.join(new.select(key, by), [key, by], "left_anti").select(*old.columns).unionByName(new)
        state.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)
    return out


def snapshot(rows: DataFrame, path: str, day: str, keep: int = 14) -> list[str]:
    """Write ``rows`` as the snapshot of ``day`` (yyyy-mm-dd) unless there is one; of all, the ``keep`` newest by name stay. Their days."""
    spark = rows.sparkSession
    files, at = at_path(spark, path)
    done, there = at_path(spark, f"{path}/day={day}/_SUCCESS")
    if not done.exists(there):
        rows.write.mode("overwrite").parquet(f"{path}/day={day}")
    days = sorted((x.getPath().getName() for x in files.listStatus(at) if x.getPath().getName().startswith("day=")), reverse=True)
    for old in days[keep:]:
        files.delete(at_path(spark, f"{path}/{old}")[1], True)
    return [d.removeprefix("day=") for d in days[:keep]]
