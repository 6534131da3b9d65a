"""JSON sources: strict and tolerant lines, configuration files, nested review records, result folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "code string, name string, hours string, description string, prereqs array<string>"
TEACHER = (
    "struct<id:string,firstName:string,lastName:string,department:string,avgRating:double,avgDifficulty:double,numRatings:int,wouldTakeAgainPercent:double,"
    "ratings:struct<edges:array<struct<node:struct<id:string,class:string,comment:string,date:string,qualityRating:double,difficultyRatingRounded:double,ratingTags:string>>>>>"
)
REVIEWS = f"struct<data:struct<newSearch:struct<teachers:struct<edges:array<struct<node:{TEACHER}>>>>>>"


def read_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; a bad line fails the job, or is left out if ``tolerant`` (a torn tail)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_config(spark: SparkSession, path: str, schema: str, entries: str) -> DataFrame:
    """The elements of one array of a configuration document."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode(entries).alias("e")).select("e.*")


def read_glossary(spark: SparkSession, path: str, senses: int = 3) -> DataFrame:
    """(acronym, sense, place) of a document {ACRONYM: [sense, ...]}: capitals, non-empty lists of strings only."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,variant>").alias("m"))
    each = raw.select(F.explode("m").alias("k", "v")).select(F.upper("k").alias("acronym"), F.col("v").cast("string").alias("json"))
    lists = each.select("acronym", F.from_json("json", "array<variant>").alias("items")).filter(F.size("items") > 0)
    texts = F.transform("items", lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")))
    kept = lists.select("acronym", texts.alias("senses")).filter(~F.exists("senses", lambda x: x.isNull()))
    return kept.select("acronym", F.posexplode(F.slice("senses", 1, senses)).alias("place", "sense")).select("acronym", "sense", "place")


def read_results(spark: SparkSession, folder: str, summary: str) -> DataFrame:
    """Summaries of all result files, newest first by modification; files that can't be parsed have nulls and are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    parsed = files.select("path", "modificationTime", F.from_json(F.col("content").cast("string"), f"struct<summary:{summary}>").alias("r"))
    return parsed.filter(F.col("r.summary").isNotNull()).select("path", "modificationTime", "r.summary.*").orderBy(F.desc("modificationTime"), "path")


def review_rows(answers: DataFrame, column: str = "json") -> DataFrame:
    """Reviews of the first teacher of each answer; nulls anywhere on the way give no rows."""
    teacher = F.from_json(column, REVIEWS)["data"]["newSearch"]["teachers"]["edges"]
    first = F.when(F.size(teacher) > 0, F.get(teacher, F.lit(0))["node"])
    rows = answers.select(first.alias("t")).filter(F.col("t").isNotNull())
    return rows.select(
        F.col("t.id").alias("teacher_id"), F.concat_ws(" ", "t.firstName", "t.lastName").alias("teacher"), F.explode("t.ratings.edges").alias("r")
    ).select("teacher_id", "teacher", F.col("r.node.id").alias("review_id"), F.col("r.node.class").alias("code"), F.col("r.node.comment").alias("comment"), F.col("r.node.date").alias("date"), F.col("r.node.qualityRating").alias("quality"), F.col("r.node.ratingTags").alias("tags"))


def merge_posts(posts: DataFrame, comments: DataFrame, code: str) -> DataFrame:
    """Posts and the comments that hold the code, once per id, best score first."""
    hit = F.contains(F.lower("body"), F.lit(code.lower()))
    both = posts.select(F.concat(F.lit("t3_"), "id").alias("id"), "body", "score").unionByName(comments.filter(hit).select(F.concat(F.lit("t1_"), "id").alias("id"), "body", "score"))
    return both.groupBy("id").agg(F.max_by("body", F.struct("score", "body")).alias("body"), F.max("score").alias("score")).orderBy(F.desc("score"), "id")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, category, query, want) of an evaluation set {"queries": [...]}: what ``models.evaluate`` takes. No expectations: an empty array."""
    rows = read_config(spark, path, "queries array<struct<query_id:string,category:string,query:string,expected_course_ids:array<string>>>", "queries")
    return rows.select("query_id", "category", "query", F.coalesce("expected_course_ids", F.array().cast("array<string>")).alias("want"))


# Fixed value: what a department's slug looks like.
SLUG = "^[a-z]{2,8}$"


def departments_to_fetch(slugs: DataFrame, done: DataFrame) -> DataFrame:
    """(slug, error): the slugs whose output isn't there yet, each once; one that is no slug is an error and isn't fetched."""
    asked = slugs.select("slug").distinct()
    error = F.when(~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False)), "not a slug")
    return not_done(asked, done.select("slug"), "slug").withColumn("error", error)


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a restart still has to do."""
    return work.join(done, key, "left_anti")




def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(pos, record) of a document that is a list of objects or {"records": [...]}; keys that begin with _ are notes and go."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    as_list = lambda at: F.try_variant_get("v", at, "array<map<string,variant>>")
    each = raw.select(F.posexplode(F.coalesce(as_list("$"), as_list("$.records"))).alias("pos", "m"))
    return each.select("pos", F.map_filter("m", lambda k, v: ~F.startswith(k, F.lit("_"))).alias("record"))


def read_program(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(program, required courses, prerequisites) of a seed document; the latter two carry the program's id."""
    schema = (
        "program struct<program_id:string,name:string>, required_courses array<struct<code:string,semester:int>>, prerequisites array<struct<code:string,prereq:string>>"
    )
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = lambda c: whole.select("program.program_id", F.explode(c).alias("e")).select("program_id", "e.*")
    return whole.select("program.*"), rows("required_courses"), rows("prerequisites")


def post_records(objects: DataFrame, kind: str) -> DataFrame:
    """Posts (t3) or comments (t1) as records: prefixed id, and texts and numbers that are missing as '' and 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return objects.select(
        F.concat(F.lit(f"{kind}_"), "id").alias("id"), text("title").alias("title"), text("body").alias("body"), F.coalesce("author", F.lit("[deleted]")).alias("author"), F.coalesce("score", F.lit(0)).alias("score")
    )
