"""How the test tables stand for the data model, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from taxonaut.operators.resolve import DatasetConfig

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt to all cores evenly, ahead of costly work: a small file is read by one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


#: White space as RE2 knows it; the same characters as functions.text.SPACE.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def sql_compact(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g')"


#: `part` as labelled records; the registry holds the categories of parts of size over 10 but for one name.
CONFIG = DatasetConfig("part", identity_fields=("level_1", "level_2", "level_4"), placeholders=("red widget",))
LEAST_SIZE, MISSING = 10, "hot gear"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_no"),
        F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("p_size") == 1, "unlabeled").otherwise("labeled").alias("label_status"),
        F.col("p_type").alias("level_1"),
        F.col("p_brand").alias("level_2"),
        F.lit("").alias("level_3"),
        F.col("p_name").alias("level_4"),
        F.concat(F.lit("L"), (F.col("p_size") % 4 + 1).cast("string")).alias("data_level"),
        "p_size",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = records(spark, sf_dir).where((F.col("p_size") > LEAST_SIZE) & (F.col("level_4") != MISSING))
    return kept.select(CONFIG.category_id().alias("category_id"), F.col("level_4").alias("name"), F.array("level_1", "level_2", "level_4").alias("path")).distinct()


CATEGORY = f"'part:' || {sql_compact('level_1')} || '.' || {sql_compact('level_2')} || '.' || {sql_compact('level_4')}"
RECORDS = f"""records AS (
  SELECT *, {CATEGORY} AS category_id FROM (
    SELECT p_partkey AS row_no, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size = 1 THEN 'unlabeled' ELSE 'labeled' END AS label_status,
      p_type AS level_1, p_brand AS level_2, '' AS level_3, p_name AS level_4, 'L' || CAST(p_size % 4 + 1 AS VARCHAR) AS data_level, p_size
    FROM part))"""
REGISTRY = f"""{RECORDS}, registry AS (
  SELECT DISTINCT category_id, level_4 AS name, level_1, level_2 FROM records WHERE p_size > {LEAST_SIZE} AND level_4 <> '{MISSING}')"""
RESOLVED = f"""{REGISTRY}, resolved AS (
  SELECT r.*, CASE WHEN label_status = 'unlabeled' THEN 'unlabeled' WHEN trim(level_4) = '' THEN 'invalid_record'
    WHEN level_4 = 'red widget' THEN 'placeholder' WHEN category_id IN (SELECT category_id FROM registry) THEN 'resolved'
    WHEN level_4 IN (SELECT name FROM registry) THEN 'path_mismatch' ELSE 'missing_leaf' END AS resolution_status
  FROM records r)"""
