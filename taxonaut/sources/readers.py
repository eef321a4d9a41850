"""Readers: CSV, JSON arrays, JSON lines, dictionaries, registries, grids, file digests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from taxonaut.sources import json_files


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns text, header names trimmed; raises on names that are then the same."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [c.strip() for c in _header(spark, path)]
    if len(set(names)) != len(names):
        raise ValueError("duplicate column names after trimming")
    return df.toDF(*names)


def _header(spark: SparkSession, path: str) -> list[str]:
    row = spark.read.csv(path, header=False, multiLine=True, escape='"').limit(1).collect()
    return [x or "" for x in row[0]] if row else []


def read_json_array(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Items of JSON arrays (one array a file) with row_no and file; a leading byte-order mark is dropped. Large files are read by many tasks.

    With `strict` an item that is no object or no JSON raises; otherwise it has null fields and its text in `record`.
    """
    found = json_files.items(spark, path)
    shape = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    record = F.coalesce("bad", F.to_json("item"))
    checked = F.when(shape, F.to_json("item")).otherwise(F.raise_error(F.concat(F.lit("item is not an object: "), record)) if strict else F.lit(None).cast("string"))
    out = found.select("file", "row_no", F.from_json(checked, schema).alias("_r"), F.when(~shape, record).alias("record"))
    return out.select("file", "row_no", "_r.*", *([] if strict else ["record"]))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are ignored."""
    return spark.read.schema(schema).json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries (pos, key, value as text or JSON text) of a JSON object, in file order; of a repeated key the first place and the last value stay.

    An entry that is no JSON raises. Large files are read by many tasks.
    """
    found = json_files.entries(spark, path)
    key = F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("entry is no JSON: "), "bad"))).otherwise(F.col("key"))
    return found.select("row_no", key.alias("key"), "value").groupBy("key").agg(F.min("row_no").alias("pos"), F.max_by(F.struct("value"), "row_no")["value"].alias("value")).select("pos", "key", "value")


def registry_from_items(spark: SparkSession, items: Sequence[str | dict], least: int = 5) -> DataFrame:
    """Ordered leaf registry (ord, category_id, name, description, path) from strings or objects; ids must be unique and not empty."""
    rows = []
    for n, item in enumerate(items):
        item = {"category_id": item} if isinstance(item, str) else item
        key = (item.get("category_id") or item.get("id") or "").strip()
        rows.append((n, key, (item.get("name") or key).strip(), item.get("description") or "", [str(p) for p in item.get("path") or []]))
    keys = [r[1] for r in rows]
    if len(rows) < least or not all(keys) or len(set(keys)) != len(keys):
        raise ValueError(f"a registry needs {least} or more categories with different ids")
    return spark.createDataFrame(rows, "ord int, category_id string, name string, description string, path array<string>")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file: a JSON array of strings or objects, read whole (a few hundred entries)."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} is not one file")
    return registry_from_items(spark, json.loads(found[0]["value"].lstrip("\ufeff")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files under a path, at any depth; name is relative to the path, or the last part where the path is one file."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.regexp_replace("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    inside = F.startswith(plain, F.lit(f"{whole}/"))
    name = F.when(inside, F.substring(plain, F.lit(len(whole) + 2), F.length(plain))).otherwise(F.element_at(F.split(plain, "/"), -1))
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), F.sha2("content", 256).alias("sha256"))


def verify_digests(spark: SparkSession, path: str, manifest: dict[str, str]) -> None:
    """Raise if a file that the manifest names is absent or differs.

    A name matches the file whose relative name it ends with, part by part (data/raw/x for x under data/raw); where it fits several files, the
    longest decides, and two equally long ones raise.
    """
    found = {r["name"]: r["sha256"] for r in file_digests(spark, path).collect()}
    for name, digest in manifest.items():
        fits = [f for f in found if name == f or name.endswith(f"/{f}") or f.endswith(f"/{name}")]
        if not fits:
            raise ValueError(f"{name}: is not there")
        longest = max(min(len(f), len(name)) for f in fits)
        best = [f for f in fits if min(len(f), len(name)) == longest]
        if len(best) > 1:
            raise ValueError(f"{name}: names several files")
        if found[best[0]] != digest:
            raise ValueError(f"{name}: differs from the manifest")


def expand_grid(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, value) of a grid with merged ranges (sheet, r1, c1, r2, c2): every cell of a range gets its first cell's value.

    sources.workbooks reads both tables from files; operators.standards.merged_grid() looks cells up without expanding ranges.
    """
    covered = ranges.select("sheet", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("row"), "c2").select("sheet", "r1", "c1", "row", F.explode(F.sequence("c1", "c2")).alias("col"))
    anchors = cells.select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("value").alias("_anchor"))
    merged = covered.join(anchors, ["sheet", "r1", "c1"], "left")
    out = cells.join(merged, ["sheet", "row", "col"], "full_outer")
    inherited = F.col("r1").isNotNull() & ((F.col("r1") != F.col("row")) | (F.col("c1") != F.col("col")))
    return out.select("sheet", "row", "col", F.when(F.col("r1").isNotNull(), F.col("_anchor")).otherwise(F.col("value")).alias("value"), F.coalesce(inherited, F.lit(False)).alias("inherited"))
