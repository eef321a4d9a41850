"""Writers: split Parquet, JSON lines, reports, all with an overwrite guard; several outputs published as one."""

from __future__ import annotations

import hashlib
import json
import posixpath
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    """Raise before any work if an output is there already."""
    if found := [p for p in paths if exists(spark, p)]:
        raise FileExistsError(f"outputs exist: {found}")


def _paths(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        target, fs = _paths(spark, path)
        fs.delete(target, True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    (one, fs), (other, _) = _paths(spark, source), _paths(spark, target)
    if not fs.rename(one, other):
        raise OSError(f"cannot rename {source} to {target}")


def scratch_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder, or a temporary one for a local master."""
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = there.get() if there.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the scratch folder: computed once, and read again by tasks that are repeated."""
    path = f"{scratch_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def journal_of(targets: Iterable[str]) -> str:
    """The commit record of a set of targets, beside the first of them."""
    names = sorted(targets)
    return f"{posixpath.dirname(names[0].rstrip('/'))}/_publish-{hashlib.sha256(chr(10).join(names).encode()).hexdigest()[:16]}.json"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """All of a small file or nothing: written under another name, then renamed."""
    target, fs = _paths(spark, f"{path}.new")
    out = fs.create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    _rename(spark, f"{path}.new", path)


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _paths(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def recover(spark: SparkSession, *targets: str) -> bool:
    """Bring a publication of these targets to its end that was broken off; True if there was one.

    A commit record is there only once every new set is written whole. With it, each old set goes aside, the new one
    takes its place, and old sets are dropped last; every step can be repeated. Without it the old sets stand untouched.
    """
    journal = journal_of(targets)
    if not exists(spark, journal):
        return False
    entries = json.loads(read_text(spark, journal))
    for target, staged, aside in entries:
        if exists(spark, staged):
            if exists(spark, target):
                _rename(spark, target, aside)
            _rename(spark, staged, target)
    delete(spark, journal)
    delete(spark, *(aside for _, _, aside in entries))
    return True


def publish_staged(spark: SparkSession, staged: dict[str, str], overwrite: bool = False) -> None:
    """Put folders that are written whole (target: staged) in the place of their targets, all or none."""
    if not overwrite:
        refuse_existing(spark, *staged)
    mark = uuid.uuid4().hex
    write_text(spark, journal_of(staged), json.dumps([[target, source, f"{target}.old-{mark}"] for target, source in staged.items()]))
    recover(spark, *staged)


def publish(outputs: dict[str, DataFrame], overwrite: bool = False) -> None:
    """Write several Parquet outputs and publish them together.

    All are written beside their targets first; then a commit record makes the change: a run that breaks before it leaves
    the old outputs, one that breaks after it is finished by recover() or by the next publication of the same targets.
    """
    spark = next(iter(outputs.values())).sparkSession
    recover(spark, *outputs)
    if not overwrite:
        refuse_existing(spark, *outputs)
    mark = uuid.uuid4().hex
    staged = {path: f"{path}.staging-{mark}" for path in outputs}
    try:
        for path, df in outputs.items():
            df.write.parquet(staged[path])
    except BaseException:
        delete(spark, *staged.values())
        raise
    publish_staged(spark, staged, overwrite)


def write_splits(rows: DataFrame, path: str, split: str = "split", overwrite: bool = False) -> None:
    """Parquet partitioned by split, so that reading one split prunes the others."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(split).parquet(path)


def write_json_lines(rows: DataFrame, record: Column, path: str) -> None:
    """One prebuilt JSON text a line."""
    rows.select(record.alias("value")).write.text(path)


def json_text(df: DataFrame, order: list[str], limit: int = 100_000) -> str:
    """A small table as a JSON array in order, for reports; refuses tables over `limit` rows."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows for a report")
    return "[" + ",\n".join(r["j"] for r in rows) + "]"


def markdown_table(df: DataFrame, order: list[str], limit: int = 1000) -> str:
    """A small table as Markdown; refuses tables over `limit` rows."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows for a report")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows])
