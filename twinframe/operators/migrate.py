"""Versioned migration files: names, order, what is pending, a plan that touches nothing, and runs with a log."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# The grammar of a migration's file name, and the columns of the version table.
VERSION = r"[vV]?[0-9]+(?:[.][0-9]+)*"
TITLE = r"[^.]+"
DIRECTIONS = ("up", "down")
KINDS = ("sql", "json")
STATE = "id int, version string, title string, applied_at timestamp, execution_time int, status string"

_NAME = f"^({VERSION})__({TITLE})(?:[.]({'|'.join(DIRECTIONS)}))?[.]({'|'.join(KINDS)})$"
_TRANSACTION = r"(?i)(?:begin|commit)(?:\s+transaction)?\s*;"


def parse(files: DataFrame, path: str = "path") -> DataFrame:
    """version, title, direction and ext of each file whose base name fits; others go."""
    base = F.element_at(F.split(path, "/"), -1)
    fields = {name: F.regexp_extract(base, _NAME, k) for k, name in enumerate(("version", "title", "direction", "ext"), 1)}
    return files.withColumns(fields).where("version <> ''")


def version_key(version: Column) -> Column:
    """An array that sorts and equals as versions do, whatever their numbers of parts: 0 alone for no version, else 1 and
    the parts as numbers up to the last that is not 0. A part that is no 64-bit number is 0."""
    text = F.regexp_replace(F.coalesce(version, F.lit("")), "^[vV]", "")
    numbers = F.transform(F.split(text, "[.]"), lambda p: F.coalesce(F.when(p.rlike("^[+-]?[0-9]+$"), p.try_cast("bigint")), F.lit(0).cast("bigint")))
    last = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    some = F.concat(F.array(F.lit(1).cast("bigint")), F.slice(numbers, F.lit(1), last))
    return F.when(F.coalesce(version, F.lit("")) == "", F.array(F.lit(0).cast("bigint"))).otherwise(some)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def ordered(files: DataFrame) -> DataFrame:
    """By version; of one version, down before up."""
    return files.orderBy(version_key(F.col("version")), "direction", "path")


def current_version(state: DataFrame) -> DataFrame:
    """version of the last successful entry, '' if there is none."""
    return state.where("status = 'success'").agg(F.coalesce(F.max_by("version", "id"), F.lit("")).alias("version"))


def pending(files: DataFrame, current: str, target: str | None = None, only_up: bool = True) -> DataFrame:
    """Files with current < version <= target. `only_up` leaves out down files and JSON files."""
    version = F.col("version")
    out = files.where(compare(version, F.lit(current)) > 0)
    if target:
        out = out.where(compare(version, F.lit(target)) <= 0)
    return out.where("direction <> 'down' and ext = 'sql'") if only_up else out


def pending_count(files: DataFrame, current: str, target: str | None = None) -> DataFrame:
    """n: how many files are pending."""
    return pending(files, current, target).agg(F.count(F.lit(1)).alias("n"))


def strip_transactions(sql: Column) -> Column:
    """`sql` without the statements that begin or commit a transaction."""
    return F.regexp_replace(sql, _TRANSACTION, "")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of all files below a folder; one that can't be read is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return parse(found.select("path", F.decode("content", "UTF-8").alias("content")))


def dry_run(files: DataFrame, state: DataFrame, target: str | None = None) -> DataFrame:
    """What apply() would run, in order, without transaction statements. Nothing is written."""
    return ordered(pending(files, current_version(state).first()["version"], target)).withColumn("content", strip_transactions(F.col("content")))


class VersionLog:
    """The version table, as a Parquet table of Spark's catalog."""

    def __init__(self, spark: SparkSession, table: str = "schema_migrations"):
        self.spark, self.table = spark, table

    def ensure(self) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({STATE}) USING parquet")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, version: str, title: str, milliseconds: int, status: str) -> tuple:
        last = self.rows().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        row = (last + 1, version, title, dt.datetime.now(), milliseconds, status)
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").insertInto(self.table)
        return row


def apply(files: DataFrame, versions: VersionLog, execute: Callable[[str], None], target: str | None = None) -> list[tuple]:
    """Makes sure of the version table, runs the pending files in order up to `target` (all if not given) and logs each;
    stops after the first that fails. Returns the rows logged; none if the current version is the target already."""
    versions.ensure()
    current = current_version(versions.rows()).first()["version"]
    todo = ordered(pending(files, current, target)).select("version", "title", "content").collect()  # files, few by nature
    log.info("version %s, %d files pending", current or "none", len(todo))
    rows = []
    for r in todo:
        began, status = time.perf_counter(), "success"
        try:
            execute(r["content"])
        except Exception:  # recorded, and the run ends here
            log.exception("version %s failed", r["version"])
            status = "failed"
        rows.append(versions.append(r["version"], r["title"], round(1000 * (time.perf_counter() - began)), status))
        if status == "failed":
            break
    return rows


def reset(spark: SparkSession, database: str, confirm: bool = False) -> None:
    """Drops and creates a database of Spark's own catalog; nothing happens without `confirm`."""
    if not confirm:
        raise PermissionError(f"resetting {database} deletes its tables: confirm it")
    name = "`" + database.replace("`", "``") + "`"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name}")
