"""Runs over many tables: their changes as ordered scripts, written as text."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as q
from ..operators import rowdiff
from ..sources.loaders import Rule

log = logging.getLogger(__name__)

RANK = {"DROP": 0, "ADD": 1, "MODIFY": 2}


def statements(diff: DataFrame, table: str, key: list[str], sql: dict[str, Column]) -> DataFrame:
    """table_name, rank, k (the key as text) and sql of each change; sql has the statement of each kind."""
    what = F.col("diff_type")
    rank = reduce(lambda x, kind: x.when(what == kind, RANK[kind]), list(RANK)[1:], F.when(what == "DROP", RANK["DROP"]))
    text = F.when(what == "ADD", sql["ADD"]).when(what == "DROP", sql["DROP"]).otherwise(sql["MODIFY"])
    return diff.select(F.lit(table).alias("table_name"), rank.alias("rank"), F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in key]).alias("k"), text.alias("sql"))


def table_changes(source: DataFrame, target: DataFrame, rule: Rule, key: list[str], d: q.Dialect, schema: str = "public") -> DataFrame:
    """The statements that make one table of the target like the source's."""
    kinds, columns = {f.name: f.dataType.simpleString() for f in target.schema.fields}, target.columns
    diff = rowdiff.row_diff(source, target, key, list(rule.comparisonKey) or None, unique=True)
    set_ = [c for c in rule.comparisonKey or columns if c in columns]
    update = q.update(d, rule.table, "new", [*key, *[c for c in set_ if c not in key]], key, kinds, schema) if set(set_) - set(key) else F.lit("")
    sql = {"ADD": q.insert(d, rule.table, "new", columns, kinds, schema), "DROP": q.delete(d, rule.table, "old", key, kinds, schema), "MODIFY": update}
    return statements(diff, rule.table, key, sql).where("sql <> ''")


def run(rules: Iterable[Rule], source: Callable[[str], DataFrame], target: Callable[[str], DataFrame], key_of: Callable[[str], list[str]], d: q.Dialect, schema: str = "public") -> tuple[DataFrame | None, dict[str, str]]:
    """(number, table_name, rank, k, sql of all tables; why tables were left out). A table without a key, or with one that
    repeats, is left out and the run goes on."""
    parts, skipped = [], {}
    for number, rule in enumerate(rules):
        key = list(rule.key) or key_of(rule.table)
        try:
            found = table_changes(source(rule.table), target(rule.table), rule, key, d, schema)
        except (rowdiff.MissingKeyError, rowdiff.DuplicateKeyError) as e:
            log.warning("%s is left out: %s", rule.table, e)
            skipped[rule.table] = str(e)
            continue
        parts.append(found.select(F.lit(number).alias("number"), "*"))
        log.info("%s compared by %s", rule.table, ", ".join(key))
    return (reduce(DataFrame.unionByName, parts) if parts else None), skipped


def write_data_script(changes: DataFrame, path: str) -> None:
    """The script as a folder of text files whose names give their order: a header for each table, then what goes, what
    comes, and what changes, each by key. An earlier script there is replaced."""
    heads = changes.select("number", "table_name").distinct().select("number", F.lit(-1).alias("rank"), F.lit("").alias("k"), F.concat(F.lit("--- diff "), "table_name", F.lit(" ")).alias("sql"))
    lines = changes.select("number", "rank", "k", "sql").unionByName(heads)
    lines.orderBy("number", "rank", "k", "sql").select("sql").write.mode("overwrite").text(path)


def write_schema_script(script: DataFrame, path: str) -> None:
    """The statements of schema_script(), which come in order and without empty ones, as a folder of text files."""
    script.select("sql").write.mode("overwrite").text(path)
