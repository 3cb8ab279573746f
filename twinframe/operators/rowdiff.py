"""Keyed comparison of two snapshots. One full outer join classifies every row; a single kind of change has its own,
cheaper join. Comparison is null-safe, keys are matched by value and type, and nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ADD, DROP, MODIFY = "ADD", "DROP", "MODIFY"


_IN = "__in"


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _of(side: str, name: str) -> Column:
    return F.col(f"{side}.{_name(name)}")


class MissingKeyError(ValueError):
    """The table has no key: rows can't be matched."""


class DuplicateKeyError(ValueError):
    """A key occurs twice: an outer join would multiply rows."""


class CompareRule(Protocol):
    table: str

    def equal(self, source: StructType, target: StructType) -> Column:
        """Over a join whose sides are named s (source) and t (target)."""
        ...


@dataclass(frozen=True)
class AllFieldsEqual:
    """All listed columns are equal; null equals null. Columns whose types differ are compared as text."""

    table: str
    columns: tuple[str, ...]

    def equal(self, source: StructType, target: StructType) -> Column:
        def same(c: str) -> Column:
            a, b = _of("s", c), _of("t", c)
            if source[c].dataType != target[c].dataType:
                a, b = a.cast("string"), b.cast("string")
            return a.eqNullSafe(b)

        return reduce(lambda x, y: x & y, map(same, self.columns), F.lit(True))


def rule_for(table: str, columns: list[str], compare: list[str] | None = None) -> AllFieldsEqual:
    """`compare`, or all of the target's columns."""
    unknown = set(compare or ()) - set(columns)
    if unknown:
        raise ValueError(f"no such column in {table}: {', '.join(sorted(unknown))}")
    return AllFieldsEqual(table, tuple(compare or columns))


def _sides(source: DataFrame, target: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    if not key:
        raise MissingKeyError("a key is needed to match rows")
    taken = sorted({"old", "new", "diff_type", _IN} & {c.lower() for c in key} | {_IN} & set(target.columns))
    if taken:
        raise ValueError(f"rename columns that have names of the result: {', '.join(taken)}")
    missing = [c for c in target.columns if c not in source.columns] + [k for k in key if k not in target.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    # The target decides the columns; others of the source are not read.
    names = list(map(_name, target.columns))
    return source.select(*names, F.lit(True).alias(_IN)).alias("s"), target.select("*", F.lit(True).alias(_IN)).alias("t")


def _on(key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [_of("s", k).eqNullSafe(_of("t", k)) for k in key])


def _row(side: str, columns: list[str]) -> Column:
    return F.struct(*[_of(side, c).alias(c) for c in columns])


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """`df`, or an error if a key occurs twice. Costs an aggregation."""
    if not df.groupBy(*map(_name, key)).agg(F.count(F.lit(1)).alias(_IN)).where(F.col(_IN) > 1).isEmpty():
        raise DuplicateKeyError(f"duplicate keys ({', '.join(key)})")
    return df


def row_diff(source: DataFrame, target: DataFrame, key: list[str], compare: list[str] | None = None, rule: CompareRule | None = None, unique: bool = False) -> DataFrame:
    """diff_type, the key columns, old (the target's row) and new (the source's row); unchanged rows are left out. A key
    that repeats gives a row for each pair of its rows; `unique` makes sure beforehand that none does, at the price of an
    aggregation of either side."""
    if unique and key:
        source, target = check_unique(source, key), check_unique(target, key)
    s, t = _sides(source, target, key)
    same = (rule or rule_for("", target.columns, compare)).equal(s.schema, t.schema)
    kind = F.when(F.col(f"t.{_IN}").isNull(), ADD).when(F.col(f"s.{_IN}").isNull(), DROP).when(~same, MODIFY)
    side = lambda x: F.when(F.col(f"{x}.{_IN}"), _row(x, target.columns))
    joined = s.join(t, _on(key), "full_outer")
    keys = [F.when(F.col(f"s.{_IN}"), _of("s", k)).otherwise(_of("t", k)).alias(k) for k in key]
    return joined.select(kind.alias("diff_type"), *keys, side("t").alias("old"), side("s").alias("new")).where("diff_type is not null")


def added(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Source rows whose key the target lacks."""
    s, t = _sides(source, target, key)
    return s.join(t, _on(key), "left_anti").drop(_IN)


def dropped(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Target rows whose key the source lacks."""
    s, t = _sides(source, target, key)
    return t.join(s, _on(key), "left_anti").drop(_IN)


def modified(source: DataFrame, target: DataFrame, key: list[str], compare: list[str] | None = None) -> DataFrame:
    """Key columns, old and new of rows in both that differ."""
    s, t = _sides(source, target, key)
    same = rule_for("", target.columns, compare).equal(s.schema, t.schema)
    return s.join(t, _on(key)).where(~same).select(*[_of("s", k).alias(k) for k in key], _row("t", target.columns).alias("old"), _row("s", target.columns).alias("new"))


def summary(diff: DataFrame, table: str) -> DataFrame:
    return diff.groupBy("diff_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table_name"), "diff_type", "n")


def apply_diff(target: DataFrame, diff: DataFrame, key: list[str]) -> DataFrame:
    """The target after the changes: rows that were dropped or modified go, new ones come."""
    gone = diff.where(F.col("diff_type") != ADD).select(*map(_name, key)).alias("g")
    t = target.alias("t")
    kept = t.join(gone, reduce(lambda x, y: x & y, [_of("t", k).eqNullSafe(_of("g", k)) for k in key]), "left_anti")
    return kept.unionByName(diff.where(F.col("diff_type") != DROP).select("new.*").select(*map(_name, target.columns)))


def verify_sync(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """surplus, missing: rows by which the target, after its changes are applied, differs from the source (both 0)."""
    after = apply_diff(target, row_diff(source, target, key), key)
    want = source.select(*map(_name, target.columns))
    a = after.withColumn("__n", F.lit(1)).unionByName(want.withColumn("__n", F.lit(-1)))
    n = a.groupBy(*map(_name, target.columns)).agg(F.sum("__n").alias("n"))
    return n.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("surplus"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("missing"))


def multiset_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """For tables without a key: whole rows that one side has more often (an extension)."""
    want = source.select(*map(_name, target.columns))
    return want.exceptAll(target).withColumn("diff_type", F.lit(ADD)).unionByName(target.exceptAll(want).withColumn("diff_type", F.lit(DROP)))


def changed_columns(diff: DataFrame) -> DataFrame:
    """MODIFY rows with the names of the columns that differ (an extension)."""
    names = [f.name for f in diff.schema["new"].dataType.fields]
    changed = F.array_compact(F.array(*[F.when(~_of("old", c).eqNullSafe(_of("new", c)), F.lit(c)) for c in names]))
    return diff.where(F.col("diff_type") == MODIFY).withColumn("changed", changed)


def keyset_page(df: DataFrame, key: list[str], after: list | None, limit: int) -> DataFrame:
    """The next `limit` rows in key order, after the key `after`. The predicate is spelled out as ORs so that it
    reaches the scan."""
    if not key:
        raise MissingKeyError("keyset paging needs a key")
    if after is not None:
        parts = []
        for i, k in enumerate(key):
            equal = [F.col(_name(x)) == F.lit(v) for x, v in zip(key[:i], after)]
            parts.append(reduce(lambda x, y: x & y, [*equal, F.col(_name(k)) > F.lit(after[i])]))
        df = df.where(reduce(lambda x, y: x | y, parts))
    return df.orderBy(*map(_name, key)).limit(limit)
