"""Comparison of two catalogs, each a set of flat DataFrames, and the DDL script that makes the target like the source.

Old is the target's side, new the source's. Every kind of object is one full outer join by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as q
from ..sources.catalogs import Catalog

# Fields compared of each kind of object; a column's position, and everything of a view but its text, are not.
COMPARED = {
    "column": ["data_type", "nullable", "extra", "default_expr", "comment", "char_max_len", "numeric_prec", "numeric_scale"],
    "index": ["is_unique", "is_primary", "method", "columns", "where_expr", "expression"],
    "primary_key": ["pk_name", "columns"],
    "foreign_key": ["ref_schema", "ref_table", "on_delete", "on_update", "columns", "ref_columns"],
    "view": ["select_statement"],
}
NAMES = {"column": "column_name", "index": "index_name", "primary_key": None, "foreign_key": "fk_name", "view": None}
FRAMES = {"column": "columns", "index": "indexes", "primary_key": "primary_keys", "foreign_key": "foreign_keys", "view": "views"}


def _changed(kind: str, s: str, t: str) -> Column:
    def same(c: str) -> Column:
        a, b = F.col(f"{s}.{c}"), F.col(f"{t}.{c}")
        if c == "comment":  # line breaks do not count; null and empty differ
            a, b = (F.regexp_replace(x, "[\r\n]", "") for x in (a, b))
        return a.eqNullSafe(b)

    return ~reduce(lambda x, y: x & y, map(same, COMPARED[kind]))


def _outer(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """on columns, and the rows of both sides as structs new and old (null where missing)."""
    side = lambda df, n: df.select(*on, F.struct(*df.columns).alias(n))
    return side(source, "new").join(side(target, "old"), on, "full_outer")


def _kind(changed: Column) -> Column:
    return F.when(F.col("old").isNull(), "ADD").when(F.col("new").isNull(), "DROP").when(changed, "MODIFY")


def tables_diff(source: Catalog, target: Catalog, type_changes: bool = True) -> DataFrame:
    """table_name, table_type, diff_type (ADD or DROP). A name whose type changed is a DROP and an ADD; without
    `type_changes` it is no difference."""
    both = _outer(source.tables, target.tables, ["table_name"])
    one = both.where("old is null or new is null").select("table_name", F.coalesce("new.table_type", "old.table_type").alias("table_type"), _kind(F.lit(False)).alias("diff_type"), F.coalesce("new.schema_name", "old.schema_name").alias("schema_name"))
    if not type_changes:
        return one
    other = both.where("old.table_type <> new.table_type").select("table_name", F.explode(F.array(*[F.struct(F.col(f"{x}.table_type").alias("table_type"), F.lit(k).alias("diff_type"), F.col(f"{x}.schema_name").alias("schema_name")) for x, k in (("old", "DROP"), ("new", "ADD"))])).alias("x"))
    return one.unionByName(other.select("table_name", "x.*"))


def common_tables(source: Catalog, target: Catalog) -> DataFrame:
    """Tables and views of both sides with the same type: table_name, table_type, schema_name (the target's)."""
    s = source.tables.select("table_name", "table_type")
    return s.join(target.tables.select("table_name", "table_type", "schema_name"), ["table_name", "table_type"])


def objects_diff(source: Catalog, target: Catalog, kind: str) -> DataFrame:
    """table_name, schema_name, name, diff_type, old, new of the objects of one kind in tables that both sides have."""
    common = common_tables(source, target).where(F.col("table_type") == ("VIEW" if kind == "view" else "TABLE")).select("table_name", "schema_name")
    own = NAMES[kind]
    on = ["table_name", *([own] if own else [])]
    both = _outer(getattr(source, FRAMES[kind]), getattr(target, FRAMES[kind]), on)
    out = both.withColumn("diff_type", _kind(_changed(kind, "new", "old"))).where("diff_type is not null")
    name = F.col(own) if own else F.coalesce(F.col("new.pk_name"), F.col("old.pk_name")) if kind == "primary_key" else F.col("table_name")
    return out.join(common, "table_name").select("table_name", "schema_name", name.alias("name"), "diff_type", "old", "new")


def schema_diff(source: Catalog, target: Catalog, type_changes: bool = True) -> DataFrame:
    """object_type, table_name, name, diff_type of every difference."""
    frames = [tables_diff(source, target, type_changes).select(F.lower("table_type").alias("object_type"), "table_name", F.col("table_name").alias("name"), "diff_type")]
    frames += [objects_diff(source, target, k).select(F.lit(k).alias("object_type"), "table_name", "name", "diff_type") for k in COMPARED]
    return reduce(DataFrame.unionByName, frames)


def create_tables(d: q.Dialect, cat: Catalog, names: DataFrame) -> DataFrame:
    """table_name, sql: CREATE TABLE with keys, then indexes and comments; text is put together in column order."""
    listed = lambda kind: getattr(cat, FRAMES[kind]).join(names.select("table_name"), "table_name")
    lines = lambda col, key: F.transform(F.sort_array(F.collect_list(F.struct(key, col.alias("text")))), lambda x: x["text"])
    cols = listed("column").withColumn("c", F.struct("*")).groupBy("table_name").agg(lines(F.concat(F.lit("  "), q.column_ddl(d, "c")), F.col("position")).alias("cols"))
    pk = listed("primary_key").withColumn("k", F.struct("*"))
    head = q.cat("  CONSTRAINT ", q.ident(d, F.col("k.pk_name")), " PRIMARY KEY (") if d.postgres else F.lit("  PRIMARY KEY (")
    pk = pk.where(F.size("k.columns") > 0).groupBy("table_name").agg(F.min(q.cat(head, q.ident_list(d, F.col("k.columns")), ")")).alias("pk"))
    fk = listed("foreign_key").withColumn("k", F.struct("*")).groupBy("table_name").agg(lines(F.concat(F.lit("  "), q.foreign_key_ddl(d, "k")), F.col("fk_name")).alias("fks"))
    t = names.select("table_name").join(cat.tables, "table_name")
    at = q.table_ident(d, F.col("schema_name"), F.col("table_name"))
    ix = listed("index").where("not coalesce(is_primary, false)").join(t.select("table_name", "schema_name"), "table_name").withColumn("i", F.struct("*"))
    ix = ix.groupBy("table_name").agg(lines(q.create_index(d, at, "i"), F.col("index_name")).alias("ixs"))
    none = F.array().cast("array<string>")
    made = t.join(cols, "table_name", "left").join(pk, "table_name", "left").join(fk, "table_name", "left").join(ix, "table_name", "left")
    body = F.array_join(F.concat(F.coalesce("cols", none), F.when(F.col("pk").isNotNull(), F.array("pk")).otherwise(none), F.coalesce("fks", none)), ",\n")
    note = F.coalesce(F.col("comment"), F.lit(""))
    quoted = q.cat("'", q.escape(d, note), "'")
    option = F.lit("") if d.postgres else F.when(note != "", q.cat(" COMMENT=", quoted)).otherwise("")
    rest = F.coalesce("ixs", none)
    if d.postgres:
        cm = listed("column").where("comment is not null").join(t.select("table_name", "schema_name"), "table_name")
        cm = cm.groupBy("table_name").agg(lines(q.cat("COMMENT ON COLUMN ", at, ".", q.ident(d, F.col("column_name")), " IS '", q.escape(d, F.col("comment")), "';"), F.col("position")).alias("cms"))
        made = made.join(cm, "table_name", "left")
        rest = F.concat(rest, F.coalesce("cms", none), F.when(note != "", F.array(q.cat("COMMENT ON TABLE ", at, " IS ", quoted, ";"))).otherwise(none))
    sql = q.cat("CREATE TABLE ", at, " (\n", body, "\n)", option, ";", F.array_join(F.transform(rest, lambda x: F.concat(F.lit("\n\n"), x)), ""))
    return made.select("table_name", sql.alias("sql"))


def schema_script(d: q.Dialect, source: Catalog, target: Catalog, foreign_keys: bool = False, type_changes: bool = True) -> DataFrame:
    """rank, table_name, name, sql in order: views go first and come last; in between tables are added, dropped and
    altered (columns, indexes, keys; foreign keys only if asked for). Each kind of object is compared once, and a
    difference gives the statements of its kind as an array."""
    t = tables_diff(source, target, type_changes)
    at = q.table_ident(d, F.col("schema_name"), F.col("table_name"))
    kind, name = F.col("diff_type"), F.col("name")

    def rows(df: DataFrame, named: Column, *steps: tuple[int, str, Column]) -> DataFrame:
        """steps: (rank, kinds of difference, statement)."""
        each = [F.when(kind.isin(*kinds.split()) & (sql != ""), F.struct(F.lit(rank).alias("rank"), sql.alias("sql"))) for rank, kinds, sql in steps]
        return df.select("table_name", named.alias("name"), F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.rank", "table_name", "name", "x.sql")

    index = objects_diff(source, target, "index")
    if d.postgres:
        index = index.where("not coalesce(new.is_primary, old.is_primary, false)")
    views = t.where("table_type = 'VIEW'").select("table_name", "schema_name", "diff_type")
    views = views.unionByName(objects_diff(source, target, "view").select("table_name", "schema_name", "diff_type"))
    text = source.views.select(F.col("table_name"), F.struct("*").alias("v"))
    tables = t.where("table_type <> 'VIEW'")
    made = create_tables(d, source, tables.where("diff_type = 'ADD'")).withColumn("diff_type", F.lit("ADD"))
    frames = [
        rows(views.join(text, "table_name", "left"), F.col("table_name"), (10, "DROP MODIFY", q.simple("DROP VIEW", at)), (90, "ADD MODIFY", q.create_view(d, at, "v"))),
        rows(tables, F.col("table_name"), (20, "DROP", q.simple("DROP TABLE", at))),
        rows(made, F.col("table_name"), (30, "ADD", F.col("sql"))),
        rows(
            objects_diff(source, target, "column"),
            name,
            (41, "ADD", q.cat("ALTER TABLE ", at, " ADD COLUMN ", q.column_ddl(d, "new"), ";")),
            (42, "DROP", q.cat("ALTER TABLE ", at, " DROP COLUMN ", q.ident(d, name), ";")),
            (43, "MODIFY", q.alter_column(d, at, "old", "new")),
        ),
        rows(index, name, (44, "DROP MODIFY", q.drop_index(d, F.col("schema_name"), at, name)), (45, "ADD MODIFY", q.create_index(d, at, "new"))),
        rows(objects_diff(source, target, "primary_key"), name, (46, "DROP MODIFY", q.drop_primary_key(d, at, "old")), (47, "ADD MODIFY", q.add_primary_key(d, at, "new"))),
    ]
    if foreign_keys:
        word = " DROP CONSTRAINT " if d.postgres else " DROP FOREIGN KEY "
        frames.append(rows(objects_diff(source, target, "foreign_key"), name, (40, "DROP MODIFY", q.cat("ALTER TABLE ", at, word, q.ident(d, name), ";")), (48, "ADD MODIFY", q.cat("ALTER TABLE ", at, " ADD ", q.foreign_key_ddl(d, "new"), ";"))))
    return reduce(DataFrame.unionByName, frames).orderBy("rank", "table_name", "name")


def compare_connections(source: Catalog, target: Catalog, d: q.Dialect, foreign_keys: bool = True) -> tuple[DataFrame, DataFrame]:
    """(the differences, the script that removes them) of two catalogs read from connections or folders."""
    return schema_diff(source, target), schema_script(d, source, target, foreign_keys)
