"""Catalogs as flat DataFrames: from Spark schemas, from literal rows, and from database servers through JDBC."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HELD = 100_000  # rows of a catalog's frame that are held

SCHEMAS = {
    "tables": "table_name string, table_type string, schema_name string, comment string",
    "columns": "table_name string, column_name string, data_type string, nullable boolean, default_expr string, extra string, comment string, char_max_len int, numeric_prec int, numeric_scale int, position int",
    "indexes": "table_name string, index_name string, columns array<string>, is_unique boolean, is_primary boolean, method string, where_expr string, expression string",
    "primary_keys": "table_name string, pk_name string, columns array<string>",
    "foreign_keys": "table_name string, fk_name string, columns array<string>, ref_schema string, ref_table string, ref_columns array<string>, on_delete string, on_update string",
    "views": "table_name string, select_statement string, is_updatable boolean, check_option string, comment string",
}


@dataclass
class Catalog:
    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame
    primary_keys: DataFrame
    foreign_keys: DataFrame
    views: DataFrame

    def primary_key(self, table: str) -> list[str]:
        row = self.primary_keys.where(F.col("table_name") == table).first()
        return list(row["columns"]) if row else []

    def column_names(self, table: str) -> list[str]:
        """Names by position; a table without columns does not exist."""
        rows = self.columns.where(F.col("table_name") == table).orderBy("position").select("column_name").collect()
        if not rows:
            raise ValueError(f"no such table: {table}")
        return [r[0] for r in rows]


def table_type(text: str) -> str:
    t = (text or "").upper()
    return "TABLE" if t in ("TABLE", "BASE TABLE") else "VIEW" if t in ("VIEW", "MATERIALIZED VIEW") else "UNKNOWN"


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a relation of the plan itself, so that its size is known and small ones are broadcast."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)


def from_rows(spark: SparkSession, **rows: list[tuple]) -> Catalog:
    return Catalog(**{k: _local(spark, rows.get(k, []), s) for k, s in SCHEMAS.items()})


def held(spark: SparkSession, catalog: Catalog) -> Catalog:
    """The catalog read once: its frames are used many times, and a server's are queried anew each time. A frame of more
    than HELD rows stays as it is."""
    out = {}
    for name, schema in SCHEMAS.items():
        frame = getattr(catalog, name)
        few = frame.limit(HELD + 1).collect()
        out[name] = _local(spark, [tuple(r) for r in few], schema) if len(few) <= HELD else frame
    return Catalog(**out)


def from_frames(spark: SparkSession, frames: dict[str, DataFrame], keys: dict[str, list[str]], schema: str = "public") -> Catalog:
    """A catalog of Spark tables; keys come from the caller."""
    cols = [(t, f.name, f.dataType.simpleString(), f.nullable, None, "", None, None, None, None, i + 1) for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return from_rows(spark, tables=[(t, "TABLE", schema, None) for t in frames], columns=cols, primary_keys=[(t, f"{t}_pk", k) for t, k in keys.items()])


def ordered_columns(rows: DataFrame, group: list[str], value: str = "column_name", order: str = "ordinal_position") -> DataFrame:
    """One array for each group, in order: how keys and indexes are put together from a row per column."""
    x = F.sort_array(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*group).agg(F.transform(x, lambda y: y[value]).alias("columns"))


# Catalog queries for servers. Names are matched with their schema, foreign key columns by their ordinal.
_POSTGRES = {
    "tables": "SELECT t.table_name, t.table_type, t.table_schema AS schema_name, obj_description(c.oid, 'pg_class') AS comment FROM information_schema.tables t JOIN pg_namespace n ON n.nspname = t.table_schema JOIN pg_class c ON c.relname = t.table_name AND c.relnamespace = n.oid WHERE t.table_schema = '{schema}'",
    "columns": "SELECT k.table_name, k.column_name, k.data_type, k.is_nullable, k.column_default AS default_expr, '' AS extra, col_description(c.oid, k.ordinal_position) AS comment, k.character_maximum_length AS char_max_len, k.numeric_precision AS numeric_prec, k.numeric_scale, k.ordinal_position AS position FROM information_schema.columns k JOIN pg_namespace n ON n.nspname = k.table_schema JOIN pg_class c ON c.relname = k.table_name AND c.relnamespace = n.oid WHERE k.table_schema = '{schema}'",
    "primary_keys": "SELECT k.table_name, k.constraint_name, k.column_name, k.ordinal_position FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = '{schema}'",
    "indexes": "SELECT own.relname AS table_name, made.relname AS index_name, coalesce(field.attname, pg_get_indexdef(x.indexrelid, part.place::int, true)) AS column_name, CASE WHEN part.attribute = 0 THEN pg_get_indexdef(x.indexrelid, part.place::int, true) END AS expression, part.place AS ordinal_position, x.indisunique AS is_unique, x.indisprimary AS is_primary, (SELECT amname FROM pg_am WHERE oid = made.relam) AS method, pg_get_expr(x.indpred, x.indrelid) AS where_expr FROM pg_index x, LATERAL unnest(x.indkey) WITH ORDINALITY AS part(attribute, place) LEFT JOIN LATERAL (SELECT attname FROM pg_attribute WHERE attrelid = x.indrelid AND attnum = part.attribute AND part.attribute <> 0) field ON TRUE, pg_class own, pg_class made WHERE own.oid = x.indrelid AND made.oid = x.indexrelid AND part.place <= x.indnkeyatts AND NOT x.indisprimary AND own.relnamespace = (SELECT oid FROM pg_namespace WHERE nspname = '{schema}')",
    "foreign_keys": "SELECT (SELECT relname FROM pg_class WHERE oid = c.conrelid) AS table_name, c.conname AS fk_name, mine.attname AS column_name, part.place AS ordinal_position, n.nspname AS ref_schema, other.relname AS ref_table, theirs.attname AS ref_column, CASE c.confdeltype WHEN 'c' THEN 'CASCADE' WHEN 'r' THEN 'RESTRICT' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' ELSE 'NO ACTION' END AS on_delete, CASE c.confupdtype WHEN 'c' THEN 'CASCADE' WHEN 'r' THEN 'RESTRICT' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' ELSE 'NO ACTION' END AS on_update FROM pg_constraint c, LATERAL unnest(c.conkey, c.confkey) WITH ORDINALITY AS part(mine, theirs, place), pg_attribute mine, pg_attribute theirs, pg_class other, pg_namespace n WHERE c.contype = 'f' AND mine.attrelid = c.conrelid AND mine.attnum = part.mine AND theirs.attrelid = c.confrelid AND theirs.attnum = part.theirs AND other.oid = c.confrelid AND n.oid = other.relnamespace AND c.connamespace = (SELECT oid FROM pg_namespace WHERE nspname = '{schema}')",
    "views": "SELECT table_name, view_definition AS select_statement, is_updatable, check_option, '' AS comment FROM information_schema.views WHERE table_schema = '{schema}'",
}
_MYSQL = {
    "tables": "SELECT table_name AS table_name, table_type AS table_type, table_schema AS schema_name, table_comment AS comment FROM information_schema.tables WHERE table_schema = '{schema}'",
    "columns": "SELECT table_name AS table_name, column_name AS column_name, concat(data_type, CASE WHEN column_type LIKE '% unsigned%' THEN ' unsigned' ELSE '' END, CASE WHEN column_type LIKE '% zerofill%' THEN ' zerofill' ELSE '' END) AS data_type, is_nullable AS is_nullable, column_default AS default_expr, CASE WHEN data_type IN ('enum', 'set') THEN column_type ELSE extra END AS extra, column_comment AS comment, character_maximum_length AS char_max_len, numeric_precision AS numeric_prec, numeric_scale AS numeric_scale, ordinal_position AS position FROM information_schema.columns WHERE table_schema = '{schema}'",
    "primary_keys": "SELECT table_name AS table_name, constraint_name AS constraint_name, column_name AS column_name, ordinal_position AS ordinal_position FROM information_schema.key_column_usage WHERE constraint_name = 'PRIMARY' AND table_schema = '{schema}'",
    "indexes": "SELECT table_name AS table_name, index_name AS index_name, coalesce(column_name, expression) AS column_name, expression AS expression, seq_in_index AS ordinal_position, non_unique = 0 AS is_unique, FALSE AS is_primary, lower(index_type) AS method, NULL AS where_expr FROM information_schema.statistics WHERE index_name <> 'PRIMARY' AND table_schema = '{schema}'",
    "foreign_keys": "SELECT k.table_name AS table_name, k.constraint_name AS fk_name, k.column_name AS column_name, k.ordinal_position AS ordinal_position, k.referenced_table_schema AS ref_schema, k.referenced_table_name AS ref_table, k.referenced_column_name AS ref_column, r.delete_rule AS on_delete, r.update_rule AS on_update FROM information_schema.key_column_usage k JOIN information_schema.referential_constraints r ON r.constraint_schema = k.constraint_schema AND r.constraint_name = k.constraint_name AND r.table_name = k.table_name WHERE k.referenced_table_name IS NOT NULL AND k.table_schema = '{schema}'",
    "views": "SELECT table_name AS table_name, view_definition AS select_statement, is_updatable AS is_updatable, check_option AS check_option, '' AS comment FROM information_schema.views WHERE table_schema = '{schema}'",
}


def queries_for(kind: str, schema: str) -> dict[str, str]:
    found = {"postgres": _POSTGRES, "mysql": _MYSQL}.get(kind)
    if found is None:
        raise ValueError(f"unsupported database type: {kind}")
    return {k: v.format(schema=schema.replace("'", "''")) for k, v in found.items()}


def assemble(raw: dict[str, DataFrame], quote: str = '"') -> Catalog:
    """A catalog from the rows that the queries above return (one row for each column of a key or index)."""
    kind = F.upper(F.col("table_type"))
    tables = raw["tables"].withColumn("table_type", F.when(kind.isin("TABLE", "BASE TABLE"), "TABLE").when(kind.isin("VIEW", "MATERIALIZED VIEW"), "VIEW").otherwise("UNKNOWN")).where("table_type <> 'UNKNOWN'")
    columns = raw["columns"].withColumn("nullable", F.upper("is_nullable") == "YES")
    pks = ordered_columns(raw["primary_keys"], ["table_name", "constraint_name"]).withColumnRenamed("constraint_name", "pk_name")
    by = ["table_name", "index_name", "is_unique", "is_primary", "method", "where_expr"]
    parts = raw["indexes"] if "expression" in raw["indexes"].columns else raw["indexes"].withColumn("expression", F.lit(None).cast("string"))
    quoted = F.transform(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name", "expression"))), lambda y: F.coalesce(F.concat(F.lit("("), y["expression"], F.lit(")")), F.concat(F.lit(quote), y["column_name"], F.lit(quote))))
    ix = ordered_columns(parts, by).drop("expression").join(parts.groupBy(*by).agg(F.when(F.count("expression") > 0, F.array_join(quoted, ", ")).alias("expression")).select("table_name", "index_name", "expression"), ["table_name", "index_name"])
    fk = ["table_name", "fk_name", "ref_schema", "ref_table", "on_delete", "on_update"]
    x = F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name", "ref_column")))
    fks = raw["foreign_keys"].groupBy(*fk).agg(F.transform(x, lambda y: y["column_name"]).alias("columns"), F.transform(x, lambda y: y["ref_column"]).alias("ref_columns"))
    views = raw["views"].withColumn("is_updatable", F.upper(F.col("is_updatable").cast("string")) == "YES")
    frames = {"tables": tables, "columns": columns, "primary_keys": pks, "indexes": ix, "foreign_keys": fks, "views": views}
    return Catalog(**{k: frames[k].selectExpr(*[f"cast({n} as {t}) as {n}" for n, t in (c.strip().split(" ", 1) for c in s.split(", "))]) for k, s in SCHEMAS.items()})


def from_jdbc(spark: SparkSession, kind: str, schema: str, options: dict[str, str]) -> Catalog:
    return held(spark, assemble({k: spark.read.format("jdbc").options(**options).option("query", sql).load() for k, sql in queries_for(kind, schema).items()}, "`" if kind == "mysql" else '"'))


# ---- the joins of a catalog, over a server's raw rows ----


def primary_key_columns(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """table_name, pk_name, column_name, place: constraints met with the columns they use, in one table."""
    keys = constraints.where("kind = 'PRIMARY KEY'").select("table_name", "name")
    return keys.join(usage, ["table_name", "name"]).select("table_name", F.col("name").alias("pk_name"), "column_name", "place")


def foreign_key_columns(constraints: DataFrame, usage: DataFrame, references: DataFrame) -> DataFrame:
    """table_name, fk_name, place, column_name, ref_table, ref_column, on_delete, on_update: four sets of rows met by
    table and name, and the referenced column by the place that it has in its own key."""
    mine = constraints.where("kind = 'FOREIGN KEY'").select("table_name", "name").join(usage, ["table_name", "name"]).join(references, ["table_name", "name"])
    theirs = usage.select(F.col("table_name").alias("ref_table"), F.col("name").alias("ref_name"), F.col("place").alias("ref_place"), F.col("column_name").alias("ref_column"))
    both = mine.join(theirs, ["ref_table", "ref_name", "ref_place"])
    return both.select("table_name", F.col("name").alias("fk_name"), "place", "column_name", "ref_table", "ref_column", "on_delete", "on_update")


def table_ids(classes: DataFrame, namespaces: DataFrame, schema: str) -> DataFrame:
    """owner, table_name of the tables of one schema."""
    own = namespaces.where(F.col("name") == schema).select(F.col("oid").alias("namespace"))
    return classes.join(own, "namespace").select(F.col("oid").alias("owner"), F.col("name").alias("table_name"))


def table_comments(ids: DataFrame, descriptions: DataFrame) -> DataFrame:
    """table_name, comment (null where there is none)."""
    notes = descriptions.where("place = 0").select("owner", F.col("text").alias("comment"))
    return ids.join(notes, "owner", "left").select("table_name", "comment")


def column_comments(fields: DataFrame, ids: DataFrame, descriptions: DataFrame) -> DataFrame:
    """table_name, column_name, place, comment: every column stays, whether its table has an id or it a comment."""
    notes = descriptions.select("owner", "place", F.col("text").alias("comment"))
    return fields.join(ids, "table_name", "left").join(notes, ["owner", "place"], "left").select("table_name", "column_name", "place", "comment")


def from_folder(spark: SparkSession, folder: str, keys: dict[str, list[str]] | None = None) -> Catalog:
    """The catalog of a folder of Parquet tables; a server's keys come from its catalog, a folder's from the caller."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(n.removesuffix(".parquet") for n in (f.getPath().getName() for f in found) if n.endswith(".parquet"))
    return from_frames(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}, {k: v for k, v in (keys or {}).items() if k in names})
