"""Named queries, each (spark, sf_dir) -> DataFrame, and the same results as SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqltext as q
from ..operators import migrate, rowdiff, schemadiff
from ..sources import catalogs as catalog_rows
from ..sources.catalogs import ordered_columns
from . import sync
from . import fixtures as fx

MONEY = {"o_totalprice", "c_acctbal"}


def _pair(spark: SparkSession, sf_dir: str, table: str, money: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    key, columns, *_ = fx.CHANGES[table]
    src = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
    tgt = fx.changed(spark, table, src)
    if money:  # the text of a decimal is the same in every engine
        src, tgt = (d.select(*[d[c].cast("decimal(18,2)").alias(c) if c in MONEY else d[c] for c in columns]) for d in (src, tgt))
    return src, tgt, key


def _flat(diff: DataFrame, table: str, kinds: bool = True) -> DataFrame:
    key, columns, *_ = fx.CHANGES[table]
    as_text = lambda side, c: F.col(f"{side}.{c}").cast("string" if c in ("o_orderdate", "ts") else diff.schema["new"].dataType[c].dataType).alias(f"{side}_{c}")
    return diff.select(*(["diff_type"] if kinds else []), *key, *[as_text(s, c) for c in columns if c not in key for s in ("old", "new")])


def _side(spark: SparkSession, sf_dir: str, table: str, what: str) -> DataFrame:
    src, tgt, key = _pair(spark, sf_dir, table)
    if what == "MODIFY":
        return _flat(rowdiff.modified(src, tgt, key), table, False)
    rows = (rowdiff.added if what == "ADD" else rowdiff.dropped)(src, tgt, key)
    return rows.select(*[F.col(c).cast("string").alias(c) if c in ("o_orderdate", "ts") else F.col(c) for c in rows.columns])


def _diff(spark: SparkSession, sf_dir: str, table: str, compare: list[str] | None = None) -> DataFrame:
    src, tgt, key = _pair(spark, sf_dir, table)
    return _flat(rowdiff.row_diff(src, tgt, key, compare), table)


def _identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, _, key = _pair(spark, sf_dir, "customer")
    return rowdiff.row_diff(src, src.select("*"), key).agg(F.count(F.lit(1)).alias("changes"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for t in ("orders", "customer", "part", "events"):
        src, tgt, key = _pair(spark, sf_dir, t)
        parts.append(rowdiff.summary(rowdiff.row_diff(src, tgt, key), t))
    return reduce(DataFrame.unionByName, parts)


def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowdiff.verify_sync(*_pair(spark, sf_dir, "orders"))


def _multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, tgt, _ = _pair(spark, sf_dir, "part")
    return rowdiff.multiset_diff(src, tgt).groupBy("diff_type").agg(F.count(F.lit(1)).alias("n"))


def _changed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, tgt, key = _pair(spark, sf_dir, "orders")
    return rowdiff.changed_columns(rowdiff.row_diff(src, tgt, key)).select("o_orderkey", F.array_join("changed", ",").alias("changed"))


def _page(spark: SparkSession, sf_dir: str, table: str, after: list, columns: list[str]) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
    return rowdiff.keyset_page(df, fx.CHANGES[table][0], after, 1000)  # a page is the feature


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


RANK = {"DROP": 0, "ADD": 1, "MODIFY": 2}


def _sql_of(d: q.Dialect, table: str, tgt: DataFrame, key: list[str]) -> dict:
    kinds, columns = _kinds(tgt), tgt.columns
    return {"ADD": q.insert(d, table, "new", columns, kinds), "DROP": q.delete(d, table, "old", key, kinds), "MODIFY": q.update(d, table, "new", columns, key, kinds)}


def _statements(spark: SparkSession, sf_dir: str, table: str, d: q.Dialect, what: str) -> DataFrame:
    src, tgt, key = _pair(spark, sf_dir, table, True)
    return rowdiff.row_diff(src, tgt, key).where(F.col("diff_type") == what).select(*key, _sql_of(d, table, tgt, key)[what].alias("sql"))


def sync_script(spark: SparkSession, sf_dir: str, d: q.Dialect, tables: tuple[str, ...] = ("orders", "customer")) -> DataFrame:
    """table_name, rank, k (key text), sql: the order of a script is table, rank, key. One join a table."""
    parts = []
    for t in tables:
        src, tgt, key = _pair(spark, sf_dir, t, True)
        parts.append(sync.statements(rowdiff.row_diff(src, tgt, key), t, key, _sql_of(d, t, tgt, key)))
    return reduce(DataFrame.unionByName, parts)


INJECTED = "text || chr(39) || chr(92) || chr(9) || chr(10) || chr(13) || chr(8) || chr(12)"


def _escape(spark: SparkSession, sf_dir: str, d: q.Dialect) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(INJECTED).alias("text"))
    return df.select("doc_id", F.md5(q.literal(d, F.col("text"), "string").cast("binary")).alias("md5"))


def _objects(spark: SparkSession, _: str, kind: str) -> DataFrame:
    return schemadiff.objects_diff(*fx.catalogs(spark), kind).select("table_name", "name", "diff_type")


def _tables(spark: SparkSession, _: str) -> DataFrame:
    return schemadiff.tables_diff(*fx.catalogs(spark)).select("table_name", "table_type", "diff_type")


def _script(spark: SparkSession, _: str, d: q.Dialect) -> DataFrame:
    return schemadiff.schema_script(d, *fx.catalogs(spark), foreign_keys=True)


SHAPES = [(None, None, None), (0, None, None), (10, None, None), (None, 12, None), (None, 12, 3)]


def _type_rows(d: q.Dialect) -> list[tuple]:
    names = [*d.plain, *d.length, *d.decimal, *d.floating, "xml", "tsvector", "bit"]
    return [(n, *s) for n in names for s in SHAPES]


def _type_map(spark: SparkSession, _: str, d: q.Dialect) -> DataFrame:
    df = spark.createDataFrame(_type_rows(d), "data_type string, len int, prec int, scale int")
    return df.select("data_type", "len", "prec", "scale", q.type_ddl(d, F.col("data_type"), F.col("len"), F.col("prec"), F.col("scale")).alias("ddl"))


def _column_ddl(spark: SparkSession, _: str, d: q.Dialect) -> DataFrame:
    return fx.catalogs(spark)[0].columns.withColumn("c", F.struct("*")).select("table_name", "column_name", q.column_ddl(d, "c").alias("ddl"))


def _ddl(spark: SparkSession, _: str, d: q.Dialect, what: str) -> DataFrame:
    s, t = fx.catalogs(spark)
    at = q.table_ident(d, F.lit("public"), F.col("table_name"))
    if what == "create_table":
        return schemadiff.create_tables(d, s, s.tables.where("table_type = 'TABLE'"))
    if what == "index":
        df = s.indexes.withColumn("i", F.struct("*"))
        return df.select("table_name", F.col("index_name").alias("name"), q.create_index(d, at, "i").alias("create_sql"), q.drop_index(d, F.lit("public"), at, F.col("index_name")).alias("drop_sql"))
    if what == "pk":
        df = s.primary_keys.withColumn("k", F.struct("*"))
        return df.select("table_name", q.add_primary_key(d, at, "k").alias("create_sql"), q.drop_primary_key(d, at, "k").alias("drop_sql"))
    if what == "view":
        df = s.views.withColumn("v", F.struct("*"))
        return df.select("table_name", q.create_view(d, at, "v").alias("create_sql"), q.simple("DROP VIEW", at).alias("drop_sql"))
    return schemadiff.objects_diff(s, t, "column").where("diff_type = 'MODIFY'").select("table_name", "name", q.alter_column(d, at, "old", "new").alias("sql"))


def _key_agg(spark: SparkSession, _: str) -> DataFrame:
    df = spark.createDataFrame(fx.KEY_COLUMNS, "constraint_name string, ordinal_position int, column_name string")
    return ordered_columns(df, ["constraint_name"]).select("constraint_name", F.array_join("columns", ",").alias("columns"))


def _catalog_join(spark: SparkSession, _: str, what: str) -> DataFrame:
    raw = fx.raw(spark)
    ids = catalog_rows.table_ids(raw["classes"], raw["namespaces"], "public")
    if what == "pk":
        return catalog_rows.primary_key_columns(raw["constraints"], raw["usage"])
    if what == "fk":
        return catalog_rows.foreign_key_columns(raw["constraints"], raw["usage"], raw["references"])
    if what == "table":
        return catalog_rows.table_comments(ids, raw["descriptions"])
    return catalog_rows.column_comments(raw["fields"], ids, raw["descriptions"])


def _membership(spark: SparkSession, _: str) -> DataFrame:
    s, _t = fx.catalogs(spark)
    ix = s.indexes.select("table_name", "index_name", F.posexplode("columns").alias("ordinal", "column_name"))
    return ix.join(s.columns.select("table_name", "column_name", "data_type"), ["table_name", "column_name"], "left").select("table_name", "index_name", "ordinal", "column_name", "data_type")


def _files(spark: SparkSession) -> DataFrame:
    return migrate.parse(spark.createDataFrame([(f"/m/{f}",) for f in fx.FILES], "path string"))


def _sorted(spark: SparkSession, _: str) -> DataFrame:
    """The place of each file's version in the order; files are few."""
    key = migrate.version_key(F.col("version"))
    return _files(spark).select("path", "direction", F.dense_rank().over(Window.orderBy(key)).alias("place"))


def _compared(spark: SparkSession, _: str) -> DataFrame:
    f = _files(spark)
    a, b = f.select(F.col("path").alias("a"), F.col("version").alias("x")), f.select(F.col("path").alias("b"), F.col("version").alias("y"))
    return a.join(b, a["a"] < b["b"]).select("a", "b", migrate.compare(F.col("x"), F.col("y")).alias("sign"))


def _state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fx.STATE, "id int, version string, status string")


def _pending(spark: SparkSession, _: str) -> DataFrame:
    return migrate.pending(_files(spark), fx.CURRENT, fx.LIMIT).select("path", "version")


def _clean(spark: SparkSession, _: str) -> DataFrame:
    return spark.createDataFrame(fx.SCRIPTS, "id int, sql string").select("id", migrate.strip_transactions(F.col("sql")).alias("sql"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "rowdiff_orders": partial(_diff, table="orders"),
        "rowdiff_orders_added": partial(_side, table="orders", what="ADD"),
        "rowdiff_orders_dropped": partial(_side, table="orders", what="DROP"),
        "rowdiff_orders_modified": partial(_side, table="orders", what="MODIFY"),
        "rowdiff_orders_subset": partial(_diff, table="orders", compare=["o_orderstatus", "o_orderpriority"]),
        "rowdiff_conversations_composite": partial(_diff, table="conversations"),
        "rowdiff_events_null_safe": partial(_diff, table="events"),
        "rowdiff_customer_identical": _identical,
        "rowdiff_summary": _summary,
        "rowdiff_apply_verify": _verify,
        "rowdiff_part_multiset": _multiset,
        "rowdiff_orders_changed_columns": _changed_columns,
        "keyset_page_orders": partial(_page, table="orders", after=[5000], columns=["o_orderkey", "o_custkey", "o_totalprice"]),
        "keyset_page_composite": partial(_page, table="conversations", after=[20, 1], columns=["conv_id", "turn", "role"]),
        "schemadiff_tables": _tables,
        "ordered_key_agg": _key_agg,
        **{f"catalog_{n}": partial(_catalog_join, what=w) for n, w in (("pk_join", "pk"), ("fk_join", "fk"), ("left_join_comments", "column"), ("table_comments", "table"))},
        "index_any_membership": _membership,
        "migration_parse": lambda s, _: _files(s),
        "migration_sort": _sorted,
        "migration_compare": _compared,
        "migration_pending": _pending,
        "migration_pending_count": lambda s, _: migrate.pending_count(_files(s), fx.CURRENT),
        "migration_current": lambda s, _: migrate.current_version(_state(s)),
        "migration_clean_tx": _clean,
    }
    for short, d in (("pg", q.POSTGRES), ("mysql", q.MYSQL)):
        for name, what in (("insert", "ADD"), ("delete", "DROP"), ("update", "MODIFY")):
            out[f"dml_{name}_{short}"] = partial(_statements, table="orders", d=d, what=what)
            out[f"dml_{name}_composite_{short}"] = partial(_statements, table="conversations", d=d, what=what)
        out[f"sync_script_{short}"] = partial(sync_script, d=d)
        out[f"literal_escape_{short}"] = partial(_escape, d=d)
        out[f"type_map_{short}"] = partial(_type_map, d=d)
        out[f"column_ddl_{short}"] = partial(_column_ddl, d=d)
        out[f"schema_script_{short}"] = partial(_script, d=d)
        for what in ("create_table", "index", "pk", "view", "column"):
            out[f"ddl_{what}_{short}"] = partial(_ddl, d=d, what=what)
    for kind, name in (("column", "columns"), ("index", "indexes"), ("primary_key", "pk"), ("foreign_key", "fk"), ("view", "views")):
        out[f"schemadiff_{name}"] = partial(_objects, kind=kind)
    return out


# ---- the same as SQL ----


def _join_sql(table: str, compare: list[str] | None = None, money: bool = False) -> str:
    key, columns, *_ = fx.CHANGES[table]
    cols = ", ".join(f"CAST({c} AS DECIMAL(18,2)) AS {c}" if money and c in MONEY else c for c in columns)
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in key)
    differ = " OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in compare or columns)
    return f"""WITH s AS (SELECT {cols}, 1 AS i FROM {table}), t AS (SELECT {cols}, 1 AS i FROM ({fx.changed_sql(table)})),
    j AS (SELECT CASE WHEN t.i IS NULL THEN 'ADD' WHEN s.i IS NULL THEN 'DROP' WHEN {differ} THEN 'MODIFY' END AS diff_type,
          {', '.join(f't.{c} AS old_{c}, s.{c} AS new_{c}' for c in columns)} FROM s FULL JOIN t ON {on})"""


def _diff_sql(table: str, compare: list[str] | None = None, only: str = "") -> str:
    key, columns, *_ = fx.CHANGES[table]
    cast = lambda side, c: f"CAST({side}_{c} AS VARCHAR) AS {side}_{c}" if c in ("o_orderdate", "ts") else f"{side}_{c}"
    keys = ", ".join(f"coalesce(new_{k}, old_{k}) AS {k}" for k in key)
    rest = ", ".join(cast(s, c) for c in columns if c not in key for s in ("old", "new"))
    return f"{_join_sql(table, compare)} SELECT {'' if only else 'diff_type, '}{keys}, {rest} FROM j WHERE diff_type " + (f"= '{only}'" if only else "IS NOT NULL")


def _one_side_sql(table: str, what: str, side: str) -> str:
    columns = fx.CHANGES[table][1]
    cols = ", ".join(f"CAST({side}_{c} AS VARCHAR) AS {c}" if c in ("o_orderdate", "ts") else f"{side}_{c} AS {c}" for c in columns)
    return f"{_join_sql(table)} SELECT {cols} FROM j WHERE diff_type = '{what}'"


def _literal_sql(d: q.Dialect, c: str, number: bool) -> str:
    if number:
        return f"coalesce(CAST({c} AS VARCHAR), 'NULL')"
    text = f"CAST({c} AS VARCHAR)"
    steps = [("39", "''''''")] if d.postgres else [("92", "chr(92) || chr(92)"), ("39", "''''''"), ("10", "chr(92) || 'n'"), ("13", "chr(92) || 'r'"), ("9", "chr(92) || 't'"), ("8", "chr(92) || 'b'"), ("12", "chr(92) || 'f'")]
    for code, to in steps:
        text = f"replace({text}, chr({code}), {to})"
    return f"coalesce(chr(39) || {text} || chr(39), 'NULL')"


NUMBERS = {"o_orderkey", "o_custkey", "o_totalprice", "c_custkey", "c_nationkey", "c_acctbal", "conv_id", "turn"}


def _dml_sql(table: str, d: q.Dialect, what: str, head: str = "") -> str:
    key, columns, *_ = fx.CHANGES[table]
    side = "old" if what == "DROP" else "new"
    lit = lambda c: _literal_sql(d, f"{side}_{c}", c in NUMBERS)
    name = lambda c: f"{d.quote}{c}{d.quote}"
    where = " || ' AND ' || ".join(f"'{name(k)} = ' || {lit(k)}" for k in key)
    if what == "ADD":
        sql = f"'INSERT INTO {name(table)} ({', '.join(map(name, columns))}) VALUES (' || " + " || ', ' || ".join(map(lit, columns)) + " || ');'"
    elif what == "DROP":
        sql = f"'DELETE FROM {name(table)} WHERE ' || {where} || ';'"
    else:
        sql = f"'UPDATE {name(table)} SET ' || " + " || ', ' || ".join(f"'{name(c)} = ' || {lit(c)}" for c in columns if c not in key) + f" || ' WHERE ' || {where} || ';'"
    keys = ", ".join(f"{side}_{k} AS {k}" for k in key)
    return f"{_join_sql(table, money=True)} SELECT {head or keys}, {sql} AS sql FROM j WHERE diff_type = '{what}'"


def _sync_sql(d: q.Dialect) -> str:
    parts = []
    for t in ("orders", "customer"):
        for what, rank in RANK.items():
            k = fx.CHANGES[t][0][0]
            parts.append(f"SELECT * FROM ({_dml_sql(t, d, what, f'{chr(39)}{t}{chr(39)} AS table_name, {rank} AS rank, CAST(coalesce(new_{k}, old_{k}) AS VARCHAR) AS k')})")
    return " UNION ALL ".join(parts)


def _objects_sql(kind: str) -> str:
    frame, own = schemadiff.FRAMES[kind], schemadiff.NAMES[kind]
    on = "s.table_name = t.table_name" + (f" AND s.{own} = t.{own}" if own else "")
    strip = lambda x, c: f"regexp_replace({x}.{c}, '[\\r\\n]', '', 'g')" if c == "comment" else f"{x}.{c}"
    differ = " OR ".join(f"{strip('s', c)} IS DISTINCT FROM {strip('t', c)}" for c in schemadiff.COMPARED[kind])
    name = f"coalesce(s.{own}, t.{own})" if own else "coalesce(s.pk_name, t.pk_name)" if kind == "primary_key" else "coalesce(s.table_name, t.table_name)"
    both = f"SELECT s.table_name FROM s_tables s JOIN t_tables t ON s.table_name = t.table_name AND s.table_type = t.table_type WHERE s.table_type = '{'VIEW' if kind == 'view' else 'TABLE'}'"
    return f"""WITH {fx.catalog_ctes()}, j AS (SELECT coalesce(s.table_name, t.table_name) AS table_name, {name} AS name,
        CASE WHEN t.table_name IS NULL THEN 'ADD' WHEN s.table_name IS NULL THEN 'DROP' WHEN {differ} THEN 'MODIFY' END AS diff_type
        FROM s_{frame} s FULL JOIN t_{frame} t ON {on}) SELECT * FROM j WHERE diff_type IS NOT NULL AND table_name IN ({both})"""


def _type_sql(d: q.Dialect) -> str:
    rows = fx.values(_type_rows(d), ["data_type", "len", "prec", "scale"], ["VARCHAR", "INTEGER", "INTEGER", "INTEGER"])
    plain = fx.values([(k, v) for k, v in d.plain.items()], ["n", "v"])
    length = fx.values([(k, *v) for k, v in d.length.items()], ["n", "v", "bare"])
    dec = fx.values([(k, *v, False) for k, v in d.decimal.items()] + [(k, v, v, True) for k, v in d.floating.items()], ["n", "v", "bare", "strict"])
    return f"""WITH r AS ({rows}), p AS ({plain}), l AS ({length}), x AS ({dec})
    SELECT data_type, len, prec, scale, CASE WHEN p.n IS NOT NULL THEN p.v
        WHEN l.n IS NOT NULL THEN CASE WHEN len > 0 THEN l.v || '(' || len || ')' ELSE l.bare END
        WHEN x.n IS NOT NULL THEN CASE WHEN prec IS NOT NULL AND scale IS NOT NULL THEN x.v || '(' || prec || ',' || scale || ')' WHEN prec IS NOT NULL AND NOT x.strict THEN x.v || '(' || prec || ')' ELSE x.bare END
        ELSE data_type END AS ddl FROM r LEFT JOIN p ON p.n = data_type LEFT JOIN l ON l.n = data_type LEFT JOIN x ON x.n = data_type"""


def _ddl_sql(d: q.Dialect) -> dict[str, str]:
    """CREATE TABLE, ALTER COLUMN, indexes, keys and the whole script, put together from the catalogs' rows by SQL."""
    pg, nl = d.postgres, "chr(10)"
    name = lambda e: f"'{d.quote}' || {e} || '{d.quote}'"
    names = lambda e: f"array_to_string(list_transform({e}, lambda x: '{d.quote}' || x || '{d.quote}'), ', ')"
    kind = "CASE data_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.plain.items()) + f" WHEN 'varchar' THEN 'varchar(' || char_max_len || ')' WHEN 'numeric' THEN '{d.decimal['numeric'][0]}(' || numeric_prec || ',' || numeric_scale || ')' END"
    note = "" if pg else ", CASE WHEN comment <> '' THEN 'COMMENT ''' || replace(comment, chr(10), chr(92) || 'n') || '''' END"
    made = f"concat_ws(' ', {name('column_name')}, {kind}, CASE WHEN NOT nullable THEN 'NOT NULL' END, CASE WHEN default_expr <> '' THEN 'DEFAULT ' || default_expr END{note})"
    using = "CASE WHEN method <> 'btree' THEN ' USING ' || method ELSE '' END" if pg else "''"
    drop_ix = f"'DROP INDEX ' || {name('index_name')} || ';'" if pg else f"'DROP INDEX ' || {name('index_name')} || ' ON ' || {name('table_name')} || ';'"
    drop_pk = f"' DROP CONSTRAINT ' || {name('pk_name')} || ';'" if pg else "' DROP PRIMARY KEY;'"
    alter = f"'ALTER TABLE ' || {name('table_name')}"
    add_pk = f"{alter} || ' ADD CONSTRAINT ' || {name('pk_name')} || ' PRIMARY KEY (' || {names('columns')} || ');'"
    fk = f"'CONSTRAINT ' || {name('fk_name')} || ' FOREIGN KEY (' || {names('columns')} || ') REFERENCES ' || {name('ref_table')} || ' (' || {names('ref_columns')} || ')' || CASE WHEN on_delete <> '' THEN ' ON DELETE ' || on_delete ELSE '' END || CASE WHEN on_update <> '' THEN ' ON UPDATE ' || on_update ELSE '' END"
    check = f"CASE WHEN check_option <> 'NONE' THEN {nl} || 'WITH ' || check_option || ' CHECK OPTION' ELSE '' END"
    ctes = [fx.catalog_ctes()]
    for x in "st":
        ctes += [
            f"{x}c AS (SELECT *, {kind} AS kind, {made} AS ddl FROM {x}_columns)",
            f"{x}i AS (SELECT *, 'CREATE ' || CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || 'INDEX ' || {name('index_name')} || ' ON ' || {name('table_name')} || {using} || ' (' || coalesce(expression, {names('columns')}) || ')' || coalesce(' WHERE ' || where_expr, '') || ';' AS create_sql, {drop_ix} AS drop_sql FROM {x}_indexes)",
            f"{x}k AS (SELECT *, {add_pk} AS create_sql, {alter} || {drop_pk} AS drop_sql FROM {x}_primary_keys)",
            f"{x}f AS (SELECT *, {fk} AS ddl FROM {x}_foreign_keys)",
        ]
    head = f"'  CONSTRAINT ' || {name('pk_name')} || ' PRIMARY KEY ('" if pg else "'  PRIMARY KEY ('"
    comments = ""
    if pg:
        line = f"{nl} || {nl} || 'COMMENT ON COLUMN ' || {name('table_name')} || '.' || {name('column_name')} || ' IS ' || chr(39) || comment || chr(39) || ';'"
        comments = f" || coalesce((SELECT string_agg({line}, '' ORDER BY position) FROM sc f WHERE f.table_name = m.table_name AND comment IS NOT NULL), '')"
    joined = lambda order, frame: f"(SELECT string_agg('  ' || ddl, ',' || {nl} ORDER BY {order}) FROM {frame} f WHERE f.table_name = m.table_name)"
    lines = f"concat_ws(',' || {nl}, {joined('position', 'sc')}, (SELECT {head} || {names('columns')} || ')' FROM sk f WHERE f.table_name = m.table_name), {joined('fk_name', 'sf')})"
    tables = f"made AS (SELECT m.table_name, 'CREATE TABLE ' || {name('m.table_name')} || ' (' || {nl} || {lines} || {nl} || ');' || coalesce((SELECT string_agg({nl} || {nl} || create_sql, '' ORDER BY index_name) FROM si f WHERE f.table_name = m.table_name), ''){comments} AS sql FROM s_tables m WHERE table_type = 'TABLE')"
    at = f"'ALTER TABLE ' || {name('s.table_name')} || ' ALTER COLUMN ' || {name('s.column_name')}"
    if pg:
        change = f"""concat_ws(' ', CASE WHEN s.kind IS DISTINCT FROM t.kind THEN {at} || ' TYPE ' || s.kind || CASE WHEN s.kind IN ('int2', 'int4', 'int8', 'json', 'jsonb') THEN ' USING ' || {name('s.column_name')} || '::' || s.kind ELSE '' END || ';' END,
            CASE WHEN s.default_expr <> '' AND s.default_expr IS DISTINCT FROM t.default_expr THEN {at} || ' SET DEFAULT ' || s.default_expr || ';' WHEN coalesce(s.default_expr, '') = '' AND t.default_expr <> '' THEN {at} || ' DROP DEFAULT;' END,
            CASE WHEN s.nullable <> t.nullable THEN {at} || CASE WHEN s.nullable THEN ' DROP' ELSE ' SET' END || ' NOT NULL;' END,
            CASE WHEN s.comment IS DISTINCT FROM t.comment THEN 'COMMENT ON COLUMN ' || {name('s.table_name')} || '.' || {name('s.column_name')} || ' IS ' || coalesce(chr(39) || s.comment || chr(39), 'NULL') || ';' END)"""
    else:
        change = f"'ALTER TABLE ' || {name('s.table_name')} || ' MODIFY COLUMN ' || s.ddl || ';'"
    delta = {k: f"d_{k} AS ({_objects_sql(k)})" for k in schemadiff.COMPARED}
    column = f"altered AS (SELECT s.table_name, s.column_name AS name, {change} AS sql FROM sc s JOIN tc t USING (table_name, column_name) JOIN d_column x ON x.table_name = s.table_name AND x.name = s.column_name WHERE x.diff_type = 'MODIFY')"
    lost = lambda a, b, k: f"SELECT table_name FROM {a}_tables x WHERE table_type = '{k}' AND NOT EXISTS (SELECT 1 FROM {b}_tables y WHERE y.table_name = x.table_name AND y.table_type = x.table_type)"
    word = " DROP CONSTRAINT " if pg else " DROP FOREIGN KEY "
    parts = [
        f"SELECT 10, table_name, table_name, 'DROP VIEW ' || {name('table_name')} || ';' FROM ({lost('t', 's', 'VIEW')} UNION ALL SELECT table_name FROM d_view WHERE diff_type <> 'ADD')",
        f"SELECT 20, table_name, table_name, 'DROP TABLE ' || {name('table_name')} || ';' FROM ({lost('t', 's', 'TABLE')})",
        f"SELECT 30, table_name, table_name, sql FROM made WHERE table_name IN ({lost('s', 't', 'TABLE')})",
        f"SELECT 40, table_name, name, {alter} || '{word}' || {name('name')} || ';' FROM d_foreign_key WHERE diff_type <> 'ADD'",
        f"SELECT 41, x.table_name, x.name, 'ALTER TABLE ' || {name('x.table_name')} || ' ADD COLUMN ' || c.ddl || ';' FROM d_column x JOIN sc c ON c.table_name = x.table_name AND c.column_name = x.name WHERE diff_type = 'ADD'",
        f"SELECT 42, table_name, name, {alter} || ' DROP COLUMN ' || {name('name')} || ';' FROM d_column WHERE diff_type = 'DROP'",
        "SELECT 43, table_name, name, sql FROM altered",
        "SELECT 44, x.table_name, x.name, i.drop_sql FROM d_index x JOIN ti i ON i.table_name = x.table_name AND i.index_name = x.name WHERE diff_type <> 'ADD'",
        "SELECT 45, x.table_name, x.name, i.create_sql FROM d_index x JOIN si i ON i.table_name = x.table_name AND i.index_name = x.name WHERE diff_type <> 'DROP'",
        "SELECT 46, x.table_name, x.name, k.drop_sql FROM d_primary_key x JOIN tk k USING (table_name) WHERE diff_type <> 'ADD'",
        "SELECT 47, x.table_name, x.name, k.create_sql FROM d_primary_key x JOIN sk k USING (table_name) WHERE diff_type <> 'DROP'",
        f"SELECT 48, x.table_name, x.name, 'ALTER TABLE ' || {name('x.table_name')} || ' ADD ' || f.ddl || ';' FROM d_foreign_key x JOIN sf f ON f.table_name = x.table_name AND f.fk_name = x.name WHERE diff_type <> 'DROP'",
        f"SELECT 90, table_name, table_name, 'CREATE VIEW ' || {name('table_name')} || ' AS' || {nl} || select_statement || {check} || ';' FROM s_views WHERE table_name IN ({lost('s', 't', 'VIEW')} UNION ALL SELECT table_name FROM d_view WHERE diff_type <> 'DROP')",
    ]
    base, every = f"WITH {', '.join(ctes)}", ", ".join(delta.values())
    return {
        "ddl_create_table": f"{base}, {tables} SELECT table_name, sql FROM made",
        "ddl_column": f"{base}, {delta['column']}, {column} SELECT table_name, name, sql FROM altered",
        "ddl_index": f"{base} SELECT table_name, index_name AS name, create_sql, drop_sql FROM si",
        "ddl_pk": f"{base} SELECT table_name, create_sql, drop_sql FROM sk",
        "column_ddl": f"{base} SELECT table_name, column_name, ddl FROM sc",
        "schema_script": f"{base}, {tables}, {every}, {column}, script(rank, table_name, name, sql) AS ({' UNION ALL '.join(parts)}) SELECT CAST(rank AS INTEGER) AS rank, table_name, name, sql FROM script",
    }


def oracles() -> dict[str, str]:
    files = fx.values([(f"/m/{f}",) for f in fx.FILES], ["path"])
    # an own reading of names and versions: cut at the first "__" and at dots, numbers padded as text in lists of equal length
    parsed = f"""SELECT path, version, title, CASE WHEN len(tail) = 2 THEN tail[1] ELSE '' END AS direction, tail[len(tail)] AS ext FROM (
        SELECT path, split_part(base, '__', 1) AS version, split_part(substr(base, strpos(base, '__') + 2), '.', 1) AS title, string_split(substr(base, strpos(base, '__') + 2), '.')[2:] AS tail
        FROM (SELECT path, substr(path, 4) AS base FROM ({files}))
        WHERE strpos(base, '__') > 0) WHERE regexp_full_match(version, '[vV]?[0-9][0-9.]*') AND title <> '' AND len(tail) IN (1, 2) AND tail[len(tail)] IN ('sql', 'json') AND (len(tail) = 1 OR tail[1] IN ('up', 'down'))"""
    key = lambda v: f"array_to_string(list_transform(list_resize(string_split(ltrim(lower({v}), 'v'), '.'), 9, '0'), lambda x: lpad(x, 30, '0')), '.')"
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, diff_type, count(*) AS n FROM ({_join_sql(t)} SELECT diff_type FROM j WHERE diff_type IS NOT NULL) GROUP BY diff_type" for t in ("orders", "customer", "part", "events"))
    changed = "concat_ws(',', " + ", ".join(f"CASE WHEN old_{c} IS DISTINCT FROM new_{c} THEN '{c}' END" for c in fx.CHANGES["orders"][1]) + ")"
    part_cols = ", ".join(fx.CHANGES["part"][1])
    out = {
        "rowdiff_orders": _diff_sql("orders"),
        "rowdiff_orders_added": _one_side_sql("orders", "ADD", "new"),
        "rowdiff_orders_dropped": _one_side_sql("orders", "DROP", "old"),
        "rowdiff_orders_modified": _diff_sql("orders", only="MODIFY"),
        "rowdiff_orders_subset": _diff_sql("orders", ["o_orderstatus", "o_orderpriority"]),
        "rowdiff_conversations_composite": _diff_sql("conversations"),
        "rowdiff_events_null_safe": _diff_sql("events"),
        "rowdiff_customer_identical": "SELECT CAST(0 AS BIGINT) AS changes",
        "rowdiff_summary": counts,
        "rowdiff_apply_verify": "SELECT CAST(0 AS BIGINT) AS surplus, CAST(0 AS BIGINT) AS missing",
        "rowdiff_part_multiset": f"WITH t AS ({fx.changed_sql('part')}), s AS (SELECT {part_cols} FROM part) SELECT 'ADD' AS diff_type, count(*) AS n FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t) UNION ALL SELECT 'DROP', count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s)",
        "rowdiff_orders_changed_columns": f"{_join_sql('orders')} SELECT new_o_orderkey AS o_orderkey, {changed} AS changed FROM j WHERE diff_type = 'MODIFY'",
        "keyset_page_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 1000",
        "keyset_page_composite": "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (20, 1) ORDER BY conv_id, turn LIMIT 1000",
        "schemadiff_tables": f"WITH {fx.catalog_ctes()} SELECT table_name, table_type, 'ADD' AS diff_type FROM s_tables s WHERE NOT EXISTS (SELECT 1 FROM t_tables t WHERE t.table_name = s.table_name AND t.table_type = s.table_type) UNION ALL SELECT table_name, table_type, 'DROP' FROM t_tables t WHERE NOT EXISTS (SELECT 1 FROM s_tables s WHERE t.table_name = s.table_name AND t.table_type = s.table_type)",
        "ordered_key_agg": f"SELECT constraint_name, string_agg(c, ',' ORDER BY o) AS columns FROM ({fx.values(fx.KEY_COLUMNS, ['constraint_name', 'o', 'c'])}) GROUP BY constraint_name",
        "catalog_left_join_comments": f"WITH {fx.raw_ctes()}, i AS (SELECT c.oid, c.name FROM classes_ c, namespaces_ n WHERE n.oid = c.namespace AND n.name = 'public') SELECT f.table_name, f.column_name, f.place, d.text AS comment FROM fields_ f LEFT JOIN i ON i.name = f.table_name LEFT JOIN descriptions_ d ON d.owner = i.oid AND d.place = f.place",
        "catalog_table_comments": f"WITH {fx.raw_ctes()} SELECT c.name AS table_name, (SELECT text FROM descriptions_ WHERE owner = c.oid AND place = 0) AS comment FROM classes_ c WHERE c.namespace IN (SELECT oid FROM namespaces_ WHERE name = 'public')",
        "catalog_pk_join": f"WITH {fx.raw_ctes()} SELECT u.table_name, u.name AS pk_name, u.column_name, u.place FROM usage_ u WHERE EXISTS (SELECT 1 FROM constraints_ c WHERE c.kind = 'PRIMARY KEY' AND c.name = u.name AND c.table_name = u.table_name)",
        "catalog_fk_join": f"WITH {fx.raw_ctes()} SELECT u.table_name, u.name AS fk_name, u.place, u.column_name, r.ref_table, (SELECT column_name FROM usage_ k WHERE k.table_name = r.ref_table AND k.name = r.ref_name AND k.place = u.ref_place) AS ref_column, r.on_delete, r.on_update FROM usage_ u, constraints_ c, references_ r WHERE c.kind = 'FOREIGN KEY' AND (c.table_name, c.name) = (u.table_name, u.name) AND (r.table_name, r.name) = (u.table_name, u.name)",
        "index_any_membership": f"WITH {fx.catalog_ctes()}, u AS (SELECT *, unnest(generate_series(1, len(columns)))::INT AS o FROM s_indexes) SELECT u.table_name, index_name, (o - 1)::INT AS ordinal, u.columns[o] AS column_name, c.data_type FROM u LEFT JOIN s_columns c ON c.table_name = u.table_name AND c.column_name = u.columns[o]",
        "migration_parse": parsed,
        "migration_sort": f"SELECT path, direction, CAST(dense_rank() OVER (ORDER BY {key('version')}) AS INTEGER) AS place FROM ({parsed})",
        "migration_compare": f"WITH p AS ({parsed}) SELECT a.path AS a, b.path AS b, CASE WHEN {key('a.version')} < {key('b.version')} THEN -1 WHEN {key('a.version')} = {key('b.version')} THEN 0 ELSE 1 END AS sign FROM p a JOIN p b ON a.path < b.path",
        "migration_pending": f"SELECT path, version FROM ({parsed}) WHERE {key('version')} > {key(chr(39) + fx.CURRENT + chr(39))} AND {key('version')} <= {key(chr(39) + fx.LIMIT + chr(39))} AND direction <> 'down' AND ext = 'sql'",
        "migration_pending_count": f"SELECT count(*) AS n FROM ({parsed}) WHERE {key('version')} > {key(chr(39) + fx.CURRENT + chr(39))} AND direction IN ('', 'up') AND ext = 'sql'",
        "migration_current": f"SELECT coalesce(max_by(version, id), '') AS version FROM ({fx.values(fx.STATE, ['id', 'version', 'status'])}) WHERE status = 'success'",
        "migration_clean_tx": fx.values([(1, "\ninsert into a values (1);\n"), (2, "start; drop table b;"), (3, "update c set beginning = 1;"), (4, ""), (5, None)], ["id", "sql"], ["INTEGER", "VARCHAR"]),
    }
    for short, d in (("pg", q.POSTGRES), ("mysql", q.MYSQL)):
        for name, what in (("insert", "ADD"), ("delete", "DROP"), ("update", "MODIFY")):
            out[f"dml_{name}_{short}"] = _dml_sql("orders", d, what)
            out[f"dml_{name}_composite_{short}"] = _dml_sql("conversations", d, what)
        out[f"sync_script_{short}"] = _sync_sql(d)
        out[f"literal_escape_{short}"] = f"SELECT doc_id, md5({_literal_sql(d, f'({INJECTED})', False)}) AS md5 FROM documents"
        out[f"type_map_{short}"] = _type_sql(d)
    for kind, name in (("column", "columns"), ("index", "indexes"), ("primary_key", "pk"), ("foreign_key", "fk"), ("view", "views")):
        out[f"schemadiff_{name}"] = _objects_sql(kind)
    at = "'\"' || table_name || '\"'"
    out["ddl_view_pg"] = f"WITH {fx.catalog_ctes()} SELECT table_name, 'CREATE VIEW ' || {at} || ' AS' || chr(10) || select_statement || CASE WHEN check_option <> 'NONE' THEN chr(10) || 'WITH ' || check_option || ' CHECK OPTION' ELSE '' END || ';' AS create_sql, 'DROP VIEW ' || {at} || ';' AS drop_sql FROM s_views"
    tick = lambda s: s.replace('"', "`")
    for short, d in (("pg", q.POSTGRES), ("mysql", q.MYSQL)):
        out |= {f"{k}_{short}": v for k, v in _ddl_sql(d).items()}
    out["ddl_view_mysql"] = tick(out["ddl_view_pg"])
    return out
