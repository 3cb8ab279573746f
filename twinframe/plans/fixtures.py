"""Deterministic changes to the test tables, and two small catalogs that differ in every way a catalog can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalogs import SCHEMAS, Catalog, from_rows

# table: (key, columns, kept rows, changed columns, shifted rows: shift of a key column, condition)
CHANGES = {
    "orders": (["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "o_orderkey % 10 <> 0", {"o_totalprice": "CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END", "o_orderpriority": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"}, ("o_orderkey", 1000000000, "o_orderkey % 13 = 0")),
    "customer": (["c_custkey"], ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey % 9 <> 0", {"c_acctbal": "CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 0.5 ELSE c_acctbal END", "c_mktsegment": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END"}, ("c_custkey", 1000000000, "c_custkey % 19 = 0")),
    "part": (["p_partkey"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "p_partkey % 20 <> 0", {"p_size": "CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END"}, ("p_partkey", 1000000000, "p_partkey % 23 = 0")),
    "events": (["event_id"], ["event_id", "ts", "user_id", "event_type", "value", "props"], "event_id % 12 <> 0", {"value": "CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END", "event_type": "CASE WHEN event_id % 15 = 0 THEN 'edited' ELSE event_type END"}, ("event_id", 1000000000, "event_id % 29 = 0")),
    "conversations": (["conv_id", "turn"], ["conv_id", "turn", "role", "text"], "(conv_id + turn) % 10 <> 0", {"text": "CASE WHEN conv_id % 4 = 0 THEN text || ' (edited)' ELSE text END"}, ("turn", 1000, "conv_id % 6 = 0")),
}


def changed_sql(table: str, source: str | None = None) -> str:
    """The target of a table, as SQL that Spark and DuckDB both read."""
    _, columns, kept, changes, (shifted, by, where) = CHANGES[table]
    source = source or table
    first = ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in columns)
    second = ", ".join(f"{c} + {by} AS {c}" if c == shifted else c for c in columns)
    return f"SELECT {first} FROM {source} WHERE {kept} UNION ALL SELECT {second} FROM {source} WHERE {where}"


def changed(spark: SparkSession, table: str, df: DataFrame) -> DataFrame:
    return spark.sql(changed_sql(table, "{src}"), src=df)


def _col(table, name, kind, nullable=True, default=None, extra="", comment=None, length=None, prec=None, scale=None, pos=1):
    return (table, name, kind, nullable, default, extra, comment, length, prec, scale, pos)


_SAME = [_col("same", "id", "bigint", False, pos=1), _col("nopk", "id", "bigint", False, pos=1)]
SOURCE = {
    "tables": [(t, "TABLE", "public", None) for t in ("only_src", "acct", "nopk", "same", "kind")] + [(v, "VIEW", "public", None) for v in ("v1", "v2")],
    "columns": [
        _col("only_src", "id", "bigint", False),
        _col("only_src", "label", "varchar", True, "'none'", length=20, comment="a label", pos=2),
        _col("acct", "id", "integer", False, pos=1),
        _col("acct", "sub", "integer", False, pos=2),
        _col("acct", "email", "varchar", length=100, pos=3),
        _col("acct", "name", "varchar", False, "'x'", length=80, pos=4),
        _col("acct", "balance", "numeric", prec=18, scale=4, pos=5),
        _col("acct", "note", "text", comment="line1\nline2", pos=6),
        _col("acct", "pos", "integer", pos=7),
        _col("acct", "memo", "text", pos=8),
        _col("kind", "id", "integer"),
        *_SAME,
    ],
    "indexes": [
        ("acct", "ix_a", ["a", "b"], False, False, "btree", None, None),
        ("acct", "ix_p", ["a"], False, False, "btree", "a > 0", None),
        ("acct", "ix_u", ["email"], True, False, "btree", None, None),
        ("acct", "ix_h", ["note"], False, False, "hash", None, None),
        ("acct", "ix_x", ["lower(name)"], False, False, "btree", None, "(lower(name))"),
    ],
    "primary_keys": [("acct", "acct_pk", ["id", "sub"]), ("only_src", "only_src_pk", ["id"]), ("same", "same_pk", ["id"])],
    "foreign_keys": [
        ("acct", "fk_org", ["org_id"], "public", "org", ["id"], "CASCADE", "NO ACTION"),
        ("acct", "fk_new", ["a", "b"], "public", "pair", ["x", "y"], "", ""),
        ("only_src", "fk_acct", ["id"], "public", "acct", ["id"], "CASCADE", ""),
    ],
    "views": [("v1", "SELECT 1", False, "NONE", ""), ("v2", "SELECT 3", True, "LOCAL", "")],
}
TARGET = {
    "tables": [(t, "TABLE", "public", None) for t in ("only_tgt", "acct", "nopk", "same")] + [(v, "VIEW", "public", None) for v in ("v1", "v2", "kind")],
    "columns": [
        _col("only_tgt", "id", "bigint"),
        _col("acct", "id", "integer", False, pos=1),
        _col("acct", "sub", "integer", False, pos=2),
        _col("acct", "legacy", "text", pos=3),
        _col("acct", "name", "varchar", length=50, pos=4),
        _col("acct", "balance", "numeric", prec=18, scale=2, pos=5),
        _col("acct", "note", "text", comment="line1line2", pos=6),
        _col("acct", "memo", "text", comment="", pos=7),
        _col("acct", "pos", "integer", pos=9),
        *_SAME,
    ],
    "indexes": [
        ("acct", "ix_a", ["b", "a"], False, False, "btree", None, None),
        ("acct", "ix_p", ["a"], False, False, "btree", None, None),
        ("acct", "ix_old", ["legacy"], False, False, "btree", None, None),
        ("acct", "ix_h", ["note"], False, False, "hash", None, None),
    ],
    "primary_keys": [("acct", "acct_pkey", ["id", "sub"]), ("nopk", "nopk_pk", ["id"]), ("same", "same_pk", ["id"])],
    "foreign_keys": [("acct", "fk_org", ["org_id"], "public", "org", ["id"], "NO ACTION", "NO ACTION"), ("acct", "fk_old", ["c"], "public", "old", ["id"], "", "")],
    "views": [("v1", "SELECT 2", False, "NONE", ""), ("v2", "SELECT 3", True, "NONE", ""), ("kind", "SELECT 4", False, "NONE", "")],
}
KEY_COLUMNS = [("pk_x", 2, "b"), ("pk_x", 1, "a"), ("pk_y", 1, "c")]
# One file name for each case of the grammar and the order: versions with and without a letter, of one to seven parts,
# with leading zeros, as time stamps; directions; names that do not fit.
FILES = [
    "v3__accounts.sql", "V3.1__add_phone.up.sql", "v3.1__add_phone.down.sql", "3.1.0__equal_to_3_1.sql", "v3.10__late.sql", "v3.2__early.sql",
    "v20240101120000__stamp_a.sql", "v20240201120000__stamp_b.sql", "v3.2.0.0.0.0.7__deep.sql", "v3.2.0.0.0.0.8__deeper.sql", "v007__zeros.sql", "v0__zero.sql",
    "v3.3__rows.json", "4.0__last.up.json", "4.0__last.down.sql", "v4__.sql", "v4__two.parts.sql", "v4__notes.txt", "__no_version.sql", "vv5__letters.sql", "v5_one_line.sql", "readme.sql",
]
CURRENT, LIMIT = "v3.2", "v20240101120000"
SCRIPTS = [(1, "Begin ;\ninsert into a values (1);\nCOMMIT;"), (2, "start; BEGIN  TRANSACTION;drop table b;commit transaction ;"), (3, "update c set beginning = 1;"), (4, ""), (5, None)]
STATE = [(1, "v3", "success"), (2, "v3.2", "success"), (3, "v9", "failed")]
# Raw rows of a server's catalog, for the joins that put a catalog together.
RAW = {
    "constraints": (["table_name", "name", "kind"], [("acct", "pk_acct", "PRIMARY KEY"), ("org", "pk_org", "PRIMARY KEY"), ("acct", "to_org", "FOREIGN KEY"), ("acct", "uq", "UNIQUE"), ("pair", "to_org", "FOREIGN KEY")]),
    "usage": (["table_name", "name", "column_name", "place:int", "ref_place:int"], [("acct", "pk_acct", "sub", 2, None), ("acct", "pk_acct", "id", 1, None), ("org", "pk_org", "a", 1, None), ("org", "pk_org", "b", 2, None), ("acct", "to_org", "oa", 1, 1), ("acct", "to_org", "ob", 2, 2), ("pair", "to_org", "x", 1, 2), ("pair", "to_org", "y", 2, 1), ("acct", "uq", "mail", 1, None)]),
    "references": (["table_name", "name", "ref_table", "ref_name", "on_delete", "on_update"], [("acct", "to_org", "org", "pk_org", "CASCADE", "NO ACTION"), ("pair", "to_org", "org", "pk_org", "RESTRICT", "CASCADE")]),
    "classes": (["oid:int", "namespace:int", "name"], [(11, 1, "acct"), (12, 1, "org"), (13, 2, "acct"), (14, 1, "pair")]),
    "namespaces": (["oid:int", "name"], [(1, "public"), (2, "other")]),
    "fields": (["table_name", "column_name", "place:int"], [("acct", "id", 1), ("acct", "sub", 2), ("org", "a", 1), ("gone", "z", 1)]),
    "descriptions": (["owner:int", "place:int", "text"], [(11, 0, "accounts"), (11, 2, "part of the key"), (12, 1, "first"), (13, 1, "not this schema")]),
}


def raw(spark: SparkSession) -> dict[str, DataFrame]:
    return {k: spark.createDataFrame(rows, ", ".join(f"{n} {t or 'string'}" for n, _, t in (c.partition(":") for c in names))) for k, (names, rows) in RAW.items()}


def raw_ctes() -> str:
    return ", ".join(f"{k}_ AS ({values(rows, [c.partition(':')[0] for c in names], ['INTEGER' if ':' in c else 'VARCHAR' for c in names])})" for k, (names, rows) in RAW.items())


def catalogs(spark: SparkSession) -> tuple[Catalog, Catalog]:
    return from_rows(spark, **SOURCE), from_rows(spark, **TARGET)


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return f"[{', '.join(map(_sql, v))}]"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], names: list[str], kinds: list[str] | None = None) -> str:
    """A SELECT over VALUES, for the oracle."""
    kinds = kinds or [""] * len(names)
    cols = ", ".join(f"CAST({n} AS {k}) AS {n}" if k else n for n, k in zip(names, kinds))
    return f"SELECT {cols} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({', '.join(names)})"


def catalog_ctes() -> str:
    """s_tables, t_tables, s_columns, ... as common table expressions."""
    kind = {"string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "array<string>": "VARCHAR[]"}
    out = []
    for side, rows in (("s", SOURCE), ("t", TARGET)):
        for name, schema in SCHEMAS.items():
            pairs = [c.strip().split(" ", 1) for c in schema.split(", ")]
            out.append(f"{side}_{name} AS ({values(rows[name], [p[0] for p in pairs], [kind[p[1]] for p in pairs])})")
    return ", ".join(out)
