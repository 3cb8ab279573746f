"""SQL text for MySQL and PostgreSQL, built as Spark expressions: identifiers, literals, types, DML and DDL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type spellings by dialect, and the spelling that DDL uses.
POSTGRES_TYPES = {
    "text": "text", "integer": "int4", "int": "int4", "int4": "int4", "bigint": "int8", "int8": "int8", "smallint": "int2", "int2": "int2",
    "real": "real", "float4": "real", "double precision": "double precision", "float8": "double precision", "money": "money",
    "serial": "serial", "bigserial": "bigserial", "smallserial": "smallserial", "boolean": "boolean", "bool": "boolean",
    "timestamp": "timestamp", "timestamp without time zone": "timestamp", "timestamptz": "timestamp with time zone", "timestamp with time zone": "timestamp with time zone",
    "date": "date", "time": "time", "time without time zone": "time", "timetz": "time with time zone", "time with time zone": "time with time zone",
    "interval": "interval", "bytea": "bytea", "uuid": "uuid", "json": "json", "jsonb": "jsonb", "inet": "inet", "cidr": "cidr", "macaddr": "macaddr",
    "point": "point", "line": "line", "lseg": "lseg", "box": "box", "path": "path", "polygon": "polygon", "circle": "circle",
}
POSTGRES_LENGTH = {"character varying": ("varchar", "varchar"), "varchar": ("varchar", "varchar"), "character": ("char", "char(1)"), "char": ("char", "char(1)")}
POSTGRES_DECIMAL = {"numeric": ("numeric", "numeric"), "decimal": ("numeric", "numeric")}
MYSQL_TYPES = {
    "text": "text", "tinytext": "tinytext", "mediumtext": "mediumtext", "longtext": "longtext", "int": "int", "integer": "int", "bigint": "bigint",
    "smallint": "smallint", "tinyint": "tinyint", "mediumint": "mediumint", "serial": "bigint unsigned NOT NULL AUTO_INCREMENT", "boolean": "tinyint(1)", "bool": "tinyint(1)",
    "datetime": "datetime", "timestamp": "timestamp", "date": "date", "time": "time", "year": "year", "blob": "blob", "tinyblob": "tinyblob", "mediumblob": "mediumblob", "longblob": "longblob",
    "json": "json", "enum": "enum", "set": "set", "geometry": "geometry", "point": "point", "linestring": "linestring", "polygon": "polygon",
    "multipoint": "multipoint", "multilinestring": "multilinestring", "multipolygon": "multipolygon", "geometrycollection": "geometrycollection",
}
MYSQL_LENGTH = {"varchar": ("varchar", "varchar(255)"), "char": ("char", "char(1)"), "binary": ("binary", "binary(1)"), "varbinary": ("varbinary", "varbinary(255)")}
MYSQL_DECIMAL = {"decimal": ("decimal", "decimal(10,0)"), "numeric": ("decimal", "decimal(10,0)")}
MYSQL_FLOAT = {"float": "float", "double": "double", "real": "double"}


@dataclass(frozen=True)
class Dialect:
    name: str
    quote: str
    plain: dict
    length: dict
    decimal: dict
    floating: dict

    @property
    def postgres(self) -> bool:
        return self.name == "postgres"


POSTGRES = Dialect("postgres", '"', POSTGRES_TYPES, POSTGRES_LENGTH, POSTGRES_DECIMAL, {})
MYSQL = Dialect("mysql", "`", MYSQL_TYPES, MYSQL_LENGTH, MYSQL_DECIMAL, MYSQL_FLOAT)


def dialect(name: str) -> Dialect:
    """The dialect of that name; an unknown one is an error."""
    found = {"postgres": POSTGRES, "postgresql": POSTGRES, "mysql": MYSQL}.get(name)
    if found is None:
        raise ValueError(f"unsupported database type: {name}")
    return found


def _text(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def cat(*parts) -> Column:
    return F.concat(*[_text(p) for p in parts])


def ident(d: Dialect, name) -> Column:
    return cat(d.quote, F.replace(_text(name), F.lit(d.quote), F.lit(d.quote * 2)), d.quote)


def join_wrap(items: Column, wrap: str, sep: str) -> Column:
    return join_affixed(items, wrap, wrap, sep)


def join_affixed(items: Column, before: str, after: str, sep: str) -> Column:
    return F.array_join(F.transform(items, lambda x: cat(before, x, after)), sep)


def ident_list(d: Dialect, names: Column) -> Column:
    return F.array_join(F.transform(names, lambda x: ident(d, x)), ", ")


def table_ident(d: Dialect, schema, table) -> Column:
    """Qualified in PostgreSQL unless the schema is public or empty."""
    if not d.postgres:
        return ident(d, table)
    s = _text(schema)
    return cat(F.when(F.coalesce(s, F.lit("")).isin("", "public"), "").otherwise(cat(ident(d, s), ".")), ident(d, table))


# ---- literals ----

_ESCAPES = [("\\", "\\\\"), ("'", "''"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]


def escape(d: Dialect, value: Column, legacy: bool = False) -> Column:
    """MySQL: backslash, quote and control characters. PostgreSQL: quotes are doubled and no more (a backslash is an
    ordinary character there), unless `legacy`."""
    for a, b in _ESCAPES if not d.postgres or legacy else _ESCAPES[1:2]:
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def literal(d: Dialect, value: Column, kind: str, legacy: bool = False) -> Column:
    """A SQL literal of a column of Spark type `kind`: numbers and booleans bare, binary as hex, all else quoted. NaN and
    the infinities are quoted in PostgreSQL, and NULL in MySQL, which has none."""
    if kind in ("float", "double"):  # not every value is a number: quoted for PostgreSQL, none in MySQL
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        out = F.when(odd, cat("'", value.cast("string"), "'") if d.postgres else F.lit("NULL")).otherwise(value.cast("string"))
    elif kind in ("tinyint", "smallint", "int", "bigint", "boolean") or kind.startswith("decimal"):
        out = value.cast("string")
    elif kind == "binary":
        out = cat("'\\x", F.lower(F.hex(value)), "'") if d.postgres else cat("0x", F.hex(value))
    else:
        text = F.to_json(value) if kind.startswith(("array", "map", "struct")) else value.cast("string")
        out = cat("'", escape(d, text, legacy), "'")
    return F.coalesce(out, F.lit("NULL"))


# ---- DML ----


def _where(d: Dialect, row: str, key: list[str], kinds: dict[str, str], legacy: bool) -> Column:
    parts = []
    for k in key:
        v = F.col(f"{row}.{k}")
        parts.append(cat(ident(d, k), F.when(v.isNull(), " IS NULL").otherwise(cat(" = ", literal(d, v, kinds[k], legacy)))))
    return F.concat_ws(" AND ", *parts)


def insert(d: Dialect, table: str, row: str, columns: list[str], kinds: dict[str, str], schema: str = "public", legacy: bool = False) -> Column:
    names = ", ".join(f"{d.quote}{c}{d.quote}" for c in columns)
    return cat("INSERT INTO ", table_ident(d, schema, table), f" ({names}) VALUES (", F.concat_ws(", ", *[literal(d, F.col(f"{row}.{c}"), kinds[c], legacy) for c in columns]), ");")


def delete(d: Dialect, table: str, row: str, key: list[str], kinds: dict[str, str], schema: str = "public", legacy: bool = False) -> Column:
    return cat("DELETE FROM ", table_ident(d, schema, table), " WHERE ", _where(d, row, key, kinds, legacy), ";")


def update(d: Dialect, table: str, row: str, columns: list[str], key: list[str], kinds: dict[str, str], schema: str = "public", legacy: bool = False) -> Column:
    changed = [c for c in columns if c not in key]
    if not changed:
        raise ValueError("nothing to set: every compared column is part of the key")
    sets = F.concat_ws(", ", *[cat(ident(d, c), " = ", literal(d, F.col(f"{row}.{c}"), kinds[c], legacy)) for c in changed])
    return cat("UPDATE ", table_ident(d, schema, table), " SET ", sets, " WHERE ", _where(d, row, key, kinds, legacy), ";")


# ---- types and columns ----


def type_ddl(d: Dialect, data_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    """The DDL spelling of a type; unknown ones stay as they are. MySQL's unsigned and zerofill follow the spelling."""
    signs = "( unsigned| zerofill)+$"
    low, out = F.regexp_replace(F.lower(data_type), signs, ""), None

    def case(name: str, value) -> None:
        nonlocal out
        out = F.when(low == name, value) if out is None else out.when(low == name, value)

    for name, to in d.plain.items():
        case(name, F.lit(to))
    for name, (to, bare) in d.length.items():
        case(name, F.when(length > 0, cat(f"{to}(", length.cast("string"), ")")).otherwise(bare))
    both = precision.isNotNull() & scale.isNotNull()
    for name, (to, bare) in d.decimal.items():
        case(name, F.when(both, cat(f"{to}(", precision.cast("string"), ",", scale.cast("string"), ")")).when(precision.isNotNull(), cat(f"{to}(", precision.cast("string"), ")")).otherwise(bare))
    for name, to in d.floating.items():
        case(name, F.when(both, cat(f"{to}(", precision.cast("string"), ",", scale.cast("string"), ")")).otherwise(to))
    return out.otherwise(data_type) if d.postgres else F.concat(out.otherwise(F.regexp_replace(data_type, f"(?i){signs}", "")), F.regexp_extract(F.lower(data_type), signs, 0))


def column_default(d: Dialect, c: str) -> Column:
    """The default as DDL has it. MySQL's catalog gives a string's default without quotes, and marks expressions."""
    f = lambda n: F.col(f"{c}.{n}")
    if d.postgres:
        return f("default_expr")
    texts = F.lower(f("data_type")).rlike("char|text|enum|set|date|time|year|json|binary|blob")
    ready = f("default_expr").rlike(r"(?i)^('.*'|null|current_timestamp(\([0-9]*\))?.*|\(.*\))$") | F.lower(F.coalesce(f("extra"), F.lit(""))).contains("default_generated")
    return F.when(texts & ~ready, cat("'", escape(d, f("default_expr")), "'")).otherwise(f("default_expr"))


def column_type(d: Dialect, c: str) -> Column:
    """The type of a column struct `c` (fields as in the columns catalog). MySQL value lists come from `extra`."""
    f = lambda n: F.col(f"{c}.{n}")
    made = type_ddl(d, f("data_type"), f("char_max_len"), f("numeric_prec"), f("numeric_scale"))
    if d.postgres:
        return made
    listed = F.lower(f("data_type")).isin("enum", "set") & f("extra").startswith(cat(F.lower(f("data_type")), "("))
    return F.when(listed, f("extra")).otherwise(made)


def column_ddl(d: Dialect, c: str) -> Column:
    f = lambda n: F.col(f"{c}.{n}")
    parts = [ident(d, f("column_name")), column_type(d, c), F.when(~f("nullable"), "NOT NULL"), F.when(f("default_expr") != "", cat("DEFAULT ", column_default(d, c)))]
    if not d.postgres:
        extra = F.trim(F.regexp_replace(F.lower(F.coalesce(f("extra"), F.lit(""))), "default_generated", ""))
        parts.append(F.when(extra.contains("auto_increment"), "AUTO_INCREMENT").when((extra != "") & ~extra.startswith("enum(") & ~extra.startswith("set("), F.trim(F.regexp_replace(f("extra"), "(?i)default_generated", ""))))
        parts.append(F.when(f("comment") != "", cat("COMMENT '", escape(d, f("comment")), "'")))
    return F.concat_ws(" ", *parts)


def alter_column(d: Dialect, table: Column, old: str, new: str) -> Column:
    if not d.postgres:
        return cat("ALTER TABLE ", table, " MODIFY COLUMN ", column_ddl(d, new), ";")
    o, n = (lambda x: F.col(f"{old}.{x}")), (lambda x: F.col(f"{new}.{x}"))
    to, name = column_type(d, new), ident(d, n("column_name"))
    at = cat("ALTER TABLE ", table, " ALTER COLUMN ", name)
    using = F.when(to.isin("int2", "int4", "int8", "json", "jsonb"), cat(" USING ", name, "::", to)).otherwise("")
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.concat_ws(
        " ",
        F.when(o("column_name") != n("column_name"), cat("ALTER TABLE ", table, " RENAME COLUMN ", ident(d, o("column_name")), " TO ", name, ";")),
        F.when(column_type(d, old) != to, cat(at, " TYPE ", to, using, ";")),
        F.when(has(n("default_expr")) & ~n("default_expr").eqNullSafe(o("default_expr")), cat(at, " SET DEFAULT ", n("default_expr"), ";")).when(~has(n("default_expr")) & has(o("default_expr")), cat(at, " DROP DEFAULT;")),
        F.when(o("nullable") != n("nullable"), cat(at, F.when(n("nullable"), " DROP NOT NULL;").otherwise(" SET NOT NULL;"))),
        F.when(~o("comment").eqNullSafe(n("comment")), cat("COMMENT ON COLUMN ", table, ".", name, " IS ", F.coalesce(cat("'", escape(d, n("comment")), "'"), F.lit("NULL")), ";")),
    )


# ---- other DDL; `table` is what table_ident gives ----


def create_index(d: Dialect, table: Column, i: str) -> Column:
    f = lambda n: F.col(f"{i}.{n}")
    method = F.when(~F.coalesce(f("method"), F.lit("")).isin("", "btree"), cat(" USING ", f("method"))).otherwise("") if d.postgres else F.lit("")
    made = cat("CREATE ", F.when(f("is_unique"), "UNIQUE ").otherwise(""), "INDEX ", ident(d, f("index_name")), " ON ", table, method, " (", F.coalesce(f("expression"), ident_list(d, f("columns"))), ")", F.coalesce(cat(" WHERE ", f("where_expr")), F.lit("")), ";")
    if d.postgres:
        return F.when(~F.coalesce(f("is_primary"), F.lit(False)), made).otherwise("")
    return F.when(F.coalesce(f("is_primary"), F.lit(False)), cat("ALTER TABLE ", table, " ADD PRIMARY KEY (", ident_list(d, f("columns")), ");")).otherwise(made)


def drop_index(d: Dialect, schema, table: Column, name: Column) -> Column:
    return cat("DROP INDEX ", table_ident(d, schema, name), ";") if d.postgres else cat("DROP INDEX ", ident(d, name), " ON ", table, ";")


def add_primary_key(d: Dialect, table: Column, k: str) -> Column:
    return cat("ALTER TABLE ", table, " ADD CONSTRAINT ", ident(d, F.col(f"{k}.pk_name")), " PRIMARY KEY (", ident_list(d, F.col(f"{k}.columns")), ");")


def drop_primary_key(d: Dialect, table: Column, k: str) -> Column:
    return cat("ALTER TABLE ", table, " DROP CONSTRAINT ", ident(d, F.col(f"{k}.pk_name")), ";") if d.postgres else cat("ALTER TABLE ", table, " DROP PRIMARY KEY;")


def foreign_key_ddl(d: Dialect, k: str) -> Column:
    f = lambda n: F.col(f"{k}.{n}")
    to = table_ident(d, f("ref_schema"), f("ref_table"))
    on = lambda what, n: F.when(F.coalesce(f(n), F.lit("")) != "", cat(f" ON {what} ", f(n))).otherwise("")
    return cat("CONSTRAINT ", ident(d, f("fk_name")), " FOREIGN KEY (", ident_list(d, f("columns")), ") REFERENCES ", to, " (", ident_list(d, f("ref_columns")), ")", on("DELETE", "on_delete"), on("UPDATE", "on_update"))


def create_view(d: Dialect, table: Column, v: str) -> Column:
    f = lambda n: F.col(f"{v}.{n}")
    check = F.when(~F.coalesce(f("check_option"), F.lit("")).isin("", "NONE"), cat("\nWITH ", f("check_option"), " CHECK OPTION")).otherwise("")
    return cat("CREATE VIEW ", table, " AS\n", f("select_statement"), check, ";")


def simple(verb: str, table: Column) -> Column:
    """DROP TABLE / DROP VIEW."""
    return cat(f"{verb} ", table, ";")
