"""Where snapshots come from: Parquet folders, JDBC databases, or DataFrames at hand; settings from YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Connection:
    """type: mysql, postgres or parquet (then dbname is the folder)."""

    type: str
    host: str = ""
    port: int = 0
    user: str = ""
    password: str = field(default="", repr=False)
    dbname: str = ""
    tableSchema: str = ""
    ssl: bool = False
    extra: dict = field(default_factory=dict)
    proxy: object = None

    def __post_init__(self) -> None:
        if self.type not in ("mysql", "postgres", "parquet"):
            raise ValueError(f"unsupported database type: {self.type}")
        if self.proxy:
            raise ValueError("tunnels are not opened here: give the host and port of one that is open")
        self.extra = dict(self.extra or {})

    @property
    def schema(self) -> str:
        return self.dbname if self.type == "mysql" else self.tableSchema or "public"

    def contains_extra(self, name: str) -> bool:
        return name in self.extra

    def get_extra(self, name: str, default=None):
        return self.extra.get(name, default)

    def set_extra(self, name: str, value) -> None:
        self.extra[name] = value

    def remove_extra(self, name: str) -> None:
        self.extra.pop(name, None)

    def jdbc(self, batch_size: int = 1000) -> dict[str, str]:
        if self.type == "mysql":
            params = {"characterEncoding": "utf8", **self.extra} | ({"useSSL": "true"} if self.ssl else {})
            url = f"jdbc:mysql://{self.host}:{self.port}/{self.dbname}"
        else:
            params = {**self.extra} | ({} if self.ssl else {"sslmode": "disable"})
            url = f"jdbc:postgresql://{self.host}:{self.port}/{self.dbname}"
        query = "&".join(f"{k}={v}" for k, v in sorted(params.items()))
        return {"url": f"{url}?{query}" if query else url, "user": self.user, "password": self.password, "fetchsize": str(batch_size)}


@dataclass(frozen=True)
class Rule:
    """comparisonKey: the columns that are compared; key: an explicit key for tables without one (an extension)."""

    table: str
    comparisonKey: tuple[str, ...] = ()
    key: tuple[str, ...] = ()


def _parse(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def load_config(path: str) -> dict[str, Connection]:
    """source and target connections; the names sourceDb and source_db both do."""
    raw = _parse(path)
    out = {}
    for side in ("source", "target"):
        found = raw.get(f"{side}Db") or raw.get(f"{side}_db")
        if found:
            out[side] = Connection(**found)
    return out


def load_rules(path: str) -> list[Rule]:
    return [Rule(r["table"], tuple(r.get("comparisonKey") or ()), tuple(r.get("key") or ())) for r in _parse(path)["rules"]]


def _name(c: Connection, table: str) -> str:
    quote = '"' if c.type == "postgres" else "`"
    own = lambda x: quote + x.replace(quote, quote * 2) + quote
    return own(table) if c.type == "mysql" or c.schema == "public" else f"{own(c.schema)}.{own(table)}"


def key_bounds(spark: SparkSession, c: Connection, table: str, key: str) -> tuple[int, int] | None:
    """The smallest and the largest key of a server's table; None if the keys are no integers, or there are none."""
    quote = '"' if c.type == "postgres" else "`"
    k = quote + key.replace(quote, quote * 2) + quote
    row = spark.read.format("jdbc").options(**c.jdbc()).option("query", f"SELECT min({k}) AS low, max({k}) AS high FROM {_name(c, table)}").load().first()
    return tuple(row) if all(isinstance(x, int) for x in row) else None


def read_table(spark: SparkSession, c: Connection, table: str, columns: list[str] | None = None, key: str | None = None, bounds: tuple | None = None, partitions: int = 8, batch_size: int = 1000) -> DataFrame:
    """A table of a connection. With a key a JDBC read is split into `partitions` ranges of it, between `bounds` or, if
    none are given, between the bounds that the server tells; a key of other than integers gives one range."""
    if c.type == "parquet":
        df = spark.read.parquet(f"{c.dbname}/{table}.parquet")
    else:
        reader = spark.read.format("jdbc").options(**c.jdbc(batch_size)).option("dbtable", _name(c, table))
        bounds = bounds or (key_bounds(spark, c, table, key) if key else None)
        if key and bounds:
            reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
        df = reader.load()
    return df.select(*columns) if columns else df
