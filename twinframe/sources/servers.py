"""Database servers as more than tables to read: statements run from the driver, their version table, and reset."""

from __future__ import annotations

import contextlib
import logging
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .loaders import Connection

log = logging.getLogger(__name__)

TRIES, WAIT = 3, 1.0  # attempts to connect, and seconds between them

# The version table of each kind of server.
VERSIONS = "schema_migrations"
VERSION_TABLE = {
    "postgres": f"CREATE TABLE IF NOT EXISTS {VERSIONS} (id SERIAL PRIMARY KEY, version VARCHAR(255) NOT NULL, title VARCHAR(255), applied_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP, execution_time INTEGER, status VARCHAR(50) DEFAULT 'success')",
    "mysql": f"CREATE TABLE IF NOT EXISTS {VERSIONS} (id INT AUTO_INCREMENT PRIMARY KEY, version VARCHAR(255) NOT NULL, title VARCHAR(255), applied_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP, execution_time INT, status VARCHAR(50) DEFAULT 'success')",
}


class Server:
    """The driver's own connection to a server, opened by Spark's JDBC drivers at first use and kept until close()."""

    def __init__(self, spark: SparkSession, c: Connection):
        if c.type not in VERSION_TABLE:
            raise ValueError(f"{c.type} is no server")
        self.spark, self.c, self._open = spark, c, None

    def connection(self):
        if self._open is None:
            for left in reversed(range(TRIES)):
                try:
                    self._open = self._connect()
                    break
                except Exception as e:
                    if not left:
                        raise
                    log.warning("no connection to %s yet: %s", self.c.host, type(e).__name__)
                    time.sleep(WAIT)
        return self._open

    def _connect(self):
        # a file of migrations holds many statements, which MySQL's driver takes only when told so
        c = replace(self.c, extra={"allowMultiQueries": "true", **self.c.extra}) if self.c.type == "mysql" else self.c
        options, jvm = c.jdbc(), self.spark._jvm
        values = jvm.org.apache.spark.api.python.PythonUtils.toScalaMap(options)
        jdbc = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(options["url"], VERSIONS, values)
        return jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).createConnectionFactory(jdbc).apply(-1)

    def execute(self, sql: str, *values) -> None:
        with contextlib.closing(self.connection().prepareStatement(sql) if values else self.connection().createStatement()) as s:
            for place, value in enumerate(values, 1):
                s.setObject(place, value)
            s.execute() if values else s.execute(sql)

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.c.jdbc()).option("query", sql).load()

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
            self._open = None


class ServerVersionLog:
    """The version table on a server; the same calls as operators.migrate.VersionLog."""

    COLUMNS = ("id", "version", "title", "applied_at", "execution_time", "status")

    def __init__(self, server: Server):
        self.server = server

    def ensure(self) -> None:
        self.server.execute(VERSION_TABLE[self.server.c.type])

    def rows(self) -> DataFrame:
        return self.server.query(f"SELECT {', '.join(self.COLUMNS)} FROM {VERSIONS}").toDF(*self.COLUMNS)

    def append(self, version: str, title: str, milliseconds: int, status: str) -> tuple:
        self.server.execute(f"INSERT INTO {VERSIONS} (version, title, execution_time, status) VALUES (?, ?, ?, ?)", version, title, milliseconds, status)
        return tuple(self.rows().orderBy(F.desc("id")).first())


def reset_statements(c: Connection) -> list[str]:
    """What empties a server: its database in MySQL, its schema in PostgreSQL."""
    if c.type == "mysql":
        name = "`" + c.dbname.replace("`", "``") + "`"
        return [f"DROP DATABASE IF EXISTS {name}", f"CREATE DATABASE {name}"]
    if c.type == "postgres":
        name = '"' + c.schema.replace('"', '""') + '"'
        return [f"DROP SCHEMA {name} CASCADE", f"CREATE SCHEMA {name}"]
    raise ValueError(f"{c.type} can't be reset")


def reset(server: Server, confirm: bool = False) -> None:
    """Empties a server; nothing happens without `confirm`."""
    if not confirm:
        raise PermissionError(f"resetting {server.c.schema} deletes its tables: confirm it")
    for sql in reset_statements(server.c):
        server.execute(sql)
