"""The JDBC paths, against the database that Spark brings along, and the commands."""

import json
import re

import pytest

from twinframe import cli
from twinframe.operators import migrate
from twinframe.sources import loaders, servers


class Embedded(loaders.Connection):
    def jdbc(self, batch_size=1000):
        return {"url": f"jdbc:derby:memory:{self.dbname};create=true", "user": "app", "password": "x", "fetchsize": str(batch_size), "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


class EmbeddedLog(servers.ServerVersionLog):
    def ensure(self):
        if self.server.query("SELECT tablename FROM sys.systables WHERE tablename = 'SCHEMA_MIGRATIONS'").isEmpty():
            self.server.execute(re.sub("IF NOT EXISTS |SERIAL", lambda m: "INT GENERATED ALWAYS AS IDENTITY" if m[0] == "SERIAL" else "", servers.VERSION_TABLE["postgres"]))


@pytest.fixture
def server(spark):
    s = servers.Server(spark, Embedded("postgres", dbname="own"))
    yield s
    s.close()


def test_tables_are_read_by_ranges(spark, server):
    server.execute('CREATE TABLE "fruit ""x" ("id" BIGINT, "name" VARCHAR(9))')
    for k in range(20):
        server.execute('INSERT INTO "fruit ""x" VALUES (?, ?)', k * 7, f"n{k}")
    assert loaders.key_bounds(spark, server.c, 'fruit "x', "id") == (0, 133)
    assert loaders.key_bounds(spark, server.c, 'fruit "x', "name") is None
    got = loaders.read_table(spark, server.c, 'fruit "x', key="id", partitions=4)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == [(k * 7, f"n{k}") for k in range(20)]
    whole = loaders.read_table(spark, server.c, 'fruit "x', ["name"], key="name")
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == 20
    server.execute('DELETE FROM "fruit ""x"')
    assert loaders.key_bounds(spark, server.c, 'fruit "x', "id") is None


def test_versions_on_a_server(spark, server, tmp_path):
    for name, sql in {"v1__a.sql": "CREATE TABLE made (x INT)", "v2__b.sql": "INSERT INTO made VALUES (5)", "v3__c.sql": "no sql", "v4__d.sql": "INSERT INTO made VALUES (6)"}.items():
        (tmp_path / name).write_text(sql)
    files, versions = migrate.read_files(spark, str(tmp_path)), EmbeddedLog(server)
    assert [(r[0], r[1], r[5]) for r in migrate.apply(files, versions, server.execute)] == [(1, "v1", "success"), (2, "v2", "success"), (3, "v3", "failed")]
    assert [r[0] for r in server.query("SELECT x FROM made").collect()] == [5]
    (tmp_path / "v3__c.sql").write_text("INSERT INTO made VALUES (7)")
    migrate.apply(migrate.read_files(spark, str(tmp_path)), versions, server.execute, "v3")
    assert sorted(r[0] for r in server.query("SELECT x FROM made").collect()) == [5, 7]
    assert migrate.current_version(versions.rows()).first()[0] == "v3"


def test_connecting_is_tried_again(spark, monkeypatch):
    tried = []

    class Late(servers.Server):
        def _connect(self):
            tried.append(1)
            if len(tried) < 3:
                raise OSError("not yet")
            return super()._connect()

    monkeypatch.setattr(servers, "WAIT", 0)
    late = Late(spark, Embedded("postgres", dbname="own"))
    late.execute("VALUES 1")
    assert len(tried) == 3
    late.close()
    tried.clear()
    monkeypatch.setattr(servers, "TRIES", 2)
    with pytest.raises(OSError):
        Late(spark, Embedded("postgres", dbname="own")).connection()
    with pytest.raises(ValueError):
        servers.Server(spark, loaders.Connection("parquet"))


def test_reset_statements():
    assert servers.reset_statements(loaders.Connection("mysql", dbname="a`b")) == ["DROP DATABASE IF EXISTS `a``b`", "CREATE DATABASE `a``b`"]
    assert servers.reset_statements(loaders.Connection("postgres", dbname="a")) == ['DROP SCHEMA "public" CASCADE', 'CREATE SCHEMA "public"']


def test_commands(spark, tmp_path, capsys):
    sides = {"a": [(1, "x"), (2, "y")], "b": [(1, "x"), (2, "Y"), (3, "w")]}
    for side, rows in sides.items():
        spark.createDataFrame(rows, "id int, name string").write.parquet(str(tmp_path / side / "fruit.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "a" / "more.parquet"))
    (tmp_path / "c.yaml").write_text(f"sourceDb: {{type: parquet, dbname: {tmp_path / 'a'}}}\ntargetDb: {{type: parquet, dbname: {tmp_path / 'b'}}}\n")
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"table": "none"}, {"table": "fruit", "key": ["id"]}]}))
    config, out = ["-c", str(tmp_path / "c.yaml")], str(tmp_path / "out.sql")
    read = lambda: [x for f in sorted((tmp_path / "out.sql").glob("part-*")) for x in f.read_text().splitlines()]
    assert cli.main(["diff-data", *config, "-r", str(tmp_path / "r.json"), "-o", out, "--dialect", "mysql"], spark) == 0
    assert read() == ["--- diff fruit ", "DELETE FROM `fruit` WHERE `id` = 3;", "UPDATE `fruit` SET `name` = 'y' WHERE `id` = 2;"]
    assert cli.main(["diff-schema", *config, "-o", out], spark) == 0
    assert read()[0].startswith('CREATE TABLE "more"')
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "v1__one.sql").write_text("create table by_command(x int) using parquet")
    (tmp_path / "m" / "v2__two.sql").write_text("insert into by_command values (3)")
    run = ["migrate-script", *config, "-d", str(tmp_path / "m")]
    assert cli.main([*run, "-n"], spark) == 0
    assert "v2__two\ninsert" in capsys.readouterr().out and not spark.catalog.tableExists("by_command")
    assert cli.main([*run, "-v", "v1"], spark) == 0 and spark.table("by_command").count() == 0
    assert cli.main(run, spark) == 0 and spark.table("by_command").first()[0] == 3
    (tmp_path / "m" / "v3__three.sql").write_text("no sql")
    assert cli.main(run, spark) == 1
    assert cli.main(["reset-db", *config], spark) == 1
    assert cli.main(["diff-schema", "-c", str(tmp_path / "missing.yaml")], spark) == 1
    spark.sql("drop table by_command")
    spark.sql("drop table schema_migrations")
