import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from twinframe.functions import sqltext as q
from twinframe.operators import migrate, rowdiff, schemadiff
from twinframe.plans import fixtures as fx
from twinframe.plans import queries as core
from twinframe.plans import sync
from twinframe.sources import catalogs, loaders

SF = "/root/testdata/sf0.01"
TABLES = "orders customer part events conversations documents".split()

def _snapshot(rnd, keys, values, space, share):
    """A dict from key to values: some of the keys of a small space, each present with a chance of `share`."""
    every = [(x,) if keys == 1 else (x, y) for x in range(space) for y in range(1 if keys == 1 else 3)]
    return {k: tuple(rnd.choice(["p", "q", None]) for _ in range(values)) for k in every if rnd.random() < share}


def _model(source, target):
    """What has to come out: kind, old and new values by key."""
    out = {}
    for k in source.keys() | target.keys():
        kind = "ADD" if k not in target else "DROP" if k not in source else "MODIFY" if source[k] != target[k] else None
        if kind:
            out[k] = (kind, target.get(k), source.get(k))
    return out


@pytest.mark.parametrize("keys,values,seed", [(1, 1, 1), (1, 3, 2), (2, 2, 3), (2, 1, 4)])
def test_row_diff_against_a_model(spark, keys, values, seed):
    rnd = random.Random(seed)
    ks, vs = [f"k.{i}" for i in range(keys)], [f"v{i}" for i in range(values)]
    schema = ", ".join([f"`{k}` int" for k in ks] + [f"{v} string" for v in vs])
    for share_s, share_t in ((0.6, 0.6), (0.9, 0.0), (0.0, 0.8), (1.0, 0.5)):
        source, target = _snapshot(rnd, keys, values, 12, share_s), _snapshot(rnd, keys, values, 12, share_t)
        s, t = (spark.createDataFrame([(*k, *v) for k, v in x.items()], schema) for x in (source, target))
        value = lambda row: None if row is None else tuple(row[v] for v in vs)  # noqa: E731, B023
        got = {tuple(r[k] for k in ks): (r["diff_type"], value(r["old"]), value(r["new"])) for r in rowdiff.row_diff(s, t, ks, unique=True).collect()}
        assert got == _model(source, target)
        after = rowdiff.apply_diff(t, rowdiff.row_diff(s, t, ks), ks).collect()
        assert {tuple(r[k] for k in ks): value(r) for r in after} == source and len(after) == len(source)
        page = rowdiff.keyset_page(s, ks, [5] * keys, 4).collect()
        assert [tuple(r[k] for k in ks) for r in page] == sorted(k for k in source if k > (5,) * keys)[:4]


def test_repeated_keys_and_reserved_names(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id int, a string")
    once = spark.createDataFrame([(1, "a")], "id int, a string")
    assert rowdiff.row_diff(twice, once, ["id"]).count() == 1
    with pytest.raises(rowdiff.DuplicateKeyError):
        rowdiff.row_diff(twice, once, ["id"], unique=True)
    with pytest.raises(ValueError, match="old"):
        rowdiff.row_diff(once.withColumnRenamed("id", "old"), once.withColumnRenamed("id", "old"), ["old"])


def test_nulls_missing_keys_and_types(spark):
    s = spark.createDataFrame([(1, None), (2, None), (None, "x")], "id int, a string")
    t = spark.createDataFrame([(1, None), (2, "v"), (None, "x")], "id int, a string")
    assert [(r["diff_type"], r["id"]) for r in rowdiff.row_diff(s, t, ["id"]).collect()] == [("MODIFY", 2)]
    with pytest.raises(rowdiff.MissingKeyError):
        rowdiff.row_diff(s, t, [])
    with pytest.raises(ValueError):
        rowdiff.rule_for("t", ["a"], ["zzz"])
    with pytest.raises(rowdiff.DuplicateKeyError):
        rowdiff.check_unique(s.union(s), ["id"])
    mixed = spark.createDataFrame([(1, 5)], "id int, a int")
    text = spark.createDataFrame([(1, "5")], "id int, a string")
    assert rowdiff.row_diff(mixed, text, ["id"]).count() == 0


def test_random_snapshots_converge(spark):
    rnd = random.Random(5)
    for _ in range(3):
        make = lambda: [(k, rnd.choice(["a", "b", None])) for k in rnd.sample(range(40), 25)]
        s, t = (spark.createDataFrame(make(), "id int, a string") for _ in range(2))
        assert tuple(rowdiff.verify_sync(s, t, ["id"]).first()) == (0, 0)
        keys = {}
        for r in rowdiff.row_diff(s, t, ["id"]).collect():
            assert r["id"] not in keys
            keys[r["id"]] = r["diff_type"]


def test_scan_reads_only_what_is_compared(spark):
    page = core.queries()["keyset_page_orders"](spark, SF)
    plan = page._jdf.queryExecution().explainString(page._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(o_orderkey,5000)" in plan and "o_orderpriority" not in plan


ORACLES = core.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want
    assert want or name == "rowdiff_customer_identical"


def test_schema_script_text(spark):
    for d in (q.POSTGRES, q.MYSQL):
        rows = schemadiff.schema_script(d, *fx.catalogs(spark), foreign_keys=True).collect()
        text = "\n".join(r["sql"] for r in rows)
        assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)
        t = (lambda s: s.replace('"', d.quote))
        assert t('DROP VIEW "v1";') in text and t('DROP TABLE "only_tgt";') in text and t('CREATE VIEW "v1" AS\nSELECT 1;') in text
        assert t('ADD COLUMN "email" varchar(100);') in text and t('DROP COLUMN "legacy";') in text
    pg = {(r["rank"], r["name"]): r["sql"] for r in schemadiff.schema_script(q.POSTGRES, *fx.catalogs(spark)).collect()}
    assert pg[43, "name"] == 'ALTER TABLE "acct" ALTER COLUMN "name" TYPE varchar(80); ALTER TABLE "acct" ALTER COLUMN "name" SET DEFAULT \'x\'; ALTER TABLE "acct" ALTER COLUMN "name" SET NOT NULL;'
    assert pg[30, "only_src"] == 'CREATE TABLE "only_src" (\n  "id" int8 NOT NULL,\n  "label" varchar(20) DEFAULT \'none\',\n  CONSTRAINT "only_src_pk" PRIMARY KEY ("id"),\n  CONSTRAINT "fk_acct" FOREIGN KEY ("id") REFERENCES "acct" ("id") ON DELETE CASCADE\n);\n\nCOMMENT ON COLUMN "only_src"."label" IS \'a label\';'
    assert pg[46, "acct_pk"] == 'ALTER TABLE "acct" DROP CONSTRAINT "acct_pkey";'


def _numbers(version):
    """A version as a plain list of numbers without zeros at its end; none for no version."""
    if not version:
        return None
    out = [int(p) if p.isdigit() and int(p) < 2**63 else 0 for p in version.lstrip("vV").split(".")]
    while out and out[-1] == 0:
        out.pop()
    return out


def test_versions(spark):
    rnd = random.Random(8)
    some = ["".join(rnd.choice(["", "v", "V"])) + ".".join(str(rnd.choice([0, 0, 3, 9, 10, 20231231235959, 2**40])) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    some += ["", "v6.x.2", "6", "v6.0.2", f"v{10**30}"]
    pairs = [(a, b) for a in some for b in rnd.sample(some, 12)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", migrate.compare(F.col("a"), F.col("b")).alias("sign")).collect()
    rank = lambda v: (v is not None, v or [])
    assert all(r["sign"] == (rank(_numbers(r["a"])) > rank(_numbers(r["b"]))) - (rank(_numbers(r["a"])) < rank(_numbers(r["b"]))) for r in got)


def test_migrations_run_log_and_stop(spark, tmp_path):
    scripts = {"v2__one.sql": "BEGIN; one; COMMIT;", "v20240301__three.up.sql": "three", "v2.5__two.sql": "bad", "v2.5__two.down.sql": "x", "notes.txt": ""}
    for name, text in scripts.items():
        (tmp_path / name).write_text(text)
    files = migrate.read_files(spark, str(tmp_path))
    state = spark.createDataFrame([(1, "v1.9", "success")], "id int, version string, status string")
    assert [(r["version"], r["content"].strip()) for r in migrate.dry_run(files, state).collect()] == [("v2", "one;"), ("v2.5", "bad"), ("v20240301", "three")]
    versions, ran = migrate.VersionLog(spark, "versions_of_test"), []

    def execute(sql):
        ran.append(sql)
        if sql in broken:
            raise RuntimeError(sql)

    broken = {"bad"}
    assert [(r[1], r[5]) for r in migrate.apply(files, versions, execute)] == [("v2", "success"), ("v2.5", "failed")]
    assert len(ran) == 2 and migrate.current_version(versions.rows()).first()[0] == "v2"
    broken.clear()
    migrate.apply(files, versions, execute)
    assert migrate.apply(files, versions, execute) == []
    logged = versions.rows().orderBy("id").collect()
    assert [(r["id"], r["version"], r["status"]) for r in logged] == [(1, "v2", "success"), (2, "v2.5", "failed"), (3, "v2.5", "success"), (4, "v20240301", "success")]
    assert all(r["applied_at"] and r["execution_time"] >= 0 and r["title"] for r in logged)
    with pytest.raises(PermissionError):
        migrate.reset(spark, "x")
    spark.sql("create database if not exists to_reset")
    spark.range(1).write.mode("overwrite").saveAsTable("to_reset.t")
    migrate.reset(spark, "to_reset", confirm=True)
    assert not spark.catalog.tableExists("to_reset.t")
    spark.sql("drop database to_reset")


def test_scripts_as_files(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "id int, name string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (3, "w")], "id int, name string")
    sides = {"one": (a, b), "two": (a.where("id < 2"), a.where("id < 1")), "three": (a, b), "four": (a.union(a), b)}
    rules = [loaders.Rule("two"), loaders.Rule("three", key=()), loaders.Rule("one", comparisonKey=("name",)), loaders.Rule("four")]
    key_of = lambda t: [] if t == "three" else ["id"]
    changes, skipped = sync.run(rules, lambda t: sides[t][0], lambda t: sides[t][1], key_of, q.POSTGRES)
    assert set(skipped) == {"three", "four"}
    sync.write_data_script(changes, str(tmp_path / "data.sql"))
    lines = [x for f in sorted((tmp_path / "data.sql").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [
        "--- diff two ",
        'INSERT INTO "two" ("id", "name") VALUES (1, \'x\');',
        "--- diff one ",
        'DELETE FROM "one" WHERE "id" = 3;',
        'INSERT INTO "one" ("id", "name") VALUES (4, \'z\');',
        'UPDATE "one" SET "name" = \'y\' WHERE "id" = 2;',
    ]
    _, script = schemadiff.compare_connections(*fx.catalogs(spark), q.POSTGRES)
    sync.write_schema_script(script, str(tmp_path / "schema.sql"))
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "schema.sql").glob("part-*")))
    assert text.startswith("DROP VIEW") and text.rstrip().endswith("SELECT 1;")


def test_numbers_that_are_none(spark):
    row = spark.sql("select double('NaN') a, double('-Infinity') b, float(1.5) c")
    one = lambda d: list(row.select(*[q.literal(d, F.col(x), k) for x, k in (("a", "double"), ("b", "double"), ("c", "float"))]).first())
    assert one(q.POSTGRES) == ["'NaN'", "'-Infinity'", "1.5"] and one(q.MYSQL) == ["NULL", "NULL", "1.5"]


def test_unsigned_and_defaults(spark):
    names = "column_name string, data_type string, char_max_len int, numeric_prec int, numeric_scale int, nullable boolean, default_expr string, extra string, comment string"
    rows = [("a", "int unsigned", None, 10, 0, True, "7", "", ""), ("b", "decimal unsigned zerofill", None, 8, 2, False, None, "", ""), ("c", "varchar", 9, None, None, True, "it's", "", ""), ("d", "datetime", None, None, None, True, "CURRENT_TIMESTAMP", "DEFAULT_GENERATED", ""), ("e", "enum", None, None, None, True, "x", "enum('x','y')", "")]
    got = spark.createDataFrame(rows, names).select(F.struct("*").alias("c")).select(q.column_ddl(q.MYSQL, "c"))
    assert [r[0] for r in got.collect()] == ["`a` int unsigned DEFAULT 7", "`b` decimal(8,2) unsigned zerofill NOT NULL", "`c` varchar(9) DEFAULT 'it''s'", "`d` datetime DEFAULT CURRENT_TIMESTAMP", "`e` enum('x','y') DEFAULT 'x'"]


def test_join_helpers(spark):
    words = ["kiwi", "fig", ""]
    df = spark.createDataFrame([(words[:n],) for n in range(4)], "w array<string>")
    got = df.select(q.join_wrap(F.col("w"), "~", ";"), q.join_affixed(F.col("w"), "<", ">>", " ")).collect()
    assert [tuple(r) for r in got] == [(";".join(f"~{x}~" for x in words[:n]), " ".join(f"<{x}>>" for x in words[:n])) for n in range(4)]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"source_db": {"type": "postgres", "host": "h", "port": 1, "dbname": "d", "password": "secret"}, "targetDb": {"type": "mysql", "host": "h", "port": 2, "dbname": "e"}}))
    c = loaders.load_config(str(tmp_path / "c.json"))
    assert c["source"].schema == "public" and c["target"].schema == "e" and "secret" not in repr(c["source"])
    assert c["source"].jdbc()["url"] == "jdbc:postgresql://h:1/d?sslmode=disable"
    (tmp_path / "r.json").write_text('{"rules":[{"table":"t","comparisonKey":["a"]},{"table":"u"}]}')
    assert loaders.load_rules(str(tmp_path / "r.json")) == [loaders.Rule("t", ("a",)), loaders.Rule("u")]
    for bad in ({"type": "oracle"}, {"type": "mysql", "proxy": {"host": "x"}}):
        with pytest.raises(ValueError):
            loaders.Connection(**bad)
    assert catalogs.table_type("BASE TABLE") == "TABLE" and catalogs.table_type("x") == "UNKNOWN"


def test_catalog_assembly(spark, tmp_path):
    raw = {
        "tables": spark.createDataFrame([("t", "BASE TABLE", "public", None), ("x", "FOREIGN", "public", None)], "table_name string, table_type string, schema_name string, comment string"),
        "columns": spark.createDataFrame([("t", "b", "int", "YES", None, "", None, None, None, None, 2), ("t", "a", "int", "NO", None, "", None, None, None, None, 1)], "table_name string, column_name string, data_type string, is_nullable string, default_expr string, extra string, comment string, char_max_len int, numeric_prec int, numeric_scale int, position int"),
        "primary_keys": spark.createDataFrame([("t", "pk", "b", 2), ("t", "pk", "a", 1)], "table_name string, constraint_name string, column_name string, ordinal_position int"),
        "indexes": spark.createDataFrame([("t", "i", "b", 1, True, False, "btree", None)], "table_name string, index_name string, column_name string, ordinal_position int, is_unique boolean, is_primary boolean, method string, where_expr string"),
        "foreign_keys": spark.createDataFrame([("t", "f", "a", 1, "public", "u", "x", "CASCADE", ""), ("t", "f", "b", 2, "public", "u", "y", "CASCADE", "")], "table_name string, fk_name string, column_name string, ordinal_position int, ref_schema string, ref_table string, ref_column string, on_delete string, on_update string"),
        "views": spark.createDataFrame([("v", "SELECT 1", "YES", "NONE", "")], "table_name string, select_statement string, is_updatable string, check_option string, comment string"),
    }
    c = catalogs.assemble(raw)
    assert c.primary_key("t") == ["a", "b"] and c.column_names("t") == ["a", "b"] and c.tables.count() == 1
    f = c.foreign_keys.first()
    assert (f["columns"], f["ref_columns"]) == (["a", "b"], ["x", "y"])
    with pytest.raises(ValueError):
        c.column_names("none")
    spark.createDataFrame([(1, "x")], "id int, name string").write.parquet(str(tmp_path / "fruit.parquet"))
    own = catalogs.from_folder(spark, str(tmp_path), {"fruit": ["id"]})
    assert own.column_names("fruit") == ["id", "name"] and own.primary_key("fruit") == ["id"]
    differ = schemadiff.schema_diff(own, catalogs.from_rows(spark)).collect()
    assert [(r["object_type"], r["name"], r["diff_type"]) for r in differ] == [("table", "fruit", "ADD")]
