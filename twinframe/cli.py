"""Four commands: diff-data, diff-schema, migrate-script, reset-db. `python -m twinframe.cli COMMAND -h` tells more."""

from __future__ import annotations

import argparse
import contextlib
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .functions import sqltext as q
from .operators import migrate, schemadiff
from .plans import sync
from .sources import catalogs, loaders, servers

log = logging.getLogger(__name__)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="twinframe", description="Compares two databases, and runs migrations.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text, description=text)
        sub.add_argument("-c", "--config", required=True, help="connections, YAML or JSON")
        return sub

    for name, what in (("diff-data", "rows"), ("diff-schema", "schema")):
        sub = command(name, f"the script that makes the target's {what} like the source's")
        sub.add_argument("-o", "--out", default=name.removeprefix("diff-") + "_diff.sql", help="folder of the script's text files, which is replaced")
        sub.add_argument("--dialect", choices=("postgres", "mysql"), help="of the script; the target's, if not given")
        if what == "rows":
            sub.add_argument("-r", "--rules", required=True, help="tables and the columns to compare, YAML or JSON")
            sub.add_argument("--batch-size", type=int, default=1000, help="rows that a server sends at a time")
    sub = command("migrate-script", "runs the pending migrations of a folder")
    sub.add_argument("-d", "--dir", required=True, help="folder of migration files")
    sub.add_argument("-v", "--version", help="last version to run; all, if not given")
    sub.add_argument("-n", "--dry-run", action="store_true", help="print what would run, and run nothing")
    command("reset-db", "empties the target").add_argument("--yes", action="store_true", help="without it nothing happens")
    return parser


def _dialect(args: argparse.Namespace, target: loaders.Connection) -> q.Dialect:
    return q.MYSQL if (args.dialect or target.type) == "mysql" else q.POSTGRES


def _catalog(spark: SparkSession, c: loaders.Connection, keys: dict[str, list[str]] | None = None) -> catalogs.Catalog:
    return catalogs.from_folder(spark, c.dbname, keys) if c.type == "parquet" else catalogs.from_jdbc(spark, c.type, c.schema, c.jdbc())


def diff_data(spark: SparkSession, args: argparse.Namespace, config: dict[str, loaders.Connection]) -> None:
    """A rule whose table is missing on a side, or has no key there, is left out and reported."""
    source, target = config["source"], config["target"]
    rules = loaders.load_rules(args.rules)
    keys = {r.table: list(r.key) for r in rules if r.key}
    has = [_catalog(spark, c, keys) for c in (source, target)]
    names = [{r[0] for r in x.tables.select("table_name").collect()} for x in has]
    there = [r for r in rules if all(r.table in n for n in names)]
    for r in rules:
        if r not in there:
            log.error("%s is left out: there is no such table in both databases", r.table)
    read = lambda c: lambda t: loaders.read_table(spark, c, t, key=first_key(t), batch_size=args.batch_size)
    key_of = lambda t: keys.get(t) or has[1].primary_key(t)
    first_key = lambda t: (key_of(t) or [None])[0]
    changes, _ = sync.run(there, read(source), read(target), key_of, _dialect(args, target), target.schema)
    if changes is not None:
        sync.write_data_script(changes, args.out)
        log.info("script: %s", args.out)


def diff_schema(spark: SparkSession, args: argparse.Namespace, config: dict[str, loaders.Connection]) -> None:
    sides = [_catalog(spark, config[side]) for side in ("source", "target")]
    _, script = schemadiff.compare_connections(*sides, _dialect(args, config["target"]))
    sync.write_schema_script(script, args.out)
    log.info("script: %s", args.out)


def migrate_script(spark: SparkSession, args: argparse.Namespace, config: dict[str, loaders.Connection]) -> bool:
    """Runs on the target's server; for a folder, in Spark's own catalog (one statement a file). False after a failure."""
    target = config["target"]
    files = migrate.read_files(spark, Path(args.dir).resolve().as_uri() if "://" not in args.dir else args.dir)
    with contextlib.ExitStack() as closing:
        if target.type == "parquet":
            versions, execute = migrate.VersionLog(spark), lambda sql: spark.sql(sql)
        else:
            server = closing.enter_context(contextlib.closing(servers.Server(spark, target)))
            versions, execute = servers.ServerVersionLog(server), server.execute
        if args.dry_run:
            versions.ensure()
            for r in migrate.dry_run(files, versions.rows(), args.version).collect():
                print(f"-- {r['version']}__{r['title']}\n{r['content']}")
            return True
        ran = migrate.apply(files, versions, execute, args.version)
    return all(r[-1] == "success" for r in ran)


def reset_db(spark: SparkSession, args: argparse.Namespace, config: dict[str, loaders.Connection]) -> None:
    with contextlib.closing(servers.Server(spark, config["target"])) as server:
        servers.reset(server, args.yes)


COMMANDS = {"diff-data": diff_data, "diff-schema": diff_schema, "migrate-script": migrate_script, "reset-db": reset_db}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 after an error, which is logged."""
    args = _parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    try:
        config = loaders.load_config(args.config)
        spark = spark or SparkSession.builder.appName("twinframe").getOrCreate()
        return 1 if COMMANDS[args.command](spark, args, config) is False else 0
    except Exception:
        log.exception("%s failed", args.command)
        return 1


if __name__ == "__main__":
    sys.exit(main())
