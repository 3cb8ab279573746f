"""URL rules, and exact membership by a Bloom filter cascade.

Every key of the universe is either listed or not. Level 1 is a Bloom filter of the listed keys; the unlisted keys
that pass it (its false positives over the whole universe) are encoded by level 2; the listed keys that pass level 2
by level 3; and so on, until a level lets nothing through. A key is then judged by the first level that stops it,
without an error for any key of the universe, and without a join: each level is a small bit array that every task
holds (a scalar subquery). Levels are cut into `parts` by a hash of the key once one array would exceed `max_words`
64-bit words; a key then meets its part's arrays through an equi-join on the part number, so nothing that grows with
the keys is broadcast unchecked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import new_path, without, written

# The rules (action, host and path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MAX_WORDS, MAX_LEVELS = 1 << 17, 40
RATE = 1 / 32  # share of the other keys that a level lets through, at most


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; '' for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """(rule, action) struct of the longest rule that fits, or null: its host or a subdomain, and the path's start."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


class Cascade:
    """levels: one (bits, parts, hashes, table) each; table holds (part, words array<bigint>) rows."""

    def __init__(self, levels: list[tuple[int, int, int, DataFrame]]):
        self.levels = levels

    def words(self) -> int:
        return sum(-(-bits // 64) * parts for bits, parts, _, _ in self.levels)

    def listed(self, df: DataFrame, key: str, name: str = "listed") -> DataFrame:
        """`df` with a boolean column: whether its key is listed (exact for the keys of the universe; null: false)."""
        out = df
        passed = []
        for level, (bits, parts, hashes, table) in enumerate(self.levels):
            if parts == 1:
                words = table.select("words").scalar()
            else:
                part, words = f"__part{level}", F.col(f"__words{level}")
                right = table.select(F.col("part").alias(part), F.col("words").alias(f"__words{level}"))
                out = out.withColumn(part, _part(F.col(key), level, parts)).join(right, part, "left").drop(part)
            passed.append(_holds(words, F.col(key), level, bits, hashes))
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(passed))):
            verdict = F.when(~passed[level], F.lit(level % 2 == 1)).otherwise(verdict)
        out = out.withColumn(name, F.coalesce(verdict, F.lit(False)) & F.col(key).isNotNull())
        return out.drop(*[f"__words{k}" for k in range(len(self.levels))])


def _part(key: Column, level: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit("part")), F.lit(parts)).cast("int")


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    a = F.pmod(F.xxhash64(key, F.lit(level), F.lit("a")), F.lit(bits))
    b = F.pmod(F.xxhash64(key, F.lit(level), F.lit("b")), F.lit(bits))
    return [(a + F.lit(i) * b) % bits for i in range(hashes)]


def _holds(words: Column, key: Column, level: int, bits: int, hashes: int) -> Column:
    out = F.lit(True)
    for p in _positions(key, level, bits, hashes):
        word = F.get(words, F.floor(p / 64).cast("int"))
        out = out & (F.getbit(F.coalesce(word, F.lit(0).cast("bigint")), (p % 64).cast("int")) == 1)
    return out


def _level(keys: DataFrame, level: int, bits: int, parts: int, hashes: int) -> DataFrame:
    """The bit arrays of one level. Bits are or-ed per word before anything meets in one task; a part's array has a
    fixed length, and the missing words are filled in with a range, not a key."""
    each = keys.select(_part(F.col("key"), level, parts).alias("part"), F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    words = each.groupBy("part", F.floor(F.col("p") / 64).cast("bigint").alias("word")).agg(F.bit_or(bit).alias("bits"))
    n = -(-bits // 64)
    grid = keys.sparkSession.range(0, n * parts, 1, max(1, n * parts // MAX_WORDS)).select((F.col("id") % parts).cast("int").alias("part"), F.floor(F.col("id") / parts).cast("bigint").alias("word"))
    full = grid.join(words, ["part", "word"], "left").select("part", F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("x"))
    return full.groupBy("part").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("words"))


def build(universe: DataFrame, max_words: int = MAX_WORDS) -> Cascade:
    """A cascade over (key string, listed boolean) rows.

    Keys may repeat; a key that is listed in any row is listed. Null keys are left out. Without listed keys the
    cascade has no level, and every key is unlisted.
    """
    spark: SparkSession = universe.sparkSession
    keys = written(universe.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed")), "url-keys")
    count = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    n_in, n_out = count.get(True, 0), count.get(False, 0)
    levels: list[tuple[int, int, int, DataFrame]] = []
    while n_in:
        level = len(levels)
        if level >= MAX_LEVELS:
            raise RuntimeError("the cascade does not end: the key hashes collide")
        # a lower rate than the smallest arrays ask for: some five levels, each a job or two, instead of some twenty
        rate = min(RATE, max(1e-4, n_in / (math.sqrt(2) * max(n_out, 1)))) if level == 0 else RATE
        hashes = max(1, round(math.log2(1 / rate)))
        total = max(64, math.ceil(n_in * hashes * 1.45))
        parts = max(1, math.ceil(total / 64 / max_words))
        bits = -(-total // parts // 64) * 64 or 64
        path = new_path(spark, f"url-level{level}")
        _level(inside, level, bits, parts, hashes).write.parquet(path)
        levels.append((bits, parts, hashes, spark.read.parquet(path)))
        false = _passing(outside, level, *levels[-1]) if n_out else outside.limit(0)
        false = written(false, f"url-false{level}")
        inside, outside, n_in, n_out = false, inside, false.count(), n_in
    return Cascade(levels)


def _passing(keys: DataFrame, level: int, bits: int, parts: int, hashes: int, table: DataFrame) -> DataFrame:
    if parts == 1:
        return keys.where(_holds(table.select("words").scalar(), F.col("key"), level, bits, hashes))
    found = keys.withColumn("part", _part(F.col("key"), level, parts)).join(table, "part")
    return found.where(_holds(F.col("words"), F.col("key"), level, bits, hashes)).select("key")


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, max_words: int = MAX_WORDS) -> DataFrame:
    """`pages` with host, path, rule and verdict.

    The universe is every distinct (host, path) of the table, the listed keys are those whose rule blocks; the
    verdict comes from the cascade: block if listed, else allow. So a URL without a rule is allowed. Null URLs and
    those without :// have empty host and path, which is a key like any other. Columns of these names are replaced.
    """
    keep = without(pages, "host", "path", "rule", "verdict", "__key", "__listed", "__rule")
    d = pages.select(*[pages[c] for c in keep], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    d = d.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("__key", F.concat("host", F.lit("\n"), "path"))
    cascade = build(d.select(F.col("__key").alias("key"), F.coalesce(F.col("__rule.action") == "block", F.lit(False)).alias("listed")), max_words)
    d = cascade.listed(d, "__key", "__listed")
    return d.select(*keep, "host", "path", F.col("__rule.rule").alias("rule"), F.when(F.col("__listed"), "block").otherwise("allow").alias("verdict"))


def oracle(rules: list[tuple[str, str]] = RULES) -> str:
    when, verdict = "", ""
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
        when, verdict = when + f" WHEN {fits} THEN '{rule}'", verdict + f" WHEN {fits} THEN '{action}'"
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT page_id, host, path, CASE{when} END AS rule, CASE{verdict} ELSE 'allow' END AS verdict FROM h"""
