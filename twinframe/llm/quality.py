"""Quality rules as a short-circuit cascade.

Each rule rejects a text. Cost (seconds over a sample of raw texts, with the features that the rule reads) and
selectivity (share of the sample that it rejects) are measured, and rules are tried by rejection per cost, the highest first; a rule further down is evaluated only for
texts that the ones before have let through (a CASE expression evaluates its branches lazily). The order decides the
time, never the verdict. Everything is built-in expressions over one row: no shuffle, no Python.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import WS, without, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

def rules(text: str = "text") -> dict[str, Column]:
    """The rules beyond the base ones, as boolean columns over a frame that `features` has made: name and what it
    rejects. Thresholds are in percent; the SQL below has the same."""
    c = F.col
    return {
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        "word_length": (c("word_chars") > 15 * c("n_words")) | (c("word_chars") < 2 * c("n_words")),
        "dup_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "shouting": 100 * F.regexp_count(F.coalesce(c(text), F.lit("")), F.lit("[A-Z]")) > 30 * c("word_chars"),
        "bangs": 100 * F.regexp_count(F.coalesce(c(text), F.lit("")), F.lit("!!")) > 30 * c("n_words"),
    }


def base_rules() -> dict[str, Column]:
    return {"short": F.col("n_words") < MIN_WORDS, "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")}


# The features that each rule reads, for its cost.
INPUTS = {"short": ("n_words",), "repeats": ("n_words", "n_repeat_words"), "symbols": ("n_symbols", "n_words"), "word_length": ("word_chars", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "shouting": ("word_chars",), "bangs": ("n_words",)}


def features(df: DataFrame, text: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """`df` with the base columns (bigint) and n_lines (lines with a word), or `only` some of them.

    Null and empty texts have zeros. Two different windows of one text count as equal if their 64-bit hashes are
    (below 1e-8 for a text of a million words). Sorting is within the text's own row, in n log n for its words.
    """
    keep = without(df, *BASE, "n_lines", "__t", "__b", "__w", "__l", "__h", "__s", "__p")
    body = F.coalesce(df[text], F.lit(""))
    d = df.select(*[df[c] for c in keep], body.alias("__t"), F.btrim(body, F.lit(WS)).alias("__b"))
    d = d.withColumn("__w", F.when(F.col("__b") == "", F.array().cast("array<string>")).otherwise(F.split("__b", r"[\x20\x09-\x0D]+"))).drop("__b")
    d = d.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""))
    n = F.size("__w")
    windows = F.transform("__w", lambda w, i: F.xxhash64(w, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2)))
    d = d.withColumn("__h", F.when(n >= 3, F.slice(windows, F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    paired = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__s", F.when(F.size("__h") > F.size(F.array_distinct("__h")), paired))
    near = lambda i: F.get(F.col("__s"), i)["h"]
    again = F.filter("__s", lambda x, i: F.coalesce(x["h"] == near(i - 1), F.lit(False)) | F.coalesce(x["h"] == near(i + 1), F.lit(False)))
    d = d.withColumn("__p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("__p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), i + 1) - p, F.lit(3))))
    made = {
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("__w", "")).cast("bigint"),
        "n_symbols": F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint"),
        "n_lines": F.size("__l").cast("bigint"),
    }
    row = F.struct(*[made[k].alias(k) for k in only or made])
    # Through a generator of one row: a filter on these columns then stays above it. Pushed below, it would split the
    # text anew at every use, once for each word inside the lambdas.
    return d.select(*[d[c] for c in keep], F.inline(F.array(row)))


def measure(df: DataFrame, tests: dict[str, Column], text: str = "text") -> list[dict]:
    """Cost and selectivity of each rule on a sample of raw texts, by rejection per cost. Selectivities come from one
    aggregate; a rule's cost is the time of a job with that rule and the features it reads, less that of counting rows."""

    def seconds(rows: DataFrame) -> float:
        began = time.perf_counter()
        rows.count()
        return time.perf_counter() - began

    every = features(df, text).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()]).first()
    bare = seconds(df.where(F.length(text) >= 0))
    costs = {k: max(seconds(features(df, text, INPUTS[k]).where(t)) - bare, 1e-6) for k, t in tests.items()}
    rows = [{"rule": k, "cost_s": costs[k], "rejects": every[k] / every["n"] if every["n"] else 0.0} for k in tests]
    return sorted(rows, key=lambda r: (-r["rejects"] / r["cost_s"], r["rule"]))


def sample_of(df: DataFrame, text: str = "text", sample_rows: int = 2000, sample_chars: int = 65536) -> DataFrame:
    """A written sample of at most `sample_rows` rows, spread over the table. Texts over `sample_chars` characters are
    left out of the sample (not of the result), so its size is bounded."""
    total = df.count()
    part = min(1.0, 4 * sample_rows / max(total, 1))
    some = df.where(F.coalesce(F.length(text), F.lit(0)) <= sample_chars).sample(part, seed=7).limit(sample_rows)
    return written(some, "quality-sample")


def cascade(df: DataFrame, tests: dict[str, Column], order: list[str]) -> Column:
    """The first rule in `order` that rejects a row, or null."""
    out = None
    for name in order:
        hit = F.coalesce(tests[name], F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def judge(df: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """`df` with the base columns, base_failed, kept and rejected_by (the first rule of the measured order that
    rejects; which one it is may change with the order, whether there is one may not). An empty table gives none."""
    clean = df.select(*[df[c] for c in without(df, "base_failed", "kept", "rejected_by")])
    tests = base_rules() | rules(text)
    order = [r["rule"] for r in measure(sample_of(clean.select(text), text, sample_rows), tests, text)]
    f = features(clean, text)
    base = base_rules()
    f = f.withColumn("base_failed", base["short"] | base["repeats"]).withColumn("rejected_by", cascade(f, tests, order))
    return f.withColumn("kept", F.col("rejected_by").isNull())


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 2) AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS caps,
             len(regexp_extract_all(t, '!!')) AS bangs
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 100 * caps > 30 * word_chars OR 100 * bangs > 30 * n_words) AS kept
FROM b"""
