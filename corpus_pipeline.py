"""A corpus pipeline over `documents`: language, toxicity, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and returns a DataFrame; `run`
writes each stage's rows to the shared folder and reads them again as the next one's. All but the last return the
columns of `documents`. Stages lower the session's Arrow batches, as their rows hold whole texts, and begin with the heap
that the stages before have left given back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import decontaminate, dedup, langid, sentencepieces, toxicity
from twinframe.llm._io import bound_batches, collect_garbage, table, train_rows, written

#: Languages are told apart with a share near 1; a text torn between languages, or without letters, goes.
LEAST_LANGUAGE_SCORE = 0.4


def _begin(spark: SparkSession) -> None:
    bound_batches(spark)
    collect_garbage(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose best language has a share under LEAST_LANGUAGE_SCORE. Where no row names
    a language, so that none can be learned, only texts without letters go."""
    _begin(spark)
    model = langid.train(train_rows(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts predicted to be toxic."""
    _begin(spark)
    model = toxicity.train(docs, train_rows(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row stays, that with the smallest doc_id (one without comes last). Rows are
    told apart by a number of their own, so rows that repeat a doc_id, or have none, are rows like others. Texts without
    words are linked with nothing and stay."""
    _begin(spark)
    numbered = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = dedup.components(numbered.select("row", "doc_id", "text"), "row").select("row", "doc_id", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = found.groupBy("component_id").agg(F.min(order).alias("first")).select("component_id", F.col("first.row").alias("stays"))
    gone = found.join(first, "component_id").where("row <> stays").select("row")
    return numbered.join(gone, "row", "left_anti").select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or a paraphrase of one."""
    _begin(spark)
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).where("n_items = 0").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids; every one is decoded again and compared with its text. The ids are
    written in between, so that a task has one Python worker at a time."""
    _begin(spark)
    coded = written(sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), "doc_id", "text"), "coded")
    collect_garbage(spark)
    back = sentencepieces.decode(coded)
    same = F.col("decoded").eqNullSafe(F.replace(F.col("text"), F.lit(sentencepieces.MARK), F.lit(" ")))
    return back.select("doc_id", "lang", "source", "ids", "n_ids", "n_chunks", same.alias("round_trip"))


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("tokens", tokens),
]

#: The models of the stages can't be expressed in SQL; tests hold each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
