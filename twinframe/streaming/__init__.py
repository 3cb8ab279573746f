"""Change feeds: row diffs of each arriving snapshot, as a foreachBatch sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.rowdiff import row_diff


def diff_each_batch(target: Callable[[], DataFrame], key: list[str], sink: Callable[[DataFrame, int], None], compare: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: compares each micro-batch (rows to be merged) with the target as it then is, and
    hands the changes, without DROPs (a batch is no whole snapshot), to `sink`."""

    def each(batch: DataFrame, number: int) -> None:
        sink(row_diff(batch, target(), key, compare).where("diff_type <> 'DROP'"), number)

    return each
