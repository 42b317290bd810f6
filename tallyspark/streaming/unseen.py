"""Documents that a conversation hasn't been given yet, the same in batch and on streams; rows are (conversation,
source_key, at, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("conversation", "source_key")


def unseen(rows: DataFrame, seen: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """The first row of each document in a conversation, without those in `seen`; rows without a key are left out.

    On a stream the state holds the keys that came before, so a restart from its checkpoint gives none again. It grows with
    the conversations' documents; `within` bounds it: keys are kept for as long after `at`, and come again later. In batch
    the first is the earliest, and equally early rows are told apart by nothing, so one of them stays."""
    rows = rows.filter("conversation IS NOT NULL AND source_key <> ''")
    if seen is not None:
        rows = rows.join(seen.select(*KEYS).distinct(), list(KEYS), "left_anti")
    if not rows.isStreaming:
        first = rows.groupBy(*KEYS).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in KEYS]), "at").alias("_row"))
        return first.select(*[F.col(c) if c in KEYS else F.col(f"_row.{c}") for c in rows.columns])
    if within:
        return rows.withWatermark("at", within).dropDuplicatesWithinWatermark(list(KEYS))
    return rows.dropDuplicates(list(KEYS))
