"""Costs and sizes that an index reports."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_BYTES, ID_ENTRY_BYTES = 28, 20
ENTRIES_PER_PAGE, ID_ENTRIES_PER_PAGE = 4096 // ENTRY_BYTES, 4096 // ID_ENTRY_BYTES


def pages(rows: Column, per_page: int = ENTRIES_PER_PAGE) -> Column:
    return F.ceil(rows / per_page).cast("long")


def leaf_pages(met: DataFrame) -> DataFrame:
    """(qid, leaves, pages) that range queries read, from leaves_met()."""
    return met.groupBy("qid").agg(F.count("*").alias("leaves"), F.sum(pages(F.col("n"))).alias("pages"))


def index_size(entries: DataFrame, structure: DataFrame, structure_bytes: int, entry_bytes: int = ENTRY_BYTES) -> DataFrame:
    """(entries, entry_bytes, structure_rows, structure_bytes) in one row."""
    a = entries.agg(F.count("*").alias("entries")).withColumn("entry_bytes", F.col("entries") * entry_bytes)
    b = structure.agg(F.count("*").alias("structure_rows")).withColumn("structure_bytes", F.col("structure_rows") * structure_bytes)
    return a.join(F.broadcast(b))  # one row each


def mean_error(models: DataFrame) -> DataFrame:
    return models.agg(F.avg(F.col("max_err") - F.col("min_err")).alias("mean_error"))


def expected_lookup_pages(models: DataFrame) -> DataFrame:
    """Pages a lookup reads on average, each leaf weighing as many as its rows."""
    p = pages(F.col("max_err") - F.col("min_err") + 1)
    return models.agg((F.sum(p * F.col("n")) / F.sum("n")).alias("pages"))


def timed(run: Callable[[], object], times: int = 5, trim: bool = False) -> float:
    """Mean seconds of `times` runs, without the fastest and slowest if `trim`."""
    took = []
    for _ in range(times):
        t = time.perf_counter()
        run()
        took.append(time.perf_counter() - t)
    return statistics.mean(sorted(took)[1:-1] if trim and times > 2 else took)
