"""Timed inserts as a stream: points arrive, and each closed interval is merged into a new version.

A micro-batch appends its rows, with their code, to the delta under its batch number and their interval, so a batch
that is run again replaces its own rows, and what intervals there are is known from the folders' names. Then each interval before the latest one seen is closed: counts and
distributions by leaf are taken and written as version time_id. Late rows are never dropped: they join the
delta, and the version of their interval is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.region import Region
from ..operators import cells, prep, series, updates


class TimedIndex:
    """State of a timed index in `folder`, a path that all executors share: delta/batch=N and series/time_id=N.

    meta: a leaf table that covers the region, as all_leaves() gives it, so that any point has a leaf.
    """

    def __init__(self, spark: SparkSession, folder: str, meta: DataFrame, region: Region, bits: int, start: int, interval: int, width: int = 20):
        self.spark, self.folder, self.meta, self.region, self.bits = spark, folder, meta, region, bits
        self.start, self.interval, self.width = start, interval, width

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def delta(self, batch: int | None = None) -> DataFrame:
        """All rows taken so far, or one batch's; time_id is a folder's name, so a filter on it reads those folders alone."""
        where = f"{self.folder}/delta" if batch is None else f"{self.folder}/delta/batch={batch}"
        return self.spark.read.schema("id long, x double, y double, t long, z long, time_id long").option("basePath", f"{self.folder}/delta").parquet(where).drop("batch")

    def _intervals(self, rows: DataFrame) -> set[int]:
        """The intervals of rows kept by interval: one number each."""
        return {r[0] for r in rows.select("time_id").distinct().collect()}

    def closed(self) -> DataFrame:
        """(leaf, n, cdf, time_id) of all closed intervals."""
        return self.spark.read.parquet(f"{self.folder}/series")

    def insert(self, points: DataFrame, batch: int) -> None:
        """Take one micro-batch of (id, x, y, t)."""
        rows = prep.coded(points, self.region, self.bits).withColumn("time_id", series.time_id(F.col("t"), self.start, self.interval))
        rows.select("id", "x", "y", "t", "z", "time_id").write.mode("overwrite").partitionBy("time_id").parquet(f"{self.folder}/delta/batch={batch}")
        every = self._intervals(self.delta())
        done = self._intervals(self.closed()) if self._exists("series") else set()
        self._close({t for t in (every - done) | self._intervals(self.delta(batch)) if t < max(every)})

    def _close(self, due: set[int]) -> None:
        if not due:
            return
        rows = self.delta().where(F.col("time_id").isin(*due))
        at = cells.assign_leaves(rows, self.meta, self.bits).join(self.meta.select("leaf", "value", (F.col("value") + F.col("value_diff")).alias("end")), "leaf")
        out = series.cdf_series(at, "leaf", "value", "end", self.width)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time_id").parquet(f"{self.folder}/series")

    def predict(self, lag: int, steps: int, cdf_model: str = "var", count_model: str = "es") -> DataFrame:
        """(leaf, time_id, cdf, max_key) for the `steps` intervals after the last closed one; leaves without rows so far get zeros."""
        last = self.closed().agg(F.max("time_id")).first()[0]
        past = series.filled_series(self.closed().select("leaf", F.col("time_id").cast("long").alias("time_id"), "n", "cdf"), "leaf", last)
        known = series.forecast(past.withColumn("max_key", F.greatest(F.col("n") - 1, F.lit(0))), "leaf", lag, steps, cdf_model, count_model)
        new = self.meta.select("leaf").join(past.select("leaf").distinct(), "leaf", "left_anti")
        return known.unionByName(series.empty_forecast(new, "leaf", last + 1, steps, self.width))

    def bucketed_delta(self, forecasts: DataFrame) -> DataFrame:
        """The delta with leaf and the bucket that a forecast lays out for each row; 0 where none was made."""
        return updates.with_buckets(cells.assign_leaves(self.delta(), self.meta, self.bits), self.meta, forecasts, self.width)

    def finish(self) -> None:
        """Close the latest interval too."""
        self._close({max(self._intervals(self.delta()), default=None)} - {None})


def run_stream(source: DataFrame, index: TimedIndex, checkpoint: str) -> StreamingQuery:
    """Start taking a streaming DataFrame (id, x, y, t); all that is there now, then it stops."""
    return source.writeStream.foreachBatch(lambda df, n: index.insert(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(source: DataFrame, region: Region, bits: int, depth: int, interval: str, late: str) -> DataFrame:
    """Counts by coarse cell and time window of a stream (ts, x, y), complete once `late` has passed."""
    from ..functions import zorder as Z

    cell = Z.prefix(Z.encode(F.col("x"), F.col("y"), region, bits), bits, depth).alias("cell")
    return source.withWatermark("ts", late).groupBy(F.window("ts", interval), cell).agg(F.count("*").alias("n"))
