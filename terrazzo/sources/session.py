"""The folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """`spark` with a checkpoint folder: the one its settings name. Where they name none, a temporary one if driver
    and executors are one process; on a cluster, where they share no temporary folder, an error says what to set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="terrazzo-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The URI of the checkpoint folder of this session."""
    return prepared(spark).sparkContext._jsc.sc().getCheckpointDir().get()


def read_back(table: DataFrame) -> DataFrame:
    """`table` as written to the shared folder and read from there, so that plans go on from its true size.

    A checkpoint keeps the estimate of the plan that it came from, and a join's estimate is the product of both sides': where each round joins
    what the one before gave, the estimate has several times as many digits from round to round, until the driver can't hold it.
    """
    path = f"{shared_folder(table.sparkSession)}/read-back-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


#: Shuffle files go with the query that made them.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def releasing(method: Callable) -> Callable:
    """A method of something with `spark` that has written all that it gives when it returns: what its steps kept on disk goes then at the latest.

    Spark drops shuffle files and, with spark.cleaner.referenceTracking.cleanCheckpoints, checkpoints that nothing refers to any more, but only when the
    driver happens to collect its garbage; until then those of one merge lie beside the next one's.
    """

    @wraps(method)
    def run(self, *args, **kwargs):
        conf = self.spark.conf
        before = conf.get(SHUFFLES_GO, "false")
        conf.set(SHUFFLES_GO, "true")
        try:
            return method(self, *args, **kwargs)
        finally:
            conf.set(SHUFFLES_GO, before)
            gc.collect()
            self.spark._jvm.System.gc()

    return run
