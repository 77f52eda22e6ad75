"""Comparisons of index settings: grids of settings, and for each entry what its index holds, how well it fits and how long it takes.

`run()` goes through a grid one entry after the other, since it times them, and gives a table (experiment, settings, metric, value).
What is measured comes from whole tables; only one row for each entry reaches the driver.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import zorder as Z
from ..functions.region import UNIT
from ..operators import blocks, cells, learned, medians, metrics, series, updates
from ..operators.growth import Shape
from ..sources.session import prepared, shared_folder
from ..streaming.tree import StoredTree
from . import catalogue as c
from .fixtures import BITS, DAY, START, pe, windows

Measure = Callable[..., dict[str, float]]


def grid(**axes: list) -> list[dict]:
    """All combinations of the axes' values."""
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def _one(df: DataFrame) -> dict[str, float]:
    return {k: float(v or 0) for k, v in df.first().asDict().items()}


def _boxes(spark: SparkSession, sf_dir: str, found: DataFrame) -> dict[str, float]:
    """Blocks, and those that a window meets on average."""
    found = found.checkpoint()
    w = windows(spark, sf_dir)
    met = blocks.blocks_met(found, w, UNIT, BITS).count()
    return {"blocks": float(found.count()), "met_each": met / max(1, w.count())}


def block_ranges(spark, sf_dir, by_code: bool, per_block: int) -> dict[str, float]:
    order = ["z", "id"] if by_code else ["id"]
    return _boxes(spark, sf_dir, blocks.block_ranges(blocks.with_blocks(c._points(spark, sf_dir, "pe"), order, per_block)))


def median_tree(spark, sf_dir, leaf_rows: int) -> dict[str, float]:
    points = c._points(spark, sf_dir, "pe")
    return _boxes(spark, sf_dir, blocks.block_ranges(medians.median_tree(points, leaf_rows)[0]))


def packed_tree(spark, sf_dir, side: int) -> dict[str, float]:
    tiles = blocks.packed_boxes(c._points(spark, sf_dir, "pe"), side, side)
    return _boxes(spark, sf_dir, tiles.withColumn("blk", (F.col("strip") * side + F.col("tile")).cast("long")).drop("strip", "tile"))


def quartered_leaves(spark, sf_dir, leaf_rows: int) -> dict[str, float]:
    """Leaves and their models' mean error interval."""
    points = c._points(spark, sf_dir, "pe")
    meta = cells.leaf_meta(cells.leaves(points, leaf_rows, BITS, c.DEEPEST), UNIT, BITS).checkpoint()
    entries = learned.leaf_positions(cells.assign_leaves(points, meta, BITS)).checkpoint()
    return _fit(entries, learned.linear_models(entries))


def _fit(entries: DataFrame, models: DataFrame) -> dict[str, float]:
    bound = learned.with_bounds(entries, models).checkpoint()
    return {"leaves": float(bound.count())} | _one(metrics.mean_error(bound)) | _one(metrics.expected_lookup_pages(bound))


def recursive_models(spark, sf_dir, leaves: int, edges: bool) -> dict[str, float]:
    points = c._points(spark, sf_dir, "pe")
    models, n = learned.stage_models(points, [1, leaves])
    entries = learned.leaf_positions(learned.sent_through(points, models, [1, leaves], n)).checkpoint()
    return _fit(entries, learned.linear_models(learned.with_edges(entries) if edges else entries))


def networks(spark, sf_dir, hidden: int, steps: int) -> dict[str, float]:
    entries = c._entries(spark, sf_dir, "pe")
    models = learned.network_models(entries, hidden, steps).checkpoint()
    bound = learned.with_bounds(entries, models, learned.network_guess())
    return _one(metrics.mean_error(bound))


def merges(spark, sf_dir, chunks: int, factor: float) -> dict[str, float]:
    """Inserts in `chunks` parts after the first; the mean error interval of the last version, and rows outside their bounds (none)."""
    points = c._points(spark, sf_dir, "pe")
    part = F.pmod(F.xxhash64("id"), F.lit(chunks + 1))
    first = points.where(part == 0)
    meta = cells.leaf_meta(cells.all_leaves(first, c.LEAF_ROWS, BITS, c.DEEPEST), UNIT, BITS).checkpoint()
    version = updates.first_version(first, meta, BITS)
    for k in range(1, chunks + 1):
        version = updates.merged_version(version, points.where(part == k), meta, BITS, factor)
    return _one(metrics.mean_error(version[1])) | _one(learned.violations(*version).agg(F.sum("outside").alias("outside")))


def updating(spark, sf_dir, method: str, chunks: int, factor: float) -> dict[str, float]:
    """Inserts in `chunks` parts after the first by one method: all leaves and models built anew each time (`rebuild`), fixed leaves whose models are refitted
    beyond the factor (`models`), or a tree whose leaves split and whose networks are inherited (`tree`). Leaves, mean error interval, rows outside their bounds (none), and models fitted in all."""
    points = c._points(spark, sf_dir, "pe")
    part = F.pmod(F.xxhash64("id"), F.lit(chunks + 1))
    if method == "tree":
        tree = StoredTree(spark, f"{shared_folder(prepared(spark))}/updating-{uuid.uuid4().hex}", UNIT, Shape(c.LEAF_ROWS, BITS, c.DEEPEST, steps=40, factor=factor))
        fitted = 0
        for k in range(chunks + 1):
            before = tree.latest()
            m = tree.merge(points.where(part == k))
            new = [x for x in m.tables["models"] if m.tables["models"][x] != before.tables.get("models", {}).get(x)]
            old = tree.store.read(before, "models").select("leaf", "w0") if "models" in before.tables else None
            made = tree.store.read(m, "models", new).where(F.col("origin").isin("fitted", "refit"))
            fitted += (made if old is None else made.join(old, ["leaf", "w0"], "left_anti")).count()
        models, outside = tree.table("models").checkpoint(), tree.violations()
    else:
        meta, version, fitted = None, None, 0
        for k in range(chunks + 1):
            rows = points.where(part <= k)
            if meta is None or method == "rebuild":
                meta = cells.leaf_meta(cells.all_leaves(rows, c.LEAF_ROWS, BITS, c.DEEPEST), UNIT, BITS).checkpoint()
                version = updates.first_version(rows, meta, BITS)
                fitted += version[1].count()
            else:
                before, version = version[1], updates.merged_version(version, points.where(part == k), meta, BITS, factor)
                fitted += version[1].select("leaf", "a", "b").exceptAll(before.select("leaf", "a", "b")).count()
        models, outside = version[1], learned.violations(*version)
    return {"leaves": float(models.count()), "fitted": float(fitted)} | _one(metrics.mean_error(models)) | _one(outside.agg(F.sum("outside").alias("outside")))


def forecasts(spark, sf_dir, width: int, model: str, hours: int) -> dict[str, float]:
    """Errors over the last three intervals of `hours`, for a cdf of `width` steps."""
    interval = hours * 3600
    span = 1 << (2 * (BITS - c.KEY_DEPTH))
    rows = pe(spark, sf_dir).withColumns({"cell": F.shiftright("z", 2 * (BITS - c.KEY_DEPTH)), "time_id": series.time_id(F.col("t"), START, interval)})
    rows = rows.withColumns({"low": F.col("cell") * span, "high": (F.col("cell") + 1) * span})
    last = c.DAYS * DAY // interval - 1
    s = series.filled_series(series.cdf_series(rows, "cell", "low", "high", width), "cell", last).withColumn("max_key", F.greatest(F.col("n") - 1, F.lit(0))).checkpoint()
    error = series.forecast_error(series.forecast(s.where(F.col("time_id") <= last - 3), "cell", 7, 3, model, "es"), s.where(F.col("time_id") > last - 3), "cell")
    return _one(error.agg(F.avg("cdf_mae").alias("cdf_mae"), F.avg("max_key_mae").alias("max_key_mae")))


def build_partitions(spark, sf_dir, partitions: int) -> dict[str, float]:
    """The leaf models' build over this many shuffle partitions."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions))
    try:
        return quartered_leaves(spark, sf_dir, c.LEAF_ROWS)
    finally:
        spark.conf.set(name, before)


def codecs(spark, sf_dir, codec: str) -> dict[str, float]:
    """One codec over all points."""
    x, y, z, h = F.col("x"), F.col("y"), F.col("z"), Z.geohash32(F.col("x"), F.col("y"))
    made = {
        "encode": Z.encode(x, y, UNIT, BITS), "encode_truncated": Z.encode(x, y, UNIT, BITS, truncate=True), "decode": F.struct(*Z.decode(z, UNIT, BITS, 5)),
        "neighbours": Z.neighbours(z, BITS), "bits": Z.geohash_bits(x, y), "base32": h, "base32_decode": F.struct(*Z.geohash32_decode(h)),
    }[codec]
    points = c._points(spark, sf_dir, "pe")
    points.select("id", made.alias("made")).write.format("noop").mode("overwrite").save()
    return {"rows": float(points.count())}


def answers(spark, sf_dir, path: str) -> dict[str, float]:
    """One registered query: the rows it gives."""
    return {"rows": float(c.QUERIES[path](spark, sf_dir).count())}


#: Experiments by name: what each entry measures, and the entries.
EXPERIMENTS: dict[str, tuple[Measure, list[dict]]] = {
    "block_ranges": (block_ranges, grid(by_code=[False], per_block=[100, 400, 1600]) + grid(by_code=[True], per_block=[100, 400, 1600, 6400])),
    "median_tree": (median_tree, grid(leaf_rows=[50, 100, 250, 500])),
    "packed_tree": (packed_tree, grid(side=[4, 8, 16])),
    "quartered_leaves": (quartered_leaves, grid(leaf_rows=[50, 100, 250, 500])),
    "recursive_models": (recursive_models, grid(leaves=[16, 64, 256], edges=[False, True])),
    "networks": (networks, grid(hidden=[8, 16], steps=[60, 300])),
    "merges": (merges, grid(chunks=[5], factor=[1.0, 1.5, 2.0])),
    "updating": (updating, grid(method=["rebuild"], chunks=[5], factor=[1.0]) + grid(method=["models", "tree"], chunks=[5], factor=[1.0, 1.5, 2.0])),
    "forecasts": (forecasts, grid(width=[10, 50], model=["last", "es", "var", "sarima", "gru"], hours=[24])),
    "build_partitions": (build_partitions, grid(partitions=[1, 8, 64])),
    "codecs": (codecs, grid(codec=["encode", "encode_truncated", "decode", "neighbours", "bits", "base32", "base32_decode"])),
    "paths": (answers, grid(path=["point_query_exact", "point_query_brin", "point_query_learned", "point_query_staged", "range_query_cells", "range_query_brin", "range_query_leaves", "range_query_predicted_buckets", "knn_join", "knn_brin", "knn_main_and_delta"])),
}


def run(spark: SparkSession, sf_dir: str, name: str, times: int = 1, entries: list[dict] | None = None) -> DataFrame:
    """(experiment, settings, metric, value) of a grid, `entries` in place of its own if given; `seconds` is a metric, the mean of `times` runs."""
    measure, own = EXPERIMENTS[name]
    out = []
    for entry in own if entries is None else entries:
        found: list[dict[str, float]] = []
        seconds = metrics.timed(lambda: found.append(measure(spark, sf_dir, **entry)), times, trim=times > 2)  # noqa: B023
        out += [(name, json.dumps(entry, sort_keys=True), metric, value) for metric, value in (found[-1] | {"seconds": seconds}).items()]
    return spark.createDataFrame(out, "experiment string, settings string, metric string, value double")
