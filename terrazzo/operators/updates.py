"""Inserts: delta blocks, merges that touch only the leaves that changed, and buckets laid out ahead by forecast.

Tables are never changed in place: an insert is a union, a merge writes a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import zorder as Z
from ..functions.region import Region
from . import blocks, cells, learned, series


def inserted(main: DataFrame, delta: DataFrame) -> DataFrame:
    """What every query reads: main rows and those not merged yet."""
    return main.unionByName(delta.select(*main.columns))


def delta_blocks(delta: DataFrame, order: list[str], per_block: int, merge_at: int) -> DataFrame:
    """(blk, n, sealed, outdated, bottom, up, left, right) of rows in order of arrival. A block is sealed, and
    so has a box, at per_block rows; with merge_at blocks or more the sealed ones are outdated: due for a merge."""
    rows = blocks.with_blocks(delta, order, per_block)
    found = blocks.block_ranges(rows)
    sealed = F.col("n") >= per_block
    many = found.agg((F.count("*") >= merge_at).alias("outdated"))
    out = found.join(F.broadcast(many))  # one row
    boxes = [F.when(sealed, F.col(c)).alias(c) for c in ("bottom", "up", "left", "right")]
    return out.select("blk", "n", sealed.alias("sealed"), (sealed & F.col("outdated")).alias("outdated"), *boxes)


def touched_leaves(meta: DataFrame, delta: DataFrame, bits: int) -> DataFrame:
    """`meta` of the leaves that take rows of `delta`."""
    return meta.join(cells.assign_leaves(delta, meta, bits).select("leaf").distinct(), "leaf", "left_semi")


def merged_leaves(main: DataFrame, delta: DataFrame, most: int, bits: int, deepest: int, region: Region) -> DataFrame:
    """Leaf table after a merge."""
    return cells.leaf_meta(cells.leaves(inserted(main, delta), most, bits, deepest), region, bits)


def refreshed_models(old: DataFrame, entries: DataFrame, changed: DataFrame, factor: float) -> DataFrame:
    """Models after a merge: leaves of `changed` get new bounds over all their rows, and are fitted anew where the
    interval grew beyond `factor` times its old width or the leaf is new; others stay as they are."""
    mine = entries.join(changed.select("leaf").distinct(), "leaf", "left_semi")
    kept = old.join(changed.select("leaf").distinct(), "leaf", "left_anti")
    known = old.join(changed.select("leaf").distinct(), "leaf", "left_semi")
    rebound = learned.with_bounds(mine, known.drop("min_err", "max_err"))
    sizes = mine.groupBy("leaf").agg(F.count("*").alias("_n"))
    rebound = rebound.join(sizes, "leaf").withColumn("n", F.col("_n")).select(*old.columns)
    worse = learned.stale(known, rebound, factor)
    fresh_of = mine.join(rebound.select("leaf").join(worse, "leaf", "left_anti"), "leaf", "left_anti")
    fresh = learned.with_bounds(fresh_of, learned.linear_models(fresh_of)).select(*old.columns)
    return kept.unionByName(rebound.join(worse, "leaf", "left_anti")).unionByName(fresh)


def gap_sizes(models: DataFrame, empty_ratio: float) -> DataFrame:
    """(leaf, n, gaps): the empty slots that an in-place layout keeps in each leaf, in proportion to its error interval."""
    return models.select("leaf", "n", F.ceil((F.col("max_err") - F.col("min_err")) * F.lit(empty_ratio)).cast("long").alias("gaps"))


def predicted_bucket(low: str, high: str, width: int) -> Column:
    return series.predicted_bucket(F.col("z"), F.col(low), F.col(high), F.col("cdf"), F.col("max_key"), width)


def with_buckets(delta: DataFrame, meta: DataFrame, forecasts: DataFrame, width: int) -> DataFrame:
    """`delta` (with leaf, time_id) with `bucket`, by the forecast of its leaf and interval; 0 without one."""
    m = meta.select("leaf", "value", (F.col("value") + F.col("value_diff")).alias("_end"))
    out = delta.join(m, "leaf").join(forecasts.select("leaf", "time_id", "cdf", "max_key"), ["leaf", "time_id"], "left")
    return out.withColumn("bucket", F.coalesce(predicted_bucket("value", "_end", width), F.lit(0).cast("long"))).select(*delta.columns, "bucket")


def range_query_buckets(delta: DataFrame, meta: DataFrame, forecasts: DataFrame, windows: DataFrame, region: Region, bits: int, width: int) -> DataFrame:
    """(qid, id) of `delta` rows (leaf, time_id, bucket, ...) in the windows. Buckets never fall as codes rise, so in
    each leaf that a window meets only those between its first and last code's buckets are read."""
    corner = lambda x, y: Z.encode(F.col(x), F.col(y), region, bits)
    m = meta.select("leaf", "value", (F.col("value") + F.col("value_diff")).alias("_end"))
    groups = cells.together(windows, ["bottom", "up", "left", "right"])
    met = cells.leaves_met(meta, groups, region, bits).select("_qids", "leaf", "bottom", "up", "left", "right").join(m, "leaf")
    met = met.withColumns({"_lo": F.greatest("value", corner("left", "bottom")), "_hi": F.least(F.col("_end") - 1, corner("right", "up"))})
    met = met.join(forecasts.select("leaf", "time_id", "cdf", "max_key"), "leaf", "left")
    at = lambda c: F.coalesce(series.predicted_bucket(F.col(c), F.col("value"), F.col("_end"), F.col("cdf"), F.col("max_key"), width), F.lit(0).cast("long"))
    met = met.select("_qids", "leaf", F.col("time_id").alias("_t"), "bottom", "up", "left", "right", at("_lo").alias("_from"), at("_hi").alias("_to"))
    rows = delta.select("leaf", "time_id", "bucket", "id", "x", "y").join(met, "leaf").where(F.col("_t").isNull() | (F.col("_t") == F.col("time_id")))
    return rows.where(F.col("bucket").between(F.col("_from"), F.col("_to")) & G.contains(G.Box.of(), F.col("x"), F.col("y"))).select(F.explode("_qids").alias("qid"), "id")


def first_version(rows: DataFrame, meta: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(entries, models) of a table: rows with leaf and place, and a model with bounds for each leaf."""
    entries = learned.leaf_positions(cells.assign_leaves(rows, meta, bits)).checkpoint()
    return entries, learned.with_bounds(entries, learned.linear_models(entries)).checkpoint()


def merged_version(version: tuple[DataFrame, DataFrame], delta: DataFrame, meta: DataFrame, bits: int, factor: float) -> tuple[DataFrame, DataFrame]:
    """The version after a merge of `delta`: only leaves that take rows are numbered anew, and get new bounds or, where
    those grew beyond `factor` times the old width, a new model. Other leaves' rows and models stay."""
    entries, models = version
    new = cells.assign_leaves(delta, meta, bits).checkpoint()
    touched = new.select("leaf").distinct().checkpoint()
    mine = entries.join(touched, "leaf", "left_semi").select(*new.columns)
    after = entries.join(touched, "leaf", "left_anti").unionByName(learned.leaf_positions(mine.unionByName(new))).checkpoint()
    return after, refreshed_models(models, after, touched, factor).checkpoint()


def point_query_with_delta(main: DataFrame, delta: DataFrame, probes: DataFrame) -> DataFrame:
    """(qid, id) of probes (qid, qx, qy, leaf, bucket): the main leaf, and of the delta one bucket. A row of a bucket has
    its own code's bucket, so no row at the probe's place is in another."""
    p = probes.select("qid", "leaf", "bucket", F.col("qx").alias("x"), F.col("qy").alias("y"))
    return main.join(p.drop("bucket"), ["leaf", "x", "y"]).select("qid", "id").unionByName(delta.join(p, ["leaf", "bucket", "x", "y"]).select("qid", "id"))
