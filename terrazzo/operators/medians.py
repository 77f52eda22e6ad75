"""Exact medians of very many groups at once, and the tree of halves that they make.

A group's value at a rank is found by histograms: rows between the bounds known so far are counted in bins, the bin that holds the rank gives
narrower bounds, its own least and greatest value, until they meet. A round reads the rows once and shuffles a few numbers
for each group; no large group is sorted or collected, nothing is sampled, and all groups of a level go together. A tree's nodes are halved so
until they have TASK_ROWS rows or fewer; from there a node's rows lie in one task, which halves them down to the leaves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.session import prepared, read_back

BINS = 1024
#: Rows that are sorted for a group at once.
SMALL = 256
#: A table with a row for each group is broadcast up to so many (about 50 bytes each). More groups than that are of like size, so none is a hot key.
BROADCAST_GROUPS = 200_000
#: While there are fewer groups than this, each has more bins, and more rows of it are sorted, by as much.
FEW_GROUPS = 64
#: Rows of a node that one task halves down to its leaves (about 50 bytes each).
TASK_ROWS = 1 << 17
#: Levels after which the rows' nodes are written down.
WRITTEN_LEVELS = 6


def _met(rows: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    return rows.join(F.broadcast(groups) if count <= BROADCAST_GROUPS else groups, "grp")


def rows_at_ranks(rows: DataFrame, ranks: DataFrame, groups: int) -> DataFrame:
    """(grp, v, id) for rows (grp, v, id) and ranks (grp, rank from 0), one for each of `groups` groups: the row at the rank in order of v, then id.

    Where the bounds hold SMALL rows or fewer (more while groups are few), these are sorted at once; where more rows than that share one v, the search goes on by id.
    """
    columns = ["grp", "rank", "lo", "hi", "n"]
    state = _met(rows, ranks, groups).groupBy("grp", "rank").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).select(*columns).checkpoint()
    wider = max(1, FEW_GROUPS // max(1, groups))
    nbins = BINS * wider
    many = F.col("n") > SMALL * wider
    apart = F.col("lo") < F.col("hi")
    within = lambda found: _met(rows, found, groups).where(F.col("v").between(F.col("lo"), F.col("hi")))
    while True:
        left, tied = state.agg(F.count_if(many & apart), F.count_if(many & ~apart)).first()
        if not left:
            break
        share = (F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
        bins = within(state.where(many & apart).drop("n")).groupBy("grp", "rank", F.least(F.lit(nbins - 1), F.floor(share * nbins)).alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("grp").orderBy("bin"))  # a row for each bin of a group
        found = bins.withColumn("_upto", upto).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("n")))
        found = found.withColumn("rank", F.col("rank") - F.col("_upto") + F.col("n"))
        state = state.where(~(many & apart)).unionByName(found.select(*columns)).checkpoint()
    few = within(state.where(~many).drop("n")).groupBy("grp", "rank").agg(F.sort_array(F.collect_list(F.struct("v", "id"))).alias("_all"))
    out = few.select("grp", F.get("_all", F.col("rank")).alias("_r")).select("grp", "_r.v", "_r.id")
    if not tied:
        return out
    same = state.where(many)
    ids = rows_at_ranks(within(same.drop("n", "rank")).select("grp", F.col("id").alias("v"), "id"), same.select("grp", "rank"), groups)
    return out.unionByName(same.select("grp", F.col("lo").alias("v")).join(ids.select("grp", "id"), "grp"))


def median_tree(points: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, splits): `points` (id, x, y, ...) with `blk`, their leaf, and (node, level, v, id), the last row of each node's first half.

    Nodes are halved in order of x and y in turn, rows with one value in order of id, down to leaves of at most `most` rows; a node's halves are
    2 * node and 2 * node + 1, and differ by one row at most, so all leaves lie on one level.
    """
    prepared(points.sparkSession)
    n = points.count()
    levels = max(0, math.ceil(math.log2(max(1, n / most))))
    rows = points.withColumn("blk", F.lit(1).cast("long"))
    splits = points.sparkSession.createDataFrame([], "node long, level int, v double, id long")
    sizes = points.sparkSession.createDataFrame([(1, n)], "grp long, n long")
    first = min(levels, max(0, math.ceil(math.log2(max(1, n / TASK_ROWS)))))
    for level in range(first):
        axis = "xy"[level % 2]
        nodes = 1 << level
        ranks = sizes.select("grp", F.expr("(n + 1) div 2 - 1").alias("rank"))
        at = rows_at_ranks(rows.select(F.col("blk").alias("grp"), F.col(axis).cast("double").alias("v"), "id"), ranks, nodes)
        at = read_back(at)  # the next level's rows are met with it, and its own ranks come from them
        splits = splits.unionByName(at.select(F.col("grp").alias("node"), F.lit(level).alias("level"), "v", "id"))
        cut = at.select(F.col("grp").alias("blk"), F.col("v").alias("_v"), F.col("id").alias("_id"))
        upper = (F.col(axis) > F.col("_v")) | ((F.col(axis) == F.col("_v")) & (F.col("id") > F.col("_id")))
        rows = rows.join(F.broadcast(cut) if nodes <= BROADCAST_GROUPS else cut, "blk").select(*points.columns, (2 * F.col("blk") + upper.cast("long")).alias("blk"))
        sizes = sizes.select(F.explode(F.array(F.struct((2 * F.col("grp")).alias("grp"), F.expr("(n + 1) div 2").alias("n")), F.struct((2 * F.col("grp") + 1).alias("grp"), F.expr("n div 2").alias("n")))).alias("_s")).select("_s.*")
        if level % WRITTEN_LEVELS == WRITTEN_LEVELS - 1:
            rows, sizes = rows.checkpoint(), sizes.checkpoint()
    if first < levels:
        rows, below = _halved(rows, first, levels)
        splits = splits.unionByName(below)
    return rows, splits


def _halved(rows: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """(rows, splits) from the nodes of level `first` to those of level `last`. A task has a node of TASK_ROWS rows at most, and marks in `_cuts` the levels, from the lowest bit, at which a row is the last of a first half."""

    def halve(node: pa.Table) -> pa.Table:
        values = [node[c].to_numpy().astype(float) for c in "xy"]
        ids, blk = node["id"].to_numpy(), node["blk"].to_numpy().astype(np.int64)
        cuts = np.zeros(len(blk), np.int64)
        for level in range(first, last):
            order = np.lexsort((ids, values[level % 2], blk))
            at = blk[order]
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            size = np.diff(np.r_[begin, len(at)])
            half = (size + 1) // 2
            cuts[order[begin + half - 1]] |= 1 << (level - first)
            blk[order] = 2 * at + (np.arange(len(at)) - np.repeat(begin, size) >= np.repeat(half, size))
        return node.set_column(node.column_names.index("blk"), "blk", pa.array(blk)).append_column("_cuts", pa.array(cuts))

    schema = rows.withColumn("_cuts", F.lit(0).cast("long")).schema
    done = rows.groupBy("blk").applyInArrow(halve, schema).checkpoint()
    level = F.col("level")
    cut = done.where("_cuts <> 0").withColumn("level", F.explode(F.filter(F.sequence(F.lit(first), F.lit(last - 1)), lambda d: F.call_function("shiftright", F.col("_cuts"), d - first).bitwiseAND(F.lit(1).cast("long")) == 1)))
    value = F.when(level % 2 == 0, F.col("x")).otherwise(F.col("y")).cast("double")
    return done.drop("_cuts"), cut.select(F.call_function("shiftright", F.col("blk"), F.lit(last) - level).alias("node"), "level", value.alias("v"), "id")


def located(places: DataFrame, splits: DataFrame, x: Column, y: Column) -> DataFrame:
    """`places` with `blk`, a leaf of the tree that the place may lie in: down the levels, to the first half where it could be in either."""
    out = places.withColumns({"_x": x, "_y": y, "blk": F.lit(1).cast("long")})
    last = splits.agg(F.max("level"), F.count("*")).first()
    for level in range(-1 if last[0] is None else last[0] + 1):
        at = splits.where(F.col("level") == level).select(F.col("node").alias("blk"), F.col("v").alias("_v"))
        value = F.col("_x") if level % 2 == 0 else F.col("_y")
        met = out.join(F.broadcast(at) if last[1] <= BROADCAST_GROUPS else at, "blk")
        out = met.withColumn("blk", 2 * F.col("blk") + (value > F.col("_v")).cast("long")).drop("_v")
    return out.drop("_x", "_y")
