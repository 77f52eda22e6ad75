"""Trees that live in a folder: merges against rebuilds, versions against a killed run, blocks against plain search."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

from terrazzo.functions.region import UNIT
from terrazzo.operators import blocks, cells, growth, learned, medians, prep, search
from terrazzo.operators.growth import Shape
from terrazzo.sources import datasource
from terrazzo.sources.versions import Manifest, Versions
from terrazzo.streaming.tree import BufferedTree, StoredTree, TimedTree

BITS = 8
SHAPE = Shape(40, BITS, 5, hidden=4, steps=15)


@pytest.fixture(scope="module")
def points(spark):
    """Points in a corner, along a line, and many at one place."""
    rows = [(i, ((i * 37) % 101) / 202, ((i * 53) % 97) / 194, i) for i in range(300)] + [(300 + i, 0.9, i / 100, i) for i in range(100)] + [(400 + i, 0.7, 0.7, 50 + i) for i in range(70)]
    return prep.coded(spark.createDataFrame(rows, "id long, x double, y double, t long"), UNIT, BITS).checkpoint()


def leaves_of(df):
    return {(r.depth, r.cell, r.n) for r in df.select("depth", "cell", "n").collect()}


def rebuilt(points):
    return leaves_of(cells.all_leaves(points, SHAPE.most, BITS, SHAPE.deepest))


def places(points):
    meta = growth.with_meta(cells.all_leaves(points, SHAPE.most, BITS, SHAPE.deepest).withColumn("leaf", cells.leaf_number(F.col("depth"), F.col("cell"))), BITS)
    return {tuple(r) for r in learned.leaf_positions(cells.assign_leaves(points, meta, BITS)).select("id", "leaf", "pos").collect()}


def test_merges_and_deletes_equal_rebuilds(spark, points, tmp_path):
    tree = StoredTree(spark, str(tmp_path), UNIT, SHAPE)
    parts = [points.where("t < 60"), points.where("t >= 60 AND t < 200"), points.where("t >= 200")]
    networks = []
    for part in parts:
        tree.merge(part)
        networks.append({r.origin for r in tree.table("models").select("origin").collect()})
        assert tree.violations().agg(F.sum("outside")).first()[0] == 0
    assert leaves_of(tree.table("leaves")) == rebuilt(points)
    assert {tuple(r) for r in tree.table("entries").select("id", "leaf", "pos").collect()} == places(points)
    assert "inherited" in set().union(*networks[1:])
    gone = points.where("x < 0.3 OR y > 0.7")
    tree.merge(points.limit(0), gone)
    left = points.where("NOT (x < 0.3 OR y > 0.7)")
    assert leaves_of(tree.table("leaves")) == rebuilt(left)
    assert {tuple(r) for r in tree.table("entries").select("id", "leaf", "pos").collect()} == places(left)
    assert tree.violations().agg(F.sum("outside")).first()[0] == 0
    # earlier versions are as they were
    assert leaves_of(tree.table("leaves", tree.store.at(1))) == rebuilt(parts[0])
    tree.merge(points.limit(0), left)
    assert leaves_of(tree.table("leaves")) == {(0, 0, 0)} and tree.table("entries").count() == 0


def test_a_merge_leaves_other_parts_alone_and_trains_few(spark, points, tmp_path):
    tree = StoredTree(spark, str(tmp_path), UNIT, SHAPE, coarse=1)
    tree.merge(points)
    before = tree.latest()
    more = prep.coded(spark.createDataFrame([(900 + i, 0.1 + i / 1000, 0.2, 9) for i in range(30)], "id long, x double, y double, t long"), UNIT, BITS)
    after = tree.merge(more)
    for name in ("leaves", "entries", "models"):
        changed = {k for k in after.tables[name] if after.tables[name][k] != before.tables[name].get(k)}
        assert changed == {"0"} and len(after.tables[name]) > 1  # the low quarter
    old, new = ({r.leaf: r.w0 for r in tree.table("models", m).collect()} for m in (before, after))
    origins = [r.origin for r in tree.table("models", after).where(F.col("leaf") != 0).collect()]
    assert len(set(new) - set(old)) > 0 and sum(o in ("kept", "inherited") for o in origins) > 0
    # what is read of the version before are that part's files alone
    read = tree.store.read(before, "entries", ["0"]).inputFiles()
    assert read and all(any(p in f for p in before.tables["entries"]["0"]) for f in read)


def test_a_quarter_of_a_network_is_the_network():
    import numpy as np

    rng = np.random.default_rng(2)
    net = (rng.normal(size=5), rng.normal(size=5), rng.normal(size=5), 0.3)
    value = lambda n, u: float(np.maximum(n[0] * u + n[1], 0) @ n[2] + n[3])
    part = learned.network_part(*net, 0.375, 0.4375)
    low, high = value(net, 0.375), value(net, 0.4375)
    for u in np.linspace(0, 1, 7):
        assert low + (high - low) * value(part, u) == pytest.approx(value(net, 0.375 + u / 16))


def test_a_version_is_there_as_a_whole(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    assert store.at() is None and store.numbers() == []
    m = Manifest(0, {"a": store.put(spark.range(3).withColumn("p", F.col("id") % 2), "p")}, {"a": "id long, p long"}, {"x": 1})
    assert store.at() is None
    store.commit(m)
    assert {r.id for r in store.read(store.at(), "a").collect()} == {0, 1, 2} and {r.id for r in store.read(m, "a", ["1"]).collect()} == {1}
    assert store.at(0).facts == {"x": 1} and store.read(m, "a", ["9"]).count() == 0
    with pytest.raises(Exception):  # noqa: B017  the number is taken
        store.commit(Manifest(0))


class Killed(Exception):
    pass


def timed(spark, folder):
    return TimedTree(spark, folder, UNIT, SHAPE, 0, 100, key_depth=1, width=4, horizon=1, cdf_model="last", count_model="last")


def state(tree):
    m = tree.latest()
    entries = {tuple(r) for r in tree.table("entries", m).select("id", "leaf", "pos").collect()}
    return leaves_of(tree.table("leaves", m)), entries, {tuple(r) for r in tree.report().collect()}, {(r.cell, r.time_id, r.max_key) for r in tree.store.read(m, "forecasts").collect()}


def test_a_stream_killed_between_writes_gives_the_same(spark, points, tmp_path, monkeypatch):
    batches = [points.where("t < 120").select("id", "x", "y", "t"), points.where("t >= 120").select("id", "x", "y", "t")]

    def run(tree):
        for k, b in enumerate(batches):
            tree.insert(b, k)
        tree.finish()

    calm = timed(spark, f"{tmp_path}/calm")
    run(calm)
    want = state(calm)
    assert leaves_of(calm.table("leaves")) == rebuilt(points) and want[1] == places(points)
    assert {r[0]: r[1] for r in want[2]} == {t: sum(1 for r in points.collect() if r.t // 100 == t) for t in range(3)}
    put, commit = Versions.put, Versions.commit
    left = [0]

    def counted(f):
        def g(*a, **k):
            if not left[0]:
                raise Killed
            left[0] -= 1
            return f(*a, **k)

        return g

    monkeypatch.setattr(Versions, "put", counted(put))
    monkeypatch.setattr(Versions, "commit", counted(commit))
    for attempt in (1, 3, 5, 8, 10, 11, 30, 60):
        left[0] = attempt
        try:
            run(timed(spark, f"{tmp_path}/killed"))
            break
        except Killed:
            continue
    left[0] = 1000
    assert attempt > 10 and state(timed(spark, f"{tmp_path}/killed")) == want


def test_late_rows_are_merged_with_the_next_interval(spark, points, tmp_path):
    tree = timed(spark, str(tmp_path))
    late = F.col("id") % 7 == 0
    for k, b in enumerate([points.where(~late & (F.col("t") < 150)), points.where(late), points.where(~late & (F.col("t") >= 150))]):
        tree.insert(b.select("id", "x", "y", "t"), k)
        tree.insert(b.select("id", "x", "y", "t"), k)  # a batch that comes again
    # queries read what is merged and what isn't
    assert tree.latest().tables["open"] and tree.table("entries").count() < points.count()
    w = spark.createDataFrame([(0, 0.2, 0.8, 0.1, 0.75)], "qid long, bottom double, up double, left double, right double")
    rows = points.collect()
    assert sorted(r.id for r in tree.range_query(w).collect()) == sorted(r.id for r in rows if 0.2 <= r.y <= 0.8 and 0.1 <= r.x <= 0.75)
    q = spark.createDataFrame([(0, 0.9, 0.5, 30)], "qid long, qx double, qy double, k int")
    assert {r.id for r in tree.knn_query(q).collect()} == {r.id for r in sorted(rows, key=lambda r: ((r.x - 0.9) ** 2 + (r.y - 0.5) ** 2, r.id))[:30]}
    assert {r.id for r in tree.point_query(q).collect()} == {r.id for r in rows if (r.x, r.y) == (0.9, 0.5)}
    tree.finish()
    assert tree.table("entries").count() == points.count() and leaves_of(tree.table("leaves")) == rebuilt(points)
    assert {r.time_id: r.rows for r in tree.report().collect()} == {r.t: r.n for r in points.groupBy(F.expr("t div 100").alias("t")).agg(F.count("*").alias("n")).collect()}


def test_blocks_are_searched_sealed_open_and_compacted(spark, points, tmp_path):
    tree = BufferedTree(spark, str(tmp_path), UNIT, SHAPE, per_block=50, merge_at=3)
    windows = spark.createDataFrame([(0, 0.2, 0.5, 0.1, 0.4), (1, 0.0, 1.0, 0.0, 1.0), (2, 0.7, 0.7, 0.7, 0.7)], "qid long, bottom double, up double, left double, right double")
    near = spark.createDataFrame([(0, 0.3, 0.3, 9), (1, 0.7, 0.7, 100), (2, 2.0, 2.0, 1000)], "qid long, qx double, qy double, k int")
    probes = spark.createDataFrame([(0, 0.7, 0.7), (1, 0.9, 0.5), (2, 0.01, 0.99)], "qid long, qx double, qy double")
    rows = points.collect()

    def check(known):
        of = [r for r in rows if known(r)]
        assert sorted(map(tuple, tree.point_query(probes).collect())) == sorted((q.qid, r.id) for q in probes.collect() for r in of if (r.x, r.y) == (q.qx, q.qy))
        assert sorted(map(tuple, tree.range_query(windows).collect())) == sorted((w.qid, r.id) for w in windows.collect() for r in of if w.bottom <= r.y <= w.up and w.left <= r.x <= w.right)
        want = [(q.qid, r.id) for q in near.collect() for r in sorted(of, key=lambda r: ((r.x - q.qx) ** 2 + (r.y - q.qy) ** 2, r.id))[: q.k]]
        assert sorted((r.qid, r.id) for r in tree.knn_query(near).collect()) == sorted(want)

    tree.insert(points.where("id < 20"), ["t", "id"])
    assert not tree.latest().tables["sealed"]
    check(lambda r: r.id < 20)
    tree.insert(points.where("id >= 20"), ["t", "id"])
    assert len(tree.latest().tables["sealed"]) == 9 and len(tree.latest().tables["arrived"]) == 10
    check(lambda r: True)
    m = tree.compact()
    assert len(m.tables["sealed"]) == 6 and tree.table("entries").count() == 150
    check(lambda r: True)


def test_more_leaves_than_are_sent_to_all_tasks(spark, points, monkeypatch):
    meta = growth.with_meta(cells.leaves(points.where("id < 350"), 10, BITS, 5).withColumn("leaf", cells.leaf_number(F.col("depth"), F.col("cell"))), BITS).checkpoint()
    want = sorted(map(tuple, cells.assign_leaves(points.select("id", "z"), meta, BITS).collect()))
    monkeypatch.setattr(cells, "BROADCAST_LEAVES", 3)
    assert sorted(map(tuple, cells.assign_leaves(points.select("id", "z"), meta, BITS).collect())) == want and 0 < len(want) < points.count()
    assert cells.assign_leaves(points, meta.limit(0), BITS).count() == 0
    assert search.knn_scan(points, 0.0, 0.0, 3).count() == 3


def test_medians_halve_exactly(spark, points, monkeypatch):
    """Splits and leaves by plain sorting, with many rows at one place, few bins and groups that aren't broadcast."""
    rows = [(r.id, r.x, r.y) for r in points.collect()]
    leaves, splits, parts, level = {}, set(), {1: rows}, 0
    while max(map(len, parts.values())) > 60:
        halves = {}
        for node, of in parts.items():
            of = sorted(of, key=lambda r: (r[1 + level % 2], r[0]))
            half = (len(of) + 1) // 2
            splits.add((node, level, of[half - 1][1 + level % 2], of[half - 1][0]))
            halves |= {2 * node: of[:half], 2 * node + 1: of[half:]}
        parts, level = halves, level + 1
    leaves = {r[0]: node for node, of in parts.items() for r in of}
    for bins, groups, small in ((1024, 200_000, 256), (64, 0, 3)):
        monkeypatch.setattr(medians, "BINS", bins)
        monkeypatch.setattr(medians, "SMALL", small)
        monkeypatch.setattr(medians, "BROADCAST_GROUPS", groups)
        got, cuts = medians.median_tree(points, 60)
        assert {r.id: r.blk for r in got.collect()} == leaves and {tuple(r) for r in cuts.collect()} == splits
    whole, none = medians.median_tree(points.limit(0), 60)
    assert whole.count() == 0 and none.count() == 0
    q = spark.createDataFrame([(1, 0.1, 0.1), (2, 5.0, -3.0)], "qid long, qx double, qy double")
    assert {r.blk.bit_length() for r in medians.located(q, cuts, F.col("qx"), F.col("qy")).collect()} == {level + 1}


def test_a_tree_of_medians_is_the_same_wherever_tasks_take_over(spark, points, monkeypatch):
    """The upper levels are one job for all nodes each, the lower ones one job in all."""
    found, jobs = [], []
    rank, monkeyed = medians.rows_at_ranks, []
    monkeypatch.setattr(medians, "rows_at_ranks", lambda *a: monkeyed.append(1) or rank(*a))
    for most in (1 << 17, 130, 1):
        monkeypatch.setattr(medians, "TASK_ROWS", most)
        rows, splits = medians.median_tree(points, 60)
        found.append(({(r.id, r.blk) for r in rows.collect()}, {tuple(r) for r in splits.collect()}))
        jobs.append(len(monkeyed))
        monkeyed.clear()
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 7 and jobs == [0, 2, 3]


def test_arrivals_share_files_and_are_read_once_whatever_the_queries(spark, points, tmp_path):
    """Blocks in order of arrival span the region; neither files nor pairs of queries and blocks grow with their number."""
    tree = BufferedTree(spark, str(tmp_path), UNIT, SHAPE, per_block=2, merge_at=10)
    m = tree.insert(points, ["t", "id"])
    assert len(m.tables["sealed"]) == 235 and len({p for v in m.tables["arrived"].values() for p in v}) == 1
    assert blocks.blocks_near(tree.delta(m)[1], spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0, 1.0)], "qid long, bottom double, up double, left double, right double"), UNIT, BITS).count() == 235
    m = tree.compact()
    assert len(m.tables["arrived"]) == 225 and tree.delta(m)[0].count() == 450 and tree.table("entries").count() == 20
    probes = points.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    assert tree.point_query(probes).count() == points.join(probes, (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy"))).count()


def test_density_search_grows_only_where_it_has_to(spark, points):
    meta = growth.with_meta(cells.all_leaves(points, 40, BITS, 5).withColumn("leaf", cells.leaf_number(F.col("depth"), F.col("cell"))), BITS)
    meta = cells.leaf_meta(meta, UNIT, BITS).checkpoint()
    entries = learned.leaf_positions(cells.assign_leaves(points, meta, BITS)).checkpoint()
    models = learned.linear_models(entries).checkpoint()
    queries = spark.createDataFrame([(0, 0.3, 0.3, 9), (1, 0.7, 0.7, 100), (2, 0.99, 0.01, 3), (3, 2.0, 2.0, 1000), (4, 0.2, 0.1, 1)], "qid long, qx double, qy double, k int")
    found, rounds = search.knn_by_density(entries, meta, models, queries, UNIT, BITS)
    rows = points.collect()
    want = {(q.qid, r.id, i + 1) for q in queries.collect() for i, r in enumerate(sorted(rows, key=lambda r: ((r.x - q.qx) ** 2 + (r.y - q.qy) ** 2, r.id))[: q.k])}
    assert {(r.qid, r.id, r.rank) for r in found.collect()} == want
    assert rounds[0] == 5 and rounds == sorted(rounds, reverse=True) and rounds[-1] < 5


def test_packed_levels_end_in_a_root(spark, points):
    tiles = blocks.packed_boxes(points, 5, 5)
    levels = blocks.packed_levels(tiles, 5, 5, fan=2).checkpoint()
    count = {r.level: (r.c, r.n) for r in levels.groupBy("level").agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect()}
    assert count == {0: (25, 470), 1: (9, 470), 2: (4, 470), 3: (1, 470)}
    rows = blocks.packed_rows(points, 5, 5)
    w = spark.createDataFrame([(0, 0.2, 0.5, 0.1, 0.4), (1, 0.0, 1.0, 0.0, 1.0), (2, 3.0, 4.0, 3.0, 4.0)], "qid long, bottom double, up double, left double, right double")
    got = sorted(map(tuple, blocks.range_query_levels(rows, levels, w, fan=2).collect()))
    assert got == sorted((q.qid, r.id) for q in w.collect() for r in points.collect() if q.bottom <= r.y <= q.up and q.left <= r.x <= q.right)
    down = blocks.descended(levels, w, fan=2).groupBy("qid").count().collect()
    assert {r.qid: r["count"] for r in down}[0] < 39 and 2 not in {r.qid for r in down}
    assert blocks.packed_levels(tiles.limit(0), 5, 5).count() == 0 and blocks.descended(levels.limit(0), w).count() == 0


def test_the_source_opens_only_parts_that_can_match(spark, points, tmp_path):
    tree = StoredTree(spark, str(tmp_path), UNIT, SHAPE)
    m = tree.merge(points)
    datasource.register(spark, UNIT, BITS)
    load = lambda **o: spark.read.format("terrazzo_tree").options(folder=str(tmp_path), bits=BITS, coarse=2, **o).load()
    assert load().count() == points.count() and load(table="leaves").columns == ["leaf", "depth", "cell", "n"] and load(version=0).count() == 0
    every = {k: {r.z for r in tree.store.read(m, "entries", [k]).select("z").collect()} for k in m.tables["entries"]}
    for low, high in ((0, 100), (20_000, 30_000), (40_000, 40_500), (65_000, 65_535)):
        reader = datasource.TreeReader(str(tmp_path), m.tables["entries"], 2 * (BITS - 2), ["id", "z"])
        filters = [GreaterThanOrEqual(("z",), low), LessThan(("z",), high)]
        assert list(reader.pushFilters(filters)) == filters
        chosen = {k for k in every if reader._can_hold(int(k))}
        assert {k for k, zs in every.items() if any(low <= z < high for z in zs)} <= chosen and len(reader.partitions()) <= max(1, len(every) - 1)
        got = load().where(f"z >= {low} AND z < {high}")
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in points.where(f"z >= {low} AND z < {high}").collect())


def test_window_cells_in_sql(spark):
    datasource.register(spark, UNIT, BITS)
    rows = spark.createDataFrame([(0, 0.2, 0.5, 0.1, 0.4), (1, 0.9, 1.5, 0.9, 1.5), (2, -2.0, -1.0, 0.0, 1.0), (3, None, 1.0, 0.0, 1.0), (4, 0.6, 0.5, 0.1, 0.2)], "qid long, bottom double, up double, left double, right double")
    rows.createOrReplaceTempView("some_windows")
    got = {tuple(r) for r in spark.sql("SELECT qid, c.cell FROM some_windows, LATERAL window_cells(bottom, up, left, right, 3) c").collect()}
    want = {(r.qid, r.cell) for r in cells.cover_masks(rows.where("bottom is not null"), UNIT, BITS, 3).collect()}
    assert got == want and {q for q, _ in got} == {0, 1}


def test_a_deep_tree_of_medians_is_planned_from_true_sizes(spark, points, monkeypatch):
    """Estimates of joins are products: a level that goes on from the estimate of the one before has several times its digits."""
    monkeypatch.setattr(medians, "TASK_ROWS", 1)
    rows, splits = medians.median_tree(points, 20)
    bits = [df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() for df in (rows, splits)]
    assert rows.select("blk").distinct().count() == 32 and max(bits) < 1000


def test_a_merge_leaves_no_shuffle_files(spark, points, tmp_path):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}
    before = files()
    tree = BufferedTree(spark, str(tmp_path), UNIT, SHAPE, per_block=50, merge_at=3)
    tree.merge(points.where("id < 200"))
    tree.insert(points.where("id >= 200"), ["t", "id"])
    tree.compact()
    left = None
    for _ in range(40):  # they go in a thread of their own
        if not (left := files() - before):
            break
        time.sleep(0.25)
    assert not left and tree.table("entries").count() == 350
