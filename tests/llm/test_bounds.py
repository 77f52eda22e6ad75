"""Hot keys, repeated ids and odd names: what has to stay bounded and whole."""

import corpus_pipeline
from pyspark.sql import functions as F

from terrazzo.llm import common, language, media, near_dup


def test_a_sample_has_one_row_for_an_id(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}", "en") for i in range(3000)] + [(7, None, "en"), (None, "x", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(3)] + [(7, 0), (7, 1)], "doc_id long, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", 10).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(0, 1), (1, 1), (2, 1), (7, 1)]
    assert sorted(map(tuple, common.labelled_sample(docs.repartition(9), labels, "toxic", 10).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert common.one_of_each(docs.where("doc_id is not null")).count() == 4
    assert language.train(docs, 10) is not None


def test_heavy_keys_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HEAVY_KEYS", 4)
    monkeypatch.setattr(near_dup, "LEAST_HEAVY", 5)
    rows = spark.createDataFrame([(i, 0 if i % 2 else i % 7) for i in range(500)], "v long, key long")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    want = sorted(map(tuple, rows.join(table, "key").collect()))
    assert sorted(map(tuple, near_dup.with_key(rows, table, "key").collect())) == want and len(want) == 500
    assert near_dup.with_key(rows.limit(0), table.limit(0), "key").count() == 0


def test_a_star_and_a_chain_are_one_component_each(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LEAST_HEAVY", 5)
    links = [(1, i) for i in range(2, 300)] + [(1000 + i, 1001 + i) for i in range(40)]
    comps = {r.id: r.comp for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert comps == {i: 1 for i in range(1, 300)} | {1000 + i: 1000 for i in range(41)}


def test_stages_take_any_names(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.limit(60).select("*", F.lit(1).alias("a.b"), F.lit("x").alias("_gone"), F.lit("y").alias("_doc"), F.lit("z").alias("cls"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and 0 < out.count() <= 60, name
    assert corpus_pipeline.pack(spark, odd, str(tmp_path)).count() > 0


def test_forgotten_payloads_are_stored_again(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id long, text string").coalesce(1)
    columns = ["doc_id", "n_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    want = sorted(map(tuple, media.media_columns(docs).select(*columns).collect()))
    monkeypatch.setattr(media, "MOST_SEEN", 2)
    got = media.media_columns(docs)
    assert sorted(map(tuple, got.select(*columns).collect())) == want and got.select("offset").distinct().count() > 5
