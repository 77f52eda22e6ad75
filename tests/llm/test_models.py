"""Toxicity, language, quality model, packing, near duplicates, pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from public_tokenizers import path
from terrazzo.llm import language, near_dup, packing, quality_model, toxicity
from terrazzo.llm.tokens import encoder


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_ordinal_thresholds_and_scores():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        words = {int(w): 1 for w in rng.integers(100, 2000, 30)}
        if bad:
            words |= {int(w): int(rng.integers(1, 6)) for w in rng.integers(0, 10, 3)}
        rows.append((list(words), list(words.values()), int(bad)))
    m = toxicity.fit(rows)
    assert m.theta[0] < m.theta[1] < m.theta[2] and 0 < m.cut <= 0.5
    assert set(sorted(m.weights, key=m.weights.get)[-10:]) == set(range(10)) and min(m.weights[i] for i in range(10)) > 0
    assert toxicity.fit([]).weights == {} and toxicity.fit(rows[:1]).weights == {}


def test_toxicity_rows(spark, odd, none, docs, labels):
    m = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.severity <= 3 for r in got) and not any(r.rejected for r in got)
    assert toxicity.score_toxicity(none, m).count() == 0
    kept = toxicity.drop_toxic(docs, m)
    assert kept.columns == docs.columns and kept.count() == toxicity.score_toxicity(docs, m).where("not rejected").count()
    assert toxicity.score_toxicity(docs, toxicity.train(none, labels)).where("rejected").count() == 0


def test_toxicity_separates_held_out_rows(spark):
    """Fitted to half of the labelled rows: few clean ones of the other half are rejected, and most of the toxic ones."""
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(d, lab.where("doc_id % 2 = 0"))
    out = toxicity.score_toxicity(d, m).join(lab.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert out[out.toxic == 0].rejected.mean() < 0.02 and out[out.toxic == 1].rejected.mean() > 0.85
    assert set(out.grade) == {0, 1, 2, 3}


def test_toxicity_equals_a_plain_version(odd, docs, labels):
    m = toxicity.train(docs, labels)
    for df in (odd, docs):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            c = Counter()
            for w in re.findall(r"\w+", (r.text or "").lower()):
                c[zlib.crc32(w.encode()) % (1 << 20)] += 1
                if len(w) > 4:
                    c[zlib.crc32(("^" + w[:4]).encode()) % (1 << 20)] += 1
            z = sum(m.weights.get(h, 0) * np.log(1 + n) for h, n in c.items())
            p = [1 / (1 + np.exp(t - z)) for t in m.theta]
            want[r.doc_id, round(sum(p), 6), p[0] >= m.cut] += 1
        assert Counter((r.doc_id, round(r.severity, 6), r.rejected) for r in toxicity.score_toxicity(df, m).collect()) == want


def test_language(spark, odd, none, docs):
    m = language.train(docs)
    out = language.predict(docs, m).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert [crc(i, 5) == 0 for i in out.doc_id] == out.held_out.tolist()
    assert (out.lang_pred == out.lang).mean() > 0.98
    got = language.predict(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5].lang_pred == by[6].lang_pred == by[7].lang_pred == by[18].lang_pred == "und" and by[0].lang_pred in m.names
    assert language.predict(none, m).count() == 0 and language.predict(odd, language.train(none)).where("lang_pred != 'und'").count() == 0


def test_language_equals_a_plain_version(odd, docs):
    """Each gram hashed by itself, embeddings averaged, softmax with the fitted temperature."""
    m = language.train(docs)
    u = 1 << 32

    def plain(text):
        low = (text or "").lower()
        if not any(c.isalpha() for c in low):
            return "und", 0.0
        words = " ".join("".join(c if c.isalpha() else " " for c in low).split())
        a = [ord(c) for c in f" {words} "]
        total, seen = np.zeros(language.WIDTH), 0
        for i in range(len(a)):
            h = a[i] * 0x9E3779B1 % u
            for n in (2, 3, 4):
                if i + n > len(a):
                    break
                h = ((h ^ h >> 15) * 0x85EBCA6B + a[i + n - 1] * 0xC2B2AE35) % u
                gram = a[i : i + n]
                if (32 in gram[1:-1]) if n > 2 else gram == [32, 32]:
                    continue
                total += m.embed[(h ^ h >> 13) * 0x27D4EB2F % u >> 19]
                seen += 1
        z = (total / max(1, seen) @ m.weight + m.bias) / m.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return m.names[int(p.argmax())], float(p.max())

    for df in (odd, docs.limit(60)):
        texts = df.select("doc_id", "text").collect()
        want = Counter((r.doc_id, plain(r.text)[0], round(plain(r.text)[1], 3)) for r in texts)
        assert Counter((r.doc_id, r.lang_pred, round(r.score, 3)) for r in language.predict(df, m).collect()) == want


def test_language_sample_is_bounded(spark, docs):
    from pyspark.sql import functions as F

    many = docs.where("lang is not null").crossJoin(spark.range(40)).withColumn("doc_id", F.col("doc_id") * 40 + F.col("id"))
    m = language.train(many, rows=600)
    assert (language.predict(docs, m).join(docs.select("doc_id", "lang"), "doc_id").toPandas().pipe(lambda x: x.lang == x.lang_pred)).mean() > 0.9


def test_quality_model_equals_a_plain_version(odd, docs, labels):
    """All pairs of features multiplied out, and held-out accuracy."""
    m = quality_model.train(docs, labels)
    hasher = quality_model.Hasher(quality_model.WORD_BUCKETS)

    def plain(text):
        at, x = quality_model.featurise(text, hasher)
        vx = m.v[at] * x[:, None]
        pairs = np.triu(vx @ vx.T, 1).sum()
        return 1 / (1 + np.exp(-np.clip(m.w0 + m.w[at] @ x + pairs, -30, 30)))

    for df in (odd, docs.limit(80)):
        want = Counter((r.doc_id, round(float(plain(r.text)), 5)) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, round(r.score, 5)) for r in quality_model.classify(df, m).collect()) == want


def test_quality_model_separates_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.classify(d, quality_model.train(d, lab)).join(lab, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93 > out.quality.mean()


def test_quality_model(spark, odd, none, docs, labels):
    m = quality_model.train(docs, labels)
    out = quality_model.classify(docs, m).join(labels, "doc_id").toPandas()
    assert [crc(i, 3) == 1 for i in out.doc_id] == out.held_out.tolist()
    held = out[out.held_out]
    assert held[held.quality == 1].score.mean() > held[held.quality == 0].score.mean()
    got = quality_model.classify(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_model.classify(none, m).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    m = quality_model.Machine(0.3, rng.normal(size=quality_model.FEATURES), rng.normal(size=(quality_model.FEATURES, quality_model.RANK)))
    at, x = np.array([3, 70, 900]), np.array([0.5, 1.0, 2.0])
    z = m.w0 + m.w[at] @ x + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(m.scores([(at, x)])[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_tokens_equal_the_library(docs):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["", " ", "a  b", " a b", "a b ", "x \n y", "it's  'tis", "\x1c a \x1cb", "　 a　b", "<|endoftext|> x", "a\n\n b"] + [r.text for r in docs.select("text").limit(40).collect()]
    e = encoder("byte_bpe_50k")
    assert [np.frombuffer(e(x), "<u2").tolist() for x in texts] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_equal_the_library_at_its_defaults(spark):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["", end, f"{end} x", f"a {end}", f"a  {end}  b {end}{end}\n c", f"it{end}s", f"<|endoftext {end[:-1]} {end}>", f" \n{end}\t x  y"]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    e = encoder("byte_bpe_50k")
    assert [np.frombuffer(e(x), "<u2").tolist() for x in texts] == want
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source")).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == {i: len(x) + 1 for i, x in enumerate(want)}


def check_packing(df, out):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    ids = {}
    for r in df.select("doc_id", "text").collect():
        x = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id] += len(x)
        ids[r.doc_id, len(x)] = np.array(x, "<u4")
    got, seq = Counter(), defaultdict(list)
    for r in out.collect():
        got[r.doc_id] += r.length
        assert zlib.crc32(ids[r.doc_id, r.doc_tokens][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seq[r.sequence_id].append((r.offset, r.length))
    assert got == want and sorted(seq) == list(range(len(seq)))
    for pieces in seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_packing(odd, none, docs):
    check_packing(odd, packing.pack_documents(odd))
    check_packing(docs, packing.pack_documents(docs.repartition(3)))
    assert packing.pack_documents(none).count() == 0


def test_packing_holds_the_mixture():
    docs = [(i, i % 2, np.arange(700, dtype="<u4").tobytes()) for i in range(400)]
    for share in ((0.5, 0.5), (0.8, 0.2)):
        pieces = list(packing.pack(iter([docs]), np.array(share), np.zeros(2), 280_000, 0))
        assert sum(p[2] for p in pieces) == 280_000
        taken = [0, 0]
        for p in pieces:
            taken[p[0] % 2] += p[2]
            if max(taken) < 130_000 and sum(taken) > 5000:
                assert abs(taken[0] - share[0] * sum(taken)) < 1500


def test_packing_carries_across_partitions():
    """What a queue has earned when a partition begins is what it wasn't served before."""
    cuts = packing.Cuts(np.array([1000.5, 2001.3]))
    for share, total in ((0.7, 2100), (0.3, 900), (0.9, 1000)):
        firsts = [cuts.first(k, share, total) for k in range(4)]
        assert firsts[0] == 0 and firsts[3] == total and firsts == sorted(firsts)
        for part in (1, 2):
            assert firsts[part] + cuts.saved(part, share, total) == min(total, share * cuts.times[part - 1])
        for place in range(total):
            assert firsts[cuts.part(place, share, total)] <= place < firsts[cuts.part(place, share, total) + 1]


def test_packing_holds_the_mixture_of_very_many_sources(spark):
    """More sources than a partition has windows: over stretches of windows each group of them has its share."""
    rng = np.random.default_rng(5)
    rows = [(i, "word " * int(rng.integers(20, 200)), f"s{i % 2000}") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(40, "source")
    out = packing.pack_documents(docs).collect()
    source, whole = {i: int(s[1:]) for i, _, s in rows}, Counter()
    windows = defaultdict(Counter)
    for r in out:
        windows[r.sequence_id][source[r.doc_id] % 20] += r.length
        whole[source[r.doc_id] % 20] += r.length
    assert whole.total() == sum({r.doc_id: r.doc_tokens for r in out}.values())
    order = sorted(windows)
    for k in range(0, len(order) - 100, 100):
        some = sum((windows[i] for i in order[k : k + 100]), Counter())
        assert all(abs(some[g] / some.total() - whole[g] / whole.total()) < 0.02 for g in whole)


def test_packing_holds_the_mixture_on_a_sorted_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(rng.integers(50, 900))), f"s{max(0, i // 100 - 3)}") for i in range(1200)]  # s0: a third
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).sort("source")
    docs = docs.repartitionByRange(4, "doc_id")
    check_packing(docs, packing.pack_documents(docs))
    source = {i: s for i, _, s in rows}
    for mixture, until in (None, 1.0), ({"s0": 0.6, "s1": 0.1, "s2": 0.3}, 0.25):
        windows = defaultdict(Counter)
        for r in packing.pack_documents(docs, mixture=mixture).collect():
            windows[r.sequence_id][source[r.doc_id]] += r.length
        total = sum(windows.values(), Counter())
        n = total.total()
        want = {s: mixture.get(s, 0) if mixture else total[s] / n for s in total}
        whole = [w for _, w in sorted(windows.items()) if w.total() == 1024]
        whole = whole[: int(until * len(whole))]
        off = [max(abs(w[s] / 1024 - want[s]) for s in want) for w in whole]
        assert max(off) < 0.3 and np.mean(off) < 0.15
        for i in range(0, len(whole) - 32, 8):
            some = sum(whole[i : i + 32], Counter())
            assert all(abs(some[s] / 32768 - want[s]) < 0.02 for s in want)


def test_packing_holds_the_mixture_of_named_sources_among_many(spark, monkeypatch):
    rows = [(i, "word " * 400, ["s0", "s1", f"t{i % 50}"][i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 10)
    out = packing.pack_documents(docs, mixture={"s0": 0.75, "s1": 0.25}).collect()
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    taken = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        taken[rows[r.doc_id][2]] += r.length
        if taken.total() > 100_000:
            break
    assert set(taken) == {"s0", "s1"} and abs(taken["s0"] / taken.total() - 0.75) < 0.02


def test_clock_serves_shares_until_a_queue_ends():
    totals, share = np.array([100, 300, 200]), np.array([0.5, 0.25, 0.25])
    at = packing.clock(totals, share, np.array([0, 100, 200, 500, 600]))
    assert np.allclose(np.minimum(share * at[:, None], totals), [[0, 0, 0], [50, 25, 25], [100, 50, 50], [100, 200, 200], [100, 300, 200]])
    cuts = packing.Cuts(packing.clock(totals, share, np.array([200, 400])))
    assert [[cuts.first(k, s, t) for s, t in zip(share, totals)] for k in range(4)] == [[0, 0, 0], [100, 50, 50], [100, 150, 150], [100, 300, 200]]


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(n=60):
    """A long text, copies of it cut short step by step (chains of links), and edits."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 400, 260)]
    out = []
    for i in range(n):
        w = words[: 260 - 4 * (i % 30)]
        for k in rng.integers(0, len(w), i % 5):
            w[k] = f"e{i}x{k}"
        out.append((1000 + i, " ".join(w)))
    return out


def test_near_components(spark, odd, none, docs):
    for df in (odd, docs, spark.createDataFrame(family(), "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        for size, percent in ((3, 85), (5, 80)):
            want = brute_components([r for r in rows if r[0] is not None], size, percent)
            got = near_dup.near_components(df, size, percent).collect()
            assert len(got) == len(rows)
            for r in got:
                if r.doc_id is None:
                    assert r.component_id is None and r.kept
                else:
                    assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert near_dup.near_components(none).count() == 0


def test_near_groups_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 1)
    rows = family(40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.id: r.comp for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_match_threshold_misses_nothing():
    import math

    for s in (0.8, 0.85):
        m = near_dup.least_matches(s)
        miss = sum(math.comb(near_dup.COORDINATES, k) * s**k * (1 - s) ** (near_dup.COORDINATES - k) for k in range(m))
        assert miss <= near_dup.MISS and m > near_dup.COORDINATES * (s - 0.3)


def test_pipeline(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "personal_data", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        if name == "near_duplicates":
            want = brute_components([(r.doc_id, r.text) for r in now.collect()], 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if i == c}
        else:
            assert out.count() >= 0.6 * now.count()
        now = spark.createDataFrame(out.collect(), docs.schema)
    check_packing(now, corpus_pipeline.STAGES[-1][1](spark, now, sf))
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == {r.doc_id for r in now.collect()}
