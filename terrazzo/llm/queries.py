"""The registered queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, divergence, language, licenses, media, near_dup, packing, pieces, pii, quality_model, quality_rules, toxicity
from .session import prepared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate_quality(_table(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_components(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.classify(docs, quality_model.train(docs, _table(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damaged(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_packing, op3_quality_rules, op4_near_dup, op5_toxicity, op6_media, op7_language, op8_licenses, op9_quality_model, op10_sentencepiece, op11_divergence, op12_decontamination, op13_conversations)
}

#: The other operators fit models, tokenise or store files, which SQL can't express; tests/llm holds them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op4_near_dup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id WHERE r.m < e.b),
c AS (SELECT id, min(m) AS m FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS m FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.m, count(t.i) AS n FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT + count(*) OVER (PARTITION BY lang, source) AS b FROM c),
v AS (SELECT lang, sum(m)::HUGEINT + count(*) AS b FROM k GROUP BY lang),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // s.b AS p, 1 + (1000000000::HUGEINT * (m + 1)) // v.b AS q FROM s JOIN v USING (lang)),
o AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
""",
    "op12_decontamination": r"""
WITH t AS (SELECT 0 AS k, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT k, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
b AS (SELECT DISTINCT id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE k = 1 AND len(w) > 0 AND id IS NOT NULL),
p AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM w, (SELECT DISTINCT n FROM b), unnest(range(1, len(w) - n + 2)) u(i) WHERE k = 0),
m AS (SELECT DISTINCT r, i, n, b.id FROM p JOIN b USING (n, g)),
h AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM m, range(0, 10) q(j) WHERE j < n GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS ids FROM (SELECT DISTINCT r, id FROM m) GROUP BY r)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN s USING (r) WHERE k = 0
""",
    "op13_conversations": r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(b))),
k AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, range(2) q(c) WHERE h <> 0 AND (c = 0 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, substr(role, 1, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT contains('.!?', right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)) THEN 3 ELSE 0 END AS fault FROM o),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (y || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS y FROM f) GROUP BY conv_id),
-- states: 0 nothing yet, 1 after the system's turn, 2 after a user's, 3 after an assistant's
e AS (SELECT * FROM (VALUES (0, 's', 1, 'K', 0, ''), (0, 'u', 2, 'K', 0, ''), (1, 'u', 2, 'K', 0, ''), (3, 'u', 2, 'K', 0, ''), (2, 'a', 3, 'K', 0, ''), (0, 'a', 3, 'IK', 5, 'user'), (1, 'a', 3, 'IK', 5, 'user'), (3, 'a', 3, 'IK', 5, 'user'), (2, 'u', 2, 'IK', 5, 'assistant'),
  (0, '', 2, 'R', 1, ''), (1, '', 2, 'R', 1, ''), (3, '', 2, 'R', 1, ''), (2, '', 3, 'R', 1, ''), (0, '', 3, 'IR', 6, 'user'), (1, '', 3, 'IR', 6, 'user'), (3, '', 3, 'IR', 6, 'user'), (2, '', 2, 'IR', 6, 'assistant'),
  (0, '', 0, 'D', 2, ''), (1, '', 1, 'D', 2, ''), (2, '', 2, 'D', 2, ''), (3, '', 3, 'D', 2, '')) v(st, x, nxt, edit, c, ins)),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS st, {'cost': 0::BIGINT, 'audit': '', 'out': ''} AS m FROM conversations UNION ALL
  SELECT r.conv_id, r.i + 1, e.nxt, min({'cost': m.cost + e.c + CASE WHEN fault = 3 AND edit <> 'D' THEN 5 ELSE 0 END, 'audit': m.audit || edit,
    'out': m.out || CASE WHEN ins = '' THEN '' ELSE chr(10) || ins || ':' END || CASE WHEN edit = 'D' THEN '' ELSE chr(10) || CASE WHEN edit IN ('K', 'IK') THEN role WHEN nxt = 2 THEN 'user' ELSE 'assistant' END || ':' || text END})
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN e ON e.st = r.st AND (e.x = '' OR e.x = f.x) AND (edit = 'D' OR fault NOT IN (1, 2)) GROUP BY ALL),
z AS (SELECT r.conv_id, min({'cost': m.cost + CASE r.st WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': m.audit || CASE r.st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
  'out': m.out || CASE r.st WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) AS m FROM r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.i = coalesce(g.n, 0) GROUP BY r.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, m.cost, m.audit, sha256(substr(m.out, 2)) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
""",
}
