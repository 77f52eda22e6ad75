"""Source divergence audit: which terms set a source apart from its language, and how far sources are from each other.

Arrow computes inside mapInArrow: texts are lower-cased and split at what isn't a letter, terms are dictionary-encoded
and counted by hash group_by, slice by slice, and a task merges its slices' counts before it hands them on.
The merged counts are columnar shards of terms: each holds all sources' rows of its terms, so the sums over terms
are sums over shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ddl

#: Terms lie between runs of these: all of ASCII but letters.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term is kept by a language if so many of its documents hold it.
LEAST_DOCUMENTS = 3
#: Shares are whole numbers of this many parts.
SCALE = 1_000_000_000
#: Ranks of terms that are reported.
TOP_TERMS = 200
#: Bytes of text that are split at once, unless one document is longer, and counts that a task holds.
SLICE_BYTES, HELD_COUNTS = 1 << 22, 1 << 19
#: Counts of a shard, about, and cells of the matrices of terms by sources and sources by sources.
SHARD_COUNTS, CELLS = 1 << 17, 1 << 20
#: A table of groups of at most so many rows (about 100 bytes each) is broadcast; a larger one is joined by shuffle, salted.
BROADCAST_ROWS, SALTS = 100_000, 64

COUNTS = "lang string, source string, term string, n long, df long"
_KEYS = ["lang", "source", "term"]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch (text, lang, source) in runs of SLICE_BYTES or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    ends = [*(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """COUNTS of a batch (text, lang, source): occurrences and documents by term, and a row without a term for each group."""
    lang, source = (pc.fill_null(batch[c], "").dictionary_encode() for c in ("lang", "source"))
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), max(1, len(source.dictionary))), source.indices.cast(pa.int64()))
    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch["text"], "")), SEPARATORS)
    flat, row = pc.list_flatten(words), pc.list_parent_indices(words)
    some = pc.not_equal(flat, "")
    term, row = flat.filter(some).dictionary_encode(), row.filter(some)
    by_row = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    by_group = pa.table({"group": group.take(by_row["row"]), "term": by_row["term"], "n": by_row["count_all"]}).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    seen = pc.unique(group)
    every = pa.concat_arrays([by_group["group"].combine_chunks(), seen])
    none = pa.nulls(len(seen), pa.string())
    zeros = pa.array(np.zeros(len(seen), np.int64))
    wide = max(1, len(source.dictionary))
    return pa.table({
        "lang": lang.dictionary.take(pc.divide(every, wide)),
        "source": source.dictionary.take(pc.subtract(every, pc.multiply(pc.divide(every, wide), wide))),
        "term": pa.concat_arrays([term.dictionary.take(by_group["term"].combine_chunks()), none]),
        "n": pa.concat_arrays([by_group["n_sum"].combine_chunks(), zeros]),
        "df": pa.concat_arrays([by_group["count_all"].combine_chunks(), zeros]),
    })


def _merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
    return out.select([*_KEYS, "n_sum", "df_sum"]).rename_columns([*_KEYS, "n", "df"])


def partial_counts(docs: DataFrame) -> DataFrame:
    """COUNTS of each task's documents, merged as far as HELD_COUNTS allows."""
    kind = ddl(COUNTS)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            for s in _slices(b):
                held.append(term_counts(s))
                rows += held[-1].num_rows
                if rows > HELD_COUNTS:
                    held = [_merged(held)]
                    rows = held[0].num_rows
                    if rows > HELD_COUNTS // 2:
                        yield from held[0].cast(arrow).to_batches(max_chunksize=1 << 16)
                        held, rows = [], 0
        if held:
            yield from _merged(held).cast(arrow).to_batches(max_chunksize=1 << 16)

    text = F.col("text").cast("string").alias("text")
    return docs.select(text, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).mapInArrow(run, kind)


def kept_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, total, first): occurrences of kept terms in each group that has some and in the language; `first`
    marks one row of each term of a language; a row without a term stands for each group. Kept as checkpoint."""
    merged = partial_counts(docs).groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = W.partitionBy("lang", "term")  # a row for each source
    out = merged.select(*_KEYS, "n", F.sum("df").over(of_term).alias("_df"), F.sum("n").over(of_term).alias("total"), (F.min("source").over(of_term) == F.col("source")).alias("first"))
    return out.where(F.col("term").isNull() | (F.col("_df") >= LEAST_DOCUMENTS)).drop("_df").checkpoint()


def group_table(counts: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, terms, sources, shards, tiles) of every group; kept as checkpoint."""
    term = F.col("term").isNotNull()
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if(term & F.col("first")).alias("_first"), F.count_if(term).alias("_rows"))
    of_lang = W.partitionBy("lang")  # a row for each source
    out = groups.select("lang", "source", "size", F.sum("size").over(of_lang).alias("lang_size"), F.sum("_first").over(of_lang).alias("terms"), F.count("*").over(of_lang).alias("sources"), F.sum("_rows").over(of_lang).alias("_rows"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("_rows") / SHARD_COUNTS)).cast("int")
    tiles = F.ceil(F.col("sources") / F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("sources")))).cast("int")
    return out.withColumns({"shards": shards, "tiles": tiles}).drop("_rows").checkpoint()


def share(n: str, size: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (size + terms)) of columns n, size and terms, exact for any long; null without terms."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0)) div nullif(cast({size} + terms as decimal(20,0)), 0)")


def with_group(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """`counts` with the columns of their group, however many rows one has."""
    if groups.count() <= BROADCAST_ROWS:
        return counts.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counts.withColumn("_salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "source", "_salt"]).drop("_salt")


def leading_terms(counts: DataFrame, groups: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank) of the terms of each group whose share is above the language's."""
    both = with_group(counts.where(F.col("term").isNotNull() & (F.col("n") > 0)), groups).select("lang", "source", F.col("term").alias("item"), share("n", "size").alias("p"), share("total", "lang_size").alias("q"))
    found = both.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    # row_number below a bound: each task hands on `most` rows of a group
    return found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most)


def _compared(key: tuple, shard: pa.Table) -> pa.Table:
    """(lang, source, other, value): sums over a shard's terms, for the sources of one tile against all others."""
    head = shard.filter(pc.is_null(shard["term"]))
    rows = shard.filter(pc.is_valid(shard["term"]))
    names = head["source"].combine_chunks()
    p0 = head["p"].to_numpy()
    here = np.flatnonzero(head["here"].to_numpy(zero_copy_only=False))
    n = len(names)
    source = pc.index_in(rows["source"], value_set=names).to_numpy()
    term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    p = rows["p"].to_numpy()
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], source[order], p[order]
    between = lambda a, b: (a - b) * (a - b) // b
    out = np.zeros((len(here), n), np.int64)
    height, last = max(1, CELLS // max(1, n)), int(term[-1]) + 1 if len(term) else 0
    for begin in range(0, last, height):
        lo, hi = np.searchsorted(term, [begin, begin + height])
        t, s, v = term[lo:hi] - begin, source[lo:hi], p[lo:hi]
        high = int(t[-1]) + 1
        has = np.zeros((high, n), bool)
        has[t, s] = True
        full = np.broadcast_to(p0, (high, n)).copy()
        full[t, s] = v
        by_source = np.argsort(s, kind="stable")
        t, v = t[by_source], v[by_source]
        ends = np.searchsorted(s[by_source], np.arange(n + 1))
        for i, a in enumerate(here):
            mine = has[:, a]
            with_a = between(full[mine, a][:, None], full[mine]).sum(axis=0)
            others = np.concatenate([[0], np.cumsum(np.where(mine[t], 0, between(p0[a], v)))])  # terms that a lacks and another has
            neither = high - mine.sum() - np.diff(ends) + has[mine].sum(axis=0)
            out[i] += with_a + others[ends[1:]] - others[ends[:-1]] + neither * between(p0[a], p0)
    at, other = np.nonzero(here[:, None] != np.arange(n))
    return pa.table({"lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(at)), "source": names.take(pa.array(here[at])), "item": names.take(pa.array(other)), "value": out[at, other]})


def source_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of every other source of each group's language: the sum over all kept terms."""
    tile, shard = F.pmod(F.hash("source"), F.col("tiles")), F.pmod(F.hash("term"), F.col("shards"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    heads = groups.select("*", every("shards").alias("shard")).select("*", every("tiles").alias("tile"))
    heads = heads.select("lang", "shard", "tile", "source", F.lit(None).cast("string").alias("term"), F.coalesce(share("cast(0 as bigint)", "size"), F.lit(1).cast("long")).alias("p"), (F.col("tile") == tile).alias("here"))
    rows = with_group(counts.where("term is not null"), groups).select("*", every("tiles").alias("tile"))
    rows = rows.select("lang", shard.alias("shard"), "tile", "source", "term", share("n", "size").alias("p"), F.lit(False).alias("here"))
    sums = heads.unionByName(rows).groupBy("lang", "shard", "tile").applyInArrow(_compared, ddl("lang string, source string, item string, value long"))
    out = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit_sources(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to each other one (`pair`) and the
    terms that it has beyond its language's share (`term`, TOP_TERMS at most).

    A null text, lang or source is an empty one, which is a language or source like another; a group without
    terms takes part; a language without kept terms gives distances of 0; repeated rows count each; a very long text is
    split whole, in memory in proportion to it; equal values are ranked by item; an empty table gives nothing; other columns are ignored.
    """
    counts = kept_counts(docs)
    groups = group_table(counts)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(source_distances(counts, groups), "pair").unionByName(columns(leading_terms(counts, groups), "term"))
