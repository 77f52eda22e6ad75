"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts with equal shingle sets are one class. A class's (coordinate, value) pairs are put in order of how many
classes share them, the rarest first, and it is posted under the first K - M + 1: two signatures that agree in
M of K places or more have one of those in common, so the longer lists needn't be merged. Places that a class
has alone come first in that order and post nothing, so a class of which fewer than M places are anyone else's
is posted nowhere.

The lists that have the same smallest member are merged into one group, in which each class is once. A group
is laid out in blocks of bounded size, and a block's task counts the agreeing places of its classes and confirms
those with M or more on full sets, but for classes that links join already. It returns at most a link for each
class, so nothing emits all pairs of a group. The blocks of a large group each hold the smallest member too; the classes that aren't
joined with it then meet all others of their group, part by part. No pair of a list is left out, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ddl, map_rows

COORDINATES = 64
#: The odds that a link at exactly the threshold has too few matches to become a candidate.
MISS = 1e-7
#: Classes, and their shingles, that are compared in one task.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 22
#: Keys whose rows aren't shuffled in a join, at most, and the least rows of such a one.
HEAVY_KEYS, LEAST_HEAVY = 10_000, 1_000
#: A table of classes of at most so many rows (about 64 bytes each) is broadcast to the texts; a larger one is joined by shuffle.
BROADCAST_ROWS = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's `size`-word shingles, A-Z lower-cased; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = _mixed(h * _MIX + w[i : n - k + 1 + i])
    return np.unique(h)


@cache
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signature(hashes: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """k minima of the set under k hash functions, 32 bits each."""
    a, b = _permutations(k)
    out = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            x = (hashes[i : i + 2048, None] ^ b) * a
            np.minimum(out, (x ^ (x >> np.uint64(29))).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


@cache
def least_matches(similarity: float, k: int = COORDINATES, miss: float = MISS) -> int:
    """The most matches that a pair at `similarity` has in all but a share `miss` of cases."""
    below, m = 0.0, 0
    while True:
        below += math.comb(k, m) * similarity**m * (1 - similarity) ** (k - m)
        if below > miss or m == k:
            return max(1, m)
        m += 1


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest, sig) by row, and (cls, rep, n, digest, sig) by class of equal non-empty sets: a number, and the smallest doc_id."""

    def describe(doc_id, text):
        s = shingle_set(text, size)
        return doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signature(s).view(np.int32) if len(s) else None

    rows = map_rows(docs, describe, "doc_id long, n long, digest binary, sig array<int>", ["doc_id", "text"]).checkpoint()
    known = rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return rows, classes.withColumn("cls", F.monotonically_increasing_id()).checkpoint()


def with_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` joined with `table` (key, n, ...), a row for each key with the number n of `rows` that have it.

    Keys of more than a HEAVY_KEYS-th of all rows go to all tasks, of which there are HEAVY_KEYS at most, so their rows stay
    where they lie; the other keys' rows meet theirs by shuffle.
    """
    table = table.checkpoint()
    least = (table.agg(F.sum("n")).first()[0] or 0) / HEAVY_KEYS
    heavy = F.broadcast(table.where(F.col("n") > max(least, LEAST_HEAVY)))
    light = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col("n") <= max(least, LEAST_HEAVY)), key)
    return light.unionByName(rows.join(heavy, key))


def _posted(classes: DataFrame, least: int) -> DataFrame:
    """(cls, hubs): the smallest members of the lists that each class is posted in; classes that are posted nowhere are left out."""
    each = classes.select("cls", F.posexplode("sig").alias("coord", "value"))
    each = each.select("cls", (F.shiftleft(F.col("coord").cast("long"), 32) + F.col("value").cast("long")).alias("key"))
    lists = each.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("hub")).where("n > 1")
    mine = with_key(each, lists, "key").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "key", "hub"))).alias("lists"))  # COORDINATES at most
    # of the places, COORDINATES - size(lists) are the class's alone
    prefix = F.slice("lists", F.lit(1), F.size("lists") - (least - 1))
    return mine.where(F.size("lists") >= least).select("cls", F.array_distinct(F.transform(prefix, lambda x: x["hub"])).alias("hubs"))


def _forest(cls: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, asks: np.ndarray, answers: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the classes of a block which are linked, from `comp`, the components known before.

    Each row that asks is compared with those that answer and aren't in its component: `least` agreeing places
    or more, then the full sets. The sets' inverted index gives a row's shared counts with all others at once.
    """
    n = np.array([len(s) for s in sets])
    sig = np.stack([signature(s) for s in sets])
    first, begun = np.unique(comp, return_index=True)
    comp = begun[np.searchsorted(first, comp)]  # a component's name is its first row
    before = comp.copy()
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(n)), n)[np.argsort(element, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(element))])
    ends = np.cumsum(n)
    row = np.arange(len(n))
    for a in np.flatnonzero(asks):
        other = np.flatnonzero((comp != comp[a]) & answers & ((row > a) | ~(asks & answers[a])))
        other = other[100 * np.minimum(n[a], n[other]) >= percent * np.maximum(n[a], n[other])]
        other = other[(sig[other] == sig[a]).sum(axis=1) >= least] if len(other) else other
        if not len(other):
            continue
        own = element[ends[a] - n[a] : ends[a]]
        if len(other) <= 8:
            both = np.array([np.isin(element[ends[b] - n[b] : ends[b]], own, assume_unique=True).sum() for b in other])
        else:
            size = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            both = np.bincount(owner[at], minlength=len(n))[other]
        linked = other[100 * both >= percent * (n[a] + n[other] - both)]
        if len(linked):
            names = np.unique(np.append(comp[linked], comp[a]))
            comp[np.isin(comp, names)] = names[0]
    new = np.flatnonzero(comp != before)
    return cls[new], cls[comp[new]]


def _links(docs: DataFrame, asked: DataFrame, size: int, percent: int, least: int) -> DataFrame:
    """(a, b) of _forest() over the blocks of `asked` (hub, part, cls, rep, digest, comp, asks, answers)."""
    asked = asked.checkpoint()
    small = asked.count() <= BROADCAST_ROWS
    got = docs.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(asked) if small else asked, "rep")
    kind = ddl("a long, b long")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}
        for b in _then_none(batches):
            out = []
            for hub, part, cls, digest, comp, asks, answers, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if b is not None else [[None] * 8]:
                if (hub, part) != block:
                    if len(held) > 1:
                        cs, names, ask, answer = (np.array(x) for x in zip(*held, strict=True))
                        out.append(_forest(cs, list(held.values()), names, ask, answer, least, percent))
                    block, held = (hub, part), {}
                if text is not None and (cls, comp, asks, answers) not in held:
                    s = shingle_set(text, size)
                    if xxhash.xxh3_128_digest(s.tobytes()) == digest:  # else another text of the same doc_id
                        held[cls, comp, asks, answers] = s
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=arrow)

    rows = got.select("hub", "part", "cls", "digest", "comp", "asks", "answers", "text").repartition("hub", "part")
    return rows.sortWithinPartitions("hub", "part", "cls").mapInArrow(run, kind).distinct().checkpoint()


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _all_links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between numbers of classes, enough to join all that are linked."""
    least = least_matches(percent / 100)
    about = classes.select("cls", "rep", "digest", "n")
    members = _posted(classes, least).join(about, "cls").checkpoint()
    each = members.select("cls", "rep", "digest", "n", F.explode("hubs").alias("hub"))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    groups = each.groupBy("hub").agg(F.count("*").alias("_n"), parts.alias("parts")).where("_n > 1").drop("_n").checkpoint()
    yes, no = F.lit(True), F.lit(False)
    cut = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ("hub", "part", "cls", "rep", "digest", "comp", "asks", "answers")
    each = each.join(groups, "hub")
    asked = each.withColumns({"part": cut(F.col("parts")), "comp": F.col("cls"), "asks": yes, "answers": yes}).select(*columns)
    large = groups.where("parts > 1")
    if large.isEmpty():
        return _links(docs, asked, size, percent, least)
    hubs = large.select("hub", F.col("hub").alias("cls"), every(F.col("parts")).alias("part")).join(about, "cls").withColumns({"comp": F.col("cls"), "asks": yes, "answers": yes})
    links = _links(docs, asked.unionByName(hubs.select(*columns)).distinct(), size, percent, least)
    # those that aren't joined with the smallest member, against all of the group
    comps = components(links)
    named = lambda df, c, name: df.join(comps.select(F.col("id").alias(c), F.col("comp").alias("_c")), c, "left").withColumn(name, F.coalesce("_c", c)).drop("_c")
    rows = named(named(each.where("parts > 1"), "cls", "comp"), "hub", "main").withColumn("apart", F.col("comp") != F.col("main")).checkpoint()
    sizes = rows.groupBy("hub").agg(F.ceil(F.greatest(F.count_if("apart") / (BLOCK // 2), F.sum(F.when(F.col("apart"), F.col("n"))) / (BLOCK_SHINGLES // 2))).cast("int").alias("asking")).where("asking > 0")
    rows = rows.join(sizes, "hub").withColumn("parts", 2 * F.col("parts"))
    asking = rows.where("apart").withColumn("_at", every(F.col("parts"))).withColumn("part", cut(F.col("asking")) * F.col("parts") + F.col("_at")).withColumns({"asks": yes, "answers": no})
    answering = rows.withColumn("_at", every(F.col("asking"))).withColumn("part", F.col("_at") * F.col("parts") + cut(F.col("parts"))).withColumns({"asks": no, "answers": yes})
    return links.unionByName(_links(docs, asking.select(*columns).unionByName(answering.select(*columns)), size, percent, least))


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in `links` (a, b): comp is the smallest id reachable. Each round points every node's
    larger neighbours and then every node at the smallest neighbour, until nothing changes."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct().checkpoint()
    while True:
        n, sources = edges.agg(F.count("*"), F.count_distinct("a")).first()
        # done when every node but the smallest of each component has one edge, to that
        if n == sources and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = with_key(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct().checkpoint()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_key(large, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = small.where("a != b").distinct().checkpoint()


def near_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked where 100 * shared >= percent * all of their distinct `size`-word shingles;
    component_id is the smallest doc_id reachable and kept says whether it is the row's own. A text
    without words has an empty set and is linked with nothing; rows with a null doc_id are linked with
    nothing either, have a null component_id and are kept; repeated rows get equal results; an empty table
    gives none; other columns are ignored.
    """
    rows, classes = _classes(docs, size)
    texts = docs.where(F.col("doc_id").isNotNull())
    comps = components(_all_links(texts, classes, size, percent)).withColumnRenamed("id", "cls").join(classes.select("cls", "rep"), "cls").checkpoint()
    least = comps.groupBy("comp").agg(F.min("rep").alias("least"))
    comps = comps.join(least, "comp").select("cls", "least")
    by_digest = classes.join(comps, "cls", "left").select("digest", F.coalesce("least", "rep").alias("_comp"))
    out = rows.select("doc_id", "n", "digest").join(by_digest, "digest", "left")
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("_comp")).alias("component_id"),
        (alone | (F.col("doc_id") == F.col("_comp"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` of which no smaller doc_id is reachable, all columns as they were.

    Rows without a doc_id stay, and so do all rows that share the id that stays. Only ids to drop are joined, so a row never meets another's text.
    Columns may have any names; an empty table gives none.
    """
    drop = near_components(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_gone"], "left_anti")
