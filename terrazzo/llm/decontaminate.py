"""Benchmark decontamination by suffix arrays of the training texts.

A task takes its documents as shards of bounded size. A shard's words are numbers of the test set's words, and 0 for all
others; runs of test words too short to hold a window are left out, and what remains, run after run with a 0 between
them, gets a suffix array by prefix doubling. Every suffix of the test items is searched in it by bisection, which gives its longest
verbatim match; where that is as long as a window, two more bisections give all places at which the window occurs.

The test set is searched in blocks of at most about BLOCK_WORDS words, each sent to all tasks; the documents pass each
block in turn, with what earlier blocks found in them, and are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ddl, map_batches

#: Consecutive words that count as contamination.
WINDOW = 10
#: Words of test items in a block, about, and of an item that are searched as one text; longer ones are cut into overlapping spans.
BLOCK_WORDS, SPAN_WORDS = 1 << 19, 1 << 16
#: Words of a shard, unless one document has more, and bytes of text that are split at once.
SHARD_WORDS, PIECE_BYTES = 1 << 20, 1 << 20

#: Words are runs of digits, letters and what isn't ASCII; A-Z count as a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE) if text else b""
    start = 0
    while start < len(raw):
        end = len(raw) if len(raw) - start <= PIECE_BYTES else raw.find(b" ", start + PIECE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` (numbers from 0) in order of their suffixes' first `depth` numbers or more; what is beyond the end counts as less than any."""
    n = len(text)
    bits = max(1, int(text.max(initial=0) + 1).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits
        if i < n:
            key[: n - i] |= text[i:] + 1
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        if k >= depth or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank << 32
        if k < n:
            key[: n - k] |= rank[k:]
        k *= 2


def common_prefix(text: np.ndarray, at: np.ndarray, test: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many numbers text[at:] and test[begin:end] have in common at their beginnings, for all at once."""
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero((at < len(text)) & (begin < end))
    while len(live):
        k = length[live]
        live = live[text[at[live] + k] == test[begin[live] + k]]
        length[live] += 1
        live = live[(at[live] + length[live] < len(text)) & (begin[live] + length[live] < end[live])]
    return length


def bisect(text: np.ndarray, order: np.ndarray, test: np.ndarray, begin: np.ndarray, end: np.ndarray, after: bool) -> np.ndarray:
    """For each test[begin:end] the number of suffixes below it, or, with `after`, of those below it or beginning with it."""
    lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) >> 1
        at, b, e = order[mid], begin[live], end[live]
        k = common_prefix(text, at, test, b, e)
        whole = k == e - b
        inside = ~whole & (at + k < len(text))
        less = ~whole & ~inside  # the suffix ends first
        less[inside] = text[(at + k)[inside]] < test[(b + k)[inside]]
        right = less | (whole & after)
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return lo


@dataclass
class Tests:
    """A block of test texts: `text` has their words' numbers with a 0 after each; suffixes and distinct windows are places in it."""

    vocabulary: dict[bytes, int]
    text: np.ndarray
    begin: np.ndarray  # of each suffix that is searched
    end: np.ndarray
    item: np.ndarray  # of each suffix
    offset: np.ndarray  # of each suffix in its item
    window: np.ndarray  # of each suffix: the number of its window, or -1
    first: np.ndarray  # of each window: the first suffix that begins with it
    width: np.ndarray  # of each window: its words
    items: list[np.ndarray]  # of each window: its items

    @staticmethod
    def of(spans: list[tuple[int, int, list[bytes], bool]], size: int = WINDOW) -> Tests:
        """From (item_id, place in the item, words, whether the span is the whole item)."""
        vocabulary: dict[bytes, int] = {}
        numbers: list[int] = []
        begin, end, item, offset, of, windows = [], [], [], [], [], {}
        for item_id, at, words, whole in spans:
            start = len(numbers)
            numbers += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            stop = len(numbers)
            numbers.append(0)
            w = min(size, len(words)) if whole else size
            for i in range(start, stop):
                key = tuple(numbers[i : i + w]) if i + w <= stop else None
                begin.append(i)
                end.append(stop)
                item.append(item_id)
                offset.append(at + i - start)
                of.append(-1 if key is None else windows.setdefault(key, len(windows)))
        window = np.array(of, np.int64)
        first = np.full(len(windows), -1, np.int64)
        has = np.flatnonzero(window >= 0)[::-1]
        first[window[has]] = has
        ids = np.array(item, np.int64)
        by = has[np.argsort(window[has], kind="stable")]
        cut = np.searchsorted(window[by], np.arange(1, len(windows)))
        items = [np.unique(x) for x in np.split(ids[by], cut)] if windows else []
        return Tests(vocabulary, np.array(numbers, np.int64), np.array(begin, np.int64), np.array(end, np.int64), ids, np.array(offset, np.int64), window, first, np.array([len(key) for key in windows], np.int64), items)


class Shard:
    """Documents of a task, as one text of the tests' numbers and its suffix array."""

    def __init__(self, tests: Tests, documents: list[np.ndarray]):
        size = np.array([len(d) for d in documents], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(size + 1)])
        words = np.zeros(self.starts[-1], np.int64)
        for start, d in zip(self.starts, documents):
            words[start : start + len(d)] = d
        edge = np.diff((words > 0).astype(np.int8), prepend=0, append=0)
        run, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stop - run >= tests.width.min(initial=WINDOW)
        run, n = run[long], (stop - run)[long]
        # the runs with a 0 after each
        at = np.concatenate([[0], np.cumsum(n + 1)])
        self.place = np.repeat(run - at[:-1], n + 1) + np.arange(at[-1])
        self.text = words[self.place] * (self.place < np.repeat(run + n, n + 1))
        self.tests = tests
        self.order = suffix_array(self.text, int((tests.end - tests.begin).max(initial=0)))

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each test suffix the length of its longest match, and the place in the shard's words."""
        t = self.tests
        if not len(self.order):
            return np.zeros(len(t.begin), np.int64), np.zeros(len(t.begin), np.int64)
        below = bisect(self.text, self.order, t.text, t.begin, t.end, False)
        sides = [self.order[np.clip(below + d, 0, len(self.order) - 1)] for d in (-1, 0)]
        length = [common_prefix(self.text, s, t.text, t.begin, t.end) for s in sides]
        left = length[0] > length[1]
        return np.where(left, *length), self.place[np.where(left, *sides)]

    def windows(self, length: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(window, words, places in the shard's words) of every window that occurs, from the suffixes' longest matches."""
        t = self.tests
        width = t.width
        met = np.flatnonzero(length[t.first] >= width)
        begin = t.begin[t.first[met]]
        lo, hi = (bisect(self.text, self.order, t.text, begin, begin + width[met], after) for after in (False, True))
        for w, n, a, b in zip(met.tolist(), width[met].tolist(), lo.tolist(), hi.tolist()):
            yield w, n, self.place[self.order[a:b]]


def _numbers(vocabulary: dict[bytes, int], text: str | None) -> np.ndarray:
    parts = [np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)) for words in split_words(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _spans(items: DataFrame, size: int) -> DataFrame:
    """(item_id, at, words, whole, block) of the items, words joined by spaces; `block` is of 0 to the number of blocks."""

    def cut(rows: list[list]) -> Iterator[tuple]:
        for item_id, text in zip(*rows):
            words = [w for piece in split_words(text) for w in piece]
            for at in range(0, max(1, len(words) - size + 1), SPAN_WORDS):
                span = words[at : at + SPAN_WORDS + size - 1]
                if span:
                    yield item_id, at, b" ".join(span), len(span) == len(words), len(span)

    return map_batches(items.where(F.col("item_id").isNotNull()), cut, "item_id long, at long, words binary, whole boolean, n long", ["item_id", "text"]).distinct().checkpoint()


def test_blocks(items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Tests, bool]]:
    """The items' texts, about block_words words at a time, dealt by hash; with each, whether it is the last."""
    spans = _spans(items, size)
    blocks = max(1, -(-(spans.agg(F.sum("n")).first()[0] or 0) // block_words))
    dealt = spans.withColumn("_block", F.pmod(F.xxhash64("item_id", "at", "words"), F.lit(blocks)))
    for k in range(blocks):
        rows = dealt.where(F.col("_block") == k).orderBy("item_id", "at", "words").collect()  # a block
        yield Tests.of([(r.item_id, r.at, bytes(r.words).split(), r.whole) for r in rows], size), k == blocks - 1


def _shards(rows: Iterator[tuple], tests: Tests) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Runs of rows whose last value is a text, with the texts' numbers, of SHARD_WORDS words or one row."""
    held, numbers, words = [], [], 0
    for row in rows:
        n = _numbers(tests.vocabulary, row[-1])
        if held and words + len(n) > SHARD_WORDS:
            yield held, numbers
            held, numbers, words = [], [], 0
        held.append(row)
        numbers.append(n)
        words += len(n) + 1
    if held:
        yield held, numbers


def _pass(docs: DataFrame, tests: Tests, last: bool) -> DataFrame:
    """`docs` (doc_id, n_words, starts, ends, items, text) with what the block of tests adds; the last pass drops the text."""
    kind = ddl("doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>" + ("" if last else ", text string"))
    arrow = to_arrow_schema(kind)
    sent = docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            for held, numbers in _shards(zip(*(c.to_pylist() for c in b.columns)), t):
                found = _hits(Shard(t, numbers), [(r[2], r[3], r[4]) for r in held])
                out = [(r[0], len(n), *f, r[5])[: len(arrow)] for r, n, f in zip(held, numbers, found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.mapInArrow(run, kind)


def _hits(shard: Shard, before: list[tuple]) -> Iterator[tuple]:
    """(starts, ends, items) of each document: merged runs of words that windows cover, and the items of those, with those found before."""
    length, _ = shard.longest()
    places, widths, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for w, n, at in shard.windows(length):
        places.append(at)
        widths.append(np.full(len(at), n))
        windows.append(np.full(len(at), w))
    place, width, window = np.concatenate(places), np.concatenate(widths), np.concatenate(windows)
    order = np.argsort(place, kind="stable")
    place, width, window = place[order], width[order], window[order]
    cut = np.searchsorted(place, shard.starts)
    for d, (starts, ends, items) in enumerate(before):
        lo, hi = cut[d], cut[d + 1]
        if lo == hi:
            yield starts, ends, items
            continue
        a = np.concatenate([np.array(starts, np.int64), place[lo:hi] - shard.starts[d]])
        z = np.concatenate([np.array(ends, np.int64), place[lo:hi] - shard.starts[d] + width[lo:hi]])
        by = np.argsort(a, kind="stable")
        a, z = a[by], np.maximum.accumulate(z[by])
        new = np.append(True, a[1:] > z[:-1])
        ids = np.unique(np.concatenate([np.array(items, np.int64), *(shard.tests.items[w] for w in np.unique(window[lo:hi]))]))
        yield a[new], z[np.append(np.flatnonzero(new)[1:] - 1, len(z) - 1)], ids


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, starts, ends, items, one row per input row: the runs of words, from 0 and without the end, that windows of
    the items (item_id, text) cover, and the ids of those items in order.

    A window is `size` consecutive words of an item, or all of an item that has fewer. A null text has no words; an item
    without words or without an id has no window; items that repeat, or share an id, count once; a null doc_id stays null; repeated rows each
    give a row; an empty table of either kind is fine; a very long text is one shard, in memory in proportion to it; other columns are ignored.
    """
    none = F.array().cast("array<bigint>")
    out = docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), none.alias("starts"), none.alias("ends"), none.alias("items"), F.col("text").cast("string").alias("text"))
    for tests, last in test_blocks(items, size, block_words):
        out = _pass(out, tests, last)
    return out


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from contamination()."""
    found = contamination(docs, items)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, item_start, length, doc_id, doc_start: for each place of an item the longest verbatim match of `size` words or more
    with any document that has an id, in words, at the first place of the smallest doc_id that has one so long in its shard.

    Every suffix of the items is searched in every shard of documents; of its matches one for each shard is compared with the other
    shards'. A match doesn't go beyond the end of an item, nor of a span of SPAN_WORDS words of one.
    """
    kind = ddl("item_id long, item_start long, length long, doc_id long, doc_start long")
    arrow = to_arrow_schema(kind)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    found = None
    for tests, _ in test_blocks(items, size, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            t = sent.value
            for b in batches:
                for held, numbers in _shards(zip(*(c.to_pylist() for c in b.columns)), t):
                    shard = Shard(t, numbers)
                    length, place = shard.longest()
                    hit = np.flatnonzero(length >= size)
                    d = np.searchsorted(shard.starts, place[hit], side="right") - 1
                    ids = np.array([r[0] for r in held], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (t.item[hit], t.offset[hit], length[hit], ids[d], place[hit] - shard.starts[d])], schema=arrow)

        part = rows.mapInArrow(run, kind)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("item_id", "item_start").agg(F.min(F.struct((-F.col("length")).alias("_l"), "doc_id", "doc_start")).alias("_b"))
    return best.select("item_id", "item_start", (-F.col("_b._l")).alias("length"), "_b.doc_id", "_b.doc_start")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of `docs` without the affected documents, all columns as they were. Rows that share an id go if one of them holds
    a window; rows without an id stay."""
    found = contamination(docs, items, size)
    affected = found.where((F.size("items") > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_affected")).distinct()
    return docs.join(affected, docs["doc_id"] == F.col("_affected"), "left_anti")
