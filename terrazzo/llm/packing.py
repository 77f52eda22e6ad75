"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of documents. In each round, one window long, every queue earns its target share of
a window and is served what it has saved once that is a slice or more; what it isn't served it keeps, and
what it was served beyond its share it owes.

The rounds are one sequence over all partitions, which are packed at the same time: a queue that earns its share
till it ends has served a known number of tokens at each time, so the tokens counted by source say which
token of each source a partition begins and ends with. Documents are sent to the partitions of their tokens,
cut where a partition ends, so each has all sources in their proportions however the table lies.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ddl, map_batches

WINDOW = 1024
#: A queue is served no less than this, unless it ends; it bounds the pieces a window is cut into.
SLICE = 128
#: Tokens that a task holds in its queues, or the next document's.
BLOCK_TOKENS = 1 << 20
#: Windows of a partition at least.
LEAST_WINDOWS = 16
#: Numbers in the table of savings by partition and queue; more sources than fit share queues by hash, but for those a mixture names.
MOST_CELLS = 1 << 22
#: A table of counts by input partition and source of at most so many rows (about 50 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: What sources that a mixture doesn't name earn, all of them together, while those that it names last.
REST = 1e-9
IDS = "p int, doc_id long, source string, n long, place long, ids binary"
SPREAD = "part int, at double, place long, source string, share double, total long, doc_id long, start long, length long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sequence_lengths(tokens: int, window: int = WINDOW) -> Iterator[int]:
    """Full windows, then the rest as falling powers of two: no sequence needs padding."""
    for _ in range(tokens // window):
        yield window
    rest = tokens % window
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            yield 1 << bit


def sequence_count(tokens: int, window: int = WINDOW) -> int:
    return tokens // window + (tokens % window).bit_count()


def clock(totals: np.ndarray, share: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The times at which so many tokens are served, if each queue is served its share of time until it ends."""
    ends = totals / share
    order = np.argsort(ends)
    beyond = np.append(np.cumsum(share[order][::-1])[::-1][1:], 0)
    served = np.maximum.accumulate(np.cumsum(totals[order]) + ends[order] * beyond)
    return np.interp(tokens, np.append(0, served), np.append(0, ends[order]))


@dataclass
class Cuts:
    """Where partitions begin: the times of all but the first, from which each source's own cuts follow."""

    times: np.ndarray

    @property
    def partitions(self) -> int:
        return len(self.times) + 1

    def first(self, part: int, share: float, total: int) -> int:
        """The token of a source with which a partition begins; `partitions` itself stands for the end."""
        if part <= 0 or part >= self.partitions:
            return 0 if part <= 0 else total
        return min(total, math.floor(share * self.times[part - 1]))

    def part(self, place: int, share: float, total: int) -> int:
        """The partition of a source's token."""
        return bisect_right(range(self.partitions), place, key=lambda k: self.first(k + 1, share, total))

    def saved(self, part: int, share: float, total: int) -> float:
        """What a source has earned and not been served when a partition begins."""
        return min(float(total), share * self.times[part - 1]) - self.first(part, share, total) if part else 0.0


def pack(blocks: Iterator[list[tuple]], share: Mapping, savings: Mapping, tokens: int, first: int, window: int = WINDOW, slice_tokens: int = SLICE) -> Iterator[tuple]:
    """Pieces of one partition. A block's rows are (doc_id, queue, ids as uint32 bytes), and of a part of a document its start and the document's tokens.
    share and savings are asked for a queue when its first row is there."""
    lengths = sequence_lengths(tokens, window)
    sequence, offset, room = first, 0, next(lengths, 0)
    earn: dict = {}
    saved: dict = {}
    queues: dict[int, deque] = {}
    left: dict[int, int] = {}
    starts: dict[int, int] = {}  # tokens of the head document that are served, by queue
    paid: dict[int, int] = {}  # the round up to which a queue has earned
    active: list[int] = []
    turn, held, more = 0, 0, True
    while True:
        if more and held < BLOCK_TOKENS:
            while more and held < BLOCK_TOKENS:
                block = next(blocks, None)
                more = block is not None
                for doc_id, q, ids, *of in block or ():
                    n = len(ids) // 4
                    if q not in earn:
                        earn[q] = float(share[q]) * window
                        # queues that earn less than a slice a round begin at different points of it, so as not to be served all in the same round
                        saved[q] = float(savings[q]) + (slice_tokens * (zlib.crc32(repr(q).encode()) * 0.618034 % 1) if earn[q] >= 1 else 0)
                    queues.setdefault(q, deque()).append((doc_id, memoryview(ids), n, *(of or (0, n))))
                    left[q] = left.get(q, 0) + n
                    held += n
            active = sorted(q for q in queues if left[q])
        if not active:
            break
        turn += 1
        served = False
        for q in active:
            saved[q] += earn[q] * (turn - paid.get(q, 0))
            paid[q] = turn
            take = min(int(saved[q]), left[q])
            if take <= 0 or take < min(slice_tokens, left[q]):
                continue
            served = True
            saved[q] -= take
            left[q] -= take
            held -= take
            docs, start = queues[q], starts.get(q, 0)
            while take:
                doc_id, ids, n, begin, whole = docs[0]
                k = min(take, n - start, room)
                yield doc_id, begin + start, k, zlib.crc32(ids[4 * start : 4 * (start + k)]), whole, sequence, offset
                take, start, offset, room = take - k, start + k, offset + k, room - k
                if start == n:
                    docs.popleft()
                    start = 0
                if not room:
                    sequence, offset, room = sequence + 1, 0, next(lengths, 0)
            starts[q] = start
        active = [q for q in active if left[q]]
        if active and not served:  # the rounds in which nobody could be served, at once
            turn += min(max(0, math.ceil((min(slice_tokens, left[q]) - saved[q]) / earn[q]) - 1) for q in active)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """IDS: a document's ids and then end_id, with its input partition p and the place of its first id among those of its source in there. A null text has end_id alone."""
    kind = ddl(IDS)
    arrow = to_arrow_schema(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(vocabulary)
        end, wide = end_id.to_bytes(enc.dtype.itemsize, "little"), enc.dtype.itemsize
        p, place = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            out = []
            for doc_id, text, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = (enc(text) if text else b"") + end
                source, n = "+" + source if source is not None else "-", len(ids) // wide
                out.append((p, doc_id, source, n, place[source], ids))
                place[source] += n
            yield _batch(out, arrow)

    return docs.select("doc_id", "text", "source").mapInArrow(encode, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _shares(counts: DataFrame, mixture: dict[str, float]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(p, source, before, total, share) from counts (p, source, n), and the totals and shares of the sources that the mixture
    names and of the others together, as the clock needs them. A source's row for each input partition, and nothing more, is one group."""
    of_source = W.partitionBy("source")
    rows = counts.select("p", "source", F.coalesce(F.sum("n").over(of_source.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(of_source).alias("total"))
    every = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where(F.col("source").isin(list(mixture))).groupBy("source").agg(F.sum("n")).collect() if mixture else []  # no more than the mixture has
    weights = {q: max(0.0, mixture[q]) for q, _ in known}
    if not sum(weights.values()):
        return rows.withColumn("share", F.col("total") / F.lit(float(max(1, every)))), np.array([float(every)]), np.array([1.0])
    part = F.lit(REST / every) * F.col("total")
    named = {q: w / sum(weights.values()) for q, w in weights.items()}
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("source")), F.lit(0.0))
    totals = {q: float(n) for q, n in known}
    rest = every - sum(totals.values())
    share = [named[q] + REST / every * totals[q] for q in named]
    return rows.withColumn("share", own + part), np.array([totals[q] for q in named] + [rest] * (rest > 0)), np.array(share + [REST / every * rest] * (rest > 0))


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", mixture: dict[str, float] | None = None, window: int = WINDOW, slice_tokens: int = SLICE, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    mixture: target shares by source (those not named get what is left over, in their own proportions); default: the corpus's own. There may be any
    number of sources. A null or empty text is the one id end_id; a null source is a source; a null doc_id stays null; each of
    repeated rows is packed; an empty table gives no piece; other columns are ignored. Ids are computed once
    and kept in the checkpoint folder, two bytes a token, and shuffled once to the partitions of their
    turns; there a task holds BLOCK_TOKENS of them, or the next document's. Counts by partition and source stay in tables: only a number or two for
    each partition, and the totals of sources that the mixture names, come to the driver.
    """
    ids = tokenized(docs, vocabulary, end_id).checkpoint()
    counts = ids.groupBy("p", "source").agg(F.sum("n").alias("n")).checkpoint()
    shares, totals, share = _shares(counts, {"+" + k: v for k, v in (mixture or {}).items()})
    if counts.count() <= BROADCAST_ROWS:
        shares = F.broadcast(shares)
    every = int(totals.sum())
    partitions = int(min(max(1, ids.rdd.getNumPartitions()), max(1, every // (window * LEAST_WINDOWS))))
    # a queue is served its share of time until it ends, so equal counts of tokens are these times
    cuts = Cuts(clock(totals, share, every * np.arange(1, partitions) / partitions) if every else np.zeros(0))
    placed = ids.join(shares, ["p", "source"]).withColumn("place", F.col("place") + F.col("before"))
    where = docs.sparkSession.sparkContext.broadcast(cuts)
    spread, pieces = ddl(SPREAD), ddl(PIECES)
    spread_arrow, arrow = to_arrow_schema(spread), to_arrow_schema(pieces)

    def pieces_of(place: int, n: int, share: float, total: int) -> Iterator[tuple[int, int, int]]:
        """(partition, start, length) of a document's parts."""
        start, at = 0, where.value
        part = at.part(place, share, total)
        while start < n:
            k = min(n, at.first(part + 1, share, total) - place) - start
            if k > 0:
                yield part, start, k
                start += k
            part += 1

    def count(rows: list[list]) -> Iterator[tuple]:
        sums: dict[int, int] = defaultdict(int)
        for row in zip(*rows, strict=True):
            for part, _, k in pieces_of(*row):
                sums[part] += k
        yield from sums.items()

    lengths = map_batches(placed, count, "part int, n long", ["place", "n", "share", "total"]).groupBy("part").agg(F.sum("n").alias("n")).collect()  # a number for each partition
    tokens = np.zeros(cuts.partitions, np.int64)
    for part, n in lengths:
        tokens[part] = n
    first = np.concatenate([[0], np.cumsum([sequence_count(int(t), window) for t in tokens])])
    plan = docs.sparkSession.sparkContext.broadcast((tokens, first))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, source, n, place, total, share, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                wide = len(raw) // n
                for part, start, k in pieces_of(place, n, share, total):
                    out.append((part, (place + start) / share, place + start, source, share, total, doc_id, start, k, n, raw if k == n else raw[wide * start : wide * (start + k)]))
            yield _batch(out, spread_arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        shares: dict[str, float] = {}
        saved: dict[str, float] = {}

        def blocks(rows: Iterator[tuple]) -> Iterator[list]:
            block, size = [], 0
            for part, q, share, total, doc_id, start, k, n, raw in rows:
                if q not in shares:
                    shares[q], saved[q] = share, where.value.saved(part, share, total)
                block.append((doc_id, q, np.frombuffer(raw, f"<u{len(raw) // k}").astype("<u4").tobytes(), start, n))
                size += k
                if size >= BLOCK_TOKENS // 8:
                    yield block
                    block, size = [], 0
            if block:
                yield block

        out: list[tuple] = []
        for part, of in groupby(rows, key=lambda row: row[0]):
            shares.clear()
            saved.clear()
            tokens, first = plan.value
            for piece in pack(blocks(of), shares, saved, int(tokens[part]), int(first[part]), window, slice_tokens):
                out.append(piece)
                if len(out) >= 20_000:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    sent = placed.select("doc_id", "source", "n", "place", "total", "share", "ids").mapInArrow(send, spread).repartitionById(cuts.partitions, "part")
    return sent.sortWithinPartitions("part", "at", "source", "place").select("part", "source", "share", "total", "doc_id", "start", "length", "n", "ids").mapInArrow(run, pieces)
