"""What the text operators share: batch maps over documents, bounded labelled samples, word hashing."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words as the contracts define them: runs without ASCII white space.
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"\w+")


def ddl(schema: str) -> T.StructType:
    """A schema from its DDL text, without a session."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<int>": T.ArrayType(T.IntegerType()), "array<long>": T.ArrayType(T.LongType()), "array<double>": T.ArrayType(T.DoubleType()), "array<string>": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in schema.split(","))])


def map_rows(df: DataFrame, fn: Callable[..., tuple], schema: str, columns: Iterable[str]) -> DataFrame:
    """Give each row's `columns` to `fn`, batch by batch over Arrow; `fn` returns the values of `schema`.

    Only the named columns cross to Python, so other columns of the input can have any name or type.
    """
    return map_batches(df, lambda rows: map(fn, *rows), schema, columns)


def map_batches(df: DataFrame, fn: Callable[[list[list]], Iterable[tuple]], schema: str, columns: Iterable[str]) -> DataFrame:
    """As map_rows, but `fn` gets the batch's columns as lists and yields rows of `schema`."""
    kind = ddl(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(fn([c.to_pylist() for c in b.columns]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, kind)


class Hasher:
    """crc32 of a word modulo `buckets`, remembered for up to `most` words."""

    def __init__(self, buckets: int, most: int = 200_000):
        self.buckets, self.most, self.seen = buckets, most, {}

    def __call__(self, word: str) -> int:
        h = self.seen.get(word)
        if h is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            h = self.seen[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        return h


def fold(doc_id: str = "doc_id", n: int = 3):
    """crc32(doc_id as text) mod n; null where doc_id is null."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled ids, the smallest by hash, so the same at each run: a row for each.

    `rows` bounds the table of ids that is broadcast, and the result. An id that `labels` repeats counts once with its
    largest label; one that several documents have counts once with the text of the least hash; a document without
    an id or a label isn't drawn.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return one_of_each(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("_y").alias("label")))


def one_of_each(rows: DataFrame) -> DataFrame:
    """One of the rows (doc_id, text, ...) of each id, that of the least hash; a task hands on one row of an id, however many it has."""
    others = [c for c in rows.columns if c != "doc_id"]
    least = F.min(F.struct(F.xxhash64(*others).alias("_h"), *others)).alias("_r")
    return rows.groupBy("doc_id").agg(least).select("doc_id", *[F.col(f"_r.{c}").alias(c) for c in others])
