"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes cuts every text where the bytes themselves say so, so that an insertion moves
no cut but those next to it. Chunks are compared by a 128-bit digest over the whole table; the first one, by document
id, part and position, stays and all others are removed.

Defined results: a null or empty text has no chunks; a text shorter than the least chunk is one chunk; rows with equal
id and text have equal results and do not remove each other; a null id comes before all others; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import _text
from causeway.llm._common import met, written

WINDOW_BITS = 5
LEAST, MOST = 32, 1024
#: Bits of the hash that must be zero at a cut: a chunk has about LEAST + 32 bytes.
MASK = np.uint64(0b11111 << 27)
GEAR = np.random.default_rng(97).integers(0, 2**64, size=256, dtype=np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """The hash of the last 32 bytes at every byte: the byte j before it counts shifted by j bits."""
    h = GEAR[data]
    for k in range(WINDOW_BITS):
        step = 1 << k
        h[step:] += h[:-step] << np.uint64(step)
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of every chunk."""
    marks = (np.flatnonzero((gear(data) & MASK) == 0) + 1).tolist()
    doc, starts, ends, k = [], [], [], 0
    for d in range(len(offsets) - 1):
        start, last = int(offsets[d]), int(offsets[d + 1])
        while start < last:
            stop = min(start + MOST, last)
            while k < len(marks) and marks[k] < start + LEAST:
                k += 1
            if k < len(marks) and marks[k] < stop:
                stop = marks[k]
            if last - stop < LEAST:
                stop = last
            doc.append(d)
            starts.append(start)
            ends.append(stop)
            start = stop
        while k < len(marks) and marks[k] <= last:
            k += 1
    return np.array(doc, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


def chunk_rows(docs: DataFrame, key_type: T.DataType) -> DataFrame:
    """key, part, start, length and digest (high, low) of every chunk of docs (key, part, text)."""
    names = ["key", "part", "start", "length", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _text.slices(batches, "text"):
            doc, start, end = cuts(data, offsets)
            raw = memoryview(np.ascontiguousarray(data))
            digest = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            halves = np.frombuffer(digest, dtype=">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(doc)
            columns = [rows.column(0).take(at), rows.column(1).take(at), pa.array((start - offsets[doc]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names)

    ints, longs = T.IntegerType(), T.LongType()
    kinds = [key_type, longs, ints, ints, longs, longs]
    return docs.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def identified(df: DataFrame, key: str, text: str, *, rest: bool = False) -> DataFrame:
    """key, part and text: rows with one id and different texts are parts of their own. rest: all columns but text, as a struct."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    more = [F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("rest")] if rest else []
    return df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("part"), body.alias("text"), *more)


def with_text(cut: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """df's columns from the rest column of a cut_out(), text being what is left of it."""
    return cut.select(*(F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in df.columns))


def cut_out(docs: DataFrame, spans: DataFrame, key_type: T.DataType) -> DataFrame:
    """docs (key, part, text) without the bytes of their spans (key, part, start, end).

    Gives key, text (what is left; bytes that are no whole characters any more are dropped), n_bytes, n_removed, n_spans
    (maximal runs) and kept_sha256 (of the bytes left), and docs' rest column if it has one.
    """
    own = spans.groupBy("key", "part").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.alias("d").join(own.alias("s"), F.expr("d.key <=> s.key AND d.part = s.part"), "left")
    more = [f for f in docs.schema.fields if f.name == "rest"]
    joined = joined.select("d.key", "d.text", "s.spans", *(f"d.{f.name}" for f in more))
    names = ["key", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(f.name for f in more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _text.slices(batches, "text", 8 << 20):
            lists = rows.column(2)
            out: list[tuple] = []
            for i in range(rows.num_rows):
                body, found = data[offsets[i] : offsets[i + 1]], lists[i]
                if found.is_valid and len(found.values):
                    edge = np.zeros(len(body) + 1, np.int64)
                    np.add.at(edge, found.values.field("start").to_numpy(), 1)
                    np.subtract.at(edge, found.values.field("end").to_numpy(), 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
                    left = body[~gone].tobytes()
                else:
                    n_spans, left = 0, body.tobytes()
                out.append((left.decode("utf-8", "ignore"), len(body), len(body) - len(left), n_spans, hashlib.sha256(left).hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)), *rows.columns[3:]], names)

    longs, strings = T.LongType(), T.StringType()
    kinds = [key_type, strings, longs, longs, longs, strings, *(f.dataType for f in more)]
    return joined.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: key, text without its repeated chunks, n_bytes, n_removed, n_spans and kept_sha256."""
    docs = identified(df, key, text)
    key_type = docs.schema["key"].dataType
    chunks = written(chunk_rows(docs, key_type), "chunks")
    place = F.struct("key", "part", "start")
    first = written(chunks.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    own = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("part") == F.col("first.part")) & (F.col("start") == F.col("first.start"))
    repeated = met(chunks, first, ["high", "low"], "n").where(~own).select("key", "part", "start", (F.col("start") + F.col("length")).alias("end"))
    return cut_out(docs, repeated, key_type).withColumnRenamed("key", key)
