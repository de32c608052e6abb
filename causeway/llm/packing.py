"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised whole, an end id follows each, and only those longer than a sequence are cut. The pieces are
dealt at random to shards of bounded token count, whose number grows with the corpus, and each shard is packed by
best-two-fit: a sequence is filled greedily with the longest pieces that fit; then its smallest piece is taken out if
two pieces that are not packed yet fill the wider gap more tightly. Only lengths are shuffled, no ids.

Defined results: a null or empty text is a document of the end id alone; repeated rows are pieces of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.models import BPE

from causeway.llm._common import written

LENGTH = 4096
END_ID = 1
#: Tokens in a shard at most, about: some thousand sequences, so that at most one in thousands is left short.
SHARD_TOKENS = 1 << 23
#: Strings whose ids a task keeps, twice at most.
CACHE = 1 << 18


def _class(kind: str) -> str:
    """The characters below END_OF_FAST of a Unicode category, for a character class."""
    return "".join(re.escape(chr(i)) for i in range(END_OF_FAST) if unicodedata.category(chr(i))[0] == kind)


#: Texts of characters below this take the fast way; of these, lower() and composition change only single letters.
END_OF_FAST = 0x130
#: Characters that need the slow way: those above, and those that count as space in one library only.
OTHER = re.compile(f"[^\\x00-\\x1b\\x20-{chr(END_OF_FAST - 1)}]")
#: The words of the tokenizer's own pattern for such texts: the same matches, with classes that re can look up.
WORDS = re.compile(f"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_class('L')}{_class('N')}]+")
#: The printable characters that byte-level models have for bytes; the other bytes follow from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = [chr(b) if b in PRINTABLE else chr(0x100 + sum(x not in PRINTABLE for x in range(b))) for b in range(256)]
#: The pattern that WORDS stands for; another tokenizer takes the slow way throughout.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Ids(dict):
    """Ids of strings without white space, put together from their words. What was not met for a while is forgotten."""

    def __init__(self, model: BPE) -> None:
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            words = WORDS.findall(token)
            if len(words) == 1 and words[0] == token:
                found = self.model.tokenize(token if token.isascii() and token.isprintable() else "".join([BYTE_CHARS[b] for b in token.encode()]))
                ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            else:
                ids = b"".join([self[w] for w in words])
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[token] = ids
        return ids


class CachedTokenizer:
    """Ids of a word-level BPE tokenizer. Its merges never cross the words of its own pre-tokenizer, so the ids of what
    stands between white space are kept and texts are put together from them; texts that its normalizer may change
    otherwise than by lower() are encoded whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers") or [{}]
        self.fast = steps[0].get("pattern", {}).get("Regex") == PATTERN and spec["model"].get("end_of_word_suffix") is not None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = _Ids(self.tokenizer.model)

    def forget(self) -> None:
        self.ids.clear()
        self.ids.older = {}

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian numbers."""
        if not self.fast or OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def pieces(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of a document: key, piece, start, length and the CRC-32 of its ids."""
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, step = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * length
        encode = own.encode
        own.forget()  # what a task that broke off left
        for batch in batches:
            encoded = [encode(t or "") + end for t in batch.column(1).to_pylist()]
            size = np.array([len(x) // 4 for x in encoded], np.int64)
            parts = -(-size // length)
            at = np.repeat(np.arange(len(size)), parts)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * length
            sums = [zlib.crc32(x if len(x) <= step else x[i : i + step]) for x in encoded for i in range(0, len(x), step)]
            columns = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(np.minimum(size[at] - start, length)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], ["key", "piece", "start", "length", "ids_crc32"])
        own.forget()  # the worker may live on, without need of them

    kind = dict(docs.dtypes)["key"]
    return docs.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; no length is above capacity."""
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable"):
        stacks.setdefault(int(lengths[i]), []).append(int(i))
    count = [0] * (capacity + 1)
    free = 0  # a bit for each length of which a piece is left
    upto = [(2 << n) - 1 for n in range(capacity + 1)]
    for n, rows in stacks.items():
        count[n] = len(rows)
        free |= 1 << n

    def take(n: int) -> None:
        nonlocal free
        count[n] -= 1
        if not count[n]:
            free &= ~(1 << n)

    def put(n: int) -> None:
        nonlocal free
        count[n] += 1
        free |= 1 << n

    def largest(n: int) -> int:
        """The largest length of at most n that is left, or 0."""
        return max(0, (free & upto[n]).bit_length() - 1)

    bins, offsets, number = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    left = len(lengths)
    while left:
        held, gap = [], capacity
        while gap and (n := largest(gap)):
            take(n)
            held.append(n)
            gap -= n
        left -= len(held)
        if gap and len(held) > 1 and left > 1:
            wide = gap + held[-1]
            best, pair, lower = gap, None, largest(wide - 1)
            while lower and 2 * lower > wide - best:
                take(lower)
                other = largest(min(wide - lower, lower))
                put(lower)
                if other and wide - lower - other < best:
                    best, pair = wide - lower - other, (lower, other)
                    if not best:
                        break
                lower = largest(lower - 1)
            if pair:
                put(held[-1])
                held[-1:] = pair
                for n in pair:
                    take(n)
                left -= 1
        at = 0
        for n in held:
            i = stacks[n].pop()
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(parts: DataFrame, *, capacity: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """parts with sequence_id and offset. Pieces that fill a sequence get one of their own."""
    total = parts.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    shard = F.pmod(F.xxhash64("key", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"], pdf["offset"] = (pdf["shard"].to_numpy() << 32) + bins, offsets
        return pdf.drop(columns="shard")

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return parts.withColumn("shard", shard).groupBy("shard").applyInPandas(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Key, piece, start, length, ids_crc32, sequence_id and offset of every piece of df's documents."""
    parts = written(pieces(df, tokenizer_path, key, text, length=length, end_id=end_id), "pieces")
    return pack(parts, capacity=length).withColumnRenamed("key", key)
