"""Signed token hashing of texts into small vectors."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The cut of texts, the width of the vector and the pattern of a token.
CHARS, BUCKETS, TOKEN = 5000, 32, "[a-z]{3,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.substring(F.lower(text), 1, CHARS), F.lit(TOKEN), F.lit(0))


@lru_cache(maxsize=1 << 16)
def bucket_and_sign(token: str) -> tuple[int, float]:
    h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "little")
    return h % BUCKETS, 1.0 if h >> 31 else -1.0


def hash_text(text: Column) -> Column:
    """The normalised vector of a text, by 4-byte BLAKE2b digests; a null text counts as empty."""
    return _hash_tokens(tokens(F.coalesce(text, F.lit(""))))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _hash_tokens(lists: pa.Array) -> pa.Array:
    return _vectors(lists)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def hash_whole(texts: pa.Array) -> pa.Array:
    """hash_text() as a function of the text itself, for SQL."""
    found = [re.findall(TOKEN, (t or "").lower()[:CHARS]) for t in texts.to_pylist()]
    return _vectors(pa.array(found, pa.list_(pa.string())))


def _vectors(lists: pa.Array) -> pa.Array:
    """Of lists of tokens; each token that occurs in the batch is hashed once."""
    words = pc.list_flatten(lists).dictionary_encode()
    row = pc.list_parent_indices(lists).to_numpy()
    known = np.array([bucket_and_sign(w) for w in words.dictionary.to_pylist()]).reshape(-1, 2)[words.indices.to_numpy()]
    out = np.bincount(row * BUCKETS + known[:, 0].astype(np.int64), known[:, 1], len(lists) * BUCKETS).reshape(-1, BUCKETS)
    out = (out / np.maximum(np.linalg.norm(out, axis=1), 1)[:, None]).astype(np.float32)
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), BUCKETS).cast(pa.list_(pa.float32()))


def hash_text_md5(text: Column) -> Column:
    """The normalised vector of a text, by MD5 digests, in doubles and in SQL functions only; a null text counts as empty."""
    return _hashed(tokens(F.coalesce(text, F.lit(""))))


def _hashed(words: Column) -> Column:
    digest = lambda word: F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
    signed = lambda h: (h % BUCKETS + 1) * F.when(h >= 1 << 31, 1).otherwise(-1)
    # A bucket's sum is the number of its tokens with a plus less the number with a minus.
    count = lambda found: F.transform(F.sequence(F.lit(1).cast("long"), F.lit(BUCKETS).cast("long")), lambda k: (F.size(F.array_remove(found, -k)) - F.size(F.array_remove(found, k))).cast("double"))
    norm = lambda sums: F.greatest(F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1.0))
    # Arrays of one element name what is used more than once, so that it is computed once.
    sums = F.transform(F.array(F.transform(F.transform(words, digest), signed)), count)
    both = F.transform(sums, lambda s: F.struct(s.alias("sums"), norm(s).alias("norm")))
    return F.get(F.transform(both, lambda s: F.transform(s["sums"], lambda x: x / s["norm"])), F.lit(0))


def md5_bucket_and_sign(token: Column) -> tuple[Column, Column]:
    """The same with the first 32 bits of an MD5 digest, in SQL functions only."""
    h = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
    return (h % BUCKETS).cast("int"), F.when(h >= 1 << 31, 1).otherwise(-1)
