"""Suffix-array deduplication of substrings: one bucket of suffixes at a time, long ties by ranks of a difference cover.

A byte goes if it lies in a string of 50 bytes that also starts in a document with a smaller id. So the suffixes of all
documents are put in order as far as their first 50 bytes tell, and a run of neighbours that agree in these (a common
prefix of 50 bytes or more) gives each of its members the run's smallest id.

1. Suffixes are dealt into buckets that no two equal windows of 50 bytes can miss each other in. A bucket by the first bytes
   of each suffix would need a row for every byte of text; instead the suffixes of a neighbourhood travel together, in the
   bucket of an anchor: of the 20-byte strings that start in a window, the last one with the smallest hash, which equal
   windows have at the same place. Anchors that are found in one document only are dropped first, since no window around
   them can repeat. Around every anchor that is left goes its context, the text of the windows that it is the anchor of.
2. A bucket is sorted part by part (whole anchors). Equal contexts become one, with the smallest id that has it. In the
   contexts of a part, the positions of a difference cover modulo 31 are ranked first, by 48 bytes each. Then all suffixes
   are sorted by their first 32 bytes, and ties are settled by the cover: for any two positions there is a shift of 2 to 32
   bytes that takes both to ranked ones. Memory is bounded by the part, and no suffix is compared beyond these bytes.
3. Neighbours in that order are compared on their 50 bytes; the windows with a smaller id than their document's are cut out.

Hashes only choose where bytes meet: what counts as equal has been compared byte by byte, but for whole texts, which are
copies if their MD5, a second hash and their lengths agree.

What a task finds equal in its own rows it settles by itself and sends once, so a passage that a large part of all documents
shares arrives once for each slice of documents. Those arrive in one part.

Defined results: a null or empty text has 0 bytes and nothing is removed; rows with one id do not remove each other's
bytes; a null id is smaller than all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import _text
from causeway.llm._common import met, written
from causeway.llm.chunks import cut_out, identified, with_text

LENGTH = 50
GRAM = 20
#: Bytes of text whose samples make a bucket, about.
BUCKET_BYTES = 16 << 20
#: Bytes of text in which a task settles by itself what is equal.
SEND_BYTES = 2 << 20
#: Contexts that are sorted at a time in a bucket.
PART = 1 << 13
#: Windows that are hashed at a time, few enough for a processor's cache.
BLOCK = 1 << 15
#: Low bits of a hash that give way to the place.
PLACE = np.uint64(2**31 - 1)
U = np.uint64
#: A perfect difference set modulo 31; any two residues have one common shift into it.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes by which all suffixes are sorted before ranks are asked.
DIRECT = 32


def samples(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, and first and last start of the windows of each anchor."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none
    hashes, place = np.empty(len(data) - gram + 1, U), np.empty(n, np.int64)
    up, down = _text.powers(BLOCK + length)
    back, wide = PLACE - np.arange(BLOCK + length, dtype=U), length - gram + 1
    for start in range(0, n, BLOCK):
        part = data[start : start + BLOCK + length - 1]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_text.BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        h = _text.mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        hashes[start : start + len(h)] = h
        # the upper bits of the hash, then how far the place is from the end: of the smallest hashes the last one is least
        h = (h & ~PLACE) | back[: len(h)]
        span = 1
        while span < wide:
            step = min(span, wide - span)
            h = np.minimum(h[step:], h[:-step])
            span += step
        place[start : start + len(h)] = (PLACE - (h & PLACE)).astype(np.int64) + start
    edge = np.append(True, place[1:] != place[:-1])
    holds = np.diff(offsets) >= length
    edge[offsets[:-1][holds]] = True
    end = offsets[1:][holds] - length + 1
    edge[end[end < n]] = True
    first = np.flatnonzero(edge)
    doc = np.searchsorted(offsets, first, "right") - 1
    valid = first + length <= offsets[doc + 1]
    last = np.append(first[1:], n) - 1
    first, last, doc = first[valid], last[valid], doc[valid]
    return hashes[place[first]], doc, first, last


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that sorts like them; zeros follow the end."""
    w = raw.astype(U)
    for k in (1, 2, 4):
        w[:-k] = w[:-k] << U(8 * k) | w[k:]
        w[-k:] <<= U(8 * k)
    return w


def agree(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which strings of size bytes (8 at least) at a and at b are equal."""
    out = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        at = np.minimum(k, size - 8)
        out &= words[a + at] == words[b + at]
    return out


def _shifts() -> np.ndarray:
    """The shift for two residues: at most DIRECT, and so that both are in the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    return np.array([[next(d for d in range(DIRECT - PERIOD + 1, DIRECT + 1) if inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


SHIFTS = _shifts()


def _by_group(group: np.ndarray) -> np.ndarray:
    """A stable order of numbers below 2**32, by their lower and then by their upper half (which sort in linear time)."""
    order = np.argsort((group & 0xFFFF).astype(np.uint16), kind="stable")
    return order if not len(group) or group.max() < 1 << 16 else order[np.argsort((group[order] >> 16).astype(np.uint16), kind="stable")]


def _ordered(padded: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings at ``at`` by size bytes, eight at a time as long as there are ties, and which of them differ
    from the one before."""
    key = padded[at]
    order = np.argsort(key)
    key = key[order]
    edge = np.append(True, key[1:] != key[:-1])[: len(at)]
    for k in range(8, size, 8):
        tied = ~edge
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group, key = np.cumsum(edge[where]) - 1, padded[at[order[where]] + k]
        by = np.argsort(key)
        by = by[_by_group(group[by])]
        order[where] = order[where[by]]
        key = key[by]
        edge[where[1:]] |= key[1:] != key[:-1]
    return order, edge


def runs(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at`` by their first bytes, length at least, and where in it begins a run of suffixes
    that agree in length bytes. words: those of the text, from words8()."""
    padded = np.append(words, np.zeros(length + 2 * DIRECT, U))
    # The cover's ranks. Agreement of two suffixes after a shift, which is 2 at least, settles a window of length bytes.
    covered = np.flatnonzero(np.isin(np.arange(len(words) + DIRECT) % PERIOD, COVER))
    order, new = _ordered(padded, covered, length - (DIRECT - PERIOD + 1))
    rank = np.zeros(len(words) + DIRECT + 1, np.int32)
    rank[covered[order]] = np.cumsum(new)
    order, edge = _ordered(padded, at, DIRECT)
    # Ties: every group is split by how its members compare with the one in its middle, until none has unlike members.
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(at)))
    first, size = first[size > 1], size[size > 1]
    while len(first):
        group = np.repeat(np.arange(len(first)), size)
        where = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + first[group]
        p, q = at[order[where]], at[order[first + size // 2]][group]
        d = SHIFTS[p % PERIOD, q % PERIOD]
        side = 3 * group + np.sign(rank[p + d] - rank[q + d]) + 1
        by = np.argsort(side, kind="stable")
        order[where] = order[where[by]]
        side = side[by]
        begin = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        edge[where[begin]] = True
        size = np.diff(np.append(begin, len(side)))
        more = (size > 1) & (side[begin] % 3 != 1)
        first, size = where[begin[more]], size[more]
    # What is told apart may still agree in length bytes, the ranks looking further.
    told = np.flatnonzero(edge)[1:]
    edge[told] = ~agree(padded, at[order[told]], at[order[told - 1]], np.full(len(told), length))
    return order, np.flatnonzero(edge)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
    for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _ids(rows: pa.RecordBatch, doc: np.ndarray) -> tuple[pa.Array, pa.Array]:
    at = pa.array(doc)
    return rows.column(0).take(at), rows.column(1).take(at)


def _lists(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _tags(h: np.ndarray) -> np.ndarray:
    """32 bits of the hashes. Two that agree only in these cost a needless context, no more."""
    return (h >> U(32)).astype(np.uint32)


def _shared(docs: DataFrame, key_type: T.DataType, buckets: int, length: int, gram: int) -> DataFrame:
    """key, part and the tags (binary) of samples that another text has too; several rows a document. Of equal texts in
    a slice only that with the smallest id is looked at: the others are cut out as copies."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("known", T.BooleanType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("parts", T.ArrayType(T.LongType())), T.StructField("counts", T.BinaryType()), T.StructField("tags", T.BinaryType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _text.slices(batches, "text", SEND_BYTES):
            h, doc, _, _ = samples(data, offsets, length, gram)
            part = rows.column(1).to_numpy()
            order = np.lexsort((_ranks(rows.column(0)), part))
            one = np.zeros(rows.num_rows, bool)
            one[order[np.append(True, np.diff(part[order]) != 0)]] = True
            h, doc = h[one[doc]], doc[one[doc]]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
            h, doc = h[new], doc[new]
            first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
            # what several texts of this slice have is known to be shared; one of them stands for it elsewhere
            for known, pick in ((False, first), (True, ~first | np.append(~first[1:], False)[: len(first)])):
                hh, dd = h[pick], doc[pick]
                for bucket, at in _by_bucket((hh % U(buckets)).astype(np.int64)):
                    at = at[np.argsort(dd[at], kind="stable")]
                    own, count = np.unique(dd[at], return_counts=True)
                    keys, parts = _ids(rows, own)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([known]), _lists(keys), _lists(parts), pa.array([count.astype(np.int32).tobytes()]), pa.array([_tags(hh[at]).tobytes()])], schema.names)

    out = T.StructType([T.StructField("key", key_type), T.StructField("part", T.LongType()), T.StructField("tags", T.BinaryType())])

    def find(table: pa.Table) -> pa.Table:
        keys, parts = (pc.list_flatten(table.column(c)).combine_chunks() for c in ("keys", "parts"))
        counts, tags = (table.column(c).to_pylist() for c in ("counts", "tags"))
        count, h = np.frombuffer(b"".join(counts), np.int32), np.frombuffer(b"".join(tags), np.uint32)
        known = np.repeat(table.column("known").to_numpy(zero_copy_only=False), [len(x) // 4 for x in tags])
        doc = np.repeat(np.arange(len(count)), count)
        part = parts.to_numpy()[doc]
        ask = np.flatnonzero(~known)
        order = ask[np.lexsort((part[ask], h[ask]))]
        same = h[order[1:]] == h[order[:-1]]
        edge = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
        last = np.append(edge[1:], len(order)) - 1
        hit = known.copy()
        hit[order] = np.repeat(part[order[edge]] != part[order[last]], last - edge + 1)
        at = np.flatnonzero(hit)
        edge = np.searchsorted(doc[at], np.arange(len(count) + 1))
        has = np.flatnonzero(edge[1:] > edge[:-1])
        found = [h[at[edge[d] : edge[d + 1]]].tobytes() for d in has]
        return pa.table({"key": keys.take(pa.array(has)), "part": parts.take(pa.array(has)), "tags": pa.array(found, pa.binary())})

    return docs.mapInArrow(send, schema).groupBy("bucket").applyInArrow(find, out)


def _ranks(keys: pa.Array) -> np.ndarray:
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) if len(keys) else np.zeros(0, np.int64)


def _joined(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings (size bytes of raw from begin on) one after another, and where each begins."""
    place = np.cumsum(size) - size
    return raw[np.repeat(begin - place, size) + np.arange(size.sum())], place


def _leads(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every string (size bytes of raw from begin on) the number of an equal one with the smallest rank."""
    whole = _text.span(_text.prefix(raw), begin, begin + size)
    order = np.lexsort((rank, whole))
    edge = np.append(True, (whole[order][1:] != whole[order][:-1])) if len(order) else np.zeros(0, bool)
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(edge)][np.cumsum(edge) - 1] if len(order) else 0
    other = np.flatnonzero(lead != np.arange(len(lead)))
    same = size[other] == size[lead[other]]
    same[same] = agree(words8(raw), begin[other[same]], begin[lead[other[same]]], size[other[same]])
    lead[other[~same]] = other[~same]
    return lead


def _spans(key_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", key_type), T.StructField("part", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _repeats(docs: DataFrame, key_type: T.DataType, buckets: int, length: int, gram: int) -> DataFrame:
    """Spans (key, part, start, end) to cut out of docs (key, part, text, tags: a list of binaries)."""
    fields = [("bucket", T.IntegerType()), ("known", T.BooleanType()), ("keys", T.ArrayType(key_type)), ("parts", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(n, k) for n, k in fields + [(c, T.BinaryType()) for c in ("counts", "tags", "first", "size", "bytes")]])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _text.slices(batches, "text", SEND_BYTES):
            lists = rows.column(3).to_pylist()
            asked = [np.frombuffer(b"".join(x), np.uint32).astype(U) | U(i << 32) for i, x in enumerate(lists) if x]
            if not asked:
                continue
            h, doc, first, last = samples(data, offsets, length, gram)
            keep = np.isin(_tags(h).astype(U) | doc.astype(U) << U(32), np.concatenate(asked))
            h, doc, first, size = h[keep], doc[keep], first[keep], last[keep] - first[keep] + length
            # Equal contexts of this slice: the smallest id's is sent, the others lie in it. Rows with that id are sent too.
            rank = _ranks(rows.column(0))
            known_row = rank[doc] > rank[doc[_leads(data, first, size, rank[doc])]]
            for known in (False, True):
                pick = np.flatnonzero(known_row == known)
                for bucket, at in _by_bucket((h[pick] % U(buckets)).astype(np.int64)):
                    at = pick[at]
                    at = at[np.argsort(doc[at], kind="stable")]
                    own, count = np.unique(doc[at], return_counts=True)
                    keys, parts = _ids(rows, own)
                    raw = b"" if known else b"".join([data[a : a + s].tobytes() for a, s in zip(first[at], size[at], strict=True)])
                    packed = [count.astype(np.int32), np.zeros(0, np.uint32) if known else _tags(h[at]), (first[at] - offsets[doc[at]]).astype(np.int32), size[at].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([known]), _lists(keys), _lists(parts), *(pa.array([x.tobytes()]) for x in packed), pa.array([raw], pa.binary())], schema.names)

    def sort(table: pa.Table) -> pa.Table:
        keys, parts = (pc.list_flatten(table.column(c)).combine_chunks() for c in ("keys", "parts"))
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        count, first, size = joined("counts", np.int32), joined("first", np.int32), joined("size", np.int32).astype(np.int64)
        rows = [len(x) // 4 for x in table.column("first").to_pylist()]
        known = np.repeat(table.column("known").to_numpy(zero_copy_only=False), rows)
        doc = np.repeat(np.arange(len(count)), count)
        rank = _ranks(keys)
        h = np.zeros(len(known), np.uint32)
        h[~known] = joined("tags", np.uint32)
        raw = joined("bytes", np.uint8)
        begin = np.cumsum(np.where(known, 0, size)) - np.where(known, 0, size)
        at = np.flatnonzero(known)
        out = [(doc[at], first[at], first[at] + size[at])]

        at = np.flatnonzero(~known)
        at = at[np.argsort(h[at], kind="stable")]
        hash_edge = np.flatnonzero(np.append(True, h[at][1:] != h[at][:-1])) if len(at) else np.zeros(0, np.int64)
        i = 0
        while i < len(at):  # a part of the bucket: whole anchors
            j = int(np.searchsorted(hash_edge, i + PART, "left"))
            j = int(hash_edge[j]) if j < len(hash_edge) else len(at)
            part = at[i:j]
            i = j
            own, n = rank[doc[part]], size[part] - length + 1
            body, place = _joined(raw, begin[part], size[part])
            lead = _leads(body, place, size[part], own)
            rep, inverse = np.unique(lead, return_inverse=True)
            many = n[rep]
            base = np.cumsum(many) - many
            body, place = _joined(body, place[rep], size[part[rep]])
            owner = np.repeat(np.arange(len(rep)), many)
            order, run = runs(words8(body), np.repeat(place - base, many) + np.arange(len(owner)), length)
            least = np.empty(len(owner), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(own[rep][owner[order]], run), np.diff(np.append(run, len(order))))
            entry = np.repeat(np.arange(len(part)), n)
            offset = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
            gone = least[base[inverse[entry]] + offset] < own[entry]
            head = gone & (~np.append(False, gone[:-1]) | (offset == 0))
            tail = gone & (~np.append(gone[1:], False) | (offset == n[entry] - 1))
            e, a, b = entry[head], offset[head], offset[tail]
            out.append((doc[part[e]], first[part[e]] + a, first[part[e]] + b + length))
        d, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        own = pa.array(d)
        return pa.table({"key": keys.take(own), "part": parts.take(own), "start": pa.array(a.astype(np.int32)), "end": pa.array(b.astype(np.int32))})

    return docs.mapInArrow(send, schema).groupBy("bucket").applyInArrow(sort, _spans(key_type))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each row of df: key, text without the repeated bytes, n_bytes, n_removed, n_spans and kept_sha256."""
    return _cut(identified(df, key, text), length, gram).withColumnRenamed("key", key)


def replaced(df: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """df with what is left of its texts."""
    return with_text(_cut(identified(df, key, text, rest=True), length, gram), df, text)


def _cut(docs: DataFrame, length: int, gram: int) -> DataFrame:
    key_type, plain = docs.schema["key"].dataType, docs.select("key", "part", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-total // BUCKET_BYTES))
    # Copies of a text with a smaller id go whole, if they have a window at all, and take no further part.
    texts = written(plain.select("key", "part", F.md5("text").alias("sum"), F.octet_length("text").alias("end")).where(F.col("end") >= length), "texts")
    least = written(texts.groupBy("part", "sum", "end").agg(F.min(F.struct("key")).alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    copies = met(texts, least, ["part", "sum", "end"], "n").where(~F.col("key").eqNullSafe(F.col("least.key"))).select("key", "part", F.lit(0).alias("start"), "end").distinct()
    copies = written(copies, "copies")
    shared = _shared(plain, key_type, buckets, length, gram).groupBy("key", "part").agg(F.collect_list("tags").alias("tags"))
    shared = shared.alias("s").join(copies.alias("c"), F.expr("s.key <=> c.key AND s.part = c.part"), "left_anti")
    asked = plain.alias("d").join(shared.alias("s"), F.expr("d.key <=> s.key AND d.part = s.part"), "left").select("d.key", "d.part", "d.text", "s.tags")
    spans = _repeats(asked, key_type, buckets, length, gram).unionAll(copies)
    return cut_out(docs, spans, key_type)
