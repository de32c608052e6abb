"""N-gram Jaccard join on count vectors, with an R-tree over group counts.

A document's set holds its distinct word shingles. Hashing the shingles into groups and counting each group turns the set
into a point; the sum of the smaller of two points' coordinates bounds their overlap from above, and so does the sum over
the corner of a rectangle that encloses points. Documents with the same set are one point, its smallest id standing for
all.

An R-tree prunes points of unlike sizes and compositions, but in so many dimensions its rectangles overlap, so the points
are first dealt into blocks that no linked pair can miss: shingles have one order for all documents (the rarer first, by a
count sketch of the whole table; then by hash), and two sets with a similarity of s share one among the first
n - ceil(s n) + 1 of either. Every document is then linked in two rounds. First it meets, in each of its blocks, the
block's smallest document; what is found linked becomes one component. Then the blocks that still hold several components
are searched with an R-tree for pairs of different components. So a group of near copies, however large, needs a pair for
each of its members, not all pairs, and no link between two components is lost. The bound decides which pairs are
verified, by the sets themselves.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is its own component; a
text of fewer words than a shingle has its whole sequence as its one shingle; rows that share an id are one node, linked
with whatever one of them is linked with; rows with a null id get a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import _text
from causeway.llm._common import SLICE_BYTES, free_name, written
from causeway.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Fewest groups of a point; there are more for larger sets, a power of two with two to four shingles in each.
GROUPS = 64
FULL = 255
#: So many ids are sent to all tasks to fetch the texts of candidates (16 MB); more are joined.
BROADCAST_ROWS = 500_000
#: Counters of the sketch that tells rare shingles from common ones; its size is fixed.
SKETCH = 1 << 20
PIECES = 64
LEAF = 32
#: Documents of a block that meet in one task; a larger block is dealt into parts, every two of which meet.
MEETING = 1 << 13


def sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, sorted, one text after another, and where each text begins."""
    texts = len(offsets) - 1
    start, end, doc = _text.words(data, offsets)
    hashes = _text.span(_text.prefix(data, _text.LOWER_VALUES), start, end)
    grams = _text.shingles(hashes, n)
    at = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    values, owner = grams[at], doc[at]
    many = np.bincount(doc, minlength=texts)
    short = np.flatnonzero((many > 0) & (many < n))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = [_text.shingles(hashes[i : i + many[d]], int(many[d]))[0] for d, i in zip(short, first, strict=True)]
        values, owner = np.concatenate((values, np.array(whole, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(texts + 1))


def required(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of two sets of these sizes that are linked."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How common the shingles of each counter are: the binary logarithm of their count over the mean, as 0 to 63.

    A task sends its counters in pieces, sparse ones by number; pieces are added up in two steps.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for _, data, offsets in _text.slices(batches, "text"):
            counts += np.bincount((sets(data, offsets, n)[0] >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
        rows = []
        for i, piece in enumerate(counts.reshape(PIECES, -1)):
            at = np.flatnonzero(piece)
            rows.append((i, at.astype(np.uint16).tobytes(), piece[at].astype(np.uint32).tobytes()))
        part, at, value = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["piece", "at", "value"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // PIECES, dtype=np.int64)
        for at, value in zip(pdf["at"], pdf["value"], strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(value, np.uint32)
        at = np.flatnonzero(total)
        value = np.minimum(total[at], 2**32 - 1).astype(np.uint32)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "at": [at.astype(np.uint16).tobytes()], "value": [value.tobytes()]})

    kind = "piece int, at binary, value binary"
    parts = docs.mapInArrow(count, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    added = parts.groupBy("piece", "part").applyInPandas(add, kind).groupBy("piece").applyInPandas(add, kind)
    counts = np.zeros((PIECES, SKETCH // PIECES))
    for r in added.collect():  # PIECES rows of fixed size, whatever the input
        counts[r["piece"], np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.uint32)
    mean = max(1.0, counts.mean())
    return np.clip(np.log2(np.maximum(counts.ravel() / mean, 1)), 0, 63).astype(np.uint8)


def groups_of(size: np.ndarray | int, percent: int = PERCENT) -> np.ndarray:
    """How many groups the point of a set has: those of the band above its own, in which it may be asked for."""
    top = (100 / percent) ** (bands(size, percent) + 2)
    return np.maximum(GROUPS, 1 << np.ceil(np.log2(top / 4)).astype(np.int64).clip(0, 40))


def bands(size: np.ndarray | int, percent: int = PERCENT) -> np.ndarray:
    """Sizes in a ratio of at most percent to 100 are in one band or in neighbouring ones."""
    return np.floor(np.log(size) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _counted(values: np.ndarray, at: np.ndarray, percent: int) -> list[bytes]:
    """How many shingles of each text fall in each of its groups, in a byte each; a point with a larger count is full
    everywhere, which bounds nothing."""
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        groups = int(groups_of(b - a, percent)) if b > a else 0
        point = np.bincount((values[a:b] & np.uint64(groups - 1)).astype(np.int64), minlength=groups) if b > a else np.zeros(0, np.int64)
        out.append((np.full(groups, FULL) if groups and point.max() >= FULL else point).astype(np.uint8).tobytes())
    return out


def _folded(points: list[bytes], groups: int) -> np.ndarray:
    """Points with so many groups as a matrix; those with more are added up."""
    out = np.empty((len(points), groups), np.uint16)
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(points):
        by_length.setdefault(len(p), []).append(i)
    for length, rows in by_length.items():
        raw = np.frombuffer(b"".join([points[i] for i in rows]), np.uint8).reshape(len(rows), length // groups, groups)
        out[rows] = np.where((raw == FULL).all(axis=(1, 2))[:, None], 65535, raw.sum(axis=1, dtype=np.uint16))
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bound on the overlap of points; where both are full there is none."""
    total = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return np.where(total >= 65535 * a.shape[1], np.iinfo(np.int64).max, total)


def _points(docs: DataFrame, key_type: T.DataType, common: np.ndarray, n: int, percent: int) -> DataFrame:
    """key, size, digest of the set (high, low), its points and its first shingles in the common order."""
    heat = docs.sparkSession.sparkContext.broadcast(common)
    names = ["key", "size", "high", "low", "point", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _text.slices(batches, "text"):
            values, at = sets(data, offsets, n)
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            with np.errstate(over="ignore"):
                high = np.array([np.add.reduce(_text.mix(values[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64)
                low = np.array([np.add.reduce(_text.mix(values[a:b] ^ np.uint64(0x9E3779B97F4A7C15))) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64)
            point = _counted(values, at, percent)
            order = np.lexsort((_text.mix(values), heat.value[(values >> np.uint64(44)).astype(np.int64)], owner))
            ranked = values[order]
            many = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
            first = [ranked[a : a + m].tobytes() for a, m in zip(at[:-1], many, strict=True)]
            columns = [rows.column(0), pa.array(size.astype(np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(point, pa.binary()), pa.array(first, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [key_type, T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType(), T.BinaryType()]
    return docs.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]))


def _block_rows(points: DataFrame, key_type: T.DataType, percent: int) -> DataFrame:
    """token, key and role of every first shingle; a document can be a pair's smaller one by those with role true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                size = part.column(1).to_numpy()
                lists = [np.frombuffer(b, np.int64) for b in part.column(2).to_pylist()]
                many = [len(x) for x in lists]
                as_smaller = np.minimum(many, size - required(size.astype(np.int64), size.astype(np.int64), percent) + 1)
                token = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                role = np.concatenate([np.arange(m) < s for m, s in zip(many, as_smaller, strict=True)]) if lists else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(token), part.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(role)], ["token", "key", "role"])

    return points.select("key", "size", "tokens").mapInArrow(run, T.StructType([T.StructField("token", T.LongType()), T.StructField("key", key_type), T.StructField("role", T.BooleanType())]))


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and points allow a link."""
    side = lambda c: points.select(F.col("key").alias(c), F.col("size").alias(f"{c}_size"), F.col("point").alias(f"{c}_point"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            sizes = [get(c).to_numpy().astype(np.int64) for c in ("a_size", "b_size")]
            need, groups = required(*sizes, percent), groups_of(np.minimum(*sizes), percent)
            points, ok = [get(c).to_pylist() for c in ("a_point", "b_point")], np.zeros(batch.num_rows, bool)
            for g in np.unique(groups):
                at = np.flatnonzero(groups == g)
                a, b = (_folded([p[i] for i in at], int(g)) for p in points)
                ok[at] = _overlap(a, b) >= need[at]
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([get("a").filter(ok), get("b").filter(ok)], ["a", "b"])

    kind = points.schema["key"].dataType
    return sized.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose sets are linked, by the texts themselves."""
    ids = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    docs = docs.join(ids, "key", "left_semi")
    both = pairs.join(docs.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a").join(docs.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = {c: batch.schema.get_field_index(c) for c in ("a", "b", "a_text", "b_text")}
            size = np.cumsum(np.add(*(pc.binary_length(batch.column(index[c])).to_numpy() for c in ("a_text", "b_text"))))
            i = 0
            while i < batch.num_rows:  # parts of bounded text, or one pair
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, "right")))
                part, i, ok = batch.slice(i, j - i), j, []
                found = [sets(*_text.buffers(part.column(index[c])), n) for c in ("a_text", "b_text")]
                (av, aa), (bv, ba) = found
                for k in range(part.num_rows):
                    x, y = av[aa[k] : aa[k + 1]], bv[ba[k] : ba[k + 1]]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * same >= percent * (len(x) + len(y) - same))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(index["a"]).filter(keep), part.column(index["b"]).filter(keep)], ["a", "b"])

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, pairs.schema)


class RTree:
    """Points packed into leaves by size and their heaviest coordinates; a node keeps the corner that bounds it."""

    def __init__(self, size: np.ndarray, point: np.ndarray) -> None:
        spread = np.argsort(-point.var(axis=0))[:2]
        self.order = np.lexsort((point[:, spread[1]], point[:, spread[0]] // 4, size))
        self.size, self.point = size[self.order], point[self.order]
        at = np.arange(0, len(size), LEAF)
        self.levels = [(np.minimum.reduceat(self.size, at), np.maximum.reduceat(self.size, at), np.maximum.reduceat(self.point, at, axis=0))]
        while len(self.levels[-1][0]) > 1:
            low, high, corner = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at, axis=0)))

    def search(self, size: int, point: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the points whose size and bound allow a link with this one."""
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            low, high, corner = (x[nodes] for x in self.levels[level])
            ok = (100 * high >= percent * size) & (percent * low <= 100 * size)
            ok &= _overlap(corner, point) >= required(np.maximum(low, -(-percent * size // 100)), size, percent)
            below = len(self.levels[level - 1][0]) if level else len(self.size)
            nodes = (nodes[ok][:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        ok = (100 * np.minimum(self.size[nodes], size) >= percent * np.maximum(self.size[nodes], size)) & (_overlap(self.point[nodes], point) >= required(self.size[nodes], size, percent))
        return self.order[nodes[ok]]


def _near(block: np.ndarray, size: np.ndarray, point: np.ndarray, part: np.ndarray, role: np.ndarray, home: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block and different components, at least one of them at home, that the bound lets through.
    Small blocks are a single leaf each and are compared all at once; larger ones get a tree."""
    left, right = [], []
    edge = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    many = np.diff(np.append(edge, len(block)))
    single = np.repeat(many <= LEAF, many)
    for step in range(1, int(min(many.max(initial=1), LEAF))):
        i = np.flatnonzero((block[step:] == block[:-step]) & single[step:])
        j = i + step
        ok = (part[i] != part[j]) & (role[i] | role[j]) & (home[i] | home[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        ok = _overlap(point[i], point[j]) >= required(size[i], size[j], percent)
        left.append(i[ok])
        right.append(j[ok])
    for start, length in zip(edge[many > LEAF], many[many > LEAF], strict=True):
        rows = slice(start, start + length)
        tree, c, r, h = RTree(size[rows], point[rows]), part[rows], role[rows], home[rows]
        for i in np.flatnonzero(h):
            found = tree.search(int(size[start + i]), point[start + i], percent)
            found = found[(c[found] != c[i]) & (r[found] | r[i]) & ((found < i) | ~h[found])]
            left.append(np.full(len(found), start + i))
            right.append(start + found)
    return (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))


def _across(blocks: DataFrame, key_type: T.DataType, percent: int) -> DataFrame:
    """For documents a, lists near of larger ids in other components that the bound lets through, from the blocks (token,
    band, meeting, home, key, part, role, size, point). A block's rows follow one another in a partition; only the last, unfinished block of a batch is held."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # All rows of a block have its band, and fold their points to as many groups as its smallest sets have.
        band = table.column("band").to_numpy()
        groups = groups_of((100 / percent) ** (band - 1.0), percent)
        for g in np.unique(groups):
            part = table.take(pa.array(np.flatnonzero(groups == g)))
            get = lambda c, part=part: part.column(c).to_numpy()
            a, b = _near(get("block"), get("size").astype(np.int64), _folded(part.column("point").to_pylist(), int(g)), get("part"), get("role"), get("home"), percent)
            keys = part.column("key").combine_chunks()
            a, b = keys.take(pa.array(a)), keys.take(pa.array(b))
            found = pa.table({"a": pc.min_element_wise(a, b), "b": pc.max_element_wise(a, b)}).group_by("a").aggregate([("b", "distinct")])
            yield from found.rename_columns({"b_distinct": "near"}).select(["a", "near"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            block = table.column("block").to_numpy()
            done = int(np.searchsorted(block, block[-1]))
            held = table.slice(done)
            if done:
                yield from pairs(table.slice(0, done))
        if held is not None:
            yield from pairs(held)

    sorted_ = blocks.withColumn("block", F.xxhash64("token", "band", "meeting")).select("block", "band", "key", "part", "role", "home", "size", "point").repartition("block").sortWithinPartitions("block")
    return sorted_.mapInArrow(run, T.StructType([T.StructField("a", key_type), T.StructField("near", T.ArrayType(key_type))]))


def classes(docs: DataFrame, *, n: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Of docs (key, text): the table of points (key, size, ...), and key and component of the keys that are linked with
    another one or share another one's set."""
    key_type = docs.schema["key"].dataType
    points = _points(docs, key_type, sketch(docs.select("text"), n), n, percent)
    points = written(points.withColumn("row", F.monotonically_increasing_id()), "points")
    full = points.where("size > 0 and key is not null")
    of_set = written(full.groupBy("high", "low", "size").agg(F.min(F.struct("key", "row")).alias("first"), F.count("*").alias("copies")), "sets")
    # One row stands for a set: one with the smallest id.
    reps = full.join(of_set.select("first.row"), "row", "left_semi")
    rows = _block_rows(reps, key_type, percent)
    # A block matters if it has two documents, one of them in the smaller one's role; the smallest of these leads it.
    leaders = rows.groupBy("token").agg(F.min(F.when(F.col("role"), F.col("key"))).alias("leader"), F.count("*").alias("n")).where("n > 1 and leader is not null").drop("n")
    met = written(rows.join(leaders, "token"), "blocks")
    lean = points.join(of_set.select("first.row"), "row", "left_semi").select("key", "size", "point")
    pairs = met.where("key <> leader").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
    near = written(_bounded(pairs, lean, percent), "pairs")
    links = written(_verified(near, docs, n, percent), "links")
    found = components(links)

    placed = met.select("token", "key", "role").join(found, met["key"] == found["node"], "left").select("token", "key", "role", F.coalesce("component", "key").alias("component"))
    several = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / MEETING).alias("parts")).where("low <> high").select("token", "parts")
    rows = placed.join(several, "token").join(lean, "key").withColumn("part", F.xxhash64("component"))
    # A pair's sizes differ by a quarter at most, so it meets in the band of the larger one.
    band = F.floor(F.ln("size") / F.ln(F.lit(100 / percent)) + F.lit(1e-9)).cast("int")
    banded = rows.withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("home", F.col("own") == F.col("band")).drop("own")
    mine, other = F.pmod(F.xxhash64("key"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    banded = banded.withColumn("mine", mine).withColumn("other", other).withColumn("meeting", F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"))
    lists = _across(banded, key_type, percent).groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    across = written(lists.select("a", F.explode("near").alias("b")), "across")
    more = _verified(written(_bounded(across, lean, percent), "pairs"), docs, n, percent)
    # Copies of a set hang on its smallest id; rows that share an id hang together by that id.
    copies = full.join(of_set.where("copies > 1"), ["high", "low", "size"]).where("key <> first.key").select(F.col("key").alias("a"), F.col("first.key").alias("b"))
    return points, components(links.unionAll(more).unionAll(copies))


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", *, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of df: key, n_shingles and component_id."""
    docs = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    points, found = classes(docs, n=n, percent=percent)
    return points.join(found, points["key"] == found["node"], "left").select(F.col("key").alias(key), F.col("size").cast("long").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", *, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of df that have their component's smallest id; rows with a null id stay."""
    docs = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    _, found = classes(docs, n=n, percent=percent)
    node = free_name(df, "node")
    gone = found.where("node <> component").select(F.col("node").alias(node))
    return df.join(gone, df[key] == gone[node], "left_anti")
