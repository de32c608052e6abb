"""A prefix trie of conversations, built level by level.

At every depth the live conversations are grouped by their node of the depth before and their next turn; a node is named after
its smallest conversation. A conversation that shares its node with no other one is live no longer: the rest of its path is a
chain that needs no grouping. Then the levels are joined from the deepest one back to the root, and leaves and saved tokens are
rolled up. So there are as many rounds as the longest beginning that different conversations share has turns, whatever their
number and length. Copies of a conversation are told by 128 bits and go through all this as one, with their number.

The digest of the conversations that end at a node is the one thing that has to be taken in one order: ids are sorted in
ranges, each range writes the ids of an end one after another, and what it has written is digested range by range.

Defined results: null roles and texts are empty; turns of equal number are ordered by role, then text, and all count, repeated
rows too; rows without a conv_id take no part; a conversation whose turns all fall away stays a member of the root; without
any conversation there is no root and the result is empty; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from causeway.llm._common import written

#: Characters of ids that a task holds for the digests before it sends them on.
HELD = 1 << 22
SEED = 271828
#: The digest of nobody's ids.
NOBODY = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), token (a digest of role and text) and chars (of the text) of every turn."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    at = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    token = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    return rows.select("conv_id", F.row_number().over(at).alias("pos"), token.alias("token"), F.length("text").cast("long").alias("chars"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and the turns (conv_id, depth, token, chars) that they have when each one's first turns
    are taken from the conversation whose number is the next smaller multiple of 100. Of own, all turns (a table)."""
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    ids = own.where("pos = 1").select("conv_id", base.alias("base"), h.alias("h"))
    first = own.where((F.col("conv_id") % 100 == 0) & (F.col("pos") <= 5)).select(F.col("conv_id").alias("base"), F.struct("pos", "token", "chars").alias("head"))
    heads = first.groupBy("base").agg(F.sort_array(F.collect_list("head")).alias("heads"))  # five at most
    ids = ids.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.slice("heads", 1, F.col("h").cast("int")), F.array().cast(heads.schema["heads"].dataType)).alias("heads"))
    taken = ids.select("conv_id", F.explode("heads").alias("x")).select("conv_id", F.col("x.pos").alias("depth"), "x.token", "x.chars")
    rest = own.where(F.col("pos") > h).join(ids.select("conv_id", (F.size("heads") - F.col("h")).alias("shift")), "conv_id")
    return ids.select("conv_id"), taken.unionByName(rest.select("conv_id", (F.col("pos") + F.col("shift")).cast("int").alias("depth"), "token", "chars"))


def ends_digest(members: DataFrame) -> DataFrame:
    """seq and ends_sha256: the digest of the conv_ids of every seq of members (seq, conv_id), in decimal, in ascending order,
    with commas between them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[str]]] = {}
        size = 0
        for batch in batches:
            for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = str(conv)
                held.setdefault(seq, (conv, []))[1].append(text)
                size += len(text) + 1
                if size > HELD:
                    yield _strings(held)
                    held, size = {}, 0
        yield _strings(held)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, str]] = []
            for seq, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if seq != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = seq, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.string()))], ["seq", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])

    ranges = members.select("seq", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    strings = ranges.mapInArrow(write, "seq long, first long, ids string")
    return strings.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(digest, "seq long, ends_sha256 string")


def _strings(held: dict[int, tuple[int, list[str]]]) -> pa.RecordBatch:
    columns = [pa.array(list(held), pa.int64()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([",".join(x[1]) for x in held.values()], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["seq", "first", "ids"])


def sequences(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, seq (the smallest conversation with the same turns) and len of every conversation."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "token")).alias(f"m{seed}")
    own = rows.groupBy("conv_id").agg(mark(SEED), mark(SEED + 1), F.max("depth").alias("len"))
    marks = [f"m{SEED}", f"m{SEED + 1}", "len"]
    marked = written(convs.join(own, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(m), F.lit(0)).alias(m) for m in marks)), "marks")
    least = written(marked.groupBy(*marks).agg(F.min("conv_id").alias("seq")), "seqs")
    return marked.join(least, marks).select("conv_id", "seq", "len")


def levels(rows: DataFrame, root: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of every depth from 1 on while there are live conversations: the grouped rows (seq, parent, token, chars, rest, weight,
    len), and the nodes (conv_id, parent, token, chars, n_convs, n_seqs). Of rows (seq, depth, token, chars, rest, weight, len), a table."""
    steps, nodes = [], []
    live = None
    while True:
        depth = len(steps) + 1
        now = rows.where(F.col("depth") == depth).drop("depth")
        now = now.withColumn("parent", F.lit(root).cast("long")) if live is None else now.join(live, "seq")
        step = written(now, f"live{depth}")
        found = step.groupBy("parent", "token").agg(F.min("seq").alias("conv_id"), F.first("chars").alias("chars"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_seqs"))
        node = written(found, f"nodes{depth}")
        steps.append(step)
        nodes.append(node)
        shared = node.where("n_seqs > 1")
        if shared.isEmpty():
            return steps, nodes
        live = step.where(F.col("len") > depth).join(shared.select("parent", "token", F.col("conv_id").alias("node")), ["parent", "token"]).select("seq", F.col("node").alias("parent"))


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for every node of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves and saved_tokens (both of its subtree), and ends_sha256."""
    convs, rows = rebuilt(written(turns(df, conv, turn, role, text), "turns"))
    return prefix_tree(convs, written(rows, "rebuilt"))


def prefix_tree(convs: DataFrame, all_rows: DataFrame) -> DataFrame:
    """trie() of conversations (conv_id) and their turns (conv_id, depth, token, chars), both tables."""
    of = written(sequences(convs, all_rows), "sequences")
    weights = written(of.groupBy("seq").agg(F.count("*").alias("weight"), F.first("len").alias("len")), "weights")
    alone = weights.where("weight = 1").select("seq", F.sha2(F.col("seq").cast("string"), 256).alias("ends_sha256"))
    several = of.join(weights.where("weight > 1").select("seq"), "seq").select("seq", "conv_id")
    ends = written(alone.unionByName(ends_digest(written(several, "copies"))), "ends")
    rest = F.sum("chars").over(W.partitionBy("seq").orderBy(F.desc("depth")))
    rows = all_rows.withColumnRenamed("conv_id", "seq").join(weights, "seq").withColumn("rest", rest)
    rows = written(rows.sortWithinPartitions("depth"), "rows")
    least, total = of.agg(F.min("conv_id"), F.count("*")).first()
    steps, nodes = levels(rows, least or 0)
    out, below = chains(rows, nodes, ends), None
    for depth in range(len(steps) - 1, -1, -1):
        if depth:
            here, ending = nodes[depth - 1].where("n_seqs > 1"), steps[depth - 1].where(F.col("len") == depth).select("parent", "token", "seq")
            ending = here.join(ending, ["parent", "token"]).select("conv_id", "seq")
            here = here.select("conv_id", "parent", "n_convs", "chars")
        else:
            kind = "conv_id long, parent long, n_convs long, chars long"
            here = rows.sparkSession.createDataFrame([(least, None, total, 0)] if total else [], kind)
            ending = weights.where("len = 0").select(F.lit(least).cast("long").alias("conv_id"), "seq")
        below = written(rolled(here.withColumn("depth", F.lit(depth).cast("long")), ending.join(ends, "seq").drop("seq"), steps[depth], nodes[depth], below), f"shared{depth}")
        out = out.unionByName(below)
    return out.withColumnRenamed("parent", "parent_conv_id")


def rolled(here: DataFrame, ends: DataFrame, step: DataFrame, children: DataFrame, below: DataFrame | None) -> DataFrame:
    """The result's rows for the shared nodes of a depth (conv_id, parent, n_convs, chars, depth), from the step and the nodes
    of the next depth and the rows that this function gave for the shared ones among them."""
    # Nodes of one sequence begin a chain: a leaf, and what its copies save from there on.
    single = children.where("n_seqs = 1").select(F.col("conv_id").alias("seq"))
    parts = step.join(single, "seq").select("parent", F.lit(1).cast("long").alias("leaves"), ((F.col("weight") - 1) * F.col("rest")).alias("saved"))
    if below is not None:
        parts = parts.unionByName(below.select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    sums = parts.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    found = here.join(sums, "conv_id", "left").join(ends, "conv_id", "left")
    filled = lambda c, other: F.coalesce(F.col(c), F.lit(other)).alias(c)
    saved = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))
    return found.select("conv_id", "depth", "parent", "n_convs", filled("n_children", 0), filled("n_leaves", 1), saved.alias("saved_tokens"), filled("ends_sha256", NOBODY))


def chains(rows: DataFrame, nodes: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The result's rows for the nodes of one sequence each."""
    top = reduce(DataFrame.unionByName, (n.where("n_seqs = 1").select(F.col("conv_id").alias("seq"), F.lit(i + 1).alias("top"), "parent") for i, n in enumerate(nodes)))
    chain = rows.join(written(top, "tops"), "seq").where("depth >= top").join(ends, "seq")
    last = F.col("depth") == F.col("len")
    return chain.select(
        F.col("seq").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("seq")).alias("parent"), F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(NOBODY).alias("ends_sha256"),
    )
