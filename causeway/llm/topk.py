"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers and grouped by length into buckets (of which the shortest vector has at least a fixed
share of the longest one's length), large buckets into blocks of bounded size. A first look at one bounded block gives
every query a score that its k-th best answer has at least. A query then meets a block only with its local cosine
threshold, that score divided by its own and the block's largest length: above 1 the block is passed over; where the
threshold is high, candidates are pruned coordinate by coordinate, on the few largest of the query's coordinates; else by
length. What is left is verified by integer products, and the best k of each query over all blocks remain.

Queries go to the candidates in packed blocks, so no pair of single vectors is shuffled. Which blocks meet is settled on
their numbers alone, dealt out over many keys: those are left out whose longest vector is too short for all queries of a
block.

Defined results: rows whose id or vector is null, or whose vector holds null or non-finite components, take no part;
vectors of different dimensions never meet; ties go to the smaller id; repeated rows are candidates of their own (but no
row with the query's own id is); with fewer candidates than k all are returned; an empty table gives an empty result.
Scores are exact while the sums of products stay within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from causeway.llm._common import written

SCALE = 1024
BLOCK = 8192
#: The shortest vector of a bucket has at least this share of the length of the longest.
RATIO = 0.9
#: Local cosine threshold from which candidates are pruned by coordinates.
COORDINATE_FROM = 0.9
FOCUS = 3
PACKED = "dim int, bucket int, block long, longest double, ids binary, matrix binary"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """The vectors of a block as one row, the longest first."""
    pdf = pdf.sort_values(["length", "id"], ascending=[False, True])
    head = pdf.iloc[0]
    matrix = np.array(pdf["vector"].to_list(), dtype=np.int64).reshape(len(pdf), int(head["dim"]))
    if np.abs(matrix).max(initial=0) < 2**31:
        matrix = matrix.astype(np.int32)
    return pd.DataFrame([{"dim": int(head["dim"]), "bucket": int(head["bucket"]), "block": int(head["block"]), "longest": float(head["length"]), "ids": pdf["id"].to_numpy(np.int64).tobytes(), "matrix": matrix.tobytes()}])


def _blocks(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """rows (id, vector, dim, length, bucket) packed into blocks of about size vectors that agree in by."""
    count = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = rows.join(F.broadcast(count), by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return dealt.groupBy(*by, "block").applyInPandas(_pack, PACKED)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where all sums stay below 2**53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < 2**53 else a @ b.T


def search_block(qid: np.ndarray, q: np.ndarray, least: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, candidate id and score of a block's best k for every query, of those with a score of at least
    ``least`` (-inf where nothing is known). The candidates are sorted by falling length."""
    q_len, p_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
    top = q_len * p_len[0]
    local = np.where(top > 0, least / np.where(top > 0, top, 1), np.where(least > 0, np.inf, -np.inf)) - 1e-9
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best(rows: np.ndarray, cand: np.ndarray) -> None:
        scores = products(q[rows], p[cand])
        ok = (scores >= least[rows][:, None]) & (pid[cand][None, :] != qid[rows][:, None])
        if len(cand) > 4 * k:  # of each query, what is below its k-th best score in this block goes
            kth = np.partition(np.where(ok, scores, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
            ok &= scores >= kth[:, None]
        r, c = np.nonzero(ok)
        found.append((rows[r], pid[cand[c]], scores[r, c]))

    unit_p = p / np.where(p_len > 0, p_len, 1)[:, None]
    by_coordinate = (local <= 1) & (local >= COORDINATE_FROM)
    for i in np.flatnonzero(by_coordinate):
        unit_q = q[i] / q_len[i]
        left = np.arange(len(p))
        for f in np.argsort(-np.abs(unit_q))[:FOCUS]:
            x = unit_p[left, f]
            left = left[unit_q[f] * x + np.sqrt(np.maximum(0, (1 - unit_q[f] ** 2) * (1 - x * x))) >= local[i]]
        if len(left):
            best(np.array([i]), left)
    rest = np.flatnonzero((local <= 1) & ~by_coordinate)
    for part in (rest[i : i + 256] for i in range(0, len(rest), 256)):
        # by length: |q| |p| bounds the product, so a prefix of the block is enough
        bound = np.where(q_len[part] > 0, least[part] / np.where(q_len[part] > 0, q_len[part], 1), -np.inf) * (1 - 1e-9)
        cut = int(np.searchsorted(-p_len, -bound.min(), "right")) if bound.min() > 0 else len(p)
        if cut:
            best(part, np.arange(cut))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    start = np.searchsorted(r, r, "left")
    keep = np.arange(len(r)) - start < k
    return r[keep], c[keep], s[keep]


def top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *, is_query: Column, k: int = 10, block: int = BLOCK, ratio: float = RATIO) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of every query's k best candidates."""
    whole = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    rows = df.where(F.col(f"`{key}`").isNotNull() & usable(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").cast("long").alias("id"), is_query.alias("asks"), whole.alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.withColumns({"dim": F.size("vector"), "length": length})
    rows = rows.withColumn("bucket", F.when(F.col("length") > 0, F.floor(-F.ln("length") / F.lit(-np.log(ratio)))).otherwise(1 << 30).cast("int"))
    cand = written(_blocks(rows.drop("asks"), ["dim", "bucket"], block), "candidates")
    asked = _blocks(rows.where("asks").drop("asks").withColumn("bucket", F.lit(0)), ["dim", "bucket"], block)
    # One block of the longest vectors, of bounded size, gives the first scores.
    seed = {r["dim"]: (r["ids"], r["matrix"]) for r in cand.groupBy("dim").agg(F.min_by(F.struct("ids", "matrix"), F.struct("bucket", "block")).alias("s")).select("dim", "s.*").orderBy("dim").limit(4).collect()}

    def rows_of(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.frombuffer(ids, np.int64)
        narrow = len(matrix) == 4 * len(i) * dim
        return i, np.frombuffer(matrix, np.int32 if narrow else np.int64).astype(np.int64).reshape(len(i), dim)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qid, q = rows_of(r["ids"], r["matrix"], r["dim"])
                least = np.full(len(qid), -np.inf)
                if r["dim"] in seed:
                    n, _, s = search_block(qid, q, least, *rows_of(*seed[r["dim"]], r["dim"]), k)
                    full = np.flatnonzero(np.bincount(n, minlength=len(qid)) == k)
                    worst = np.full(len(qid), np.inf)
                    np.minimum.at(worst, n, s)
                    least[full] = worst[full]
                size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                # a candidate shorter than this answers no query of the block
                reach = np.where(size > 0, least / np.where(size > 0, size, 1), np.where(least > 0, np.inf, -np.inf)) * (1 - 1e-9)
                row = {"dim": r["dim"], "question": r["block"], "reach": float(reach.min(initial=np.inf)), "asked": r["ids"], "q": r["matrix"], "least": least.tobytes()}
                yield pa.RecordBatch.from_pylist([row], kind)

    kind = pa.schema([("dim", pa.int32()), ("question", pa.int64()), ("reach", pa.float64()), ("asked", pa.binary()), ("q", pa.binary()), ("least", pa.binary())])
    queries = written(asked.mapInArrow(look, "dim int, question long, reach double, asked binary, q binary, least binary"), "queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                qid, q = rows_of(r["asked"], r["q"], r["dim"])
                n, c, s = search_block(qid, q, np.frombuffer(r["least"], np.float64), *rows_of(r["ids"], r["matrix"], r["dim"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[n]), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    salts = max(1, -(-cand.count() // 64))
    numbers = cand.select("dim", "bucket", "block", "longest", F.pmod(F.xxhash64("bucket", "block"), F.lit(salts)).alias("salt"))
    questions = queries.select("dim", "question", "reach", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    meeting = numbers.join(questions, ["dim", "salt"]).where("longest >= reach").select("dim", "bucket", "block", "question")
    pairs = meeting.join(queries, ["dim", "question"]).join(cand, ["dim", "bucket", "block"])
    found = pairs.select("dim", "ids", "matrix", "asked", "q", "least").mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
