"""Mixing sources to target weights by subset sums over exact document lengths.

Each source gets a target number of words. It takes all its documents as often as they fit whole, and then fits the
rest of the budget: its documents are counted by exact length, most of the rest is filled with an even share of every
length, and a bounded-knapsack dynamic programme over the counts that are left finds the lengths whose sum comes
nearest to what remains. Of the documents of a length, those with the smallest seeded hashes are taken.

Only counts by length reach the programme, a row for each source and length; documents are selected by their place in
hash buckets, so that neither a large source nor a length that many documents share gathers in one task.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in
order; repeated rows count each time; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from causeway.llm._common import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MOST_REPEATS = 2
SEED = 17
#: Buckets by seeded hash that the documents of a source and length are ranked in.
BUCKETS = 1024
#: Words that the dynamic programme fits at most; what is above is filled length by length before.
DP_WORDS = 1 << 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, percent: int = BUDGET_PERCENT, most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Targets of the sources: percent of all sizes by weight, none above most times its source's size; what goes
    beyond is shared among the others by weight until none is above. Python orders strings by code point."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, target = Decimal(sum(size.values())) * percent / 100, list(weight), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] > Decimal(most * size[s]) * total]
        if not full:
            target |= {s: float(left * weight[s] / total) for s in open_}
            break
        for s in full:
            target[s] = float(most * size[s])
            left -= most * size[s]
        open_ = [s for s in open_ if s not in full]
    return target


def fit(counts: dict[int, int], budget: int, most: int = DP_WORDS) -> dict[int, int]:
    """How many documents of each length to take, so that their lengths sum to budget or as near below it as the
    programme finds; at most counts of each."""
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    lengths = sorted((n for n, c in counts.items() if n > 0 and c > 0), reverse=True)
    share = max(0, budget - most // 2)
    taken = {n: counts[n] * share // total for n in lengths}
    left = budget - sum(n * c for n, c in taken.items())
    for n in lengths:  # the longest first, down to what the programme can hold
        if left <= most:
            break
        more = min(counts[n] - taken[n], -(-(left - most) // n), left // n)
        taken[n] += more
        left -= more * n
    # A common divisor of all lengths divides every sum.
    unit = math.gcd(*lengths)
    left //= unit
    # reachable[k]: a bit for each sum that the first k parts can make; a part is a number of documents of a length.
    parts, mask = [], (1 << (left + 1)) - 1
    for n in lengths:
        c, k = min(counts[n] - taken[n], left * unit // n), 1
        while c > 0:
            parts.append((n // unit, min(k, c)))
            c -= k
            k *= 2
    reachable = [1]
    for n, c in parts:
        reachable.append(reachable[-1] | (reachable[-1] << (n * c)) & mask)
        if reachable[-1] >> left & 1:
            break
    at = reachable[-1].bit_length() - 1
    for k in range(len(reachable) - 1, 0, -1):
        if not reachable[k - 1] >> at & 1:
            n, c = parts[k - 1]
            taken[n * unit] += c
            at -= n * c
    return taken


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, weights: Sequence[int] = WEIGHTS, percent: int = BUDGET_PERCENT, most: int = MOST_REPEATS, seed: int = SEED, part: Column | None = None) -> DataFrame:
    """A row for each row of df: key, part (an expression that tells rows with one key apart; else 0), source, size,
    source_size, target, repeats (times the mix holds the document) and taken (repeats times size)."""
    part = F.lit(0).cast("long") if part is None else part
    docs = df.select(F.col(f"`{key}`").alias("key"), part.alias("part"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("key").cast("string")), F.lit(BUCKETS)).cast("int"))
    docs = written(docs, "sizes")  # the texts are read once
    by_length = docs.groupBy("source", "size").agg(F.count("*").alias("n"))
    by_source = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # A row for each source reaches the driver, no document.
    sizes = [(r["source"], r["source_size"]) for r in by_source.collect()]
    target = share_out(sizes, weights, percent, most)
    known = dict(sizes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        name = None if pd.isna(pdf["source"].iloc[0]) else pdf["source"].iloc[0]
        counts = {int(n): int(c) for n, c in zip(pdf["size"], pdf["n"], strict=True)}
        whole = int(target[name] // known[name]) if known[name] else 0
        rest = fit(counts, round(target[name]) - whole * known[name]) if whole < most and known[name] else {}
        out = pdf[["source", "size"]].copy()
        out["source_size"], out["target"], out["whole"] = known[name], target[name], whole
        out["extra"] = [rest.get(int(n), 0) if n else 0 for n in pdf["size"]]
        return out

    chosen = by_length.groupBy("source").applyInPandas(choose, "source string, size long, source_size long, target double, whole long, extra long")
    # Buckets before the one in which the last document to take lies are taken whole; in that one, documents are ranked.
    filled = docs.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    filled = filled.withColumn("before", F.coalesce(before, F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    plan = filled.alias("f").join(chosen.alias("c"), same(filled, chosen)).select("f.source", "f.size", "f.bucket", "source_size", "target", "whole", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")).alias("quota"), "n")
    cols = ("source_size", "target", "whole", "quota", "n")
    joined = docs.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d.size = p.size AND d.bucket = p.bucket")).select("d.*", *(f"p.{c}" for c in cols))
    partly = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    rank = F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col("key").cast("string")), "key", "part"))
    ranked = joined.where(partly).withColumn("extra", (rank <= F.col("quota")).cast("long"))
    plain = joined.where(~partly).withColumn("extra", (F.col("quota") > 0).cast("long"))
    both = plain.unionByName(ranked)
    repeats = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long")
    return both.select(F.col("key").alias(key), "part", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: df's rows, each as often as the mix takes it. Rows that agree in all columns are alike."""
    # A row keeps its place in the join by its id and its other columns; maps, which have no hash, are taken as text.
    every = [(f"`{f.name}`", f.dataType.typeName()) for f in df.schema.fields if f.name != key]
    part = F.xxhash64(*(x for c, kind in every for x in (F.col(c).isNull(), F.to_json(c) if kind == "map" else F.col(c))))
    names = [free_name(df, n) for n in ("mix_part", "mix_repeats", "mix_key", "mix_of")]
    marked = df.withColumn(names[0], part)
    taken = mix(df, key, text, source, part=part, **options).groupBy(F.col(f"`{key}`").alias(names[2]), F.col("part").alias(names[3])).agg(F.sum("repeats").alias(names[1])).where(F.col(names[1]) > 0)
    one = marked.dropDuplicates([key, names[0]])
    return one.join(taken, one[key].eqNullSafe(taken[names[2]]) & (one[names[0]] == taken[names[3]])).withColumn(names[1], F.explode(F.array_repeat(F.lit(0), F.col(names[1]).cast("int")))).select(*(F.col(f"`{c}`") for c in df.columns))
