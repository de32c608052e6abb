"""Factor screening by rolling moments, collinearity, and weighted moments of a regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-10


def correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Population correlation from means; 0 where a side is constant, never outside [-1, 1]."""
    vx, vy = F.greatest(xx - x * x, F.lit(0.0)), F.greatest(yy - y * y, F.lit(0.0))
    flat = (F.sqrt(vx * n) <= FLOOR) | (F.sqrt(vy * n) <= FLOOR)
    return F.when(flat, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(xy - x * y, F.sqrt(vx) * F.sqrt(vy)))))


def _means(x: Column, y: Column, frame=None) -> list[Column]:
    over = lambda c: c.over(frame) if frame is not None else c
    return [over(F.avg(c)) for c in (x, y, x * x, y * y, x * y)]


def rolling(samples: DataFrame, factors: Sequence[str], target: str, frame, least: int) -> DataFrame:
    """samples with corr_<factor>: the correlation of factor and target over each row's matured training frame; null with
    fewer than ``least`` samples in it."""
    n = F.count(target).over(frame)
    col = lambda f: F.when(n >= least, correlation(n.cast("double"), *_means(F.col(f), F.col(target), frame)))
    return samples.withColumns({f"corr_{f}": col(f) for f in factors} | {"train_n": n})


def matrix(samples: DataFrame, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row for each pair of factors (in order): their correlation over all rows, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    n = F.count("*").cast("double")
    wide = samples.groupBy(*by).agg(*(correlation(n, *_means(F.col(a), F.col(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs))))
    return wide.select(*by, rows.alias("pair")).select(*by, "pair.*")


def screen_table(samples: DataFrame, factors: Sequence[str], target: str, chosen: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """factor, correlation over all rows (the training rows, if samples are cut to them) and whether it was chosen, the
    strongest first. chosen has the chosen factors (by, factor)."""
    n = F.count("*").cast("double")
    wide = samples.groupBy(*by).agg(*(correlation(n, *_means(F.col(f), F.col(target))).alias(f) for f in factors))
    rows = wide.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("correlation")) for f in factors))).alias("x")).select(*by, "x.*")
    if chosen is None:
        return rows.withColumn("selected", F.lit(False)).orderBy(*by, F.desc(F.abs("correlation")), "factor")
    key = [*by, "factor"]
    marked = rows.join(chosen.select(*key).distinct().withColumn("selected", F.lit(True)), key, "left")
    return marked.withColumn("selected", F.coalesce("selected", F.lit(False))).orderBy(*by, F.desc(F.abs("correlation")), "factor")


def softmax_weights(df: DataFrame, distance: str, gamma: float, by: Sequence[str]) -> DataFrame:
    """df with weight, exp(-gamma distance) over its group's sum, and n_eff, 1 over the sum of squared weights. The
    maximum is taken out by an aggregation and a join, so that a group is never one task's."""
    logit = F.lit(-gamma) * F.col(distance)
    top = df.groupBy(*by).agg(F.max(logit).alias("top_"))
    raw = df.join(top, list(by)).withColumn("raw_", F.exp(logit - F.col("top_")))
    sums = raw.groupBy(*by).agg(F.sum("raw_").alias("sum_"), (F.sum("raw_") * F.sum("raw_") / F.sum(F.col("raw_") * F.col("raw_"))).alias("n_eff"))
    return raw.join(sums, list(by)).withColumn("weight", F.col("raw_") / F.col("sum_")).drop("top_", "raw_", "sum_")


def weighted_gram(df: DataFrame, features: Sequence[str], target: str, weight: str, by: Sequence[str] = (), clip: float = 8.0) -> DataFrame:
    """For each pair of features i <= j: the weighted product of the standardised, clipped and centred features, and for
    each i that with the centred target (j = 'target'). Two aggregations with map-side partial sums."""
    w, total = F.col(weight), F.sum(weight)
    mean = lambda x: F.sum(w * x) / total
    first = df.groupBy(*by).agg(*(mean(F.col(f)).alias(f"m_{f}") for f in [*features, target]), *((mean(F.col(f) * F.col(f))).alias(f"q_{f}") for f in features))
    key = list(by) or None
    joined = df.join(first, key) if key else df.crossJoin(F.broadcast(first))
    scale = lambda f: F.greatest(F.sqrt(F.greatest(F.col(f"q_{f}") - F.col(f"m_{f}") * F.col(f"m_{f}"), F.lit(0.0))), F.lit(1e-5))
    z = {f"z_{f}": F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(f) - F.col(f"m_{f}")) / scale(f))) for f in features}
    zs = joined.select(*by, weight, *(c.alias(n) for n, c in z.items()), (F.col(target) - F.col(f"m_{target}")).alias("z_target"))
    names = [*features, "target"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:] if a != "target"]
    moments = zs.groupBy(*by).agg(*(mean(F.col(f"z_{n}")).alias(f"o_{n}") for n in names), *(mean(F.col(f"z_{a}") * F.col(f"z_{b}")).alias(f"g{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), (F.col(f"g{k}") - F.col(f"o_{a}") * F.col(f"o_{b}")).alias("value")) for k, (a, b) in enumerate(pairs)))
    return moments.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")
