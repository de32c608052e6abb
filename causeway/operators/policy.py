"""Allocation by forecast percentile and self-financing backtests."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SESSIONS_PER_YEAR = 252


#: Ranges of values that percentiles are counted in side by side.
RANGES = 64


def mid_percentile(forecasts: DataFrame, calibration: DataFrame, value: str = "predicted_return", by: Sequence[str] = ()) -> DataFrame:
    """forecasts with percentile, the mid-rank of each forecast in the frozen calibration set (of its group). Distinct values
    are dealt into ranges, each sorted by itself and lifted by what lies in the ranges below it; no forecast is compared with
    every calibration row, and no task sorts all values. Where the ranges lie has no influence on the result. Values that are
    null or NaN count for nothing: such a forecast stays, with a null percentile, as does one of a group without calibration."""
    every, usable = forecasts, F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    forecasts, calibration = forecasts.where(usable), calibration.where(usable)
    if calibration.isEmpty():
        raise ValueError("the calibration set is empty")
    ends = sorted({x for x in forecasts.unionByName(calibration, allowMissingColumns=True).approxQuantile(value, [k / RANGES for k in range(1, RANGES)], 0.01) if math.isfinite(x)})
    v = F.col(value)
    place = sum((F.when(v > x, 1).otherwise(0) for x in ends), F.lit(0))
    keys = [*by, value]
    both = forecasts.select(*keys, F.lit(0).alias("cal")).unionByName(calibration.select(*keys, F.lit(1).alias("cal")))
    counts = both.groupBy(*keys).agg(F.sum("cal").alias("same")).withColumn("range_", place)
    below = counts.groupBy(*by, "range_").agg(F.sum("same").alias("held"))
    lower = W.partitionBy(*by).orderBy("range_")
    # a row for each range of each group
    below = below.select(*by, "range_", F.coalesce(F.sum("held").over(lower.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("held").over(W.partitionBy(*by)).alias("n_"))
    upto = F.sum("same").over(W.partitionBy(*by, "range_").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    held = below.select(*(F.col(k).alias(f"{k}__") for k in (*by, "range_")), "below", "n_")
    ranked = counts.withColumn("upto", upto).join(held, functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"{k}__")) for k in (*by, "range_"))))
    ranked = ranked.select(*keys, F.try_divide(2 * (F.col("below") + F.col("upto")) - F.col("same"), 2 * F.col("n_")).alias("percentile"))
    other = ranked.select(*(F.col(k).alias(f"{k}__") for k in keys), "percentile")
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys))
    return every.join(other, same, "left").select(*every.columns, "percentile")


def allocation(percentile: Column, low: float = 0.2, high: float = 0.8) -> Column:
    if not 0 <= low <= high <= 1:
        raise ValueError("bounds must lie in order within [0, 1]")
    return low + (high - low) * percentile


def check_inputs(df: DataFrame, simple_return: str = "asset_simple_return", weight: str = "allocation") -> None:
    """Raise for returns that are not finite or not above -1, and for weights outside [0, 1]."""
    r, w = F.col(simple_return), F.col(weight)
    bad = r.isNull() | F.isnan(r) | (F.abs(r) == float("inf")) | (r <= -1) | w.isNull() | F.isnan(w) | (w < 0) | (w > 1)
    if not df.where(bad).isEmpty():
        raise ValueError("returns must be finite and above -1, weights in [0, 1]")


def ledger(df: DataFrame, *, series: Sequence[str] = ("strategy",), order: str = "idx", wealth: float = 100.0, simple_return: str = "asset_simple_return", weight: str = "allocation") -> DataFrame:
    """df with the self-financing ledger of each series; the first peak is the wealth at the start."""
    w = W.partitionBy(*series).orderBy(order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("portfolio_simple_return", F.col(weight) * F.col(simple_return))
    rows = rows.withColumn("wealth", F.lit(float(wealth)) * F.product(1 + F.col("portfolio_simple_return")).over(so_far))
    rows = rows.withColumn("wealth_before", F.lag("wealth", 1, float(wealth)).over(w))
    peak = F.greatest(F.lit(float(wealth)), F.max("wealth").over(so_far))
    return rows.withColumns({"invested_dollars": F.col("wealth_before") * F.col(weight), "cash_dollars": F.col("wealth_before") * (1 - F.col(weight)), "pnl_dollars": F.col("wealth") - F.col("wealth_before"), "drawdown": F.col("wealth") / peak - 1})


def performance(ledgers: DataFrame, *, by: Sequence[str] = ("strategy",), order: str = "idx", wealth: float = 100.0) -> DataFrame:
    """Final wealth, return, largest drawdown (positive), Sharpe ratio (null with one session or no variation) and
    allocations of each series."""
    r = F.col("portfolio_simple_return")
    sd = F.stddev_samp(r)
    return ledgers.groupBy(*by).agg(
        F.count("*").alias("sessions"), F.max_by("wealth", order).alias("final_wealth"), (100 * (F.max_by("wealth", order) / wealth - 1)).alias("total_return_pct"), (-100 * F.min("drawdown")).alias("max_drawdown_pct"),
        F.when((F.count("*") > 1) & (sd > 1e-15), F.sqrt(F.lit(float(SESSIONS_PER_YEAR))) * F.avg(r) / sd).alias("annualized_sharpe_rf0"),
        (100 * F.avg("allocation")).alias("mean_allocation_pct"), (100 * F.min("allocation")).alias("min_allocation_pct"), (100 * F.max("allocation")).alias("max_allocation_pct"),
    )


def violations(predictions: DataFrame, prices: DataFrame, atol: float = 2e-12, by: Sequence[str] = ()) -> DataFrame:
    """Predictions that break a rule, with the rule's name: a repeated issue, a target that is not the next session, a
    return that is not the log ratio of the closes, or a number that is not finite. by: columns of both tables that tell
    series apart."""
    w = W.partitionBy(*by).orderBy("session")
    nxt = prices.select(*by, F.col("session").alias("issue_date"), F.col("close").alias("c0"), F.lead("session").over(w).alias("next_session"), F.lead("close").over(w).alias("c1"))
    issue = [*by, "issue_date"]
    times = predictions.groupBy(*issue).agg(F.count("*").alias("times"))
    rows = predictions.join(times, issue).join(nxt, issue, "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rule = F.when(F.col("times") > 1, "repeated issue").when(~finite("actual_return") | ~finite("predicted_return"), "not finite").when(~F.col("target_date").eqNullSafe(F.col("next_session")), "target is not the next session").when(F.abs(F.col("actual_return") - F.ln(F.col("c1") / F.col("c0"))) > atol, "return does not match the closes")
    return rows.withColumn("rule", rule).where("rule is not null").select(*issue, "rule")
