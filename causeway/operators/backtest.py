"""A policy on walk-forward forecasts: frozen calibration, anchors, and ledgers of all strategies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from causeway.operators import policy
from causeway.plans.config import ForecastConfig

#: Fewest forecasts of a calibration.
LEAST = 100
CLOSE, OPEN = "close to close", "next open to close"


def split(forecasts: DataFrame, first: DataFrame, most: int, by: Sequence[str] = ("series",)) -> tuple[DataFrame, DataFrame]:
    """Calibration and test of forecasts (by, issue_date, target_date, ...), whose horizon is one session. first has each
    series' first test issue (by, first_issue). The test is what is issued from then on; the calibration is the latest
    ``most`` forecasts whose targets were known at that issue's close. Series with fewer than LEAST of these are refused.
    """
    dated = forecasts.join(first, list(by))
    test = dated.where("issue_date >= first_issue").drop("first_issue")
    known = dated.where("issue_date < first_issue and target_date <= first_issue").drop("first_issue")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("issue_date")))
    calibration = known.withColumn("rank_", rank).where(F.col("rank_") <= most).drop("rank_")
    held = calibration.groupBy(*by).agg(F.count("*").alias("n"))
    short = first.join(held, list(by), "left").where(F.coalesce("n", F.lit(0)) < LEAST)
    if not short.isEmpty():
        raise ValueError(f"a calibration needs {LEAST} forecasts that matured before the test")
    return calibration, test


def anchors(forecasts: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """The first, the middle and the last forecast of each series."""
    w = W.partitionBy(*by)
    numbered = forecasts.withColumns({"at_": F.row_number().over(w.orderBy("issue_date")) - 1, "n_": F.count("*").over(w)})
    return numbered.where("at_ = 0 or at_ = n_ div 2 or at_ = n_ - 1").drop("at_", "n_")


def unlike(saved: DataFrame, again: DataFrame, by: Sequence[str] = ("series",), rtol: float = 1e-8, atol: float = 1e-11) -> DataFrame:
    """Saved forecasts that a model of today does not reproduce; a check expects none."""
    key = [*by, "issue_date"]
    both = saved.select(*key, F.col("predicted_return").alias("saved")).join(again.select(*key, F.col("predicted_return").alias("reproduced")), key, "left")
    near = F.abs(F.col("saved") - F.col("reproduced")) <= atol + rtol * F.abs("reproduced")
    return both.where(~F.coalesce(near, F.lit(False)))


def identity(config: ForecastConfig, panel: DataFrame, first: DataFrame) -> dict:
    """What a stored calibration depends on, as a key for sources.files.cached(): settings, first test issues, and number
    and checksum of the panel's rows."""
    rows = panel.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("series", "idx", "close", "ret", "factors").cast("decimal(38,0)")), F.lit(0)).alias("sum")).first()
    starts = first.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*first.columns).cast("decimal(38,0)")), F.lit(0)).alias("sum")).first()
    return {"config": asdict(config), "panel": [rows["n"], str(rows["sum"])], "first": [starts["n"], str(starts["sum"])]}


def run(test: DataFrame, calibration: DataFrame, prices: DataFrame, *, wealth: float = 100.0, low: float = 0.2, high: float = 0.8, by: Sequence[str] = ("series",)) -> tuple[DataFrame, DataFrame]:
    """Details and summary of a policy that holds more the higher a forecast ranks in the calibration.

    prices: by, session, open and close. Details have a row for each test forecast: the forecast, the policy's ledger, its
    percentile, the simple forecast and the wealth of the two fixed strategies. The summary has a row for each strategy
    and execution. One pass of windows for all strategies of all series.
    """
    series = [*by, "execution", "strategy"]
    ranked = policy.mid_percentile(test, calibration, by=by).withColumnRenamed("percentile", "training_percentile")
    day = prices.select(*by, F.col("session").alias("target_date"), (F.col("close") / F.col("open") - 1).alias("intraday_"))
    ranked = ranked.join(day, [*by, "target_date"], "left")
    own = policy.allocation(F.col("training_percentile"), low, high)
    kinds = [("percentile", CLOSE, own), ("half", CLOSE, F.lit(0.5)), ("hold", CLOSE, F.lit(1.0)), ("percentile", OPEN, own)]
    simple = lambda execution: F.expm1("actual_return") if execution == CLOSE else F.col("intraday_")
    each = F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(e).alias("execution"), a.alias("allocation"), simple(e).alias("asset_simple_return")) for s, e, a in kinds))
    rows = ranked.withColumn("k", F.explode(each)).select("*", "k.*").drop("k", "intraday_")
    policy.check_inputs(rows)
    ledgers = policy.ledger(rows, series=series, order="issue_date", wealth=wealth)
    summary = policy.performance(ledgers, by=series, order="issue_date", wealth=wealth)
    key = [*by, "issue_date"]
    close = ledgers.where(F.col("execution") == CLOSE)
    other = close.groupBy(*key).agg(*(F.max(F.when(F.col("strategy") == s, F.col("wealth"))).alias(n) for s, n in (("half", "fixed_50_wealth"), ("hold", "buy_hold_wealth"))))
    details = close.where("strategy = 'percentile'").drop("strategy", "execution").join(other, key)
    return details.withColumn("predicted_simple_return", F.expm1("predicted_return")), summary
