"""Scores of forecasts: directions, errors, prices, baselines and paired comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def direction(forecast: Column, up: float, down: float | None = None) -> Column:
    """1 above ``up``, -1 at or below ``down`` (which is ``up`` by default), else 0."""
    down = up if down is None else down
    if not (math.isfinite(up) and math.isfinite(down) and down <= up):
        raise ValueError("cutoffs must be finite, and down not above up")
    return F.when(forecast > up, 1).when(forecast <= down, -1).otherwise(0)


def scores(predictions: DataFrame, up: float = 0.0, down: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Direction and error scores in one aggregation. A neutral forecast is a miss; a precision without forecasts, or a
    recall without days, is null."""
    said, up_day = direction(F.col("predicted_return"), up, down), F.col("actual_return") > 0
    error = F.col("actual_return") - F.col("predicted_return")
    count = lambda c: F.count_if(c)
    row = predictions.groupBy(*by).agg(
        F.count("*").alias("n"), count(up_day).alias("actual_up_days"), count(~up_day).alias("actual_down_days"),
        count(said == 1).alias("predicted_up_days"), count(said == -1).alias("predicted_down_days"), count(said == 0).alias("neutral_days"),
        count((said == 1) & up_day).alias("correct_up_days"), count((said == -1) & ~up_day).alias("correct_down_days"),
        F.avg(F.abs(error)).alias("return_mae"), F.sqrt(F.avg(error * error)).alias("return_rmse"), F.avg(F.abs("actual_return")).alias("zero_return_mae"),
    )
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    row = row.withColumns({"accuracy": (F.col("correct_up_days") + F.col("correct_down_days")) / F.col("n"), "up_recall": part("correct_up_days", "actual_up_days"), "down_recall": part("correct_down_days", "actual_down_days"), "up_precision": part("correct_up_days", "predicted_up_days"), "down_precision": part("correct_down_days", "predicted_down_days"), "majority_accuracy": F.greatest("actual_up_days", "actual_down_days") / F.col("n"), "predicted_up_rate": part("predicted_up_days", "n"), "predicted_down_rate": part("predicted_down_days", "n"), "neutral_rate": part("neutral_days", "n"), "actual_up_rate": part("actual_up_days", "n")})
    return row.withColumn("balanced_accuracy", (F.col("up_recall") + F.col("down_recall")) / 2)


def reconstructed_prices(predictions: DataFrame, prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """predictions with the issue's close, the target's close and the predicted close. by: columns of both tables that tell
    series apart, here and below."""
    at = lambda name, day: prices.select(*by, F.col("session").alias(day), F.col("close").alias(name))
    both = predictions.join(at("previous_actual_close", "issue_date"), [*by, "issue_date"]).join(at("actual_close", "target_date"), [*by, "target_date"])
    return both.withColumn("predicted_close", F.col("previous_actual_close") * F.exp("predicted_return"))


def price_errors(priced: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return priced.groupBy(*by).agg(F.avg(F.abs(F.col("predicted_close") - F.col("actual_close"))).alias("price_mae"), F.avg(F.abs(F.col("previous_actual_close") - F.col("actual_close"))).alias("last_close_mae"))


def return_errors(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Absolute errors of log and simple returns, by target date."""
    return predictions.select(*by, "issue_date", "target_date", F.abs(F.col("predicted_return") - F.col("actual_return")).alias("log_return_error"), F.abs(F.expm1("predicted_return") - F.expm1("actual_return")).alias("simple_return_error"))


def pearson(x: str, y: str) -> Column:
    """Population correlation; null with fewer than two rows or a constant side."""
    cov = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    ok = (F.count("*") >= 2) & (F.stddev_pop(x) > 1e-14) & (F.stddev_pop(y) > 1e-14)
    return F.when(ok, F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)))


def normalised_errors(predictions: DataFrame, deviation: Column, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, mean squared error, that over the frozen variance, the same for a forecast of 0, and skill."""
    error = F.col("actual_return") - F.col("predicted_return")
    row = predictions.groupBy(*by).agg(pearson("predicted_return", "actual_return").alias("pearson"), F.avg(error * error).alias("mse"), F.avg(F.col("actual_return") * F.col("actual_return")).alias("zero_mse"), F.max(deviation).alias("sd"))
    variance = F.col("sd") * F.col("sd")
    return row.select(*by, "pearson", "mse", F.try_divide("mse", variance).alias("normalised_mse"), F.try_divide("zero_mse", variance).alias("zero_normalised_mse"), (F.lit(1.0) - F.try_divide("mse", "zero_mse")).alias("skill"))


def frozen_normaliser(samples: DataFrame, frame) -> DataFrame:
    """Mean, sample deviation and number of the labels matured at each issue."""
    return samples.withColumns({"label_mean": F.avg("target").over(frame), "label_sd": F.stddev_samp("target").over(frame), "label_n": F.count("target").over(frame)})


def previous_direction(bars: DataFrame, series: Sequence[str] = ("ticker",)) -> DataFrame:
    """The last session's direction as the forecast of the next one's; an unchanged close is DOWN."""
    w = W.partitionBy(*series).orderBy("session")
    word = lambda r: F.when(r > 0, "UP").otherwise("DOWN")
    rows = bars.select(*series, F.lag("session").over(w).alias("previous_session_date"), F.col("session").alias("issue_date"), F.lead("session").over(w).alias("target_date"), F.ln(F.col("close") / F.lag("close").over(w)).alias("last_observed_return"), F.ln(F.lead("close").over(w) / F.col("close")).alias("actual_return"))
    rows = rows.where("previous_session_date is not null and target_date is not null")
    rows = rows.withColumns({"predicted_direction": word(F.col("last_observed_return")), "actual_direction": word(F.col("actual_return"))})
    return rows.withColumn("correct", F.col("predicted_direction") == F.col("actual_direction"))


def confusion(directions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows UP and DOWN by actual direction, with counts of predicted ones; classes that do not occur count 0."""
    classes = directions.select(*by).distinct().crossJoin(directions.sparkSession.createDataFrame([("UP",), ("DOWN",)], "actual string")) if by else directions.sparkSession.createDataFrame([("UP",), ("DOWN",)], "actual string")
    counted = directions.groupBy(*by, F.col("actual_direction").alias("actual")).pivot("predicted_direction", ["UP", "DOWN"]).count()
    return classes.join(counted, [*by, "actual"], "left").select(*by, "actual", F.coalesce("UP", F.lit(0)).alias("predicted_up"), F.coalesce("DOWN", F.lit(0)).alias("predicted_down"))


def baseline_table(directions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy of repeating the last direction, of always UP and of always DOWN."""
    up = F.avg((F.col("actual_direction") == "UP").cast("double"))
    row = directions.groupBy(*by).agg(F.avg(F.col("correct").cast("double")).alias("r"), up.alias("u"), (F.lit(1.0) - up).alias("d"))
    return row.select(*by, F.expr("stack(3, 'repeat previous', r, 'always UP', u, 'always DOWN', d) as (method, accuracy)"))


def factor_frequency(predictions: DataFrame, factors: Column) -> DataFrame:
    return predictions.select(F.explode(factors).alias("factor")).groupBy("factor").agg(F.count("*").alias("selected_sessions")).orderBy(F.desc("selected_sessions"), "factor")


def split_summary(scored: DataFrame, by: Sequence[str] = ("split", "ticker")) -> DataFrame:
    """Accuracy at one half, Brier score, up rate, majority share and number of probability forecasts by group."""
    up = F.avg(F.col("label").cast("double"))
    hit = ((F.col("probability") >= 0.5).cast("int") == F.col("label")).cast("double")
    gap = F.col("probability") - F.col("label")
    return scored.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.avg(gap * gap).alias("brier"), up.alias("up_rate"), F.greatest(up, 1 - up).alias("majority"), F.count("*").alias("n"))


def rolling_rate(hit: Column, series: Sequence[str], order: str, rows: int = 60, least: int = 10) -> Column:
    frame = W.partitionBy(*series).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(hit).over(frame) >= least, F.avg(hit).over(frame))


def same_outcomes(left: DataFrame, right: DataFrame, rtol: float = 1e-8, atol: float = 1e-11) -> DataFrame:
    """Rows of two prediction tables that differ in date, label or forecast; a check expects none."""
    pair = left.select("issue_date", "target_date", "actual_return", "predicted_return").alias("a").join(right.alias("b"), "issue_date", "full")
    close = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= atol + rtol * F.abs(F.col(f"b.{c}"))
    fine = F.col("a.target_date").eqNullSafe(F.col("b.target_date")) & F.coalesce(close("actual_return") & close("predicted_return"), F.lit(False))
    return pair.where(~fine).select("issue_date")


def block_starts(errors: DataFrame, *, reps: int = 1000, block: int = 20, seed: int = 17, by: Sequence[str] = ()) -> DataFrame:
    """by, rep, block_no and start: a random start for each block of each repetition, for the rows of errors (by, idx).

    A start is a draw of 60 bits of the MD5 digest of seed, repetition and block, so it does not depend on how rows lie or on
    what else is drawn; a draw from the incomplete last run of the numbers of rows is drawn again from the digest's other
    half, so that no row is favoured.
    """
    n = errors.groupBy(*by).agg(F.count("*").alias("n"))
    numbers = n.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    blocks = numbers.select(*by, "n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)).alias("block_no"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("block_no").cast("string")))
    first, second = (F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 17))
    whole = (1 << 60) - F.lit(1 << 60) % F.col("n")
    return blocks.select(*by, "rep", "block_no", (F.when(first < whole, first).otherwise(second) % F.col("n")).alias("start"))


def block_bootstrap(errors: DataFrame, starts: DataFrame, *, value: str = "difference", block: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Mean, and the 2.5 and 97.5 percent quantiles of the means, over circular blocks.

    errors: by, idx from 0 and value; starts: by, rep, block_no and start. A repetition joins its days by number, so nothing
    is broadcast or looped; the last block is cut at the number of rows.
    """
    n = errors.groupBy(*by).agg(F.count("*").alias("n"))
    counted = starts.join(n, list(by)) if by else starts.crossJoin(F.broadcast(n))
    days = counted.select(*by, "rep", "n", (F.col("block_no") * block).alias("at"), "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"))
    days = days.where(F.col("at") + F.col("k") < F.col("n")).select(*by, "rep", ((F.col("start") + F.col("k")) % F.col("n")).alias("idx"))
    means = days.join(errors, [*by, "idx"]).groupBy(*by, "rep").agg(F.avg(value).alias("m"))
    ends = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    mean = errors.groupBy(*by).agg(F.avg(value).alias("difference"))
    both = mean.join(ends, list(by)) if by else mean.crossJoin(F.broadcast(ends))
    return both.select(*by, "difference", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def direction_metrics(directions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, recall of either direction and their mean; a recall without days is null."""
    up, ok = F.col("actual_direction") == "UP", F.col("correct")
    row = directions.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(up).alias("actual_up"), F.count_if(~up).alias("actual_down"), F.count_if(F.col("predicted_direction") == "UP").alias("predicted_up"), F.count_if(up & ok).alias("correct_up"), F.count_if(~up & ok).alias("correct_down"))
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    row = row.withColumns({"accuracy": (F.col("correct_up") + F.col("correct_down")) / F.col("n"), "up_recall": part("correct_up", "actual_up"), "down_recall": part("correct_down", "actual_down")})
    return row.withColumn("balanced_accuracy", (F.col("up_recall") + F.col("down_recall")) / 2)


def after(predictions: DataFrame, date, by: Sequence[str] = ()) -> DataFrame:
    """The forecasts issued after a date, which must lie within the issues of every series."""
    outside = predictions.groupBy(*by).agg(F.min("issue_date").alias("low"), F.max("issue_date").alias("high")).where(~F.lit(date).cast("date").between(F.col("low"), F.col("high")))
    if not outside.isEmpty():
        raise ValueError("the date is not within the issues")
    return predictions.where(F.col("issue_date") > F.lit(date).cast("date"))


def held_out_table(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of a scores() row: accuracy and mean absolute error, of the model and of its baseline, a row for each metric."""
    return scored.select(*by, F.expr("stack(2, 'direction accuracy', accuracy, majority_accuracy, 'return MAE', return_mae, zero_return_mae) as (metric, model, baseline)"))


def method_table(methods: dict[str, DataFrame], prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each issue that all methods forecast: both closes, and the price that each method predicts."""
    key = [*by, "issue_date", "target_date"]
    out = None
    for name, predictions in methods.items():
        priced = reconstructed_prices(predictions, prices, by)
        mine = priced.select(*key, *(["previous_actual_close", "actual_close"] if out is None else []), F.col("predicted_close").alias(f"{name}_close"), F.abs(F.col("predicted_close") - F.col("actual_close")).alias(f"{name}_error"))
        out = mine if out is None else out.join(mine, key)
    return out
