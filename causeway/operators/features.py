"""Daily-bar features: returns, volatility, ranges, market breadth and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _over(series: Sequence[str], order: str) -> W:
    return W.partitionBy(*series).orderBy(order)


def log_return(close: str = "close", series: Sequence[str] = ("ticker",), order: str = "session") -> Column:
    """ln of the close over the previous one; 0 for the first session of a series."""
    return F.coalesce(F.ln(close) - F.lag(F.ln(close)).over(_over(series, order)), F.lit(0.0))


def archive_return(close: str = "close", series: Sequence[str] = ("ticker",), order: str = "session") -> Column:
    """The return on a reindexed calendar: 0 where either day has no close."""
    return F.coalesce(F.ln(F.try_divide(F.col(close), F.lag(close).over(_over(series, order)))), F.lit(0.0))


def intraday_return(open_: str = "open", close: str = "close") -> Column:
    return F.ln(F.col(close) / F.col(open_))


def rolling_volatility(ret: str = "ret", rows: int = 20, least: int = 5, series: Sequence[str] = ("ticker",), order: str = "session") -> Column:
    """Sample deviation of the last rows returns, 0 with fewer than ``least`` of them."""
    frame = _over(series, order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(ret).over(frame) >= least, F.stddev_samp(ret).over(frame)).otherwise(0.0)


def bar_range(high: str = "high", low: str = "low", close: str = "close") -> Column:
    return F.try_divide(F.col(high) - F.col(low), F.col(close))


def log_volume(volume: str = "volume") -> Column:
    return F.log1p(volume)


def open_gap(open_: str = "open", close: str = "close") -> Column:
    return F.try_divide(F.col(close), F.col(open_)) - 1.0


def next_up(close: str = "close", series: Sequence[str] = ("ticker",), order: str = "session") -> Column:
    """1 if the next close is higher, else 0; 0 for the last session."""
    return F.coalesce((F.lead(close).over(_over(series, order)) > F.col(close)).cast("int"), F.lit(0))


def last_of_day(bars: DataFrame, position: str, series: Sequence[str] = ("symbol",), session: str = "session") -> DataFrame:
    """Of several rows for one session, that with the largest file position."""
    rank = F.row_number().over(W.partitionBy(*series, session).orderBy(F.desc(position)))
    return bars.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def breadth(bars: DataFrame, *, limit: float = 0.7, series: str = "symbol") -> DataFrame:
    """A row for each session: mean, population deviation, share above 0 and log count of all symbols' returns, each on
    its symbol's own calendar. Prices that are not positive are unknown, returns of ``limit`` or more are left out."""
    close = F.when(F.col("close") > 0, F.col("close"))
    back = F.lag("price").over(W.partitionBy(series).orderBy("session"))
    rows = bars.withColumn("price", close).withColumn("r", F.ln(F.try_divide(F.col("price"), back)))
    good = rows.withColumn("r", F.when(F.abs("r") < limit, F.col("r")))
    n = F.greatest(F.count("r"), F.lit(1))
    mean = F.coalesce(F.sum("r"), F.lit(0.0)) / n
    square = F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)) / n
    return good.groupBy("session").agg(
        mean.alias("breadth_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("breadth_sd"), (F.count_if(F.col("r") > 0) / n).alias("breadth_up"), F.log1p(F.count("r")).alias("breadth_log_n")
    )


def cleaned(value: Column) -> Column:
    """0 for what is no finite number."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def factor_array(columns: Sequence[str]) -> Column:
    """The factors of a session as single-precision numbers, in the order of columns."""
    return F.array(*(cleaned(F.col(c)).cast("float") for c in columns))


def window_moments(windows: DataFrame, names: Sequence[str], by: Sequence[str] = (), floor: float = 1e-4) -> DataFrame:
    """feature, mean, sd (population, floor at least) and n of each feature over all rows of the windows of a group, in one
    aggregation; nulls do not count."""
    stats = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.greatest(F.stddev_pop(f), F.lit(floor)).alias("sd"), F.count(f).alias("n")) for f in names]
    return windows.groupBy(*by).agg(F.array(*stats).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")


def standardized(windows: DataFrame, moments: DataFrame, names: Sequence[str], by: Sequence[str] = (), most: float = 8.0) -> DataFrame:
    """windows with the features in standard scores by window_moments(), between -most and most; a null counts as the mean."""
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{f}_{c}_")
    wide = moments.groupBy(*by).agg(*(pick(f, c) for f in names for c in ("mean", "sd")))
    both = windows.join(wide, list(by)) if by else windows.crossJoin(F.broadcast(wide))
    raw = lambda f: (F.col(f) - F.col(f"{f}_mean_")) / F.col(f"{f}_sd_")
    score = lambda f: F.when(raw(f).isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), raw(f)))).otherwise(0.0)
    return both.withColumns({f: score(f) for f in names}).select(*windows.columns)


def archive_features(targets: DataFrame, archive: DataFrame, breadths: DataFrame, names: Sequence[str], upper: Sequence[str]) -> DataFrame:
    """session, idx and vector of the sessions that all targets have with both prices: the targets' close-to-close returns, their
    gaps, return, range and log volume of each symbol of upper, and the breadth.

    targets: ticker, session, open, close; archive: symbol, session, high, low, close, volume, put on the targets' sessions, so
    that a return needs a close on this and on the session before; breadths as breadth() makes them. What is unknown or no finite
    number is 0. The calendar is sorted in one task, a row for each session.
    """
    whole = targets.where("open is not null and close is not null").where(F.col("ticker").isin(*names))
    pick = lambda by, t, c: F.max(F.when(F.col(by) == t, F.col(c))).alias(f"{t}_{c}")
    wide = whole.groupBy("session").agg(F.count_distinct("ticker").alias("n"), *(pick("ticker", t, c) for t in names for c in ("open", "close"))).where(F.col("n") == len(set(names))).drop("n")
    above = archive.where(F.col("symbol").isin(*upper)).groupBy("session").agg(*(pick("symbol", u, c) for u in upper for c in ("high", "low", "close", "volume")))
    rows = wide.join(above, "session", "left").join(breadths, "session", "left")
    ret = lambda t: archive_return(f"`{t}_close`", series=[F.lit(0)])
    ranges = [(bar_range(f"`{u}_high`", f"`{u}_low`", f"`{u}_close`"), log_volume(f"`{u}_volume`")) for u in upper]
    cells = [*map(ret, names), *(open_gap(f"`{t}_open`", f"`{t}_close`") for t in names), *(c for u, x in zip(upper, ranges) for c in (ret(u), *x)), *(F.col(c) for c in breadths.columns if c != "session")]
    place = (F.row_number().over(_over([F.lit(0)], "session")) - 1).cast("long")
    return rows.select("session", place.alias("idx"), F.array(*(cleaned(c.cast("double")) for c in cells)).alias("vector"))
