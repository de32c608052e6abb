"""Session calendars, alignment of series, and as-of lookups with the next-session rule.

Windows are partitioned by a series column everywhere, so that many series run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def aligned(bars: DataFrame, tickers: Sequence[str], *, ticker: str = "ticker", session: str = "session") -> DataFrame:
    """Inner alignment: the bars of the sessions that all tickers have."""
    held = bars.where(F.col(ticker).isin(*tickers))
    common = held.groupBy(session).agg(F.count_distinct(ticker).alias("n")).where(F.col("n") == len(set(tickers))).select(session)
    return held.join(common, session)


def numbered(df: DataFrame, series: Sequence[str] = ("ticker",), session: str = "session", name: str = "idx") -> DataFrame:
    """df with the number of each session in its series, from 0."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*series).orderBy(session)) - 1).cast("long"))


def wide(bars: DataFrame, tickers: Sequence[str], fields: Sequence[str] = ("open", "close")) -> DataFrame:
    """One row a session, with a column for each ticker and field."""
    pick = lambda t, f: F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{t}_{f}")
    return aligned(bars, tickers).groupBy("session").agg(*(pick(t, f) for t in tickers for f in fields))


def reindexed(calendar: DataFrame, values: DataFrame, on: Sequence[str] = ("session",)) -> DataFrame:
    """Every row of the calendar, with nulls where values have none."""
    return calendar.join(values, list(on), "left")


def missing_sessions(calendar: DataFrame, values: DataFrame, on: Sequence[str] = ("session",)) -> DataFrame:
    """The rows of the calendar that values do not cover; a check expects none."""
    return calendar.join(values, list(on), "left_anti")


def next_session(events: DataFrame, calendar: DataFrame, *, date: str = "event_date", series: Sequence[str] = (), keep_early: bool = True) -> DataFrame:
    """events with session and idx of the first session strictly after their date; those after the last one go.

    With series columns, both sides are put in one order for each series, the latest first and a day's sessions after its
    events, and each event takes the last session above it: no range join, one pass over a sort. Without, the calendar is
    one for all events; see next_session_by_calendar. calendar: session, idx and the series columns. keep_early=False drops
    events that fall on the first session, as for news. Null dates go.
    """
    if not series:
        found = next_session_by_calendar(events, calendar, date=date)
        return found if keep_early else found.where("idx > 0")
    rest = [c for c in events.columns if c not in series]
    left = events.where(F.col(date).isNotNull()).select(*series, F.struct(*rest).alias("event"), F.col(date).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<session:date,idx:bigint>").alias("next"))
    right = calendar.select(*series, F.lit(None).cast(left.schema["event"].dataType).alias("event"), F.col("session").alias("at"), F.lit(0).alias("kind"), F.struct("session", "idx").alias("next"))
    found = left.unionByName(right).withColumn("next", _next_known(W.partitionBy(*series), "at")).where("kind = 1 and next is not null")
    found = found.select(*series, "event.*", F.col("next.session").alias("session"), F.col("next.idx").alias("idx"))
    return found if keep_early else found.where("idx > 0")


def _next_known(partition: W, at: str) -> Column:
    """next of the nearest later row that has one; of rows at one time, those of kind 1 come later."""
    return F.last("next", ignorenulls=True).over(partition.orderBy(F.desc(at), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1))


def next_session_by_calendar(events: DataFrame, calendar: DataFrame, *, date: str = "event_date") -> DataFrame:
    """The same for one calendar shared by all events: each calendar day is given its next session, and events join by
    day. The calendar has a row for each day, whatever the number of events, so events are not sorted or shuffled."""
    span = calendar.agg(F.min("session").alias("low"), F.max("session").alias("high")).select(F.explode(F.sequence(F.date_sub("low", 1), F.date_sub("high", 1))).alias("day"))
    marks = span.select("day", F.lit(None).cast("struct<session:date,idx:bigint>").alias("next"), F.lit(1).alias("kind")).unionByName(calendar.select(F.col("session").alias("day"), F.struct("session", "idx").alias("next"), F.lit(0).alias("kind")))
    days = marks.withColumn("next", _next_known(W.partitionBy(F.lit(0)), "day")).where("kind = 1").select("day", F.col("next.session").alias("session"), F.col("next.idx").alias("idx"))
    first = calendar.agg(F.min("session").alias("first_session"))
    early = F.when(F.col(date).isNotNull(), F.greatest(F.col(date), F.date_sub("first_session", 1)))
    return events.crossJoin(F.broadcast(first)).withColumn("day", early).drop("first_session").join(F.broadcast(days), "day").drop("day")


def carried(df: DataFrame, value: str | Column, *, series: Sequence[str], order: str = "idx") -> Column:
    """The last known value up to and including each row of its series."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*series).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def matured(max_train: int, horizon: int, series: Sequence[str] = ("ticker",), order: str = "idx") -> W:
    """The frame of the samples whose labels are known at a row's close, the latest max_train of them."""
    return W.partitionBy(*series).orderBy(order).rowsBetween(-(horizon + max_train - 1), -horizon)


def gathered(df: DataFrame, window: int, series: Sequence[str] = ("ticker",), order: str = "idx") -> DataFrame:
    """Each row of the last ``window`` rows of every issue: columns issue and pos (0 is the oldest), by an equi-join on
    exploded issue numbers instead of a range join. Issues with an incomplete window are left out."""
    last = df.groupBy(*series).agg(F.max(order).alias("last_idx"))
    spread = df.join(last, list(series)).withColumn("issue", F.explode(F.sequence(F.greatest(F.col(order), F.lit(window - 1)), F.least(F.col(order) + window - 1, F.col("last_idx")))))
    return spread.withColumn("pos", (F.col(order) - F.col("issue") + window - 1).cast("int")).drop("last_idx")
