"""Filings: the latest eligible fact, and a panel of last known values over sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import alignment

#: The tags of a filing in the order of its vector, and their unit.
TAGS = ("Assets", "Liabilities", "StockholdersEquity", "CashAndCashEquivalentsAtCarryingValue")
UNIT = "USD"


def latest_fact(facts: DataFrame, by: Sequence[str], *, value: str = "val") -> DataFrame:
    """Of the facts that had ended and been filed by the filing date (ISO strings), the value with the latest (end,
    filed); on a tie, the first in file order (column pos)."""
    eligible = facts.where("end <= filing_date and filed <= filing_date").where(F.col(value).isNotNull())
    return eligible.groupBy(*by).agg(F.max_by(value, F.struct("end", "filed", -F.col("pos"))).alias(value), F.max("end").alias("end"))


def filing_facts(filings: DataFrame) -> DataFrame:
    """A row for each USD fact of the known tags: symbol, filing (its number in the file), filing_date, tag, end, filed,
    val, pos. filings: symbol and the nested filings array of sources.files.FILING_SCHEMA."""
    one = filings.select("symbol", F.posexplode("filings").alias("filing", "f")).where("f is not null")
    tags = one.select("symbol", "filing", F.col("f.filing_date").alias("filing_date"), F.explode(F.col("f.facts.us-gaap")).alias("tag", "body")).where(F.col("tag").isin(*TAGS))
    unit = F.element_at("body.units", UNIT)
    return tags.select("symbol", "filing", "filing_date", "tag", F.posexplode(unit).alias("pos", "x")).select("symbol", "filing", "filing_date", "tag", "pos", "x.end", "x.filed", "x.val")


def filing_vectors(facts: DataFrame) -> DataFrame:
    """symbol, filing, filing_date and vector (log assets over 30; liabilities, equity and cash over assets; a missing
    fact counts 0). Filings without positive assets are dropped."""
    latest = latest_fact(facts, ["symbol", "filing", "filing_date", "tag"])
    pick = lambda t: F.max(F.when(F.col("tag") == t, F.col("val")))
    row = latest.groupBy("symbol", "filing", "filing_date").agg(*(pick(t).alias(t) for t in TAGS))
    a = F.col(TAGS[0])
    row = row.where(a.isNotNull() & (a > 0) & (a < float("inf")))
    ratio = lambda t: F.coalesce(F.col(t) / a, F.lit(0.0))
    return row.select("symbol", "filing", "filing_date", F.array((F.log1p(a) / 30).cast("float"), *(ratio(t).cast("float") for t in TAGS[1:])).alias("vector"))


def panel(vectors: DataFrame, calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each session: mean of the symbols' last known vectors, and the share of symbols that have one.

    vectors: symbol, event_date, pos (file order; of a session's filings the last one holds) and vector; calendar: session
    and idx, a row for each day; symbols: symbol. The product of calendar and symbols is the panel itself.
    """
    dated = alignment.next_session_by_calendar(vectors, calendar)
    last = dated.groupBy("symbol", "idx").agg(F.max_by("vector", "pos").alias("vector"))
    return sessions_of(last, calendar, symbols)


def sessions_of(last: DataFrame, calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same of vectors that have their session: symbol, idx (each pair once) and vector."""
    grid = symbols.select("symbol").distinct().crossJoin(F.broadcast(calendar.select("idx", "session")))
    filled = grid.join(last, ["symbol", "idx"], "left").withColumn("known", alignment.carried(last, "vector", series=["symbol"]))
    return vector_mean(filled, ["idx", "session"], "known")


def vector_mean(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of the vectors of a group that are not null (element by element, zero where there are none) and
    the share of rows with a vector."""
    share = df.groupBy(*by).agg((F.count(vector) / F.count("*")).alias("coverage"))
    parts = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("k", "x")).groupBy(*by, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("mean"))
    return share.join(means, list(by), "left")
