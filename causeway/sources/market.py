"""Daily bars: from the driver's line items, and from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import alignment, features

TICKERS = ("A", "N", "R")
#: Factors of the panel's series A, in the order of its array.
FACTORS = ("N_ret", "N_intraday", "N_vol", "R_ret", "R_intraday", "R_vol", "A_range", "A_logvol", "breadth_mean", "breadth_sd", "breadth_up")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, session, open, high, low, close (average price) and volume of every return flag and shipping day. Money is
    summed in whole cents, so the sums do not depend on their order."""
    lines = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = cents / (100 * F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.groupBy(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("session")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), (F.sum(cents) / (100 * F.sum("l_quantity"))).alias("close"), F.sum("l_quantity").alias("volume")
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the sessions that all tickers have, numbered."""
    return alignment.numbered(alignment.aligned(bars(spark, sf_dir), TICKERS))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, session, high, low, close and volume of every brand."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = cents / (100 * F.col("l_quantity"))
    joined = lines.join(part.select("p_partkey", "p_brand"), lines["l_partkey"] == part["p_partkey"])
    return joined.groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("session")).agg(
        F.max(price).alias("high"), F.min(price).alias("low"), (F.sum(cents) / (100 * F.sum("l_quantity"))).alias("close"), F.sum("l_quantity").alias("volume")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, idx, session, close, ret and factors of ticker A."""
    rows = market(spark, sf_dir).withColumns({"ret": features.log_return(), "intraday": features.intraday_return(), "rng": features.bar_range(), "logvol": features.log_volume()})
    rows = rows.withColumn("vol", features.rolling_volatility())
    pick = lambda t, f: F.max(F.when(F.col("ticker") == t, F.col(f)))
    names = {f"{t}_{f}": (t, f) for t in ("N", "R") for f in ("ret", "intraday", "vol")} | {"A_range": ("A", "rng"), "A_logvol": ("A", "logvol")}
    wide = rows.groupBy("session").agg(F.max("idx").alias("idx"), pick("A", "close").alias("close"), pick("A", "ret").alias("ret"), *(pick(*x).alias(n) for n, x in names.items()))
    both = alignment.reindexed(wide, features.breadth(brand_bars(spark, sf_dir)))
    return both.select(F.lit("A").alias("series"), "idx", "session", "close", "ret", *(features.cleaned(F.col(f)).alias(f) for f in FACTORS), features.factor_array(FACTORS).alias("factors"))


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, idx, session, close, ret and factors of every ticker: of the two others the return, the intraday return and the
    volatility, its own range and volume, and the breadth of all brands, as panel() has them for ticker A."""
    rows = market(spark, sf_dir).withColumns({"ret": features.log_return(), "intraday": features.intraday_return(), "rng": features.bar_range(), "logvol": features.log_volume()})
    rows = rows.withColumn("vol", features.rolling_volatility())
    own = F.struct("close", "ret", "intraday", "vol", "rng", "logvol")
    wide = rows.groupBy("session").agg(F.max("idx").alias("idx"), *(F.max(F.when(F.col("ticker") == t, own)).alias(t) for t in TICKERS))
    both = alignment.reindexed(wide, features.breadth(brand_bars(spark, sf_dir)))
    breadths = [f for f in FACTORS if f.startswith("breadth")]

    def series(t: str) -> Column:
        cells = [F.col(f"{o}.{f}") for o in TICKERS if o != t for f in ("ret", "intraday", "vol")] + [F.col(f"{t}.rng"), F.col(f"{t}.logvol"), *map(F.col, breadths)]
        return F.struct(F.lit(t).alias("series"), F.col(f"{t}.close").alias("close"), F.col(f"{t}.ret").alias("ret"), F.array(*(features.cleaned(c) for c in cells)).alias("factors"))

    return both.select("idx", "session", F.explode(F.array(*map(series, TICKERS))).alias("x")).select("x.series", "idx", "session", "x.close", "x.ret", "x.factors")
