import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import alignment, backtest, policy
from causeway.plans.config import ForecastConfig


def values(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "idx int, predicted_return double")


def weights(spark, xs, cal):
    got = policy.mid_percentile(values(spark, xs), values(spark, cal).select("predicted_return")).select("idx", "percentile", policy.allocation(F.col("percentile")).alias("w")).orderBy("idx").collect()
    return [r["percentile"] for r in got], [r["w"] for r in got]


def ledger(spark, returns, allocation):
    rows = spark.createDataFrame([("s", i, float(r), float(w)) for i, (r, w) in enumerate(zip(returns, allocation))], "strategy string, idx int, asset_simple_return double, allocation double")
    return policy.ledger(rows)


def test_frozen_percentiles(spark):
    p, w = weights(spark, [-0.03, -0.02, 0, 0.02, 0.03], [-0.02, 0, 0.02])
    assert p == pytest.approx([0, 1 / 6, 0.5, 5 / 6, 1]) and w == pytest.approx([0.2, 0.3, 0.5, 0.7, 0.8])
    assert weights(spark, [0], [0, 0, 0])[0] == [0.5]


def test_later_forecasts_do_not_change_earlier_weights(spark):
    early = weights(spark, [-0.005, 0.005], [-0.01, 0, 0.01])[1]
    assert weights(spark, [-0.005, 0.005, -100, 100], [-0.01, 0, 0.01])[1][:2] == early


def test_compounding_cash_and_sharpe(spark):
    book = ledger(spark, [0.10, -0.20], [0.8, 0.2])
    rows = book.orderBy("idx").collect()
    assert [r["wealth"] for r in rows] == pytest.approx([108, 103.68]) and [r["cash_dollars"] for r in rows] == pytest.approx([20, 86.4])
    row = policy.performance(book).first()
    assert (row["total_return_pct"], row["max_drawdown_pct"], row["annualized_sharpe_rf0"]) == pytest.approx((3.68, 4, math.sqrt(14)))


def test_drawdown_includes_the_start(spark):
    assert policy.performance(ledger(spark, [-0.1, 0.2], [0.8, 0.2])).first()["max_drawdown_pct"] == pytest.approx(8)


def test_cash_only_and_log_returns(spark):
    full = ledger(spark, [math.expm1(math.log(1.1)), math.expm1(math.log(0.8))], [1, 1]).orderBy("idx").collect()
    assert [r["wealth"] for r in full] == pytest.approx([110, 88])
    cash = ledger(spark, [0.1, -0.2], [0, 0])
    assert [r["wealth"] for r in cash.collect()] == [100, 100] and policy.performance(cash).first()["annualized_sharpe_rf0"] is None


@pytest.mark.parametrize("r, w", [(math.nan, 0.5), (0, 1.1), (-1, 0.5)])
def test_invalid_ledgers(spark, r, w):
    with pytest.raises(ValueError):
        policy.check_inputs(ledger(spark, [r], [w]))


def test_empty_calibration(spark):
    with pytest.raises(ValueError):
        policy.mid_percentile(values(spark, [0]), values(spark, []).select("predicted_return"))


def test_dates_and_prices_must_match(spark):
    days = [dt.date(2024, 1, 2 + i) for i in range(3)]
    prices = spark.createDataFrame(list(zip(days, [100.0, 110.0, 99.0])), "session date, close double")
    kind = "issue_date date, target_date date, actual_return double, predicted_return double"
    good = [(days[0], days[1], math.log(1.1), 0.0), (days[1], days[2], math.log(0.9), 0.0)]
    assert policy.violations(spark.createDataFrame(good, kind), prices).isEmpty()
    late = [(days[0], days[2], math.log(1.1), 0.0), good[1]]
    wrong = [(days[0], days[1], math.log(1.2), 0.0), good[1]]
    assert [r["rule"] for r in policy.violations(spark.createDataFrame(late, kind), prices).collect()] == ["target is not the next session"]
    assert [r["rule"] for r in policy.violations(spark.createDataFrame(wrong, kind), prices).collect()] == ["return does not match the closes"]


def test_percentiles_of_many_values_and_groups(spark):
    rng = np.random.default_rng(4)
    raw = [(g, i, float(v)) for g in ("a", "b") for i, v in enumerate(np.round(rng.normal(size=900), 1))]
    df = spark.createDataFrame(raw, "g string, idx int, predicted_return double").repartition(5)
    cal = df.where("idx % 3 = 0")
    got = {(r["g"], r["idx"]): r["percentile"] for r in policy.mid_percentile(df, cal.select("g", "predicted_return"), by=["g"]).collect()}
    for g in ("a", "b"):
        held = np.array([v for h, i, v in raw if h == g and i % 3 == 0])
        for h, i, v in raw:
            if h == g:
                assert got[g, i] == pytest.approx(((held < v).sum() + (held == v).sum() / 2) / len(held))


def policy_inputs(spark, n=260):
    rng = np.random.default_rng(5)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    rows, prices = [], []
    for s in ("a", "b"):
        close = 100 * np.exp(np.cumsum(rng.normal(scale=0.01, size=n + 1)))
        prices += [(s, day(i), float(c * math.exp(rng.normal(scale=0.003))), float(c)) for i, c in enumerate(close)]
        rows += [(s, day(i), day(i + 1), float(np.log(close[i + 1] / close[i])), float(rng.normal(scale=0.002))) for i in range(n)]
    kind = "series string, issue_date date, target_date date, actual_return double, predicted_return double"
    return rows, spark.createDataFrame(rows, kind), spark.createDataFrame(prices, "series string, session date, open double, close double"), prices, day


def test_policy_run_against_plain_python(spark):
    rows, forecasts, prices, price_rows, day = policy_inputs(spark)
    first = spark.createDataFrame([("a", day(150)), ("b", day(200))], "series string, first_issue date")
    calibration, test = backtest.split(forecasts, first, 120)
    details, summary = backtest.run(test, calibration, prices)
    details = {(r["series"], r["issue_date"]): r for r in details.collect()}
    summary = {(r["series"], r["strategy"], r["execution"]): r for r in summary.collect()}
    assert len(summary) == 8
    bar = {(s, d): (o, c) for s, d, o, c in price_rows}
    for s, at in (("a", 150), ("b", 200)):
        mine = [r for r in rows if r[0] == s]
        held = np.array([r[4] for r in mine[max(0, at - 120) : at]])
        assert len(held) == 120
        wealth, peak, low, moves = {"percentile": 100.0, "half": 100.0, "hold": 100.0, "open": 100.0}, 100.0, 0.0, []
        for _, issue, target, actual, forecast in mine[at:]:
            p = ((held < forecast).sum() + (held == forecast).sum() / 2) / len(held)
            r = details[s, issue]
            assert r["training_percentile"] == pytest.approx(p) and r["allocation"] == pytest.approx(0.2 + 0.6 * p) and r["predicted_simple_return"] == pytest.approx(math.expm1(forecast))
            assert r["wealth_before"] == pytest.approx(wealth["percentile"])
            intraday = bar[s, target][1] / bar[s, target][0] - 1
            for name, w, x in (("percentile", 0.2 + 0.6 * p, math.expm1(actual)), ("half", 0.5, math.expm1(actual)), ("hold", 1, math.expm1(actual)), ("open", 0.2 + 0.6 * p, intraday)):
                wealth[name] *= 1 + w * x
            moves.append((0.2 + 0.6 * p) * math.expm1(actual))
            peak = max(peak, wealth["percentile"])
            low = min(low, wealth["percentile"] / peak - 1)
            assert (r["wealth"], r["fixed_50_wealth"], r["buy_hold_wealth"], r["drawdown"]) == pytest.approx((wealth["percentile"], wealth["half"], wealth["hold"], wealth["percentile"] / peak - 1))
        row = summary[s, "percentile", "close to close"]
        assert (row["final_wealth"], row["max_drawdown_pct"]) == pytest.approx((wealth["percentile"], -100 * low))
        assert row["annualized_sharpe_rf0"] == pytest.approx(math.sqrt(252) * np.mean(moves) / np.std(moves, ddof=1))
        assert summary[s, "percentile", "next open to close"]["final_wealth"] == pytest.approx(wealth["open"])
        assert summary[s, "hold", "close to close"]["final_wealth"] == pytest.approx(wealth["hold"])


def test_calibration_needs_matured_forecasts_and_anchors(spark):
    rows, forecasts, _, _, day = policy_inputs(spark)
    with pytest.raises(ValueError, match="matured"):
        backtest.split(forecasts, spark.createDataFrame([("a", day(150)), ("b", day(99))], "series string, first_issue date"), 120)
    held = backtest.anchors(forecasts)
    assert sorted((r["series"], r["issue_date"]) for r in held.collect()) == [(s, day(i)) for s in ("a", "b") for i in (0, 130, 259)]
    assert backtest.unlike(held, forecasts).isEmpty()
    other = forecasts.withColumn("predicted_return", F.when(F.col("issue_date") == F.lit(day(130)), F.col("predicted_return") + 1e-6).otherwise(F.col("predicted_return")))
    assert {r["issue_date"] for r in backtest.unlike(held, other).collect()} == {day(130)}
    assert backtest.unlike(held, forecasts.where("series = 'a'")).count() == 3


def test_calibration_identity(spark):
    panel = spark.createDataFrame([("a", 0, 1.0, 0.1, [0.5]), ("a", 1, 2.0, 0.2, [0.6])], "series string, idx long, close double, ret double, factors array<float>")
    first = spark.createDataFrame([("a", dt.date(2020, 1, 1))], "series string, first_issue date")
    key = backtest.identity(ForecastConfig(), panel, first)
    assert key == backtest.identity(ForecastConfig(), panel.orderBy(F.desc("idx")), first)
    assert key != backtest.identity(ForecastConfig(window=30), panel, first) and key != backtest.identity(ForecastConfig(), panel.withColumn("ret", F.lit(0.3)), first)


def test_no_sort_of_all_rows_in_one_task(spark):
    """Exchanges to one partition hold aggregates or a calendar, no forecasts or events."""
    df = spark.range(5000).select(F.rand(1).alias("predicted_return"), F.col("id").alias("idx"))
    lines = policy.mid_percentile(df, df.select("predicted_return"))._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [below for line, below in zip(lines, lines[1:]) if "SinglePartition" in line]
    assert all("HashAggregate(keys=[range_" in x for x in single)  # 64 rows
    events = spark.range(5000).select("id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("event_date"), F.lit("a").alias("series"))
    calendar = spark.range(300).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("session"), F.col("id").alias("idx"), F.lit("a").alias("series"))
    assert "SinglePartition" not in alignment.next_session(events, calendar, series=["series"])._jdf.queryExecution().executedPlan().toString()
    by_day = alignment.next_session(events.drop("series"), calendar.drop("series"))._jdf.queryExecution().optimizedPlan().toString()
    assert by_day.count("Window") == 1  # that of the calendar's days
