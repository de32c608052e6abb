"""The registered queries: bars of line items stand for the market, orders for filings, documents for news."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from causeway.functions import sql, text
from causeway.operators import alignment, backtest, calibration, facts, features, modal, policy, scoring, screen, signature, walkforward
from causeway.plans import config
from causeway.plans.config import CANDIDATES
from causeway.streaming import replay
from causeway.sources import files, prepared
from causeway.sources import market as m
from causeway.sources.market import table

WINDOW, MAX_TRAIN, HORIZON, LEAST = 20, 756, 1, 100
SERIES = ["ticker", "strategy"]
#: The modalities of a session, the sessions of a window of them, and the symbols whose bars are features of their own.
#: FEATURES numbers how the prepared sessions are made.
MODALITIES, MODAL_WINDOW, FEATURES, UPPER = ("price", "news", "table", "image"), 40, 2, ("Brand#11", "Brand#12")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded to six digits, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def series_a(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar that filings and news are dated on; all tickers have the same sessions."""
    return m.market(spark, sf).where("ticker = 'A'")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, idx, session, ret, the next session's date and return."""
    w = W.partitionBy("ticker").orderBy("session")
    rows = m.market(spark, sf).withColumn("ret", features.log_return())
    return rows.withColumns({"target_date": F.lead("session").over(w), "target": F.ln(F.lead("close").over(w)) - F.ln("close")}).where("target_date is not null")


def naive(spark: SparkSession, sf: str) -> DataFrame:
    """The last return as the forecast of the next one."""
    return samples(spark, sf).where("idx > 0").select("ticker", "idx", F.col("session").alias("issue_date"), "target_date", F.col("target").alias("actual_return"), F.col("ret").alias("predicted_return"))


@query
def bars_daily(spark, sf):
    return m.bars(spark, sf)


@query
def aligned_sessions(spark, sf):
    return alignment.wide(m.bars(spark, sf), m.TICKERS)


@query
def log_returns(spark, sf):
    return m.market(spark, sf).select("ticker", "session", r6(features.log_return()).alias("ret"))


@query
def intraday_returns(spark, sf):
    return m.market(spark, sf).select("ticker", "session", r6(features.intraday_return()).alias("intraday"), r6(features.open_gap()).alias("gap"))


@query
def rolling_vol20(spark, sf):
    return m.market(spark, sf).withColumn("ret", features.log_return()).select("ticker", "session", r6(features.rolling_volatility()).alias("vol"))


@query
def high_low_range_logvol(spark, sf):
    return m.market(spark, sf).select("ticker", "session", r6(features.bar_range()).alias("rng"), r6(features.log_volume()).alias("logvol"))


@query
def market_breadth(spark, sf):
    b = features.breadth(m.brand_bars(spark, sf))
    return b.select("session", *(r6(c).alias(c) for c in ("breadth_mean", "breadth_sd", "breadth_up", "breadth_log_n")))


@query
def next_up_label(spark, sf):
    return m.market(spark, sf).select("ticker", "session", features.next_up().alias("up"))


@query
def asof_next_session(spark, sf):
    calendar = series_a(spark, sf).select("session", "idx")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("event_date"))
    return alignment.next_session_by_calendar(orders, calendar).select("o_orderkey", "event_date", "session", "idx")


@query
def filing_panel_locf(spark, sf):
    calendar = series_a(spark, sf).select("session", "idx")
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    filed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(F.col("c_nationkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("event_date"), F.col("o_orderkey").alias("pos"), F.array("o_totalprice").alias("vector"))
    out = facts.panel(filed, calendar, customer.select(F.col("c_nationkey").alias("symbol")))
    return out.select("idx", "session", r6(F.col("mean")[0]).alias("mean_fact"), r6("coverage").alias("coverage"))


@query
def latest_fact(spark, sf):
    orders = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = orders.select(F.col("o_custkey").alias("symbol"), F.lit("1998-06-30").alias("filing_date"), day.alias("end"), day.alias("filed"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("val"))
    return facts.latest_fact(rows, ["symbol"])


@query
def props_json(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return events.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("largest"))


@query
def text_hash_md5(spark, sf):
    words = table(spark, sf, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("token"))
    bucket, sign = text.md5_bucket_and_sign(F.col("token"))
    return words.groupBy("lang", bucket.alias("bucket")).agg(F.sum(sign).alias("value"), F.count("*").alias("tokens"))


@query
def text_hash_blake2b(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.hash_text(F.col("text")).alias("vector"))


@query
def news_panel(spark, sf):
    """Per session: log count, and mean share of the length limit. news_panel_features has the mean hashed text too."""
    news = _news(spark, sf)
    return news.groupBy("idx", "session").agg(r6(F.log1p(F.count("*"))).alias("log_n"), r6(F.avg(F.least(F.length("text"), F.lit(text.CHARS)) / text.CHARS)).alias("mean_length"))


@query
def news_panel_features(spark, sf):
    """All features of the news panel, a row for each session and feature k: 0 to 31 are the mean hashed text of the
    documents (by MD5), 32 the log count and 33 the mean share of the length limit."""
    vectors = _news(spark, sf).select("idx", "session", text.hash_text_md5(F.col("text")).alias("vector"))
    means = facts.vector_mean(vectors, ["idx", "session"], "vector").select("idx", "session", F.posexplode("mean").alias("k", "value"))
    rest = news_panel(spark, sf).select("idx", "session", F.posexplode(F.array("log_n", "mean_length")).alias("k", "value"))
    return means.select("idx", "session", "k", r6("value").alias("value")).unionByName(rest.withColumn("k", F.col("k") + text.BUCKETS))


def _news(spark, sf, calendar: DataFrame | None = None) -> DataFrame:
    calendar = series_a(spark, sf).select("session", "idx") if calendar is None else calendar
    dated = table(spark, sf, "documents").select("doc_id", "text", F.date_add(F.lit("1998-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("event_date")).where(F.length("text") > 0)
    return alignment.next_session_by_calendar(dated, calendar).where("idx > 0")


def _modalities(spark, sf) -> DataFrame:
    """idx, session, labels (next close higher; null for the last session), and the vectors of price, news, table and image with
    what is known, kept in a prepared table: filings are orders, charts are embeddings, in classes dated by number."""
    # A row for each session and ticker or symbol; digests and parts read them many times.
    market, brands = m.market(spark, sf).persist(), m.brand_bars(spark, sf).persist()
    calendar = market.where("ticker = 'A'").select("idx", "session")
    dated = lambda rows, of: alignment.next_session_by_calendar(rows.withColumn("event_date", of), calendar)
    since = lambda key: F.date_add(F.lit("1998-01-01").cast("date"), (F.col(key) % 365).cast("int"))
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    filed = dated(orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("o_orderdate", F.col("c_nationkey").alias("symbol"), F.col("o_orderkey").alias("pos"), F.array("o_totalprice").alias("vector")), F.col("o_orderdate").cast("date"))
    charts = table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    drawn = dated(charts.select("vec_id", F.col("label").alias("symbol"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector")), since("vec_id"))
    filers, classes = customer.select(F.col("c_nationkey").alias("symbol")), charts.select(F.col("label").alias("symbol"))
    news = _news(spark, sf, calendar)

    def carried(rows: DataFrame, symbols: DataFrame) -> DataFrame:
        last = rows.groupBy("symbol", "idx").agg(F.max_by("vector", "pos").alias("vector"))
        return facts.sessions_of(last, calendar, symbols).select("idx", F.concat("mean", F.array("coverage")).alias("vector"))

    def build(first: int, last: int) -> DataFrame:
        here = F.col("idx").between(first, last)
        up = F.array(*(F.max(F.when(F.col("ticker") == t, F.col("up"))) for t in m.TICKERS))
        later = F.lead("close").over(W.partitionBy("ticker").orderBy("idx"))
        labels = market.withColumn("up", (later > F.col("close")).cast("int")).groupBy("idx", "session").agg(up.alias("labels"))
        labels = labels.withColumn("labels", F.when(~F.exists("labels", F.isnull), F.col("labels")))
        # Vectors are hashed once, and added up before the shuffle.
        found = news.where(here).select("idx", text.hash_text_md5(F.col("text")).alias("vector"), F.least(F.length("text"), F.lit(text.CHARS)).alias("n"))
        means = found.groupBy("idx").agg(F.array(*(F.avg(F.get("vector", F.lit(k))) for k in range(text.BUCKETS)), F.log1p(F.count("*")), F.avg(F.col("n") / text.CHARS)).alias("vector"))
        price = features.archive_features(market, brands, features.breadth(brands), m.TICKERS, UPPER)
        parts = {
            "price": (price.select("idx", "vector"), 16), "news": (means, text.BUCKETS + 2),
            "table": (carried(filed.where(F.col("idx") <= last), filers), 2), "image": (carried(drawn.where(F.col("idx") <= last), classes), 65),
        }
        return modal.assembled(labels.where(here), {n: (rows.where(here), width) for n, (rows, width) in parts.items()})

    # A price has a say in the return of the next session and, by the label, in the session before. Symbols may skip sessions,
    # and have bars between them.
    own = market.select(F.greatest(F.col("idx") - 1, F.lit(0)).alias("idx"), "ticker", "session", "open", "close")
    inputs = {"bars": (own, 2), "brands": (dated(brands.withColumnRenamed("session", "day"), F.date_sub("day", 1)).drop("event_date"), None), "news": (news.select("idx", "doc_id", "text"), 0), "filings": (filed.select("idx", "symbol", "pos", "vector"), None), "charts": (drawn.select("idx", "symbol", "pos", "vector"), None)}
    inputs["symbols"] = (filers.distinct().unionAll(classes.distinct()).select(F.lit(0).alias("idx"), "symbol"), None)
    schema = "idx long, session date, labels array<int>, " + ", ".join(f"{n} array<double>, {n}_known boolean" for n in MODALITIES)
    rows = prepared.refreshed(spark, f"{files.shared_folder(spark)}/causeway/prepared", {"features": FEATURES, "tables": sf, "upper": UPPER}, inputs, build, schema)
    market.unpersist()
    brands.unpersist()
    return rows


@query
def archive_features(spark, sf):
    """The 16 price features of every session: a row for each of them."""
    brands = m.brand_bars(spark, sf)
    rows = features.archive_features(m.market(spark, sf), brands, features.breadth(brands), m.TICKERS, UPPER)
    return rows.select("idx", "session", F.posexplode("vector").alias("k", "x")).select("idx", "session", "k", r6("x").alias("value"))


@query
def prepared_sessions(spark, sf):
    """What the prepared table has for each session and modality: known or not, and all its elements."""
    rows = _modalities(spark, sf)
    cells = lambda n: F.transform(n, lambda x, k: F.struct(F.lit(n).alias("modality"), F.col(f"{n}_known").cast("int").alias("known"), k.alias("k"), r6(x).alias("value")))
    return rows.select("idx", "session", F.inline(F.flatten(F.array(*map(cells, MODALITIES)))))


@query
def modality_windows(spark, sf):
    """Windows of 40 sessions of price, news, table and image, the first three in units of the training windows (the first 80 %
    of all sessions): a row for each issue and modality, with the labels, how many sessions are known, the mean of the
    newest vector, and the mean of all elements, weighted by their places in the window and in their vectors, from 1."""
    panel = _modalities(spark, sf).persist()
    cut = panel.agg(F.max("idx")).first()[0] or 0
    scaled = [n for n in MODALITIES if n != "image"]
    found = modal.moments(panel, scaled, MODAL_WINDOW, F.lit(cut * 8 // 10))
    win = modal.windows(modal.standardized(panel, found, scaled), MODALITIES, MODAL_WINDOW, carry=["labels"]).where("labels is not null")
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    width = lambda n: F.size(F.get(n, F.lit(0)))
    total = lambda n: add(F.transform(n, lambda v, p: (p + 1) * add(F.transform(v, lambda x, k: (k + 1) * x)))) * 4 / (MODAL_WINDOW * (MODAL_WINDOW + 1) * width(n) * (width(n) + 1))
    newest = lambda n: add(F.element_at(n, -1)) / width(n)
    known = lambda n: F.size(F.filter(f"{n}_known", lambda x: x)).cast("long")
    cells = [F.struct(F.lit(n).alias("modality"), width(n).cast("long").alias("width"), known(n).alias("known"), r6(newest(n)).alias("newest"), r6(total(n)).alias("weighted")) for n in MODALITIES]
    up = [F.get("labels", F.lit(i)).alias(f"up_{t}") for i, t in enumerate(m.TICKERS)]
    return win.select("issue", "session", *up, F.inline(F.array(*cells)))


@query
def sample_windows(spark, sf):
    rows = alignment.gathered(m.market(spark, sf).select("ticker", "idx", "session", "close"), WINDOW)
    first = F.min_by("close", "pos")
    out = rows.groupBy("ticker", "issue").agg(F.count("*").alias("n"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), first.alias("first_close"), F.max_by("close", "pos").alias("last_close"), F.sum(F.ln("close")).alias("s"))
    return out.where(F.col("n") == WINDOW).select("ticker", "issue", "n", "first_session", "last_session", r6(F.ln(F.col("last_close") / F.col("first_close"))).alias("anchored_last"), F.round(F.col("s") - WINDOW * F.ln("first_close"), 5).alias("anchored_sum"))


def _signature(spark, sf, depth: int) -> DataFrame:
    points = alignment.gathered(m.market(spark, sf).select("ticker", "idx", "close"), WINDOW).select("ticker", "issue", "pos", (F.col("pos").cast("double") / F.lit(float(WINDOW - 1))).alias("time"), F.ln("close").alias("log_close"))
    out = signature.by_window(points, ["time", "log_close"], depth, path=["ticker", "issue"])
    return out.select("ticker", "issue", *(r6(c).alias(c) for c in signature.coordinate_names(2, depth)))


@query
def signature_depth1(spark, sf):
    return _signature(spark, sf, 1)


@query
def signature_depth2(spark, sf):
    return _signature(spark, sf, 2)


@query
def signature_depth3(spark, sf):
    return _signature(spark, sf, 3)


@query
def signature_arrow(spark, sf):
    """Depth 4 of the embeddings, read as paths of 16 points in 4 dimensions, by Arrow batches."""
    path = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)).cast("array<double>"))
    return table(spark, sf, "embeddings").select("vec_id", signature.by_arrow(4)(path).alias("signature"))


@query
def sql_signature(spark, sf):
    """The windows of signature_depth2, by the SQL function signature()."""
    sql.register(spark)
    points = alignment.gathered(m.market(spark, sf).select("ticker", "idx", "close"), WINDOW)
    return spark.sql(
        f"""WITH paths AS (SELECT ticker, issue, array_sort(collect_list(struct(pos, array(CAST(pos AS DOUBLE) / {WINDOW - 1}, ln(close)) AS point))).point AS path FROM {{points}} GROUP BY ticker, issue HAVING count(*) = {WINDOW}),
        s AS (SELECT ticker, issue, signature(path, 2) AS s FROM paths)
        SELECT ticker, issue, {", ".join(f"round(s[{i}], 6) + 0D AS {c}" for i, c in enumerate(signature.coordinate_names(2, 2)))} FROM s""",
        points=points,
    )


@query
def sql_hash_text(spark, sf):
    """Every feature of the hashed texts, by the SQL function hash_text_md5()."""
    sql.register(spark)
    return spark.sql("SELECT doc_id, k, round(value, 6) + 0D AS value FROM (SELECT doc_id, hash_text_md5(text) AS vector FROM {docs}) LATERAL VIEW posexplode(vector) AS k, value", docs=table(spark, sf, "documents").select("doc_id", "text"))


@query
def sql_walk_forward(spark, sf):
    """The forecasts of walk_forward_forecast for all three tickers, by the table function walk_forward()."""
    sql.register(spark)
    settings = json.dumps({"depth2_sparse": asdict(CANDIDATES["depth2_sparse"])})
    return spark.sql("SELECT * FROM walk_forward(TABLE({panel}) PARTITION BY series ORDER BY idx, candidates => :settings)", args={"settings": settings}, panel=m.panels(spark, sf))


@query
def window_standardize(spark, sf):
    """Mean and deviation of features over training windows and their sessions, each session once for each window."""
    rows = m.market(spark, sf).withColumns({"ret": features.log_return(), "rng": features.bar_range()})
    win = alignment.gathered(rows.select("ticker", "idx", "ret", "rng"), WINDOW)
    last = rows.groupBy("ticker").agg(F.floor(F.max("idx") * 8 / 10).alias("cut"))
    moments = features.window_moments(win.join(last, "ticker").where("issue < cut"), ["ret", "rng"], by=["ticker"])
    return moments.select("ticker", "feature", r6("mean").alias("mean"), r6("sd").alias("sd"), "n")


@query
def standardized_windows(spark, sf):
    """The windows themselves in units of the training windows' deviations, 8 at most: a row for each issue, with the sum of
    each feature over the window and the largest absolute value."""
    rows = m.market(spark, sf).withColumns({"ret": features.log_return(), "rng": features.bar_range()})
    win = alignment.gathered(rows.select("ticker", "idx", "ret", "rng"), WINDOW)
    last = rows.groupBy("ticker").agg(F.floor(F.max("idx") * 8 / 10).alias("cut"))
    moments = features.window_moments(win.join(last, "ticker").where("issue < cut"), ["ret", "rng"], by=["ticker"])
    z = features.standardized(win, moments, ["ret", "rng"], by=["ticker"])
    wide = z.groupBy("ticker", "issue").agg(*(c for f in ("ret", "rng") for c in (r6(F.sum(f)).alias(f"{f}_sum"), r6(F.max(F.abs(f))).alias(f"{f}_top"))))
    return wide.where(F.col("issue") >= WINDOW - 1)


@query
def factor_screen_rolling(spark, sf):
    p = m.panel(spark, sf).withColumn("ticker", F.col("series"))
    out = screen.rolling(p, ["N_ret", "R_ret", "A_range"], "ret", alignment.matured(MAX_TRAIN, HORIZON), LEAST)
    return out.select("idx", "session", "train_n", *(r6(f"corr_{f}").alias(f"corr_{f}") for f in ("N_ret", "R_ret", "A_range")))


@query
def factor_corr_matrix(spark, sf):
    out = screen.matrix(m.panel(spark, sf), ["N_ret", "R_ret", "A_range", "breadth_mean"])
    return out.select("left", "right", r6("corr").alias("corr"))


@query
def factor_screen_table(spark, sf):
    out = screen.screen_table(m.panel(spark, sf), ["N_ret", "R_ret", "A_range", "breadth_mean"], "ret")
    return out.select("factor", r6("correlation").alias("correlation"))


@query
def training_calendar(spark, sf):
    out = walkforward.training_calendar(samples(spark, sf), alignment.matured(MAX_TRAIN, HORIZON))
    return out.select("ticker", "idx", "session", "target_date", "training_issue_first", "training_issue_last", "latest_training_target", "training_examples")


@query
def frozen_normalizer(spark, sf):
    out = scoring.frozen_normaliser(samples(spark, sf), alignment.matured(MAX_TRAIN, HORIZON)).where(F.col("label_n") >= 2)
    return out.select("ticker", "idx", "session", r6("label_mean").alias("label_mean"), r6("label_sd").alias("label_sd"), "label_n")


@query
def softmax_weights_neff(spark, sf):
    rows = m.market(spark, sf).withColumn("ret", features.log_return())
    out = screen.softmax_weights(rows.withColumn("distance", F.abs("ret")), "distance", 0.5, ["ticker"])
    return out.groupBy("ticker").agg(r6(F.sum("weight")).alias("total"), F.round(F.max("n_eff"), 4).alias("n_eff"), F.round(F.max("weight") * 1000, 6).alias("largest"))


@query
def weighted_gram(spark, sf):
    rows = m.panel(spark, sf).withColumn("w", F.exp(-F.abs("ret")))
    out = screen.weighted_gram(rows, ["N_ret", "R_ret", "A_range"], "ret", "w")
    return out.select("i", "j", r6("value").alias("value"))


@query
def walk_forward_forecast(spark, sf):
    """A forecast of every session of ticker A that has enough history, by the validation-selected settings."""
    out = walkforward.forecasts(m.panel(spark, sf), {"depth2_sparse": CANDIDATES["depth2_sparse"]}, first=0)
    return out.drop("candidate").withColumn("selected_factors", F.transform("selected_factors", lambda k: F.get(F.array(*(F.lit(f) for f in m.FACTORS)), k)))


@query
def candidate_selection(spark, sf):
    """Errors of all candidates over all sessions, the best first."""
    return walkforward.selection(walkforward.forecasts(m.panel(spark, sf), CANDIDATES, first=0))


@query
def score_predictions(spark, sf):
    out = scoring.scores(naive(spark, sf), 1e-4, -1e-4, by=["ticker"])
    return out.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query
def price_reconstruction(spark, sf):
    prices = m.market(spark, sf).select("ticker", "session", "close")
    out = scoring.reconstructed_prices(naive(spark, sf), prices, by=["ticker"])
    return out.select("ticker", "issue_date", "target_date", "previous_actual_close", "actual_close", F.round("predicted_close", 4).alias("predicted_close"))


@query
def price_mae(spark, sf):
    prices = m.market(spark, sf).select("ticker", "session", "close")
    out = scoring.price_errors(scoring.reconstructed_prices(naive(spark, sf), prices, by=["ticker"]), by=["ticker"])
    return out.select("ticker", F.round("price_mae", 4).alias("price_mae"), F.round("last_close_mae", 4).alias("last_close_mae"))


@query
def return_errors(spark, sf):
    out = scoring.return_errors(naive(spark, sf), by=["ticker"])
    return out.select("ticker", "issue_date", "target_date", r6("log_return_error").alias("log_return_error"), r6("simple_return_error").alias("simple_return_error"))


@query
def pearson_nmse(spark, sf):
    """Errors over the second half of the sessions, in units of the labels' deviation at the first of these issues."""
    rows = scoring.frozen_normaliser(samples(spark, sf), alignment.matured(MAX_TRAIN, HORIZON))
    half = rows.groupBy("ticker").agg(F.floor(F.max("idx") / 2).alias("half"))
    sd = rows.join(half, "ticker").where(F.col("idx") == F.col("half") + 1).select("ticker", "half", F.col("label_sd").alias("frozen_sd"))
    out = scoring.normalised_errors(naive(spark, sf).join(sd, "ticker").where("idx > half"), F.col("frozen_sd"), by=["ticker"])
    return out.select("ticker", *(r6(c).alias(c) for c in out.columns if c != "ticker"))


def _test_and_calibration(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = naive(spark, sf)
    both = rows.join(rows.groupBy("ticker").agg(F.floor(F.max("idx") / 2).alias("half")), "ticker")
    return both.where("idx > half").drop("half"), both.where("idx <= half").drop("half")


@query
def midcdf_allocation(spark, sf):
    test, cal = _test_and_calibration(spark, sf)
    ranked = policy.mid_percentile(test, cal, by=["ticker"])
    return ranked.select("ticker", "idx", "issue_date", r6("percentile").alias("percentile"), r6(policy.allocation(F.col("percentile"))).alias("allocation"))


def _strategies(spark, sf, simple: str = "close") -> DataFrame:
    test, cal = _test_and_calibration(spark, sf)
    ranked = policy.mid_percentile(test, cal, by=["ticker"])
    if simple == "close":
        ranked = ranked.withColumn("asset_simple_return", F.expm1("actual_return"))
    else:
        day = m.market(spark, sf).select("ticker", F.col("session").alias("target_date"), (F.col("close") / F.col("open") - 1).alias("asset_simple_return"))
        ranked = ranked.join(day, ["ticker", "target_date"])
    kinds = F.array(F.struct(F.lit("percentile").alias("strategy"), policy.allocation(F.col("percentile")).alias("allocation")), *(F.struct(F.lit(n).alias("strategy"), F.lit(x).alias("allocation")) for n, x in (("half", 0.5), ("hold", 1.0))))
    return ranked.select("*", F.explode(kinds).alias("k")).select("ticker", "idx", "issue_date", "target_date", "asset_simple_return", "k.*")


@query
def backtest_ledger(spark, sf):
    out = policy.ledger(_strategies(spark, sf), series=SERIES)
    return out.select(*SERIES, "idx", "issue_date", r6(F.ln("wealth")).alias("log_wealth"), r6("drawdown").alias("drawdown"), r6(F.col("cash_dollars") / F.col("wealth_before")).alias("cash_share"))


@query
def backtest_performance(spark, sf):
    out = policy.performance(policy.ledger(_strategies(spark, sf), series=SERIES), by=SERIES)
    return out.select(*SERIES, "sessions", r6(F.ln("final_wealth")).alias("log_final_wealth"), *(r6(c).alias(c) for c in ("max_drawdown_pct", "annualized_sharpe_rf0", "mean_allocation_pct", "min_allocation_pct", "max_allocation_pct")))


@query
def open_to_close_variant(spark, sf):
    out = policy.performance(policy.ledger(_strategies(spark, sf, "open"), series=SERIES), by=SERIES)
    return out.select(*SERIES, "sessions", r6(F.ln("final_wealth")).alias("log_final_wealth"), r6("max_drawdown_pct").alias("max_drawdown_pct"), r6("annualized_sharpe_rf0").alias("annualized_sharpe_rf0"))


@query
def validate_contiguous(spark, sf):
    bad = policy.violations(naive(spark, sf), m.market(spark, sf).select("ticker", "session", "close"), atol=1e-9, by=["ticker"])
    return bad.agg(F.count("*").alias("violations"))


@query
def prev_day_direction(spark, sf):
    out = scoring.previous_direction(m.market(spark, sf))
    return out.select("ticker", "previous_session_date", "issue_date", "target_date", "predicted_direction", "actual_direction", "correct")


@query
def confusion_matrix(spark, sf):
    return scoring.confusion(scoring.previous_direction(m.market(spark, sf)), ["ticker"])


@query
def baseline_comparison(spark, sf):
    out = scoring.baseline_table(scoring.previous_direction(m.market(spark, sf)), by=["ticker"])
    return out.select("ticker", "method", r6("accuracy").alias("accuracy"))


@query
def factor_frequency(spark, sf):
    """How often each factor passes the screen: a rolling correlation of 0.05 or more, either way."""
    names = ["N_ret", "R_ret", "A_range"]
    p = screen.rolling(m.panel(spark, sf).withColumn("ticker", F.col("series")), names, "ret", alignment.matured(MAX_TRAIN, HORIZON), LEAST)
    picked = p.where(F.col("train_n") >= LEAST).select(F.filter(F.array(*(F.when(F.abs(f"corr_{n}") >= 0.05, F.lit(n)) for n in names)), lambda x: x.isNotNull()).alias("factors"))
    return scoring.factor_frequency(picked, F.col("factors"))


@query
def block_bootstrap(spark, sf):
    rows = naive(spark, sf).select("ticker", (F.col("idx") - 1).alias("idx"), (F.abs(F.col("predicted_return") - F.col("actual_return")) - F.abs("actual_return")).alias("difference"))
    starts = scoring.block_starts(rows, by=["ticker"])
    out = scoring.block_bootstrap(rows, starts, by=["ticker"])
    return out.select("ticker", *(r6(c).alias(c) for c in out.columns if c != "ticker"))


@query
def split_ticker_summary(spark, sf):
    rows = m.market(spark, sf).withColumns({"up": features.next_up(), "ret": features.log_return()})
    rows = rows.select("ticker", F.when(F.col("idx") < 200, "train").otherwise("test").alias("split"), F.col("up").alias("label"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("ret")))).alias("probability"))
    out = scoring.split_summary(rows)
    return out.select("split", "ticker", "n", *(r6(c).alias(c) for c in ("accuracy", "brier", "up_rate", "majority")))


@query
def rolling_hit_rate(spark, sf):
    rows = scoring.previous_direction(m.market(spark, sf)).withColumn("hit", F.col("correct").cast("double"))
    return rows.select("ticker", "issue_date", r6(scoring.rolling_rate(F.col("hit"), ["ticker"], "issue_date")).alias("rate"))


@query
def candidate_table(spark, sf):
    return config.table(spark, CANDIDATES)


@query
def direction_metrics(spark, sf):
    out = scoring.direction_metrics(scoring.previous_direction(m.market(spark, sf)), ["ticker"])
    return out.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


#: Issues after this day are a held-out part of the sessions.
AFTER = "1997-01-01"


@query
def score_after(spark, sf):
    out = scoring.scores(scoring.after(naive(spark, sf), AFTER, ["ticker"]), by=["ticker"])
    return out.select("ticker", "n", *(r6(c).alias(c) for c in ("return_mae", "return_rmse", "accuracy", "balanced_accuracy")))


@query
def held_out_comparison(spark, sf):
    out = scoring.held_out_table(scoring.scores(scoring.after(naive(spark, sf), AFTER, ["ticker"]), by=["ticker"]), ["ticker"])
    return out.select("ticker", "metric", r6("model").alias("model"), r6("baseline").alias("baseline"))


@query
def method_comparison(spark, sf):
    """Prices by repeating the last return and by no change, of the issues after a day, with their errors as shares of the
    close."""
    repeat = scoring.after(naive(spark, sf), AFTER, ["ticker"])
    out = scoring.method_table({"repeat": repeat, "flat": repeat.withColumn("predicted_return", F.lit(0.0))}, m.market(spark, sf).select("ticker", "session", "close"), ["ticker"])
    share = lambda m: r6(F.col(f"{m}_error") / F.col("actual_close")).alias(f"{m}_error")
    return out.select("ticker", "issue_date", "target_date", F.round("repeat_close", 4).alias("repeat_close"), share("repeat"), "flat_close", share("flat"))


@query
def masked_factor_screen(spark, sf):
    """Correlations over the sessions whose targets came before a day; the two strongest factors are marked."""
    names = ["N_ret", "R_ret", "A_range", "breadth_mean"]
    w = W.partitionBy("series").orderBy("session")
    training = m.panel(spark, sf).withColumn("target_date", F.lead("session").over(w)).where(F.col("target_date") < F.lit(AFTER).cast("date"))
    strongest = screen.screen_table(training, names, "ret", by=["series"]).withColumn("place", F.row_number().over(W.partitionBy("series").orderBy(F.desc(F.abs("correlation")), "factor")))
    out = screen.screen_table(training, names, "ret", strongest.where("place <= 2"), by=["series"])
    return out.select("series", "factor", r6("correlation").alias("correlation"), "selected")


@query
def prequential_summary(spark, sf):
    """Direction by online logistic regression on the last return and range, each series in its own time."""
    rows = m.market(spark, sf).withColumns({"ret": features.log_return(), "rng": features.bar_range(), "up": features.next_up()})
    scored = replay.prequential(rows.select(F.col("ticker").alias("series"), "idx", F.array(F.col("ret") * 10, F.col("rng")).alias("features"), F.col("up").alias("label")), 2)
    out = scoring.split_summary(scored, ["split", "series"])
    return out.select("split", "series", "n", *(r6(c).alias(c) for c in ("accuracy", "brier", "up_rate", "majority")))


def _policy(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The policy on the model's own forecasts: of the sessions with a forecast, the second half is the test. Forecasts are
    stored by what they depend on, so a second query, or a second run, makes none; their anchors are checked."""
    panel, config = m.panel(spark, sf).persist(), CANDIDATES["depth2_sparse"]
    model = lambda first, last: walkforward.forecasts(panel, {"depth2_sparse": config}, first=first, last=last)
    most = panel.agg(F.max("idx")).first()[0]
    names = backtest.identity(config, panel, panel.groupBy("series").agg(F.min("session").alias("first")))
    forecasts = calibration.stored(spark, f"{files.shared_folder(spark)}/causeway/forecasts", names, model, 0, -1 if most is None else most)
    calibration.check_anchors(forecasts, model)
    panel.unpersist()  # what follows reads the stored forecasts
    middle = F.element_at(F.array_sort(F.collect_list("issue_date")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    first = forecasts.groupBy("series").agg(middle.alias("first_issue"))
    known, test = backtest.split(forecasts, first, MAX_TRAIN)
    prices = m.market(spark, sf).select(F.col("ticker").alias("series"), "session", "open", "close")
    return backtest.run(test, known, prices)


@query
def policy_details(spark, sf):
    return _policy(spark, sf)[0].drop("candidate", "selected_factors")


@query
def policy_summary(spark, sf):
    return _policy(spark, sf)[1]


@query
def forecast_factor_frequency(spark, sf):
    """How often the forecasts of ticker A use each factor."""
    return scoring.factor_frequency(walk_forward_forecast(spark, sf), F.col("selected_factors"))
