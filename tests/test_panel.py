import datetime as dt
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import text
from causeway.operators import alignment, facts, features, scoring
from causeway.plans import config
from causeway.sources import files
from causeway.streaming import replay


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_next_session_is_strictly_later(spark):
    calendar = spark.createDataFrame([(day(1), 0), (day(2), 1), (day(5), 2)], "session date, idx long")
    events = spark.createDataFrame([(i, day(n)) for i, n in enumerate((-9, 0, 1, 2, 3, 5, 9))], "id int, event_date date")
    want = {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    assert {r["id"]: r["idx"] for r in alignment.next_session_by_calendar(events, calendar).collect()} == want
    assert {r["id"]: r["idx"] for r in alignment.next_session(events, calendar).collect()} == want
    assert {r["id"]: r["idx"] for r in alignment.next_session(events, calendar, keep_early=False).collect()} == {2: 1, 3: 2, 4: 2}


def test_next_session_of_each_series(spark):
    days = {"a": [1, 2, 5], "b": [0, 5]}
    calendar = spark.createDataFrame([(s, day(n), i) for s, x in days.items() for i, n in enumerate(x)], "series string, session date, idx long")
    raw = [(s, k, None if n is None else day(n)) for s in ("a", "b", "c") for k, n in enumerate((-9, 0, 1, 2, 3, 5, 9, None, 2))]
    events = spark.createDataFrame(raw, "series string, id int, event_date date").repartition(3)
    later = lambda s, d: next((i for i, n in enumerate(days.get(s, [])) if d is not None and day(n) > d), None)
    want = {(s, k): later(s, d) for s, k, d in raw if later(s, d) is not None}
    got = alignment.next_session(events, calendar, series=["series"])
    assert {(r["series"], r["id"]): r["idx"] for r in got.collect()} == want
    assert alignment.next_session(events.limit(0), calendar, series=["series"]).isEmpty()


def test_windows_in_standard_scores(spark):
    raw = [("A", i, float(v), None if i == 2 else float(i)) for i, v in enumerate((1, 2, 3, 4, 500))]
    win = spark.createDataFrame(raw, "ticker string, idx long, x double, y double")
    moments = features.window_moments(win.where("idx < 4"), ["x", "y"], ["ticker"])
    got = {r["feature"]: (r["mean"], r["sd"], r["n"]) for r in moments.collect()}
    assert got["x"] == pytest.approx((2.5, np.std([1, 2, 3, 4]), 4)) and got["y"] == pytest.approx((4 / 3, np.std([0, 1, 3]), 3))
    z = {r["idx"]: (r["x"], r["y"]) for r in features.standardized(win, moments, ["x", "y"], ["ticker"]).collect()}
    assert z[4][0] == 8.0 and z[0][0] == pytest.approx(-1.5 / np.std([1, 2, 3, 4])) and z[2][1] == 0.0


def test_windows_and_carry(spark):
    rows = spark.createDataFrame([("A", i, float(i)) for i in range(5)], "ticker string, idx long, x double")
    got = alignment.gathered(rows, 3).groupBy("issue").agg(F.sort_array(F.collect_list("x")).alias("xs")).orderBy("issue").collect()
    assert [(r["issue"], r["xs"]) for r in got] == [(2, [0, 1, 2]), (3, [1, 2, 3]), (4, [2, 3, 4])]
    some = spark.createDataFrame([("A", 0, None), ("A", 1, 5.0), ("A", 2, None)], "ticker string, idx long, x double")
    assert [r[0] for r in some.select("idx", alignment.carried(some, "x", series=["ticker"]).alias("c")).orderBy("idx").select("c").collect()] == [None, 5.0, 5.0]


def test_breadth_rules(spark):
    raw = [("a", 0, 10.0), ("a", 1, 11.0), ("a", 2, -1.0), ("b", 0, 10.0), ("b", 1, 30.0), ("b", 2, 33.0), ("c", 1, 5.0), ("c", 2, 4.0)]
    bars = spark.createDataFrame([(s, day(n), c, i) for i, (s, n, c) in enumerate(raw)], "symbol string, session date, close double, position int")
    got = {r["session"]: r for r in features.breadth(features.last_of_day(bars, "position")).collect()}
    r = [math.log(33 / 30), math.log(4 / 5)]
    assert got[day(1)]["breadth_mean"] == pytest.approx(math.log(1.1)) and got[day(1)]["breadth_log_n"] == pytest.approx(math.log(2))
    assert got[day(2)]["breadth_mean"] == pytest.approx(np.mean(r)) and got[day(2)]["breadth_sd"] == pytest.approx(np.std(r)) and got[day(2)]["breadth_up"] == 0.5
    twice = bars.union(spark.createDataFrame([("a", day(1), 12.0, 99)], bars.schema))
    assert features.last_of_day(twice, "position").where("symbol = 'a' and session = date'2024-01-02'").first()["close"] == 12.0


def test_filings(spark, tmp_path):
    fact = lambda end, filed, val: {"end": end, "filed": filed, "val": val}
    tag = lambda *f: {"units": {"USD": list(f)}}
    good = {"Assets": tag(fact("2023-12-31", "2024-01-01", 100.0), fact("2023-12-31", "2024-01-02", 200.0), fact("2024-06-30", "2024-07-01", 900.0)), "StockholdersEquity": tag(fact("2023-12-31", "2024-01-01", 50.0))}
    bad = {"Assets": tag(fact("2023-12-31", "2024-01-01", -5.0))}
    body = {"filings": [{"filing_date": "2024-01-02", "facts": {"us-gaap": good}}, {"filing_date": "2024-01-03", "facts": {"us-gaap": bad}}]}
    (tmp_path / "acme.json").write_text(json.dumps(body))
    vectors = facts.filing_vectors(facts.filing_facts(files.read_filings(spark, str(tmp_path)))).collect()
    assert len(vectors) == 1 and vectors[0]["symbol"] == "acme"
    assert vectors[0]["vector"] == pytest.approx([math.log1p(200) / 30, 0, 0.25, 0], rel=1e-6)
    calendar = spark.createDataFrame([(day(0), 0), (day(1), 1), (day(2), 2)], "session date, idx long")
    panel = facts.panel(spark.createDataFrame([("acme", dt.date(2024, 1, 2), 0, vectors[0]["vector"])], "symbol string, event_date date, pos int, vector array<float>"), calendar, spark.createDataFrame([("acme",), ("none",)], "symbol string"))
    rows = panel.orderBy("idx").collect()
    assert [r["coverage"] for r in rows] == [0, 0, 0.5] and rows[0]["mean"] is None and rows[2]["mean"][2] == pytest.approx(0.25)


def test_hashed_texts(spark):
    got = spark.createDataFrame([("Stocks rose; stocks ROSE ab",), (None,), ("",)], "t string").select(text.hash_text(F.col("t"))).collect()
    want = np.zeros(32)
    for token in ("stocks", "rose", "stocks", "rose"):
        h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "little")
        want[h % 32] += 1 if h >> 31 else -1
    assert got[0][0] == pytest.approx(want / max(1, np.linalg.norm(want)), rel=1e-6)
    assert not any(got[1][0]) and not any(got[2][0])


def test_bar_files_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "SPY.csv").write_text("Date,Open,Close,Volume\n2024-01-02 00:00,1,2,x\nbad,1,1,1\n2024-01-03,3,4,5\n")
    (tmp_path / "in" / "BAD.csv").write_text("Date,Price\n2024-01-02,1\n")
    bars = files.read_bars(spark, str(tmp_path / "in"))
    assert [(r["ticker"], r["close"], r["volume"]) for r in bars.orderBy("session").collect()] == [("SPY", 2.0, None), ("SPY", 4.0, 5.0)]
    with pytest.raises(ValueError):
        files.check_bars(bars)
    frame = spark.createDataFrame([(day(0), day(1), 0.1, 0.2, 1, 1, ["a", "b"], 9.0)], files.PREDICTION_SCHEMA.replace("selected_factors string", "selected_factors array<string>"))
    files.write_csv(frame, str(tmp_path / "out"))
    assert files.read_predictions(spark, str(tmp_path / "out")).collect() == frame.collect()
    calls = []
    build = lambda: calls.append(1) or frame
    for key in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert files.cached(spark, str(tmp_path / "cache"), key, build).count() == 1
    assert len(calls) == 2


def test_bar_files_with_unlike_headers(spark, tmp_path):
    (tmp_path / "A.csv").write_text('date,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,1,2,0.5,1.6,11\n')
    (tmp_path / "B.csv").write_text('"Timestamp", "CLOSE" ,"Open"\n"2024-01-02T00:00:00","7","6"\n')
    (tmp_path / "C.csv").write_text("close,x\n1,2\n")
    (tmp_path / "D.csv").write_text("")
    (tmp_path / "note.txt").write_text("close,date\n1,2024-01-01\n")
    got = sorted((r["ticker"], r["session"], r["open"], r["high"], r["close"], r["volume"]) for r in files.read_bars(spark, str(tmp_path)).collect())
    assert got == [("A", day(1), 1, 2, 1.5, 10), ("A", day(2), 1, 2, 1.6, 11), ("B", day(1), 6, None, 7, None)]


def test_image_panel_is_recent_and_skips_bad_files(spark, tmp_path):
    for name, body in {"a_2023_H1": b"\x10", "a_2023_H2": b"\x20", "b_2023_H2": b"", "b_2024_H1": b"\x60", "c_2020_H1": b"\x90"}.items():
        (tmp_path / f"{name}_candlestick.png").write_bytes(body)

    def decode(data):
        if not data:
            raise ValueError("no image")
        return np.full((100, 100, 3), data[0], np.uint8)

    images = files.read_images(spark, str(tmp_path), decode=decode)
    calendar = spark.createDataFrame([(dt.date(2024, 1, 2), 0), (dt.date(2024, 6, 30), 1), (dt.date(2024, 7, 1), 2)], "session date, idx long")
    rows = files.image_panel(images, calendar).orderBy("idx").collect()
    assert images.count() == 4 and [r["coverage"] for r in rows] == pytest.approx([1 / 3, 1 / 3, 2 / 3])
    assert [r["mean"][0] for r in rows] == pytest.approx([32 / 255, 32 / 255, (32 + 96) / 2 / 255])


def test_run_files_and_prepared_table(spark, tmp_path):
    frame = spark.createDataFrame([(1, ["x", "y"])], "n int, names array<string>")
    files.save_run(spark, str(tmp_path / "run"), {"predictions": frame, "metrics": frame.select("n")}, {"config": config.asdict(config.ForecastConfig(window=30)), "day": day(0)})
    info = files.read_json(spark, str(tmp_path / "run" / "run_info"))
    assert config.from_run_info(info) == config.ForecastConfig(window=30) and info["day"] == "2024-01-01"
    assert spark.read.option("header", True).csv(str(tmp_path / "run" / "predictions")).first()["names"] == "x;y"
    with pytest.raises(ValueError):
        files.write_json(spark, {"x": math.nan}, str(tmp_path / "bad"))
    calendar = spark.createDataFrame([(0, day(0)), (1, day(1))], "idx long, session date")
    calls = []
    parts = {"news": lambda: calls.append(1) or spark.createDataFrame([(1, 0.5)], "idx long, x double")}
    for key in (1, 1, 2):
        got = files.prepared(spark, str(tmp_path / "set"), {"k": key}, lambda: calendar, parts).orderBy("idx").collect()
        assert [r["news"] and r["news"]["x"] for r in got] == [None, 0.5]
    assert len(calls) == 2


def test_prequential_replay(spark):
    rng = np.random.default_rng(2)
    raw = [(s, i, [float(x)], int(x + 0.3 * e > 0)) for s in ("A", "B") for i, (x, e) in enumerate(zip(rng.normal(size=60), rng.normal(size=60)))]
    rows = spark.createDataFrame(raw, "series string, idx long, features array<double>, label int")
    got = {(r["series"], r["idx"]): r for r in replay.prequential(rows.orderBy(F.rand(1)), 1).collect()}
    for s in ("A", "B"):
        mine, w = [r for r in raw if r[0] == s], np.zeros(2)
        p = lambda x, w=None: 1 / (1 + math.exp(-(w[0] * x + w[1])))
        for _ in range(5):
            for _, _, (x,), y in mine[:48]:
                w = w + replay.RATE * (y - p(x, w)) * np.array([x, 1])
        for _, i, (x,), y in mine[48:]:
            assert got[s, i]["split"] == "test" and got[s, i]["probability"] == pytest.approx(p(x, w))
            w = w + replay.RATE * (y - p(x, w)) * np.array([x, 1])
        assert all(got[s, i]["split"] == "train" for i in range(48))
    assert replay.prequential(rows.limit(0), 1).isEmpty()


def test_images_by_another_decoder(spark, tmp_path):
    (tmp_path / "acme_2024_H1_candlestick.png").write_bytes(b"\x80")
    row = files.read_images(spark, str(tmp_path), decode=lambda b: np.full((100, 100, 3), b[0], np.uint8)).first()
    assert row["symbol"] == "acme" and row["event_date"] == dt.date(2024, 6, 30) and len(row["vector"]) == 432 and row["vector"][0] == pytest.approx(128 / 255)


def test_bootstrap_and_confusion(spark):
    x = np.random.default_rng(1).normal(size=45)
    errors = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, difference double")
    starts = np.random.default_rng(17).integers(0, 45, size=(50, 3))
    table = spark.createDataFrame([(i, k, int(s)) for i, row in enumerate(starts) for k, s in enumerate(row)], "rep long, block_no long, start long")
    means = [x[np.concatenate([(s + np.arange(20)) % 45 for s in row])[:45]].mean() for row in starts]
    got = scoring.block_bootstrap(errors, table).first()
    assert (got["difference"], got["low"], got["high"]) == pytest.approx((x.mean(), *np.quantile(means, [0.025, 0.975])))
    rows = spark.createDataFrame([("UP", "UP"), ("UP", "UP")], "actual_direction string, predicted_direction string")
    assert [tuple(r) for r in scoring.confusion(rows).orderBy("actual").collect()] == [("DOWN", 0, 0), ("UP", 2, 0)]


def test_online_scores_keep_state(spark, tmp_path):
    rows = spark.createDataFrame([("A", i, [float(i % 2)], i % 2) for i in range(200)], "series string, idx long, features array<double>, label int")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = replay.online_scores(stream, 1).writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["idx"]: r["probability"] for r in spark.table("online").collect()}
    assert got[0] == 0.5 and got[199] > 0.6 and got[198] < 0.4


def test_news_panel_has_all_features(spark):
    duckdb = pytest.importorskip("duckdb")
    from causeway.plans import registry

    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in registry.queries()["news_panel_features"](spark, folder).collect())
    db = duckdb.connect()
    for name in ("documents", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(db.execute(registry.oracle_sql()["news_panel_features"]).fetchall())
    assert [r[:3] for r in got] == [r[:3] for r in want] and {r[2] for r in got} == set(range(34))
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)
    assert any(r[3] for r in got if r[2] < 32)
