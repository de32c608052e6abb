"""Windows of several modalities, the archive's price features and the prepared table, against plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import features, modal
from causeway.sources import prepared


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def sessions(spark, lengths):
    rows = [(s, i, day(i), [float(i % 7 + len(s)), i * 1e6], None if i % 3 else [i / 2]) for s, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "series string, idx long, session date, price array<double>, news array<double>").repartition(3)
    parts = {"price": (df.select("series", "idx", F.col("price").alias("vector")), 2), "news": (df.where("news is not null").select("series", "idx", F.col("news").alias("vector")), 1)}
    return rows, modal.assembled(df.select("series", "idx", "session"), parts, ["series"])


@pytest.mark.parametrize("chunk", [3, 128])
def test_windows_of_modalities(spark, chunk):
    rows, panel = sessions(spark, {"a": 11, "bb": 23, "c": 4})
    got = modal.windows(panel, ["price", "news"], 5, by=["series"], carry=[], chunk=chunk).collect()
    of = {s: [r for r in rows if r[0] == s] for s in ("a", "bb", "c")}
    assert sorted((r["series"], r["issue"]) for r in got) == [(s, i) for s in ("a", "bb") for i in range(4, len(of[s]))]
    for r in got:
        win = of[r["series"]][r["issue"] - 4 : r["issue"] + 1]
        assert (r["session"], r["price"]) == (win[-1][2], [x[3] for x in win])
        assert (r["news"], r["news_known"]) == ([x[4] or [0.0] for x in win], [x[4] is not None for x in win])


def test_moments_count_windows(spark):
    rows, panel = sessions(spark, {"a": 11, "bb": 23, "c": 4})
    found = modal.moments(panel, ["price", "news"], 5, F.when(F.col("series") == "a", 8).otherwise(17), ["series"])
    got = {(r["series"], r["modality"], r["k"]): (r["mean"], r["sd"]) for r in found.collect()}
    z = {(r["series"], r["idx"]): r["price"] for r in modal.standardized(panel, found, ["price", "news"], ["series"]).collect()}
    assert {s for s, _ in z} == {"a", "bb"} == {s for s, _, _ in got}
    for s, last in (("a", 8), ("bb", 17)):
        of = [r for r in rows if r[0] == s]
        flat = np.array([r[3] for i in range(4, last + 1) for r in of[i - 4 : i + 1]])
        for k in (0, 1):
            assert got[s, "price", k] == pytest.approx((flat[:, k].mean(), flat[:, k].std()), rel=1e-12)
            assert z[s, 10][k] == pytest.approx((of[10][3][k] - flat[:, k].mean()) / flat[:, k].std())
        news = np.array([(r[4] or [0.0])[0] for i in range(4, last + 1) for r in of[i - 4 : i + 1]])
        assert got[s, "news", 0] == pytest.approx((news.mean(), news.std()))
    none = modal.moments(panel, ["price"], 5, F.lit(3), ["series"])
    assert none.isEmpty() and modal.standardized(panel, none, ["price"], ["series"]).isEmpty()


def test_edges_of_windows(spark):
    _, panel = sessions(spark, {"a": 5})
    for window in (1, 513):
        with pytest.raises(ValueError, match="2 to 512"):
            modal.windows(panel, ["price"], window, by=["series"])
    assert modal.windows(panel.limit(0), ["price"], 5, by=["series"]).isEmpty()
    short = spark.createDataFrame([(0, [1.0, None])], "idx long, vector array<double>")
    days = spark.createDataFrame([(0,), (1,)], "idx long")
    assert sorted((r["idx"], r["x"], r["x_known"]) for r in modal.assembled(days, {"x": (short, 2)}).collect()) == [(0, [1.0, 0.0], True), (1, [0.0, 0.0], False)]


def test_archive_features(spark):
    prices = {"A": [(10, 11), (11, 12), (None, 12), (12, 0), (13, 13)], "B": [(5, 5), (5, 6), (6, 7), (7, 8), (0, 9)]}
    rows = [(t, day(i), *map(lambda x: None if x is None else float(x), p)) for t, x in prices.items() for i, p in enumerate(x)] + [("B", day(9), 1.0, 1.0), ("X", day(0), 1.0, 1.0)]
    targets = spark.createDataFrame(rows, "ticker string, session date, open double, close double")
    archive = spark.createDataFrame([("u.1", day(0), 3.0, 1.0, 2.0, 9.0), ("u.1", day(1), 5.0, 3.0, 4.0, None), ("u.1", day(2), 5.0, 3.0, 4.0, 1.0), ("u.1", day(4), 5.0, 3.0, 8.0, 1.0), ("v", day(0), 1.0, 1.0, 1.0, 1.0)], "symbol string, session date, high double, low double, close double, volume double")
    breadths = spark.createDataFrame([(day(1), 0.5), (day(7), 0.7)], "session date, b double")
    got = {r["session"]: (r["idx"], r["vector"]) for r in features.archive_features(targets, archive, breadths, ["A", "B"], ["u.1"]).collect()}
    # Day 2 has no opening price of A; a return to or from a close of 0 is no number; u.1 has no bar on day 3.
    want = {
        day(0): [0, 0, 0.1, 0, 0, 1, math.log(10), 0], day(1): [math.log(12 / 11), math.log(6 / 5), 12 / 11 - 1, 0.2, math.log(2), 0.5, 0, 0.5],
        day(3): [0, math.log(8 / 6), -1, 8 / 7 - 1, 0, 0, 0, 0], day(4): [0, math.log(9 / 8), 0, 0, 0, 0.25, math.log(2), 0],
    }
    assert sorted(got) == sorted(want) and [got[d][0] for d in sorted(want)] == [0, 1, 2, 3]
    for d, vector in want.items():
        assert got[d][1] == pytest.approx(vector)


class Source:
    """Prices (each has a say in the next session) and levels that are carried; counts what is built, and may end the run."""

    def __init__(self, spark, n=30):
        self.spark, self.made, self.left = spark, [], 99
        self.price = {i: i / 2 for i in range(n)}
        self.level = {0: 1.0, 12: 2.0}

    def build(self, first, last):
        if not self.left:
            raise KeyboardInterrupt
        self.left -= 1
        self.made.append((first, last))
        rows = self.want()
        return self.spark.createDataFrame([r for r in rows if first <= r[0] <= last], "idx long, step double, level double").repartition(2)

    def want(self):
        level = lambda i: next((self.level[j] for j in range(i, -1, -1) if j in self.level), None)
        return [(i, p - self.price.get(i - 1, p), level(i)) for i, p in sorted(self.price.items())]

    def get(self, folder, settings=None):
        self.made = []
        frame = lambda d: self.spark.createDataFrame(sorted(d.items()), "idx long, x double").repartition(2)
        inputs = {"price": (frame(self.price), 1), "level": (frame(self.level), None)}
        rows = prepared.refreshed(self.spark, folder, settings or {"v": 1}, inputs, self.build, "idx long, step double, level double", part=8)
        assert sorted(map(tuple, rows.collect())) == self.want()
        return self.made


def test_only_what_changed_is_prepared(spark, tmp_path):
    at, s = str(tmp_path / "table"), Source(spark)
    assert s.get(at) == [(0, 31)] and s.get(at) == []
    s.price[30] = 99.0  # a new session rewrites its part only
    assert s.get(at) == [(24, 31)]
    s.price[9] = -1.0
    assert s.get(at) == [(8, 23)] or s.made == [(8, 15)]  # what a part's last session has a say in may be in the next part
    s.price[31] = 5.0
    assert s.get(at) == [(24, 31)]
    s.level[12] = 7.0  # is carried to the end
    assert s.get(at) == [(8, 31)]
    for i in range(24, 32):
        del s.price[i]
    s.get(at)
    s.price = {i: x for i, x in s.price.items() if i < 20}
    assert s.get(at)[0][0] == 16
    assert s.get(at, {"v": 2}) == [(0, 23)]


def test_runs_that_end_early(spark, tmp_path):
    at, s = str(tmp_path / "table"), Source(spark)
    s.get(at)
    old = dict(s.price)
    s.price[3], s.price[29], s.left = 50.0, 60.0, 1
    with pytest.raises(KeyboardInterrupt):
        s.get(at)
    # The first run of parts was replaced and the second was not. With the inputs as before, both are made again.
    s.price, s.left = old, 99
    assert s.get(at) == [(0, 15), (24, 31)] and s.get(at) == []
    empty = prepared.refreshed(spark, at, {"v": 9}, {"price": (spark.createDataFrame([], "idx long, x double"), 0)}, s.build, "idx long, step double, level double")
    assert empty.isEmpty()
    assert prepared.runs({5, 1, 2, 9, 4}) == [(1, 2), (4, 5), (9, 9)]
