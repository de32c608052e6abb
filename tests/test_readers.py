"""Bars from folders and zip archives, news lines, percentiles with nulls, and random block starts."""

import datetime as dt
import io
import json
import zipfile
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.operators import policy, scoring
from causeway.sources import archives, files

MEMBERS = {
    "A": "Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-03,\"1,000.5\",1100,900,1050,77\nbad,1,1,1,1,1\n2020-01-06,,x,1,2,\n",
    "CLOSE": "﻿Timestamp, close ,name,Open\r\n2020-01-02T10:00:00,7,\"the \"\"close\"\", at last\",6\r\n\"2020-01-03\",8,close,\r\n",
    "quoted": '"date","volume","close"\n"2020-01-02","5","3"\n,1,2\n"2020-01-03"\n',
    "empty": "",
    "headless": "2020-01-02,1,2\n",
    "other": "close,x\n1,2\n",
}


def by_pandas(text):
    try:
        t = pd.read_csv(io.StringIO(text.lstrip("﻿")), dtype=str, skipinitialspace=True)
    except pd.errors.EmptyDataError:
        return []
    t.columns = [c.strip().lower() for c in t.columns]
    day = "date" if "date" in t else "timestamp"
    if day not in t or "close" not in t:
        return []
    when = pd.to_datetime(t[day].str[:10], errors="coerce")
    number = lambda c: pd.to_numeric(t[c], errors="coerce") if c in t else pd.Series([None] * len(t), dtype=float)
    rows = zip(when, *(number(c) for c in archives.VALUES), strict=True)
    return [(r[0].date(), *(None if pd.isna(x) else float(x) for x in r[1:])) for r in rows if not pd.isna(r[0])]


WANT = {name.upper(): by_pandas(text) for name, text in MEMBERS.items()}


def got(df):
    out = {}
    for r in df.orderBy("ticker", "position").collect():
        out.setdefault(r.ticker.upper(), []).append((r.session, *(r[c] for c in archives.VALUES)))
    return out


def test_bar_folder_equals_pandas(spark, tmp_path):
    for name, text in MEMBERS.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    assert WANT["A"][1] == (dt.date(2020, 1, 3), None, 1100.0, 900.0, 1050.0, 77.0)
    assert got(files.read_bars(spark, str(tmp_path))) == {t: r for t, r in WANT.items() if r}


def test_zip_archive_equals_folder(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "prices.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in MEMBERS.items():
            z.writestr(f"prices/{name}.csv", text)
        z.writestr("readme.txt", "close,date\n1,2020-01-01\n")
        z.writestr("prices/damaged.csv", MEMBERS["A"] * 300)
    data = bytearray(open(path, "rb").read())
    with zipfile.ZipFile(path) as z:
        at = z.getinfo("prices/damaged.csv").header_offset
    data[at + 60 : at + 90] = b"\xff" * 30
    open(path, "wb").write(data)
    read = lambda where=path, **options: archives.read_zip_bars(spark, where, **options)
    whole = {t: r for t, r in WANT.items() if r}
    assert got(read()) == whole
    monkeypatch.setattr(archives, "PARTITION", 1)
    assert got(read(f"{path},file:{path}").where("archive like 'file:%'")) == whole
    with pytest.raises(Exception, match=r"damaged\.csv"):
        read(mode="failfast").where("ticker = 'DAMAGED'").collect()
    assert read(mode="failfast").where("ticker in ('A', 'QUOTED') and close > 1").count() == 4
    assert {r.volume for r in read(columns="open").collect()} == {None}
    with pytest.raises(Exception, match="no columns of bars"):
        read(columns="price").collect()


def test_zip_archive_plans_partitions_and_filters(tmp_path, monkeypatch):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for i in range(10):
            z.writestr(f"t{i}.csv", "date,close\n2020-01-02,1\n" * 4)
    monkeypatch.setattr(archives, "PARTITION", 300)
    reader = archives.ZipBarsReader({"path": path})
    assert [len(p.names) for p in reader.partitions()] == [3, 3, 3, 1]
    left = list(reader.pushFilters([archives.StringStartsWith(("ticker",), "T"), archives.In(("ticker",), ("T3", "T4")), archives.EqualTo(("close",), 1.0)]))
    assert [f.attribute for f in left] == [("close",)] and [p.names for p in reader.partitions()] == [("t3.csv", "t4.csv")]


def test_news_lines(spark, tmp_path):
    lines = [{"Date": "2024-01-02 10:00", "Article": "text"}, {"Date": "2024-01-03", "Article": None}, {"Date": "2024-01-04"}, {"Date": "2024-01-05", "Article": 5}, {"Article": "no date"}]
    (tmp_path / "sym.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n[1]\n")
    got_ = [(r.symbol, r.event_date.day, r.text) for r in files.read_news(spark, str(tmp_path)).orderBy("event_date").collect()]
    assert got_ == [("sym", 2, "text"), ("sym", 3, "None"), ("sym", 4, ""), ("sym", 5, "5")]


def test_percentiles_of_nulls(spark):
    nan = float("nan")
    test = spark.createDataFrame([(0, "a", 1.0), (1, "a", None), (2, "a", nan), (3, None, 2.0), (4, "b", 1.0), (5, "a", 9.0)], "idx int, g string, predicted_return double")
    cal = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", None), ("a", nan), (None, 2.0), (None, 3.0)], "g string, predicted_return double")
    rows = policy.mid_percentile(test, cal, by=["g"]).orderBy("idx").collect()
    assert [(r.idx, r.percentile) for r in rows] == [(0, 0.75), (1, None), (2, None), (3, 0.25), (4, None), (5, 1.0)]
    with pytest.raises(ValueError, match="empty"):
        policy.mid_percentile(test, cal.where("predicted_return is null"))


def test_block_starts_are_uniform(spark):
    errors = spark.range(50).select(F.lit("x").alias("g"), F.col("id").alias("idx"))
    draw = lambda **k: scoring.block_starts(errors, reps=2000, block=20, by=["g"], **k)
    rows = [(r.rep, r.block_no, r.start) for r in draw().orderBy("rep", "block_no").collect()]
    assert [r[:2] for r in rows] == [(i, b) for i in range(2000) for b in range(3)]
    counts = Counter(r[2] for r in rows)
    chi = sum((counts[i] - 120) ** 2 / 120 for i in range(50))
    assert set(counts) == set(range(50)) and 25 < chi < 90  # 49 degrees of freedom
    assert rows == [(r.rep, r.block_no, r.start) for r in draw().orderBy("rep", "block_no").collect()]
    assert draw(seed=18).join(draw(), ["g", "rep", "block_no", "start"]).count() < 300
