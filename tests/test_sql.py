"""What SQL can call, against the DataFrame forms and plain Python."""

import hashlib
import json
import math
import re

import numpy as np
import pytest

from causeway.functions import sql, text
from causeway.operators import signature, walkforward

SETTINGS = {"a": {"signature_depth": 2, "max_train": 120}, "b": {"signature_depth": 1, "horizon": 3, "max_train": 100}}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for series, n in (("x", 420), ("y", 180), ("short", 30)):
        ret = rng.normal(0, 0.01, n)
        close = 100 * np.exp(np.cumsum(ret))
        first = 40 if series == "y" else 0
        rows += [(series, first + i, f"20{10 + i // 360:02d}-{1 + i % 360 // 30:02d}-{1 + i % 30 % 28:02d}", float(close[i]), float(ret[i]), rng.normal(0, 1, 4).tolist(), 0) for i in range(n)]
    kind = "series string, idx long, day string, close double, ret double, factors array<double>, last int"
    return spark.createDataFrame(rows, kind).selectExpr("series", "idx", "date_add(DATE'2010-01-01', CAST(idx AS INT)) AS session", "close", "ret", "factors", "last").repartition(3).cache()


def call(spark, panel, how="PARTITION BY series ORDER BY idx", more="", settings=SETTINGS):
    sql.register(spark)
    return spark.sql(f"SELECT * FROM walk_forward(TABLE({{panel}}) {how}, candidates => :settings{more})", args={"settings": json.dumps(settings)}, panel=panel)


def plain(df):
    return sorted((r.series, r.candidate, r.issue_idx, r.issue_date, r.target_date, r.actual_return, r.predicted_return, r.lasso_support_count, tuple(r.selected_factors), r.effective_train_n) for r in df.collect())


def test_table_function_equals_the_operator(spark, panel, monkeypatch):
    configs = {n: walkforward.ForecastConfig(**c) for n, c in SETTINGS.items()}
    whole = plain(walkforward.forecasts(panel, configs, first=0))
    assert {r[0] for r in whole} == {"x", "y"} and {r[1] for r in whole} == {"a", "b"}
    assert plain(call(spark, panel)) == whole
    some = plain(walkforward.forecasts(panel, configs, first=150, last=290))
    assert plain(call(spark, panel, more=", first => 150, last => 290")) == some and len(some) < len(whole)
    assert call(spark, panel.where("false")).count() == 0


def test_table_function_refuses_what_it_cannot_do(spark, panel):
    for how, said in (("WITH SINGLE PARTITION", "PARTITION BY series"), ("PARTITION BY series ORDER BY close", "not numbered one after another")):
        with pytest.raises(Exception, match=said):
            call(spark, panel, how).collect()
    for settings, said in (({}, "no candidate"), ({"a": {"window": 2}}, "window must be in"), ({"a": {"windw": 20}}, "windw")):
        with pytest.raises(Exception, match=said):
            call(spark, panel, settings=settings)
    with pytest.raises(Exception, match="no column ret, factors"):
        call(spark, panel.drop("ret", "factors"))


def test_sql_signature(spark):
    sql.register(spark)
    rng = np.random.default_rng(2)
    paths = [rng.normal(size=(n, d)).tolist() for n, d in ((2, 1), (5, 2), (9, 3))]
    rows = [(i, p, k) for k in (1, 2, 3) for i, p in enumerate(paths)] + [(7, None, 2), (8, paths[0], None), (9, [[1.0]], 2), (10, [[1.0, 2.0], [3.0]], 2)]
    got = spark.sql("SELECT i, depth, signature(path, depth) AS s FROM {t}", t=spark.createDataFrame(rows, "i int, path array<array<double>>, depth int")).collect()
    for r in got:
        if r.i < 3:
            assert np.allclose(r.s, signature.batch(np.array([paths[r.i]]), r.depth)[0], rtol=0, atol=1e-12)
        else:
            assert r.s is None


def hashed(t, digest):
    v = [0.0] * 32
    for w in re.findall("[a-z]{3,}", (t or "").lower()[:5000]):
        h = digest(w)
        v[h % 32] += 1 if h >> 31 else -1
    norm = max(1.0, math.sqrt(sum(x * x for x in v)))
    return [x / norm for x in v]


def test_sql_hash_text(spark):
    sql.register(spark)
    texts = [None, "", "One two Three, three: ÄRGER x", "word " * 3000, "ab cd", "z" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = spark.sql("SELECT i, hash_text(t) AS b, hash_text_md5(t) AS m FROM {t}", t=df).withColumn("c", text.hash_text_md5(sql.F.lit(texts[2]))).collect()
    for r in got:
        assert r.m == pytest.approx(hashed(texts[r.i], lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)), abs=1e-15)
        assert r.b == pytest.approx(hashed(texts[r.i], lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little")), abs=1e-7)
        assert r.c == pytest.approx(hashed(texts[2], lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)), abs=1e-15)
