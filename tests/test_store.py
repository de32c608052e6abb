"""Stored forecasts over ended and changed runs, and digests of inputs."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import calibration
from causeway.operators.walkforward import SCHEMA
from causeway.sources import files


class Model:
    """Forecasts that count how often each chunk is made, and end the run after some."""

    def __init__(self, spark, left=99, add=0.0):
        self.spark, self.left, self.add, self.made = spark, left, add, []

    def __call__(self, first, last):
        if not self.left:
            raise KeyboardInterrupt
        self.left -= 1
        self.made.append((first, last))
        rows = [(s, "c", i, None, None, 0.0, self.add + i / 7 + len(s), 1, 1, [1], 2.0) for s in ("x", "yy") for i in range(first, min(last, 64) + 1)]
        df = self.spark.createDataFrame(rows, SCHEMA.replace("date date", "date string")).withColumns({c: F.date_add(F.lit("2024-01-01").cast("date"), F.col("issue_idx").cast("int")) for c in ("issue_date", "target_date")})
        return df.repartition(2)


def test_resumed_runs(spark, tmp_path):
    get = lambda model, key=None, first=5, last=64: calibration.stored(spark, str(tmp_path), key or {"v": 1}, model, first, last, chunk=20, together=1)
    first = Model(spark, left=2)
    with pytest.raises(KeyboardInterrupt):
        get(first)
    again = Model(spark)
    rows = get(again)
    assert (first.made, again.made) == ([(0, 19), (20, 39)], [(40, 59), (60, 79)])
    assert sorted((r.series, r.issue_idx, r.predicted_return) for r in rows.collect()) == sorted((s, i, i / 7 + len(s)) for s in ("x", "yy") for i in range(5, 65))
    third = Model(spark)
    assert get(third).count() == 120 and not third.made
    calibration.check_anchors(rows, third)
    assert third.made == [(5, 5), (34, 34), (64, 64)]
    with pytest.raises(ValueError, match="issue 5 "):
        calibration.check_anchors(rows, Model(spark, add=1e-6))
    other = Model(spark)
    assert get(other, {"v": 2}).count() == 120 and len(other.made) == 4
    # A chunk that was half written has no manifest and is made again; one that was changed later raises.
    wide = Model(spark)
    assert calibration.stored(spark, str(tmp_path), {"v": 3}, wide, 5, 64, chunk=20, together=3).count() == 120 and wide.made == [(0, 59), (60, 79)]
    at = calibration.place(str(tmp_path), {"v": 1, "chunk": 20})
    Model(spark)(0, 9).withColumn("chunk", F.lit(4)).write.mode("overwrite").parquet(f"{at}/run-00000004-00000004")
    more = Model(spark)
    assert get(more, last=85).count() == 120 and more.made == [(80, 99)]
    Model(spark)(0, 9).withColumn("chunk", F.lit(1)).write.mode("overwrite").parquet(f"{at}/run-00000001-00000001")
    with pytest.raises(ValueError, match="not those that were published"):
        get(Model(spark))
    assert get(Model(spark), first=0, last=-1).count() == 0


def test_digest_of_inputs(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(12):
        (tmp_path / "in" / ("deep" if i % 2 else ".") / f"f{i}").write_bytes(bytes([i]) * i)
    where = str(tmp_path / "in")
    digest = files.tree_hash(spark, where)
    assert digest == files.tree_hash(spark, [where]) and len(digest) == 64
    with files.unchanged(spark, where) as before:
        assert before == digest
    with pytest.raises(ValueError, match="inputs changed"), files.unchanged(spark, where):
        (tmp_path / "in" / "f2").write_bytes(b"other")
    assert files.tree_hash(spark, where) != digest
    changed = files.tree_hash(spark, where)
    (tmp_path / "in" / "f2").rename(tmp_path / "in" / "g2")
    assert files.tree_hash(spark, where) != changed
