"""Forecasts that outlive the run that made them: kept in chunks of issues, each with a manifest, and checked before use.

A store is a folder with a subfolder for each identity (settings, and checksums of what the forecasts depend on), so whatever
changes starts anew and nothing stale is read. A chunk counts once its manifest is there, which is written after its rows and
names their number and checksum; a run that ends early leaves at most one job's chunks without, and the next run makes the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import backtest
from causeway.operators.walkforward import SCHEMA

#: Issues of a chunk, and chunks that are made in one job.
CHUNK, TOGETHER = 100, 8
Forecast = Callable[[int, int], DataFrame]


def place(folder: str, identity: dict) -> str:
    return f"{folder}/{hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:24]}"


def _manifests(spark: SparkSession, at: str) -> dict[int, dict]:
    try:
        rows = spark.read.text(f"{at}/done/*").collect()  # a row for each chunk
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {m["chunk"]: m for m in (json.loads(r["value"]) for r in rows)}


def _sums(rows: DataFrame) -> dict[int, list]:
    """Number and checksum of the rows of each chunk, which their order has no influence on."""
    checksum = F.sum(F.xxhash64("series", "candidate", "issue_idx", "predicted_return").cast("decimal(38,0)"))
    return {r["chunk"]: [r["n"], str(r["sum"])] for r in rows.groupBy("chunk").agg(F.count("*").alias("n"), checksum.alias("sum")).collect()}


def stored(spark: SparkSession, folder: str, identity: dict, forecast: Forecast, first: int, last: int, *, chunk: int = CHUNK, together: int = TOGETHER) -> DataFrame:
    """The forecasts of the issues first to last of all series; forecast(first, last) makes those that the store has not, up to
    ``together`` neighbouring chunks in a job. Chunks whose rows are not those that their manifests name raise."""
    at = place(folder, identity | {"chunk": chunk})
    kind = f"{SCHEMA}, chunk int"
    done, wanted = _manifests(spark, at), range(first // chunk, last // chunk + 1)
    missing = [number for number in wanted if number not in done]
    while missing:
        run = [n for i, n in enumerate(missing[:together]) if n == missing[0] + i]
        missing = missing[len(run) :]
        path = f"run-{run[0]:08d}-{run[-1]:08d}"
        made = forecast(run[0] * chunk, (run[-1] + 1) * chunk - 1).withColumn("chunk", F.floor(F.col("issue_idx") / chunk).cast("int"))
        made.write.mode("overwrite").parquet(f"{at}/{path}")
        sums = _sums(spark.read.schema(kind).parquet(f"{at}/{path}"))
        lines = [(json.dumps({"chunk": n, "path": path, "rows": sums.get(n, [0, "0"])}),) for n in run]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{at}/done/{path}")
    named = {n: m for n, m in _manifests(spark, at).items() if n in wanted}
    if not named:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(kind).parquet(*sorted({f"{at}/{m['path']}" for m in named.values()})).where(F.col("chunk").between(wanted[0], wanted[-1]))
    if _sums(rows) != {n: m["rows"] for n, m in named.items() if m["rows"][0]}:
        raise ValueError(f"the forecasts in {at} are not those that were published")
    return rows.where(F.col("issue_idx").between(first, last)).drop("chunk")


def check_anchors(rows: DataFrame, forecast: Forecast) -> None:
    """Raise unless the model of today makes the stored forecasts of the first, the middle and the last issue again."""
    ends = rows.agg(F.min("issue_idx").alias("low"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY issue_idx)").alias("middle"), F.max("issue_idx").alias("high")).first()
    for idx in dict.fromkeys(x for x in (ends["low"], ends["middle"], ends["high"]) if x is not None):
        saved = rows.where(F.col("issue_idx") == int(idx))
        if not backtest.unlike(saved, forecast(int(idx), int(idx)), ["series", "candidate"]).isEmpty():
            raise ValueError(f"the stored forecasts of issue {int(idx)} are not what the model makes today")
