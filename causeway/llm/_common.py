"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into numpy arrays at a time.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, the warehouse on a cluster, and on one machine (tests) a
    temporary folder that ends with the process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        path = spark.conf.get("spark.sql.warehouse.dir")
    if path is None:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="causeway-")
            atexit.register(shutil.rmtree, _own[app], True)
        path = _own[app]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_dir(spark)}/causeway/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def met(rows: DataFrame, groups: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows joined with groups, which has a row for each value of the columns on (without nulls) and how many rows have it.
    Both are tables. Values with a thousandth of these rows or more are at most a thousand; they are broadcast, so that no
    value, however frequent, lands in one task."""
    least = (groups.agg(F.sum(count)).first()[0] or 0) / 1000
    frequent = F.broadcast(groups.where(F.col(count) >= least))
    rest = rows.join(F.broadcast(groups.where(F.col(count) >= least).select(*on)), on, "left_anti")
    return rows.join(frequent, on).unionByName(rest.join(groups.where(F.col(count) < least), on))


def clear(spark: SparkSession) -> None:
    """Delete the tables and archives written so far; results that still read them can't be computed any more."""
    while _paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores, such that no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
