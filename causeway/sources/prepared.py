"""A prepared table of sessions that is kept, and brought up to date part by part.

Sessions are dealt to parts of neighbouring ones. A manifest says what the inputs of each part were; if an input has other rows
than then, the parts that these rows reach are made again and replace the old ones, and all others stay untouched.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.calibration import place

#: Sessions of a part, and the layout of manifests and rows, which gives tables of another one a folder of their own.
PART, LAYOUT = 64, 2


def _digests(inputs: dict[str, tuple[DataFrame, int | None]], part: int) -> dict[int, dict[str, list]]:
    """Number and checksum of the rows of each input and part, whatever their order: a row for each of them."""
    out: dict[int, dict[str, list]] = {}
    for name, (rows, _) in inputs.items():
        checksum = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))
        found = rows.where("idx is not null").groupBy(F.floor(F.col("idx") / part).alias("part")).agg(F.count("*").alias("n"), checksum.alias("sum"))
        for r in found.collect():
            out.setdefault(r["part"], {})[name] = [r["n"], str(r["sum"])]
    return out


def _manifest(spark: SparkSession, at: str) -> tuple[dict[int, dict[str, list]], set[int]]:
    """What the inputs of each part were, and the parts whose rows are those of these inputs."""
    try:
        rows = [json.loads(r["value"]) for r in spark.read.text(f"{at}/manifest").collect()]  # a row for each part
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    return {m["part"]: m["inputs"] for m in rows}, {m["part"] for m in rows if m["made"]}


def _publish(spark: SparkSession, at: str, manifest: dict[int, dict[str, list]], made: set[int]) -> None:
    lines = [(json.dumps({"part": p, "made": p in made, "inputs": inputs}),) for p, inputs in sorted(manifest.items())]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")


def _reached(old: dict[int, dict[str, list]], new: dict[int, dict[str, list]], inputs: dict[str, tuple[DataFrame, int | None]], part: int) -> set[int]:
    """Parts that a changed part of an input has a say in: its own, and those of the next reach sessions."""
    out: set[int] = set()
    for name, (_, reach) in inputs.items():
        for p in old.keys() | new.keys():
            if old.get(p, {}).get(name) != new.get(p, {}).get(name):
                last = max(new, default=p) if reach is None else ((p + 1) * part - 1 + reach) // part
                out.update(range(p, last + 1))
    return out


def runs(numbers: Iterable[int]) -> list[tuple[int, int]]:
    """Neighbouring numbers as (first, last)."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def refreshed(spark: SparkSession, folder: str, settings: dict, inputs: dict[str, tuple[DataFrame, int | None]], build: Callable[[int, int], DataFrame], schema: str, *, part: int = PART) -> DataFrame:
    """The prepared rows (of this schema, with the column idx) of all parts that have inputs.

    inputs: rows with the column idx of a session, and on how many later sessions they have a say (0: none, None: on all of
    them, as values that are carried have). build(first, last) makes the rows of the sessions from first to last; as its code is no
    input, settings should name its version. Settings and
    schema give the table a folder of its own. Parts that are to be made again are marked in the manifest before their rows are
    replaced, and it names the new inputs only when all are there, so a run that ends in between leaves nothing stale: the next one
    makes the marked parts, whatever the inputs are then.
    """
    at = place(folder, settings | {"part": part, "schema": schema, "layout": LAYOUT})
    (old, made), new = _manifest(spark, at), _digests(inputs, part)
    dirty = (_reached(old, new, inputs, part) | (new.keys() - made)) & new.keys()
    if dirty or old.keys() - new.keys():
        _publish(spark, at, old, made & new.keys() - dirty)
        for first, last in runs(dirty):
            rows = build(first * part, (last + 1) * part - 1).where(F.col("idx").between(first * part, (last + 1) * part - 1))
            rows = rows.withColumn("part", F.floor(F.col("idx") / part).cast("int"))
            # Parts are few rows each: one task writes a part as one file.
            rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{at}/rows")
        _publish(spark, at, new, set(new))
    if not new:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, part int").parquet(f"{at}/rows").where(F.col("part").isin(sorted(new))).drop("part")
