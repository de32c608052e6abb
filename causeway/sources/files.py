"""Readers of bar, filing, news, image and prediction files, and the writers of results."""

from __future__ import annotations

import atexit
import hashlib
import io
import json
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import facts

BAR_SCHEMA = "date string, open string, high string, low string, close string, volume string"
FILING_SCHEMA = "filings array<struct<filing_date: string, facts: struct<`us-gaap`: map<string, struct<units: map<string, array<struct<`end`: string, filed: string, val: double>>>>>>>>"
PREDICTION_SCHEMA = "issue_date date, target_date date, actual_return double, predicted_return double, screened_factor_count int, lasso_support_count int, selected_factors string, effective_train_n double"
# Side of the small images, and days that an image counts as recent.
IMAGE_SIDE, RECENT_DAYS = 12, 210


def _stem(path: str = "_metadata.file_path") -> Column:
    return F.regexp_extract(F.col(path), r"([^/]+)\.[^./]+$", 1)


#: A cell of a line after a comma: quoted, with doubled quotes inside, or up to the next comma.
CELL = r',[ \t]*("(?:[^"]++|"")*+"[^,]*|[^,]*)'


def csv_cells(line: Column) -> Column:
    """The cells of a line of CSV without their quotes; commas and doubled quotes inside quotes are part of the cell."""
    plain = lambda x: F.when(x.startswith('"'), F.replace(F.regexp_extract(x, '^"((?:[^"]++|"")*+)"', 1), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), F.btrim(line, F.lit("\ufeff\r"))), F.lit(CELL), F.lit(1)), lambda x: F.trim(plain(F.trim(x))))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """ticker (the file's stem), session, prices and position (order in the file) of CSV files with a header; columns are
    found by name and what cannot be parsed is null. Files without a date or a close column give no rows.

    All files are one scan, whatever their headers: a line's cells are looked up by the places that its own file's header
    gives. A header is the first line of its file that is not blank; headers, a row for each file, are found in a second scan.
    Cells can be quoted and hold commas, but no line breaks.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).where(F.btrim("value", F.lit("\ufeff\r\t ")) != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("position"))
    names = F.transform(csv_cells(F.col("value")), lambda x: F.lower(x))
    headers = lines.where("block = 0").groupBy("file").agg(F.min_by(names, "position").alias("names"), F.min("position").alias("header"))
    place = lambda *options: F.coalesce(*(F.nullif(F.array_position("names", o), F.lit(0)) for o in options))
    headers = headers.select("file", "header", place("date", "timestamp").alias("date"), *(place(c).alias(c) for c in ("open", "high", "low", "close", "volume"))).where("date is not null and close is not null")
    rows = lines.withColumn("cells", csv_cells(F.col("value"))).join(headers, "file").where("position <> header")
    cell = lambda c: F.get("cells", (F.col(c) - 1).cast("int"))
    out = rows.select(_stem("file").alias("ticker"), F.substring(cell("date"), 1, 10).try_cast("date").alias("session"), *(cell(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")), "position")
    return out.where("session is not null")


def check_bars(bars: DataFrame, least: int = 150) -> None:
    """Raise unless every ticker has positive prices, unique sessions and at least ``least`` of them."""
    row = bars.agg(F.count_if(~(F.col("close") > 0) | ~(F.col("open") > 0) | F.col("close").isNull() | F.col("open").isNull()).alias("bad"), F.count("*").alias("n"), F.count_distinct("ticker", "session").alias("days"), F.count_distinct("session").alias("sessions")).first()
    if row["bad"] or row["n"] != row["days"] or row["sessions"] < least:
        raise ValueError("prices must be positive, sessions unique and numerous enough")


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILING_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select(_stem().alias("symbol"), "filings")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """symbol, event_date and text of JSON lines; lines that are no JSON object or have no date go. An article that is missing
    is empty, one that is null is the text None, and one that is no text its JSON."""
    rows = spark.read.text(path).select(_stem().alias("symbol"), F.try_parse_json("value").alias("v"))
    part = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    article = F.when(F.is_variant_null(part("Article", "variant")), "None").otherwise(F.coalesce(part("Article", "string"), F.lit("")))
    day = F.substring(part("Date", "string"), 1, 10).try_cast("date")
    return rows.select("symbol", day.alias("event_date"), article.alias("text")).where("event_date is not null")


def read_images(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """symbol, event_date (the end of the half year in the file's name) and vector (432 colour values) of chart images;
    files that cannot be decoded are left out.

    decode turns a file's bytes into a (rows, columns, 3) array of 0 to 255. By default Pillow does, where it is installed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_candlestick.png").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    part = lambda k: F.regexp_extract(name, r"^(.*)_(\d{4})_H([12])_candlestick\.png$", k)
    rows = files.where(part(3) != "").select(part(1).alias("symbol"), F.when(part(3) == "1", F.make_date(part(2).cast("int"), F.lit(6), F.lit(30))).otherwise(F.make_date(part(2).cast("int"), F.lit(12), F.lit(31))).alias("event_date"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = decode or _pillow
        for pdf in batches:
            pdf["vector"] = [_seen(read, x) for x in pdf["content"]]
            yield pdf.drop(columns="content")

    return rows.mapInPandas(run, "symbol string, event_date date, vector array<float>").where("vector is not null")


def _seen(read: Callable[[bytes], np.ndarray], data: bytes) -> np.ndarray | None:
    """The thumbnail, or None for a file that is no image."""
    try:
        return thumbnail(read(data))
    except (OSError, ValueError):
        return None


def image_panel(images: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for each session: the mean of the symbols' last known charts (null where there are none), and the share of
    symbols that have one. A chart counts from the session after its half year; those that ended more than RECENT_DAYS
    before the first session do not count at all."""
    first = calendar.agg(F.date_sub(F.min("session"), RECENT_DAYS).alias("from_"))
    recent = images.crossJoin(F.broadcast(first)).where("event_date >= from_")
    vectors = recent.select("symbol", "event_date", F.col("event_date").alias("pos"), "vector")
    return facts.panel(vectors, calendar, images.select("symbol"))


def _pillow(data: bytes) -> np.ndarray:
    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def thumbnail(image: np.ndarray) -> np.ndarray:
    """The middle of an image (10-90 % across, 17-90 % down) as 12 x 12 mean colours between 0 and 1."""
    h, w = image.shape[:2]
    part = image[round(0.17 * h) : round(0.9 * h), round(0.1 * w) : round(0.9 * w)].astype(np.float64)
    cells = [np.array_split(band, IMAGE_SIDE, axis=1) for band in np.array_split(part, IMAGE_SIDE, axis=0)]
    return (np.array([[c.reshape(-1, 3).mean(axis=0) for c in row] for row in cells]) / 255).astype(np.float32).ravel()


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).option("header", True).csv(path).withColumn("selected_factors", F.split("selected_factors", ";"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV of a small result; arrays become texts joined by semicolons."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A JSON document as a one-row text table; numbers that JSON does not know are refused."""
    text = json.dumps(value, indent=2, allow_nan=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_run(spark: SparkSession, folder: str, tables: dict[str, DataFrame], info: dict) -> None:
    """A run's results: each table as CSV in the folder of its name, and what is known about the run (settings, input
    hashes, headline figures) as run_info."""
    for name, table in tables.items():
        write_csv(table, f"{folder}/{name}")
    write_json(spark, info, f"{folder}/run_info")


def prepared(spark: SparkSession, path: str, key: dict, calendar: Callable[[], DataFrame], parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """A table with a row for each session (idx, session) and, as structs, what each part has for it; built anew if the key
    has changed. Parts have a row for each idx at most."""

    def build() -> DataFrame:
        out = calendar()
        for name, part in parts.items():
            rows = part()
            out = out.join(rows.select("idx", F.struct(*(c for c in rows.columns if c not in {"idx", "session"})).alias(name)), "idx", "left")
        return out

    return cached(spark, path, key | {"parts": sorted(parts)}, build)


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir; on one machine (tests), where it is not set, a
    temporary one that ends with the process. A cluster without the setting is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="causeway-")
            atexit.register(shutil.rmtree, _own[app], True)
        path = _own[app]
    return path.rstrip("/")


def tree_hash(spark: SparkSession, paths: str | Sequence[str]) -> str:
    """One digest of all files below paths, by their names and bytes: files are digested where they are read, and their
    digests in the order of their names. It is the same whatever the number of tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else list(paths))
    digests = files.select("path", F.sha2("content", 256).alias("digest"))
    lines = digests.select(F.concat_ws(" ", "digest", "path").alias("line"), F.substring("digest", 1, 2).alias("group"))
    groups = lines.groupBy("group").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))  # 256 at most
    return groups.agg(F.sha2(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat("group", "digest"))), "\n"), F.lit("")), 256)).first()[0]


@contextmanager
def unchanged(spark: SparkSession, paths: str | Sequence[str]) -> Iterator[str]:
    """The digest of the inputs of a run; ValueError at its end if they are not the same any more."""
    before = tree_hash(spark, paths)
    yield before
    if tree_hash(spark, paths) != before:
        raise ValueError("the inputs changed while the run read them")


def file_hash(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def cached(spark: SparkSession, path: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A Parquet table that is built anew only if its key (sizes and times of inputs, settings) has changed. The key is
    kept beside it as a one-row table, so any store that Spark writes to will do."""
    text = json.dumps(key, sort_keys=True)
    try:
        same = spark.read.text(f"{path}/key").first()[0] == text
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        same = False
    if not same:
        build().write.mode("overwrite").parquet(f"{path}/table")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/key")
    return spark.read.parquet(f"{path}/table")


def input_key(paths: Sequence[str | Path]) -> dict:
    return {str(p): [Path(p).stat().st_size, Path(p).stat().st_mtime_ns] for p in paths}
