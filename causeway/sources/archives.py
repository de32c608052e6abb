"""Bars from the members of zip archives, as a Python data source.

    read_zip_bars(spark, "prices.zip").where("ticker in ('A', 'B')")

The central directory of each archive is read once, on the driver, and its members are dealt to partitions by their size; a task
opens the archive, goes to its own members and reads nothing else. Filters on ticker are taken by the source, so other members
are never opened; the option columns names the value columns to parse. Several paths are parted by commas.

Members count as CSV files of the folder do for files.read_bars(): a header in the first line, columns by name, what cannot be
parsed is null, rows without a date go. A member that is no such table, or is damaged, is skipped, or raises with the option
mode set to failfast. Paths of other file systems are opened with pyarrow.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

VALUES = ("open", "high", "low", "close", "volume")
#: Bytes of members, as they lie in the archive, that a partition has at most (or one member).
PARTITION = 32 << 20
SCHEMA = "archive string, ticker string, session date, open double, high double, low double, close double, volume double, position long"


def read_zip_bars(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The bars of zip archives; the session lets Python sources take filters from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipBars)
    return spark.read.format("zip_bars").options(**options).load(path)


def _open(path: str):
    if re.match(r"[a-zA-Z][\w+.-]*://", path):
        system, inner = pa.fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path.removeprefix("file:"), "rb")


def ticker_of(member: str) -> str:
    return os.path.basename(member)[: -len(".csv")].upper()


@dataclass
class Members(InputPartition):
    archive: str
    names: tuple[str, ...]


class ZipBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipBarsReader:
        return ZipBarsReader(self.options)


class ZipBarsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.columns = tuple(c.strip().lower() for c in options.get("columns", ",".join(VALUES)).split(",") if c.strip())
        self.strict = options.get("mode", "dropmalformed").lower() == "failfast"
        if unknown := set(self.columns) - set(VALUES):
            raise ValueError(f"no columns of bars: {sorted(unknown)}")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("ticker",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, ticker: str) -> bool:
        for f in self.filters:
            found = ticker == f.value if isinstance(f, EqualTo) else ticker in f.value if isinstance(f, In) else ticker.startswith(f.value) if isinstance(f, StringStartsWith) else ticker.endswith(f.value)
            if not found:
                return False
        return True

    def partitions(self) -> Sequence[Members]:
        out: list[Members] = []
        for path in self.paths:
            with _open(path) as file, zipfile.ZipFile(file) as archive:
                infos = [i for i in archive.infolist() if i.filename.lower().endswith(".csv") and self._wanted(ticker_of(i.filename))]
            held, size = [], 0
            for info in sorted(infos, key=lambda i: i.header_offset):  # neighbours are read together
                if held and size + info.compress_size > PARTITION:
                    out.append(Members(path, tuple(held)))
                    held, size = [], 0
                held.append(info.filename)
                size += info.compress_size
            if held:
                out.append(Members(path, tuple(held)))
        return out

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Members):
            return
        with _open(partition.archive) as file, zipfile.ZipFile(file) as archive:
            for name in partition.names:
                try:
                    frame = self._frame(archive.read(name))
                except (zipfile.BadZipFile, zlib.error, EOFError, ValueError, NotImplementedError, RuntimeError) as error:
                    if self.strict:
                        raise ValueError(f"{partition.archive}: member {name}: {error}") from error
                    continue
                yield self._batch(frame, partition.archive, ticker_of(name))

    def _frame(self, data: bytes) -> pd.DataFrame:
        """The cells of the columns asked for, as strings; ValueError if there is no date or no close."""
        table = pd.read_csv(io.BytesIO(data), dtype=str, keep_default_na=False, skipinitialspace=True, encoding="utf-8-sig", usecols=lambda c: c.strip().lower() in ("date", "timestamp", "close", *self.columns))
        table.columns = [c.strip().lower() for c in table.columns]
        if "date" not in table.columns and "timestamp" not in table.columns or "close" not in table.columns:
            raise ValueError("no date or no close")
        return table

    def _batch(self, table: pd.DataFrame, archive: str, ticker: str) -> pa.RecordBatch:
        day = table["date" if "date" in table.columns else "timestamp"].fillna("").str.strip().str[:10].map(_day)
        known = day.notna().to_numpy()
        numbers = [pd.to_numeric(table[c], errors="coerce")[known] if c in table.columns and c in self.columns else pd.Series([None] * int(known.sum()), dtype="float64") for c in VALUES]
        n = int(known.sum())
        columns = [pa.repeat(archive, n), pa.repeat(ticker, n), pa.array(day[known].tolist(), pa.date32()), *(pa.array(x.to_numpy("float64"), from_pandas=True) for x in numbers), pa.array(known.nonzero()[0], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["archive", "ticker", "session", *VALUES, "position"])


def _day(text: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return None
