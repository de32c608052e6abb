"""Walk-forward forecasts: every issue session is fitted on the labels known at its close, all issues in parallel.

A panel has a row for each session of each series: series, idx (without gaps), session, close, ret and factors. Issues are
dealt into chunks of consecutive sessions; a session is copied to the few chunks whose windows, training rows or labels need
it (an explode of computed chunk numbers), so a task holds one chunk's rows, however many series there are, and nothing is
broadcast. All candidates are fitted where the rows are, and share windows and signatures.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import kernel
from causeway.operators.signature import batch
from causeway.plans.config import ForecastConfig

#: Issues of a chunk: with the usual training length, a session goes to seven chunks or eight.
CHUNK = 128
SCHEMA = "series string, candidate string, issue_idx long, issue_date date, target_date date, actual_return double, predicted_return double, screened_factor_count int, lasso_support_count int, selected_factors array<int>, effective_train_n double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def samples_of(close: np.ndarray, factors: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows ending at each session from number window - 1 on: (time, anchored log close) and factor paths."""
    log_close = np.lib.stride_tricks.sliding_window_view(np.log(close), window)
    time = np.broadcast_to(np.linspace(0, 1, window), log_close.shape)
    y = np.stack((time, log_close - log_close[:, :1]), axis=2).astype(np.float32).astype(np.float64)
    return y, np.lib.stride_tricks.sliding_window_view(factors, window, axis=0).transpose(0, 2, 1).astype(np.float64)


def forecasts(panel: DataFrame, candidates: Mapping[str, ForecastConfig], *, first: int, last: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Forecasts of every candidate for the issues numbered first to last (by idx, inclusive) of each series: those with a
    full window, at least 100 matured labels and a known target."""
    for config in candidates.values():
        config.check()
    back, ahead = reach(candidates)
    low = F.greatest(F.floor((F.col("idx") - ahead) / chunk), F.lit(first // chunk))
    high = F.floor((F.col("idx") + back) / chunk)
    high = F.least(high, F.lit(last // chunk)) if last is not None else high
    rows = panel.withColumn("chunk", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    configs = json.dumps({name: asdict(c) for name, c in candidates.items()})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        series, number = key
        found = {n: ForecastConfig(**c) for n, c in json.loads(configs).items()}
        end = (number + 1) * chunk if last is None else min((number + 1) * chunk, last + 1)
        return pd.DataFrame(fitted(series, pdf.sort_values("idx"), found, max(first, number * chunk), end), columns=COLUMNS)

    # The rows are few and the work on them is long, so their size says nothing about how many tasks are wanted.
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "series", "chunk").groupBy("series", "chunk").applyInPandas(run, SCHEMA)


def fitted(series: str, pdf: pd.DataFrame, candidates: Mapping[str, ForecastConfig], start: int, end: int) -> list[tuple]:
    """The rows of SCHEMA for the issues from start up to, not including, end, from sessions (idx, session, close, ret,
    factors) in order, which begin early enough for the training rows of start."""
    idx, close, ret = pdf["idx"].to_numpy(), pdf["close"].to_numpy(), pdf["ret"].to_numpy()
    if (np.diff(idx) != 1).any():
        raise ValueError(f"the sessions of series {series} are not numbered one after another")
    factors = np.array(pdf["factors"].to_list(), dtype=np.float32).astype(np.float64).reshape(len(pdf), -1)
    issued = (idx >= start) & (idx < end)
    windows, signatures, out = {}, {}, []
    for name, config in candidates.items():
        w, h = config.window, config.horizon
        if len(pdf) < w + h:
            continue
        if w not in windows:
            windows[w] = samples_of(close, factors, w)
        y_paths, x_paths = windows[w]
        if (w, config.signature_depth) not in signatures:
            signatures[w, config.signature_depth] = batch(y_paths, config.signature_depth).astype(np.float32).astype(np.float64)
        y_signature = signatures[w, config.signature_depth]
        label = np.log(close[h:]) - np.log(close[:-h])
        for at in np.flatnonzero(issued[: len(pdf) - h]):
            known = np.arange(max(w - 1, at - h - config.max_train + 1), at - h + 1)
            if at < w - 1 or len(known) < 100:
                continue
            rows = np.append(known, at)
            got = kernel.fit(factors[rows], ret[rows], label[known], y_signature[rows - w + 1], x_paths[rows - w + 1], y_paths[rows - w + 1], config)
            out.append((series, name, idx[at], pdf["session"].iloc[at], pdf["session"].iloc[at + h], label[at], got.predicted_return, len(got.chosen), len(got.support), got.chosen.tolist(), 1 / np.square(got.model.weight).sum()))
    return out


def reach(candidates: Mapping[str, ForecastConfig]) -> tuple[int, int]:
    """Sessions before an issue, and after it, that its forecast and its label need."""
    return max(c.horizon + c.max_train + c.window - 2 for c in candidates.values()), max(c.horizon for c in candidates.values())


def selection(predictions: DataFrame) -> DataFrame:
    """A row for each candidate, the one with the smallest mean absolute error first."""
    error = F.col("actual_return") - F.col("predicted_return")
    hit = (F.col("predicted_return") > 0) == (F.col("actual_return") > 0)
    return (
        predictions.groupBy("candidate")
        .agg(F.avg(F.abs(error)).alias("validation_return_mae"), F.avg(hit.cast("double")).alias("validation_direction_accuracy"), F.sqrt(F.avg(error * error)).alias("validation_return_rmse"), F.median("lasso_support_count").alias("median_lasso_support"), F.median("effective_train_n").alias("median_effective_train_n"))
        .orderBy("validation_return_mae", "candidate")
    )


def training_calendar(samples: DataFrame, frame) -> DataFrame:
    """For each issue: first and last training issue, their number, and the latest label in use."""
    return samples.withColumns({"training_issue_first": F.min("session").over(frame), "training_issue_last": F.max("session").over(frame), "latest_training_target": F.max("target_date").over(frame), "training_examples": F.count("*").over(frame)})
