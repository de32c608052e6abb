"""Replay of sessions as a stream: forecasts for new issues, labels that mature later, and online learning per series."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causeway.operators import walkforward
from causeway.plans.config import ForecastConfig

RATE = 0.05
ONLINE_OUT = "series string, idx long, probability double, label int"


def forecast_stream(sessions: DataFrame, panel: Callable[[], DataFrame], candidates: Mapping[str, ForecastConfig], path: str, checkpoint: str) -> StreamingQuery:
    """For each batch of new panel sessions (series, idx, ...), forecast the issues that their closes made complete.

    panel() gives all sessions stored so far, the batch's included. A batch that is run again writes its own folder again,
    so a restart neither repeats nor loses a forecast.
    """

    def step(batch: DataFrame, number: int) -> None:
        span = batch.agg(F.min("idx").alias("low"), F.max("idx").alias("high")).first()
        if span["low"] is None:
            return
        late = max(c.horizon for c in candidates.values())
        found = walkforward.forecasts(panel(), candidates, first=max(0, span["low"] - late), last=span["high"] - late)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sessions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matured_labels(forecasts: DataFrame, labels: DataFrame, *, wait: str = "30 days") -> DataFrame:
    """Stream-stream join of forecasts (issue_ts, target_ts, ...) with labels (label_ts, label): a forecast is held until
    its label comes, and dropped when the watermark has passed the waiting time."""
    left = forecasts.withWatermark("issue_ts", wait)
    right = labels.withWatermark("label_ts", wait)
    return left.join(right, F.expr(f"series = label_series AND label_ts = target_ts AND label_ts >= issue_ts AND label_ts <= issue_ts + INTERVAL {wait}"))


def _learned(weights: np.ndarray, x: np.ndarray, label: float) -> tuple[float, np.ndarray]:
    """The probability of a label of 1, and the weights after it is known."""
    x = np.append(np.asarray(x, dtype=float), 1.0)
    p = float(1 / (1 + np.exp(-np.clip(weights @ x, -30, 30))))
    return p, weights + RATE * (label - p) * x


def prequential(examples: DataFrame, features: int, *, share: float = 0.8, passes: int = 5) -> DataFrame:
    """series, idx, split, probability and label of (series, idx, features, label), each series in its own time: the first
    share of its examples are learned from, several times over, and scored by what that gave; each later one is scored by a
    model that has learned from all before it, and then learned from."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        rows = list(zip(pdf["idx"], pdf["features"], pdf["label"], strict=True))
        cut, weights = int(len(rows) * share), np.zeros(features + 1)
        for _ in range(passes):
            for _, x, label in rows[:cut]:
                weights = _learned(weights, x, label)[1]
        out = [(key[0], idx, "train", _learned(weights, x, label)[0], label) for idx, x, label in rows[:cut]]
        for idx, x, label in rows[cut:]:
            p, weights = _learned(weights, x, label)
            out.append((key[0], idx, "test", p, label))
        return pd.DataFrame(out, columns=["series", "idx", "split", "probability", "label"])

    return examples.groupBy("series").applyInPandas(run, "series string, idx long, split string, probability double, label int")


def online_scores(examples: DataFrame, features: int) -> DataFrame:
    """Prequential logistic regression on a stream of (series, idx, features, label): each example is scored first, then
    learned from. The weights of a series are its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weights = np.array(json.loads(state.get[0])) if state.exists else np.zeros(features + 1)
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, x, label in zip(rows["idx"], rows["features"], rows["label"], strict=True):
            p, weights = _learned(weights, x, label)
            out.append((key[0], idx, p, label))
        state.update((json.dumps(weights.tolist()),))
        yield pd.DataFrame(out, columns=["series", "idx", "probability", "label"])

    return examples.groupBy("series").applyInPandasWithState(step, ONLINE_OUT, "weights string", "append", GroupStateTimeout.NoTimeout)
