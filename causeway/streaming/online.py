"""A model for each series that lives in the state of a stream: it forecasts when an issue comes, and learns when its label does.

Events are rows of series, idx (of the issue), event_ts, features (of an issue) and label (of an issue before). What comes out
is a row for everything that happens, at once:

    forecast  an issue and its probability            score     the label of an issue, with the probability it was given
    expired   an issue without a label in time        late      a label after its issue had expired, or of none that is known
    repeated  an issue that is not after the last one ignored   neither features of the right number nor a label

The state of a series is its model (parameters, normaliser, version, number of labels learned, last issue) and the issues
whose labels are not known. It can be read with the state data source while the stream stands still. Events of a batch are
taken in the order of time, labels before issues of the same time, so if batches follow each other in time (no event is
as early as the batch before, or delay covers it), no result depends on where one ends or on restarts. A model of another version than the learner's is refused, in the state and in what it starts from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODEL = "version int, params array<double>, mean array<double>, sd array<double>, learned long, last long"
PENDING = "features array<double>, probability double, deadline long"
OUT = "series string, idx long, kind string, at long, probability double, label int, learned long"
#: Normalised features lie within this.
CLIP = 8.0


@dataclass(frozen=True)
class Logistic:
    """Logistic regression by gradient steps. Another learner has the same fields version and features, and the same methods
    on a list of parameters."""

    features: int
    rate: float = 0.05
    updates: int = 1
    version: int = 1

    def start(self) -> list[float]:
        return [0.0] * (self.features + 1)

    def predict(self, params: list[float], x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(np.dot(params[:-1], x)) + params[-1]))))

    def learn(self, params: list[float], x: np.ndarray, label: int) -> list[float]:
        for _ in range(self.updates):
            step = self.rate * (label - self.predict(params, x))
            params = [*(np.asarray(params[:-1]) + step * x).tolist(), params[-1] + step]
        return params


class Online(StatefulProcessor):
    """See the module; wait: milliseconds from an issue to the expiry of its label."""

    def __init__(self, learner: Logistic, wait: int) -> None:
        self.learner, self.wait = learner, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", MODEL)
        self.pending = handle.getMapState("pending", "idx long", PENDING)

    def _checked(self, version: int) -> None:
        if version != self.learner.version:
            raise ValueError(f"the model of the state has version {version}, the learner {self.learner.version}")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        row = initialState.iloc[0]
        self._checked(int(row["version"]))
        vectors = [[float(x) for x in row[c]] for c in ("params", "mean", "sd")]
        if len(initialState) > 1 or [len(v) for v in vectors[1:]] != [self.learner.features] * 2 or len(vectors[0]) != len(self.learner.start()):
            raise ValueError(f"series {key[0]} needs one model to start from, of {self.learner.features} features")
        self.model.update((int(row["version"]), *vectors, 0, -1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n = self.learner.features
        if self.model.exists():
            version, params, mean, sd, learned, last = self.model.get()
            self._checked(version)
        else:
            version, params, mean, sd, learned, last = self.learner.version, self.learner.start(), [0.0] * n, [1.0] * n, 0, -1
        mean, sd = np.asarray(mean), np.asarray(sd)
        out: list[tuple] = []
        events = []
        for pdf in rows:
            for idx, at, x, label in zip(pdf["idx"], pdf["at"], pdf["features"], pdf["label"], strict=True):
                known = label is not None and not pd.isna(label)
                if known:
                    events.append((at, 0, idx, int(label)))
                x = None if x is None else np.asarray(x, dtype=float)
                if x is not None and x.shape == (n,) and np.isfinite(x).all():
                    events.append((at, 1, idx, x))
                elif x is not None or not known:
                    out.append((idx, "ignored", at, None, None, learned))
        for at, issue, idx, what in sorted(events, key=lambda e: e[:3]):
            if issue and idx <= last:
                out.append((idx, "repeated", at, None, None, learned))
            elif issue:
                z = np.clip((what - mean) / sd, -CLIP, CLIP)
                p, last = self.learner.predict(params, z), idx
                self.pending.updateValue((int(idx),), (z.tolist(), p, int(at) + self.wait))
                self.handle.registerTimer(int(at) + self.wait)
                out.append((idx, "forecast", at, p, None, learned))
            elif not self.pending.containsKey((int(idx),)):
                out.append((idx, "late", at, None, what, learned))
            else:
                z, p, deadline = self.pending.getValue((int(idx),))
                self.pending.removeKey((int(idx),))
                if at > deadline:  # whether or not its timer has fired
                    out += [(idx, "expired", deadline, p, None, learned), (idx, "late", at, None, what, learned)]
                else:
                    params, learned = self.learner.learn(params, np.asarray(z), what), learned + 1
                    out.append((idx, "score", at, p, what, learned))
        self.model.update((version, [float(x) for x in params], mean.tolist(), sd.tolist(), int(learned), int(last)))
        yield _rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, learned = expiredTimerInfo.getExpiryTimeInMs(), self.model.get()[4]
        over = [(k[0], v) for k, v in self.pending.iterator() if v[2] <= now]
        for idx, _ in over:
            self.pending.removeKey((idx,))
        yield _rows(key, [(idx, "expired", deadline, p, None, learned) for idx, (_, p, deadline) in sorted(over)])

    def close(self) -> None:
        pass


def _rows(key: tuple, out: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in OUT.split(", ")]
    frame = pd.DataFrame([(key[0], *r) for r in out], columns=columns)
    return frame.astype({"idx": "int64", "at": "int64", "probability": "float64", "label": "Int32", "learned": "int64"})


def online(events: DataFrame, learner: Logistic, *, wait: str = "5 days", delay: str = "0 seconds", models: GroupedData | None = None) -> DataFrame:
    """What happens (OUT, with the time event_ts in place of at) to the events, a stream. delay: how late events may come.
    models: rows of series, version, params, mean and sd to start from, grouped by series.

    The state store has to be RocksDB: spark.sql.streaming.stateStore.providerClass.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    length = pd.Timedelta(wait) // pd.Timedelta(1, "ms")
    rows = events.withWatermark("event_ts", delay).select("series", "idx", "event_ts", F.unix_millis("event_ts").alias("at"), "features", "label")
    found = rows.groupBy("series").transformWithStateInPandas(Online(learner, length), OUT, "Append", "EventTime", initialState=models)
    return found.select("series", "idx", "kind", F.timestamp_millis("at").alias("event_ts"), "probability", "label", "learned")
