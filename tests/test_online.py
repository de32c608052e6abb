"""The online model in a stream's state, against plain Python, over restarts, late, missing and repeated labels."""

import datetime as dt
import itertools
import json

import numpy as np
import pytest

from causeway.streaming import online

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
KIND = "series string, idx long, event_ts timestamp, features array<double>, label int"
LEARNER = online.Logistic(2, rate=0.1, updates=2)
WAIT = 3


def event(series, idx, hour, x=None, label=None):
    return {"series": series, "idx": idx, "event_ts": (START + dt.timedelta(hours=hour)).isoformat(), "features": x, "label": label}


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(9)
    rows = []
    for series in ("a", "b"):
        for i in range(24):
            x = rng.normal(size=2).tolist()
            rows.append(event(series, i, i, x))
            if i % 7 == 3:
                continue  # never revealed
            delay = 5 if i % 7 == 5 else 1
            rows.append(event(series, i, i + delay, None, int(x[0] > 0)))
            if i % 6 == 0:
                rows.append(event(series, i, i + delay + 1, None, 1))  # the label again
        rows += [event(series, 3, 20.5, [0.0, 0.0]), event(series, 20, 20.6, [1.0]), event(series, 21, 20.7)]
    rows.append(event("a", 99, 200, [0.0, 0.0]))
    rows.append(event("b", 99, 200, [0.0, 0.0]))
    return sorted(rows, key=lambda r: r["event_ts"])


def expected(events, models=None):
    out = []
    for series in ("a", "b"):
        params, mean, sd = (models or {}).get(series, ([0.0] * 3, [0.0] * 2, [1.0] * 2))
        pending, last, learned = {}, -1, 0
        own = [e for e in events if e["series"] == series]
        for e in sorted(own, key=lambda e: (e["event_ts"], e["features"] is not None, e["idx"])):
            at = (dt.datetime.fromisoformat(e["event_ts"]) - START).total_seconds() / 3600
            idx, x, y = e["idx"], e["features"], e["label"]
            if y is None and (x is None or len(x) != 2):
                out.append((series, idx, "ignored", None, None))
            elif x is not None and idx <= last:
                out.append((series, idx, "repeated", None, None))
            elif x is not None:
                z = np.clip((np.array(x) - mean) / sd, -8, 8)
                p = 1 / (1 + np.exp(-(np.dot(params[:2], z) + params[2])))
                pending[idx], last = (z, p, at + WAIT), idx
                out.append((series, idx, "forecast", round(float(p), 9), None))
            elif idx not in pending:
                out.append((series, idx, "late", None, y))
            else:
                z, p, until = pending.pop(idx)
                if at > until:
                    out += [(series, idx, "expired", round(float(p), 9), None), (series, idx, "late", None, y)]
                    continue
                out.append((series, idx, "score", round(float(p), 9), y))
                learned += 1
                for _ in range(2):
                    q = 1 / (1 + np.exp(-(np.dot(params[:2], z) + params[2])))
                    params = [*(np.array(params[:2]) + 0.1 * (y - q) * z), params[2] + 0.1 * (y - q)]
        out += [(series, idx, "expired", round(float(p), 9), None) for idx, (_, p, until) in pending.items() if until < 200]
    return sorted(out, key=str)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, online.ROCKSDB)
    yield
    spark.conf.set(key, before)


def run(spark, folder, learner=LEARNER, models=None):
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    found = online.online(stream, learner, wait=f"{WAIT} hours", models=models)
    found.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start().awaitTermination()


def put(folder, name, rows):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def got(spark, folder):
    rows = spark.read.parquet(str(folder / "out")).collect()
    return sorted(((r.series, r.idx, r.kind, None if r.probability is None else round(r.probability, 9), r.label) for r in rows), key=str)


def test_stream_with_restarts_equals_one_batch(spark, rocksdb, events, tmp_path):
    want = expected(events)
    assert {r[2] for r in want} == {"forecast", "score", "expired", "late", "repeated", "ignored"}
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    whole.mkdir(), parts.mkdir()
    put(whole, "all", events)
    run(spark, whole)
    assert got(spark, whole) == want
    edge = lambda at: next(i for i in range(at, len(events)) if events[i]["event_ts"] != events[i - 1]["event_ts"])
    cuts = [0, edge(9), edge(40), edge(edge(40) + 1), len(events)]
    for k, (i, j) in enumerate(itertools.pairwise(cuts)):
        put(parts, f"{k}", events[i:j])
        if k != 1:  # the second and third part come in one run of two batches
            run(spark, parts)
    assert got(spark, parts) == want
    # What the state holds can be read; a learner of another version is refused.
    model = {r.key.series: r.value for r in spark.read.format("statestore").option("stateVarName", "model").load(str(parts / "check")).collect()}
    assert {s: (m.version, m.learned, m.last) for s, m in model.items()} == {s: (1, sum(r[0] == s and r[2] == "score" for r in want), 99) for s in ("a", "b")}
    put(parts, "more", [event("a", 100, 201, [0.0, 0.0])])
    with pytest.raises(Exception, match="version 1, the learner 2"):
        run(spark, parts, online.Logistic(2, version=2))


def test_models_to_start_from(spark, rocksdb, events, tmp_path):
    models = {"a": ([0.5, -1.0, 0.1], [0.2, 0.0], [2.0, 0.5]), "b": ([0.0, 0.0, 1.0], [0.0, 0.0], [1.0, 1.0])}
    kind = "series string, version int, params array<double>, mean array<double>, sd array<double>"
    first = lambda version: spark.createDataFrame([(s, version, *m) for s, m in models.items()], kind).groupBy("series")
    put(tmp_path, "all", events)
    run(spark, tmp_path, models=first(1))
    assert got(spark, tmp_path) == expected(events, models)
    other = tmp_path / "other"
    other.mkdir()
    put(other, "all", events)
    with pytest.raises(Exception, match="version 0, the learner 1"):
        run(spark, other, models=first(0))


def test_needs_rocksdb(spark, tmp_path):
    with pytest.raises(ValueError, match="providerClass"):
        online.online(spark.readStream.schema(KIND).json(str(tmp_path)), LEARNER)
