"""What SQL can call: register(spark) makes hash_text, hash_text_md5, signature and the table function walk_forward known.

    SELECT * FROM walk_forward(TABLE(panel) PARTITION BY series ORDER BY idx, candidates => '{"a": {"signature_depth": 2}}')
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from causeway.functions import text
from causeway.operators import walkforward
from causeway.operators.signature import of_arrays
from causeway.plans.config import ForecastConfig

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(), "array<int>": T.ArrayType(T.IntegerType())}
#: Of walkforward.SCHEMA; a worker that analyses a call has no session to parse it.
RESULT = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in walkforward.SCHEMA.split(", "))])
PANEL = ("series", "idx", "session", "close", "ret", "factors")


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def signature(paths: pa.Array, depth: pa.Array) -> pa.Array:
    """signature(path, depth): the signature of an array of points; null where either is null or the path is none."""
    out: list = [None] * len(paths)
    for d in depth.drop_null().unique().to_pylist():
        rows = pc.indices_nonzero(pc.equal(depth, d))
        for i, found in zip(rows.to_pylist(), of_arrays(paths.take(rows), d), strict=True):
            out[i] = found
    return pa.array(out, pa.list_(pa.float64()))


@dataclass
class Asked(AnalyzeResult):
    """What a call asks for, checked when it is analysed."""

    configs: str = "{}"
    first: int = 0
    last: int | None = None


@dataclass
class _Sessions:
    """The sessions of a series that issues to come still need."""

    series: str
    rows: list[tuple] = field(default_factory=list)
    start: int = 0


class WalkForward:
    """Forecasts of every candidate for every issue of a panel, a partition being a series in the order of idx.

    Sessions are held only as long as an issue can need them, so memory does not grow with the series; issues are fitted
    in chunks as soon as their labels are there. Rows of other series in a partition, and gaps or repetitions of idx, raise.
    """

    def __init__(self, asked: Asked) -> None:
        self.first, self.last = asked.first, asked.last
        self.candidates = {n: ForecastConfig(**c) for n, c in json.loads(asked.configs).items()}
        self.back, self.ahead = walkforward.reach(self.candidates)
        self.held: _Sessions | None = None

    @staticmethod
    def analyze(panel: AnalyzeArgument, candidates: AnalyzeArgument, first: AnalyzeArgument | None = None, last: AnalyzeArgument | None = None) -> Asked:
        if not panel.isTable:
            raise ValueError("walk_forward takes TABLE(panel) PARTITION BY series ORDER BY idx")
        missing = [c for c in PANEL if c not in panel.dataType.names]
        if missing:
            raise ValueError(f"the panel has no column {', '.join(missing)}")
        if not candidates.isConstantExpression or not candidates.value:
            raise ValueError("candidates is a constant JSON object of settings by name")
        configs = json.loads(candidates.value)
        for config in configs.values():
            ForecastConfig(**config).check()
        if not configs:
            raise ValueError("there is no candidate")
        return Asked(RESULT, configs=json.dumps(configs), first=first.value if first and first.value is not None else 0, last=last.value if last else None)

    def eval(self, panel: Row, candidates: str, first: int | None = None, last: int | None = None) -> Iterator[tuple]:
        row = tuple(panel[c] for c in PANEL)
        if self.held is None:
            self.held = _Sessions(row[0], start=max(self.first, row[1]))
        if row[0] != self.held.series:
            raise ValueError("a partition has sessions of several series; walk_forward needs PARTITION BY series")
        if self.held.rows and row[1] != self.held.rows[-1][1] + 1:
            raise ValueError(f"the sessions of series {row[0]} are not numbered one after another; walk_forward needs ORDER BY idx")
        self.held.rows.append(row)
        if row[1] - self.ahead - self.held.start >= walkforward.CHUNK:
            yield from self._issued(row[1] - self.ahead)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield from self._issued(self.held.rows[-1][1] + 1)
            self.held = None

    def _issued(self, end: int) -> Iterator[tuple]:
        """The forecasts of the issues before end that have not been given."""
        held = self.held
        stop = end if self.last is None else min(end, self.last + 1)
        if held.start < stop:
            pdf = pd.DataFrame([r[1:] for r in held.rows], columns=PANEL[1:])
            for r in walkforward.fitted(held.series, pdf, self.candidates, held.start, stop):
                yield (*r[:2], int(r[2]), *r[3:5], float(r[5]), float(r[6]), *r[7:10], float(r[10]))
        held.start = max(held.start, end)
        gone = held.start - self.back - held.rows[0][1]
        if gone > 0:
            del held.rows[:gone]


_SUMS = f"transform(sequence(1L, {text.BUCKETS}L), k -> CAST(size(array_remove(found, -k)) - size(array_remove(found, k)) AS DOUBLE))"
#: Functions with a body in SQL. Arrays of one element name what is used more than once, so that it is computed once.
BODIES = {
    "text_tokens(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(substring(lower(coalesce(t, '')), 1, {text.CHARS}), '{text.TOKEN}', 0)",
    "hash_text_md5(t STRING) RETURNS ARRAY<DOUBLE>": f"""get(transform(transform(transform(array(
        transform(transform(text_tokens(t), w -> CAST(conv(substring(md5(w), 1, 8), 16, 10) AS BIGINT)), h -> (h % {text.BUCKETS} + 1) * if(h >= 2147483648, 1, -1))), found -> {_SUMS}),
        sums -> named_struct('sums', sums, 'norm', greatest(sqrt(aggregate(sums, 0D, (a, x) -> a + x * x)), 1D))), s -> transform(s.sums, x -> x / s.norm)), 0)""",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, for as long as it lasts."""
    spark.udf.register("signature", signature)
    spark.udf.register("hash_text", text.hash_whole)
    spark.udtf.register("walk_forward", F.udtf(WalkForward))
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
