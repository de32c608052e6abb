"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped and probed by binary search.

A rule is a host, a path prefix and a verdict. It fits its host and all subdomains if the url's path starts with the
rule's; of several that fit, the one with the longest host and path wins (with equal lengths, the one with the longer
host). Urls that no rule fits get the default verdict.

The digests of all rules lie in one sorted array. A task probes it, for all its urls at once, with the digests of every
host suffix joined to every path prefix of a length that some rule has, and a hit counts only if the stored rule equals
the probed string, so colliding digests do no harm. The array is sent to the executors only up to MAX_BYTES; longer
lists of rules are joined as a table by the probed strings.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default verdict; repeated
rows are judged one by one; an empty table gives an empty result; without rules, every url gets the default verdict.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm._common import free_name, met, written

MAX_BYTES = 64 << 20
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query op10_url_filters.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url as SQL expressions."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


class DigestArray:
    """Rules as a sorted array of digests, with the stored strings in the same order."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        kept = {r.text: r for r in reversed(rules)}  # of equal rules, the first holds
        order = sorted(kept.values(), key=lambda r: xxhash.xxh64_intdigest(r.text))
        self.keys = np.array([xxhash.xxh64_intdigest(r.text) for r in order], dtype="<u8").tobytes()
        self.rules = [(r.text, r.host, r.verdict) for r in order]
        self.path_lengths = sorted({len(r.path) for r in order})
        self.longest_host = max((len(r.host) for r in order), default=0)

    def size(self) -> int:
        return len(self.keys) + sum(len(a) + len(b) + 64 for a, b, _ in self.rules)

    def mapped(self) -> np.ndarray:
        """The digests, memory-mapped from a file of this worker's own temporary folder."""
        if not self.keys:
            return np.zeros(0, np.uint64)
        with tempfile.TemporaryFile() as f:
            f.write(self.keys)
            f.flush()
            return np.memmap(f, dtype="<u8", mode="r", shape=(len(self.keys) // 8,))


def probes(host: str, path: str, path_lengths: Sequence[int], longest_host: int) -> list[str]:
    """The strings a rule for this url can have, those that win first; no rule has a longer host than longest_host."""
    if not host:
        return []
    parts = host.split(".")
    found = []
    for i in range(max(0, len(parts) - longest_host - 1), len(parts)):
        suffix = ".".join(parts[i:])
        if len(suffix) > longest_host:
            continue
        found += [(len(suffix) + n, len(suffix), suffix + path[:n]) for n in path_lengths if n <= len(path)]
    return [s for _, _, s in sorted(found, key=lambda x: (-x[0], -x[1]))]


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", *, default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df's columns other than url with host, path, rule (null where none fits) and verdict; underscores follow a name that
    df has already. Of equal rules, the first holds."""
    host, path = host_and_path(F.col(f"`{url}`"))
    rest = df.drop(url)
    names = [free_name(rest, c) for c in ("host", "path", "rule", "verdict")]
    split = df.select(*(F.col(f"`{c}`") for c in rest.columns), host.alias(names[0]), path.alias(names[1]))
    array = DigestArray(rules)
    if array.size() > max_bytes:
        table = df.sparkSession.createDataFrame([(i, r.text, r.verdict) for i, r in enumerate(rules)], "number int, rule string, verdict string")
        return _judge_by_join(split, table, names, array.path_lengths, array.longest_host, default)
    shared = df.sparkSession.sparkContext.broadcast(array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keys = shared.value, shared.value.mapped()
        for batch in batches:
            hosts, paths = (batch.column(i).to_pylist() for i in (batch.num_columns - 2, batch.num_columns - 1))
            asked = [probes(h, p, found.path_lengths, found.longest_host) for h, p in zip(hosts, paths, strict=True)]
            row = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
            text = [s for a in asked for s in a]
            digests = np.fromiter((xxhash.xxh64_intdigest(s) for s in text), np.uint64, len(text))
            low, high = np.searchsorted(keys, digests, "left"), np.searchsorted(keys, digests, "right")
            rule: list[str | None] = [None] * len(asked)
            verdict = [default] * len(asked)
            for i in np.flatnonzero(high > low):  # in the order of the probes: the first hit of a row wins
                if rule[row[i]] is None:
                    for k in range(low[i], high[i]):
                        if found.rules[k][0] == text[i]:
                            rule[row[i]], verdict[row[i]] = found.rules[k][0], found.rules[k][2]
                            break
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, *names[2:]])

    return split.mapInArrow(run, T.StructType([*split.schema.fields, *(T.StructField(c, T.StringType()) for c in names[2:])]))


def _judge_by_join(split: DataFrame, rules: DataFrame, names: Sequence[str], path_lengths: Sequence[int], longest_host: int, default: str) -> DataFrame:
    """The same for rules (number, rule, verdict) of any number: each distinct host and path is joined with the rules it can
    have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, s, k) for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, s in enumerate(probes(h, p, path_lengths, longest_host))]
            yield pa.RecordBatch.from_pylist([dict(zip(("host", "path", "rule", "place"), r, strict=True)) for r in rows], pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("place", pa.int32())]))

    pages = split.select(F.col(f"`{names[0]}`").alias("host"), F.col(f"`{names[1]}`").alias("path")).distinct()
    asked = written(pages.mapInArrow(run, "host string, path string, rule string, place int"), "probes")
    verdicts = rules.groupBy("rule").agg(F.min_by("verdict", "number").alias("verdict"))
    # Most pages ask for a few short rules.
    asked_for = written(asked.groupBy("rule").agg(F.count("*").alias("n")).join(verdicts, "rule"), "asked_for")
    best = met(asked, asked_for, ["rule"], "n").groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), "place").alias("best"))
    plain = split.alias("s").join(best.alias("b"), (F.col(f"s.`{names[0]}`") == F.col("b.host")) & (F.col(f"s.`{names[1]}`") == F.col("b.path")), "left")
    return plain.select("s.*", F.col("b.best.rule").alias(names[2]), F.coalesce("b.best.verdict", F.lit(default)).alias(names[3]))
