"""How far the sources of a language are apart in their words: DuckDB counts and compares shards, Spark merges them.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. Tasks count the terms of their own texts first;
what is left is dealt to shards by language and term, and DuckDB adds up each shard with SQL and keeps the terms that stand in
enough documents. Totals go back through Spark, and the kept terms are dealt to shards of bounded size once more, in which SQL
makes the smoothed shares p of every source, the sums of |p - q| for every pair of sources and the best terms of every source.
Spark adds the sums of all shards and ranks them. Shares are integers, so no result depends on the order of rows.

Defined results: null texts, languages and sources count as ''; a row is a document, whether its id is null or repeated; a
group without terms is still compared with the others of its language; a language without kept terms has all pairs at 0 and
no ranked terms; an only source has no pair; ties in value are ranked by the item's UTF-8 bytes; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from causeway.llm import _text
from causeway.llm._common import written

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Kept terms in a shard of the comparison.
SHARD_TERMS = 2_000
#: Bytes of text that a task counts at a time, counts that it holds before it sends them on, and rows that it sends at a time.
SLICE, HELD, SENT = 4 << 20, 2_000_000, 100_000
#: Rows of counts that DuckDB takes at a time.
FOLDED = 500_000
#: Every byte that is no part of a term becomes 0, A-Z become a-z.
LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
COUNTED = "lang string, source string, term string, docs long, n long"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Every term of the texts, and the number of its text."""
    data = LETTERS[data]
    inside = data != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A term ends with its text, though another one may follow at once.
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])
    start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    at = np.concatenate(([0], np.cumsum(end - start)))
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    return terms.dictionary_encode(), np.searchsorted(offsets, start, "right") - 1


def _added(group: np.ndarray, term: np.ndarray, docs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with a row for each group and term."""
    order = np.argsort(key := group << 32 | term)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(docs[order], first), np.add.reduceat(n[order], first)


class _Held:
    """Counts of groups and terms that a task has not sent on yet."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def add(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        """The rows (lang, source, text) with the bytes and offsets of their texts."""
        terms, doc = _terms(data, offsets)
        if len(doc):
            key, n = np.unique(doc << 32 | terms.indices.to_numpy(), return_counts=True)
            names = zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)
            group = np.array([self.groups.setdefault(g, len(self.groups)) for g in names], np.int64)
            group, term, docs, n = _added(group[key >> 32], key & 0xFFFFFFFF, np.ones(len(key), np.int64), n)
            self.parts.append((group, pa.DictionaryArray.from_arrays(pa.array(term.astype(np.int32)), terms.dictionary), docs, n))

    def merge(self) -> None:
        if len(self.parts) > 1:
            group, terms, docs, n = zip(*self.parts, strict=True)
            terms = pa.chunked_array(terms).unify_dictionaries()
            number = np.concatenate([c.indices.to_numpy() for c in terms.chunks]).astype(np.int64)
            group, term, docs, n = _added(np.concatenate(group), number, np.concatenate(docs), np.concatenate(n))
            self.parts = [(group, pa.DictionaryArray.from_arrays(pa.array(term.astype(np.int32)), terms.chunk(0).dictionary), docs, n)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for group, terms, docs, n in self.parts:
            names = [pa.array(x, pa.string()) for x in zip(*self.groups, strict=True)]
            for at in range(0, len(group), SENT):
                g, part = pa.array(group[at : at + SENT]), slice(at, at + SENT)
                term = terms.dictionary.take(terms.indices[part]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names[0].take(g), names[1].take(g), term, pa.array(docs[part]), pa.array(n[part])], ["lang", "source", "term", "docs", "n"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs (documents with the term) and n (occurrences), each perhaps several times over: a task sends
    what it has counted whenever it holds HELD counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for part in _text.slices(batches, "text", SLICE):
            held.add(*part)
            if len(held) > HELD:
                held.merge()
                if len(held) > HELD // 2:
                    yield from held.rows()
                    held = _Held()
        yield from held.rows()

    return docs.mapInArrow(run, COUNTED)


def _shard() -> duckdb.DuckDBPyConnection:
    """A database in memory, with one thread and no files."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term and n of every term in least_docs documents of its language; is_lead at one source of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _shard() as db:
            db.execute("CREATE TABLE total (lang VARCHAR, source VARCHAR, term VARCHAR, docs BIGINT, n BIGINT)")
            waiting: list[pa.RecordBatch] = []
            rows = total = 0

            def fold() -> int:
                fresh = pa.Table.from_batches(waiting)  # noqa: F841  named in the SQL
                db.execute("CREATE TABLE more AS SELECT lang, source, term, sum(docs)::BIGINT AS docs, sum(n)::BIGINT AS n FROM (FROM total UNION ALL FROM fresh) GROUP BY ALL")
                db.execute("DROP TABLE total; ALTER TABLE more RENAME TO total")
                return db.execute("SELECT count(*) FROM total").fetchall()[0][0]

            for batch in batches:
                waiting.append(batch)
                rows += batch.num_rows
                if rows >= max(FOLDED, total):  # so that every row is added up a few times at most
                    total, rows = fold(), 0
                    waiting.clear()
            if waiting:
                fold()
            kept = "SELECT lang, term, min(source) AS lead FROM total GROUP BY ALL HAVING sum(docs) >= ?"
            yield from db.sql(f"SELECT lang, source, term, n, source = lead AS is_lead FROM total JOIN ({kept}) USING (lang, term)", params=[least_docs]).to_arrow_reader(SENT)

    return counts.repartition("lang", "term").mapInArrow(run, "lang string, source string, term string, n long, is_lead boolean")


COMPARE = f"""
CREATE TABLE size AS SELECT max(v)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM groups;
CREATE TABLE term AS SELECT row_number() OVER () AS t, term FROM terms WHERE is_lead;
CREATE TABLE own AS SELECT t, source, n FROM terms JOIN term USING (term);
CREATE TABLE q AS SELECT t, (1 + {SCALE}::HUGEINT * (sum(own.n) + {SMOOTHING}) // (any_value(size.n) + {SMOOTHING} * any_value(size.v)))::BIGINT AS q FROM own, size GROUP BY t;
CREATE TABLE g AS SELECT row_number() OVER (ORDER BY source) AS g, source, n + {SMOOTHING} * v AS mass FROM groups;
CREATE TABLE share AS SELECT t, g, coalesce(own.n, 0) AS n, (1 + {SCALE}::HUGEINT * (coalesce(own.n, 0) + {SMOOTHING}) // mass)::BIGINT AS p
  FROM (SELECT t, g, source, mass FROM term, g) LEFT JOIN own USING (t, source);
"""
PAIRS = """
WITH apart AS (SELECT a.g AS a, b.g AS b, sum(abs(a.p - b.p))::BIGINT AS value FROM share a JOIN share b ON a.t = b.t AND a.g < b.g GROUP BY ALL)
SELECT x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
FROM g x JOIN g y ON x.g <> y.g LEFT JOIN apart ON apart.a = least(x.g, y.g) AND apart.b = greatest(x.g, y.g)
"""
TERMS = f"""
SELECT source, 'term' AS part, term AS item, p - q AS value FROM share JOIN q USING (t) JOIN term USING (t) JOIN g USING (g)
WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY g ORDER BY p - q DESC, term) <= {TOP_TERMS}
"""
FINDINGS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compared(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """The part of a shard in the sums of all pairs of sources, and its best terms of each source."""
    if not groups.num_rows:
        return FINDINGS.empty_table()
    with _shard() as db:
        db.execute(COMPARE)
        found = [db.sql(sql).to_arrow_table() for sql in (PAIRS, TERMS)]
    lang = groups.column("lang")[0].as_py()
    return pa.concat_tables(t.add_column(0, "lang", pa.repeat(lang, t.num_rows)).select(FINDINGS.names).cast(FINDINGS) for t in found)


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: for each source of a language its distance from every other
    one, and the terms that stand out most against the language."""
    plain = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    docs = df.select(plain(lang, "lang"), plain(source, "source"), plain(text, "text"))
    kept = written(kept_terms(term_counts(docs), least_docs), "terms")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.where("is_lead").groupBy("lang").agg(F.count("*").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = written(docs.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", zero("n"), zero("v")), "groups")
    shards = 1 + (by_lang.agg(F.max("v")).first()[0] or 0) // SHARD_TERMS
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards).cast("long"))).groupBy("lang", "shard")
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).groupBy("lang", "shard")
    found = dealt.cogroup(everywhere).applyInArrow(_compared, "lang string, source string, part string, item string, value long")
    merged = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = merged.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
