"""Quality rules: how much of a text lies inside its own duplicated n-grams and lines.

Every text is hashed in numpy with rolling hashes of several n-gram lengths. For each length the characters in words
that some n-gram occurring twice or more in the text covers are counted, as are the characters of lines equal to an
earlier line; a text stays if each count is within a limit that is a percentage of all characters in words, and if it holds few symbols
for its words.

Defined results: a null or empty text has no words, all counts are 0 and the rule for short texts rejects it; repeated
rows are judged one by one; an empty table gives an empty result; other columns are passed through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import _text
from causeway.llm._common import free_name

#: Most percent of the characters in words that duplicated n-grams of so many words may cover; the usual limits of this rule.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most percent of the characters in words that may stand in lines equal to an earlier line.
LINE_LIMIT = 30
#: Most symbols in a hundred words.
SYMBOL_LIMIT = 10
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, dtype=bool)
    ranked = keys[order]
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), dtype=bool)
    out[order] = same[:-1] | same[1:]
    return out


def _covered(windows: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in a marked window of n words."""
    edge = np.zeros(total + 1, dtype=np.int64)
    at = np.flatnonzero(windows)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of every text; dup_chars_nK for each K of lengths."""
    texts = len(offsets) - 1
    per = lambda doc, weight=None: np.bincount(doc, weight, minlength=texts).astype(np.int64)
    start, end, doc = _text.words(data, offsets)
    sums = _text.prefix(data)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = heads[end] - heads[start]
    out = {"n_words": per(doc), "word_chars": per(doc, chars)}
    marks = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = per(np.searchsorted(offsets, marks, "right") - 1)

    salt = _text.mix(np.arange(1, texts + 1, dtype=np.uint64))
    hashes = _text.span(sums, start, end)

    def covered(n: int) -> np.ndarray:
        grams = _text.shingles(hashes, n)
        if not len(grams):
            return np.zeros(len(doc), dtype=bool)
        inside = doc[: len(grams)] == doc[n - 1 :]
        at = np.flatnonzero(inside)
        found = np.zeros(len(grams), dtype=bool)
        found[at] = _repeated(grams[at] ^ salt[doc[at]])
        return _covered(found, n, len(doc))

    out["n_repeat_words"] = per(doc, covered(3))
    for n in lengths:
        out[f"dup_chars_n{n}"] = per(doc, chars * covered(n))

    # A line ends before \n or at the end of its text.
    cut = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1], cut + 1)
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.append(line_start[1:], len(data))
    line_end = np.where(data[line_end - 1] == 10, line_end - 1, line_end) if len(line_start) else line_end[:0]
    first, last = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    at = np.flatnonzero(last > first)
    keys = _text.span(sums, line_start[at], line_end[at]) ^ salt[line_doc[at]]
    _, earliest = np.unique(keys, return_index=True)
    later = np.ones(len(at), dtype=bool)
    later[earliest] = False
    at = at[later]
    totals = np.concatenate(([0], np.cumsum(chars)))
    out["n_dup_lines"] = per(line_doc[at])
    out["dup_line_chars"] = per(line_doc[at], totals[last[at]] - totals[first[at]])
    return out


def judge(df: DataFrame, text: str = "text", *, ngram_limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT, symbol_limit: int = SYMBOL_LIMIT) -> DataFrame:
    """df with a struct column ``quality`` (underscores follow if the name is taken): the counts, ``dup_chars_nK``,
    ``base_failed`` and ``kept``."""
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits
    lengths = tuple(sorted(limits))
    name = free_name(df, "quality")
    counts = [*COUNTS, *(f"dup_chars_n{n}" for n in lengths)]
    kind = T.StructType([T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _text.slices(batches, text):
            m = measure(data, offsets, lengths)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            kept = ~failed & (100 * m["dup_line_chars"] <= line_limit * m["word_chars"])
            kept &= 100 * m["n_symbols"] <= symbol_limit * m["n_words"]
            for n in lengths:
                kept &= 100 * m[f"dup_chars_n{n}"] <= limits[n] * m["word_chars"]
            fields = [pa.array(m[c]) for c in counts] + [pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(fields, [*counts, "base_failed", "kept"])], [*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def keep(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of df that the rules accept, with df's columns."""
    name = free_name(df, "quality")
    return judge(df, text, **limits).where(F.col(f"`{name}`.kept")).drop(name)
