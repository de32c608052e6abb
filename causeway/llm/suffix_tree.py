"""LM scoring with a probabilistic suffix tree over words.

Tokens are lower-cased words and an end per text. The root has the smoothed frequencies of all words. Below it, contexts
of one, two and more words become states if the state of their suffix is there and if their next-word distribution
diverges from that one's: the count times the Kullback-Leibler divergence must reach a threshold for each word the state
keeps, which are those that follow it LEAST_COUNT times. A state gives a kept word its discounted share, and hands what is
left on to its suffix. A token is scored by the state of the longest suffix of its history. The model's memory is a
parameter, DEPTH: no context has more words. The number of states has no bound, and neither LEAST_COUNT nor DEPTH
depends on the corpus. The texts are read once for the words, once for contexts of one word and once for those of two;
from these states, all longer contexts are counted in one more pass.

Word counts, states and kept words are tables of any size. Tasks hold bitmaps of fixed size that may say yes too often but
never no too often, and a cache of the most frequent states, kept words and words. The bitmaps only save the shuffle
of what a join would drop, and what the cache lacks is priced by joins with the tables: results depend on neither.

Defined results: a null or empty text is its end alone; a null id is no hold-out; repeated rows are scored one by one and
count each; an empty table gives an empty result; without training texts, all tokens are unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import _text
from causeway.llm._common import written

#: At most so many words, states and kept words, each, are cached in the tasks.
CACHE = 1 << 21
LEAST_COUNT = 16
#: Most words of a context. On held-out texts of 0.1 GB of documents, 6 and 8 score a little worse than 4.
DEPTH = 4
DISCOUNT = 0.75
#: Least count times divergence, in nats, for each word that a state keeps.
DIVERGENCE = 4.0
#: Hash that stands for the end of a text.
END = np.uint64(0x5DEECE66D1CE4E5B)
#: Stands for a next word that is not cached.
ANY = np.uint64(0x2545F4914F6CDD1D)
STEP, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Most bits of a bitmap.
BITMAP = 1 << 27
#: Tokens whose entries make a bucket, about.
BUCKET_TOKENS = 1 << 20
#: Entries that a task holds before it sends them.
HELD = 1 << 20
ASK = "array<struct<pos:int,kind:int,depth:int,key:long,value:double>>"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every token, with the end of each text after its words."""
    start, end, doc = _text.words(data, offsets)
    hashes = _text.span(_text.prefix(data, _text.LOWER_VALUES), start, end)
    texts = len(offsets) - 1
    at = np.arange(len(doc)) + doc
    out, owner = np.full(len(doc) + texts, END, dtype=np.uint64), np.empty(len(doc) + texts, dtype=np.int64)
    out[at] = hashes
    last = np.searchsorted(doc, np.arange(texts), "right") + np.arange(texts)
    owner[at], owner[last] = doc, np.arange(texts)
    return out, owner


def _counted(docs: DataFrame) -> DataFrame:
    """h and c: the count of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            value, inverse = np.unique(h, return_inverse=True)
            return value, np.bincount(inverse, c).astype(np.int64)

        for _, data, offsets in _text.slices(batches, "text"):
            value, count = np.unique(tokens(data, offsets)[0], return_counts=True)
            held.append((value, count))
            size += len(value)
            if size > 1 << 21:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["h", "c"])
                    held, size = [], 0
        if held:
            value, count = merged()
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], ["h", "c"])

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts with one more word before them."""
    return _text.mix(context * STEP + word)


def entry(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts with their next words."""
    return _text.mix(context * NEXT + word)


class Bitmap:
    """Which hashes may be in a table's column."""

    def __init__(self, df: DataFrame, column: str) -> None:
        bits = max(15, min(BITMAP.bit_length() - 1, (32 * df.count()).bit_length()))
        self.mask = (1 << bits) - 1
        at = F.col(column).bitwiseAND(F.lit(self.mask)) + 1
        parts = df.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
        self.bits = np.zeros((self.mask + 1) >> 3, np.uint8)
        for b, bits in parts:
            self.bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Cached:
    """The values of the most frequent rows of a table (key, n, value) by key, and whether these are all rows."""

    def __init__(self, df: DataFrame, most: int) -> None:
        level = F.floor(8 * F.log2("n")).cast("long")
        counts = sorted(((r["level"], r["count"]) for r in df.groupBy(level.alias("level")).count().collect()), reverse=True)
        held = np.cumsum([c for _, c in counts])
        fit = int(np.searchsorted(held, most, "right"))
        self.complete = fit == len(counts)
        rows = df.where(level >= (counts[fit - 1][0] if fit else 1 << 40)).select("key", "value").toArrow()
        key, value = (rows.column(c).to_numpy() for c in ("key", "value"))
        key = key.view(np.uint64)
        order = np.argsort(key)
        self.key, self.value = key[order], value[order].astype(np.float64)
        self.first: np.ndarray | None = None

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys are, -1 for those that are not there. Hashes are spread evenly, so their first bits lead to a few
        places each, where a binary search would take many steps in far apart memory."""
        out = np.full(len(keys), -1)
        if not len(self.key):
            return out
        if self.first is None:  # in each worker
            self.shift = np.uint64(64 - max(1, len(self.key).bit_length()))
            bounds = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
            self.first = np.append(np.searchsorted(self.key, bounds), len(self.key)).astype(np.int32)
        part = (keys >> self.shift).astype(np.int64)
        at, end, left = self.first[part], self.first[part + 1], np.arange(len(keys))
        while True:
            some = at < end
            at, end, left = at[some], end[some], left[some]
            if not len(left):
                return out
            hit = self.key[at] == keys[left]
            out[left[hit]] = at[hit]
            at, end, left = at[~hit] + 1, end[~hit], left[~hit]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, nan where there are none."""
        if not len(self.key):
            return np.full(len(keys), np.nan)
        at = self.place(keys)
        return np.where(at >= 0, self.value[at], np.nan)


class Tree:
    """What tasks hold of the tables. A token's log10 probability is the value of the deepest state of its history (the log
    of all that its line of states hands on) plus that of the deepest of these states that keeps the token (the log of its
    probability there, less the state's value), or of the root if none does."""

    def __init__(self, words: Cached, states: Cached, kept: Cached, maybe_state: Bitmap, maybe_kept: Bitmap, z: int) -> None:
        self.h, self.c, self.z = words.key, words.value, z
        self.words_cached, self.states, self.kept, self.maybe_state, self.maybe_kept = words, states, kept, maybe_state, maybe_kept
        self.root = (self.c + 1) / self.z

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for those that are not cached."""
        return self.words_cached.place(hashes)

    def walk(self, word: np.ndarray, before, asks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Value and depth of the deepest cached state and kept entry of every token (0 where there is none; the root has
        depth 0). before(at, d) has the words d places before tokens, and which tokens have one. What only the tables
        know is added to asks: token, kind (0 state, 1 entry), depth, key."""
        state, entered = np.zeros(len(word)), np.zeros(len(word))
        state_depth, entry_depth = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        at, context, d = np.arange(len(word)), np.zeros(len(word), np.uint64), 0
        while len(at):
            d += 1
            more, ok = before(at, d)
            at, context = at[ok], longer(context[ok], more[ok])
            maybe = self.maybe_state.has(context)
            at, context = at[maybe], context[maybe]
            for kind, table, keys, where, value, depth in ((0, self.states, context, at, state, state_depth), (1, self.kept, entry(context, word[at]), at, entered, entry_depth)):
                if kind:
                    some = self.maybe_kept.has(keys)
                    keys, where = keys[some], where[some]
                got = table.get(keys)
                found = ~np.isnan(got)
                value[where[found]], depth[where[found]] = got[found], d
                if not table.complete and not found.all():
                    asks.append((where[~found], np.full(int((~found).sum()), kind), np.full(int((~found).sum()), d), keys[~found]))
                if not kind and table.complete:
                    at, context = at[found], context[found]
        return state, state_depth, entered, entry_depth

    def price(self, word: np.ndarray, *history: np.ndarray) -> np.ndarray:
        """log10 of the probabilities by what is cached. Words and their history, the last word first, are numbers; -1 has
        no such word. Of a word -1, without the root's part."""
        named = lambda x: self.h[np.maximum(x, 0)] if len(self.h) else np.zeros(len(x), np.uint64)

        def before(at: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
            x = history[d - 1][at] if d <= len(history) else np.full(len(at), -1)
            return named(x), x >= 0

        state, _, entered, depth = self.walk(np.where(word >= 0, named(word), ANY), before, [])
        root = np.where(word >= 0, np.log10(self.root[np.maximum(word, 0)]) if len(self.root) else 0.0, 0.0)
        return state + np.where(depth > 0, entered, root)


def _before(h: np.ndarray, doc: np.ndarray):
    """The words before tokens in their texts, for Tree.walk."""
    first = np.searchsorted(doc, doc)

    def before(at: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        return h[np.maximum(at - d, 0)], at - d >= first[at]

    return before


def _entries(docs: DataFrame, first: int, last: int, words: Broadcast, often: list[Broadcast], states: list[Broadcast], least: int, buckets: int) -> DataFrame:
    """What occurs at least least times of contexts of first to last words, as rows depth, whole, code, context, other and
    n: contexts with their next word (other), and, where whole is true, with any next word (other is then the suffix, the
    context without its first word). Contexts are left out where a suffix whose depth has been settled (states) is no
    state, or where two words in a row, or three of which the middle one is a state, are too rare (often: the entries found
    for one word and for two). Entries are counted in each task and then dealt into buckets by code. There are no whole rows
    of contexts whose occurrences are known from the entries of one word less, see _longer()."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> list[np.ndarray]:
            kind, context, other, n = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at, inverse = np.unique(entry(context, other), return_index=True, return_inverse=True)
            return [kind[at], context[at], other[at], np.minimum(np.bincount(inverse, n), 2**32 - 1).astype(np.uint32)]

        def packed(kind: np.ndarray, context: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            group = (entry(context, other) % np.uint64(buckets)).astype(np.int64) * 256 + kind
            order = np.lexsort((context, group))
            edge = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            parts, own = np.split(order, edge[1:]), group[order[edge]]
            columns = [pa.array([x[i].tobytes() for i in parts], pa.binary()) for x in (context, other, n)]
            return pa.RecordBatch.from_arrays([pa.array((own >> 8).astype(np.int32)), pa.array((own & 255).astype(np.int32)), *columns], ["bucket", "kind", "context", "other", "n"])

        for _, data, offsets in _text.slices(batches, "text"):
            h, doc = tokens(data, offsets)
            before, known = _before(h, doc), words.value.has(h)
            two, three, unsettled = np.ones(len(h), bool), np.ones(len(h), bool), np.ones(len(h), bool)
            one = longer(np.zeros(len(h) - 1, np.uint64), h[:-1])
            if often:
                two[1:] = often[0].value.has(entry(one, h[1:]))
            if len(often) > 1:
                unsettled[2:] = ~states[0].value.has(one[1:])
                three[2:] = often[1].value.has(entry(longer(one[1:], h[:-2]), h[2:])) | unsettled[2:]
            at = np.flatnonzero(before(np.arange(len(h)), 1)[1])
            at = at[known[at - 1]]
            suffix, context = np.zeros(len(at), np.uint64), longer(np.zeros(len(at), np.uint64), h[at - 1])
            for d in range(1, last + 1):
                if d > 1:
                    more, ok = before(at, d)
                    ok &= two[at - d + 1]
                    if d > 2:
                        ok &= three[at - d + 2]
                    if d - 2 < len(states):
                        ok[ok] = states[d - 2].value.has(context[ok])
                    at, suffix = at[ok], context[ok]
                    context = longer(suffix, more[ok])
                if d < first or not len(at):
                    continue
                some = known[at] & two[at] & (three[at] if d > 2 else True)
                open_ = at > 0 if d > 3 else unsettled[at - 1] if d == 3 else at < 0
                for whole, c, o in ((0, context[some], h[at[some]]), (1, context[open_], suffix[open_])):
                    code, place, n = np.unique(entry(c, o), return_index=True, return_counts=True)
                    held.append((np.full(len(code), 2 * d + whole, np.uint8), c[place], o[place], n.astype(np.uint32)))
                    size += len(code)
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield packed(*held[0])
                    held, size = [], 0
        if held:
            yield packed(*merged())

    def add(key: tuple[pa.Scalar, pa.Scalar], table: pa.Table) -> pa.Table:
        context, other = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("context", "other"))
        code, at, inverse = np.unique(entry(context, other), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32)).astype(np.int64)
        ok = n >= least
        at, kind = at[ok], key[1].as_py()
        return pa.table({"depth": pa.array(np.full(len(at), kind // 2, np.int32)), "whole": pa.array(np.full(len(at), kind % 2 == 1)), "code": code[ok].view(np.int64), "context": context[at].view(np.int64), "other": other[at].view(np.int64), "n": n[ok]})

    sent = docs.mapInArrow(send, "bucket int, kind int, context binary, other binary, n binary")
    return sent.groupBy("bucket", "kind").applyInArrow(add, "depth int, whole boolean, code long, context long, other long, n long")


WHOLE = "context long, suffix long, total long, words array<long>"


def _single(often: DataFrame) -> DataFrame:
    """context, suffix, total and words (the last one first) of the contexts of one word, from the counts of words (h, c):
    some token follows every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            context = longer(np.zeros(len(h), np.uint64), h)
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(np.zeros(len(h), np.int64)), batch.column(1), words], ["context", "suffix", "total", "words"])

    return often.select("h", "c").mapInArrow(run, WHOLE)


def _longer(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """The same for the contexts of one word more: those that end in the entries' words occur as often as the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            size = len(lists.flatten()) // batch.num_rows
            words = lists.flatten().to_numpy().view(np.uint64).reshape(-1, size)
            context = longer(np.zeros(len(words), np.uint64), words[:, 0])
            for k in range(1, size):
                suffix, context = context, longer(context, words[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(suffix.view(np.int64)), batch.column(1), lists], ["context", "suffix", "total", "words"])

    # a state ends in a word, not in the end of a text
    end = F.lit(int(END.view(np.int64)))
    joined = entries.where(F.col("word") != end).join(totals.select("context", "words"), "context")
    return joined.select(F.concat(F.array("word"), "words").alias("words"), F.col("n").alias("total")).mapInArrow(run, WHOLE)


def _grown(entries: DataFrame, totals: DataFrame, below: DataFrame) -> DataFrame:
    """The kept words of a depth's states: code, context, word, n, total, p (the probability of the word) and s (the log10 of
    what the state and those before it hand on). entries: code, context, word and n; totals: context, suffix and total;
    below: suffix, word, p and s of the depth before."""
    rows = entries.join(totals, "context").join(below.select("suffix", "word", F.col("p").alias("q"), F.col("s").alias("s_below")), ["suffix", "word"])
    rest = lambda x: F.greatest(1 - F.sum(x), F.lit(1e-12))
    share, total = F.col("n") / F.col("total"), F.first("total")
    gain = F.sum(F.col("n") * F.log(share / F.col("q"))) + total * rest(share) * F.log(rest(share) / rest(F.col("q")))
    kept_share = (F.col("n") - DISCOUNT) / F.col("total")
    states = rows.groupBy("context").agg(gain.alias("gain"), F.count("*").alias("number"), (1 - F.sum(kept_share)).alias("passed"), F.first("s_below").alias("s_below"))
    states = states.where(F.col("gain") >= DIVERGENCE * F.col("number")).select("context", "passed", (F.col("s_below") + F.log10("passed")).alias("s"))
    return rows.join(states, "context").select("code", "context", "word", "n", "total", (kept_share + F.col("passed") * F.col("q")).alias("p"), "s")


def learn(docs: DataFrame, *, cache: int = CACHE, least_count: int = LEAST_COUNT, depth: int = DEPTH) -> tuple[Tree, DataFrame, int]:
    """The tree of docs (text), the table of the values of all keys (kind, key, value; kind 0 states, 1 kept words, 2 counts
    of tokens) and the number of tokens."""
    counts = written(_counted(docs), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    z = total + distinct + 1
    often = counts.where(F.col("c") >= least_count)
    send = docs.sparkSession.sparkContext.broadcast
    words, codes, maybe, depths = send(Bitmap(often, "h")), [], [], []
    buckets = max(32, -(-total // BUCKET_TOKENS))
    below = often.select(F.lit(0).cast("long").alias("suffix"), F.col("h").alias("word"), ((F.col("c") + 1) / F.lit(float(z))).alias("p"), F.lit(0.0).alias("s"))
    found = None
    for d in range(1, depth + 1):
        if d <= 3:
            found = written(_entries(docs, d, depth if d == 3 else d, words, codes, maybe, least_count, buckets), "entries")
        mine = found.where(F.col("depth") == d)
        entries = mine.where("not whole").select("code", "context", F.col("other").alias("word"), "n")
        counted = mine.where("whole").select("context", F.col("other").alias("suffix"), F.col("n").alias("total"))
        if d <= 3:
            totals = written(_single(often) if d == 1 else _longer(before, totals), "totals")
            counted = counted.unionByName(totals.drop("words"))
            before = entries
        if d < 3:
            codes.append(send(Bitmap(entries, "code")))
        depths.append(written(_grown(entries, counted, below), "kept"))
        if depths[-1].isEmpty():
            break
        if d < 3:
            maybe.append(send(Bitmap(depths[-1], "context")))
        below = depths[-1].select(F.col("context").alias("suffix"), "word", "p", "s")
    kept = depths[0]
    for more in depths[1:]:
        kept = kept.unionByName(more)
    states = kept.groupBy(F.col("context").alias("key")).agg(F.first("total").alias("n"), F.first("s").alias("value"))
    states = written(states, "states")
    entries = kept.select(F.col("code").alias("key"), "n", (F.log10("p") - F.col("s")).alias("value"))
    count = counts.select(F.col("h").alias("key"), F.col("c").alias("n"), F.col("c").cast("double").alias("value"))
    end = int(END.view(np.int64))
    tree = Tree(Cached(count.where((F.col("n") >= least_count) | (F.col("key") == end)), cache), Cached(states, cache), Cached(entries, cache), Bitmap(states, "key"), Bitmap(entries, "key"), z)
    values = [x.select(F.lit(kind).alias("kind"), "key", "value") for kind, x in enumerate((states, entries, count))]
    return tree, values[0].unionByName(values[1]).unionByName(values[2]), total


def score(df: DataFrame, key: str = "doc_id", text: str = "text", *, held_out: Column, **options) -> DataFrame:
    """A row for each row of df: key, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    docs = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    tree, values, total = learn(docs.where(~F.col("held_out")).select("text"), **options)
    shared = df.sparkSession.sparkContext.broadcast(tree)
    names = ["key", "held_out", "n_tokens", "known", "base", "model", "rare", "times", "priced", "asks"]
    kinds = [docs.schema["key"].dataType, T.BooleanType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T._parse_datatype_string(ASK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows, data, offsets in _text.slices(batches, "text"):
            h, doc = tokens(data, offsets)
            word, asks = known.words(h), []
            state, state_depth, entered, entry_depth = known.walk(h, _before(h, doc), asks)
            per = lambda at, x=None: np.bincount(doc[at], x, minlength=rows.num_rows)
            often = (word >= 0) & (known.c[np.maximum(word, 0)] > 0) if len(known.c) else np.zeros(len(word), bool)
            base = np.where(often, np.log10(known.c[np.maximum(word, 0)] + 1) if len(known.c) else 0.0, 0.0) - np.log10(known.z)
            price = state + np.where(entry_depth > 0, entered, base)
            # Tokens with a part that is not cached are priced from the tables alone, by all the parts that are known of them.
            kind, depth = (np.concatenate([x[i] for x in asks] or [np.zeros(0, np.int64)]) for i in (1, 2))
            at, asked = np.concatenate([x[0] for x in asks] or [np.zeros(0, np.int64)]), np.concatenate([x[3] for x in asks] or [np.zeros(0, np.uint64)])
            is_open = np.zeros(len(h), bool)
            is_open[at] = True
            some = np.flatnonzero(is_open)
            price[some] = 0.0
            rare = np.flatnonzero(word < 0)
            order = rare[np.lexsort((h[rare], doc[rare]))]
            edge = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(order) else np.zeros(0, np.int64)
            times, owner = np.diff(np.append(edge, len(order))), doc[order[edge]]
            by_root = np.add.reduceat((~is_open & (entry_depth == 0))[order].astype(np.int32), edge) if len(order) else np.zeros(0, np.int32)
            lists = pa.array(np.searchsorted(owner, np.arange(rows.num_rows + 1)).astype(np.int32))
            # Asks: the open parts, the cached state and entry, and the root, by count where the word is not cached.
            new = some[word[some] < 0]
            parts = [
                (at, kind, depth, asked.view(np.int64), np.full(len(at), np.nan)),
                (some, np.zeros(len(some), np.int64), state_depth[some], None, state[some]),
                (some, np.ones(len(some), np.int64), entry_depth[some], None, np.where(entry_depth[some] > 0, entered[some], base[some])),
                (new, np.full(len(new), 2), np.zeros(len(new), np.int64), h[new].view(np.int64), np.full(len(new), np.nan)),
            ]
            pos, kind, depth, value = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 4))
            keys = np.concatenate([np.zeros(len(p[0]), np.int64) if p[3] is None else p[3] for p in parts])
            closed = np.concatenate([np.full(len(p[0]), p[3] is None) for p in parts])
            sort = np.argsort(doc[pos], kind="stable")
            ask_lists = pa.array(np.searchsorted(doc[pos][sort], np.arange(rows.num_rows + 1)).astype(np.int32))
            fields = [pa.array(x[sort].astype(np.int32)) for x in (pos, kind, depth)] + [pa.array(keys[sort], mask=closed[sort]), pa.array(value[sort], mask=~closed[sort])]
            ask_structs = pa.StructArray.from_arrays(fields, ["pos", "kind", "depth", "key", "value"])
            everything = np.arange(len(doc))
            columns = [rows.column(0), rows.column(1), pa.array(per(everything)), pa.array(per(np.flatnonzero(often))), pa.array(per(everything, base)), pa.array(per(everything, price))]
            columns += [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (h[order[edge]].view(np.int64), times.astype(np.int32), by_root.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ask_lists, ask_structs)], names)

    scored = docs.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = scored.select("row", F.explode(F.arrays_zip("rare", "times", "priced")).alias("x")).select("row", F.col("x.rare").alias("key"), "x.times", "x.priced")
    log = F.log10(F.col("value") + 1)
    priced = asked.join(values.where("kind = 2"), "key").groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.col("priced") * log).alias("more_priced"), F.sum("times").alias("seen"))
    out = scored.join(priced, "row", "left")
    found = F.lit(0.0)
    if not (tree.states.complete and tree.kept.complete):
        asks = scored.select("row", F.explode("asks").alias("a")).select("row", "a.*")
        got = asks.where("key is not null").drop("value").join(values, ["kind", "key"]).withColumn("value", F.when(F.col("kind") == 2, log - F.log10(F.lit(float(tree.z)))).otherwise(F.col("value")))
        # A word's count goes before the 1 / z of unknown words, which has the same depth.
        every = got.select("row", "pos", "kind", "depth", "value").unionByName(asks.where("key is null").select("row", "pos", "kind", "depth", "value"))
        best = every.groupBy("row", "pos", (F.col("kind") > 0).alias("of_word")).agg(F.max_by("value", F.struct("depth", "kind")).alias("value"))
        out = out.join(best.groupBy("row").agg(F.sum("value").alias("found")), "row", "left")
        found = F.coalesce("found", F.lit(0.0))
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("more_priced", F.lit(0.0)) + found).alias("score"),
    )
