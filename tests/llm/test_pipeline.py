"""The pipeline against a plain version of every stage, each judged on what the one before it kept."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import build, lower

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def good(text):
    """Quality rules by plain counting."""
    spans = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
    w = [text[a:b] for a, b in spans]
    chars = sum(map(len, w))

    def covered(n):
        seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(n)}

    if len(w) < 50 or 100 * len(covered(3)) > 50 * len(w):
        return False
    if 100 * len(re.findall(r"[#*$%&|<>]", text)) > 10 * len(w):
        return False
    if any(100 * sum(len(w[i]) for i in covered(n)) > limit * chars for n, limit in {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}.items()):
        return False
    lines, seen = Counter(), 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own and lines[line]:
            seen += sum(map(len, own))
        lines[line] += bool(own)
    return 100 * seen <= 30 * chars


def one_of_each(rows):
    """Rows without a smaller linked one, by all pairs."""
    shingles = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i in shingles}
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(sorted(shingles), 2) if shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return [r for r in rows if least[r[0]] == r[0]]


def without_repeats(rows):
    """Texts without the bytes that a smaller id has in a string of 50; of cut characters, the rest goes."""
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(least.get(b[p : p + 50], i), i)
    out = []
    for i, t, lang, source, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        left = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        out.append((i, left, lang, source, len(left)))
    return out


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in build()]
    spark.createDataFrame(rows, KIND).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard", "suffix_dedup", "source_mixing", "best_fit_packing"]

    def after(name, docs):
        out = stages[name](spark, docs, str(tmp_path)).cache()
        assert out.columns == [c.split()[0] for c in KIND.split(", ")], name
        return out

    docs = after("quality_rules", docs)
    want = [r for r in rows if good(r[1])]
    assert collected(docs) == want and 40 < len(want) < len(rows)
    docs, before = after("ngram_jaccard", docs), len(want)
    want = one_of_each(want)
    assert collected(docs) == want and len(want) < before
    docs = after("suffix_dedup", docs)
    want = without_repeats(want)
    assert collected(docs) == want and any(len(a[1]) < len(b[1]) for a, b in zip(want, (r for r in rows if r[0] in {w[0] for w in want})))
    # The mix: rows of the stage before, and of each source as many words as the weights share out, repeats counted.
    docs, before = after("source_mixing", docs), {tuple(r): len(WORD.findall(r[1])) for r in want}
    mixed = Counter(collected(docs))
    assert set(mixed) <= set(before) and max(mixed.values()) <= 2
    sizes, taken = defaultdict(int), defaultdict(int)
    for r, n in before.items():
        sizes[r[3]] += n
        taken[r[3]] += n * mixed[r]
    target, open_, left = {}, dict(zip(sorted(sizes), (5, 2, 1))), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        for s in full or list(open_):
            target[s] = 2 * sizes[s] if full else share[s]
            left -= target[s]
            del open_[s]
    for s in sizes:  # all documents as often as they fit whole, and the best sum of some of them below the rest
        whole, sums = int(target[s] // sizes[s]), 1
        for r, n in before.items():
            sums |= sums << n if r[3] == s else 0
        rest = round(target[s]) - whole * sizes[s] if whole < 2 else 0
        assert taken[s] == whole * sizes[s] + (sums & ((2 << rest) - 1)).bit_length() - 1
    # Packing, and the whole run, which reads and writes between stages.
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for (i, t, *_), n in mixed.items():
        ids = np.array(tk.encode(t, add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 4096):
            pieces[i, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += n
    for out in (stages["best_fit_packing"](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        out = out.toPandas()
        assert Counter(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == pieces
        ends = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert (ends["length"].cumsum() - out["length"] == out["offset"]).all() and ends["length"].sum().max() <= 4096


def test_stages_of_nulls_and_of_nothing(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(None, long, None, None, None), (None, long, None, None, None), (1, None, "en", None, 0), (2, long + " end", None, "s", 5), (3, "", None, None, None)]
    for name, some in (("nulls", rows), ("nothing", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(some, KIND).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in out} <= {None, 2} and bool(out) == bool(some)
        docs = spark.createDataFrame(some, KIND)
        for stage, f in corpus_pipeline.STAGES:
            got = f(spark, docs, str(tmp_path / name)).collect()
            assert bool(got) == bool(some), stage
