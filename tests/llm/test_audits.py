"""The divergence audit, the page extraction and the conversation trie against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from causeway.llm import divergence, pages, registry, trie

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


# Divergence


def audited(rows, least):
    own, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        own[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        sources = sorted(s for at, s in groups if at == lang)
        n = {s: sum(own[lang, s][t] for t in kept) for s in sources}
        share = lambda count, total: 1 + 10**9 * (count + 5) // (total + 5 * len(kept))  # noqa: E731, B023
        p = {(s, t): share(own[lang, s][t], n[s]) for s in sources for t in kept}
        q = {t: share(sum(own[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s, t] - p[o, t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s, t] - q[t]) for t in kept if own[lang, s][t] and p[s, t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < 50]
    return sorted(out)


def test_source_divergence(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "abcdé" for b in "xyzÜ" for c in "mnoß"]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    rows = [(prose(rng.randint(0, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])) for _ in range(160)]
    rows += [(None, "en", "silent"), ("", "fr", "a"), ("rare words only", "fr", "b"), ("x1y2 ABC abc d", "only", "one"), ("A" * 3000 + " b_c", "en", "a")] + [rows[0]] * 5
    rows.append((" ".join(vocabulary) * 400, "de", "a"))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string").repartition(4)
    names = ["lang", "source", "part", "item", "value", "rank"]
    monkeypatch.setattr(divergence, "SHARD_TERMS", 7)
    for least in (3, 30, 10_000):
        assert sorted(map(tuple, divergence.audit(df, least_docs=least).select(names).collect())) == audited(rows, least)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "SLICE", 200)
    monkeypatch.setattr(divergence, "FOLDED", 40)
    counts = divergence.term_counts(df.select("lang", "source", "text").na.fill(""))
    total = Counter()
    for r in counts.collect():
        total[r.lang, r.source, r.term] += r.n
    want = Counter((lang or "", source or "", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for text, lang, source in rows for t in TERM.findall(text or ""))
    assert total == want
    assert divergence.audit(df.where("false")).count() == 0


# Pages

BODY = ["Title & more", "First paragraph of the story, with some words in it to be long enough.", "Second one — with a line break and a link.", "Third 3 < 4 paragraph that closes the story."]
INNER = "<h1>Title &amp; more</h1><p><b>First paragraph of the story,\n with&nbsp;some words in it to be long enough.</b><br><p>Second one &mdash; with a<br>line break and a <a href='/x?a=\">\"'>link</a>.<script>var a='<p>no</p>';</script></p><p>Third 3 &lt; 4 <!-- <p>gone</p> --> paragraph that closes the story."
MENU = "<ul class=menu-top><li><a href=/a>Home</a><li><a href=/b>News and more news</a></ul>"
COMMENTS = "<section class='comments'><h2>Comments</h2>" + "<article class='comment'><p>" + "I think that this is a very long comment of a reader about the story. " * 9 + "</p></article></section>"
LAYOUTS = {
    "article": f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body><nav>{MENU}</nav><div class='ad'>Buy this!</div><article>{INNER}</article>{COMMENTS}<footer>&copy; all</footer>",
    "classes": f"<html><body><div id=header><p>Site name and slogan</p></div><div class='wrap has-sidebar'><div class='col-8'><div class='post post-17'>{INNER}</div>{COMMENTS}</div><div class='sidebar'><p>Popular stories on this site are listed here.</p></div></div><div class='cookie-notice'>We use cookies.</div></body></html>",
    "unnamed": f"<body><table><tr><td class=c1>{MENU}<td class='c2'>{INNER}<td class=c3><p>Weather</p></table><form><p>Sign in with your name and your password</p><input name=a></form></body>",
    "inside": f"<body><main><article><aside><p>Read this too, it is a long advertisement text.</p></aside><div class='promoBox'>Sale</div>{INNER}<div class=share-buttons>Share</div></article></main><div role=alert>Old browser!</div><div hidden>secret text</div><div style='display:none'>gone text</div>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    all_ = pages.parse(LAYOUTS[name])
    path = "/".join(pages.container(all_).path())
    assert pages.main_text(LAYOUTS[name], path).split("\n") == BODY
    assert pages.main_text(LAYOUTS[name], None).split("\n") == BODY


def test_consensus_of_hosts(spark):
    long = lambda i: f"<p>Story number {i} has a paragraph that is long enough to be found.</p>"
    aside = "<div class=more>" + "<p>A list of other things that stands on each page and has a good many words in it.</p>" * 2 + "</div>"
    page = lambda i, body: f"<body><div class=top>Top</div><div class='b{100 + i}'>{body}</div>{aside}</body>"
    rows = [(i, f"http://A.example/{i}", page(i, long(i) * 9), 0) for i in range(6)]
    rows += [(6, "http://a.example/6?x", page(6, "<p>Short.</p>"), 0), (7, None, "<p>alone</p>", 0), (8, "no host", "", 0), (9, "http://b.example", None, 0), (10, "http://c.example/#", page(10, "<p>Short.</p>"), 0), (11, "http://a.example", "<b>other", 0), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page int").repartition(3)
    got = sorted((r.page_id, r.page_.text, r.page_.n_chars) for r in pages.extract(df).collect())
    want = [(i, "\n".join(["Story number %d has a paragraph that is long enough to be found." % i] * 9)) for i in (0, *range(6))]
    want += [(6, "Short."), (7, "alone"), (8, ""), (9, ""), (10, "\n".join(["A list of other things that stands on each page and has a good many words in it."] * 2)), (11, "other")]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert pages.extract(df.where("false")).count() == 0


def test_malformed_and_long_pages():
    for html in ("<", "<p", "<p>a<", "<!--", "<script>", "</p>", "<a href='", "&#0;&#x110000;", "<li><li>x</ul></ol>", "<td>x<tr>y"):
        pages.main_text(html, None)
    assert pages.main_text("<body>" + "<div>" * 3000 + "deep" + "<p>x" * 3000, None).startswith("deep\nx\nx")
    assert len(pages.main_text("<article>" + "<p>" + "word " * 400_000, None)) == 5 * 400_000 - 1


def test_pages_of_the_tables_hold_their_documents(spark):
    at = "/root/testdata/sf0.01"
    squeezed = lambda t: " ".join((t or "").split())
    documents = {squeezed(r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("text").collect()}
    got = registry.op12_html_extraction(spark, at).collect()
    assert len(got) == spark.read.parquet(f"{at}/pages.parquet").count()
    for r in got:
        title, _, body = r.text.partition("\n")
        assert squeezed(body) in documents and squeezed(body).startswith(title[:40]) and r.n_chars == len(r.text)


# Trie


def built(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(abs(c) % 100 * (1 if c > 0 else -1))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    digest = lambda n: hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), children[n], leaves[n], saved[n], digest(n)) for n, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(COLUMNS).collect())


def test_conversation_trie(spark, monkeypatch):
    rng = random.Random(3)
    say = lambda k: rng.choice(["", "hi", "né " * 3, "yes", "no"]) + str(rng.randint(0, k))
    rows = []
    for c in [*range(190, 320), *range(-105, -95), *range(3), 5000]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), say(1)) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "copy") for c in range(400, 460) for t in range(8)] + [(c, t, "user", "deep") for c in (501, 502) for t in range(30)] + [(502, 30, "user", None)]
    rows += [(600, None, "user", "first"), (600, 1, None, None), (600, 1, "b", "tie"), (600, 1, "a", "tie"), (600, 1, "a", "tie"), (None, 1, "user", "lost"), (-250, 4, "system", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn int, role string, text string, seq int, parent string").repartition(5)
    monkeypatch.setattr(trie, "HELD", 30)
    assert rows_of(trie.trie(df)) == built(rows)
    assert trie.trie(df.where("false")).count() == 0
    assert rows_of(trie.trie(df.where("conv_id = 600"))) == built([r for r in rows if r[0] == 600])
