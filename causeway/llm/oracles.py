"""DuckDB SQL that gives the same rows as the queries of registry.py."""

from __future__ import annotations

from causeway.llm import divergence, jaccard, quality, urls

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules(documents: str = "documents", columns: str = "") -> str:
    """The rows of op7; columns: more columns of documents to carry."""
    lengths = sorted(quality.NGRAM_LIMITS)
    spans = ", ".join(
        f"coalesce(max(CASE WHEN d{n} > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) AS c{n}" for n in (3, *lengths)
    )
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(1, max(lengths)))
    grams = ", ".join(f"w || ' ' || " + " || ' ' || ".join(f"w{k}" for k in range(1, n)) + f" AS g{n}" for n in (3, *lengths))
    counts = ", ".join(f"CASE WHEN g{n} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, g{n}) END AS d{n}" for n in (3, *lengths))
    dups = ", ".join(f"CAST(coalesce(sum(c{n} * length(w)), 0) AS BIGINT) AS dup_chars_n{n}" for n in lengths)
    zeros = ", ".join(f"coalesce(dup_chars_n{n}, 0) AS dup_chars_n{n}" for n in lengths)
    within = " AND ".join(f"100 * dup_chars_n{n} <= {limit} * word_chars" for n, limit in sorted(quality.NGRAM_LIMITS.items()))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM {documents}),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
x AS (SELECT *, {leads} FROM w),
h AS (SELECT doc_id, i, w, {grams} FROM x),
g AS (SELECT doc_id, i, w, {counts} FROM h),
c AS (SELECT doc_id, w, {spans} FROM g),
a AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, CAST(sum(c3) AS BIGINT) AS n_repeat_words, {dups} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '{WORD}')),
m AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS BIGINT) AS dup_line_chars FROM r WHERE k > 1 GROUP BY doc_id),
t AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {zeros}
  FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM t)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {quality.LINE_LIMIT} * word_chars AND 100 * n_symbols <= {quality.SYMBOL_LIMIT} * n_words AND {within} AS kept FROM f"""


def url_filters() -> str:
    """The rows of op10."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urls.RULES)
    return f"""
WITH rules(v, h, p) AS (VALUES {rules}),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, row_number() OVER () AS k FROM r),
m AS (SELECT s.k, arg_max(h || p, (length(h || p), length(h))) AS rule, arg_max(v, (length(h || p), length(h))) AS verdict
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY s.k)
SELECT page_id, host, path, rule, coalesce(verdict, '{urls.DEFAULT}') AS verdict FROM s LEFT JOIN m ON m.k = s.k"""


def warc_records() -> str:
    """The rows of op2."""
    return """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


def exact_top_k() -> str:
    """The rows of op8."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.e, p.e) AS BIGINT) AS score FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def ngram_jaccard() -> str:
    """The rows of op6."""
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(1, jaccard.SHINGLE))
    gram = "w || ' ' || " + " || ' ' || ".join(f"w{k}" for k in range(1, jaccard.SHINGLE))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {gram} AS g FROM (SELECT *, {leads} FROM w)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {jaccard.SHINGLE - 1}) WHERE g IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {jaccard.PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS doc, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM d JOIN r ON r.doc = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def source_divergence() -> str:
    """The rows of op11."""
    d = divergence
    share = lambda n, total: f"CAST(1 + CAST({d.SCALE} AS HUGEINT) * ({n} + {d.SMOOTHING}) // ({total} + {d.SMOOTHING} * v.v) AS BIGINT)"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
  regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT lang, source, k, unnest(terms) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {d.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM t GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT m.lang, m.source, t.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "m.total")} AS p, {share("t.n", "v.n")} AS q
  FROM m JOIN t ON t.lang = m.lang JOIN v ON v.lang = m.lang LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = t.term),
a AS (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
f AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(a.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.other = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= {d.TOP_TERMS}"""


def conversation_trie() -> str:
    """The rows of op13; crc32 is reckoned bit by bit."""
    # Fixed value: the polynomial of CRC-32, 0xEDB88320.
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return f"""
WITH RECURSIVE s AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM s),
crc AS (SELECT conv_id, name, 0 AS i, CAST(4294967295 AS BIGINT) AS x FROM k UNION ALL
  SELECT conv_id, name, i + 1, CASE WHEN i % 9 = 0 THEN xor(x, CAST(unicode(substr(name, i // 9 + 1, 1)) AS BIGINT)) ELSE {step} END FROM crc WHERE i < 9 * length(name)),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(x, 4294967295) % 6 AS h FROM crc WHERE i = 9 * length(name)),
f AS (SELECT conv_id, pos AS k, role, text, 0 AS own FROM h JOIN (SELECT conv_id AS base, pos, role, text FROM s) USING (base) WHERE pos <= h
  UNION ALL SELECT conv_id, pos, role, text, 1 FROM s JOIN h USING (conv_id) WHERE pos > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth, sha256(length(role) || ':' || role || ':' || text) AS token, length(text) AS chars FROM f),
p AS (SELECT conv_id, depth, chars, sha256(string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
q AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS last, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM p),
n AS (SELECT node, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM q GROUP BY node),
c AS (SELECT above AS node, count(*) AS n_children FROM n GROUP BY above),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.node = n.node),
u AS (SELECT q.node, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.node)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN u ON u.node = m.node LEFT JOIN m o ON o.node = m.above"""


def sql() -> dict[str, str]:
    return {"op2_warc": warc_records(), "op6_ngram_jaccard_join": ngram_jaccard(), "op7_quality_rules": quality_rules(), "op8_exact_top_k": exact_top_k(), "op10_url_filters": url_filters(), "op11_source_divergence": source_divergence(), "op13_conversation_trie": conversation_trie()}
