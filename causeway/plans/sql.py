"""DuckDB SQL for the queries of queries.py, over the same tables."""

from __future__ import annotations

import itertools
import math
from dataclasses import asdict

from causeway.plans.config import CANDIDATES

W, TRAIN, LEAST = 20, 756, 100

BARS = """bars AS (SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS session,
  arg_min(p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open, max(p) AS high, min(p) AS low,
  CAST(sum(cents) AS DOUBLE) / (100 * sum(l_quantity)) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, cents / (100 * l_quantity) AS p FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)) GROUP BY 1, 2)"""
M = f"""{BARS},
m AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY session) - 1 AS BIGINT) AS idx FROM bars
  WHERE session IN (SELECT session FROM bars WHERE ticker IN ('A', 'N', 'R') GROUP BY session HAVING count(DISTINCT ticker) = 3) AND ticker IN ('A', 'N', 'R'))"""
RET = f"""{M},
r AS (SELECT *, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY session), 0) AS ret, ln(close / open) AS intraday,
  (high - low) / close AS rng, ln(1 + volume) AS logvol FROM m)"""
A = f"{RET}, a AS (SELECT * FROM r WHERE ticker = 'A')"
SAMPLES = f"""{RET},
s AS (SELECT * FROM (SELECT *, lead(session) OVER w AS target_date, ln(lead(close) OVER w) - ln(close) AS target FROM r WINDOW w AS (PARTITION BY ticker ORDER BY session)) WHERE target_date IS NOT NULL),
nv AS (SELECT ticker, idx, session AS issue_date, target_date, target AS actual_return, ret AS predicted_return FROM s WHERE idx > 0)"""
#: Rows of the windows of every issue, the oldest at pos 0.
WINDOWS = f"win AS (SELECT i.ticker, i.idx AS issue, r.idx - i.idx + {W - 1} AS pos, r.session, r.close, r.ret, r.rng FROM r i JOIN r ON r.ticker = i.ticker AND r.idx BETWEEN i.idx - {W - 1} AND i.idx WHERE i.idx >= {W - 1})"
BRANDS = """bb AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS session, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (100 * sum(l_quantity)) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
br AS (SELECT session, CASE WHEN abs(q) < 0.7 THEN q END AS q FROM (SELECT session, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session)) AS q FROM bb)),
bn AS (SELECT session, greatest(count(q), 1) AS n, count(q) AS c, coalesce(sum(q), 0) AS s1, coalesce(sum(q * q), 0) AS s2, count(*) FILTER (q > 0) AS up FROM br GROUP BY session),
breadth AS (SELECT session, s1 / n AS breadth_mean, sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)) AS breadth_sd, CAST(up AS DOUBLE) / n AS breadth_up, ln(1 + c) AS breadth_log_n FROM bn)"""
PANEL = f"""{RET}, {BRANDS},
wide AS (SELECT session, max(idx) AS idx, max(ret) FILTER (ticker = 'A') AS ret, max(ret) FILTER (ticker = 'N') AS N_ret, max(ret) FILTER (ticker = 'R') AS R_ret, max(rng) FILTER (ticker = 'A') AS A_range FROM r GROUP BY session),
panel AS (SELECT wide.*, coalesce(breadth_mean, 0) AS breadth_mean FROM wide LEFT JOIN breadth USING (session))"""
FRAME = f"ROWS BETWEEN {TRAIN} PRECEDING AND 1 PRECEDING"
HALF = "hf AS (SELECT ticker, CAST(floor(max(idx) / 2) AS BIGINT) AS half FROM nv GROUP BY ticker)"
CDF = f"""{SAMPLES}, {HALF},
test AS (SELECT nv.* FROM nv JOIN hf USING (ticker) WHERE idx > half), cal AS (SELECT ticker, predicted_return AS v FROM nv JOIN hf USING (ticker) WHERE idx <= half),
pct AS (SELECT test.*, (SELECT CAST(count(*) FILTER (v < predicted_return) + count(*) FILTER (v <= predicted_return) AS DOUBLE) / (2 * count(*)) FROM cal WHERE cal.ticker = test.ticker) AS percentile FROM test),
alloc AS (SELECT *, 0.2::DOUBLE + (0.8::DOUBLE - 0.2::DOUBLE) * percentile AS allocation FROM pct)"""


def r6(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + CAST(0 AS DOUBLE)"


def corr(x: str, y: str, over: str = "") -> str:
    a = lambda e: f"avg({e}){over}"
    vx, vy = (f"greatest({a(f'{v} * {v}')} - {a(v)} * {a(v)}, 0)" for v in (x, y))
    n = f"count(*){over}"
    return f"CASE WHEN sqrt({vx} * {n}) <= 1e-10 OR sqrt({vy} * {n}) <= 1e-10 THEN 0 ELSE greatest(-1, least(1, ({a(f'{x} * {y}')} - {a(x)} * {a(y)}) / (sqrt({vx}) * sqrt({vy})))) END"


def signature(depth: int) -> str:
    """The window form: level k is a sum over segments of the lower levels before it times powers of its increment."""
    name = lambda w: "".join(map(str, w))
    power = lambda w: "(" + " * ".join(f"d{i}" for i in w) + f" / CAST({math.factorial(len(w))} AS DOUBLE))"
    steps = [WINDOWS, f"w AS (SELECT ticker, issue, CAST(pos AS DOUBLE) / CAST({W - 1} AS DOUBLE) AS x1, ln(close) AS x2, pos FROM win)",
             "l0 AS (SELECT * FROM (SELECT ticker, issue, pos, x1 - lag(x1) OVER (PARTITION BY ticker, issue ORDER BY pos) AS d1, x2 - lag(x2) OVER (PARTITION BY ticker, issue ORDER BY pos) AS d2 FROM w) WHERE d1 IS NOT NULL)"]
    for k in range(1, depth + 1):
        words = list(itertools.product((1, 2), repeat=k))
        terms = ", ".join(" + ".join([power(w), *(f"p{name(w[:e])} * {power(w[e:])}" for e in range(1, k))]) + f" AS t{name(w)}" for w in words)
        sums = ", ".join(f"coalesce(sum(t{name(w)}) OVER (PARTITION BY ticker, issue ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p{name(w)}" for w in words)
        steps += [f"e{k} AS (SELECT *, {terms} FROM l{k - 1})", f"l{k} AS (SELECT *, {sums} FROM e{k})"]
    every = [name(w) for k in range(1, depth + 1) for w in itertools.product((1, 2), repeat=k)]
    return f"WITH {RET}, {', '.join(steps)} SELECT ticker, issue, {', '.join(f'{r6(f"sum(t{w})")} AS s{w}' for w in every)} FROM l{depth} GROUP BY ticker, issue"


def ledger(rows: str = "") -> str:
    source = "expm1_ AS (SELECT *, exp(actual_return) - 1 AS x FROM alloc)" if not rows else rows
    return f"""WITH {CDF}, {source},
st AS (SELECT ticker, idx, issue_date, x, 'percentile' AS strategy, allocation FROM expm1_ UNION ALL SELECT ticker, idx, issue_date, x, 'half', CAST(0.5 AS DOUBLE) FROM expm1_ UNION ALL SELECT ticker, idx, issue_date, x, 'hold', CAST(1 AS DOUBLE) FROM expm1_),
w AS (SELECT *, allocation * x AS pr, CAST(100 AS DOUBLE) * product(1 + allocation * x) OVER (PARTITION BY ticker, strategy ORDER BY idx ROWS UNBOUNDED PRECEDING) AS wealth FROM st),
led AS (SELECT *, lag(wealth, 1, CAST(100 AS DOUBLE)) OVER (PARTITION BY ticker, strategy ORDER BY idx) AS wealth_before, wealth / greatest(100, max(wealth) OVER (PARTITION BY ticker, strategy ORDER BY idx ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM w)"""


PERFORMANCE = f"""ticker, strategy, count(*) AS sessions, {r6('ln(arg_max(wealth, idx))')} AS log_final_wealth, {r6('-100 * min(drawdown)')} AS max_drawdown_pct,
  {r6('CASE WHEN count(*) > 1 AND stddev_samp(pr) > 1e-15 THEN sqrt(CAST(252 AS DOUBLE)) * avg(pr) / stddev_samp(pr) END')} AS annualized_sharpe_rf0"""
OPEN = "expm1_ AS (SELECT alloc.ticker, alloc.idx, issue_date, allocation, r.close / r.open - 1 AS x FROM alloc JOIN r ON r.ticker = alloc.ticker AND r.session = target_date)"
DIRECTION = f"""{M},
pd AS (SELECT * FROM (SELECT ticker, idx, lag(session) OVER w AS previous_session_date, session AS issue_date, lead(session) OVER w AS target_date,
  CASE WHEN ln(close / lag(close) OVER w) > 0 THEN 'UP' ELSE 'DOWN' END AS predicted_direction, CASE WHEN ln(lead(close) OVER w / close) > 0 THEN 'UP' ELSE 'DOWN' END AS actual_direction
  FROM m WINDOW w AS (PARTITION BY ticker ORDER BY session)) WHERE previous_session_date IS NOT NULL AND target_date IS NOT NULL),
dd AS (SELECT *, predicted_direction = actual_direction AS correct FROM pd)"""
NAMES = ("N_ret", "R_ret", "A_range")
SCREEN = f"""{PANEL},
sc AS (SELECT idx, session, count(*) OVER w AS train_n, {', '.join(f"CASE WHEN count(*) OVER w >= {LEAST} THEN {corr(f, 'ret', ' OVER w')} END AS corr_{f}" for f in NAMES)}
  FROM panel WINDOW w AS (ORDER BY idx {FRAME}))"""


HELD_OUT = f"""WITH {SAMPLES}, h AS (SELECT ticker, count(*) AS n, avg(abs(actual_return - predicted_return)) AS mae, sqrt(avg((actual_return - predicted_return) * (actual_return - predicted_return))) AS rmse, avg(abs(actual_return)) AS zero,
avg(CAST((predicted_return > 0) = (actual_return > 0) AS DOUBLE)) AS hits, avg(CAST(actual_return > 0 AS DOUBLE)) AS ups, avg(CAST(predicted_return > 0 AS DOUBLE)) FILTER (actual_return > 0) AS up_hits, avg(CAST(predicted_return <= 0 AS DOUBLE)) FILTER (actual_return <= 0) AS down_hits
FROM nv WHERE issue_date > DATE '1997-01-01' GROUP BY ticker)"""


def gram() -> str:
    names = [*NAMES, "ret"]
    mean = lambda x: f"sum(w * {x}) / sum(w)"
    z = ", ".join(f"greatest(-8, least(8, ({f} - m_{f}) / greatest(sqrt(greatest(q_{f} - m_{f} * m_{f}, 0)), 1e-5))) AS z_{f}" for f in NAMES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:] if a != "ret"]
    rows = " UNION ALL ".join(f"SELECT '{a}' AS i, '{'target' if b == 'ret' else b}' AS j, {r6(f'{mean(f"z_{a} * z_{b}")} - ({mean(f"z_{a}")}) * ({mean(f"z_{b}")})')} AS value FROM z" for a, b in pairs)
    return f"""WITH {PANEL}, pw AS (SELECT *, exp(-abs(ret)) AS w FROM panel),
f AS (SELECT {', '.join(f'{mean(n)} AS m_{n}' for n in names)}, {', '.join(f'{mean(f"{n} * {n}")} AS q_{n}' for n in NAMES)} FROM pw),
z AS (SELECT w, {z}, ret - m_ret AS z_ret FROM pw, f) {rows}"""


def scores() -> str:
    part = lambda a, b: r6(f"CAST({a} AS DOUBLE) / nullif({b}, 0)")
    return f"""WITH {SAMPLES},
d AS (SELECT *, CASE WHEN predicted_return > 1e-4 THEN 1 WHEN predicted_return <= -1e-4 THEN -1 ELSE 0 END AS said, actual_return > 0 AS up, actual_return - predicted_return AS e FROM nv),
c AS (SELECT ticker, count(*) AS n, count(*) FILTER (up) AS u, count(*) FILTER (NOT up) AS dn, count(*) FILTER (said = 1) AS pu, count(*) FILTER (said = -1) AS pdn, count(*) FILTER (said = 0) AS ne,
  count(*) FILTER (said = 1 AND up) AS cu, count(*) FILTER (said = -1 AND NOT up) AS cd, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(actual_return)) AS zmae FROM d GROUP BY ticker)
SELECT ticker, n, u AS actual_up_days, dn AS actual_down_days, pu AS predicted_up_days, pdn AS predicted_down_days, ne AS neutral_days, cu AS correct_up_days, cd AS correct_down_days,
  {r6('mae')} AS return_mae, {r6('rmse')} AS return_rmse, {r6('zmae')} AS zero_return_mae, {part('(cu + cd)', 'n')} AS accuracy, {part('cu', 'u')} AS up_recall, {part('cd', 'dn')} AS down_recall,
  {part('cu', 'pu')} AS up_precision, {part('cd', 'pdn')} AS down_precision, {part('greatest(u, dn)', 'n')} AS majority_accuracy, {part('pu', 'n')} AS predicted_up_rate, {part('pdn', 'n')} AS predicted_down_rate,
  {part('ne', 'n')} AS neutral_rate, {part('u', 'n')} AS actual_up_rate, {r6('(CAST(cu AS DOUBLE) / nullif(u, 0) + CAST(cd AS DOUBLE) / nullif(dn, 0)) / 2')} AS balanced_accuracy FROM c"""


#: Vectors of the modalities of each session; the tables of the news come from oracles().
MODAL_WINDOW, UPPER = 40, ("Brand#11", "Brand#12")


def price_features() -> str:
    """px: idx, session and the list of the 16 price features."""
    tickers, finite = ("A", "N", "R"), lambda e: f"coalesce({e}, 0)"
    ret = lambda c: finite(f"ln({c} / lag({c}) OVER o)")
    cells = [*(ret(f"close_{t}") for t in tickers), *(finite(f"close_{t} / open_{t} - 1") for t in tickers)]
    for i in range(len(UPPER)):
        cells += [ret(f"u{i}.close"), finite(f"(u{i}.high - u{i}.low) / u{i}.close"), finite(f"ln(1 + u{i}.volume)")]
    cells += [finite(c) for c in ("breadth_mean", "breadth_sd", "breadth_up", "breadth_log_n")]
    joins = " ".join(f"LEFT JOIN bo u{i} ON u{i}.symbol = '{u}' AND u{i}.session = pw.session" for i, u in enumerate(UPPER))
    picks = ", ".join(f"max(close) FILTER (ticker = '{t}') AS close_{t}, max(open) FILTER (ticker = '{t}') AS open_{t}" for t in tickers)
    return f"""{A}, {BRANDS}, pw AS (SELECT idx, session, {picks} FROM m GROUP BY 1, 2),
bo AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS session, max(cents / (100 * l_quantity)) AS high, min(cents / (100 * l_quantity)) AS low, CAST(sum(cents) AS DOUBLE) / (100 * sum(l_quantity)) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
px AS (SELECT pw.idx, pw.session, [{', '.join(f'CAST({c} AS DOUBLE)' for c in cells)}] AS v FROM pw {joins} LEFT JOIN breadth ON breadth.session = pw.session WINDOW o AS (ORDER BY pw.idx))"""


def modalities(tokens: str, digest: str) -> str:
    """l: idx, session, modality, known, width, k and x of every element of every session's vectors."""
    zeros = lambda n: f"(SELECT list(CAST(0 AS DOUBLE)) FROM range({n}))"
    carry = lambda source, symbols: f"""SELECT idx, symbol, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING) AS v
  FROM (SELECT a.idx, c.symbol, d.v FROM a CROSS JOIN (SELECT DISTINCT {symbols}) c LEFT JOIN {source} d ON d.idx = a.idx AND d.symbol = c.symbol)"""  # noqa: E731
    return f"""{price_features()},
nd AS (SELECT row_number() OVER () AS r, text, CAST(DATE '1998-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS event_date FROM documents WHERE length(text) > 0),
nn AS (SELECT r, text, idx FROM nd ASOF JOIN a ON nd.event_date < a.session WHERE idx > 0), nt AS (SELECT r, {digest} AS h FROM (SELECT r, unnest({tokens}) AS token FROM nn)),
nk AS (SELECT r, CAST(h % 32 AS INTEGER) AS k, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM nt GROUP BY 1, 2), nu AS (SELECT r, greatest(sqrt(sum(x * x)), 1) AS norm FROM nk GROUP BY r),
np AS (SELECT idx, k, sum(x / norm) AS s FROM nk JOIN nu USING (r) JOIN nn USING (r) GROUP BY 1, 2), nc AS (SELECT idx, count(*) AS docs, avg(least(length(text), 5000) / CAST(5000 AS DOUBLE)) AS mean_length FROM nn GROUP BY 1),
news AS (SELECT nc.idx, list(coalesce(s, 0) / docs ORDER BY b.k) || [ln(1 + any_value(docs)), any_value(mean_length)] AS v FROM nc CROSS JOIN range(32) b(k) LEFT JOIN np ON np.idx = nc.idx AND np.k = b.k GROUP BY 1),
fo AS (SELECT c_nationkey AS symbol, CAST(o_orderdate AS DATE) AS event_date, o_orderkey AS pos, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
fd AS (SELECT symbol, a.idx, arg_max(v, pos) AS v FROM fo ASOF JOIN a ON fo.event_date < a.session GROUP BY ALL), fg AS ({carry('fd', 'c_nationkey AS symbol FROM customer')}),
filed AS (SELECT idx, [avg(v), CAST(count(v) AS DOUBLE) / count(*)] AS v FROM fg GROUP BY idx HAVING count(v) > 0),
io AS (SELECT label AS symbol, vec_id, embedding, CAST(DATE '1998-01-01' + CAST(vec_id % 365 AS INTEGER) AS DATE) AS event_date FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
dr AS (SELECT symbol, a.idx, arg_max(embedding, vec_id) AS v FROM io ASOF JOIN a ON io.event_date < a.session GROUP BY ALL), dg AS ({carry('dr', 'symbol FROM io')}),
du AS (SELECT idx, k, avg(x) AS x FROM (SELECT idx, unnest(range(len(v))) AS k, CAST(unnest(v) AS DOUBLE) AS x FROM dg WHERE v IS NOT NULL) GROUP BY 1, 2), dc AS (SELECT idx, CAST(count(v) AS DOUBLE) / count(*) AS c FROM dg GROUP BY idx),
drawn AS (SELECT idx, list(x ORDER BY k) || [any_value(c)] AS v FROM du JOIN dc USING (idx) GROUP BY idx),
mv AS (SELECT idx, session, 'price' AS modality, 1 AS known, v FROM px UNION ALL
  {' UNION ALL '.join(f"SELECT a.idx, a.session, '{name}', CASE WHEN v IS NULL THEN 0 ELSE 1 END, coalesce(v, {zeros(n)}) FROM a LEFT JOIN {t} ON {t}.idx = a.idx" for name, t, n in (('news', 'news', 34), ('table', 'filed', 2), ('image', 'drawn', 65)))}),
l AS (SELECT idx, session, modality, CAST(known AS INTEGER) AS known, CAST(len(v) AS BIGINT) AS width, CAST(unnest(range(len(v))) AS INTEGER) AS k, unnest(v) AS x FROM mv)"""


def modality_windows(tokens: str, digest: str) -> str:
    n = MODAL_WINDOW
    up = ", ".join(f"CAST(lead(close_{t}) OVER (ORDER BY idx) > close_{t} AS INTEGER) AS up_{t}" for t in "ANR")
    return f"""WITH {modalities(tokens, digest)}, wi AS (SELECT i.idx AS issue, p.pos, l.* FROM a i CROSS JOIN range({n}) p(pos) JOIN l ON l.idx = i.idx - {n - 1} + p.pos WHERE i.idx >= {n - 1}),
mo AS (SELECT modality, k, avg(x) AS mean, greatest(stddev_pop(x), 1e-4) AS sd FROM wi WHERE modality <> 'image' AND issue <= (SELECT max(idx) * 8 // 10 FROM a) GROUP BY 1, 2),
z AS (SELECT issue, pos, wi.modality, width, known, wi.k, CASE WHEN mo.sd IS NULL THEN x ELSE greatest(-8, least(8, (x - mean) / sd)) END AS z FROM wi LEFT JOIN mo ON mo.modality = wi.modality AND mo.k = wi.k),
lb AS (SELECT idx, session, {up} FROM pw)
SELECT issue, session, up_A, up_N, up_R, modality, width, CAST(sum(known) FILTER (k = 0) AS BIGINT) AS known, {r6(f'avg(z) FILTER (pos = {n - 1})')} AS newest, {r6('sum((pos + 1) * (k + 1) * z) / sum((pos + 1) * (k + 1))')} AS weighted
FROM z JOIN lb ON lb.idx = issue WHERE up_A IS NOT NULL GROUP BY ALL"""


def oracles() -> dict[str, str]:
    tokens = "regexp_extract_all(substr(lower(text), 1, 5000), '[a-z]{3,}')"
    digest = "CAST('0x' || substr(md5(token), 1, 8) AS BIGINT)"
    freq = " UNION ALL ".join(f"SELECT '{n}' AS factor FROM sc WHERE train_n >= {LEAST} AND abs(corr_{n}) >= 0.05" for n in NAMES)
    four = [*NAMES, "breadth_mean"]
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r6(corr(a, b))} AS corr FROM panel" for i, a in enumerate(four) for b in four[i + 1 :])
    return {
        "bars_daily": f"WITH {BARS} SELECT * FROM bars",
        "aligned_sessions": f"WITH {M} SELECT session, {', '.join(f'''max({c}) FILTER (ticker = '{t}') AS "{t}_{c}"''' for t in 'ANR' for c in ('open', 'close'))} FROM m GROUP BY session",
        "log_returns": f"WITH {RET} SELECT ticker, session, {r6('ret')} AS ret FROM r",
        "intraday_returns": f"WITH {RET} SELECT ticker, session, {r6('intraday')} AS intraday, {r6('close / open - 1')} AS gap FROM r",
        "rolling_vol20": f"WITH {RET} SELECT ticker, session, {r6('CASE WHEN count(*) OVER w >= 5 THEN stddev_samp(ret) OVER w ELSE 0 END')} AS vol FROM r WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
        "high_low_range_logvol": f"WITH {RET} SELECT ticker, session, {r6('rng')} AS rng, {r6('logvol')} AS logvol FROM r",
        "market_breadth": f"WITH {BRANDS} SELECT session, {', '.join(f'{r6(c)} AS {c}' for c in ('breadth_mean', 'breadth_sd', 'breadth_up', 'breadth_log_n'))} FROM breadth",
        "next_up_label": f"WITH {M} SELECT ticker, session, CAST(coalesce(lead(close) OVER (PARTITION BY ticker ORDER BY session) > close, false) AS INTEGER) AS up FROM m",
        "asof_next_session": f"WITH {A}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS event_date FROM orders) SELECT o.*, a.session, a.idx FROM o ASOF JOIN a ON o.event_date < a.session",
        "filing_panel_locf": f"""WITH {A}, o AS (SELECT c_nationkey AS symbol, CAST(o_orderdate AS DATE) AS event_date, o_orderkey AS pos, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT symbol, a.idx, arg_max(v, pos) AS v FROM o ASOF JOIN a ON o.event_date < a.session GROUP BY ALL),
g AS (SELECT idx, session, symbol, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT a.idx, a.session, c.symbol, d.v FROM a CROSS JOIN (SELECT DISTINCT c_nationkey AS symbol FROM customer) c LEFT JOIN d ON d.idx = a.idx AND d.symbol = c.symbol))
SELECT idx, session, {r6('avg(v)')} AS mean_fact, {r6('CAST(count(v) AS DOUBLE) / count(*)')} AS coverage FROM g GROUP BY idx, session""",
        "latest_fact": "SELECT o_custkey AS symbol, arg_max(o_totalprice, row(CAST(o_orderdate AS DATE), -o_orderkey)) AS val, strftime(max(o_orderdate), '%Y-%m-%d') AS \"end\" FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-30' GROUP BY 1",
        "props_json": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
        "text_hash_md5": f"WITH t AS (SELECT lang, unnest({tokens}) AS token FROM documents), h AS (SELECT lang, {digest} AS h FROM t) SELECT lang, CAST(h % 32 AS INTEGER) AS bucket, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS BIGINT) AS value, count(*) AS tokens FROM h GROUP BY 1, 2",
        "sql_hash_text": f"""WITH t AS (SELECT doc_id, {digest} AS h FROM (SELECT doc_id, unnest({tokens}) AS token FROM documents)),
v AS (SELECT doc_id, CAST(h % 32 AS INTEGER) AS k, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM t GROUP BY 1, 2), u AS (SELECT doc_id, greatest(sqrt(sum(x * x)), 1) AS norm FROM v GROUP BY 1)
SELECT d.doc_id, CAST(b.k AS INTEGER) AS k, {r6('coalesce(x / norm, 0)')} AS value FROM documents d CROSS JOIN range(32) b(k) LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id AND v.k = b.k""",
        "sql_signature": signature(2),
        "news_panel": f"""WITH {A}, d AS (SELECT text, CAST(DATE '1998-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS event_date FROM documents WHERE length(text) > 0)
SELECT idx, session, {r6('ln(1 + count(*))')} AS log_n, {r6('avg(least(length(text), 5000) / CAST(5000 AS DOUBLE))')} AS mean_length FROM d ASOF JOIN a ON d.event_date < a.session WHERE idx > 0 GROUP BY 1, 2""",
        "news_panel_features": f"""WITH {A}, d AS (SELECT row_number() OVER () AS r, text, CAST(DATE '1998-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS event_date FROM documents WHERE length(text) > 0),
n AS (SELECT r, text, idx, session FROM d ASOF JOIN a ON d.event_date < a.session WHERE idx > 0), t AS (SELECT r, {digest} AS h FROM (SELECT r, unnest({tokens}) AS token FROM n)),
v AS (SELECT r, CAST(h % 32 AS INTEGER) AS k, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM t GROUP BY 1, 2), u AS (SELECT r, greatest(sqrt(sum(x * x)), 1) AS norm FROM v GROUP BY r),
p AS (SELECT idx, k, sum(x / norm) AS s FROM v JOIN u USING (r) JOIN n USING (r) GROUP BY 1, 2),
c AS (SELECT idx, session, count(*) AS docs, avg(least(length(text), 5000) / CAST(5000 AS DOUBLE)) AS mean_length FROM n GROUP BY 1, 2)
SELECT c.idx, session, CAST(b.k AS INTEGER) AS k, {r6('coalesce(s, 0) / docs')} AS value FROM c CROSS JOIN range(32) b(k) LEFT JOIN p ON p.idx = c.idx AND p.k = b.k
UNION ALL SELECT idx, session, 32, {r6('ln(1 + docs)')} FROM c UNION ALL SELECT idx, session, 33, {r6('mean_length')} FROM c""",
        "archive_features": f"WITH {price_features()} SELECT idx, session, CAST(unnest(range(16)) AS INTEGER) AS k, {r6('unnest(v)')} AS value FROM px",
        "prepared_sessions": f"WITH {modalities(tokens, digest)} SELECT idx, session, modality, known, k, {r6('x')} AS value FROM l",
        "modality_windows": modality_windows(tokens, digest),
        "sample_windows": f"""WITH {RET}, {WINDOWS}
SELECT ticker, issue, count(*) AS n, min(session) AS first_session, max(session) AS last_session, {r6('ln(arg_max(close, pos) / arg_min(close, pos))')} AS anchored_last, {r6(f'sum(ln(close)) - {W} * ln(arg_min(close, pos))', 5)} AS anchored_sum FROM win GROUP BY ticker, issue""",
        **{f"signature_depth{d}": signature(d) for d in (1, 2, 3)},
        "window_standardize": f"""WITH {RET}, {WINDOWS}, c AS (SELECT ticker, CAST(floor(max(idx) * 8 / 10) AS BIGINT) AS cut FROM r GROUP BY ticker), w AS (SELECT win.* FROM win JOIN c USING (ticker) WHERE issue < cut)
{' UNION ALL '.join(f"SELECT ticker, '{f}' AS feature, {r6(f'avg({f})')} AS mean, {r6(f'greatest(stddev_pop({f}), 1e-4)')} AS sd, count({f}) AS n FROM w GROUP BY ticker" for f in ('ret', 'rng'))}""",
        "standardized_windows": f"""WITH {RET}, {WINDOWS}, c AS (SELECT ticker, CAST(floor(max(idx) * 8 / 10) AS BIGINT) AS cut FROM r GROUP BY ticker),
mo AS (SELECT ticker, {', '.join(f'avg({f}) AS m_{f}, greatest(stddev_pop({f}), 1e-4) AS d_{f}' for f in ('ret', 'rng'))} FROM win JOIN c USING (ticker) WHERE issue < cut GROUP BY ticker),
z AS (SELECT ticker, issue, {', '.join(f'greatest(-8, least(8, ({f} - m_{f}) / d_{f})) AS {f}' for f in ('ret', 'rng'))} FROM win JOIN mo USING (ticker))
SELECT ticker, issue, {', '.join(f'{r6(f"sum({f})")} AS {f}_sum, {r6(f"max(abs({f}))")} AS {f}_top' for f in ('ret', 'rng'))} FROM z GROUP BY ticker, issue""",
        "factor_screen_rolling": f"WITH {SCREEN} SELECT idx, session, train_n, {', '.join(f'{r6(f"corr_{f}")} AS corr_{f}' for f in NAMES)} FROM sc",
        "factor_corr_matrix": f"WITH {PANEL} {pairs}",
        "factor_screen_table": f"WITH {PANEL} {' UNION ALL '.join(f"SELECT '{f}' AS factor, {r6(corr(f, 'ret'))} AS correlation FROM panel" for f in four)}",
        "training_calendar": f"WITH {SAMPLES} SELECT ticker, idx, session, target_date, min(session) OVER w AS training_issue_first, max(session) OVER w AS training_issue_last, max(target_date) OVER w AS latest_training_target, count(*) OVER w AS training_examples FROM s WINDOW w AS (PARTITION BY ticker ORDER BY idx {FRAME})",
        "frozen_normalizer": f"WITH {SAMPLES} SELECT * FROM (SELECT ticker, idx, session, {r6('avg(target) OVER w')} AS label_mean, {r6('stddev_samp(target) OVER w')} AS label_sd, count(target) OVER w AS label_n FROM s WINDOW w AS (PARTITION BY ticker ORDER BY idx {FRAME})) WHERE label_n >= 2",
        "softmax_weights_neff": f"""WITH {RET}, e AS (SELECT ticker, exp(-0.5 * abs(ret) - max(-0.5 * abs(ret)) OVER (PARTITION BY ticker)) AS w FROM r)
SELECT ticker, {r6('sum(w) / sum(w)')} AS total, {r6('sum(w) * sum(w) / sum(w * w)', 4)} AS n_eff, {r6('max(w) / sum(w) * 1000')} AS largest FROM e GROUP BY ticker""",
        "weighted_gram": gram(),
        "score_predictions": scores(),
        "price_reconstruction": f"WITH {SAMPLES} SELECT nv.ticker, issue_date, target_date, i.close AS previous_actual_close, t.close AS actual_close, {r6('i.close * exp(predicted_return)', 4)} AS predicted_close FROM nv JOIN r i ON i.ticker = nv.ticker AND i.session = issue_date JOIN r t ON t.ticker = nv.ticker AND t.session = target_date",
        "price_mae": f"WITH {SAMPLES} SELECT nv.ticker, {r6('avg(abs(i.close * exp(predicted_return) - t.close))', 4)} AS price_mae, {r6('avg(abs(i.close - t.close))', 4)} AS last_close_mae FROM nv JOIN r i ON i.ticker = nv.ticker AND i.session = issue_date JOIN r t ON t.ticker = nv.ticker AND t.session = target_date GROUP BY nv.ticker",
        "return_errors": f"WITH {SAMPLES} SELECT ticker, issue_date, target_date, {r6('abs(predicted_return - actual_return)')} AS log_return_error, {r6('abs(exp(predicted_return) - exp(actual_return))')} AS simple_return_error FROM nv",
        "pearson_nmse": f"""WITH {SAMPLES}, {HALF}, sd AS (SELECT n.ticker, n.half, n.sd FROM (SELECT s.ticker, s.idx, half, stddev_samp(target) OVER (PARTITION BY s.ticker ORDER BY idx {FRAME}) AS sd FROM s JOIN (SELECT ticker, CAST(floor(max(idx) / 2) AS BIGINT) AS half FROM s GROUP BY ticker) h USING (ticker)) n WHERE idx = half + 1),
q AS (SELECT ticker, (avg(predicted_return * actual_return) - avg(predicted_return) * avg(actual_return)) / (stddev_pop(predicted_return) * stddev_pop(actual_return)) AS pearson, avg((actual_return - predicted_return) * (actual_return - predicted_return)) AS mse, avg(actual_return * actual_return) AS zero FROM nv JOIN sd USING (ticker) WHERE idx > half GROUP BY ticker)
SELECT ticker, {r6('pearson')} AS pearson, {r6('mse')} AS mse, {r6('mse / (sd * sd)')} AS normalised_mse, {r6('zero / (sd * sd)')} AS zero_normalised_mse, {r6('1 - mse / zero')} AS skill FROM q JOIN sd USING (ticker)""",
        "midcdf_allocation": f"WITH {CDF} SELECT ticker, idx, issue_date, {r6('percentile')} AS percentile, {r6('allocation')} AS allocation FROM alloc",
        "backtest_ledger": f"{ledger()} SELECT ticker, strategy, idx, issue_date, {r6('ln(wealth)')} AS log_wealth, {r6('drawdown')} AS drawdown, {r6('(wealth_before * (1 - allocation)) / wealth_before')} AS cash_share FROM led",
        "backtest_performance": f"{ledger()} SELECT {PERFORMANCE}, {r6('100 * avg(allocation)')} AS mean_allocation_pct, {r6('100 * min(allocation)')} AS min_allocation_pct, {r6('100 * max(allocation)')} AS max_allocation_pct FROM led GROUP BY ticker, strategy",
        "open_to_close_variant": f"{ledger(OPEN)} SELECT {PERFORMANCE} FROM led GROUP BY ticker, strategy",
        "validate_contiguous": f"WITH {SAMPLES}, x AS (SELECT ticker, session, close AS c0, lead(session) OVER w AS nx, lead(close) OVER w AS c1 FROM r WINDOW w AS (PARTITION BY ticker ORDER BY session)) SELECT count(*) AS violations FROM nv JOIN x ON x.ticker = nv.ticker AND session = issue_date WHERE nx IS DISTINCT FROM target_date OR abs(actual_return - ln(c1 / c0)) > 1e-9",
        "prev_day_direction": f"WITH {DIRECTION} SELECT ticker, previous_session_date, issue_date, target_date, predicted_direction, actual_direction, correct FROM dd",
        "confusion_matrix": f"WITH {DIRECTION} SELECT t.ticker, c.actual, count(*) FILTER (actual_direction = c.actual AND predicted_direction = 'UP') AS predicted_up, count(*) FILTER (actual_direction = c.actual AND predicted_direction = 'DOWN') AS predicted_down FROM (SELECT DISTINCT ticker FROM dd) t CROSS JOIN (VALUES ('UP'), ('DOWN')) c(actual) JOIN dd ON dd.ticker = t.ticker GROUP BY 1, 2",
        "baseline_comparison": f"WITH {DIRECTION}, x AS (SELECT ticker, avg(CAST(correct AS DOUBLE)) AS r, avg(CAST(actual_direction = 'UP' AS DOUBLE)) AS u FROM dd GROUP BY ticker) SELECT ticker, 'repeat previous' AS method, {r6('r')} AS accuracy FROM x UNION ALL SELECT ticker, 'always UP', {r6('u')} FROM x UNION ALL SELECT ticker, 'always DOWN', {r6('1 - u')} FROM x",
        "factor_frequency": f"WITH {SCREEN} SELECT factor, count(*) AS selected_sessions FROM ({freq}) GROUP BY factor",
        "block_bootstrap": f"""WITH {SAMPLES}, e AS (SELECT ticker, idx - 1 AS idx, abs(predicted_return - actual_return) - abs(actual_return) AS d FROM nv), n AS (SELECT ticker, count(*) AS n FROM e GROUP BY ticker),
dr AS (SELECT *, md5('17:' || rep || ':' || b) AS h, 1152921504606846976 - 1152921504606846976 % n AS whole FROM (SELECT ticker, n, rep, unnest(range(CAST(ceil(n / 20.0) AS BIGINT))) AS b FROM n, range(1000) t(rep))),
st AS (SELECT ticker, rep, b, CASE WHEN CAST('0x' || substr(h, 1, 15) AS BIGINT) < whole THEN CAST('0x' || substr(h, 1, 15) AS BIGINT) ELSE CAST('0x' || substr(h, 17, 15) AS BIGINT) END % n AS s, n FROM dr),
dy AS (SELECT ticker, rep, (s + k) % n AS idx FROM st, range(20) v(k) WHERE b * 20 + k < n), mm AS (SELECT ticker, rep, avg(d) AS m FROM dy JOIN e USING (ticker, idx) GROUP BY ticker, rep),
q AS (SELECT ticker, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM mm GROUP BY ticker)
SELECT ticker, {r6('difference')} AS difference, {r6('low')} AS low, {r6('high')} AS high FROM q JOIN (SELECT ticker, avg(d) AS difference FROM e GROUP BY ticker) USING (ticker)""",
        "split_ticker_summary": f"""WITH {RET}, y AS (SELECT ticker, CASE WHEN idx < 200 THEN 'train' ELSE 'test' END AS split, CAST(coalesce(lead(close) OVER (PARTITION BY ticker ORDER BY session) > close, false) AS INTEGER) AS label, 1 / (1 + exp(-ret)) AS p FROM r)
SELECT split, ticker, count(*) AS n, {r6('avg(CAST(CAST(p >= 0.5 AS INTEGER) = label AS DOUBLE))')} AS accuracy, {r6('avg((p - label) * (p - label))')} AS brier, {r6('avg(CAST(label AS DOUBLE))')} AS up_rate, {r6('greatest(avg(CAST(label AS DOUBLE)), 1 - avg(CAST(label AS DOUBLE)))')} AS majority FROM y GROUP BY 1, 2""",
        "rolling_hit_rate": f"WITH {DIRECTION} SELECT ticker, issue_date, {r6('CASE WHEN count(*) OVER w >= 10 THEN avg(CAST(correct AS DOUBLE)) OVER w END')} AS rate FROM dd WINDOW w AS (PARTITION BY ticker ORDER BY issue_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
        "candidate_table": " UNION ALL ".join(f"SELECT '{n}' AS candidate, '{f}' AS field, CAST({v!r} AS DOUBLE) AS value" for n, c in CANDIDATES.items() for f, v in asdict(c).items()),
        "direction_metrics": f"""WITH {DIRECTION}, c AS (SELECT ticker, count(*) AS n, count(*) FILTER (actual_direction = 'UP') AS actual_up, count(*) FILTER (actual_direction = 'DOWN') AS actual_down, count(*) FILTER (predicted_direction = 'UP') AS predicted_up,
count(*) FILTER (correct AND actual_direction = 'UP') AS correct_up, count(*) FILTER (correct AND actual_direction = 'DOWN') AS correct_down FROM dd GROUP BY ticker),
x AS (SELECT *, CAST(correct_up AS DOUBLE) / nullif(actual_up, 0) AS u, CAST(correct_down AS DOUBLE) / nullif(actual_down, 0) AS d FROM c)
SELECT ticker, n, actual_up, actual_down, predicted_up, correct_up, correct_down, {r6('CAST(correct_up + correct_down AS DOUBLE) / n')} AS accuracy, {r6('u')} AS up_recall, {r6('d')} AS down_recall, {r6('(u + d) / 2')} AS balanced_accuracy FROM x""",
        "score_after": f"{HELD_OUT} SELECT ticker, n, {r6('mae')} AS return_mae, {r6('rmse')} AS return_rmse, {r6('hits')} AS accuracy, {r6('(up_hits + down_hits) / 2')} AS balanced_accuracy FROM h",
        "held_out_comparison": f"{HELD_OUT} SELECT ticker, 'direction accuracy' AS metric, {r6('hits')} AS model, {r6('greatest(ups, 1 - ups)')} AS baseline FROM h UNION ALL SELECT ticker, 'return MAE', {r6('mae')}, {r6('zero')} FROM h",
        "method_comparison": f"""WITH {SAMPLES} SELECT nv.ticker, issue_date, target_date, {r6('i.close * exp(predicted_return)', 4)} AS repeat_close, {r6('abs(i.close * exp(predicted_return) - t.close) / t.close')} AS repeat_error, i.close AS flat_close, {r6('abs(i.close - t.close) / t.close')} AS flat_error
FROM nv JOIN r i ON i.ticker = nv.ticker AND i.session = issue_date JOIN r t ON t.ticker = nv.ticker AND t.session = target_date WHERE issue_date > DATE '1997-01-01'""",
        "masked_factor_screen": f"""WITH {PANEL}, tr AS (SELECT * FROM (SELECT *, lead(session) OVER (ORDER BY session) AS target_date FROM panel) WHERE target_date < DATE '1997-01-01'),
c AS ({' UNION ALL '.join(f"SELECT '{f}' AS factor, {corr(f, 'ret')} AS c FROM tr" for f in four)})
SELECT 'A' AS series, factor, {r6('c')} AS correlation, row_number() OVER (ORDER BY abs(c) DESC, factor) <= 2 AS selected FROM c""",
    }
