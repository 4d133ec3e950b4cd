"""The registered queries as SQL over the same tables, one text for each."""

from __future__ import annotations

from tidemark.functions.sheets import as_sql
from tidemark.operators.ledger import CURRENT, SWEEP, TUNABLE
from tidemark.operators.lifecycle import rules
from tidemark.operators.text import BEARISH, BULLISH, OPTIONS
from tidemark.plans.oracle_market import SQL as MARKET_SQL
from tidemark.plans.oracle_proposals import JUDGED
from tidemark.plans.oracle_proposals import SQL as PROPOSAL_SQL
from tidemark.plans.oracle_streams import EXIT_STATES, EXIT_TABLE, LEDGER
from tidemark.plans.oracle_tiers import precheck_sql, tier_sql
from tidemark.plans.oracle_valuation import valuation_sql
from tidemark.sources.adapters import DAY_REPORTS, EXPIRY, LINE_ID, POSITIONS, TERMS

TRADES = """trades AS (SELECT o_orderkey AS trade_id, o_custkey AS ticker, CAST(o_orderdate AS DATE) AS entry_date,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'LONG_CALL' WHEN '2' THEN 'BULL_CALL_SPREAD' WHEN '3' THEN 'LONG_PUT' WHEN '4' THEN 'BEAR_PUT_SPREAD' WHEN '5' THEN 'LONG_CALL' END AS strategy,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EARNINGS' WHEN '2' THEN 'FDA' WHEN '3' THEN 'MA' WHEN '4' THEN 'INSIDER' END AS catalyst,
 r_name AS sector, o_custkey % 365 AS dte, (o_orderkey % 100) / 10 AS mismatch, o_orderkey % 10 + 1 AS impact, o_custkey % 10 + 1 AS surprise, o_orderkey % 101 AS score, CASE WHEN o_orderkey % 9 <> 0 THEN (o_custkey % 25 - 12) / 100 END AS eps_drift, CASE WHEN o_orderstatus = 'P' THEN ['final_mc_survivor', 'roi_gate', 'score_48', 'correlation'][o_orderkey % 4 + 1] END AS reject_reason,
 CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'shadow' ELSE 'open' END AS source,
 (o_orderkey * 7 + o_custkey) % 40 / 100 + 0.35::DOUBLE AS hit_rate,
 CASE WHEN o_orderstatus IN ('F', 'P') THEN round((CAST(round(o_totalprice * 100) AS BIGINT) % 200000) / 100000 - 1 - CASE WHEN o_orderkey % 100 > 60 THEN 0.5::DOUBLE ELSE 0 END, 5) END AS outcome
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
BARS = """bars AS (SELECT n_name AS ticker, n_regionkey AS sector, CAST(l_shipdate AS DATE) AS d,
 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100 / CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
rets AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS ret FROM bars)"""
REGION_BARS = """rbars AS (SELECT r_name AS ticker, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100 / CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS close
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
rrets AS (SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS ret FROM rbars) WHERE ret IS NOT NULL)"""
SUPPLIER_BARS = """sbars AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100 / CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS close FROM lineitem GROUP BY ALL),
srets AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS ret FROM sbars)"""
CHAIN = f"""chain AS (SELECT *, round(strike * (0.05 + l_discount), 4) AS ask, round(strike * (0.05 + l_discount) * (1 - l_tax), 6) AS bid FROM (SELECT l_suppkey AS ticker, {EXPIRY} AS expiry,
 CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END AS type, (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 100 AS strike, l_discount, l_tax, CAST(l_quantity AS BIGINT) * 25 AS oi, round(0.2 + l_tax, 2) AS iv,
 CASE WHEN l_partkey % 4 <> 0 THEN (40 + l_partkey % 45) / 100 END AS delta, {LINE_ID} AS row FROM lineitem)),
spot AS (SELECT ticker, CAST(sum(CAST(round(strike * 100) AS BIGINT)) AS BIGINT) / count(*) / 100 AS s FROM chain GROUP BY ticker),
priced AS (SELECT * FROM chain JOIN spot USING (ticker)),
days AS (SELECT DISTINCT expiry FROM chain), months AS (SELECT CAST(unnest(range(date_trunc('month', (SELECT min(expiry) FROM days) - 400)::TIMESTAMP, (SELECT max(expiry) FROM days)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS run_month),
runs AS (SELECT expiry, run_month, expiry - run_month AS dte FROM days JOIN months ON expiry >= run_month AND expiry - run_month <= 365)"""


def _first(least: int, most: int, where: str = "true") -> str:
    """Contracts of the first expiry in the range."""
    return f"(SELECT * FROM (SELECT *, min(dte) OVER (PARTITION BY ticker, run_month) AS nearest FROM priced JOIN runs USING (expiry) WHERE {where} AND dte BETWEEN {least} AND {most}) WHERE dte = nearest)"


def _pick(least: int, most: int, low: float, high: float) -> str:
    return f"""WITH {CHAIN}, own AS (SELECT * FROM {_first(least, most, "type = 'call'")} WHERE strike >= s * CASE WHEN s * ({high} - 1) < 15 THEN round(1 - 15 / s, 4) ELSE {low} END AND strike <= s * CASE WHEN s * ({high} - 1) < 15 THEN round(1 + 15 / s, 4) ELSE {high} END
  AND oi >= 100 AND (ask - bid) / greatest(ask, 0.01) <= 0.10),
 meant AS (SELECT *, coalesce(abs(delta) BETWEEN 0.55 AND 0.75, false) AS meant FROM own),
 pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, run_month ORDER BY oi DESC, strike, row) AS k FROM (SELECT *, bool_or(meant) OVER (PARTITION BY ticker, run_month) AS has FROM meant) WHERE meant OR NOT has) WHERE k = 1)"""


OUT = """o AS (SELECT *, max(outcome) OVER (PARTITION BY trade_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak, date_diff('day', CAST(entry AS DATE), CAST(ts AS DATE)) AS age FROM
 (SELECT user_id AS trade_id, ts, event_id, value, value / first(value) OVER w - 1 AS outcome, first(ts) OVER w AS entry FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""
#: Rules of a position held for 14 days at most, as the given marks span 30 days.
FIRED = f"{OUT}, f AS (SELECT * FROM {as_sql('o', TERMS, *rules(14))}), x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY ts, event_id) AS k FROM f WHERE reason IS NOT NULL) WHERE k = 1)"
TRAILED = """tp AS (SELECT trade_id, ts AS tts, event_id AS tid, outcome AS tpo, peak AS seed FROM x WHERE reason = 'take_profit'),
 l AS (SELECT f.*, tpo, greatest(seed, max(outcome) OVER (PARTITION BY f.trade_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS top FROM f JOIN tp ON f.trade_id = tp.trade_id AND (ts > tts OR ts = tts AND event_id > tid)),
 h AS (SELECT trade_id, outcome AS h, CASE WHEN age >= term_days THEN 'expiry' ELSE 'trail_stop' END AS close_reason FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY ts, event_id) AS k FROM l WHERE outcome <= top * 0.65::DOUBLE OR age >= term_days) WHERE k = 1),
 trailed AS (SELECT tp.trade_id, round(tpo, 6) AS tp_outcome, round(h, 6) AS trailing_outcome, close_reason FROM tp LEFT JOIN h USING (trade_id))"""
STATS = "count(outcome) AS n, round(avg(CAST(outcome > 0 AS INT)) + 1e-9::DOUBLE, 6) AS win_rate, round(avg(outcome) + 1e-9::DOUBLE, 6) AS mean, round(median(outcome) + 1e-9::DOUBLE, 6) AS median, count(*) FILTER (outcome <= -0.99) AS total_losses"



def _swept(grid: dict[str, tuple]) -> str:
    return "swept AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {float(t)}::DOUBLE AS threshold, {STATS} FROM trades WHERE outcome IS NOT NULL AND {f} {'<=' if f == 'mismatch' else '>='} {t}::DOUBLE HAVING count(*) > 0" for f, ts in grid.items() for t in ts) + ")"


_NOW = "CASE field " + " ".join(f"WHEN '{f}' THEN {float(t)}::DOUBLE" for f, t in CURRENT.items()) + " END"
_OFFERED = " OR ".join(f"field = '{f}' AND threshold IN ({', '.join(map(str, ts))})" for f, ts in TUNABLE.items())
_SECTORS = f"""s AS (SELECT sector, {STATS}, count(*) FILTER (outcome > 0) AS wins FROM trades WHERE outcome IS NOT NULL GROUP BY 1),
 sectors AS (SELECT * FROM (SELECT sector, n, mean, win_rate, wins, round(wins / sum(wins) OVER (), 6) AS share, round(wins / sum(wins) OVER (), 6) > 0.5 AS dominant FROM s) WHERE n >= 3)"""
_BINS = """bins AS (SELECT outcome, 'impact' AS feature, CASE WHEN impact <= 4 THEN 'low' WHEN impact <= 7 THEN 'mid' ELSE 'high' END AS bin FROM c
 UNION ALL SELECT outcome, 'mismatch', CASE WHEN mismatch < 3 THEN 'weak' WHEN mismatch <= 6 THEN 'good' ELSE 'strong' END FROM c
 UNION ALL SELECT outcome, 'eps', CASE WHEN abs(eps_drift) > 0.10 THEN 'massive' WHEN abs(eps_drift) > 0.05 THEN 'relevant' ELSE 'noise' END FROM c)"""
_POSTS = rf"""cred AS (SELECT doc_id AS id, source, round(ln(1 + greatest(n_chars, 0)) * (1 + least(greatest(doc_id % 50, 0) / (greatest(n_chars, 0) + 1), 2.0)), 3) AS credibility,
 len(regexp_extract_all(lower(text), '\b({"|".join(sorted(BULLISH, reverse=True))})\b')) AS bull, len(regexp_extract_all(lower(text), '\b({"|".join(sorted(BEARISH, reverse=True))})\b')) AS bear, coalesce(regexp_matches(lower(text), '{OPTIONS}'), false) AS has_options FROM documents)"""
TERM = """firsts AS (SELECT * FROM (SELECT ticker, run_month, dte, row_number() OVER (PARTITION BY ticker, run_month ORDER BY dte) AS k FROM (SELECT DISTINCT ticker, run_month, dte FROM chain JOIN runs USING (expiry) WHERE dte <= 120)) WHERE k <= 3 AND dte >= 7),
 term AS (SELECT ticker, run_month, dte, round(median(iv), 6) AS iv, count(*) AS n FROM priced JOIN runs USING (expiry) JOIN firsts USING (ticker, run_month, dte) WHERE type = 'call' AND strike BETWEEN s * 0.93 AND s * 1.07 AND iv > 0.05 GROUP BY 1, 2, 3)"""
_ATM = f"WITH {CHAIN}, atm AS (SELECT *, row_number() OVER (PARTITION BY ticker, expiry, type ORDER BY round(abs(strike - s), 6), strike, row) AS k FROM priced)"
_FUNNEL = "funnel AS (SELECT user_id AS desk, CAST(ts AS DATE) AS run_date, event_type AS stage, count(*) AS n FROM events GROUP BY ALL)"


def _by(keys: str, where: str = "outcome IS NOT NULL") -> str:
    return f"WITH {TRADES} SELECT {keys}, {STATS} FROM trades WHERE {where} GROUP BY 1"


SQL: dict[str, str] = {
    "threshold_sweep": f"WITH {TRADES}, {_swept(SWEEP)} SELECT * FROM swept",
    "threshold_suggest": f"""WITH {TRADES}, {_swept({f: {*ts, CURRENT[f]} for f, ts in TUNABLE.items()})}, cur AS (SELECT field, threshold AS current, win_rate AS current_win_rate, mean AS current_mean FROM swept WHERE threshold = {_NOW})
 SELECT field, current, threshold AS suggested, n, win_rate, current_win_rate, mean FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY win_rate DESC, threshold) AS k FROM swept JOIN cur USING (field)
 WHERE ({_OFFERED}) AND n >= 20 AND threshold <> current AND round(win_rate - current_win_rate, 6) >= 0.05::DOUBLE AND mean >= current_mean) WHERE k = 1""",
    "trade_stats_by_month": _by("strftime(entry_date, '%Y-%m') AS month"),
    "catalyst_breakdown": _by("coalesce(catalyst, 'unknown') AS catalyst"),
    "month_over_month": f"""WITH {TRADES}, m AS (SELECT date_trunc('month', entry_date) AS m, {STATS} FROM trades WHERE outcome IS NOT NULL GROUP BY 1)
 SELECT strftime(a.m, '%Y-%m') AS month, a.n, a.mean, b.mean AS prev_mean, round(a.mean - b.mean, 6) AS change, b.win_rate AS prev_win_rate FROM m a LEFT JOIN m b ON a.m = b.m + INTERVAL 1 MONTH""",
    "spread_vs_long": f"""WITH {TRADES}, s AS (SELECT CASE WHEN contains(strategy, 'SPREAD') THEN 'spread' ELSE 'long' END AS kind, {STATS} FROM trades WHERE outcome IS NOT NULL AND source = 'closed' GROUP BY 1),
 p AS (SELECT max(n) FILTER (kind = 'spread') AS spread_n, max(mean) FILTER (kind = 'spread') AS spread_mean, max(win_rate) FILTER (kind = 'spread') AS spread_win_rate, max(n) FILTER (kind = 'long') AS long_n, max(mean) FILTER (kind = 'long') AS long_mean, max(win_rate) FILTER (kind = 'long') AS long_win_rate FROM s)
 SELECT *, round(long_mean - spread_mean, 6) AS gap, spread_n >= 10 AND long_n >= 10 AS ready, CASE WHEN spread_n >= 10 AND long_n >= 10 AND long_mean - spread_mean >= 0.10 THEN 'long' WHEN spread_n >= 10 AND long_n >= 10 AND long_mean - spread_mean <= -0.10 THEN 'spread' ELSE 'none' END AS recommend FROM p""",
    "sector_concentration": f"WITH {TRADES}, {_SECTORS} SELECT * FROM sectors",
    "sector_verdict": f"""WITH {TRADES.replace('trades AS', 'book AS', 1)}, trades AS (SELECT * FROM book WHERE source = 'closed' OR reject_reason = 'final_mc_survivor'), {_SECTORS} SELECT n, n >= 20 AS ready, sectors, best, worst, dominant, CASE WHEN n >= 20 AND up = 1 AND sectors > 1 THEN lone END AS recommended FROM (SELECT (SELECT count(sector) FROM trades) AS n, count(*) AS sectors,
 (SELECT sector FROM sectors ORDER BY mean DESC, sector DESC LIMIT 1) AS best, (SELECT sector FROM sectors ORDER BY mean, sector LIMIT 1) AS worst, max(sector) FILTER (dominant) AS dominant, count(*) FILTER (mean > 0) AS up, max(sector) FILTER (mean > 0) AS lone FROM sectors)""",
    "bin_stats": f"WITH {TRADES}, c AS (SELECT * FROM trades WHERE outcome IS NOT NULL AND source = 'closed'), {_BINS} SELECT feature, bin, count(*) AS count, round(avg(outcome), 6) AS avg_return FROM bins GROUP BY 1, 2",
    "pearson_weights": f"""WITH {TRADES}, x AS (SELECT outcome, CASE WHEN impact <= 4 THEN 0.0 WHEN impact <= 7 THEN 0.5 ELSE 1.0 END::DOUBLE AS a, CASE WHEN mismatch < 3 THEN 0.0 WHEN mismatch <= 6 THEN 0.5 ELSE 1.0 END::DOUBLE AS b, CASE WHEN abs(eps_drift) > 0.10 THEN 1.0 WHEN abs(eps_drift) > 0.05 THEN 0.5 ELSE 0.0 END::DOUBLE AS c FROM trades WHERE outcome IS NOT NULL AND source = 'closed'),
 r AS (SELECT count(*) AS n, greatest(coalesce(covar_pop(a, outcome) / nullif(stddev_pop(a) * stddev_pop(outcome), 0), 0), 0) AS a, greatest(coalesce(covar_pop(b, outcome) / nullif(stddev_pop(b) * stddev_pop(outcome), 0), 0), 0) AS b, greatest(coalesce(covar_pop(c, outcome) / nullif(stddev_pop(c) * stddev_pop(outcome), 0), 0), 0) AS c FROM x)
 SELECT n, round(CASE WHEN n < 5 OR a + b + c = 0 THEN 0.35 ELSE 0.35 + 0.05 * (a / (a + b + c) - 0.35) END, 4)::DOUBLE AS impact, round(CASE WHEN n < 5 OR a + b + c = 0 THEN 0.45 ELSE 0.45 + 0.05 * (b / (a + b + c) - 0.45) END, 4)::DOUBLE AS mismatch, round(CASE WHEN n < 5 OR a + b + c = 0 THEN 0.20 ELSE 0.20 + 0.05 * (c / (a + b + c) - 0.20) END, 4)::DOUBLE AS eps FROM r""",
    "cooldown_antijoin": f"""WITH RECURSIVE {TRADES}, d AS (SELECT ticker, entry_date, min(trade_id) AS trade_id FROM trades GROUP BY 1, 2),
 following AS (SELECT a.ticker, a.entry_date, min(b.entry_date) AS later FROM d a JOIN d b ON a.ticker = b.ticker AND b.entry_date > a.entry_date + 30 GROUP BY 1, 2),
 e AS (SELECT ticker, min(entry_date) AS entry_date FROM d GROUP BY 1 UNION ALL SELECT e.ticker, f.later FROM e JOIN following f ON f.ticker = e.ticker AND f.entry_date = e.entry_date)
 SELECT trade_id, ticker, entry_date FROM e JOIN d USING (ticker, entry_date)""",
    "shadow_maturity": f"""WITH {TRADES}, s AS (SELECT *, max(entry_date) OVER () AS latest FROM trades WHERE source = 'shadow' OR reject_reason IS NOT NULL)
 SELECT coalesce(reject_reason, 'unknown') AS reason, count(*) AS total, count(*) FILTER (outcome IS NOT NULL) AS evaluated, count(*) FILTER (outcome IS NULL AND entry_date + 45 <= latest + 14) AS ready, min(entry_date + 45) FILTER (outcome IS NULL) AS next_date FROM s GROUP BY 1""",
    "trade_score_rank": f"""WITH {TRADES} SELECT entry_date, rank, trade_id, score, CASE WHEN score >= 75 THEN 'STRONG BUY' WHEN score >= 60 THEN 'BUY' WHEN score >= 45 THEN 'WATCH' ELSE 'AVOID' END AS grade
 FROM (SELECT *, row_number() OVER (PARTITION BY entry_date ORDER BY score DESC, ticker, trade_id) AS rank FROM trades) WHERE rank <= 5""",
    "reject_counts": f"""WITH {TRADES} SELECT CASE WHEN dte < 14 THEN 'dte_too_short' WHEN impact < 4 THEN 'impact_too_low' WHEN surprise < 3 THEN 'surprise_too_low' WHEN mismatch > 7 THEN 'mismatch_too_high' WHEN score < 40 THEN 'score_too_low' ELSE 'passed' END AS reason, count(*) AS count, count(DISTINCT ticker) AS tickers FROM trades GROUP BY 1""",
    "returns_48h_mismatch": f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS last FROM rets) WHERE d > last - 35),
 a AS (SELECT ticker, count(*) AS n, stddev_pop(ret) AS s, max(close) FILTER (k = 2) AS c2, max(close) FILTER (k = 4) AS c4 FROM r GROUP BY 1),
 b AS (SELECT ticker, CASE WHEN n >= 10 THEN s ELSE 0 END AS sigma, CASE WHEN n >= 5 THEN c2 / c4 - 1 ELSE 0 END AS move FROM a)
 SELECT ticker, round(sigma, 6) AS sigma, round(move, 6) AS move, round(abs(move) / sigma, 6) AS z, round(8 - 5 * (abs(move) / sigma), 6) AS mismatch FROM b WHERE sigma > 0 AND 8 - 5 * (abs(move) / sigma) > 0""",
    "sigma_pop_samp": f"""WITH {BARS}, w AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS last FROM bars) WHERE d > last - 182),
 a AS (SELECT ticker, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, stddev_pop(r) AS p FROM w GROUP BY 1)
 SELECT ticker, n, round(CASE WHEN n < 30 OR abs(m) > 0.005 THEN 0.0 ELSE m END, 6) AS mu, round(CASE WHEN n < 30 OR NOT s BETWEEN 0.005 AND 0.15 THEN 0.02 ELSE s END, 6) AS sigma_samp, round(p, 6) AS sigma_pop FROM a""",
    "correlation_matrix": f"""WITH {REGION_BARS}, k AS (SELECT d FROM rrets GROUP BY d HAVING count(*) = (SELECT count(DISTINCT ticker) FROM rrets)), r AS (SELECT * FROM rrets JOIN k USING (d))
 SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, round(coalesce(covar_pop(x.ret, y.ret) / nullif(stddev_pop(x.ret) * stddev_pop(y.ret), 0), 0), 6) AS corr FROM r x JOIN r y ON x.d = y.d AND x.ticker < y.ticker GROUP BY 1, 2""",
    "month_benchmark": f"""WITH {TRADES}, {REGION_BARS}, i AS (SELECT date_trunc('month', d)::DATE AS month, round(CASE WHEN count(*) >= 2 THEN arg_max(close, d) / arg_min(close, d) - 1 END, 6) AS index_return FROM rbars WHERE ticker = 'AMERICA' GROUP BY 1),
 t AS (SELECT date_trunc('month', entry_date)::DATE AS month, count(*) AS n, round(avg(outcome), 6) AS mean FROM trades WHERE outcome IS NOT NULL GROUP BY 1) SELECT month, n, mean, index_return, round(mean - index_return, 6) AS edge FROM t LEFT JOIN i USING (month)""",
    "iv_rank": f"""WITH {SUPPLIER_BARS}, {CHAIN}, {TERM}, t AS (SELECT ticker, run_month, arg_min(iv, dte) AS short, arg_max(iv, dte) AS long, count(*) AS points FROM term GROUP BY 1, 2),
 ts AS (SELECT ticker, arg_max(round(CASE WHEN points >= 2 AND long > 0 THEN least(greatest((short / long - 1 + 0.05) * 100, 0.0), 80.0) ELSE 20.0 END, 4), run_month) AS term_score FROM t GROUP BY 1),
 v AS (SELECT ticker, d, CASE WHEN count(ret) OVER w = 21 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS rv FROM srets WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
 y AS (SELECT * FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS last FROM v WHERE rv IS NOT NULL) WHERE d > last - 365), a AS (SELECT ticker, count(*) AS n, arg_max(rv, d) AS rv, quantile_cont(rv, 0.05) AS lo, quantile_cont(rv, 0.95) AS hi FROM y GROUP BY 1),
 k AS (SELECT ticker, round(coalesce(least(greatest((rv - lo) / nullif(hi - lo, 0) * 100, 0.0), 100.0), 50.0), 1) AS rv_rank FROM a WHERE n >= 60)
 SELECT ticker, rv_rank, round(rv_rank * 0.80 + coalesce(term_score, 20) * 0.20 + 1e-9::DOUBLE, 1) AS iv_rank FROM k LEFT JOIN ts USING (ticker)""",
    "relative_strength": f"""WITH {BARS}, r AS (SELECT * FROM bars WHERE d > (SELECT max(d) FROM bars) - 35), sec AS (SELECT sector, d, CAST(sum(CAST(round(close * 1000000) AS BIGINT)) AS BIGINT) / count(*) / 1000000 AS close FROM r GROUP BY ALL),
 t AS (SELECT ticker, sector, max_by(close, d) / min_by(close, d) - 1 AS ret, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT sector, max_by(close, d) / min_by(close, d) - 1 AS ret FROM sec GROUP BY 1)
 SELECT ticker, sector, round(t.ret - s.ret, 4) AS strength, n < 5 OR round(t.ret - s.ret, 4) >= -0.15 AS ok, n < 5 OR round(t.ret - s.ret, 4) <= 0.15 AS ok_bearish FROM t JOIN s USING (sector)""",
    "pair_corr": f"""WITH {BARS}, r AS (SELECT * FROM rets WHERE ret IS NOT NULL) SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, round(coalesce(covar_pop(x.ret, y.ret) / nullif(stddev_pop(x.ret) * stddev_pop(y.ret), 0), 0), 6) AS corr
 FROM r x JOIN r y ON x.sector = y.sector AND x.d = y.d AND x.ticker < y.ticker GROUP BY 1, 2 HAVING count(*) >= 20""",
    "barrier_hit_rate": f"""WITH {BARS}, g AS (SELECT ticker, greatest(0.08::DOUBLE, round(0.5 * coalesce(stddev_pop(ret), 0) * sqrt(20.0), 6)) AS target FROM rets GROUP BY 1), h AS (SELECT ticker, close, max(close) OVER w AS high, count(close) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
 a AS (SELECT ticker, target, count(*) AS n, least(avg(CAST(high >= close * (1 + target) AS INT)), 0.75::DOUBLE) AS p FROM h JOIN g USING (ticker) WHERE n = 20 GROUP BY 1, 2) SELECT ticker, target, n, round(p, 6) AS hit_rate, round(sqrt(p * (1 - p) / n), 6) AS stderr FROM a""",
    "rolling_rv_rank": f"""WITH {BARS}, v AS (SELECT ticker, d, CASE WHEN count(ret) OVER w = 21 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS rv FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
 y AS (SELECT * FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS last FROM v WHERE rv IS NOT NULL) WHERE d > last - 365),
 a AS (SELECT ticker, count(*) AS n, max_by(rv, d) AS rv, quantile_cont(rv, 0.05) AS lo, quantile_cont(rv, 0.95) AS hi FROM y GROUP BY 1)
 SELECT ticker, n, round(rv, 6) AS rv, round(coalesce(least(greatest((rv - lo) / nullif(hi - lo, 0) * 100, 0.0), 100.0), 50.0), 1) AS rv_rank FROM a WHERE n >= 60""",
    "first_expiry": f"WITH {CHAIN} SELECT ticker, run_month, expiry, dte, count(*) AS contracts FROM {_first(20, 50)} GROUP BY ALL",
    "atm_nearest": f"{_ATM} SELECT ticker, s, expiry, type, strike, row, ask, iv FROM atm WHERE k = 1",
    "straddle_move": f"""{_ATM} SELECT c.ticker, c.expiry, round((c.ask + p.ask) / c.s, 6) AS implied_move FROM atm c JOIN atm p ON c.ticker = p.ticker AND c.expiry = p.expiry AND c.type = 'call' AND p.type = 'put' AND c.k = 1 AND p.k = 1 WHERE c.ask > 0 AND p.ask > 0""",
    "contract_pick": f"{_pick(14, 60, 0.97, 1.03)} SELECT ticker, run_month, expiry, dte, strike, bid, ask, oi, delta, round((ask - bid) / greatest(ask, 0.01), 6) AS spread_ratio, row FROM pick",
    "spread_leg": f"""{_pick(61, 149, 0.96, 1.08)}, l AS (SELECT p.ticker, p.run_month, p.expiry, p.strike AS k1, p.ask AS ask1, c.strike AS k2, c.bid, row_number() OVER (PARTITION BY p.ticker, p.run_month ORDER BY round(abs(c.strike - p.strike * 1.10), 6), c.strike, c.row) AS n
 FROM pick p JOIN chain c ON c.ticker = p.ticker AND c.expiry = p.expiry AND c.type = 'call' AND c.strike >= p.strike * 1.05 AND c.strike <= p.strike * 1.20) SELECT ticker, run_month, expiry, k1, k2, round(ask1 - bid, 4) AS net_debit, round(k2 - k1, 4) AS width FROM l WHERE n = 1 AND bid > 0""",
    "oi_gamma": f"""WITH {CHAIN}, a AS (SELECT ticker, run_month, expiry, CAST(coalesce(sum(oi) FILTER (type = 'call'), 0) AS BIGINT) AS calls, CAST(coalesce(sum(oi) FILTER (type = 'put'), 0) AS BIGINT) AS puts FROM {_first(14, 45)} WHERE abs(strike - s) <= 0.05 * s GROUP BY 1, 2, 3), b AS (SELECT *, CASE WHEN puts = 0 THEN 2.0 ELSE calls / puts END AS r FROM a)
 SELECT ticker, run_month, expiry, calls, puts, round(r, 6) AS ratio, CASE WHEN calls + puts < 100 THEN 'unavailable' WHEN r > 1.5 THEN 'positive' WHEN r < 0.70 THEN 'negative' ELSE 'neutral' END AS gamma FROM b""",
    "term_structure": f"WITH {CHAIN}, {TERM} SELECT ticker, run_month, dte, iv, n FROM term",
    "term_score": f"""WITH {CHAIN}, {TERM}, t AS (SELECT ticker, run_month, arg_min(iv, dte) AS short, arg_max(iv, dte) AS long, count(*) AS points FROM term GROUP BY 1, 2)
 SELECT ticker, run_month, points, round(CASE WHEN points >= 2 AND long > 0 THEN least(greatest((short / long - 1 + 0.05) * 100, 0.0), 80.0) ELSE 20.0 END, 4) AS term_score FROM t""",
    "skew": f"""WITH {CHAIN}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, run_month, type ORDER BY round(abs(strike - s), 6), strike, row) AS k FROM {_first(20, 50, "iv > 0.01")}),
 b AS (SELECT ticker, run_month, max(iv) FILTER (type = 'put') AS put_iv, max(iv) FILTER (type = 'call') AS call_iv FROM k WHERE k = 1 GROUP BY 1, 2)
 SELECT *, round(put_iv / call_iv, 6) AS skew_ratio, CASE WHEN put_iv / call_iv >= 1.20 THEN 'bearish_skew' WHEN put_iv / call_iv <= 0.85 THEN 'bullish_skew' ELSE 'neutral' END AS signal FROM b WHERE put_iv IS NOT NULL AND call_iv > 0""",
    "option_liquidity": f"WITH {CHAIN} SELECT ticker, run_month, count(DISTINCT expiry) AS expiries, count(DISTINCT expiry) >= 2 AS liquid FROM chain JOIN runs USING (expiry) GROUP BY 1, 2",
    "option_quotes": f"""WITH {CHAIN}, t AS (SELECT trade_id, ticker, expiry, strike, type FROM {as_sql('lineitem', *POSITIONS)}),
 b AS (SELECT t.trade_id, c.row, c.type AS quoted_type, c.bid, c.ask, row_number() OVER (PARTITION BY t.trade_id ORDER BY (c.type <> t.type)::INT, round(abs(c.strike - t.strike), 6), c.row) AS k FROM t JOIN chain c ON c.ticker = t.ticker AND c.expiry = t.expiry AND round(abs(c.strike - t.strike), 6) <= 0.01)
 SELECT t.trade_id, b.row, b.quoted_type, round(CASE WHEN b.bid > 0 AND b.ask > 0 THEN (b.bid + b.ask) / 2 WHEN b.ask > 0 THEN b.ask ELSE 0 END, 7) AS mid FROM t LEFT JOIN b ON b.trade_id = t.trade_id AND k = 1""",
    "running_peak": f"WITH {OUT} SELECT trade_id, event_id, round(outcome, 6) AS outcome, round(peak, 6) AS peak FROM o",
    "exit_first_fire": f"WITH {FIRED} SELECT trade_id, event_id, reason, round(outcome, 6) AS outcome, round(peak, 6) AS peak, age FROM x",
    "exit_alerts": f"WITH {FIRED} SELECT CAST(ts AS DATE) AS day, reason, count(*) AS trades, round(avg(outcome), 6) AS mean_outcome, round(avg(age), 6) AS mean_age FROM x GROUP BY 1, 2",
    "trailing_stop": f"WITH {FIRED}, {TRAILED} SELECT * FROM trailed",
    "trailing_vs_tp": f"""WITH {FIRED}, {TRAILED}, c AS (SELECT * FROM trailed WHERE trailing_outcome IS NOT NULL) SELECT (SELECT count(*) FROM trailed WHERE trailing_outcome IS NULL) AS open, count(*) AS closed, round(avg(tp_outcome), 6) AS mean_tp, round(avg(trailing_outcome), 6) AS mean_trailing, round(median(tp_outcome), 6) AS median_tp, round(median(trailing_outcome), 6) AS median_trailing,
 round(avg(trailing_outcome - tp_outcome), 6) AS mean_delta, round(avg(CAST(trailing_outcome > tp_outcome AS INT)), 6) AS share_better, count(*) >= 5 AS ready, count(*) >= 5 AND coalesce(avg(trailing_outcome - tp_outcome), 0) >= 0.05 AS recommended FROM c""",
    "shadow_outcome": f"WITH {OUT} SELECT trade_id, event_id, round(outcome, 4) AS outcome, age FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY ts, event_id) AS k FROM o WHERE age >= 14 AND outcome IS NOT NULL) WHERE k = 1",
    "quote_as_of": "SELECT q.trade_id, q.asof_ AS asof, e.event_id, e.value FROM (SELECT o_custkey % 150 AS trade_id, CAST(TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 40 AS INT)) AS TIMESTAMP) AS asof_ FROM orders GROUP BY ALL) q LEFT JOIN events e ON e.user_id = q.trade_id AND e.ts <= q.asof_ QUALIFY row_number() OVER (PARTITION BY q.trade_id, q.asof_ ORDER BY e.ts DESC NULLS LAST, e.event_id DESC) = 1".replace("asof_ AS asof,", 'asof_ AS "asof",'),
    "daily_first": "SELECT trade_id, d, value FROM (SELECT user_id AS trade_id, CAST(ts AS DATE) AS d, first(value ORDER BY ts, event_id) AS value, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) AS k FROM events GROUP BY user_id, CAST(ts AS DATE)) WHERE k <= 120",
    "killer_gate": f"""WITH {_FUNNEL}, w AS (SELECT desk, run_date, coalesce(sum(n) FILTER (stage = 'view'), 0) AS a, coalesce(sum(n) FILTER (stage = 'click'), 0) AS b, coalesce(sum(n) FILTER (stage = 'signup'), 0) AS c, coalesce(sum(n) FILTER (stage = 'purchase'), 0) AS d FROM funnel GROUP BY 1, 2)
 SELECT CASE WHEN c > 0 THEN 'purchase' WHEN b > 0 THEN 'signup' WHEN a > 0 THEN 'click' ELSE 'view' END AS gate, count(*) AS days, count(DISTINCT desk) AS desks FROM w WHERE d = 0 GROUP BY 1""",
    "drought_streak": f"""WITH {_FUNNEL}, d AS (SELECT desk, run_date, sum(CASE WHEN stage = 'purchase' THEN n ELSE 0 END) AS t FROM funnel GROUP BY 1, 2)
 SELECT desk, count(*) FILTER (seen = 0) AS streak, count(*) AS days FROM (SELECT *, sum(t) OVER (PARTITION BY desk ORDER BY run_date DESC ROWS UNBOUNDED PRECEDING) AS seen, row_number() OVER (PARTITION BY desk ORDER BY run_date DESC) AS k FROM d) WHERE k <= 10 GROUP BY 1""",
    "sentiment_drift": """WITH d AS (SELECT user_id AS trade_id, CAST(ts AS DATE) AS d, last(value ORDER BY ts, event_id) AS score FROM events GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY d DESC) AS back FROM d),
 c AS (SELECT *, count(*) OVER (PARTITION BY trade_id) AS size, count(*) FILTER (d >= (SELECT CAST(max(ts) AS DATE) FROM events) - 28) OVER (PARTITION BY trade_id) AS recent FROM b WHERE back <= 60),
 e AS (SELECT *, CASE WHEN recent >= 10 THEN recent ELSE least(10, size) END AS n FROM c), f AS (SELECT *, least(5, n // 2) AS k FROM e WHERE back <= n),
 a AS (SELECT trade_id, n, size >= 10 AS enough, avg(score) AS mean, round(avg(score) FILTER (back <= k) - avg(score) FILTER (back > n - k), 4) AS drift FROM f GROUP BY 1, 2, 3)
 SELECT trade_id, n, CASE WHEN enough THEN drift ELSE 0 END AS drift, CASE WHEN enough THEN round(mean, 4) ELSE 0 END AS mean_score, CASE WHEN NOT enough THEN 'insufficient_data' WHEN drift > 0.1 THEN 'rising' WHEN drift < -0.1 THEN 'falling' ELSE 'flat' END AS trend, enough AND drift >= 0.15 AND n >= 20 AS accumulation FROM a""",
    "post_credibility": f"WITH {_POSTS} SELECT * FROM cred",
    "weighted_sentiment": f"""WITH {_POSTS}, w AS (SELECT source, CAST(round(credibility * 1000) AS BIGINT) AS w, (bull - bear) / (bull + bear + 1) AS t, has_options FROM cred) SELECT source, count(*) AS mentions, round(greatest(-1.0, least(1.0, coalesce(sum(w * t) / nullif(sum(w), 0), 0.0))), 6) AS sentiment, round(avg(CAST(has_options AS INT)), 6) AS options_intent FROM w GROUP BY 1""",
    "top_posts": f"WITH {_POSTS} SELECT source, rank, id, credibility FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY credibility DESC, id) AS rank FROM cred) WHERE rank <= 5",
}
SQL["stream_exits"] = f"WITH {FIRED} SELECT trade_id, event_id, reason, round(outcome, 6) AS outcome, age FROM x"
SQL["stream_news_window"] = """SELECT event_type, CAST(start AS TIMESTAMP) AS start, CAST(start + INTERVAL 2 DAY AS TIMESTAMP) AS "end", count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY ALL"""
SQL["stream_report_counts"] = f"WITH {JUDGED} SELECT date_trunc('month', run_date)::DATE AS month, reject_reason AS reason, count(*) AS count FROM judged WHERE reject_reason IS NOT NULL GROUP BY 1, 2"
SQL |= PROPOSAL_SQL | MARKET_SQL
SQL |= {name: tier_sql(CHAIN, SUPPLIER_BARS, SQL["oi_gamma"], strict) for name, strict in (("tier_search", False), ("tier_search_legs", True))} | {"roi_precheck": precheck_sql(CHAIN, SUPPLIER_BARS)}
SQL |= valuation_sql(CHAIN, SUPPLIER_BARS)
SQL |= {"stream_exit_states": EXIT_STATES, "exit_table": EXIT_TABLE, "ledger_upsert": f"WITH {TRADES} {LEDGER}"}
#: Greedy pruning as a recursion over each run's correlated pairs.
_PRUNED = f"""WITH RECURSIVE {REGION_BARS}, m AS (SELECT date_trunc('month', d)::DATE AS month, ticker, round(arg_max(close, d), 2) AS score, max(d) AS d FROM rbars GROUP BY 1, 2),
 ranked AS (SELECT max(d) OVER (PARTITION BY month) AS run, ticker, score, row_number() OVER (PARTITION BY month ORDER BY score DESC, ticker) AS rank FROM m),
 fr AS (SELECT * FROM (SELECT run, k.ticker, rank, b.d, close / lag(close) OVER (PARTITION BY run, k.ticker ORDER BY b.d) - 1 AS ret FROM ranked k JOIN rbars b ON b.ticker = k.ticker AND b.d > run - 35 AND b.d <= run) WHERE ret IS NOT NULL),
 ok AS (SELECT run, d FROM fr GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM ranked k WHERE k.run = fr.run)),
 c AS (SELECT a.run, a.rank AS i, b.rank AS j, a.ticker AS a, b.ticker AS b, round(coalesce(covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0), 0), 9) AS corr FROM fr a JOIN fr b ON a.run = b.run AND a.d = b.d AND a.rank < b.rank SEMI JOIN ok ON ok.run = a.run AND ok.d = a.d GROUP BY 1, 2, 3, 4, 5),
 p AS (SELECT c.*, s.score >= t.score AS first, row_number() OVER (PARTITION BY c.run ORDER BY i, j) AS n FROM c JOIN ranked s ON s.run = c.run AND s.ticker = c.a JOIN ranked t ON t.run = c.run AND t.ticker = c.b WHERE corr > 0.1),
 f AS (SELECT DISTINCT run, 0::BIGINT AS n, []::VARCHAR[] AS gone, -1::BIGINT AS i, false AS out FROM ranked
   UNION ALL SELECT f.run, p.n, CASE WHEN (CASE WHEN p.i = f.i THEN f.out ELSE list_contains(f.gone, p.a) END) OR list_contains(f.gone, p.b) THEN f.gone ELSE list_append(f.gone, CASE WHEN p.first THEN p.b ELSE p.a END) END, p.i, CASE WHEN p.i = f.i THEN f.out ELSE list_contains(f.gone, p.a) END FROM f JOIN p ON p.run = f.run AND p.n = f.n + 1),
 g AS (SELECT run, arg_max(gone, n) AS gone FROM f GROUP BY 1), pruned AS (SELECT run, ticker, rank, score, NOT list_contains(gone, ticker) AS kept FROM ranked JOIN g USING (run))"""
SQL |= {"corr_prune": f"{_PRUNED} SELECT * FROM pruned", "corr_losers": f"{_PRUNED} SELECT ticker, run AS entry_date, 'correlation' AS reason FROM pruned WHERE NOT kept"}
_bp = lambda x: f"coalesce(CAST(CAST(round(({x}) * 10000 + 1e-6::DOUBLE) AS BIGINT) AS VARCHAR), 'none')"
SQL["slot_summary"] = f"""WITH {FIRED}, {TRAILED}, {TRADES},
 t AS (SELECT count(trailing_outcome) AS n, avg(tp_outcome) FILTER (trailing_outcome IS NOT NULL) AS a, avg(trailing_outcome) AS b FROM trailed),
 c AS (SELECT count(*) FILTER (strategy LIKE '%SPREAD%') AS s, count(*) FILTER (strategy LIKE 'LONG%') AS l, avg(outcome) FILTER (strategy LIKE '%SPREAD%') AS ms, avg(outcome) FILTER (strategy LIKE 'LONG%') AS ml FROM trades WHERE source = 'closed' AND outcome IS NOT NULL),
 b AS (SELECT sector, count(*) AS rows_, count(outcome) AS n, avg(outcome) AS mean FROM trades WHERE sector <> '' AND (source = 'closed' OR reject_reason = 'final_mc_survivor') GROUP BY 1),
 g AS (SELECT CAST(sum(rows_) AS BIGINT) AS n, count(*) FILTER (n >= 3) AS k, count(*) FILTER (n >= 3 AND mean > 0) AS up, max(sector) FILTER (n >= 3 AND mean > 0) AS lone, arg_max(sector, mean) FILTER (n >= 3) AS best, arg_min(sector, mean) FILTER (n >= 3) AS worst FROM b)
SELECT 'trailing_stop' AS name, n, 'take profit ' || {_bp('a')} || ', trailing ' || {_bp('b')} || ', delta ' || {_bp('b - a')} AS finding, CASE WHEN n < 5 THEN 'collect more data' WHEN round(b - a, 9) >= 0.05 THEN 'trail profits' END AS recommendation, n >= 5 AS ready FROM t
UNION ALL SELECT 'spreads_vs_single', s + l, CASE WHEN s > 0 AND l > 0 THEN 'spreads ' || s || ' at ' || {_bp('ms')} || ', single ' || l || ' at ' || {_bp('ml')} ELSE 'spreads ' || s || ', single ' || l END, CASE WHEN s < 10 OR l < 10 THEN 'collect more data' WHEN round(ml - ms, 9) >= 0.10 THEN 'raise the gate of spreads' END, s >= 10 AND l >= 10 FROM c
UNION ALL SELECT 'sectors', n, CASE WHEN n < 20 THEN 'too few with a sector' WHEN k = 0 THEN 'no sector has enough' ELSE k || ' sectors, best ' || best || ', worst ' || worst END, CASE WHEN n < 20 THEN 'collect more data' WHEN up = 1 AND k > 1 THEN 'only ' || lone END, n >= 20 FROM g"""
SQL["book_health"] = f"""WITH {TRADES}, d AS (SELECT max(entry_date) AS today FROM trades), r AS ({DAY_REPORTS.format(orders='orders')}),
 o AS (SELECT ticker, today - entry_date AS age FROM trades, d WHERE source = 'open' AND today - entry_date > 75), p AS (SELECT string_agg(CAST(ticker AS VARCHAR) || ' ' || age, ', ' ORDER BY age DESC, CAST(ticker AS VARCHAR)) AS names FROM (SELECT * FROM o ORDER BY age DESC, CAST(ticker AS VARCHAR) LIMIT 5)),
 l AS (SELECT max(run_date) AS last, arg_max(universe, run_date) AS universe, arg_max(coalesce(vix, -1), run_date) AS vix, any_value(today) AS today FROM r, d),
 c AS (SELECT 'weights' AS "check", NULL AS message UNION ALL SELECT 'overdue', CASE WHEN (SELECT count(*) FROM o) > 0 THEN (SELECT count(*) FROM o) || ' overdue: ' || names END FROM p
  UNION ALL SELECT 'reports', CASE WHEN today - last > 5 AND vix < 0 THEN 'last report ' || (today - last) || ' days old, no volatility' WHEN today - last > 5 THEN 'last report ' || (today - last) || ' days old' WHEN vix < 0 THEN 'no volatility' END FROM l)
SELECT "check", message IS NOT NULL AS warned, message FROM c UNION ALL SELECT 'status', bool_or(message IS NOT NULL), CASE WHEN bool_or(message IS NOT NULL) THEN 'WARN' ELSE 'OK' END FROM c"""
