"""SQL of the search over tiers, written apart from the operator's sheets."""

from __future__ import annotations

from tidemark.functions.sheets import as_sql
from tidemark.sources.adapters import PROPOSALS


def _normal(x: str) -> str:
    """P(N <= x): Abramowitz and Stegun 7.1.26."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x} / sqrt(2))))"
    tail = f"(0.254829592::DOUBLE * {t} - 0.284496736::DOUBLE * pow({t}, 2) + 1.421413741::DOUBLE * pow({t}, 3) - 1.453152027::DOUBLE * pow({t}, 4) + 1.061405429::DOUBLE * pow({t}, 5)) * exp(-{x} * {x} / 2)"
    return f"((1 + sign({x}) * (1 - {tail})) / 2)"


def tier_sql(chain: str, bars: str, gamma: str, strict: bool) -> str:
    """chain, bars: CTEs named chain and sbars; gamma: a query of ticker, run_month, gamma."""
    leg = "nd IS NOT NULL" if strict else "true"
    return f"""WITH {chain}, {bars},
 c0 AS (SELECT proposal_id AS candidate_id, ticker, run_date, direction, coalesce(nullif(hit_rate, 0), 0.65::DOUBLE) AS hit, iv_rank, coalesce(nullif(vix, 0), 20) AS vix, vix_structure, (5 + l_orderkey % 30) / 100 AS move,
   CASE WHEN lower(coalesce(horizon, '')) LIKE '%6 monat%' THEN 140 ELSE 120 END AS floor_days,
   CASE WHEN fda THEN 'FDA' WHEN abs(coalesce(eps_drift, 0)) > 0.05 OR regexp_matches(lower(catalyst_text), 'earnings| eps|ergebnis|guidance') THEN 'EARNINGS'
    WHEN regexp_matches(lower(catalyst_text), 'merger|acquisition|takeover|buyout|übernahme|deal|m&a') THEN 'MA' WHEN insider_cluster OR lower(catalyst_text) LIKE '%insider%' THEN 'INSIDER' ELSE 'OTHER' END AS class
  FROM {as_sql("lineitem", *PROPOSALS)}),
 pr AS (SELECT n.ticker, n.run_date, b.close AS price FROM (SELECT DISTINCT ticker, run_date FROM c0) n ASOF LEFT JOIN sbars b ON n.ticker = b.ticker AND n.run_date >= b.d),
 g AS ({gamma}),
 c AS (SELECT c0.*, price, price * (1 + move) AS target, coalesce(gamma, 'neutral') AS gamma FROM c0 LEFT JOIN pr USING (ticker, run_date) LEFT JOIN g ON g.ticker = c0.ticker AND g.run_month = date_trunc('month', run_date)::DATE),
 gate AS (SELECT *, CASE WHEN vix_structure = 'backwardation' THEN greatest(base - 8, 35) ELSE base END AS gate FROM (SELECT *, CASE gamma WHEN 'negative' THEN 65 WHEN 'positive' THEN 40 ELSE 52 END AS base FROM c)),
 s AS (SELECT *, iv_rank >= gate AS wants_spread, direction = 'BULLISH' AS up FROM gate),
 tiers(tier_no, tier, dmin, dmax, roi, hi, lo) AS (VALUES (1, 'Short-Term', 14, 60, 0.15::DOUBLE, 1.03::DOUBLE, 0.97::DOUBLE), (2, 'Mid-Term', 61, 149, 0.12, 1.08, 0.96), (3, 'Long-Term', 150, 365, 0.10, 1.12, 0.95)),
 ex AS (SELECT ticker, expiry FROM chain GROUP BY 1, 2),
 e AS (SELECT ticker, run_date, any_value(price) AS price, tier_no, any_value(hi) AS hi, any_value(lo) AS lo, min(expiry) AS expiry FROM pr JOIN ex USING (ticker), tiers WHERE price > 0 AND expiry - run_date BETWEEN dmin AND dmax GROUP BY 1, 2, 4),
 k AS (SELECT *, row_number() OVER (PARTITION BY ticker, run_date, tier_no, type ORDER BY coalesce(abs(delta) BETWEEN 0.55 AND 0.75, false) DESC, oi DESC, strike, row) AS k FROM e JOIN chain USING (ticker, expiry)
   WHERE oi >= 100 AND (ask - bid) / greatest(ask, 0.01) <= 0.10 AND strike >= price * CASE WHEN price * (hi - 1) < 15 THEN round(1 - 15 / price, 4) ELSE lo END AND strike <= price * CASE WHEN price * (hi - 1) < 15 THEN round(1 + 15 / price, 4) ELSE hi END),
 pick AS (SELECT ticker, run_date, tier_no, type, expiry, expiry - run_date AS dte, strike, bid, ask, iv, delta FROM k WHERE k = 1),
 longs AS (SELECT DISTINCT ticker, expiry, type, strike FROM pick),
 legs AS (SELECT l.ticker, l.expiry, l.type, l.strike, x.strike AS k2, x.bid AS bid2, row_number() OVER (PARTITION BY l.ticker, l.expiry, l.type, l.strike ORDER BY round(abs(x.strike - l.strike * 1.10), 6), x.strike, x.row) AS k
   FROM longs l JOIN chain x ON x.ticker = l.ticker AND x.expiry = l.expiry AND x.type = l.type AND x.strike >= l.strike * 1.05 AND x.strike <= l.strike * 1.20),
 a AS (SELECT s.*, t.tier_no, t.tier, t.dmin, t.roi AS tier_roi, p.expiry, p.dte, p.strike, p.bid, p.ask, p.iv, p.delta, CASE WHEN bid2 > 0 THEN k2 END AS k2, CASE WHEN bid2 > 0 THEN round(ask - bid2 + 1e-9::DOUBLE, 2) END AS nd
   FROM s CROSS JOIN tiers t LEFT JOIN pick p ON p.ticker = s.ticker AND p.run_date = s.run_date AND p.tier_no = t.tier_no AND p.type = CASE WHEN up THEN 'call' ELSE 'put' END
   LEFT JOIN legs l ON l.k = 1 AND l.ticker = p.ticker AND l.expiry = p.expiry AND l.type = p.type AND l.strike = p.strike),
 b AS (SELECT *, wants_spread AND {leg} AS spread, CASE WHEN wants_spread AND {leg} AND nd IS NOT NULL THEN nd ELSE ask END AS cost, greatest(dte, 1) / 365 AS years, CASE WHEN iv < 0.05 OR iv > 3 THEN 0.30::DOUBLE ELSE coalesce(nullif(iv, 0), 0.30::DOUBLE) END AS vol FROM a),
 d AS (SELECT *, round(tier_roi * CASE WHEN vix < 18 THEN 0.70::DOUBLE WHEN vix < 22 THEN 0.85 WHEN vix < 28 THEN 1 ELSE 1.20 END, 3) AS min_roi, cost > 0 AND price > 0 AS ok, (ln(price / strike) + vol * vol / 2 * years) / (vol * sqrt(years)) AS d1 FROM b),
 f AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS dens, CASE WHEN abs(delta) BETWEEN 0.01 AND 0.99 THEN delta ELSE {_normal("d1")} END * CASE WHEN spread THEN 0.80::DOUBLE ELSE 1 END AS dl,
   CASE class WHEN 'EARNINGS' THEN [0.42::DOUBLE, 0.18, 0.06] WHEN 'FDA' THEN [0.60::DOUBLE, 0.22, 0.08] WHEN 'MA' THEN [0.25::DOUBLE, 0.10, 0.03] WHEN 'INSIDER' THEN [0.10::DOUBLE, 0.04, 0.01] ELSE [0.22::DOUBLE, 0.10, 0.03] END[tier_no]
    * (0.5 + iv_rank / 200) * CASE vix_structure WHEN 'backwardation' THEN 1.20::DOUBLE WHEN 'contango' THEN 0.85 ELSE 1 END AS iv_drop FROM d),
 r AS (SELECT *, price * dens * vol / (2 * sqrt(years)) / 365 / cost AS theta, least(price * dens * sqrt(years) * vol * iv_drop / cost, 0.50) AS vega_loss, (ask - bid) / ask AS bidask, 0.65::DOUBLE * CASE WHEN spread THEN 4 ELSE 2 END / (cost * 100) AS fee,
   (target - price) / price AS mv, (strike + CASE WHEN spread AND nd > 0 THEN nd ELSE ask END - price) / price AS even FROM f),
 n AS (SELECT *, CASE WHEN ok THEN mv * dl * (price / cost) * least(hit, 0.95) - 2 * bidask - vega_loss - fee ELSE 0 END AS net FROM r),
 v AS (SELECT *, CASE WHEN dmin < floor_days THEN 'below_floor' WHEN strike IS NULL THEN 'no_contract' WHEN tier_no = 1 AND theta > 0.03 THEN 'theta' WHEN tier_no = 1 AND vega_loss > 0.35 THEN 'vega'
   WHEN NOT (ok AND net >= min_roi) THEN 'roi' WHEN NOT mv - even > 0.005 THEN 'edge' ELSE 'pass' END AS status FROM n),
 w AS (SELECT *, min(CASE WHEN status = 'pass' THEN tier_no END) OVER (PARTITION BY candidate_id) AS won, row_number() OVER (PARTITION BY candidate_id ORDER BY CASE WHEN status <> 'below_floor' AND strike IS NOT NULL THEN round(net, 6) END DESC NULLS LAST, tier_no) AS pos FROM v),
 told AS (SELECT candidate_id, string_agg(status, ',' ORDER BY tier_no) AS tried FROM w WHERE won IS NULL OR tier_no <= won GROUP BY 1)
SELECT w.candidate_id, CASE WHEN won IS NULL THEN 'no tier' ELSE tier END AS tier, tried, CASE WHEN won IS NOT NULL THEN CASE WHEN spread THEN CASE WHEN up THEN 'BULL_CALL_SPREAD' ELSE 'BEAR_PUT_SPREAD' END WHEN up THEN 'LONG_CALL' ELSE 'LONG_PUT' END END AS strategy,
 CASE WHEN won IS NOT NULL THEN expiry END AS expiry, CASE WHEN won IS NOT NULL THEN dte END AS dte, CASE WHEN won IS NOT NULL THEN strike END AS strike, CASE WHEN won IS NOT NULL THEN ask END AS ask, CASE WHEN won IS NOT NULL THEN k2 END AS k2,
 CASE WHEN won IS NOT NULL AND spread THEN nd END AS net_debit, CASE WHEN won IS NOT NULL THEN round(net + 1e-9::DOUBLE, 5) END AS roi_net, CASE WHEN won IS NOT NULL THEN round(min_roi + 1e-9::DOUBLE, 5) END AS min_roi,
 CASE WHEN won IS NOT NULL THEN round(CASE WHEN 1 + net < 0 THEN 0 ELSE least(pow(1 + net, 365 / greatest(dte, 1)) - 1, 9.99) END + 1e-9::DOUBLE, 5) END AS annual_roi, CASE WHEN won IS NOT NULL THEN round(mv - even + 1e-9::DOUBLE, 5) END AS edge,
 CASE WHEN won IS NULL AND strike IS NOT NULL AND status <> 'below_floor' THEN tier END AS best_tier, CASE WHEN won IS NULL AND strike IS NOT NULL AND status <> 'below_floor' THEN round(net - min_roi + 1e-9::DOUBLE, 5) END AS best_gap
 FROM w JOIN told USING (candidate_id) WHERE tier_no = won OR (won IS NULL AND pos = 1)"""


def precheck_sql(chain: str, bars: str) -> str:
    return f"""WITH {chain}, {bars},
 c AS (SELECT proposal_id AS candidate_id, ticker, run_date, iv_rank, vix_structure FROM {as_sql("lineitem", *PROPOSALS)}),
 pr AS (SELECT n.ticker, n.run_date, b.close AS price FROM (SELECT DISTINCT ticker, run_date FROM c) n ASOF LEFT JOIN sbars b ON n.ticker = b.ticker AND n.run_date >= b.d),
 e AS (SELECT ticker, run_date, any_value(price) AS price, min(expiry) AS expiry FROM pr JOIN (SELECT DISTINCT ticker, expiry FROM chain) USING (ticker) WHERE expiry - run_date BETWEEN 21 AND 45 GROUP BY 1, 2),
 k AS (SELECT *, expiry - run_date AS dte, row_number() OVER (PARTITION BY ticker, run_date ORDER BY coalesce(abs(delta) BETWEEN 0.55 AND 0.75, false) DESC, oi DESC, strike, row) AS k FROM e JOIN chain USING (ticker, expiry) WHERE type = 'call'
   AND oi >= 100 AND (ask - bid) / greatest(ask, 0.01) <= 0.10 AND strike >= price * CASE WHEN price * (1.03::DOUBLE - 1) < 15 THEN round(1 - 15 / price, 4) ELSE 0.97 END AND strike <= price * CASE WHEN price * (1.03::DOUBLE - 1) < 15 THEN round(1 + 15 / price, 4) ELSE 1.03 END),
 r AS (SELECT c.*, strike, dte, ask, bid, price, dte / 365 AS years, iv, (ln(price / strike) + iv * iv / 2 * dte / 365) / (iv * sqrt(dte / 365)) AS d1, delta FROM c LEFT JOIN (SELECT * FROM k WHERE k = 1) x USING (ticker, run_date)),
 n AS (SELECT *, (price * 1.08::DOUBLE - price) / price * CASE WHEN abs(delta) BETWEEN 0.01 AND 0.99 THEN delta ELSE {_normal("d1")} END * price / ask * 0.65 - 2 * (ask - bid) / ask - 1.3 / (ask * 100)
   - least(price * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(years) * iv * 0.22::DOUBLE * (0.5 + iv_rank / 200) * CASE vix_structure WHEN 'backwardation' THEN 1.20::DOUBLE WHEN 'contango' THEN 0.85 ELSE 1 END / ask, 0.50) AS net FROM r)
SELECT candidate_id, strike, dte, CASE WHEN strike IS NULL THEN 1e-9::DOUBLE * 0 ELSE round(net + 1e-9::DOUBLE, 5) END AS roi_net, strike IS NULL OR net >= -0.30 AS stays FROM n"""
