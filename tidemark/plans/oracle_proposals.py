"""SQL of the queries over proposals. Gates and sizes are written apart (reject_tally, position_size), as is the ROI in the SQL of the
search over tiers. The other row formulas are the operators' own sheets, so their texts hold the engines against each other;
tests/test_rules.py holds the formulas against hand-worked cases."""

from __future__ import annotations

from tidemark.functions.sheets import as_sql
from tidemark.operators import proposals as p
from tidemark.sources.adapters import LINE_BINS, PROPOSALS

BASE = as_sql("lineitem", *PROPOSALS)
JUDGED = f"judged AS (SELECT * FROM {as_sql(BASE, *p.FULL)})"


def _rounded(names: tuple[str, ...], digits: int) -> str:
    return ", ".join(f"round({n} + 1e-9::DOUBLE, {digits}) AS {n}" for n in names)


# The gates, written apart from the operator's sheet: the name of the first condition that holds.
_GATES = {
    "vix_gate": "vix >= 35", "invalid_ticker": "symbol IS NULL OR length(trim(symbol)) = 0", "earnings": "days_to_earnings >= 0 AND days_to_earnings <= 7",
    "not_shortlisted": "decision IS DISTINCT FROM '[YES]' OR coalesce(category = 'routine_news' OR category = 'analyst_opinion', false) OR n_expiries IS NULL OR n_expiries < 2",
    "roi_precheck": "dte >= 21 AND dte <= 45 AND roi_net < -0.30", "pre_mc": "hit_rate < 0.40", "red_team_veto": "veto", "bearish_disabled": "direction = 'BEARISH'",
    "impact_x_surprise_below_floor": "impact_capped IS NULL OR surprise IS NULL OR impact_capped < 4 OR surprise < 3", "no_mismatch": "mismatch IS NULL OR mismatch <= 0", "mismatch_overreaction": "mismatch > 7",
    "mc_invalid_hit_rate": "hit_rate IS NULL OR hit_rate < 0 OR hit_rate > 1", "mc_below_threshold": "hit_rate < CASE WHEN vix < 20 THEN 0.48 WHEN vix > 30 THEN 0.42 ELSE 0.45 END",
    "intraday_too_late": "abs(intraday_move) > CASE WHEN mismatch >= 7 THEN 0.12 WHEN mismatch >= 5 THEN 0.09 ELSE 0.07 END",
    "final_mc_invalid": "final_hit_rate IS NULL OR NOT final_hit_rate BETWEEN 0 AND 1", "final_mc_zero_prob": "final_hit_rate < 0.01", "final_mc_below_threshold": "final_hit_rate < CASE WHEN quick_days > 30 THEN 0.50 ELSE 0.45 END",
    "bear_case": "severity >= 8", "sector_weak": "CASE WHEN direction = 'BULLISH' THEN sector_strength < -0.15 ELSE sector_strength > 0.15 END", "dte_floor": "dte IS NULL OR dte < dte_floor",
    "decay": "dte <= 60 AND (theta_pct > 0.03 OR vega_loss > 0.35)", "roi_gate": "NOT coalesce(ask > 0 AND price > 0 AND roi_net >= min_roi, false)", "no_edge": "edge <= 0.005",
}
GATED = f"judged AS (SELECT *, ([{', '.join(map(repr, _GATES))}])[list_position([{', '.join(f'coalesce({c}, false)' for c in _GATES.values())}], true)] AS reject_reason FROM {as_sql(BASE, *p.JUDGEMENT, *p.MISMATCH, *p.STRATEGY, *p.ROI)})"

_gone: list[str] = []
_counts = []
for _stage, _reasons in p.FUNNEL.items():
    _gone += _reasons
    _counts.append(f"count(*){' FILTER (reject_reason IS NULL OR reject_reason NOT IN (' + ', '.join(map(repr, _gone)) + '))' if _gone else ''} AS {_stage}")
_counts.append("count(*) FILTER (reject_reason IS NULL AND total >= 55) AS trades")
_names = [*p.FUNNEL, "trades"]
_known = " ".join(f"LEFT JOIN (SELECT bin AS bin_{f}, avg_return AS known_{f} FROM bins WHERE feature = '{f}' AND count >= 3) k_{f} USING (bin_{f})" for f in p.WEIGHTS)

SQL: dict[str, str] = {
    "option_roi": f"SELECT proposal_id, catalyst_type, tier, {_rounded(('roi_gross', 'roi_net', 'spread_pct', 'vega_loss', 'theta_pct', 'delta_used', 'commission_pct', 'min_roi', 'annual_roi', 'break_even', 'edge'), 5)}, passes_roi, skip_tier, has_edge FROM {as_sql(BASE, *p.JUDGEMENT, *p.MISMATCH, *p.ROI)}",
    "trade_score": f"WITH {JUDGED} SELECT proposal_id, ticker, {_rounded(('signal_pts', 'options_pts', 'risk_pts', 'context_pts'), 3)}, total, grade, route, mailed, fund, reject_reason FROM judged",
    "proposal_rank": f"WITH {JUDGED} SELECT run_date, ticker, proposal_id, total, grade, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY total DESC, ticker, proposal_id) AS rank FROM judged) WHERE rank <= 5",
    "reject_tally": f"""WITH {GATED}, r AS (SELECT date_trunc('month', run_date)::DATE AS month, reject_reason, ticker, count(*) AS n FROM judged WHERE reject_reason IS NOT NULL GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY month, reject_reason ORDER BY ticker) AS k FROM r)
 SELECT month, reject_reason, CAST(sum(n) AS BIGINT) AS count, string_agg(lpad(CAST(ticker AS VARCHAR), 12, '0'), ',' ORDER BY ticker) FILTER (k <= 10) AS tickers FROM k GROUP BY 1, 2""",
    "funnel_month": f"WITH {JUDGED}, f AS (SELECT date_trunc('month', run_date)::DATE AS month, {', '.join(_counts)} FROM judged GROUP BY 1) SELECT *, CASE {' '.join(f'WHEN {n} = 0 THEN {n!r}' for n in _names)} END AS killer FROM f",
    "position_size": f"""WITH {GATED}, e AS (SELECT *, CASE WHEN strategy LIKE '%SPREAD%' AND net_debit <> 0 THEN net_debit ELSE coalesce(ask, 0) END * 100 AS c0, CASE WHEN coalesce(hit_rate, 0) = 0 THEN 0.5 WHEN hit_rate > 0.75 THEN 0.75 WHEN hit_rate < 0.05 THEN 0.05 ELSE hit_rate END::DOUBLE AS w, CASE WHEN roi_net > 0.01 THEN roi_net ELSE 0.01 END::DOUBLE AS gain FROM judged WHERE reject_reason IS NULL),
 k AS (SELECT *, round(c0 + 1e-9::DOUBLE, 2) AS cost1, w - (1 - w) * 0.80 / gain AS full_kelly FROM e), s AS (SELECT *, CASE WHEN full_kelly <= 0 THEN 0 WHEN full_kelly >= 0.4 THEN 0.1 ELSE full_kelly / 4 END::DOUBLE AS part FROM k),
 u AS (SELECT *, round(5000 * part + 1e-9::DOUBLE, 2) AS usd FROM s), n AS (SELECT *, CASE WHEN cost1 > 0 THEN CAST(floor(usd / cost1) AS BIGINT) ELSE 0 END AS number FROM u)
 SELECT proposal_id, round(full_kelly + 1e-9::DOUBLE, 5) AS kelly, round(part + 1e-9::DOUBLE, 5) AS position_pct, usd AS position_usd, cost1 AS unit_cost, number AS contracts, round(number * cost1 * 0.80::DOUBLE, 4) AS max_risk, CASE WHEN full_kelly <= 0 THEN 'no edge' WHEN number = 0 AND cost1 > 0 THEN 'too dear' ELSE '' END AS note FROM n""",
    "exit_sheet": f"WITH {JUDGED} SELECT proposal_id, width, {_rounded(('take_profit', 'full_profit', 'stop_loss', 'ticket_break_even', 'max_roi', 'pnl_stop', 'pnl_take', 'pnl_full'), 4)}, exit_days, exit_date FROM judged",
    "strategy_choice": f"WITH {JUDGED} SELECT gamma, vix_structure, direction, chosen, count(*) AS n, sum(iv_rank) AS iv_rank_sum FROM judged GROUP BY 1, 2, 3, 4",
    "roi_gap_spread": f"""WITH {JUDGED}, r AS (SELECT tier, round(roi_gap, 4) AS gap FROM judged WHERE reject_reason = 'roi_gate')
 SELECT tier, count(*) AS n, min(gap) AS least, list_sort(list(gap))[count(*) // 2 + 1] AS upper_median, max(gap) AS most FROM r GROUP BY 1""",
    "best_rejects": f"""WITH {JUDGED} SELECT ticker, month, proposal_id, tier, round(roi_net, 5) AS roi_net, round(roi_net - min_roi, 5) AS roi_gap FROM
 (SELECT *, date_trunc('month', run_date)::DATE AS month, row_number() OVER (PARTITION BY ticker, date_trunc('month', run_date) ORDER BY round(roi_net, 6) DESC, proposal_id) AS k FROM judged WHERE reject_reason = 'roi_gate') WHERE k = 1""",
    "bin_score": f"""WITH {JUDGED}, bins AS (SELECT feature, bin, count(*) AS count, round(avg(outcome), 6) AS avg_return FROM ({LINE_BINS.format(lines='lineitem')}) GROUP BY 1, 2),
 r AS (SELECT * FROM judged {_known}),
 v AS (SELECT *, {' + '.join(f"coalesce(known_{f}, {p.choose(f'bin_{f}', p.PRIORS[f], 0)}) * {w}" for f, w in p.WEIGHTS.items())} AS learned, impact_capped / 10 * 0.35 + least(coalesce(mismatch, 0) / 10, 1) * 0.45 + least(abs(coalesce(eps_drift, 0)), 0.2) / 0.2 * 0.20 AS plain FROM r),
 b AS (SELECT *, round(CASE WHEN learned = 0 THEN plain ELSE learned END, 4) AS base FROM v),
 k AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY base DESC, ticker, proposal_id) AS rank FROM b)
 SELECT run_date, proposal_id, rank, base, round(CASE WHEN rank <= 2 THEN base + 0.10 * dealer ELSE base END, 4) AS final_score, crush_risk, flow_bias FROM k WHERE rank <= 5""",
}
