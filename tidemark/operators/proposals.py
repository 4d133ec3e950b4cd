"""Trade proposals: catalyst class, strategy choice, option ROI, edge, gates, score, size, exit sheet. All are column
expressions over one row a proposal, so that a plan is one scan and one projection, whatever the number of rules.

A gate marks a row with its reason and never drops it: survivors and funnel counts come from the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sheets import Sheet, add, choose, in_small_methods, present, steps

# Share of implied volatility that an event takes away, by class and days to expiry.
CRUSH = {"EARNINGS": (0.42, 0.18, 0.06), "FDA": (0.60, 0.22, 0.08), "MA": (0.25, 0.10, 0.03), "INSIDER": (0.10, 0.04, 0.01), "OTHER": (0.22, 0.10, 0.03)}
# Days to expiry and least ROI of the tiers.
TIERS = {"Short-Term": (14, 60, 0.15), "Mid-Term": (61, 149, 0.12), "Long-Term": (150, 365, 0.10)}
# How much a sector follows the macro regime.
SENSITIVITY = {
    "Financial Services": 1.00, "Financials": 1.00, "Real Estate": 0.85, "Consumer Cyclical": 0.70, "Industrials": 0.70, "Technology": 0.60, "Communication Services": 0.50,
    "Basic Materials": 0.50, "Energy": 0.40, "Utilities": 0.55, "Consumer Defensive": 0.25, "Healthcare": 0.20, "Biotechnology": 0.10,
}
# sectors' benchmark funds.
SECTOR_FUND = {
    "Technology": "XLK", "Healthcare": "XLV", "Biotechnology": "XBI", "Financial Services": "XLF", "Financials": "XLF", "Energy": "XLE", "Consumer Cyclical": "XLY",
    "Consumer Defensive": "XLP", "Industrials": "XLI", "Basic Materials": "XLB", "Real Estate": "XLRE", "Utilities": "XLU", "Communication Services": "XLC",
}
# Words that tell a catalyst's class.
CATALYST_WORDS = {"EARNINGS": "earnings| eps|ergebnis|guidance", "MA": "merger|acquisition|takeover|buyout|übernahme|deal|m&a", "INSIDER": "insider"}
# Phrases that make a veto, words of a bullish and of a bearish reason.
VETO = "narrativ-mismatch|narrative mismatch|trifft das geschäftsmodell|falsches narrativ|datenfehler in der vorselektion|grundlegendes missverständnis|trifft nicht zu"
UPBEAT = "positiv|erhöht|wachstum|deal|akquisition|expansion|gewinn|stieg|prognose"
DOWNBEAT = "warnung|verlust|rückgang|verfehlt|kürzung|rechtsstreit|rückruf|gegenwind|sinkt|enttäuscht"
# ROI limits by market volatility; weights and prior returns of the feature bins.
ROI_BY_VIX = [("< 18", 0.70), ("< 22", 0.85), ("< 28", 1.00)]
WEIGHTS = {"impact": 0.35, "mismatch": 0.45, "eps": 0.20}
PRIORS = {"impact": {"low": -0.02, "mid": 0.04, "high": 0.12}, "mismatch": {"weak": -0.01, "good": 0.05, "strong": 0.15}, "eps": {"noise": 0.0, "relevant": 0.04, "massive": 0.10}}

SPREAD = "strategy like '%SPREAD%'"


def normal(x: str) -> str:
    """The normal distribution function, by a rational approximation (error below 2e-7)."""
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(cast(2 as double))))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(0.5 * (1 + sign({x}) * (1 - {poly} * exp(-({x}) * ({x}) / 2))))"


# ---- judgement: class of the catalyst, veto, conflict, horizon
JUDGEMENT: list[Sheet] = [
    {
        "catalyst_type": f"case when fda then 'FDA' when abs(coalesce(eps_drift, 0)) > 0.05 or matches(lower(catalyst_text), '{CATALYST_WORDS['EARNINGS']}') then 'EARNINGS' "
        f"when matches(lower(catalyst_text), '{CATALYST_WORDS['MA']}') then 'MA' when insider_cluster or matches(lower(catalyst_text), '{CATALYST_WORDS['INSIDER']}') then 'INSIDER' else 'OTHER' end",
        "veto": f"coalesce(verdict = 'VETO', false) or matches(lower(coalesce(argument, '')), '{VETO}')",
        "conflict": f"(direction = 'BEARISH' and matches(lower(reason_text), '{UPBEAT}')) or (direction = 'BULLISH' and (matches(lower(reason_text), '{DOWNBEAT}') or category = 'bearish_reversal'))",
        "dte_floor": "case when lower(coalesce(horizon, '')) like '%6 monat%' then 140 else 120 end",
        "shortlisted": "coalesce(decision, '') = '[YES]' and coalesce(category, '') not in ('routine_news', 'analyst_opinion') and coalesce(n_expiries, 0) >= 2",
    },
    {"impact_capped": "case when impact > 6 and (concern = 'high' or conflict) then 6 else impact end"},
]

# ---- mismatch and bins
MISMATCH: list[Sheet] = [
    {"z": "abs(move_48h) / nullif(sigma_30, 0)"},
    {
        "mismatch": "round(impact_capped - 5 * z, 3)",
        "bin_impact": steps("impact_capped", [("<= 4", "low"), ("<= 7", "mid")], "high"),
        "bin_eps": steps("abs(coalesce(eps_drift, 0))", [("> 0.10", "massive"), ("> 0.05", "relevant")], "noise"),
    },
    {"bin_mismatch": "case when mismatch is null then null when mismatch < 3 then 'weak' when mismatch <= 6 then 'good' else 'strong' end"},
]

# ---- strategy: spread or single leg, by rank of implied volatility, dealers' gamma and the volatility term structure
STRATEGY: list[Sheet] = [
    {"iv_gate": "case gamma when 'negative' then 65 when 'positive' then 40 else 52 end"},
    {"iv_gate_used": "case when vix_structure = 'backwardation' then greatest(iv_gate - 8, 35) else iv_gate end"},
    {"chosen": "case when iv_rank >= iv_gate_used then case when direction = 'BULLISH' then 'BULL_CALL_SPREAD' else 'BEAR_PUT_SPREAD' end when direction = 'BULLISH' then 'LONG_CALL' else 'LONG_PUT' end"},
]

# ---- return of the option if the target is reached, net of spread, crush and commission
ROI: list[Sheet] = [
    {
        "is_spread": SPREAD,
        "tier": "case when dte <= 60 then 'Short-Term' when dte <= 149 then 'Mid-Term' else 'Long-Term' end",
        "iv_used": f"case when {present('iv', 0.30)} < 0.05 or {present('iv', 0.30)} > 3.0 then cast(0.30 as double) else {present('iv', 0.30)} end",
        "years": "greatest(cast(dte as double), 1) / 365",
    },
    {
        "cost": "case when is_spread then coalesce(net_debit, ask) else ask end",
        "tier_roi": choose("tier", {t: v[2] for t, v in TIERS.items()}),
        "roi_factor": steps(present("vix", 20), ROI_BY_VIX, 1.20),
        "crush_base": "case when dte <= 60 then {} when dte <= 149 then {} else {} end".format(*(choose("catalyst_type", {k: v[i] for k, v in CRUSH.items()}, CRUSH["OTHER"][i]) for i in range(3))),
        "crush_scale": steps("vix_structure", [("= 'backwardation'", 1.20), ("= 'contango'", 0.85)], 1.0),
    },
    {"usable": "cost > 0 and price > 0", "min_roi": "round(tier_roi * roi_factor, 3)"},
    {"d1": "case when usable and strike > 0 then (ln(price / strike) + 0.5 * iv_used * iv_used * years) / (iv_used * sqrt(years)) end"},
    {"density": "coalesce(exp(-0.5 * d1 * d1) / sqrt(2 * pi()), 0)"},
    {
        "delta_used": f"case when abs(delta) between 0.01 and 0.99 then delta else coalesce({normal('d1')}, 0.5) end * case when is_spread then cast(0.80 as double) else 1 end",
        "vega": "price * density * sqrt(years)",
        "spread_pct": "case when usable and ask > 0 then (ask - bid) / ask else 0 end",
        "theta_pct": "case when usable then price * density * iv_used / (2 * sqrt(years)) / 365 / cost else 0 end",
        "model_move": "case when price > 0 and target > price then (target - price) / price else 0 end",
        "commission_pct": "case when usable then cast(0.65 as double) * case when is_spread then 2 else 1 end * 2 / (cost * 100) else 0 end",
        "iv_drop": "crush_base * (0.5 + iv_rank / cast(200 as double)) * crush_scale",
    },
    {"roi_gross": "case when usable then model_move * delta_used * (price / cost) * least(hit_rate, 0.95) else 0 end", "vega_loss": "case when usable then least(vega * iv_used * iv_drop / cost, 0.50) else 0 end"},
    {"roi_net": "case when usable then roi_gross - 2 * spread_pct - vega_loss - commission_pct else 0 end"},
    {
        "passes_roi": "usable and roi_net >= min_roi",
        "skip_tier": "tier = 'Short-Term' and (theta_pct > 0.03 or vega_loss > 0.35)",
        "annual_roi": "case when 1 + roi_net < 0 then 0 else least(power(1 + roi_net, 365 / greatest(cast(dte as double), 1)) - 1, 9.99) end",
        "break_even": "case when price > 0 and strike > 0 and is_spread and net_debit > 0 then (strike + net_debit - price) / price when price > 0 and strike > 0 and ask > 0 then (strike + ask - price) / price else straddle_move / 2 end",
        "roi_gap": "roi_net - min_roi",
    },
    {"edge": "model_move - break_even"},
    {"has_edge": "coalesce(edge > 0.005, true)"},
]

# ---- gates, in the order of the funnel. Missing numbers fail the gate that needs them, but for those whose absence says nothing:
# volatility (then 20), earnings date, intraday move, sector strength, bear-case severity. A volatility that is no number, or none
# above 0, tells no calm market from a wild one and takes the middle limit.
GATES: list[Sheet] = [
    {
        "mc_limit": "case when vix is null or isnan(cast(vix as double)) or vix <= 0 then cast(0.45 as double) when vix < 20 then cast(0.48 as double) when vix > 30 then cast(0.42 as double) else cast(0.45 as double) end",
        "final_limit": "case when coalesce(quick_days, 30) <= 30 then cast(0.45 as double) else cast(0.50 as double) end",
        "intraday_limit": steps("mismatch", [(">= 7", 0.12), (">= 5", 0.09)], 0.07),
    },
    {
        "reject_reason": "case when coalesce(vix, 20) >= 35 and not isnan(cast(coalesce(vix, 20) as double)) then 'vix_gate' when trim(coalesce(symbol, '')) = '' then 'invalid_ticker' when days_to_earnings between 0 and 7 then 'earnings' "
        "when not shortlisted then 'not_shortlisted' when roi_net < -0.30 and dte between 21 and 45 then 'roi_precheck' when hit_rate < 0.40 then 'pre_mc' when veto then 'red_team_veto' "
        "when direction = 'BEARISH' then 'bearish_disabled' when coalesce(impact_capped, 0) < 4 or coalesce(surprise, 0) < 3 then 'impact_x_surprise_below_floor' when isnan(cast(mismatch as double)) then 'invalid_mismatch' when mismatch is null or mismatch <= 0 then 'no_mismatch' "
        "when mismatch > 7 then 'mismatch_overreaction' when hit_rate is null or isnan(cast(hit_rate as double)) or hit_rate < 0 or hit_rate > 1 then 'mc_invalid_hit_rate' "
        "when hit_rate < mc_limit then 'mc_below_threshold' when abs(coalesce(intraday_move, 0)) > intraday_limit then 'intraday_too_late' when final_hit_rate is null or isnan(cast(final_hit_rate as double)) or final_hit_rate < 0 or final_hit_rate > 1 then 'final_mc_invalid' when final_hit_rate < 0.01 then 'final_mc_zero_prob' when final_hit_rate < final_limit then 'final_mc_below_threshold' "
        "when severity >= 8 then 'bear_case' when coalesce(case when direction = 'BULLISH' then sector_strength < -0.15 else sector_strength > 0.15 end, false) then 'sector_weak' "
        "when coalesce(dte, 0) < dte_floor then 'dte_floor' when skip_tier then 'decay' when not coalesce(passes_roi, false) then 'roi_gate' when not has_edge then 'no_edge' end",
    },
]

# ---- score of 0 to 100
SCORE: list[Sheet] = [
    {
        "signal_pts": "case when impact_capped > 0 and surprise > 0 then half_even(sqrt(cast(impact_capped * surprise as double)) / 10 * 40, 1) else 0 end",
        "roi_penalty": "case when roi_net > 0.50 and dte < 30 then -6 when roi_net > 0.80 and dte < 60 then -3 else 0 end",
        "roi_scored": "case when roi_net > 0.50 and dte < 30 then cast(0.20 as double) when roi_net > 0.80 and dte < 60 then cast(0.25 as double) else least(greatest(roi_net, 0), 0.40) end",
        "liquidity_pts": steps(present("spread_pct", 1), [("<= 0.05", 10), ("<= 0.10", 7), ("<= 0.20", 4)], 1),
        "oi_pts": steps("coalesce(open_interest, 0)", [(">= 1000", 5), (">= 500", 3), (">= 100", 1.5)], 0.5),
        "edge_pts": steps("edge * 100", [("< -2", -6), ("< 0", -2), ("> 5", 4)], 0),
        "bear_pts": "case when severity <= 6 then 0 when severity <= 7 then -5 * cast(severity - 5 as double) else -10 - 2.5 * cast(severity - 7 as double) end",
        "iv_pts": f"({steps(present('iv_rank', 50), [('>= 95', -10), ('>= 85', -5), ('>= 70', -2)], 0)}) * case when surprise >= 8 then cast(0.5 as double) else 1 end",
        "move_pts": steps("abs(coalesce(move_48h, 0))", [(">= 0.10", -5), (">= 0.05", -3)], 0),
        "macro_pts": f"half_even((case when macro_regime = 'expansive' then 10 when macro_regime in ('neutral', 'unknown') then 5 else 0 end) * ({choose('sector', SENSITIVITY, 0.50)}), 1)",
        "sector_pts": steps("coalesce(sector_strength, 0)", [(">= 0.03", 10), (">= 0", 5)], 0),
        "accord_pts": "case when conflict then -5 else 5 end",
        "fund": choose("sector", SECTOR_FUND, "SPY"),
    },
    {
        "options_pts": "least(greatest(half_even(half_even(roi_scored / 0.40 * 15, 1) + liquidity_pts + oi_pts + roi_penalty + edge_pts, 1), 0), 30)",
        "risk_pts": "half_even(bear_pts + iv_pts + move_pts, 1)",
        "context_pts": "least(half_even(macro_pts + sector_pts + accord_pts, 1), 30)",
    },
    {"total": "cast(least(greatest(half_even(signal_pts + options_pts + risk_pts + context_pts, 0), 0), 100) as int)"},
    {
        "grade": "case when total >= 75 then 'STRONG BUY' when total >= 60 then 'BUY' when total >= 45 then 'WATCH' else 'AVOID' end",
        "route": "case when total >= 55 then 'keep' when total >= 40 then 'shadow' else 'drop' end",
        "mailed": "total >= 65",
    },
]

# Share of the debit that a stopped trade is assumed to lose, of Kelly's share that is taken, of the book at most; the book.
LOSS, KELLY, LARGEST, BOOK_USD = 0.80, 0.25, 0.10, 5000


# ---- size of a position: a quarter of Kelly's share, at most a tenth
def size(loss: float = LOSS, kelly: float = KELLY, largest: float = LARGEST, book: float = BOOK_USD) -> list[Sheet]:
    return [
        {"entry": f"case when {SPREAD} and {present('net_debit', 'NULL')} is not null then net_debit else coalesce(ask, 0) end", "p_win": f"greatest(0.05, least({present('hit_rate', 0.5)}, 0.75))", "payoff": f"greatest(coalesce(roi_net, 0), 0.01) / {loss}"},
        {"unit_cost": "round(entry * 100 + 0.000000001, 2)", "kelly": "p_win - (1 - p_win) / payoff"},
        {"position_pct": f"least(greatest(kelly, 0) * {kelly}, {largest})"},
        {"position_usd": f"round({book} * position_pct + 0.000000001, 2)"},
        {"contracts": "case when unit_cost > 0 then cast(floor(position_usd / unit_cost) as bigint) else 0 end"},
        {"max_risk": f"contracts * unit_cost * {loss}", "note": "case when kelly <= 0 then 'no edge' when contracts = 0 and unit_cost > 0 then 'too dear' else '' end"},
    ]


SIZE = size()

# ---- exit sheet and ticket of an order
EXITS: list[Sheet] = [
    {"sheet_spread": SPREAD, "width": f"case when {SPREAD} and short_strike > strike then round(short_strike - strike + 0.000000001, 2) else 0 end"},
    {"max_profit": "case when width > 0 then round(width - entry + 0.000000001, 2) else 0 end"},
    {
        "take_profit": "case when entry <= 0 then 0 when sheet_spread and max_profit > 0 then round(entry + max_profit * 0.70 + 0.000000001, 2) else round(entry * 1.50 + 0.000000001, 2) end",
        "full_profit": "case when entry <= 0 then 0 when sheet_spread and max_profit > 0 then round(entry + max_profit * 0.90 + 0.000000001, 2) else round(entry * 2 + 0.000000001, 2) end",
        "stop_loss": "case when entry <= 0 then 0 when sheet_spread then round(entry * 0.50 + 0.000000001, 2) else round(entry * 0.55 + 0.000000001, 2) end",
        "exit_days": "case when entry <= 0 then 0 when sheet_spread then greatest(cast(floor(dte * cast(0.45 as double)) as int), 1) else greatest(cast(floor(dte / cast(2 as double)) as int), 1) end",
        "ticket_break_even": "strike + entry",
        "max_roi": "case when width > 0 and entry > 0 then (width - entry) / entry end",
    },
    {"exit_date": "case when entry > 0 then run_date + cast(dte - exit_days as int) end", "pnl_stop": "(stop_loss - entry) * 100", "pnl_take": "(take_profit - entry) * 100", "pnl_full": "(full_profit - entry) * 100"},
]

# ---- learned score of the bins, with priors where a bin has few trades, and the dealers' adjustment
PREMIUM: list[Sheet] = [
    {
        "dealer": "round(greatest(-1, least(1, sign(coalesce(gex, 0)) * least(abs(coalesce(gex, 0)) / 1000000000, 0.4) + case positioning when 'bullish' then cast(0.3 as double) when 'bearish' then cast(-0.3 as double) else 0 end)), 3)",
        "flow_bias": "case when abs(call_flow) + abs(put_flow) = 0 then 0 else round((call_flow - put_flow) / (abs(call_flow) + abs(put_flow)), 3) end",
        "crush_risk": steps("coalesce(iv_percentile, 50)", [("> 80", "high"), ("> 60", "medium")], "low"),
    },
]

FULL = [*JUDGEMENT, *MISMATCH, *STRATEGY, *ROI, *GATES, *SCORE, *SIZE, *EXITS, *PREMIUM]
#: The funnel's stages and the reasons that end before each.
FUNNEL = {
    "universe": (), "prescreened": ("vix_gate", "invalid_ticker", "earnings", "not_shortlisted"), "pre_mc": ("roi_precheck", "pre_mc"), "analyzed": ("red_team_veto", "bearish_disabled"),
    "after_floor": ("impact_x_surprise_below_floor",), "mismatch_ok": ("no_mismatch", "mismatch_overreaction", "invalid_mismatch"), "quick_mc": ("mc_invalid_hit_rate", "mc_below_threshold"), "intraday_ok": ("intraday_too_late",),
    "final_mc": ("final_mc_invalid", "final_mc_zero_prob", "final_mc_below_threshold"), "roi_ok": ("bear_case", "sector_weak", "dte_floor", "decay", "roi_gate", "no_edge"),
}


def rounded(names: tuple[str, ...], digits: int) -> list[Column]:
    """Rounded half up; the shift keeps exact halves from depending on their binary form."""
    return [F.round(F.col(n) + 1e-9, digits).alias(n) for n in names]


def judged(p: DataFrame) -> DataFrame:
    """All sheets. The reason passes a generator of one row: a filter on it is then not pushed into the sheets, where it would repeat
    every formula that it rests on until the code is too large to compile."""
    rows = add(in_small_methods(p), *FULL)
    return rows.select(*[c for c in rows.columns if c != "reject_reason"], F.explode(F.array("reject_reason")).alias("reject_reason"))


def option_roi(p: DataFrame) -> DataFrame:
    names = ("roi_gross", "roi_net", "spread_pct", "vega_loss", "theta_pct", "delta_used", "commission_pct", "min_roi", "annual_roi", "break_even", "edge")
    return add(in_small_methods(p), *JUDGEMENT, *MISMATCH, *ROI).select("proposal_id", "catalyst_type", "tier", *rounded(names, 5), "passes_roi", "skip_tier", "has_edge")


def reject_tally(p: DataFrame, shown: int = 10) -> DataFrame:
    """By run month and reason: the rejected proposals, and the `shown` smallest of their tickers, distinct. The tickers are cut
    after a partial aggregate by ticker, so that no list grows with the rows."""
    rows = judged(p).where("reject_reason is not null").select(F.trunc("run_date", "month").alias("month"), "reject_reason", "ticker")
    by = rows.groupBy("month", "reject_reason", "ticker").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("month", "reject_reason").orderBy("ticker"))
    by = by.withColumn("k", k)
    names = F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.lpad(F.col("ticker").cast("string"), 12, "0")))))
    return by.groupBy("month", "reject_reason").agg(F.sum("n").alias("count"), names.alias("tickers"))


def funnel(p: DataFrame) -> DataFrame:
    """By run month: how many proposals reach each stage, and the stage after the last one that any reached."""
    rows = judged(p).select(F.trunc("run_date", "month").alias("month"), "reject_reason", "total")
    gone: list[str] = []
    counts = []
    for stage, reasons in FUNNEL.items():
        gone += reasons
        counts.append(F.count_if(F.coalesce(~F.col("reject_reason").isin(gone), F.lit(True)) if gone else F.lit(True)).alias(stage))
    counts.append(F.count_if(F.col("reject_reason").isNull() & (F.col("total") >= 55)).alias("trades"))
    out = rows.groupBy("month").agg(*counts)
    names = [*FUNNEL, "trades"]
    killer = F.coalesce(*[F.when(F.col(n) == 0, F.lit(n)) for n in names])
    return out.withColumn("killer", killer)


def scored(p: DataFrame) -> DataFrame:
    names = ("signal_pts", "options_pts", "risk_pts", "context_pts")
    return judged(p).select("proposal_id", "ticker", *rounded(names, 3), "total", "grade", "route", "mailed", "fund", "reject_reason")


def ranked(p: DataFrame, top: int = 5) -> DataFrame:
    """The best proposals of each run day."""
    w = Window.partitionBy("run_date").orderBy(F.desc("total"), "ticker", "proposal_id")
    rows = judged(p).select("run_date", "ticker", "proposal_id", "total", "grade")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def sized(p: DataFrame) -> DataFrame:
    return judged(p).where("reject_reason is null").select("proposal_id", *rounded(("kelly", "position_pct"), 5), "position_usd", "unit_cost", "contracts", F.round("max_risk", 4).alias("max_risk"), "note")


def exit_sheet(p: DataFrame) -> DataFrame:
    names = ("take_profit", "full_profit", "stop_loss", "ticket_break_even", "max_roi", "pnl_stop", "pnl_take", "pnl_full")
    return judged(p).select("proposal_id", "width", *rounded(names, 4), "exit_days", "exit_date")


def strategies(p: DataFrame) -> DataFrame:
    return judged(p).groupBy("gamma", "vix_structure", "direction", "chosen").agg(F.count("*").alias("n"), F.sum("iv_rank").alias("iv_rank_sum"))


def gap_spread(p: DataFrame) -> DataFrame:
    """By tier: how far the proposals that only the ROI gate rejects fall short: least, upper median, largest. The median comes
    from counts of distinct gaps, so that no group is gathered."""
    rows = judged(p).where("reject_reason = 'roi_gate'").select("tier", F.round("roi_gap", 4).alias("gap"))
    by = rows.groupBy("tier", "gap").agg(F.count("*").alias("n"))
    up, all_ = Window.partitionBy("tier").orderBy("gap"), Window.partitionBy("tier")
    by = by.withColumn("upto", F.sum("n").over(up)).withColumn("size", F.sum("n").over(all_))
    return by.groupBy("tier").agg(F.max("size").alias("n"), F.min("gap").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("size") / 2), F.col("gap"))).alias("upper_median"), F.max("gap").alias("most"))


def best_rejects(p: DataFrame) -> DataFrame:
    """Of each ticker and month the rejected proposal with the best net ROI."""
    rows = judged(p).where("reject_reason = 'roi_gate'").withColumn("month", F.trunc("run_date", "month"))
    best = rows.groupBy("ticker", "month").agg(F.max_by(F.struct("proposal_id", "tier", "roi_net", "min_roi"), F.struct(F.round("roi_net", 6), F.negate("proposal_id"))).alias("x"))
    return best.select("ticker", "month", "x.proposal_id", "x.tier", F.round("x.roi_net", 5).alias("roi_net"), F.round(F.col("x.roi_net") - F.col("x.min_roi"), 5).alias("roi_gap"))


def bin_score(p: DataFrame, closed: DataFrame, least: int = 3) -> DataFrame:
    """final_score: each bin's mean return over closed(feature, bin, count, avg_return), or its prior where fewer than `least`
    trades are known, times its weight; where all that is 0, a score from the raw features. Of each day the two best get the
    dealers' adjustment. `closed` holds nine rows: three features of three bins."""
    rows = judged(p)
    for f in WEIGHTS:
        own = closed.where((F.col("feature") == f) & (F.col("count") >= least)).select(F.col("bin").alias(f"bin_{f}"), F.col("avg_return").alias(f"known_{f}"))
        rows = rows.join(F.broadcast(own), f"bin_{f}", "left")  # three rows
    value = {f: f"coalesce(known_{f}, {choose(f'bin_{f}', PRIORS[f], 0)}) * {w}" for f, w in WEIGHTS.items()}
    rows = add(rows, {"learned": " + ".join(value.values()), "plain": "impact_capped / cast(10 as double) * 0.35 + least(coalesce(mismatch, 0) / 10, 1) * 0.45 + least(abs(coalesce(eps_drift, 0)), 0.2) / 0.2 * 0.20"})
    rows = rows.withColumn("base", F.round(F.expr("case when learned = 0 then plain else learned end"), 4))
    k = F.row_number().over(Window.partitionBy("run_date").orderBy(F.desc("base"), "ticker", "proposal_id"))
    rows = rows.withColumn("k", k).where("k <= 5")
    return rows.select("run_date", "proposal_id", F.col("k").alias("rank"), "base", F.round(F.expr("case when k <= 2 then base + 0.10 * dealer else base end"), 4).alias("final_score"), "crush_risk", "flow_bias")
