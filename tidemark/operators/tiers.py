"""Search for a contract over tiers of expiry: candidates meet bars and option chains, all alternatives are evaluated at once, and the
first that passes every gate is taken.

What a contract depends on is shared: expiry and contract are found once for each ticker, run day, tier and type, however many
candidates ask. Prices, gammas and first expiries come from sorted windows over the distinct days of all sides, no range join; of one
strike only the best contract is kept, so that a ticker with very many contracts meets its run days with at most one row a strike. A
candidate then has three rows in its own task, which shrink to one there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sheets import Sheet, add, in_small_methods
from tidemark.operators.proposals import ROI, STRATEGY, TIERS, rounded

#: tier_no, tier, least and most days to expiry.
RANGES = {i: (name, least, most) for i, (name, (least, most, _)) in enumerate(TIERS.items(), 1)}


def last_close(needs: DataFrame, bars: DataFrame) -> DataFrame:
    """needs(ticker, run_date) with `price`: the last close on or before that day, unknown without one."""
    asked = needs.select("ticker", "run_date").distinct()
    days = bars.select("ticker", F.col("d").alias("day"), "close", F.lit(0).alias("asks")).unionByName(asked.select("ticker", F.col("run_date").alias("day"), F.lit(None).cast("double").alias("close"), F.lit(1).alias("asks")))
    upto = Window.partitionBy("ticker").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("price", F.last("close", True).over(upto)).where("asks = 1").select("ticker", F.col("day").alias("run_date"), "price")


def first_expiries(needs: DataFrame, chain: DataFrame, ranges: dict[int, tuple[str, int, int]], bars: DataFrame | None = None, gammas: DataFrame | None = None) -> DataFrame:
    """needs(ticker, run_date, ...) for each tier whose range of days holds an expiry: tier_no, the first one, dte. Days run backwards,
    so that the frame only grows. With needs(..., floor) tiers that start under it aren't looked for. With bars also `price`, the last close
    on or before the run day; with gammas `gamma`, that of the run's month, neutral where unknown. All meet in one exchange by ticker."""
    both = needs.withColumn("day", F.col("run_date")).unionByName(chain.select("ticker", F.col("expiry").alias("day"), "expiry").distinct(), allowMissingColumns=True)
    upto = Window.partitionBy("ticker").orderBy("day", F.col("run_date").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    if bars is not None:
        both = both.unionByName(bars.select("ticker", F.col("d").alias("day"), "close"), allowMissingColumns=True)
    if gammas is not None:
        both = both.unionByName(gammas.select("ticker", F.col("run_month").alias("day"), F.struct("run_month", "gamma").alias("known")), allowMissingColumns=True)
        own = F.when(F.col("known.run_month") == F.trunc("run_date", "month"), F.col("known.gamma"))
        both = both.withColumn("known", F.last("known", True).over(upto)).withColumn("gamma", F.coalesce(own, F.lit("neutral"))).drop("known")
    if bars is not None:
        both = both.withColumn("price", F.last("close", True).over(upto)).drop("close")
    tiers = F.array(*[F.struct(F.lit(i).alias("tier_no"), F.lit(a).alias("least"), F.lit(b).alias("most")) for i, (_, a, b) in ranges.items()])
    if "floor" in needs.columns:
        tiers = F.filter(tiers, lambda t: F.col("expiry").isNotNull() | (t["least"] >= F.col("floor")))
    tiers = F.when(F.col("expiry").isNull(), tiers).otherwise(F.slice(tiers, 1, 1))  # an expiry is one row, whose tier means nothing
    rows = both.where("run_date is not null or expiry is not null").withColumn("t", F.explode(tiers)).select(*[c for c in both.columns if c != "floor"], "t.*")
    rows = rows.withColumn("day", F.coalesce("expiry", F.date_add("run_date", F.col("least"))))
    later = Window.partitionBy("ticker").orderBy(F.desc("day"), F.col("run_date").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("expiry", F.last("expiry", True).over(later)).where("run_date is not null").withColumn("dte", F.datediff("expiry", "run_date"))
    return found.where(F.col("dte") <= F.col("most")).drop("least", "most", "day")


def _window(ranges: dict[int, tuple[str, int, int]], room: float = 15.0) -> tuple[Column, Column]:
    """Lowest and highest strike over the price, by the middle of the tier's range; `room` dollars on either side at least."""
    low = high = None
    for i, (_, least, most) in ranges.items():
        mid = (least + most) / 2
        up, down = (1.03, 0.97) if mid <= 60 else (1.08, 0.96) if mid <= 149 else (1.12, 0.95)
        narrow = F.col("price") * (up - 1) < room
        own = [F.when(narrow, F.round(1 + sign * room / F.col("price"), 4)).otherwise(base) for sign, base in ((-1, down), (1, up))]
        low, high = (F.when(F.col("tier_no") == i, c) if x is None else x.when(F.col("tier_no") == i, c) for x, c in zip((low, high), own, strict=True))
    return low, high


def contracts(needs: DataFrame, chain: DataFrame, ranges: dict[int, tuple[str, int, int]] = RANGES, min_oi: int = 100, max_spread: float = 0.10, delta: tuple[float, float] = (0.55, 0.75), bars: DataFrame | None = None, gammas: DataFrame | None = None) -> DataFrame:
    """For needs(ticker, run_date, price) and each tier and type (that of needs(..., type), if there): the contract with the highest open
    interest at the first expiry that passes strikes, open interest and bid-ask ratio (of those with a delta in the range, where there are
    any; ties: lower strike, then row), and the short leg of a spread: strike in [1.05 K, 1.20 K] nearest to 1.10 K. floor, bars and gammas
    as in first_expiries.

    The chain is shuffled once, by (ticker, expiry, type), and all that follows stays there: one row a strike, both as a contract and as a leg."""
    key = ["ticker", "expiry", "type"]
    ratio = (F.col("ask") - F.col("bid")) / F.greatest(F.col("ask"), F.lit(0.01))
    fit = (F.col("oi") >= max(min_oi, 50)) & (ratio <= max_spread)
    other = F.when(F.coalesce(F.abs("delta").between(*delta), F.lit(False)), 0).otherwise(1)
    order = F.struct(other.alias("other"), F.negate("oi").alias("less"), "strike", "row", "bid", "ask", "oi", "iv", "delta")
    lines = chain.select(*key, "strike", "row", "bid", "ask", "oi", "iv", "delta").repartition(*key)
    strikes = lines.groupBy(*key, F.col("strike").alias("k2")).agg(F.min(F.when(fit, order)).alias("c"), F.min(F.struct("row", "bid")).alias("leg"))
    asked = first_expiries(needs, chain, ranges, bars, gammas).where("price > 0")
    if "type" not in needs.columns:
        asked = asked.withColumn("type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    low, high = (F.col("price") * c for c in _window(ranges))
    met = strikes.join(asked, key).where((F.col("k2") >= low) & (F.col("k2") <= high * 1.20))  # contracts, and all that may be their legs
    ask = [*key, *[c for c in asked.columns if c not in key]]
    met = met.withColumn("c", F.min(F.when(F.col("k2") <= high, F.col("c"))).over(Window.partitionBy(*ask))).where("c is not null")
    gap = F.round(F.abs(F.col("k2") - F.col("c.strike") * 1.10), 6)
    near = (F.col("k2") >= F.col("c.strike") * 1.05) & (F.col("k2") <= F.col("c.strike") * 1.20)
    out = met.groupBy(*ask).agg(F.first("c").alias("c"), F.min(F.when(near, F.struct(gap.alias("gap"), "k2", "leg.row", "leg.bid"))).alias("leg"))
    return out.select(*ask, "c.strike", "c.bid", "c.ask", "c.oi", "c.iv", "c.delta", "c.row", F.when(F.col("leg.bid") > 0, F.col("leg.k2")).alias("k2"), F.when(F.col("leg.bid") > 0, F.col("leg.bid")).alias("bid2"))


#: What a tier does with a candidate, in the order of its gates; pnl_*: expected profit of the contract where it is known, net of costs.
STATUS: list[Sheet] = [
    {"costs": "2 * spread_pct + commission_pct"},
    {
        "status": "case when tier_least < dte_floor then 'below_floor' when strike is null then 'no_contract' when tier_no = 1 and theta_pct > 0.03 then 'theta' when tier_no = 1 and vega_loss > 0.35 then 'vega' "
        "when not passes_roi then 'roi' when not has_edge then 'edge' when pnl_mean - costs < min_roi or pnl_median - costs < 0 then 'pnl' else 'pass' end",
    },
]


def tier_search(candidates: DataFrame, chain: DataFrame, pnl: DataFrame | None = None, leg_required: bool = False, ranges: dict[int, tuple[str, int, int]] = RANGES, bars: DataFrame | None = None, gammas: DataFrame | None = None) -> DataFrame:
    """candidates(candidate_id, ticker, run_date, price, target, direction, dte_floor, catalyst_type, hit_rate, iv_rank, gamma, vix,
    vix_structure), one row each: the first tier that passes, its contract and figures; what every tier up to it said; without one,
    the tier with the best net ROI, and how far that falls short. With bars and gammas candidates bring a target_move instead of price,
    target and gamma: the price is that of the run day, the dealers' gamma that of its month.

    A spread without a short leg that has a bid is kept at the price of its long leg; with `leg_required` it isn't a spread, and the
    single contract of the same tier takes its place. pnl(candidate_id, tier_no, pnl_mean, pnl_median): where given, the mean has to
    reach the tier's ROI and the median 0, net of costs; candidates without a row there pass.

    A candidate is shuffled once, to the contracts of its day, and its tiers end where they began."""
    rows = candidates.withColumn("type", F.when(F.col("direction") == "BULLISH", "call").otherwise("put"))
    key = ["ticker", "run_date", "type"] if bars is not None else ["ticker", "run_date", "price", "type"]
    # a tier under the floor of all candidates of its day says so whatever its contract is, which needn't be found
    needs = rows.groupBy(*key).agg(F.min(F.coalesce("dte_floor", F.lit(-1))).alias("floor"))
    found = contracts(needs, chain, ranges, bars=bars, gammas=gammas)
    own = F.struct(*[c for c in found.columns if c not in (*key, "price", "gamma")])
    # at most one row a tier; a candidate without a contract needs no price either
    by_day = found.repartition(*key).groupBy(*key).agg(F.collect_list(own).alias("found"), *[F.first(c).alias(c) for c in ("price", "gamma") if c in found.columns and c not in key])
    tiers = F.array(*[F.struct(F.lit(i).alias("tier_no"), F.lit(name).alias("tier_name"), F.lit(a).alias("tier_least")) for i, (name, a, _) in ranges.items()])
    rows = rows.join(by_day, key, "left")
    if bars is not None:
        rows = rows.withColumn("target", F.col("price") * (1 + F.col("target_move")))
    rows = add(rows, *STRATEGY).withColumn("t", F.explode(tiers))
    contract = F.filter("found", lambda c: c["tier_no"] == F.col("t.tier_no"))
    rows = rows.withColumn("c", F.get(contract, F.lit(0))).select(*[c for c in rows.columns if c not in ("found", "t")], "t.*", *[F.col(f"c.{n}").alias(n) for n in ("expiry", "dte", "strike", "bid", "ask", "iv", "delta", "k2", "bid2")])
    spread = F.col("chosen").contains("SPREAD")
    fallback = spread & F.lit(leg_required) & F.col("bid2").isNull() & F.col("strike").isNotNull()
    rows = rows.withColumn("strategy", F.when(fallback, F.when(F.col("type") == "call", "LONG_CALL").otherwise("LONG_PUT")).otherwise(F.col("chosen")))
    rows = rows.withColumn("net_debit", F.when(F.col("strategy").contains("SPREAD"), F.round(F.col("ask") - F.col("bid2") + 1e-9, 2)))
    rows = rows.withColumn("hit_rate", F.coalesce(F.nullif("hit_rate", F.lit(0.0)), F.lit(0.65)))
    if pnl is None:
        rows = rows.withColumn("pnl_mean", F.lit(None).cast("double")).withColumn("pnl_median", F.lit(None).cast("double"))
    else:
        rows = rows.join(pnl.select("candidate_id", "tier_no", "pnl_mean", "pnl_median"), ["candidate_id", "tier_no"], "left")
    rows = add(in_small_methods(rows).withColumn("straddle_move", F.lit(None).cast("double")), *ROI, *STATUS)
    figures = F.struct("tier_no", F.col("tier_name").alias("tier"), "strategy", "expiry", "dte", "strike", "ask", "k2", "net_debit", "roi_net", "min_roi", "annual_roi", "edge")
    said = F.array_sort(F.collect_list(F.struct("tier_no", "status")))
    best = F.max(F.when(F.col("strike").isNotNull() & (F.col("status") != "below_floor"), F.struct(F.round("roi_net", 6).alias("r"), F.negate("tier_no").alias("first"), "tier_name", "roi_gap")))
    out = rows.groupBy(*key, "candidate_id").agg(F.min(F.when(F.col("status") == "pass", figures)).alias("x"), best.alias("best"), said.alias("said"))
    upto = F.filter("said", lambda s: F.col("x").isNull() | (s["tier_no"] <= F.col("x.tier_no")))
    tried = F.concat_ws(",", F.transform(upto, lambda s: s["status"]))
    none = F.col("x").isNull()
    out = out.select("candidate_id", F.coalesce("x.tier", F.lit("no tier")).alias("tier"), tried.alias("tried"), *[f"x.{c}" for c in ("strategy", "expiry", "dte", "strike", "ask", "k2", "net_debit", "roi_net", "min_roi", "annual_roi", "edge")], F.when(none, F.col("best.tier_name")).alias("best_tier"), F.when(none, F.col("best.roi_gap")).alias("best_gap"))
    names = ("roi_net", "min_roi", "annual_roi", "edge", "best_gap")
    return out.select(*[c for c in out.columns if c not in names], *rounded(names, 5))


def precheck(candidates: DataFrame, chain: DataFrame, least: int = 21, most: int = 45, rise: float = 1.08, floor: float = -0.30, bars: DataFrame | None = None) -> DataFrame:
    """Before any costly stage: the net ROI that a call of `least` to `most` days would have at a target of `rise` times the price, as
    a single leg, whatever the direction, class and hit rate will turn out to be. Candidates under the floor go; without a contract they
    stay. With bars the price is that of the run day."""
    key = ["ticker", "run_date"] if bars is not None else ["ticker", "run_date", "price"]
    needs = candidates.select(*key, F.lit("call").alias("type")).distinct()
    found = contracts(needs, chain.where("type = 'call'"), {1: ("Short-Term", least, most)}, bars=bars)
    names = [c for c in ("price", "dte", "strike", "bid", "ask", "iv", "delta") if c not in key]
    rows = candidates.select("candidate_id", *key, "iv_rank", "vix", "vix_structure").join(found.select(*key, *names), key, "left")
    rows = add(rows, {"target": f"price * {rise}", "strategy": "'LONG_CALL'", "catalyst_type": "'OTHER'", "hit_rate": "cast(0.65 as double)", "net_debit": "cast(null as double)", "straddle_move": "cast(null as double)"})
    rows = add(rows, *ROI)
    known = F.col("strike").isNotNull()
    return rows.select("candidate_id", "strike", "dte", *rounded(("roi_net",), 5), (~known | (F.col("roi_net") >= floor)).alias("stays"))
