"""Option-chain operators. A chain has one row a contract: ticker, expiry, type, strike, bid, ask, oi, iv, delta, row.

Runs are months: a contract belongs to the runs from whose first day its expiry is within the wanted range of days. So one plan
serves all tickers and runs; each is a group of its own, and minima over structs shrink before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import salted_join
from tidemark.functions.sheets import steps


def spot(chain: DataFrame) -> DataFrame:
    """A ticker's price: the mean strike, from whole cents."""
    return chain.groupBy("ticker").agg((F.sum(F.round(F.col("strike") * 100).cast("long")) / F.count("*") / 100).alias("s"))


def priced(chain: DataFrame) -> DataFrame:
    return salted_join(chain, spot(chain), ["ticker"], "row")


def runs(chain: DataFrame, least: int, most: int) -> DataFrame:
    """run_month, dte for each run from which the contract expires in `least` to `most` days."""
    first = F.trunc(F.date_sub("expiry", most), "month")
    out = chain.withColumn("run_month", F.explode(F.sequence(first, F.trunc(F.date_sub("expiry", least), "month"), F.expr("interval 1 month"))))
    return out.withColumn("dte", F.datediff("expiry", "run_month")).where(F.col("dte").between(least, most))


def first_expiry(chain: DataFrame, least: int = 20, most: int = 50) -> DataFrame:
    """Per ticker and run the first expiry in the range, and its contracts."""
    return runs(chain, least, most).groupBy("ticker", "run_month", "expiry", "dte").agg(F.count("*").alias("contracts")).groupBy("ticker", "run_month").agg(F.min(F.struct("dte", "expiry", "contracts")).alias("x")).select("ticker", "run_month", "x.expiry", "x.dte", "x.contracts")


def at_first_expiry(chain: DataFrame, least: int, most: int) -> DataFrame:
    """The contracts of the first expiry in the range."""
    nearest = F.min("dte").over(Window.partitionBy("ticker", "run_month"))
    return runs(chain, least, most).withColumn("nearest", nearest).where("dte = nearest").drop("nearest")


def atm_nearest(chain: DataFrame) -> DataFrame:
    """Per ticker, expiry and type the contract nearest to the price (ties: lower strike, then row)."""
    rows = priced(chain).withColumn("gap", F.round(F.abs(F.col("strike") - F.col("s")), 6))
    best = rows.groupBy("ticker", "s", "expiry", "type").agg(F.min(F.struct("gap", "strike", "row", "ask", "iv")).alias("x"))
    return best.select("ticker", "s", "expiry", "type", "x.strike", "x.row", "x.ask", "x.iv")


def straddle(chain: DataFrame) -> DataFrame:
    """Implied move of an expiry: asks of its nearest call and put over the price; both have to be there and have an ask."""
    leg = lambda t: F.max(F.when(F.col("type") == t, F.col("ask")))
    legs = atm_nearest(chain).groupBy("ticker", "s", "expiry").agg(leg("call").alias("call_ask"), leg("put").alias("put_ask"))
    legs = legs.where("call_ask > 0 and put_ask > 0 and s > 0")
    return legs.select("ticker", "expiry", F.round((F.col("call_ask") + F.col("put_ask")) / F.col("s"), 6).alias("implied_move"))


def strike_window(least: int, most: int, room: float = 15.0):
    """Lowest and highest strike over the price: by the middle of the range, but `room` dollars on either side at least."""
    mid = (least + most) / 2
    high, low = (1.03, 0.97) if mid <= 60 else (1.08, 0.96) if mid <= 149 else (1.12, 0.95)
    narrow = F.col("s") * (high - 1) < room
    own = lambda sign, base: F.when(narrow, F.round(1 + sign * room / F.col("s"), 4)).otherwise(base)
    return own(-1, low), own(1, high)


def selectable(chain: DataFrame, least: int, most: int, min_oi: int = 100, max_spread: float = 0.10, delta: tuple[float, float] = (0.55, 0.75)) -> DataFrame:
    """Calls of the first expiry in the range that pass strikes, open interest and bid-ask ratio; of these, where any has a delta
    in the range, only those."""
    low, high = strike_window(least, most)
    rows = at_first_expiry(priced(chain).where("type = 'call'"), least, most)
    rows = rows.where((F.col("strike") >= F.col("s") * low) & (F.col("strike") <= F.col("s") * high) & (F.col("oi") >= max(min_oi, 50)))
    ratio = (F.col("ask") - F.col("bid")) / F.greatest(F.col("ask"), F.lit(0.01))
    rows = rows.withColumn("spread_ratio", F.round(ratio, 6)).where(ratio <= max_spread)
    rows = rows.withColumn("meant", F.coalesce(F.abs("delta").between(*delta), F.lit(False)))
    any_ = F.max("meant").over(Window.partitionBy("ticker", "run_month"))
    return rows.withColumn("any", any_).where("meant or not any").drop("any")


def contract_pick(chain: DataFrame, least: int = 14, most: int = 60) -> DataFrame:
    """Per ticker and run the selectable contract with the highest open interest (ties: lower strike, then row)."""
    best = selectable(chain, least, most).groupBy("ticker", "run_month").agg(F.min(F.struct(F.negate("oi").alias("less"), "strike", "row", "expiry", "dte", "bid", "ask", "oi", "delta", "spread_ratio")).alias("x"))
    return best.select("ticker", "run_month", "x.expiry", "x.dte", "x.strike", "x.bid", "x.ask", "x.oi", "x.delta", "x.spread_ratio", "x.row")


def spread_leg(chain: DataFrame, least: int = 61, most: int = 149) -> DataFrame:
    """For each picked contract the call of its expiry to sell: strike in [1.05 K, 1.20 K] nearest to 1.10 K; none if that has no bid."""
    long = contract_pick(chain, least, most).select("ticker", "run_month", "expiry", F.col("strike").alias("k1"), F.col("ask").alias("ask1"))
    legs = chain.where("type = 'call'").select("ticker", "expiry", "strike", "bid", "row").join(long, ["ticker", "expiry"]).where("strike >= k1 * 1.05 and strike <= k1 * 1.20")
    best = legs.withColumn("gap", F.round(F.abs(F.col("strike") - F.col("k1") * 1.10), 6)).groupBy("ticker", "run_month", "expiry", "k1", "ask1").agg(F.min(F.struct("gap", "strike", "row", "bid")).alias("x")).where("x.bid > 0")
    return best.select("ticker", "run_month", "expiry", "k1", F.col("x.strike").alias("k2"), F.round(F.col("ask1") - F.col("x.bid"), 4).alias("net_debit"), F.round(F.col("x.strike") - F.col("k1"), 4).alias("width"))


GAMMA = steps("ratio", [("> 1.5", "positive"), ("< 0.70", "negative")], "neutral")


def dealer_gamma(chain: DataFrame, least: int = 14, most: int = 45) -> DataFrame:
    """Open interest of calls and puts within 5 % of the price at the first expiry in the range, and what their ratio says of the
    dealers' gamma. No puts: ratio 2; under 100 in all: unavailable."""
    near = F.abs(F.col("strike") - F.col("s")) <= 0.05 * F.col("s")
    oi = lambda t: F.coalesce(F.sum(F.when(near & (F.col("type") == t), F.col("oi"))), F.lit(0))
    # sums of an expiry come before the runs that it belongs to; dealt by expiry, they are small before they are shuffled
    sums = salted_join(chain, spot(chain), ["ticker"], "expiry").groupBy("ticker", "expiry").agg(oi("call").alias("calls"), oi("put").alias("puts"), F.count_if(near).alias("near"))
    a = at_first_expiry(sums, least, most).where("near > 0")
    a = a.withColumn("ratio", F.when(F.col("puts") == 0, 2.0).otherwise(F.try_divide("calls", "puts")))
    return a.select("ticker", "run_month", "expiry", "calls", "puts", F.round("ratio", 6).alias("ratio"), F.when(F.col("calls") + F.col("puts") < 100, "unavailable").otherwise(F.expr(GAMMA)).alias("gamma"))


def term_structure(chain: DataFrame) -> DataFrame:
    """Per ticker and run, of the first three expiries from the run's day on those at least 7 days away: the median implied volatility
    of the calls within 7 % of the price. The window's rank runs over expiries, not contracts."""
    calls = runs(priced(chain).where("type = 'call'"), 0, 120)
    expiries = runs(chain.select("ticker", "expiry").distinct(), 0, 120)
    first = expiries.withColumn("k", F.row_number().over(Window.partitionBy("ticker", "run_month").orderBy("dte"))).where("k <= 3 and dte >= 7")
    near = calls.where("strike between s * 0.93 and s * 1.07 and iv > 0.05").join(first.select("ticker", "run_month", "dte"), ["ticker", "run_month", "dte"])
    counts = near.groupBy("ticker", "run_month", "dte", "iv").agg(F.count("*").alias("times"))  # an exact median of counts: no group is gathered row by row
    return counts.groupBy("ticker", "run_month", "dte").agg(F.round(F.percentile("iv", 0.5, F.col("times")), 6).alias("iv"), F.sum("times").alias("n"))


def term_score(chain: DataFrame) -> DataFrame:
    """0 to 80: how much dearer the first point of the term structure is than the last; 20 with fewer than two points."""
    t = term_structure(chain).groupBy("ticker", "run_month").agg(F.min_by("iv", "dte").alias("short"), F.max_by("iv", "dte").alias("long"), F.count("*").alias("points"))
    slope = F.least(F.greatest((F.col("short") / F.col("long") - 1 + 0.05) * 100, F.lit(0.0)), F.lit(80.0))
    return t.select("ticker", "run_month", "points", F.round(F.when((F.col("points") >= 2) & (F.col("long") > 0), slope).otherwise(20.0), 4).alias("term_score"))


def skew(chain: DataFrame, least: int = 20, most: int = 50) -> DataFrame:
    """At the first expiry in the range: implied volatility of the nearest put over that of the nearest call."""
    rows = at_first_expiry(priced(chain).where("iv > 0.01"), least, most).withColumn("gap", F.round(F.abs(F.col("strike") - F.col("s")), 6))
    best = rows.groupBy("ticker", "run_month", "type").agg(F.min(F.struct("gap", "strike", "row", "iv")).alias("x"))
    leg = lambda t: F.max(F.when(F.col("type") == t, F.col("x.iv")))
    both = best.groupBy("ticker", "run_month").agg(leg("put").alias("put_iv"), leg("call").alias("call_iv")).where("put_iv is not null and call_iv > 0")
    both = both.withColumn("ratio", F.col("put_iv") / F.col("call_iv"))
    return both.select("ticker", "run_month", "put_iv", "call_iv", F.round("ratio", 6).alias("skew_ratio"), F.expr(steps("ratio", [(">= 1.20", "bearish_skew"), ("<= 0.85", "bullish_skew")], "neutral")).alias("signal"))


def liquidity(chain: DataFrame, least: int = 2) -> DataFrame:
    """Tickers and runs with the number of expiries within a year; liquid with `least` of them."""
    a = runs(chain.select("ticker", "expiry").distinct(), 0, 365).groupBy("ticker", "run_month").agg(F.count("*").alias("expiries"))
    return a.withColumn("liquid", F.col("expiries") >= least)


def quotes(chain: DataFrame, trades: DataFrame, near: float = 0.01) -> DataFrame:
    """For trades(trade_id, ticker, expiry, strike, type) the quote of the contract within `near` of the strike; that of the wanted
    type first, then the other's. Joined on the strike in steps of `near` and its neighbours, not by a range.
    mid: of bid and ask if both are there, else the ask, else 0."""
    step = lambda k: F.floor(F.round(F.col(k) / near, 6)).cast("long")
    want = trades.withColumn("cell", F.explode(F.array(*[step("strike") + i for i in (-1, 0, 1)]))).withColumnRenamed("strike", "wanted").withColumnRenamed("type", "wanted_type")
    have = chain.withColumn("cell", step("strike")).select("ticker", "expiry", "cell", "strike", "type", "bid", "ask", "row")
    both = want.join(have, ["ticker", "expiry", "cell"]).where(F.round(F.abs(F.col("strike") - F.col("wanted")), 6) <= near)
    other = (F.col("type") != F.col("wanted_type")).cast("int").alias("other")
    best = both.groupBy("trade_id").agg(F.min(F.struct(other, F.round(F.abs(F.col("strike") - F.col("wanted")), 6).alias("gap"), "row", "type", "bid", "ask")).alias("x"))
    mid = F.when((F.col("x.bid") > 0) & (F.col("x.ask") > 0), (F.col("x.bid") + F.col("x.ask")) / 2).when(F.col("x.ask") > 0, F.col("x.ask")).otherwise(0.0)
    return trades.select("trade_id").join(best, "trade_id", "left").select("trade_id", "x.row", F.col("x.type").alias("quoted_type"), F.round(mid, 7).alias("mid"))
