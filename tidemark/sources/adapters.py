"""Market-shaped views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sheets import Sheet, add

#: Tells lines apart: their order and number repeat.
LINE_ID = "(l_orderkey * 10 + l_linenumber) * 10000000000 + cast(round(l_extendedprice * 100) as bigint) * 97 + l_partkey % 97"
#: Contracts expire in the middle of a month.
EXPIRY = "cast(date_trunc('month', l_shipdate) as date) + 14"
# What an order's priority stands for.
STRATEGY = {"1": "LONG_CALL", "2": "BULL_CALL_SPREAD", "3": "LONG_PUT", "4": "BEAR_PUT_SPREAD", "5": "LONG_CALL"}
CATALYST = {"1": "EARNINGS", "2": "FDA", "3": "MA", "4": "INSIDER"}
# Why a shadow was rejected.
SHADOWS = {"0": "final_mc_survivor", "1": "roi_gate", "2": "score_48", "3": "correlation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of few, large splits dealt out over the session's cores, for formulas that cost more than a shuffle; many splits stay as they
    are, so nothing is shuffled where a table has a split for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def _lookup(values: dict[str, str], col):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), col)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    first = F.substring("o_orderpriority", 1, 1)
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 200_000
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_custkey").alias("ticker"),
        F.to_date("o_orderdate").alias("entry_date"),
        _lookup(STRATEGY, first).alias("strategy"),
        _lookup(CATALYST, first).alias("catalyst"),
        F.col("r_name").alias("sector"),
        (F.col("o_custkey") % 365).alias("dte"),
        (F.col("o_orderkey") % 100 / 10).alias("mismatch"),
        (F.col("o_orderkey") % 10 + 1).alias("impact"),
        (F.col("o_custkey") % 10 + 1).alias("surprise"),
        (F.col("o_orderkey") % 101).alias("score"),
        F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_custkey") % 25 - 12) / 100).alias("eps_drift"),
        F.when(F.col("o_orderstatus") == "P", _lookup(SHADOWS, (F.col("o_orderkey") % 4).cast("string"))).alias("reject_reason"),
        F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "shadow").otherwise("open").alias("source"),
        ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 40 / 100 + 0.35).alias("hit_rate"),
        # late entries (a mismatch of over 6) do worse, so that a lower limit pays
        F.when(F.col("o_orderstatus").isin("F", "P"), F.round(cents / 100_000 - 1 - F.when(F.col("o_orderkey") % 100 > 60, 0.5).otherwise(0.0), 5)).alias("outcome"),
    )


#: Ticks and signals from events: a dozen tickers.
TICKS: Sheet = {"ticker": "user_id % 12", "seq": "event_id", "price": "case when event_id % 40 = 0 then null else 100 + value / 100 end"}
SIGNALS: Sheet = {"id": "event_id", "ticker": "user_id % 12", "day": "cast(ts as date)", "direction": "case when event_id % 3 = 0 then 'BEARISH' else 'BULLISH' end", "mismatch": "case when event_id % 17 = 0 then null else cast(event_id % 9 as double) end"}


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ts, seq, price."""
    return add(table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts")), TICKS).select("ticker", "ts", "seq", "price")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ticker, day, direction, mismatch."""
    return add(table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")), SIGNALS).select(*SIGNALS)


#: Reports by day, some without a volatility.
DAY_REPORTS = "SELECT cast(o_orderdate as date) AS run_date, count(*) AS universe, case when count(*) % 3 = 0 then null else 15 + count(*) % 9 end AS vix FROM {orders} GROUP BY cast(o_orderdate as date)"


def day_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DAY_REPORTS, orders=table(spark, sf_dir, "orders"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, d, close, volume, one row for each nation and ship date. Sums are of whole cents, so they don't depend on order."""
    line, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = line.select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").join(s, line.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    sums = rows.groupBy(F.col("n_name").alias("ticker"), F.col("n_regionkey").alias("sector"), F.to_date("l_shipdate").alias("d")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("volume")
    )
    return sums.select("ticker", "sector", "d", (F.col("cents") / 100 / F.col("volume")).alias("close"), "volume")


def region_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bars, one row for each region and ship date."""
    line, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    rows = line.select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").join(s, line.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    sums = rows.groupBy(F.col("r_name").alias("ticker"), F.to_date("l_shipdate").alias("d")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("volume"))
    return sums.select("ticker", "d", (F.col("cents") / 100 / F.col("volume")).alias("close"), "volume")


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bars, one row for each supplier and ship date."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("d")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("volume"))
    return sums.select("ticker", "d", (F.col("cents") / 100 / F.col("volume")).alias("close"), "volume")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, expiry, type, strike, bid, ask, oi (25 contracts a unit), iv, delta (unknown for some), row."""
    line = table(spark, sf_dir, "lineitem")
    strike = F.expr("(cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)) / 100")
    return line.select(
        F.col("l_suppkey").alias("ticker"),
        F.expr(EXPIRY).alias("expiry"),
        F.when(F.col("l_returnflag") == "R", "put").otherwise("call").alias("type"),
        strike.alias("strike"),
        F.round(strike * (0.05 + F.col("l_discount")), 4).alias("ask"),
        F.round(strike * (0.05 + F.col("l_discount")) * (1 - F.col("l_tax")), 6).alias("bid"),
        (F.col("l_quantity").cast("long") * 25).alias("oi"),
        F.round(0.2 + F.col("l_tax"), 2).alias("iv"),
        F.when(F.col("l_partkey") % 4 != 0, (40 + F.col("l_partkey") % 45) / 100).alias("delta"),
        F.expr(LINE_ID).alias("row"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, ts, event_id, value: the marks of a trade in order of (ts, event_id)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trade_id"), "ts", "event_id", "value")


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """desk, run_date, stage, n."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("desk"), F.to_date("ts").alias("run_date"), F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, text, score, comments."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text", F.col("n_chars").alias("score"), (F.col("doc_id") % 50).alias("comments"))


#: A proposal from each line of an order. Prices, marks and texts follow from its keys; all of them are as wide as real ones.
PROPOSALS: list[Sheet] = [
    {
        "proposal_id": LINE_ID,
        "run_date": "cast(l_shipdate as date)",
        "ticker": "l_suppkey",
        "symbol": "case when l_orderkey % 97 = 0 then ' ' else cast(l_suppkey as string) end",
        "strike": "cast(floor(round(l_extendedprice * 100) / l_quantity) as double) / 100",
        "direction": "case when l_orderkey % 11 = 3 then 'BEARISH' else 'BULLISH' end",
        "dte": "case when l_orderkey % 9 = 0 then 20 + l_partkey % 100 else 118 + l_partkey % 240 end",
        "iv": "case when l_orderkey % 23 = 0 then 0 else 0.2 + l_tax end",
        "iv_rank": "cast((l_partkey * 7 + l_linenumber) % 101 as double)",
        "hit_rate": "case when l_orderkey % 89 = 0 then 1.5 else cast(38 + (l_orderkey * 3 + l_linenumber) % 40 as double) / 100 end",
        "delta": "case when l_partkey % 4 = 0 then null else cast(40 + l_partkey % 45 as double) / 100 end",
        "catalyst_text": "case l_orderkey % 6 when 0 then 'Q3 Earnings beat' when 1 then 'Merger talks' when 2 then 'Insider buying' when 3 then 'Product launch' when 4 then 'Decision due' else 'Raised guidance' end",
        "fda": "l_orderkey % 6 = 4",
        "insider_cluster": "l_orderkey % 13 = 5",
        "eps_drift": "case when l_partkey % 8 = 0 then null else cast(l_partkey % 25 - 12 as double) / 100 end",
        "verdict": "case when l_orderkey % 31 = 7 then 'VETO' when l_orderkey % 31 < 3 then null else 'PASS' end",
        "argument": "case when l_partkey % 37 = 5 then 'Narrative Mismatch: wrong segment' when l_partkey % 5 = 0 then null else 'Valuation is rich' end",
        "reason_text": "case l_partkey % 7 when 0 then 'Wachstum stieg' when 1 then 'Gewinn trotz Warnung' when 2 then 'Verlust erwartet' else 'Neue Produkte' end",
        "category": "case l_partkey % 12 when 0 then 'routine_news' when 1 then 'bearish_reversal' else 'catalyst' end",
        "decision": "case when l_orderkey % 17 = 2 then '[NO]' else '[YES]' end",
        "n_expiries": "1 + l_partkey % 19",
        "horizon": "case l_orderkey % 5 when 0 then '4-8 Wochen' when 1 then '2-3 Monate' when 2 then '6 Monate' when 3 then 'ca. 6 Monate' else null end",
        "concern": "case when l_partkey % 10 = 4 then 'high' else 'low' end",
        "impact": "2 + (l_orderkey + l_linenumber) % 9",
        "surprise": "2 + l_partkey % 9",
        "severity": "l_suppkey % 9 + l_linenumber % 2",
        "move_48h": "cast(l_partkey % 13 - 6 as double) / 1000",
        "sigma_30": "case when l_partkey % 41 = 0 then 0 else 0.01 + l_discount / 10 end",
        "gamma": "case l_suppkey % 4 when 0 then 'negative' when 1 then 'positive' else 'neutral' end",
        "vix_structure": "case l_linenumber % 4 when 0 then 'backwardation' when 1 then 'contango' when 2 then 'flat' else 'unknown' end",
        "vix": "case when l_orderkey % 43 = 0 then null else cast(14 + l_orderkey % 23 as double) end",
        "straddle_move": "0.05 + l_discount",
        "intraday_move": "cast(l_partkey % 21 - 10 as double) / 100",
        "sector": "case l_suppkey % 14 when 0 then 'Technology' when 1 then 'Healthcare' when 2 then 'Biotechnology' when 3 then 'Financial Services' when 4 then 'Financials' when 5 then 'Energy' when 6 then 'Consumer Cyclical' when 7 then 'Consumer Defensive' when 8 then 'Industrials' when 9 then 'Basic Materials' when 10 then 'Real Estate' when 11 then 'Utilities' when 12 then 'Communication Services' else 'Other' end",
        "sector_strength": "case when l_partkey % 6 = 0 then null else cast(l_partkey % 41 - 20 as double) / 100 end",
        "macro_regime": "case l_orderkey % 4 when 0 then 'expansive' when 1 then 'neutral' when 2 then 'unknown' else 'recessionary' end",
        "open_interest": "cast(l_quantity as bigint) * 25",
        "days_to_earnings": "l_partkey % 60 - 5",
        "gex": "case when l_suppkey % 5 = 0 then null else cast(l_partkey % 41 - 20 as double) * 50000000 end",
        "positioning": "case l_linenumber % 3 when 0 then 'bullish' when 1 then 'bearish' else 'neutral' end",
        "call_flow": "cast(l_partkey % 9 as double)",
        "put_flow": "cast(l_partkey % 7 as double)",
        "iv_percentile": "case when l_suppkey % 6 = 0 then null else cast(l_partkey % 101 as double) end",
    },
    {
        "price": "round(strike * (96 + l_partkey % 9) / 100, 4)",
        "short_strike": "round(strike * 110 / 100, 4)",
        "ask": "round(strike * (0.05 + l_discount), 4)",
        "strategy": "case when direction = 'BULLISH' then case when l_linenumber % 2 = 0 then 'BULL_CALL_SPREAD' else 'LONG_CALL' end when l_linenumber % 2 = 0 then 'BEAR_PUT_SPREAD' else 'LONG_PUT' end",
    },
    {
        "target": "round(price * (105 + l_orderkey % 30) / 100, 6)",
        "quick_days": "case when l_partkey % 3 = 0 then 60 else 30 end",
        "final_hit_rate": "case when l_orderkey % 101 = 0 then 0.005 when l_orderkey % 103 = 0 then null else hit_rate + cast(l_partkey % 5 - 2 as double) / 100 end",
        "bid": "round(ask * (1 - l_tax), 6)",
        "net_debit": "case when strategy like '%SPREAD%' then round(ask * 60 / 100, 6) end",
    },
]


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(spread(table(spark, sf_dir, "lineitem")), *PROPOSALS)


#: What a candidate brings to the search for a contract; its price comes from bars, its target from that price.
CANDIDATES = ("ticker", "run_date", "direction", "horizon", "hit_rate", "iv_rank", "vix", "vix_structure", "fda", "eps_drift", "catalyst_text", "insider_cluster")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, what CANDIDATES names, target_move. Not dealt out over the cores: they are shuffled to their contracts anyway."""
    return add(table(spark, sf_dir, "lineitem"), *PROPOSALS).select(F.col("proposal_id").alias("candidate_id"), *CANDIDATES, ((5 + F.col("l_orderkey") % 30) / 100).alias("target_move"))


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, ticker, expiry, strike, type: positions whose strikes are off the chain's by up to two cents, or of the other type."""
    return add(table(spark, sf_dir, "lineitem"), *POSITIONS).select("trade_id", "ticker", "expiry", "strike", "type")


POSITIONS: list[Sheet] = [
    {
        "trade_id": LINE_ID,
        "ticker": "l_suppkey",
        "expiry": EXPIRY,
        "strike": "round(cast(floor(round(l_extendedprice * 100) / l_quantity) + l_partkey % 5 - 2 as double) / 100, 2)",
        "type": "case when (l_returnflag = 'R') = (l_partkey % 3 > 0) then 'put' else 'call' end",
    }
]
#: A book of positions, one from each line of an order; the short strike is that of the next contract of the same expiry and type.
BOOK_ROWS = f"""SELECT *, lead(listed) OVER (PARTITION BY ticker, expiry, type ORDER BY listed, trade_id) AS next_strike FROM
  (SELECT {LINE_ID} AS trade_id, l_suppkey AS ticker, {EXPIRY} AS expiry, case when l_returnflag = 'R' then 'put' else 'call' end AS type,
   cast(floor(round(l_extendedprice * 100) / l_quantity) as double) / 100 AS listed, l_linenumber, l_partkey, l_orderkey, l_discount FROM {{lines}}) x"""
BOOK: list[Sheet] = [
    {
        "strategy": "case when l_partkey % 50 = 0 then null when type = 'call' then case when l_linenumber % 2 = 0 then 'BULL_CALL_SPREAD' else 'LONG_CALL' end when l_linenumber % 2 = 0 then 'BEAR_PUT_SPREAD' else 'LONG_PUT' end",
        "strike": "round(listed + cast(l_partkey % 5 - 2 as double) / 100, 2)",
        "value_day": "expiry + cast(l_partkey % 60 - 30 as int)",
        "entry_debit": "case when l_orderkey % 6 = 0 then 0 else round(listed * (0.04 + l_discount) + 0.000000001, 2) end",
        "net_debit": "case when l_orderkey % 12 = 0 then null else round(listed * 3 / 100 + 0.000000001, 2) end",
        "entry_ask": "case when l_orderkey % 24 = 0 then 0 else round(listed * (0.05 + l_discount) + 0.000000001, 4) end",
        "entry_short_bid": "case when l_orderkey % 36 = 0 then null else round(listed * 2 / 100 + 0.000000001, 4) end",
        "entry_last": "case when l_orderkey % 48 = 0 then null else round(listed * 4 / 100 + 0.000000001, 4) end",
        "entry_stock": "case when l_orderkey % 7 = 0 then 0 else round(listed * (96 + l_partkey % 9) / 100 + 0.000000001, 4) end",
    },
    {"short_strike": "case when strategy like '%SPREAD%' and l_partkey % 29 > 0 then round(next_strike + cast(l_partkey % 3 as double) / 100, 2) end"},
]
#: Stock quotes from bars: some without a last price, some without a bid either.
STOCK_QUOTES: Sheet = {"last": "case when volume % 5 = 0 then 0 else round(close + 0.000000001, 4) end", "bid": "case when volume % 35 = 0 then null else round(close * 999 / 1000 + 0.000000001, 4) end", "ask": "round(close * 1001 / 1000 + 0.000000001, 4)"}


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, ticker, expiry, strategy, strike, short_strike, value_day and the figures at entry."""
    rows = add(spark.sql(BOOK_ROWS, lines=table(spark, sf_dir, "lineitem")), *BOOK)
    return rows.select("trade_id", "ticker", "expiry", *BOOK[0], *BOOK[1])


def stock_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, d, last, bid, ask."""
    return add(supplier_bars(spark, sf_dir), STOCK_QUOTES).select("ticker", "d", *STOCK_QUOTES)


#: Outcomes by feature and bin, from lines of orders.
LINE_BINS = """SELECT 'impact' AS feature, CASE WHEN l_linenumber <= 4 THEN 'low' WHEN l_linenumber <= 6 THEN 'mid' ELSE 'high' END AS bin, (l_partkey % 21 - 10) / 100 AS outcome FROM {lines}
  UNION ALL SELECT 'mismatch', CASE WHEN l_quantity < 15 THEN 'weak' WHEN l_quantity <= 30 THEN 'good' ELSE 'strong' END, (l_partkey % 21 - 10) / 100 FROM {lines}"""


def line_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, bin, outcome."""
    return spark.sql(LINE_BINS, lines=table(spark, sf_dir, "lineitem"))


#: A position's terms, from the id of the trade that its marks belong to.
TERMS: Sheet = {
    "strategy": "case when trade_id % 2 = 0 then 'BULL_CALL_SPREAD' else 'LONG_CALL' end",
    "strike": "cast(100 as double)",
    "short_strike": "case when trade_id % 2 = 0 then cast(100 + trade_id % 8 as double) end",
    "entry_debit": "cast(1 + trade_id % 3 as double)",
    "term_days": "20 + trade_id % 40",
}


def quote_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, asof: times for which a trade's last mark is asked."""
    return table(spark, sf_dir, "orders").selectExpr("o_custkey % 150 as trade_id", "cast(date_add(date'2024-01-01', cast(o_orderkey % 40 as int)) as timestamp) as asof").distinct()


#: A listed symbol from each customer: spelt in several ways, some of them no symbol.
LISTED: Sheet = {
    "raw": "case c_custkey % 6 when 0 then concat('  ', lower(substr(c_mktsegment, 1, cast(1 + c_custkey % 8 as int))), ' ') when 1 then substr(md5(cast(c_custkey as string)), 1, 4) when 2 then concat(substr(c_mktsegment, 1, 2), '.b') when 3 then 'HES' when 4 then '' "
    "else substr(translate(md5(cast(c_custkey as string)), '0123456789', 'ghijklmnop'), 1, 5) end",
    "position": "c_custkey",
}


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(table(spark, sf_dir, "customer"), LISTED).select("raw", "position")


#: Snapshots from sums of a customer's orders (o_custkey, n, cents); text fields as a feed gives them.
SNAPSHOTS: Sheet = {
    "ticker": "o_custkey",
    "market_cap": "case when o_custkey % 37 = 0 then null when o_custkey % 19 = 0 then cents * 20000 else cents * 20 end",
    "average_volume": "case when o_custkey % 11 = 0 then 0 else n * 150000 end",
    "average_volume_10d": "n * 120000",
    "current_price": "case when o_custkey % 7 = 0 then 0 else cast(cents % 30000 as double) / 100 end",
    "market_price": "case when o_custkey % 14 = 0 then null else cast(cents % 20000 as double) / 100 end",
    "previous_close": "12.5e0",
    "volume": "case when o_custkey % 13 = 0 then 0 else cents % 3000000 end",
    "market_volume": "n * 1000",
    "n_news": "o_custkey % 6",
    "vix": "case when o_custkey % 10 = 0 then null else cast(10 + o_custkey % 30 as double) end",
    "short_percent": "case o_custkey % 6 when 0 then null when 1 then 'n/a' when 2 then concat('0.', cast(10 + o_custkey % 20 as string)) when 3 then '' else cast(o_custkey % 40 as string) end",
    "short_ratio": "case when o_custkey % 5 = 0 then 'unknown' else cast(o_custkey % 9 as string) end",
    "shares_short": "case when o_custkey % 8 = 0 then null else cast(1000 + o_custkey % 70 as string) end",
    "shares_short_prior": "case when o_custkey % 9 = 0 then '0' else cast(1000 + o_custkey % 50 as string) end",
}
SNAPSHOT_SUMS = "SELECT o_custkey, count(*) AS n, sum(cast(round(o_totalprice * 100) as bigint)) AS cents FROM {orders} GROUP BY o_custkey"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = spark.sql(SNAPSHOT_SUMS, orders=table(spark, sf_dir, "orders"))
    return add(sums, SNAPSHOTS).select(*SNAPSHOTS)


#: Filings from orders, and quotes from customers.
FILINGS: Sheet = {
    "ticker": "o_custkey",
    "tag": "case when o_custkey % 4 = 0 or o_orderkey % 3 = 0 then 'diluted' else 'basic' end",
    "form": "case when o_orderkey % 5 = 0 then '8-K' when o_orderkey % 5 = 1 then '10-K' else '10-Q' end",
    "value": "case when o_orderkey % 17 = 0 then null else cast(o_orderkey % 300 - 40 as double) / 100 end",
    "end_date": "cast(o_orderdate as date)",
    "filing_id": "o_orderkey",
}
EPS_QUOTES: Sheet = {
    "ticker": "c_custkey",
    "quoted": "case when c_custkey % 12 = 0 then 0 when c_custkey % 25 = 0 then null else cast(c_custkey % 500 as double) / 100 end",
    "second": "case when c_custkey % 3 = 0 then cast(c_custkey % 500 as double) * 106 / 10000 end",
}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(table(spark, sf_dir, "orders"), FILINGS).select(*FILINGS)


#: Company facts as documents: a customer's filings below their tag and unit, each in its place; some cut off, some of another taxonomy.
FACT_ROWS = "SELECT *, case when ticker % 23 = 0 then 'cut' when ticker % 29 = 0 then 'other' else 'sound' end AS state FROM {filings}"


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, body."""
    rows = spark.sql(FACT_ROWS, filings=filings(spark, sf_dir)).withColumn("name", F.when(F.col("tag") == "basic", "EarningsPerShareBasic").otherwise("EarningsPerShareDiluted"))
    figure = F.struct(F.date_format("end_date", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"), "form", F.col("filing_id").alias("accn"))
    tags = rows.groupBy("ticker", "state", "name").agg(F.sort_array(F.collect_list(figure)).alias("figures"))
    unit = F.create_map(F.lit("USD/shares"), F.col("figures"), F.lit("EUR"), F.slice("figures", 1, 1))
    company = tags.groupBy("ticker", "state").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(unit.alias("units"))))).alias("tags"))
    taxonomy = F.when(F.col("state") == "other", "ifrs-full").otherwise("us-gaap")
    body = F.to_json(F.struct(F.col("ticker").alias("cik"), F.concat(F.lit("company "), F.col("ticker").cast("string")).alias("entityName"), F.create_map(taxonomy, F.col("tags")).alias("facts")))
    return company.withColumn("whole", body).select("ticker", F.when(F.col("state") == "cut", F.expr("substring(whole, 1, length(whole) - 3)")).otherwise(F.col("whole")).alias("body"))


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, cik: one number a customer, ten digits wide."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sponsor: the first line of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("sponsor"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, name, from benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("company"), F.col("text").alias("name"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title (the first line), body."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("body"))


def eps_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(table(spark, sf_dir, "customer"), EPS_QUOTES).select(*EPS_QUOTES)


#: Series of text values by day, with gaps, from orders.
SERIES: list[Sheet] = [
    {
        "name": "case o_custkey % 4 when 0 then 'y10' when 1 then 'y2' when 2 then 'v9' else 'v90' end",
        "d": "cast(o_orderdate as date)",
    }
]
SERIES_VALUES = "SELECT name, d, case when count(*) % 5 = 0 then '.' when count(*) % 7 = 0 then '' else cast(cast(case when name like 'y%' then sum(o_orderkey) % 500 else 1000 + sum(o_orderkey) % 900 end as bigint) as string) end AS value FROM {rows} GROUP BY name, d"


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SERIES_VALUES, rows=add(table(spark, sf_dir, "orders"), *SERIES))


#: Articles from documents: three feeds, of which a ticker may lack the first.
ARTICLES: Sheet = {"id": "doc_id", "ticker": "doc_id % 97", "source_rank": "case when doc_id % 97 % 4 = 0 then 2 else doc_id % 3 end", "ts": "doc_id * 7 % 1000", "title": "coalesce(text, '')"}


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(table(spark, sf_dir, "documents").select("doc_id", "text"), ARTICLES).select(*ARTICLES)


#: Tickers as the first words of benchmark items.
TICKERS: Sheet = {"ticker": "upper(regexp_replace(substr(text, 1, 5), '[^A-Za-z]', ''))"}


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(table(spark, sf_dir, "benchmark"), TICKERS).select("ticker")


INSIDERS: Sheet = {"ticker": "event_id % 211", "insider": "case when event_id % 10 = 0 then null else concat('person ', cast(user_id % 40 as string)) end", "month": "cast(date_trunc('month', ts) as date)"}


def insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(table(spark, sf_dir, "events").where("event_type = 'purchase'"), INSIDERS).select(*INSIDERS)


#: Stored answers from event properties: plain, fenced, after prose, cut off early or late, and none.
ANSWERS: Sheet = {
    "id": "event_id",
    "raw": "case event_id % 6 when 0 then props when 1 then concat('```json', chr(10), props, chr(10), '```') when 2 then concat('Here it is: ', props) when 3 then concat(substr(props, 1, length(props) - 1), ', \"note\": \"cut') "
    "when 4 then concat(substr(props, 1, length(props) - 1), ', \"reason\": \"', repeat('long text ', 12), '\", \"tail\": \"lost') else 'no answer' end",
}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(table(spark, sf_dir, "events"), ANSWERS).select("id", "raw")
