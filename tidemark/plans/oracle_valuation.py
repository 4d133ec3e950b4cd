"""SQL of the valuation of positions, written apart from the operator's sheets."""

from __future__ import annotations

from tidemark.functions.sheets import as_sql
from tidemark.sources.adapters import BOOK, BOOK_ROWS, STOCK_QUOTES


def valuation_sql(chain: str, bars: str) -> dict[str, str]:
    """chain, bars: CTEs named chain and sbars (which lack the volume)."""
    volume = "(SELECT s.*, v.volume FROM sbars s JOIN (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2) v USING (ticker, d))"
    valued = f"""WITH {chain}, {bars},
 p AS (SELECT *, CASE WHEN strategy LIKE '%PUT%' OR strategy LIKE '%BEAR%' THEN 'put' ELSE 'call' END AS kind, coalesce(strategy LIKE '%SPREAD%', false) AS spread FROM {as_sql("(" + BOOK_ROWS.format(lines="lineitem") + ")", *BOOK)}),
 q AS (SELECT ticker, d, CASE WHEN last > 0 THEN last WHEN bid > 0 AND ask > 0 THEN round((bid + ask) / 2 + 1e-9::DOUBLE, 4) ELSE 0 END AS stock FROM {as_sql(volume, STOCK_QUOTES)}),
 legs AS (SELECT trade_id, 'long' AS leg, ticker, expiry, kind, strike AS k FROM p WHERE expiry >= value_day UNION ALL SELECT trade_id, 'short', ticker, expiry, kind, short_strike FROM p WHERE expiry >= value_day AND short_strike > 0),
 hits AS (SELECT l.trade_id, l.leg, c.bid, c.ask, row_number() OVER (PARTITION BY l.trade_id, l.leg ORDER BY c.type <> l.kind, round(abs(c.strike - l.k), 6), c.row) AS n FROM legs l JOIN chain c ON c.ticker = l.ticker AND c.expiry = l.expiry AND round(abs(c.strike - l.k), 6) <= 0.01 AND c.ask > 0),
 mids AS (SELECT trade_id, leg, CASE WHEN bid > 0 THEN round((bid + ask) / 2 + 1e-9::DOUBLE, 4) ELSE ask END AS mid FROM hits WHERE n = 1),
 s AS (SELECT p.*, l.mid AS long_mid, h.mid AS short_mid, coalesce(q.stock, 0) AS stock FROM p LEFT JOIN mids l ON l.trade_id = p.trade_id AND l.leg = 'long' LEFT JOIN mids h ON h.trade_id = p.trade_id AND h.leg = 'short' ASOF LEFT JOIN q ON q.ticker = p.ticker AND p.value_day >= q.d),
 a AS (SELECT s.*, CASE WHEN s.expiry < s.value_day AND b.d < s.expiry + 4 THEN b.close END AS after FROM s ASOF LEFT JOIN sbars b ON b.ticker = s.ticker AND s.expiry <= b.d),
 v AS (SELECT *, CASE WHEN entry_debit > 0 THEN entry_debit WHEN NOT spread THEN CASE WHEN coalesce(entry_ask, 0) <> 0 THEN entry_ask ELSE coalesce(entry_last, 0) END WHEN coalesce(net_debit, 0) <> 0 THEN net_debit WHEN entry_ask > 0 AND entry_short_bid > 0 THEN round(entry_ask - entry_short_bid + 1e-9::DOUBLE, 2) ELSE coalesce(entry_ask, 0) END AS debit,
   CASE WHEN NOT spread THEN CASE WHEN expiry >= value_day THEN long_mid END WHEN short_strike IS NULL THEN NULL WHEN expiry >= value_day THEN CASE WHEN long_mid > 0 AND short_mid > 0 THEN greatest(0, round(long_mid - short_mid + 1e-9::DOUBLE, 4)) END
     WHEN short_strike <= strike OR round(short_strike - strike + 1e-9::DOUBLE, 2) <= 0 THEN NULL ELSE CASE WHEN after >= short_strike THEN round(short_strike - strike + 1e-9::DOUBLE, 2) WHEN after > strike THEN round(after - strike + 1e-9::DOUBLE, 4) WHEN after IS NOT NULL THEN 0 END END AS value,
   CASE WHEN entry_stock > 0 AND stock > 0 THEN stock / entry_stock - 1 ELSE 0 END AS moved FROM a),
 o AS (SELECT *, CASE WHEN spread AND (value IS NULL OR debit <= 0) THEN 'none' WHEN spread THEN CASE WHEN expiry < value_day THEN 'intrinsic' ELSE 'legs' END WHEN debit > 0 AND value > 0 THEN 'quote' WHEN debit > 0 AND entry_stock > 0 THEN 'delta' ELSE 'stock' END AS basis FROM v)"""
    return {
        "position_value": f"{valued} SELECT trade_id, basis, expiry < value_day AS expired, {', '.join(f'round({e} + 1e-9::DOUBLE, 4) AS {n}' for n, e in (('long_mid', 'long_mid'), ('short_mid', 'short_mid'), ('stock', 'stock'), ('close_after', 'after'), ('value', 'value')))} FROM o",
        "trade_outcome": f"{valued} SELECT trade_id, strategy, basis, round(debit + 1e-9::DOUBLE, 6) AS debit, round(CASE basis WHEN 'none' THEN NULL WHEN 'stock' THEN moved WHEN 'delta' THEN CASE WHEN moved * 0.65 * entry_stock / debit < -1 THEN -1 WHEN moved * 0.65 * entry_stock / debit > 5 THEN 5 ELSE moved * 0.65 * entry_stock / debit END ELSE value / debit - 1 END + 1e-9::DOUBLE, 6) AS outcome FROM o",
    }
