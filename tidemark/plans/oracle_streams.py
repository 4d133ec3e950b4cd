"""SQL of the exits, their rules written apart from the operators'."""

EXITS = """m AS (SELECT user_id AS trade_id, ts, event_id, value, first(value) OVER w AS v0, CAST(first(ts) OVER w AS DATE) AS d0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 o AS (SELECT trade_id, ts, event_id, CASE WHEN v0 <> 0 THEN value / v0 - 1 END AS outcome, d0, CAST(ts AS DATE) - d0 AS age, trade_id % 2 = 0 AS spread, 20 + trade_id % 40 AS term, 1 + trade_id % 3 AS debit, trade_id % 8 AS width FROM m),
 r AS (SELECT *, max(outcome) OVER (PARTITION BY trade_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak, last_value(outcome IGNORE NULLS) OVER (PARTITION BY trade_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latest,
   CASE WHEN outcome <= CASE WHEN spread THEN -0.50 ELSE -0.45 END THEN 'stop_loss' WHEN outcome >= CASE WHEN spread AND width > 0 THEN (width - debit) * 0.70::DOUBLE / debit ELSE 0.50 END THEN 'take_profit'
   WHEN age * 2 >= term AND outcome < 0.20 THEN 'time_exit' WHEN age >= 14 THEN 'max_holding_period' END AS reason FROM o),
 x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY ts, event_id) AS k FROM r WHERE reason IS NOT NULL) WHERE k = 1)"""
EXIT_STATES = f"""WITH {EXITS},
 before AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY trade_id ORDER BY ts DESC, event_id DESC) AS k FROM r WHERE ts < d0 + 15) WHERE k = 1)
 SELECT trade_id, 'exit' AS kind, event_id, reason, round(outcome, 6) AS outcome, round(peak, 6) AS peak, age FROM x
 UNION ALL SELECT b.trade_id, 'overdue', NULL, 'holding_limit', round(b.latest, 6), round(b.peak, 6), 14 FROM before b LEFT JOIN x ON x.trade_id = b.trade_id WHERE (x.ts IS NULL OR x.ts >= b.d0 + 15) AND b.d0 + 15 <= (SELECT max(ts) FROM events) + INTERVAL 1 DAY"""
EXIT_TABLE = f"""WITH {EXITS} SELECT trade_id, CAST(ts AS DATE) AS day, d0 AS entry_date, CASE WHEN spread THEN 'BULL_CALL_SPREAD' ELSE 'LONG_CALL' END AS strategy, reason, round(outcome, 6) AS outcome, age, round(outcome * debit * 100 + 1e-9::DOUBLE, 2) AS pnl_per_contract FROM x"""
#: Trades entered before the day are opened by the first merge, the others by the second, which also brings all outcomes.
LEDGER = "SELECT trade_id, ticker, entry_date, strategy, reject_reason, outcome, CASE WHEN entry_date < DATE '1995-06-17' THEN 1 ELSE 2 END AS opened, CASE WHEN outcome IS NOT NULL THEN 2 END AS closed, 2 AS version FROM trades"
