"""The stateful exit monitor: equal to the batch rules whatever the order of its input, over restarts; limits and expiry."""

import datetime
import random

import pytest

from tidemark.operators import lifecycle
from tidemark.streaming import exit_states as xs

KINDS = "trade_id long, ts timestamp, event_id long, value double"
START = datetime.datetime(2026, 1, 1, 9)


def at(days, hours=0):
    return START + datetime.timedelta(days=days, hours=hours)


class Landing:
    """Files that arrive one after the other, each a run of the stream from the same checkpoint."""

    def __init__(self, spark, path, **more):
        self.spark, self.path, self.more = spark, path, more
        self.n = 0

    def arrive(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(f"{self.path}/in/part{self.n}")
        marks = self.spark.readStream.schema(KINDS).option("recursiveFileLookup", "true").parquet(f"{self.path}/in")
        xs.run_appending(xs.exit_states(marks, **self.more), f"{self.path}/out", f"{self.path}/state")

    def rows(self):
        return sorted((r["trade_id"], r["kind"], r["event_id"], r["reason"], r["outcome"] and round(r["outcome"], 6), r["peak"] and round(r["peak"], 6), r["age"]) for r in self.spark.read.schema(xs.OUT).parquet(f"{self.path}/out").where("trade_id >= 0").collect())


def test_equal_to_the_batch_rules_in_any_order_and_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows, event = [], 0
    for trade in range(14):
        value = 100.0
        for day in range(30):
            for _ in range(rng.randrange(3)):
                value *= rng.uniform(0.9, 1.11)
                rows.append((trade, at(day, rng.randrange(3)), event, None if rng.random() < 0.05 else 0.0 if trade == 3 and day == 0 else round(value, 4)))
                event += 1
    rows.sort(key=lambda r: r[1] + datetime.timedelta(hours=rng.uniform(0, 40)))  # up to 40 hours late
    land = Landing(spark, str(tmp_path), hold=20, delay="2 days")
    for k in range(0, len(rows), 150):
        land.arrive(rows[k : k + 150])
    land.arrive([(-1, at(40), 0, None)])
    batch = lifecycle.first_exit(spark.createDataFrame(rows, KINDS), 20).collect()
    want = sorted((r["trade_id"], r["event_id"], r["reason"], r["outcome"], r["peak"], r["age"]) for r in batch)
    got = [r for r in land.rows() if r[1] == "exit"]
    assert [(r[0], *r[2:]) for r in got] == want and len({r[3] for r in got}) >= 3
    land.arrive([(0, at(60), 9999, 1.0), (-1, at(70), 0, None)])  # a closed trade takes no more marks
    assert [r for r in land.rows() if r[1] == "exit"] == got


def test_holding_limit_and_expiry_of_the_state(spark, tmp_path):
    land = Landing(spark, str(tmp_path), hold=5, delay="1 day", expire=30)
    quiet = lambda trade, day, value, event: (trade, at(day), event, value)
    clock = lambda day: (-1, at(day), 0, None)
    land.arrive([quiet(1, 0, 100.0, 1), quiet(1, 1, 110.0, 2), quiet(1, 2, 105.0, 3), quiet(3, 0, 100.0, 4)])
    assert land.rows() == []
    land.arrive([clock(6)])  # the watermark stands within day 5: the limit's day isn't over
    assert land.rows() == []
    land.arrive([clock(8)])
    overdue = [(1, "overdue", None, "holding_limit", 0.05, 0.1, 5), (3, "overdue", None, "holding_limit", 0, 0, 5)]
    assert land.rows() == overdue
    land.arrive([quiet(1, 9, 108.0, 7), clock(12)])
    assert land.rows() == sorted([*overdue, (1, "exit", 7, "max_holding_period", 0.08, 0.1, 9)])
    land.arrive([clock(50)])  # the states of 1 and 3 expire; a new mark opens a new trade
    land.arrive([quiet(1, 60, 50.0, 10), quiet(1, 61, 80.0, 11), clock(70)])
    assert (1, "exit", 11, "take_profit", 0.6, 0.6, 1) in land.rows()


@pytest.mark.parametrize("order", [1, -1])
def test_a_mark_after_the_limit_comes_after_the_overdue_row(spark, tmp_path, order):
    land = Landing(spark, str(tmp_path), hold=5, delay="1 day")
    land.arrive([(1, at(0), 1, 100.0), (1, at(20), 2, 130.0), (-1, at(40), 3, None)][::order])
    assert land.rows() == [(1, "exit", 2, "max_holding_period", 0.3, 0.3, 20), (1, "overdue", None, "holding_limit", 0, 0, 5)]
