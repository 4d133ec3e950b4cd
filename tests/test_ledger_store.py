"""The ledger's merge: inserts, changes, closures, repetition, a crash before the switch, another writer."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources.ledger_store import LedgerStore, Merged

SCHEMA = "ticker string, entry_date date, reason string, outcome double, note string"
DAY = datetime.date(2026, 1, 1)


def store(spark, tmp_path):
    return LedgerStore(spark, str(tmp_path / "ledger"), SCHEMA, ["ticker", "entry_date", "reason"])


def rows(spark, *values):
    return spark.createDataFrame([(t, DAY, r, o, n) for t, r, o, n in values], SCHEMA)


def held(s):
    return sorted((r["ticker"], r["reason"], r["outcome"], r["note"], r["opened"], r["closed"]) for r in s.rows().collect())


def test_merges(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.version() == 0 and held(s) == []
    assert s.merge(rows(spark)) == Merged(0)
    first = rows(spark, ("A", "roi", None, "x"), ("B", "roi", None, None), ("C", "", 0.5, "done"), (None, "roi", None, "no key"))
    assert s.merge(first) == Merged(1, 3, 0, 1)
    assert s.merge(first) == Merged(1) and s.version() == 1  # a repeated run changes nothing
    second = rows(spark, ("A", "roi", None, None), ("B", "roi", -0.2, "late"), ("C", "", 0.9, "again"), ("D", "", None, None), ("A", "corr", None, None))
    assert s.merge(second) == Merged(2, 2, 1, 1)
    want = [("A", "corr", None, None, 2, None), ("A", "roi", None, "x", 1, None), ("B", "roi", -0.2, "late", 1, 2), ("C", "", 0.5, "done", 1, 1), ("D", "", None, None, 2, None)]
    assert held(s) == sorted(want, key=lambda r: r[:2]) and s.merge(second) == Merged(2)
    assert s.rows(1).count() == 3  # an older version can still be read
    s.prune(1)
    assert s.rows().count() == 5 and not (tmp_path / "ledger/versions/000000001").exists()


def test_a_crash_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.merge(rows(spark, ("A", "", None, None)))
    before, changes = held(s), rows(spark, ("A", "", 0.1, None), ("B", "", None, None))
    with monkeypatch.context() as m:
        m.setattr(LedgerStore, "_switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.merge(changes)
    assert s.version() == 1 and held(s) == before and (tmp_path / "ledger/versions/000000002").exists()
    assert s.merge(changes) == Merged(2, 1, 1, 1) and [r[:3] for r in held(s)] == [("A", "", 0.1), ("B", "", None)]


def test_another_writer(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.merge(rows(spark, ("A", "", None, None)))
    real = LedgerStore._switch

    def late(self, seen, version):
        monkeypatch.setattr(LedgerStore, "_switch", real)
        real(other, 1, 2)  # in between, another merge has made its version current
        real(self, seen, version)

    monkeypatch.setattr(LedgerStore, "_switch", late)
    with pytest.raises(RuntimeError):
        s.merge(rows(spark, ("B", "", None, None)))


def test_changes_that_share_a_key(spark, tmp_path):
    s = store(spark, tmp_path)
    twice = rows(spark, ("A", "", None, "late"), ("A", "", None, "early")).withColumn("at", F.when(F.col("note") == "late", 2).otherwise(1))
    s.merge(twice, F.col("at"))
    assert [r[3] for r in held(s)] == ["late"]
    s.merge(rows(spark, ("A", "", None, "b"), ("A", "", None, "a")))
    assert [r[3] for r in held(s)] == ["b"]
