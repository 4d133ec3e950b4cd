"""Times of marks by plain datetimes, as pandas has them."""

import datetime

import pandas as pd

from tidemark.streaming.exit_states import _days, _ms


def test_milliseconds_round_up_and_days_count_midnights():
    base = datetime.datetime(2024, 2, 28, 23, 59, 59, 999_001)
    times = [base, datetime.datetime(1969, 12, 31, 23, 59, 59, 999_500), datetime.datetime(1970, 1, 1), *(base + datetime.timedelta(hours=7 * k, microseconds=333 * k) for k in range(50))]
    for t in times:
        assert _ms(t) == -(-pd.Timestamp(t).value // 1_000_000)
        assert _days(t, base) == (pd.Timestamp(t).normalize() - pd.Timestamp(base).normalize()).days
