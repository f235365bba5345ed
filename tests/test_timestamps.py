from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headwater.functions.zones import zone_table
from headwater.operators.timestamps import normalize_timestamps


def us(y, mo, d, h=0, mi=0, s=0, f=0):
    return int(datetime(y, mo, d, h, mi, s, tzinfo=timezone.utc).timestamp()) * 1_000_000 + f


CASES = [
    # Date, Time, tz, order, expected
    ("2025-03-26T06:23:01Z", None, None, None, us(2025, 3, 26, 6, 23, 1)),
    ("  26-Mar-2025 06:23PM ", None, "Europe/London", "DMY", us(2025, 3, 26, 18, 23)),
    ("26-MAR-2025 06:23 pm", None, "Europe/London", "DMY", us(2025, 3, 26, 18, 23)),
    ("Sun, 10 Aug 2025 20:41:11 +0530", "11:11", "UTC", "DMY", us(2025, 8, 10, 15, 11, 11)),
    ("1714511723", None, None, None, 1714511723 * 1_000_000),
    ("1723303851298", None, None, None, 1723303851298 * 1000),
    ("04/05/2025", "10:00", "UTC", "DMY", us(2025, 5, 4, 10)),
    ("04/05/2025", "10:00", "UTC", "MDY", us(2025, 4, 5, 10)),
    ("4/5/25 9:05 AM", None, "UTC", "MDY", us(2025, 4, 5, 9, 5)),
    ("2025/04/05", "3:35 pm", "Asia/Tokyo", "DMY", us(2025, 4, 5, 6, 35)),
    ("April 20, 2024 at 3:34:26 PM UTC", None, "Asia/Tokyo", "YMD", us(2024, 4, 20, 15, 34, 26)),
    ("30. März 2025, 05:16 Uhr", None, "Europe/Berlin", "DMY", us(2025, 3, 30, 3, 16)),
    ("2025-08-02T00:38:21+01:00[Europe/London]", None, None, None, us(2025, 8, 1, 23, 38, 21)),
    ("2024-01-30 14:02:26.686+00", None, None, None, us(2024, 1, 30, 14, 2, 26, 686000)),
    ("2024-10-08T02:32:57.129", None, "America/New_York", "MDY", us(2024, 10, 8, 6, 32, 57, 129000)),
    ("20250729T132959Z", None, None, None, us(2025, 7, 29, 13, 29, 59)),
    ("2025-05-01 20:56:21 CST", None, "America/Chicago", "MDY", us(2025, 5, 2, 2, 56, 21)),
    ("2025-05-01 20:56:21 IST", None, "Asia/Kolkata", "DMY", us(2025, 5, 1, 15, 26, 21)),
    ("11-Feb-2024", "12:16 pm BST", "Europe/London", "DMY", us(2024, 2, 11, 11, 16)),
    # no case
    ("2025-05-01 20:56:21 IST", None, "Europe/Paris", "DMY", None),
    ("2025-05-01 20:56:21", None, None, "DMY", None),
    ("2025-02-30 10:15:00", None, "UTC", "DMY", None),
    ("2025-02-28", None, "UTC", "DMY", None),
    ("2025-02-28", "25:00", "UTC", "DMY", None),
    ("2025-02-28", "13:00 pm", "UTC", "DMY", None),
    ("2025-03-30 02:30:00", None, "Europe/Berlin", "DMY", None),  # never shown
    ("2025-10-26 02:30:00", None, "Europe/Berlin", "DMY", None),  # shown twice
    ("2025-10-26 02:30:00 +0100", None, "Europe/Berlin", "DMY", us(2025, 10, 26, 1, 30)),
    ("yesterday", "10:00", "UTC", "DMY", None),
    ("", "10:00", "UTC", "DMY", None),
    (None, "10:00", "UTC", "DMY", None),
    ("9" * 500, None, "UTC", "DMY", None),
    ("2025-02-28 10:00:00", None, "No/Where", "DMY", None),
]


def test_notations(spark):
    posts = spark.createDataFrame([(k, c[0], c[1], f"f{k}", "x") for k, c in enumerate(CASES)], "row_id long, Date string, Time string, feed string, tz string")
    feeds = spark.createDataFrame([(f"f{k}", c[2], c[3]) for k, c in enumerate(CASES)], "feed string, tz string, date_order string")
    got = {r.row_id: r.utc_us for r in normalize_timestamps(posts, feeds).collect()}
    assert got == {k: c[4] for k, c in enumerate(CASES)}


def test_rows_stay_and_edge_tables(spark):
    posts = spark.createDataFrame([(1, "2025-01-01 10:00:00", None, None), (1, "2025-01-01 10:00:00", None, None), (None, None, None, "f")], "row_id long, Date string, Time string, feed string")
    feeds = spark.createDataFrame([("f", "UTC", "DMY"), ("f", "UTC", "DMY"), (None, "UTC", "DMY")], "feed string, tz string, date_order string")
    assert normalize_timestamps(posts, feeds).count() == 3
    assert normalize_timestamps(posts.limit(0), feeds).count() == 0
    assert normalize_timestamps(posts, feeds.limit(0)).where("utc_us is null").count() == 3


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2_000_000_000), st.sampled_from(["Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo", "Africa/Casablanca"]))
def test_zone_tables_agree_with_the_zone(seconds, name):
    zone, table = ZoneInfo(name), zone_table(name)
    local = datetime.fromtimestamp(seconds, timezone.utc).astimezone(zone).replace(tzinfo=None)
    wall = int(local.replace(tzinfo=timezone.utc).timestamp())
    both = {int(local.replace(tzinfo=zone, fold=f).timestamp()) for f in (0, 1)}
    utc, sure = table.to_utc(np.array([wall]))
    assert bool(sure[0]) == (len(both) == 1)
    if sure[0]:
        assert utc[0] == seconds


@pytest.mark.parametrize("name", ["", "../etc/passwd", "Mars/Base"])
def test_unknown_zones(name):
    assert zone_table(name) is None
