"""Versioned zone transition tables.

A table holds, for one IANA zone and one release of the zone data, every change of offset or abbreviation
between 1900 and 2100. Wall-clock readings are converted for whole arrays with two binary searches.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np

try:
    from tzdata import IANA_VERSION
except ImportError:  # the system's zone files are used then
    IANA_VERSION = "system"

FIRST_YEAR, LAST_YEAR, PROBE = 1900, 2100, timedelta(days=7)


@dataclass(frozen=True)
class ZoneTable:
    version: str
    name: str
    at: np.ndarray  # UTC seconds of each change
    offsets: np.ndarray  # seconds east of UTC, one more than changes
    low: np.ndarray  # wall clock: start and end of the hour(s) shown twice or never
    high: np.ndarray
    abbreviations: dict

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds for wall-clock seconds, and whether the reading fixes exactly one instant."""
        k = np.searchsorted(self.high, wall, side="right")
        sure = np.ones(len(wall), dtype=bool)
        if len(self.low):
            inside = k < len(self.low)
            sure[inside] = self.low[k[inside]] > wall[inside]
        return wall - self.offsets[k], sure


@lru_cache(maxsize=1024)
def zone_table(name: str, version: str = IANA_VERSION) -> ZoneTable | None:
    """The table of a zone, or None if there is no such zone."""
    try:
        zone = ZoneInfo(name)
    except Exception:  # unknown keys, paths and odd characters raise different things
        return None

    def state(t: datetime) -> tuple[int, str]:
        local = t.astimezone(zone)
        return int(local.utcoffset().total_seconds()), local.tzname()

    t, end = datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc), datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc)
    now = state(t)
    at, states = [], [now]
    while t < end:
        after = t + PROBE
        if state(after) != now:
            lo, hi = t, after
            while hi - lo > timedelta(seconds=1):
                mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                lo, hi = (mid, hi) if state(mid) == now else (lo, mid)
            now = state(hi)
            at.append(int(hi.timestamp()))
            states.append(now)
            t = hi
        else:
            t = after
    changes, offsets = np.array(at, dtype=np.int64), np.array([s[0] for s in states], dtype=np.int64)
    before, after_ = changes + offsets[:-1], changes + offsets[1:]
    names = {abbr.upper(): off for off, abbr in states if abbr and abbr.isalpha()}  # the latest meaning wins
    return ZoneTable(version, name, changes, offsets, np.minimum(before, after_), np.maximum(before, after_), names)
