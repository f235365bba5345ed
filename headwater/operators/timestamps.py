"""Mixed timestamp notations and zones, normalised to one UTC instant.

Each text is reduced to its shape (digits, kinds of words, separators at their places). A distinct shape is
mapped to a parser once and cached; all texts of that shape are then converted together as arrays, through
the versioned tables of :mod:`headwater.functions.zones`.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.zones import zone_table

# fixed values: names of months, weekdays and day halves in the languages of the feeds
MONTHS = [
    "january jan januar jänner enero ene janvier janv janeiro января янв январь",
    "february feb februar febrero février fevrier févr fevereiro fev февраля фев февраль",
    "march mar märz mär maerz marzo mars março marco марта мар март",
    "april apr abril abr avril avr апреля апр апрель",
    "may mai mayo maio мая май",
    "june jun juni junio juin junho июня июн июнь",
    "july jul juli julio juillet juil julho июля июл июль",
    "august aug agosto ago août aout августа авг август",
    "september sep sept septiembre septembre setembro set сентября сен сентябрь",
    "october oct oktober okt octubre octobre outubro out октября окт октябрь",
    "november nov noviembre novembre novembro ноября ноя ноябрь",
    "december dec dezember dez diciembre dic décembre decembre déc dezembro декабря дек декабрь",
]
WEEKDAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag mo di mi do fr sa so "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mer jeu ven sam dim "
    "lunes martes miércoles jueves viernes sábado domingo segunda terça quarta quinta sexta "
    "понедельник вторник среда четверг пятница суббота воскресенье пн вт ср чт пт сб вс"
)
FILLERS = "at uhr um on of de del le the à às a h"
ORDINALS = "st nd rd th"
UNIVERSAL = "z utc gmt ut zulu"

MONTH_NUMBER = {w: i + 1 for i, row in enumerate(MONTHS) for w in row.split()}
WORD_CLASS = (
    {w: "F" for w in FILLERS.split()}
    | {w: "W" for w in WEEKDAYS.split()}
    | {w: "N" for w in ORDINALS.split()}
    | {w: "Z" for w in UNIVERSAL.split()}
    | {w: "M" for w in MONTH_NUMBER}
    | {"am": "P", "pm": "P", "t": "T"}
)

EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"

CLOCK = (
    r"(?:(?P<h>9{1,2}):(?P<mi>99)(?::(?P<se>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<p>P+))?|(?P<hp>9{1,2}) ?(?P<pp>P+)"
    r"|(?P<hc>99)(?P<mc>99)(?P<sc>99)?)(?: F+)?"
)
ZONE = (
    r"(?: ?(?:(?:Z+)?(?P<os>[+-])(?P<oh>99)(?::?(?P<om>99))?|(?P<u>Z+)|(?P<x>[A-Z]+(?:[/_-][A-Z]+)*)))?"
    r"(?: ?\[(?P<b>[^\]]+)\])?(?: \([A-Z ]+\))?"
)
DAYS = [
    r"(?P<y>9999)(?P<s>[-/.])(?P<m>9{1,2})(?P=s)(?P<d>9{1,2})",
    r"(?P<y>9999)(?P<m>99)(?P<d>99)",
    r"(?P<d>9{1,2})(?:N+|\.)?[-/ ]*(?:F+ )?(?P<M>M+)\.?(?:[-/]|,? )(?:F+ )?(?P<y>9999|99)",
    r"(?P<M>M+)\.?[-/ ](?P<d>9{1,2})(?:N+)?(?:,? |[-/])(?P<y>9999)",
    r"(?P<y>9999)[-/ ](?P<M>M+)[-/ ](?P<d>9{1,2})",
    r"(?P<n1>9{1,2})(?P<s>[-/.])(?P<n2>9{1,2})(?P=s)(?P<n3>9999|99)",
]
PARSERS = [re.compile(rf"(?:W+\.?,? )?{day}(?:(?:,? (?:F+ )?| ?T ?){CLOCK}{ZONE})?") for day in DAYS]
EPOCH = re.compile(r"9{10}(?:999)?")
TIME_ONLY = re.compile(CLOCK + ZONE)


class _Mask(dict):
    def __missing__(self, c: int) -> str:
        ch = chr(c)
        out = "9" if ch in "0123456789" else "a" if ch.isalpha() else ch
        if len(self) < 4096:
            self[c] = out
        return out


_MASK = _Mask()


@lru_cache(maxsize=65536)
def parser_of(shape: str, time_only: bool) -> dict | None:
    """Where a shape holds which part: {part: (from, to)}; None if the shape is no notation known here."""
    if time_only:
        m = TIME_ONLY.fullmatch(shape)
        return {k: m.span(k) for k, v in m.groupdict().items() if v is not None} if m else None
    if EPOCH.fullmatch(shape):
        return {"epoch": (0, len(shape))}
    for p in PARSERS:
        if m := p.fullmatch(shape):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _digits(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for c in range(*span):
        out = out * 10 + (chars[:, c].astype(np.int64) - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    a, b = span
    return np.ascontiguousarray(chars[:, a:b]).view(f"<U{b - a}").ravel()


def _looked_up(words: np.ndarray, f) -> np.ndarray:
    distinct, back = np.unique(words, return_inverse=True)
    return np.array([f(str(w).lower()) for w in distinct])[back]


def _day_number(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01, and whether there is such a day."""
    ok = (m >= 1) & (m <= 12) & (y >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    length = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - first
    return first + d - 1, ok & (d >= 1) & (d <= length)


class _Parts:
    """What was read of each text: day, time of day, written offset or zone name, or an absolute instant."""

    def __init__(self, n: int):
        self.day = np.zeros(n, dtype=np.int64)
        self.has_day = np.zeros(n, dtype=bool)
        self.clock = np.zeros(n, dtype=np.int64)  # microseconds
        self.has_clock = np.zeros(n, dtype=bool)
        self.offset = np.zeros(n, dtype=np.int64)  # seconds
        self.has_offset = np.zeros(n, dtype=bool)
        self.zone = np.full(n, None, dtype=object)
        self.instant = np.zeros(n, dtype=np.int64)
        self.has_instant = np.zeros(n, dtype=bool)
        self.bad = np.zeros(n, dtype=bool)  # written, but impossible


def _read(texts: list, rows: np.ndarray, order: np.ndarray, out: _Parts, time_only: bool) -> None:
    """Reads texts[i] for i in rows into out; groups by mask, then by the kinds of the words."""
    clean = {}
    for i in rows:
        s = " ".join(texts[i].split()).replace("−", "-")
        if ".m." in s.lower():
            s = re.sub(r"(?i)\b([ap])\.m\.", r"\1m", s)
        if 0 < len(s) <= 80:
            clean[i] = s
    groups: dict[str, list] = {}
    for i, s in clean.items():
        groups.setdefault(s.translate(_MASK), []).append(i)
    for mask, ids in groups.items():
        at = np.array(ids)
        chars = np.array([clean[i] for i in ids]).view(np.uint32).reshape(len(ids), -1)
        runs = [m.span() for m in re.finditer("a+", mask)]
        kinds = [_looked_up(_words(chars, r), lambda w: WORD_CLASS.get(w, "X")) for r in runs]
        codes = np.zeros(len(ids), dtype=np.int64)
        for k in kinds:
            codes = codes * 128 + k.view(np.uint32).astype(np.int64)
            codes = np.unique(codes, return_inverse=True)[1]
        for code in np.unique(codes):
            these = np.flatnonzero(codes == code)
            shape = list(mask)
            for (a, b), k in zip(runs, kinds, strict=True):
                shape[a:b] = str(k[these[0]]) * (b - a)
            plan = parser_of("".join(shape), time_only)
            if plan is not None:
                _convert(plan, chars[these], at[these], order, out)


def _convert(plan: dict, chars: np.ndarray, at: np.ndarray, order: np.ndarray, out: _Parts) -> None:
    n = len(at)

    def num(*names: str) -> np.ndarray | None:
        return next((_digits(chars, plan[x]) for x in names if x in plan), None)

    if "epoch" in plan:
        seconds = _digits(chars, plan["epoch"])
        out.instant[at] = seconds * (1_000_000 if plan["epoch"][1] == 10 else 1000)
        out.has_instant[at] = True
        return
    bad = np.zeros(n, dtype=bool)
    if "y" in plan or "n1" in plan:
        if "n1" in plan:
            a, b, c = num("n1"), num("n2"), num("n3")
            short = plan["n3"][1] - plan["n3"][0] == 2
            kind = order[at]
            mdy, ymd = kind == "MDY", kind == "YMD"
            y = np.where(ymd & short, a, c)
            m = np.where(mdy, a, b)
            d = np.where(mdy, b, np.where(ymd & short, c, a))
            y = y + 2000 * (y < 100) * short
            bad |= ~np.isin(kind, ["DMY", "MDY", "YMD"])
            if short:
                bad |= ymd & (plan["n1"][1] - plan["n1"][0] != 2)
        else:
            y, d = num("y"), num("d")
            if plan["y"][1] - plan["y"][0] == 2:
                y = y + 2000
            m = num("m") if "m" in plan else _looked_up(_words(chars, plan["M"]), lambda w: MONTH_NUMBER.get(w, 0))
        day, ok = _day_number(y, m, d)
        out.day[at], out.has_day[at] = day, ok & ~bad
        bad |= ~ok
    hour = num("h", "hp", "hc")
    if hour is not None:
        minute, second = num("mi", "mc"), num("se", "sc")
        minute = np.zeros(n, dtype=np.int64) if minute is None else minute
        second = np.zeros(n, dtype=np.int64) if second is None else second
        half = next((plan[x] for x in ("p", "pp") if x in plan), None)
        if half:
            pm = _looked_up(_words(chars, half), lambda w: w == "pm")
            bad |= (hour < 1) | (hour > 12)
            hour = hour % 12 + 12 * pm
        bad |= (hour > 23) | (minute > 59) | (second > 59)
        micros = np.zeros(n, dtype=np.int64)
        if "f" in plan:
            a, b = plan["f"]
            b = min(b, a + 6)
            micros = _digits(chars, (a, b)) * 10 ** (6 - (b - a))
        out.clock[at] = ((hour * 60 + minute) * 60 + second) * 1_000_000 + micros
        out.has_clock[at] = True
    if "os" in plan:
        away = num("oh") * 3600 + (num("om") * 60 if "om" in plan else 0)
        sign = np.where(chars[:, plan["os"][0]] == ord("-"), -1, 1)
        out.offset[at], out.has_offset[at] = sign * away, True
        bad |= away > 18 * 3600
    elif "u" in plan:
        out.has_offset[at] = True
    elif "x" in plan:
        out.zone[at] = _words(chars, plan["x"]).astype(object)
    elif "b" in plan:
        out.zone[at] = _words(chars, plan["b"]).astype(object)
    out.bad[at] |= bad


def _to_utc(dates: pd.Series, times: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
    n = len(dates)
    d, t = dates.to_numpy(dtype=object), times.to_numpy(dtype=object)
    order = np.array([o.strip().upper() if isinstance(o, str) else "" for o in orders.to_numpy(dtype=object)] or [""], dtype="<U8")
    feed_zone = zones.to_numpy(dtype=object)
    got = _Parts(n)
    _read(d, np.array([i for i in range(n) if isinstance(d[i], str)], dtype=np.int64), order, got, False)
    open_ = np.flatnonzero(got.has_day & ~got.has_clock & ~got.bad)
    later = _Parts(n)
    _read(t, np.array([i for i in open_ if isinstance(t[i], str)], dtype=np.int64), order, later, True)
    use = later.has_clock & ~later.bad
    got.clock[use], got.has_clock[use] = later.clock[use], True
    got.offset[use], got.has_offset[use], got.zone[use] = later.offset[use], later.has_offset[use], later.zone[use]

    result, known = got.instant.copy(), got.has_instant.copy()
    ready = got.has_day & got.has_clock & ~got.bad
    wall = got.day * 86_400_000_000 + got.clock
    written = ready & got.has_offset
    result[written], known[written] = wall[written] - got.offset[written] * 1_000_000, True
    rest = np.flatnonzero(ready & ~got.has_offset)
    pairs: dict[tuple, list] = {}
    for i in rest:
        pairs.setdefault((feed_zone[i] if isinstance(feed_zone[i], str) else None, got.zone[i]), []).append(i)
    for (home, name), ids in pairs.items():
        at = np.array(ids)
        table = zone_table(home) if home else None
        if name is not None:
            if table is not None and name.upper() in table.abbreviations:
                result[at], known[at] = wall[at] - table.abbreviations[name.upper()] * 1_000_000, True
                continue
            table = zone_table(name) if "/" in name else None
        if table is None:
            continue
        seconds, micros = np.divmod(wall[at], 1_000_000)
        utc, sure = table.to_utc(seconds)
        result[at], known[at] = utc * 1_000_000 + micros, sure
    return pd.Series(pd.array(np.where(known, result, 0), dtype="Int64")).mask(~known)


def utc_micros(date: Column, time: Column, zone: Column, date_order: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a post's date and time texts; null where they fix no instant.

    ``zone`` is the IANA zone in which texts without zone are written (null: unknown), ``date_order`` DMY,
    MDY or YMD for all-digit dates. Defined results: null or empty date, junk, a day that does not exist, no
    time of day in either text, an hour the zone shows twice or never, an unknown zone: null. A written
    offset or zone holds over the feed's; an abbreviation means what it means in the feed's zone. The time
    text counts only where the date text has no time of day. Texts over 80 characters are junk.
    """
    s = lambda c: c.cast("string")
    return F.pandas_udf(_to_utc, "long")(s(date), s(time), s(zone), s(date_order))


def normalize_timestamps(
    posts: DataFrame, feeds: DataFrame, date: str = "Date", time: str = "Time", feed: str = "feed", out: str = "utc_us"
) -> DataFrame:
    """``posts`` with one more column ``out``, the instant in UTC (see :func:`utc_micros`).

    ``feeds`` (feed, tz, date_order) is joined on its key; a feed listed twice counts once (its least row), a
    post of an unlisted or null feed has no zone. Every post stays exactly once, whatever its other columns
    are called; an ``out`` column already there is replaced. An empty table gives an empty table.
    """
    key, tz, order = "__hw_feed", "__hw_tz", "__hw_order"
    lookup = feeds.groupBy(F.col("feed").alias(key)).agg(F.min(F.struct("tz", "date_order")).alias("__hw_f"))
    lookup = lookup.select(key, F.col("__hw_f.tz").alias(tz), F.col("__hw_f.date_order").alias(order))
    joined = posts.join(lookup, F.col(feed) == F.col(key), "left")
    return joined.withColumn(out, utc_micros(F.col(date), F.col(time), F.col(tz), F.col(order))).drop(key, tz, order)
