"""Reading of time texts: every valid interpretation of one text, and its placing in a zone."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)
_EPOCH_DAY = _EPOCH.toordinal()

#: Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660,
    "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_TAIL = r"\s*(?P<tail>[^\s\d].*|)$"
_NAME = r"(?P<mon>[A-Za-z]{3})[a-z]*\.?"
_SHAPES = [
    ("year-first", re.compile(r"(?P<Y>\d{4})(?P<sep>[-:/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:[Tt]|,?\s+)" + _TIME + _TAIL)),
    ("compact", re.compile(r"(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt_ -]?(?P<H>\d{2})(?P<M>\d{2})(?:(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?P<ap>)" + _TAIL)),
    ("all-number", re.compile(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<Y>\d{4})(?:[Tt]|,?\s+)" + _TIME + _TAIL)),
    ("day-name", re.compile(r"(?:[A-Za-z]{3,9}\.?,?\s+)?(?P<d>\d{1,2})[\s-]+" + _NAME + r",?[\s-]+(?P<Y>\d{4}),?\s+" + _TIME + _TAIL)),
    ("name-day", re.compile(r"(?:[A-Za-z]{3,9}\.?,?\s+)?" + _NAME + r"\s+(?P<d>\d{1,2}),?\s+(?P<Y>\d{4}),?\s+" + _TIME + _TAIL)),
    ("year-last", re.compile(r"(?:[A-Za-z]{3,9}\.?,?\s+)?" + _NAME + r"\s+(?P<d>\d{1,2})\s+" + _TIME + r"(?:\s+(?P<tail>[^\s\d]\S*))?\s+(?P<Y>\d{4})$")),
]
_COUNT = re.compile(r"(-?\d+)(?:\.(\d+))?$")
_OFFSET = re.compile(r"(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?::?\d{2})?\s*(?:\[[^\]]*\]|\([^)]*\))?$", re.I)


#: Costs of a reading by itself: an unlikely one, and one that contradicts what is known of its source. Both outweigh any path.
UNLIKELY, CONTRADICTS = 1_000, 1_000_000
#: Formats that a path may switch between: all-number dates by their order; all others are alike.
PLAIN, DMY, MDY = 0, 1, 2
_ORDERS = {"dmy": DMY, "mdy": MDY}
#: Counts are read in every unit that gives an instant before this one (year 2100).
_LAST_US = 4_102_444_800_000_000


class Reading(NamedTuple):
    """One interpretation: its format, the wall time in microseconds, the zone the text names, and its own cost.

    ``zone`` is an offset in minutes, a zone name, or None; an instant (a count) has offset 0.
    """

    form: int
    wall_us: int
    zone: int | str | None
    cost: int = 0


@lru_cache(maxsize=1000)
def _zone_info(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - unknown, malformed or a path: all mean that there is no such zone
        return None


@lru_cache(maxsize=10_000)
def zone_of(text: str | None) -> int | str | None:
    """Offset in minutes or zone name that a text stands for; None for none, ``"?"`` for an unknown one."""
    t = (text or "").strip()
    if not t:
        return None
    if m := _OFFSET.match(t):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        if minutes > 18 * 60 or int(m[3] or 0) > 59:
            return "?"
        return -minutes if m[1] == "-" else minutes
    t = t.strip("[]() ")
    if t.upper() in ABBREVIATIONS:
        return ABBREVIATIONS[t.upper()]
    if "/" in t and _zone_info(t):
        return t
    return "?"


def _micros(fraction: str | None) -> int:
    return int((fraction or "").ljust(6, "0")[:6] or 0)


def _wall(y: int, mo: int, d: int, clock: tuple) -> int | None:
    hour, minute, second, fraction, half = clock
    hour, minute, second = int(hour), int(minute), int(second or 0)
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half in "Pp" else 0)
    try:
        days = date(y, mo, d).toordinal() - _EPOCH_DAY
    except ValueError:
        return None
    if hour > 23 or minute > 59 or second > 59:
        return None
    return ((days * 24 + hour) * 60 + minute) * 60_000_000 + second * 1_000_000 + (_micros(fraction) if fraction else 0)


def _counts(m: re.Match) -> list[Reading]:
    """Readings of a count: the unit that its digits suggest first, then all others that give an instant before 2100."""
    whole, digits = int(m[1]), len(m[1].lstrip("-"))
    if 9 <= digits <= 11:
        likely, us = 1_000_000, whole * 1_000_000 + (-1 if whole < 0 else 1) * _micros(m[2])
    elif 12 <= digits <= 13 and not m[2]:
        likely, us = 1000, whole * 1000
    elif 15 <= digits <= 16 and not m[2]:
        likely, us = 1, whole
    else:
        return []
    others = [] if m[2] else [whole * k for k in (1_000_000, 1000, 1) if k != likely and abs(whole * k) < _LAST_US]
    return [Reading(PLAIN, us, 0), *(Reading(PLAIN, x, 0, UNLIKELY) for x in others)]


def interpretations(text: str | None) -> list[Reading]:
    """All valid readings of a text: both orders of an all-number date that does not begin with the year, all units of a count."""
    t = " ".join((text or "").split())
    if not t:
        return []
    if (m := _COUNT.match(t)) and (found := _counts(m)):
        return found
    for form, shape in _SHAPES:
        m = shape.match(t)
        if not m:
            continue
        clock = m.group("H", "M", "S", "f", "ap")
        tail = m["tail"]
        zone = zone_of(tail) if tail else None
        if zone == "?":
            return []
        year = int(m["Y"])
        if form == "all-number":
            a, b = int(m["a"]), int(m["b"])
            tries = [(DMY, b, a), (MDY, a, b)]
        elif form in ("year-first", "compact"):
            tries = [(PLAIN, int(m["m"]), int(m["d"]))]
        else:
            tries = [(PLAIN, _MONTHS.get(m["mon"].lower(), 0), int(m["d"]))]
        return [Reading(f, w, zone) for f, mo, d in tries if (w := _wall(year, mo, d, clock)) is not None]
    return []


def _offsets(wall_us: int, zone: str) -> tuple[int, int]:
    """Offsets in microseconds of both occurrences of a wall time (equal where there is one)."""
    when = (_EPOCH + timedelta(microseconds=wall_us)).replace(tzinfo=_zone_info(zone))
    return when.utcoffset() // _US, when.replace(fold=1).utcoffset() // _US


#: Stretch of wall time within which a zone changes its offset at most once.
_STRETCH_US = 8 * 86_400_000_000


@lru_cache(maxsize=100_000)
def _steady(stretch: int, zone: str) -> int | None:
    """The offset throughout a stretch of wall time; None where it changes."""
    try:
        ends = _offsets(stretch * _STRETCH_US - 86_400_000_000, zone) + _offsets((stretch + 1) * _STRETCH_US + 86_400_000_000, zone)
    except OverflowError:
        return None
    return ends[0] if len(set(ends)) == 1 else None


def instants(wall_us: int, zone: int | str) -> list[tuple[int, int]]:
    """(UTC microseconds, cost) of every occurrence of a wall time: the second of two is unlikely; a skipped one has the offset before the skip."""
    if isinstance(zone, int):
        return [(wall_us - zone * 60_000_000, 0)]
    steady = _steady(wall_us // _STRETCH_US, zone)
    if steady is not None:
        return [(wall_us - steady, 0)]
    try:
        first, second = _offsets(wall_us, zone)
    except OverflowError:
        return []
    return [(wall_us - first, 0)] + ([(wall_us - second, UNLIKELY)] if second < first else [])


def placed(text: str | None, offset: str | None, zone_name: str | None, date_order: str | None) -> list[tuple[int, int, int]]:
    """(form, UTC microseconds, cost) of every reading that can be placed in a zone, nothing left out.

    The zone inside the text comes first, then ``offset``, then ``zone_name``.  A reading against a known
    ``date_order`` (dmy or mdy) contradicts its source.
    """
    order, out = _ORDERS.get(date_order), []
    for r in interpretations(text):
        zone = r.zone
        if zone is None:
            for more in (offset, zone_name):
                if more and (z := zone_of(more)) is not None and z != "?":
                    zone = z
                    break
            else:
                continue
        cost = r.cost + (CONTRADICTS if r.form and order and r.form != order else 0)
        for utc, c in instants(r.wall_us, zone):
            out.append((r.form, utc, cost + c))
    return out
