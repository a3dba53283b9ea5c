"""Windows of time, as a reader names them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from typing import NamedTuple

_DAYS = re.compile(r"[+-]?[0-9]+d")


class Compared(NamedTuple):
    """prior: where the earlier of two windows begins; recent: the first day of the later one."""

    prior: str
    recent: str


def days_of(window: str) -> int:
    """The days of a window such as ``7d``; what is no such window, or has no days, raises."""
    if not _DAYS.fullmatch(window) or int(window[:-1]) <= 0:
        raise ValueError(f"a window is a number of days such as 7d, not {window!r}")
    return int(window[:-1])


def since(window: str, now: str) -> str:
    """The moment so many days before another."""
    return str(datetime.fromisoformat(now) - timedelta(days=days_of(window)))


def compared(window: str, now: str) -> Compared:
    """Two windows of whole days, one after the other: the later one ends with today and holds as many days as the earlier one, so that
    neither has a day, or a part of one, that the other lacks."""
    midnight = datetime.fromisoformat(now).replace(hour=0, minute=0, second=0, microsecond=0)
    days = days_of(window)
    return Compared(str(midnight - timedelta(days=2 * days - 1)), str((midnight - timedelta(days=days - 1)).date()))
