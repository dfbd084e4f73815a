"""Report parameters (D1): dates parsed on the driver, before any plan is built."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


def parse_date(value: str | dt.date) -> dt.date:
    """``YYYY-MM-DD`` (also ``2025-1-1``); a bad value raises ValueError."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(str(value), "%Y-%m-%d").date()


@dataclass(frozen=True)
class Period:
    start: dt.date
    end: dt.date

    @classmethod
    def of(cls, start, end) -> "Period":
        return cls(parse_date(start), parse_date(end))

    @property
    def label(self) -> str:
        """D3: ``YYYY.MM.DD-YYYY.MM.DD``."""
        return f"{self.start:%Y.%m.%d}-{self.end:%Y.%m.%d}"

    @property
    def compact(self) -> str:
        return f"{self.start:%Y%m%d}_{self.end:%Y%m%d}"


def as_period(value) -> Period:
    """A Period from a Period, a (start, end) pair, or one date (a one-day period)."""
    if isinstance(value, Period):
        return value
    if isinstance(value, (tuple, list)):
        return Period.of(*value)
    d = parse_date(value)
    return Period(d, d)
