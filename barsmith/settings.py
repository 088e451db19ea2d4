"""Run settings: JSON with comments, validated values, and the dates of an incremental run."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import re
from dataclasses import dataclass, field

MODES = ("backfill", "incremental", "repair")
DATASETS = ("kline_1d", "instrument_info", "trading_calendar", "corporate_actions", "finance_raw", "finance_daily")


def without_comments(text: str) -> str:
    """JSON text without // and /* */ comments; those within strings stay."""
    out, k, n = [], 0, len(text)
    while k < n:
        two = text[k : k + 2]
        if text[k] == '"':
            end = k + 1
            while end < n and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            out.append(text[k : end + 1])
            k = end + 1
        elif two == "//":
            stop = text.find("\n", k)
            k = n if stop < 0 else stop
        elif two == "/*":
            stop = text.find("*/", k + 2)
            if stop < 0:
                raise ValueError("a comment is not closed")
            k = stop + 2
        else:
            out.append(text[k])
            k += 1
    return "".join(out)


def day(text: str, name: str) -> dt.date:
    try:
        return dt.datetime.strptime(text, "%Y%m%d").date()
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a date as yyyymmdd") from None


@dataclass(frozen=True)
class RunSettings:
    """One landing run: its mode, dates, scope and sizes."""

    output_root: str = "landing"
    mode: str = "backfill"
    start_date: str | None = None
    end_date: str | None = None
    symbols: tuple[str, ...] = ()
    sector: str = ""
    expired_sectors: tuple[str, ...] = ()
    datasets: tuple[str, ...] = ("kline_1d", "instrument_info", "trading_calendar")
    batch_size: int = 300
    gap_retries: int = 3
    lag_days: int = 0
    lag_cutoff: str = "16:00"
    calendar_symbol: str = "000001.SH"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        for name in ("start_date", "end_date"):
            if getattr(self, name) is not None:
                day(getattr(self, name), name)
        if self.start_date and self.end_date and self.start_date > self.end_date:
            raise ValueError("start_date after end_date")
        if not (self.symbols or self.sector or self.expired_sectors):
            raise ValueError("give symbols, a sector or expired sectors")
        if wrong := set(self.datasets) - set(DATASETS):
            raise ValueError(f"unknown datasets: {sorted(wrong)}")
        if not self.datasets or self.batch_size < 1 or not 1 <= self.gap_retries <= 10 or self.lag_days < 0:
            raise ValueError("datasets, batch_size, gap_retries (1 to 10) or lag_days out of range")
        if "." not in self.calendar_symbol:
            raise ValueError("calendar_symbol needs its market's suffix")
        if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", self.lag_cutoff):
            raise ValueError("lag_cutoff is a time of 24 hours")

    @classmethod
    def parse(cls, text: str) -> RunSettings:
        """From JSON with comments; unknown names go to extra."""
        try:
            given = json.loads(without_comments(text))
        except json.JSONDecodeError as e:
            raise ValueError(f"not JSON: {e}") from e
        if not isinstance(given, dict):
            raise ValueError("settings are an object")
        names = {f.name for f in dataclasses.fields(cls)} - {"extra"}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names}
        return cls(**known, extra={k: v for k, v in given.items() if k not in names})

    def scope(self) -> dict:
        """What a partition's marker says it was landed for."""
        return {"symbols": sorted({s.strip().upper() for s in self.symbols}), "sector": self.sector, "expired_sectors": sorted(self.expired_sectors)}

    def dates(self, last_complete: str, now: dt.datetime) -> tuple[str, str] | None:
        """(start, end) of a run: an incremental one goes on after the last complete date, to lag_days before today (a day more before the cutoff);
        None if there is nothing to do."""
        lag = self.lag_days + (1 if now.time() < dt.time.fromisoformat(self.lag_cutoff) else 0)
        end = self.end_date or (now.date() - dt.timedelta(days=lag)).strftime("%Y%m%d")
        start = self.start_date
        if self.mode == "incremental" and last_complete:
            start = (day(last_complete, "last_complete") + dt.timedelta(days=1)).strftime("%Y%m%d")
        if start is None:
            raise ValueError("no start_date, and nothing has landed yet")
        return (start, end) if start <= end else None
