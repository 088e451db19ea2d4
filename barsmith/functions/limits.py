"""Daily price limits by board, date and age of a listing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First day of the star board, the day chinext limits widened, sessions without a limit after a listing.
STAR_START = dt.date(2019, 7, 22)
CHINEXT_WIDENED = dt.date(2020, 8, 24)
FREE_SESSIONS = 5


def limit_ratio(board: Column, trade_date: Column, sessions: Column, is_st: Column | None = None) -> Column:
    """The largest move up or down from the last close; NULL where there is none or the board is unknown.

    sessions: trading days since listing, 0 on its first day, NULL if unknown (then nothing is waived).
    Warned stocks of the main board, and of chinext before it widened, are held to 5 % only where is_st is
    given: the flag is today's, not that of the day.
    """
    first = F.coalesce(sessions == 0, F.lit(False))
    new = F.coalesce(sessions.between(0, FREE_SESSIONS - 1), F.lit(False))
    narrow = F.lit(0.1) if is_st is None else F.when(F.coalesce(is_st, F.lit(False)), 0.05).otherwise(0.1)
    none = F.lit(None).cast("double")
    return (
        F.when(board == "star", F.when((trade_date < F.lit(STAR_START)) | new, none).otherwise(0.2))
        .when((board == "chinext") & (trade_date < F.lit(CHINEXT_WIDENED)), F.when(first, none).otherwise(narrow))
        .when(board == "chinext", F.when(new, none).otherwise(0.2))
        .when(board == "bse", F.when(first, none).otherwise(0.3))
        .when(board == "main", F.when(first, none).otherwise(narrow))
    )
