"""Null-safe numbers and the market's code, date and flag normalisers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for an open-ended lifecycle date.
DATE_SENTINELS = ["", "nan", "none", "nat", "null", "0", "99999999", "19700101", "19700102", "19700103", "19700104", "19700105", "19700106",
    "19700427", "19700428"]
#: First digits of the codes of each board, tried in this order.
BOARD_PREFIXES = {
    "star": ["688", "689"],
    "chinext": ["300", "301"],
    "bse": ["430", "920", "83", "87", "88"],
    "main": ["600", "601", "603", "605", "000", "001", "002", "003"],
}


def finite(c: Column) -> Column:
    """c, or NULL where it is NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or the quotient is not finite."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def normalize_security_code(c: Column) -> Column:
    """Trimmed upper case; six bare digits get .SH (5, 6, 9 first) or .SZ (0 to 3)."""
    code = F.upper(F.trim(c))
    bare = code.rlike("^[0-9]{6}$")
    return F.when(bare & code.rlike("^[569]"), F.concat(code, F.lit(".SH"))).when(bare & code.rlike("^[0-3]"), F.concat(code, F.lit(".SZ"))).otherwise(code)


def classify_board(c: Column) -> Column:
    """The board of a code by the first digits of what stands before its suffix; unknown unless that is digits only."""
    number = F.split(c, r"\.")[0]
    out = F.lit("unknown")
    for board, prefixes in reversed(BOARD_PREFIXES.items()):
        starts = number.startswith(prefixes[0])
        for p in prefixes[1:]:
            starts |= number.startswith(p)
        out = F.when(starts, board).otherwise(out)
    return F.when(number.rlike("^[0-9]+$"), out).otherwise("unknown")


def is_risk_warned(name: Column) -> Column:
    n = F.upper(F.trim(name))
    return F.coalesce((n.contains("ST") | n.contains("退")) & ~n.isin("NAN", "NONE"), F.lit(False))


def is_date_sentinel(c: Column) -> Column:
    """Whether a text stands for no date: itself, or the first eight of its digits if it has so many. NULL is one."""
    text = F.lower(F.trim(c.cast("string")))
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.coalesce(text.isin(DATE_SENTINELS) | ((F.length(digits) >= 8) & F.substring(digits, 1, 8).isin(DATE_SENTINELS)), F.lit(True))


def normalize_lifecycle_date(c: Column) -> Column:
    """A date from the first eight digits of a text; sentinels and unparsable texts are NULL."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.when(~is_date_sentinel(c) & (F.length(digits) >= 8), F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))


def normalize_date(c: Column) -> Column:
    """First eight digits of 19.../20... texts, else an epoch in seconds, or in milliseconds above 1e11, as yyyyMMdd."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    number = c.cast("string").try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    return F.when(digits.rlike("^(19|20)[0-9]{6}"), F.substring(digits, 1, 8)).when(number > 0, F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd"))


def finite_number(c: Column) -> Column:
    number = finite(c.cast("string").try_cast("double"))
    return F.when(F.abs(number) <= 1e100, number)


def optional_bool(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("1", "1.0", "true", "yes", "t"), True).when(text.isin("0", "0.0", "false", "no", "f"), False)
