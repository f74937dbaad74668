"""Date systems and number formats of workbooks."""

from __future__ import annotations

import datetime as dt
import functools
import re

#: Built-in formats that show a date, a time or both.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_LAST = dt.datetime(9999, 12, 31, 23, 59, 59, 999999)


def to_date(serial: float, date1904: bool = False) -> dt.datetime | None:
    """The date of a serial number; None for negative ones, the 29th of February 1900 and those past year 9999."""
    if not 0 <= serial < 3_000_000:
        return None
    if date1904:
        start = dt.datetime(1904, 1, 1)
    elif serial < 1:
        start = dt.datetime(1, 1, 1)
    elif serial < 60:
        start = dt.datetime(1899, 12, 31)
    elif serial < 61:
        return None
    else:
        start = dt.datetime(1899, 12, 30)
    try:
        found = start + dt.timedelta(milliseconds=round(serial * 86_400_000))
    except OverflowError:
        return None
    return found if found <= _LAST else None


_MASK = re.compile(r'"[^"]*"?|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]?', re.I)


@functools.cache
def is_date_format(code: str) -> bool:
    """Whether the first section of a custom format has a part of a date or time outside literals."""
    first, quoted = [], False
    for c in code:
        if c == '"':
            quoted = not quoted
        if c == ";" and not quoted:
            break
        first.append(c)
    bare = _MASK.sub("", "".join(first)).lower()
    bare = re.sub(r"\[(h+|m+|s+)\]", r"\1", bare)
    if bare.strip() in ("general", "@", ""):
        return False
    bare = re.sub(r"am/pm|a/p", "h", bare)
    bare = re.sub(r"[0#?.]+e[+-]?[0#?]+", "0", bare)  # exponents of numbers
    return bool(re.search(r"[ymdhs]|e(?![+-])", bare.replace("general", "")))


def is_date_id(number_format: int, custom: dict[int, str]) -> bool:
    if number_format in custom:
        return is_date_format(custom[number_format])
    return number_format in DATE_FORMATS
