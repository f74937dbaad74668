"""Cell addresses and ranges in A1 notation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import InvalidAddress

#: Limits of the sheet formats.
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
MAX_CELLS = 100_000_000

_CELL = re.compile(r"([A-Za-z]{1,3})([0-9]{1,7})")


def letters(column: int) -> str:
    """1 is A, 27 is AA: base 26 without a zero."""
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_number(text: str) -> int:
    number = 0
    for c in text.upper():
        if not "A" <= c <= "Z":
            raise InvalidAddress(f"Not a column: {text!r}")
        number = number * 26 + ord(c) - 64
    if not 1 <= number <= MAX_COLUMNS:
        raise InvalidAddress(f"Not a column: {text!r}")
    return number


def parse_cell(text: str) -> tuple[int, int]:
    """(column, row) of A1."""
    found = _CELL.fullmatch(text.strip())
    if not found or not 1 <= (row := int(found[2])) <= MAX_ROWS:
        raise InvalidAddress(f"Not a cell address: {text!r}")
    return column_number(found[1]), row


@dataclass(frozen=True)
class Range:
    left: int = 1
    top: int = 1
    right: int = MAX_COLUMNS
    bottom: int = MAX_ROWS

    @classmethod
    def of(cls, a: tuple[int, int], b: tuple[int, int]) -> Range:
        """Of two corners in any order."""
        return cls(min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1]))

    @property
    def width(self) -> int:
        return self.right - self.left + 1

    @property
    def height(self) -> int:
        return self.bottom - self.top + 1

    @property
    def unbounded(self) -> bool:
        return self.right == MAX_COLUMNS or self.bottom == MAX_ROWS

    def contains(self, column: int, row: int) -> bool:
        return self.left <= column <= self.right and self.top <= row <= self.bottom

    def overlaps(self, other: Range) -> bool:
        return self.left <= other.right and other.left <= self.right and self.top <= other.bottom and other.top <= self.bottom

    def __str__(self) -> str:
        start, end = f"{letters(self.left)}{self.top}", f"{letters(self.right)}{self.bottom}"
        return start if start == end else f"{start}:{end}"


def parse_range(text: str) -> Range:
    """A1, A1:C5, A:C, 1:10 or ':'; corners must be in order."""
    text = text.strip()
    if text == ":":
        return Range()
    first, colon, last = text.partition(":")
    if not colon:
        at = parse_cell(text)
        return Range.of(at, at)
    try:
        if first.isdigit() and last.isdigit():
            out = Range(top=int(first), bottom=int(last))
        elif first.isalpha() and last.isalpha():
            out = Range(left=column_number(first), right=column_number(last))
        else:
            (left, top), (right, bottom) = parse_cell(first), parse_cell(last)
            out = Range(left, top, right, bottom)
    except InvalidAddress:
        raise InvalidAddress(f"Not a range: {text!r}") from None
    if not (1 <= out.left <= out.right and 1 <= out.top <= out.bottom <= MAX_ROWS):
        raise InvalidAddress(f"Not a range: {text!r}")
    return out
