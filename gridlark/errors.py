"""Exceptions of the engine."""

from __future__ import annotations


class GridlarkError(Exception):
    """Base of all errors raised here."""


class SheetNotFound(GridlarkError, KeyError):
    pass


class InvalidAddress(GridlarkError, ValueError):
    pass


class RangeTooLarge(GridlarkError, ValueError):
    pass


class MalformedWorkbook(GridlarkError, ValueError):
    pass


class TooManyGroups(GridlarkError):
    pass


class QueryError(GridlarkError, ValueError):
    """A query that is well formed but can't be planned: unknown columns, clashing clauses."""


class QueryDslError(GridlarkError, ValueError):
    """Text that isn't a query; position is 0-based, -1 where none applies."""

    def __init__(self, message: str, position: int = -1):
        super().__init__(message)
        self.position = position
