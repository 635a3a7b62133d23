"""Errors. All of them are raised when a query or a loader is built, before any result row is made."""

from __future__ import annotations

SHAPE = "SELECT col1, SUM(col2) FROM t WHERE col3 <op> literal GROUP BY col1, where <op> is =, < or >"


class QuernError(Exception):
    """Base of all errors of this package."""


class IoError(QuernError):
    """A file can't be read."""


class CsvError(QuernError):
    """A file is no regular CSV."""


class SqlSyntaxError(QuernError):
    """Text that is no SQL."""


class UnsupportedQuery(QuernError):
    """SQL outside the one supported shape; names the construct."""

    def __init__(self, what: str):
        self.what = what
        super().__init__(f"unsupported query: {what}\nsupported: {SHAPE}")


class DuplicateColumn(QuernError):
    def __init__(self, column: str):
        self.column = column
        super().__init__(f'duplicate column "{column}"')


class ColumnLengthMismatch(QuernError):
    def __init__(self, column: str, expected: int, found: int):
        self.column, self.expected, self.found = column, expected, found
        super().__init__(f'column "{column}" has {found} rows where {expected} are expected')


class ParseError(QuernError):
    """A CSV value that breaks an explicit schema. The header is line 1; blank lines don't count."""

    def __init__(self, column: str, line: int | None, value: str, expected: str):
        self.column, self.line, self.value, self.expected = column, line, value, expected
        at = f" (line {line})" if line is not None else ""
        super().__init__(f'"{value}" in column "{column}" is no {expected}{at}')


class UnknownColumn(QuernError):
    def __init__(self, column: str, available: list[str]):
        self.column, self.available = column, sorted(available)
        super().__init__(f'no column "{column}"; there are: {", ".join(self.available)}')


class QueryTypeError(QuernError):
    """Columns of types that a role in the query can't take."""


def group_type(column: str, kind: str) -> QueryTypeError:
    return QueryTypeError(f'cannot GROUP BY "{column}": it is {kind}; keys are Int64 or Utf8')


def sum_type(column: str, kind: str) -> QueryTypeError:
    return QueryTypeError(f'cannot SUM "{column}": it is {kind}; sums are over Int64 or Float64')


def compare_type(column: str, kind: str, literal: str) -> QueryTypeError:
    return QueryTypeError(f'cannot compare "{column}" ({kind}) with {literal}')
