"""The plan of the one query shape."""

from __future__ import annotations

from dataclasses import dataclass

Literal = int | float | str


@dataclass(frozen=True)
class LogicalPlan:
    """SELECT group_column, SUM(value_column) FROM table WHERE filter_column op literal GROUP BY group_column."""

    table: str
    group_column: str
    value_column: str
    filter_column: str
    op: str
    literal: Literal

    @property
    def output_name(self) -> str:
        return f"SUM({self.value_column})"

    @property
    def columns(self) -> list[str]:
        """What the scan reads: each column once."""
        return list(dict.fromkeys((self.group_column, self.value_column, self.filter_column)))


def describe(literal: Literal) -> str:
    kind = "integer" if isinstance(literal, int) else "float" if isinstance(literal, float) else "string"
    return f'the {kind} "{literal}"' if kind == "string" else f"the {kind} {literal}"
