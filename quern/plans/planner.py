"""Validation of a plan against a DataFrame, and the DataFrame that answers it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import errors
from quern.functions.expressions import as_kind, predicate
from quern.functions.types import Kind, kind_of
from quern.plans.logical import LogicalPlan, describe


@dataclass(frozen=True)
class Bound:
    """A validated plan: its input (columns k, v, f as needed) and what the strategies need to know."""

    plan: LogicalPlan
    rows: DataFrame
    condition: Column
    group_kind: Kind
    value_kind: Kind
    filter_kind: Kind

    @property
    def filtered(self) -> DataFrame:
        """Columns k and v of the rows that pass. The scan reads the named columns only; the condition reaches it."""
        return self.rows.where(self.condition).select(as_kind(F.col("k"), self.group_kind).alias("k"), as_kind(F.col("v"), self.value_kind).alias("v"))

    def named(self, out: DataFrame) -> DataFrame:
        """k and s under the result's names."""
        return out.select(F.col("k").alias(self.plan.group_column), F.col("s").alias(self.plan.output_name))


def _lookup(df: DataFrame, name: str) -> tuple[int, Kind | None, str]:
    """Position (names are case-sensitive here, whatever the session says), kind and Spark's name of the type."""
    names = df.columns
    if name not in names:
        raise errors.UnknownColumn(name, names)
    field = df.schema.fields[names.index(name)]
    kind = kind_of(field.dataType)
    return names.index(name), kind, kind.value if kind else field.dataType.simpleString()


def bind(df: DataFrame, plan: LogicalPlan) -> Bound:
    """Checks in this order: group column, filter column and literal, value column. Nothing runs."""
    group, group_kind, shown = _lookup(df, plan.group_column)
    if group_kind not in (Kind.INT64, Kind.UTF8):
        raise errors.group_type(plan.group_column, shown)
    test, filter_kind, shown = _lookup(df, plan.filter_column)
    if filter_kind is None or (filter_kind is Kind.UTF8) != isinstance(plan.literal, str):
        raise errors.compare_type(plan.filter_column, shown, describe(plan.literal))
    value, value_kind, shown = _lookup(df, plan.value_column)
    if value_kind not in (Kind.INT64, Kind.FLOAT64):
        raise errors.sum_type(plan.value_column, shown)
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    rows = numbered.select(*(F.col(f"c{i}").alias(name) for name, i in (("k", group), ("v", value), ("f", test))))
    return Bound(plan, rows, predicate(F.col("f"), filter_kind, plan.op, plan.literal), group_kind, value_kind, filter_kind)
