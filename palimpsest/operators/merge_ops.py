"""Merge operators: associative folds of a key's operands over its base value, as aggregate expressions.

Sums, counts, extremes, first, last, versioned maximum and set union are built-in aggregates with a partial step. Ordered
folds gather the operands of a key and sort them by sequence number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce as _fold
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operands that a Python fold combines at a time.
BATCH = 100


@dataclass(frozen=True)
class MergeOperator:
    """agg(value, order, key) aggregates the values of one key, oldest to newest; null values (tombstones) are ignored.

    Its results are values that it takes again, as flush and compaction fold part of a key's versions. Where a plain value is
    not yet one (a count's is 1, a list's holds one element), enter makes it one, once, before it is written.
    """

    name: str
    agg: Callable[[Column, Column, Column], Column]
    decomposable: bool = True
    enter: Callable[[Column], Column] | None = None

    def entered(self, log: DataFrame) -> DataFrame:
        """A log or a batch of plain values as one of the operator's values."""
        return log if self.enter is None else log.withColumn("value", F.when(F.col("value").isNotNull(), self.enter(F.col("value"))))


def _some(value: Column, order: Column) -> Column:
    return F.when(value.isNotNull(), order)


def in_order(value: Column, order: Column) -> Column:
    """The values as an array, oldest first."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


SUM = MergeOperator("sum", lambda v, o, k: F.sum(v))
COUNT = MergeOperator("count", lambda v, o, k: F.sum(v), enter=lambda v: F.lit(1).cast("long"))
MIN = MergeOperator("min", lambda v, o, k: F.min(v))
MAX = MergeOperator("max", lambda v, o, k: F.max(v))
FIRST = MergeOperator("first", lambda v, o, k: F.min_by(v, _some(v, o)))
LAST = MergeOperator("last", lambda v, o, k: F.max_by(v, _some(v, o)))
BALANCE = MergeOperator("balance", lambda v, o, k: F.sum(v))
SET_UNION = MergeOperator("set_union", lambda v, o, k: F.array_sort(F.array_distinct(F.flatten(F.collect_set(v)))), enter=F.array)


def concat(separator: str = "") -> MergeOperator:
    return MergeOperator("concat", lambda v, o, k: F.array_join(in_order(v.cast("string"), o), separator), decomposable=False)


APPEND = MergeOperator("append_list", lambda v, o, k: F.flatten(in_order(v, o)), decomposable=False, enter=F.array)


def max_by_version(version: Callable[[Column], Column]) -> MergeOperator:
    """The value of the greatest version; equal versions go to the newer row."""
    return MergeOperator("max_by_version", lambda v, o, k: F.max_by(v, F.when(v.isNotNull(), F.struct(version(v), o))))


def routed(routes: list[tuple[Callable[[Column], Column], MergeOperator]], default: MergeOperator | None = None) -> MergeOperator:
    """Another operator by key. Keys without an operator fail on their first operand."""

    def agg(v: Column, o: Column, k: Column) -> Column:
        out: Column | None = None
        for test, op in routes:
            out = F.when(F.first(test(k)), op.agg(v, o, k)) if out is None else out.when(F.first(test(k)), op.agg(v, o, k))
        last = default.agg(v, o, k) if default else F.raise_error(F.lit("no merge operator for this key"))
        return last if out is None else out.otherwise(last)

    return MergeOperator("routed", agg, all(op.decomposable for _, op in routes))


def custom(merge: Callable[[Any, Any], Any], returns: T.DataType, name: str = "custom") -> MergeOperator:
    """A Python function of (existing, operand), folded oldest to newest in batches."""

    @F.pandas_udf(returns)
    def fold(values: pd.Series) -> pd.Series:
        def one(ops: Any) -> Any:
            items = list(ops)
            while len(items) > 1:
                items = [_fold(merge, items[i : i + BATCH]) for i in range(0, len(items), BATCH)]
            return items[0] if items else None

        return values.map(one, na_action="ignore")

    return MergeOperator(name, lambda v, o, k: fold(in_order(v, o)), decomposable=False)


REGISTRY: dict[str, MergeOperator] = {op.name: op for op in (SUM, COUNT, MIN, MAX, FIRST, LAST, BALANCE, SET_UNION, APPEND, concat())}
