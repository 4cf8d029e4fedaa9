"""Joins, aggregates, sorts and limits over DataFrames, with the warehouse's naming and NULL rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.outcomes import ValidationError

AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
#: Names of the tokens that group keys take in compat mode.
NULL_KEY = "<NULL>"


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], right_name: str = "right", how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equality join on pairs of column names; a right column whose name is taken becomes <right_name>_<column>.

    With `null_safe` NULL keys meet each other. Catalyst and adaptive execution pick the strategy.
    """
    if not on:
        raise ValidationError("VALIDATION_UNSUPPORTED_QUERY_SHAPE", "a join needs at least one pair of keys")
    taken = {c.lower() for c in left.columns}
    names = [f"{right_name}_{c}" if c.lower() in taken else c for c in right.columns]
    hidden = {c: f"__right_{i}" for i, c in enumerate(right.columns)}
    moved = right.toDF(*hidden.values())
    condition: Column | None = None
    for a, b in on:
        x, y = left[a], moved[hidden[b]]
        pair = x.eqNullSafe(y) if null_safe else x == y
        condition = pair if condition is None else condition & pair
    both = left.join(moved, condition, how)
    if how in ("left_semi", "left_anti"):
        return both
    return both.select(*[left[c] for c in left.columns], *[moved[h].alias(n) for h, n in zip(hidden.values(), names, strict=True)])


def default_name(function: str, column: str) -> str:
    """count for COUNT(*), else <function>_<column>."""
    return function if column == "*" else f"{function}_{column.split('.')[-1]}"


def aggregate(df: DataFrame, keys: list[str], aggs: list[tuple[str, str] | tuple[str, str, str]], compat: bool = False) -> DataFrame:
    """Group by `keys` (none: one group) with (function, column[, alias]) aggregates; column "*" counts rows.

    `compat`: sums and averages as doubles with 0.0 for a group without values, text keys with
    <NULL>, and no row for an empty global aggregate.
    """
    out = []
    for function, column, *alias in aggs:
        f = function.lower()
        if f not in AGGREGATES or (column == "*" and f != "count"):
            raise ValidationError("VALIDATION_UNSUPPORTED_OPERATOR", f"{function}({column})")
        value = F.count(F.lit(1)) if column == "*" else AGGREGATES[f](F.col(column).cast("double") if compat and f != "count" else F.col(column))
        if compat and f == "sum":
            value = F.coalesce(value, F.lit(0.0))
        out.append(value.alias(alias[0] if alias else default_name(f, column)))
    if not keys:
        done = df.agg(*out) if out else df.limit(0)
        return done if not compat else df.groupBy(F.lit(1).alias("__one")).agg(*out).drop("__one")
    grouped = [F.coalesce(F.col(k).cast("string"), F.lit(NULL_KEY)).alias(k) if compat else F.col(k) for k in keys]
    return df.groupBy(*grouped).agg(*out) if out else df.select(*grouped).distinct()


def ordering(key: str | tuple[str, str]) -> Column:
    """A sort key; NULLs come last in either direction."""
    column, direction = (key, "asc") if isinstance(key, str) else key
    return F.col(column).desc_nulls_last() if direction.lower() == "desc" else F.col(column).asc_nulls_last()


def sort(df: DataFrame, *keys: str | tuple[str, str]) -> DataFrame:
    return df.orderBy(*map(ordering, keys))


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """Skip `offset` rows, then take `count`; after a sort this is a top-k, not a full sort."""
    if count < 0 or offset < 0:
        raise ValidationError("VALIDATION_UNSUPPORTED_QUERY_SHAPE", "limit and offset must not be negative")
    return df.offset(offset).limit(count) if offset else df.limit(count)
