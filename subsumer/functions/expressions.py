"""Column expressions: null handling, keys, violation caps and degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DiscoveryConfig, Duplicates, Nulls


def normalized(cell: Column, config: DiscoveryConfig) -> Column:
    """A cell as text; the null string and null are one, on the side that the null mode wants."""
    text, null = cell.cast("string"), F.lit(config.null_string)
    return F.coalesce(text, null) if config.nulls is Nulls.EQUALITY else F.nullif(text, null)


def key_of(cells: Column, columns: Column) -> Column:
    """The cells at some columns as an array; null if any of them is."""
    key = F.transform(columns, lambda c: F.get(cells, c))
    return F.when(~F.exists(key, lambda v: v.isNull()), key)


def size_of(rows: Column, distinct: Column, config: DiscoveryConfig) -> Column:
    return rows if config.duplicates is Duplicates.AWARE else distinct


def cap_of(size: Column, threshold: float) -> Column:
    """Violations that the threshold allows: a double, truncated."""
    return ((F.lit(1.0) - F.lit(float(threshold))) * size).cast("long")


def partial_degree(violations: Column, cap: Column, threshold: float) -> Column:
    """1 without violations, the threshold where the cap is reached, linear between."""
    return F.when(cap > 0, 1 - violations / cap + F.lit(float(threshold)) * violations / cap).otherwise(F.lit(1.0))


def exact_degree(violations: Column, size: Column) -> Column:
    return F.when(size > 0, 1 - violations / size).otherwise(F.lit(1.0))


def column_list(columns: Column, names: Column, relation: Column) -> Column:
    """"relation.name" for each column, joined by commas."""
    return F.concat_ws(",", F.transform(columns, lambda c: F.concat(relation, F.lit("."), F.get(names, c))))
