"""Generic relational operators (A-01 to A-35)."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NTH = "__nth"


def where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """A-01, A-02: equality on each column whose value is neither None nor blank."""
    for name, value in wanted.items():
        if value is not None and str(value).strip():
            df = df.filter(F.col(name) == value)
    return df


def in_lane(df: DataFrame, env: str | None, column: str = "env") -> DataFrame:
    """A-03: the lane asked for, or rows whose lane is unknown."""
    return df.filter(F.col(column).isin(env, "unknown")) if env else df


def touching(edges: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """A-10: edges with either end in ``ids``, as two equi-joins; an edge comes once for each distinct row."""
    keys = ids.select(F.col(column).alias("__id")).distinct()
    one = edges.join(keys, F.col("from_node") == F.col("__id"), "left_semi")
    two = edges.join(keys, F.col("to_node") == F.col("__id"), "left_semi")
    return one.union(two).distinct()


def parent_path(path: Column | str) -> Column:
    """A-11: the path without its last step; null at the top."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", ""))


def exists_in(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """A-13: a boolean column instead of a filter, so that several tests can be combined; nulls match nothing."""
    keys = other.select(*(F.col(c).alias(f"__{c}") for c in on)).distinct().withColumn("__there", F.lit(True))
    test = functools.reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{c}") for c in on))
    return df.join(keys, test, "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__there", *(f"__{c}" for c in on))


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A-16, A-17, A-19, A-35: the first row of each key in an order that should break all ties."""
    return df.withColumn(_NTH, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(_NTH) == 1).drop(_NTH)


def latest(df: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """A-16, A-17: the value at the latest time of each key, aggregated before the shuffle; ties take the largest value."""
    return df.groupBy(*keys).agg(F.max(F.struct(at, value)).alias("__m")).select(*keys, F.col(f"__m.{value}").alias(value), F.col(f"__m.{at}").alias(at))


def repeated(df: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """A-20: GROUP BY ... HAVING COUNT(*) >= least."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") >= least)


def ranked(column: str, order: Sequence[str]) -> Column:
    """A-24: the place of a value in ``order``; others last."""
    return functools.reduce(lambda rest, x: F.when(F.col(column) == x[1], x[0]).otherwise(rest), reversed(list(enumerate(order))), F.lit(len(order)))


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total: int
    limit: int
    offset: int

    @property
    def has_more(self) -> bool:
        return self.offset + self.limit < self.total


DEFAULT_LIMIT, MOST_LIMIT = 50, 200


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int | None = None) -> Page:
    """A-25: one page; limits over the most or under one, and negative offsets, are errors."""
    limit, offset = DEFAULT_LIMIT if limit is None else limit, offset or 0
    if not 1 <= limit <= MOST_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_LIMIT} and offset 0 or more")
    return Page(df.orderBy(*order).offset(offset).limit(limit), df.count(), limit, offset)


def _null_safe(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    return functools.reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def _one_each(new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first new row of each key; without an order, the smallest by its columns."""
    return distinct_on(new, keys, [*order, *(F.asc(c) for c in new.columns)])


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """A-30: new rows whose key is not there yet, of each key the first in ``order``; null keys are equal."""
    fresh = _one_each(new, keys, order)
    return table.unionByName(fresh.join(table, _null_safe(keys, fresh, table), "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """A-31: on a key that is there, only ``update`` columns take the new values, of each key's first new row in ``order``."""
    fresh = _one_each(new, keys, order)
    old, add = table.alias("o"), fresh.alias("n")
    test = functools.reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    both = old.withColumn("__o", F.lit(True)).alias("o").join(add.withColumn("__n", F.lit(True)).alias("n"), test, "full")

    def column(c: str) -> Column:
        first, second = ("n", "o") if c in update else ("o", "n")
        return F.when(F.col(f"__{first}").isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c)

    return both.select(*(column(c) for c in table.columns))


def replace_by_key(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-32: delete the rows of the new rows' keys, then insert."""
    gone = new.select(*keys).distinct()
    return table.join(gone, _null_safe(keys, table, gone), "left_anti").unionByName(new)


def update_where(table: DataFrame, test: Column, values: Mapping[str, Column]) -> DataFrame:
    """A-33."""
    return table.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_scoped(tables: Mapping[str, DataFrame], **scope: object) -> dict[str, DataFrame]:
    """A-34: the same scope deleted from every table that has all its columns; others stay whole."""
    out = {}
    for name, df in tables.items():
        if set(scope) <= set(df.columns):
            hit = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in scope.items()))
            df = df.filter(~hit)
        out[name] = df
    return out


def best_wins(df: DataFrame, keys: Sequence[str], by: str, then: Sequence[Column]) -> DataFrame:
    """A-35: the row of the highest value for each key; ``then`` breaks ties."""
    return distinct_on(df, keys, [F.desc_nulls_last(by), *then])
