"""Ordered scans (running sums, last value, previous row) that survive hot keys.

A plain window puts every row of a key into one task. Here the key's timeline
is cut into cells of fixed width. Each (key, cell) is scanned on its own, and
what earlier cells hand over - one row per non-empty cell, built with map-side
partial aggregation - is scanned separately and joined back. A key holding a
third of all rows is thereby spread over as many tasks as it has cells, and the
result is the same as that of the plain window. Rows without a key are kept;
they have no history, so what is added to them is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def cell_start(at, width: int) -> Column:
    """Start of the cell an instant (epoch microseconds) falls into."""
    at = F.col(at) if isinstance(at, str) else at
    return at - F.pmod(at, F.lit(width))


def _has_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def _carried(cells: DataFrame, keys: list[str], name: str, carried: Column) -> DataFrame:
    return cells.select(*keys, "_cell", carried.alias(name))


def prior_sum(df: DataFrame, keys: list[str], at: str, tie: str, value: str, out: str,
              width: int = HOUR) -> DataFrame:
    """Add ``out``: sum of ``value`` over rows strictly before by (at, tie), per key."""
    cells = df.withColumn("_cell", cell_start(at, width))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = _carried(
        cells.groupBy(*keys, "_cell").agg(F.sum(value).alias("_total")),
        keys, "_base", F.coalesce(F.sum("_total").over(before), F.lit(0)),
    )
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy(at, tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cells.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(base, [*keys, "_cell"], "left")
        .withColumn(out, F.when(_has_key(keys), F.col("_base") + F.col("_inside")))
        .drop("_cell", "_base", "_inside")
    )


def trailing_sum(df: DataFrame, keys: list[str], at: str, value: str, out: str, span: int,
                 include_edge: bool, width: int = HOUR, also: list[str] | None = None) -> DataFrame:
    """Sum of ``value`` over the trailing ``span`` microseconds, the row and its peers included.

    Every row enters the sum at its own instant and leaves it one span later, so
    the trailing sum is a running sum of signed entries. ``include_edge`` keeps a
    row exactly one span old. Returns keys, ``at``, ``also`` and ``out``.
    """
    also = also or []
    leave = span + 1 if include_edge else span
    entry = F.explode(
        F.array(
            F.struct(F.lit(True).alias("enters"), F.col(at).alias("instant"), F.col(value).alias("v")),
            F.struct(F.lit(False).alias("enters"), (F.col(at) + leave).alias("instant"), (-F.col(value)).alias("v")),
        )
    ).alias("_e")
    signed = df.select(*keys, *also, entry).select(*keys, *also, "_e.*")
    cells = signed.withColumn("_cell", cell_start("instant", width))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = _carried(
        cells.groupBy(*keys, "_cell").agg(F.sum("v").alias("_total")),
        keys, "_base", F.coalesce(F.sum("_total").over(before), F.lit(0)),
    )
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy("instant")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cells.withColumn("_inside", F.sum("v").over(inside))
        .where("enters")
        .join(base, [*keys, "_cell"], "left")
        .select(*keys, F.col("instant").alias(at), *also,
                F.when(_has_key(keys), F.col("_base") + F.col("_inside")).alias(out))
    )


def last_known(probes: DataFrame, facts: DataFrame, keys: list[str], probe_at: str, fact_at: str,
               fact_tie: str, fields: list[str], ttl: int | None = None, width: int = HOUR) -> DataFrame:
    """Add to each probe the latest fact of its key at or before it (as-of join).

    Adds ``fact_at`` (micros, as ``known_at``) and the ``fields``; all null when
    there is no fact, or when it is older than ``ttl`` microseconds.
    """
    payload = F.struct(F.col(fact_at).alias("at"), F.col(fact_tie).alias("tie"),
                       *[F.col(f).alias(f) for f in fields])
    fact_rows = facts.select(*keys, F.col(fact_at).alias("_at"), payload.alias("_fact"))
    return _carry_last(probes, fact_rows, keys, probe_at, fields, ttl, width)


def _carry_last(probes, fact_rows, keys, probe_at, fields, ttl, width):
    kept = [c for c in probes.columns if c not in keys]
    rows = probes.select(*keys, F.col(probe_at).alias("_at"), F.struct(*kept).alias("_probe"))
    both = rows.unionByName(fact_rows, allowMissingColumns=True).withColumn("_cell", cell_start("_at", width))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = _carried(
        both.groupBy(*keys, "_cell").agg(F.max("_fact").alias("_newest")),
        keys, "_base", F.last("_newest", ignorenulls=True).over(before),
    )
    # Facts sort before probes of the same instant, so an equal instant counts.
    inside = (
        Window.partitionBy(*keys, "_cell")
        .orderBy("_at", F.col("_probe").isNotNull(), F.col("_fact.tie"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        both.withColumn("_inside", F.last("_fact", ignorenulls=True).over(inside))
        .where(F.col("_probe").isNotNull())
        .join(base, [*keys, "_cell"], "left")
        .withColumn("_known", F.when(_has_key(keys), F.coalesce("_inside", "_base")))
    )
    fresh = F.col("_known").isNotNull()
    if ttl is not None:
        fresh = fresh & (F.col("_at") - F.col("_known.at") < F.lit(ttl))
    return found.select(
        *keys, "_probe.*",
        F.when(fresh, F.col("_known.at")).alias("known_at"),
        *[F.when(fresh, F.col(f"_known.{f}")).alias(f) for f in fields],
    )


def with_previous(df: DataFrame, keys: list[str], at: str, tie: str, fields: list[str],
                  width: int = HOUR) -> DataFrame:
    """Add ``prev_<field>`` from the row before, by (at, tie) within the key."""
    row = F.struct(F.col(at).alias("_at"), F.col(tie).alias("_tie"), *[F.col(f).alias(f) for f in fields])
    cells = df.withColumn("_cell", cell_start(at, width))
    across = Window.partitionBy(*keys).orderBy("_cell")
    base = _carried(
        cells.groupBy(*keys, "_cell").agg(F.max(row).alias("_newest")),
        keys, "_base", F.lag("_newest").over(across),
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(at, tie)
    return (
        cells.withColumn("_prev", F.lag(row).over(inside))
        .join(base, [*keys, "_cell"], "left")
        .withColumn("_prev", F.when(_has_key(keys), F.coalesce("_prev", "_base")))
        .select(*df.columns, *[F.col(f"_prev.{f}").alias(f"prev_{f}") for f in fields])
    )


def first_seen(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Add ``is_first``: whether the row is the earliest of its key combination."""
    earliest = df.groupBy(*keys).agg(F.min(F.struct(F.col(at), F.col(tie))).alias("_first"))
    return (
        df.join(earliest, keys, "left")
        .withColumn("is_first", F.coalesce(F.col("_first") == F.struct(F.col(at), F.col(tie)), F.lit(False)))
        .drop("_first")
    )
