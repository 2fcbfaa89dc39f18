"""Applying changes to tables: upserts, keyed updates, toggles and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``.

    An aggregate, so a hot key is reduced before the shuffle; ``order`` must
    identify a row within its key.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def earliest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    oldest = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(oldest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None,
           matched: list[str] | None = None, filled: list[str] = (), newer: str | None = None) -> DataFrame:
    """``base`` with the latest change per key applied; unknown keys are added.

    A change row replaces the columns it carries, or of a known key only those
    in ``matched`` if given. Columns in ``filled`` it replaces unless its own value is
    null. With ``newer`` a change older by that column than the known row only fills in
    what is null there. Columns it lacks keep their base value.
    """
    if order:
        changes = latest_per_key(changes, keys, order)
    set_cols = [c for c in changes.columns if c not in keys and c in base.columns]
    new = changes.select(*keys, F.struct(*set_cols).alias("_new"))
    merged = base.withColumn("_known", F.lit(True)).join(new, keys, "full_outer")
    hit = F.col("_new").isNotNull()
    added = F.col("_known").isNull()
    fresh = F.lit(True) if newer is None else added | F.coalesce(F.col(f"_new.{newer}") >= F.col(newer), F.lit(True))

    def merged_value(c: str) -> Column:
        new, old = F.col(f"_new.{c}"), F.col(c)
        if c in filled:
            return F.when(fresh, F.coalesce(new, old)).otherwise(F.coalesce(old, new)).alias(c)
        return F.when((hit & fresh) if matched is None or c in matched else added, new).otherwise(old).alias(c)

    return merged.select(*[merged_value(c) if c in set_cols else c for c in base.columns])


def update_where(base: DataFrame, keyed: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """Set columns on the rows whose key is in ``keyed`` (unique per key).

    ``changes`` may refer to ``new.<column>`` of the change row.
    """
    fields = [c for c in keyed.columns if c not in keys]
    marked = keyed.select(*keys, F.struct(F.lit(True).alias("hit"), *fields).alias("new"))
    joined = base.join(marked, keys, "left")
    hit = F.col("new").isNotNull()
    return joined.select(
        *[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else c for c in base.columns]
    )


def toggled(flag: Column, presses: Column) -> Column:
    """State of a boolean after an odd or even number of toggles."""
    odd = F.pmod(F.coalesce(presses, F.lit(0)), F.lit(2)) == 1
    return flag != odd
