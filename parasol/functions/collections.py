"""Array and struct column helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_list(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds, in the given order."""
    items = [F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in pairs]
    return F.array_compact(F.array(*items))


def joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def any_contains(c: Column, needle: str) -> Column:
    return F.exists(c, lambda x: x.contains(needle))


def lookup(mapping: dict, key: Column, default) -> Column:
    """Value of ``key`` in a small fixed mapping, as a literal map."""
    entries = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))
