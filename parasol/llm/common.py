"""Helpers the operators of this folder share: tables, ASCII case, row keys, row filters."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


ROW_KEY = ["row_key_1__", "row_key_2__"]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """A 96-bit key of a row's id and raw text, so that decisions find their row without moving texts.

    Rows with equal keys repeat one another. A null id or text hashes as absent.
    """
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias(ROW_KEY[0]),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias(ROW_KEY[1])]


def by_place(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by their places, so that an operator's own names stay free, and the new
    names of ``columns``. ``toDF(*docs.columns)`` gives the old names back."""
    names = [f"c{i}__" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in columns]


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``keys`` (ROW_KEY columns, unique), each repeated row once.

    One shuffle carries the texts: the window needs the partitioning and order the join leaves.
    """
    rows, of = by_place(docs, id_col, text_col)
    marked = rows.select("*", *row_key(*of)).join(keys.select(*ROW_KEY), ROW_KEY)
    nth = F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy(*ROW_KEY))
    return marked.withColumn("row_nth__", nth).where("row_nth__ = 1").select(*rows.columns).toDF(*docs.columns)


def ship_by_value(module_name: str) -> None:
    """Lets tasks run a module's functions on executors that do not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
