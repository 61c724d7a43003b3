"""Matrices as text: white space between numbers, points or commas as decimal marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(x) of every line that is not blank."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(numbers(F.col("value")).alias("x"))


def numbers(line: Column) -> Column:
    """The numbers of a line, decimal commas taken as points."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(line, ",", "."), r"\s+", " ")), " ").cast("array<double>")


def read_matrices(spark: SparkSession, paths: list[str], skip: tuple[int, ...] = ()) -> DataFrame:
    """(file, x) of several matrices; ``file`` counts from 1 in the order of the paths, those in ``skip`` are not read."""
    parts = [read_matrix(spark, path).select(F.lit(i).alias("file"), "x") for i, path in enumerate(paths, 1) if i not in skip]
    if not parts:
        return spark.createDataFrame([], "file int, x array<double>")
    return reduce(DataFrame.unionByName, parts)


def write_matrix(rows: DataFrame, path: str, digits: int = 9, between: tuple[int, int] | None = None, order: str = "t") -> None:
    """``x`` of each row as one line; refuses to overwrite. ``between``: only rows whose ``order`` lies in it, both ends included."""
    if between is not None:
        rows = rows.where(F.col(order).between(*between))
    write_lines(rows.select(F.concat_ws(" ", F.transform("x", lambda v: F.round(v, digits).cast("string"))).alias("value")), path)


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """A string column, one string a line; a null is an empty line. Refuses to overwrite."""
    rows.select(F.coalesce(column, F.lit("")).alias("value")).write.mode("error").option("lineSep", "\r\n").text(path)


def write_vector(rows: DataFrame, path: str, column: str = "value") -> None:
    """A column, one value a line without any white space; refuses to overwrite."""
    write_lines(rows.select(F.regexp_replace(F.col(column).cast("string"), r"\s", "").alias("value")), path)
