"""Seeded orders, ranks and running totals that no single task has to hold.

Rows are ordered by a hash. Its first digits make slices, as many as the rows need; totals of slices are added up, and the
rest happens within a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 50_000


def seeded(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))


def slice_digits(rows: int) -> int:
    """Hexadecimal digits that make enough slices: 16 at least, about SLICE_ROWS rows in each."""
    digits = 1
    while 16**digits * SLICE_ROWS < rows:
        digits += 1
    return digits


def running_total(df: DataFrame, order: str, value: Column, name: str, rows: int, *ties: str) -> DataFrame:
    """df (of about so many rows) with the total of ``value`` over the rows before each row, in the order of a hash column and of the ties'."""
    cut = df.withColumn("_slice", F.substring(order, 1, slice_digits(rows))).withColumn("_value", value)
    sums = cut.groupBy("_slice").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))  # a row for each SLICE_ROWS
    within = Window.partitionBy("_slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_own", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(offsets, "_slice")
    return out.withColumn(name, F.col("_offset") + F.col("_own")).drop("_slice", "_value", "_own", "_offset")


def split_by_conversation(sizes: DataFrame, seed: str = "13", evaluation: float = 0.25, validation: float = 0.05) -> DataFrame:
    """(conv_id, n) with the split of each conversation: whole ones go to eval until it is full, then to val, the rest to train."""
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    order = sizes.withColumn("h", seeded(seed, "conv_id"))
    first = running_total(order, "h", F.col("n"), "before", rows, "conv_id")
    first = first.withColumn("held", F.col("before") < int(total * evaluation))
    rest = running_total(first.drop("before"), "h", F.when(F.col("held"), 0).otherwise(F.col("n")), "before", rows, "conv_id")
    split = F.when(F.col("held"), "eval").when(F.col("before") < int(total * validation), "val").otherwise("train")
    return rest.select("conv_id", "n", split.alias("split"))


def three_way(df: DataFrame, key: str, seed: str, train: float, val: float) -> DataFrame:
    """A proportional cut of a shuffled table into train, val and test; fractions are truncated, the remainder is test."""
    total = df.count()
    ranked = running_total(df.withColumn("h", seeded(seed, key)), "h", F.lit(1), "rank", total, *df.columns)
    a, b = int(total * train), int(total * val)
    return ranked.withColumn("split", F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "val").otherwise("test")).drop("h", "rank")
