"""The documented bounded samples that classifiers are fitted on: exact, by a hash of id and text, with copies counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_of(id_col: Column, text: Column, seed: str) -> Column:
    """What a row is drawn by: a hash of seed, id and text, so that neither equal ids nor missing ones bind rows together."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))


def chosen(keys: DataFrame, bound: int, bound_chars: int) -> tuple[DataFrame, dict]:
    """The rows (kind, key) that are drawn: of each kind the first by key, at most bound of them and of bound_chars characters in
    all, and the number of different rows of each kind.

    keys: kind, key and chars of every row; kinds are few. Rows alike meet in one before anything else, so a row that stands a
    million times is one candidate; then all but a few more than bound rows of a kind go by their keys' size alone.
    """
    different = keys.groupBy("kind", "key").agg(F.max("chars").alias("chars"))
    counts = different.groupBy("kind").agg(F.count("*").alias("d"))
    u = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = different.join(F.broadcast(counts.withColumnRenamed("kind", "k")), F.col("kind") == F.col("k")).filter(u * F.col("d") < bound + 8 * bound**0.5 + 32)
    upto = Window.partitionBy("kind").orderBy("key")
    near = near.withColumn("place", F.row_number().over(upto)).withColumn("upto", F.sum("chars").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = near.filter((F.col("place") <= bound) & ((F.col("place") == 1) | (F.col("upto") <= bound_chars))).select("kind", "key")
    return rows, {r["kind"]: r["d"] for r in counts.collect()}


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int, bound_chars: int, seed: str, others: tuple[str, ...] = ()) -> tuple[DataFrame, dict[int, int]]:
    """text, the other columns asked for, label and key of at most bound labelled documents of each class (0, 1), and how many
    different ones each class has.

    Only ids and keys meet the labels; texts are then picked out by a broadcast of the at most 2 * bound keys drawn.
    """
    tagged = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("kind")).distinct()
    rows = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in others])
    rows = rows.withColumn("key", key_of(F.col("doc_id"), F.col("text"), seed))
    keys, counts = chosen(rows.select("doc_id", "key", F.length("text").alias("chars")).distinct().join(tagged, "doc_id"), bound, bound_chars)
    got = rows.join(F.broadcast(keys), "key").groupBy("key", "kind").agg(*[F.first(c).alias(c) for c in ("text", *others)])
    return got.withColumnRenamed("kind", "label"), counts
