"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in an order by a hash of their ids and texts, again and again for up to ``repeats`` rounds. A copy's
virtual finish time is the words its source has sent up to and with it, divided by the source's target. All copies are
taken in order of that time until the budget is reached.

Sources weigh 1, 2, 3, 1, 2, 3, ... in order of code point, null last, and share the words of all documents; no target
exceeds ``repeats`` times the source's words, and what that leaves over goes to the others by weight.

Defined results: a null text has no words and takes none; so does a text of white space; a null source is a source of its
own; documents with equal ids are told apart by their texts, and rows alike in both get their places in any order; a null id
counts as the empty text; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disfluo.llm.common import WORD, Block, block_of, blocks_of, fresh, read, stable, text_blocks, unpacked


ORDER = ("order", "doc_id", "size", "row")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with the shuffling hash in place of their text's digest: the md5 of both the id as text and the digest, so that neither a
    repeated id nor a missing one puts its documents in one slice."""
    return rows.withColumn("order", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")).cast("binary"))).drop("digest")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the shuffling hash, and row, which tells apart rows that are packed in blocks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return _ordered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.lit(0).cast("long").alias("row"), F.md5(text.cast("binary")).alias("digest")))


def targets(totals: DataFrame, repeats: int = 3) -> DataFrame:
    """source, source_size, n, target by water-filling: sources are capped in order of repeats * size / weight until the rest fit.

    One row for each source (a mixture's table of weights), so the windows over all of it are small.
    """
    alone = Window.orderBy(F.col("source").isNull(), "source")
    t = totals.withColumn("weight", (1 + F.pmod(F.row_number().over(alone) - 1, F.lit(3))).cast("double")).withColumn("most", (repeats * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    ratio = F.col("most") / F.col("weight")
    at = t.filter(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min_by("level", F.struct(ratio, F.col("source").isNull(), F.col("source"))).alias("water"))
    return t.crossJoin(F.broadcast(at)).select("source", "source_size", "n", F.least(F.col("water") * F.col("weight"), F.col("most")).alias("target"))


def finish(offset: Column, cum: Column, turn: Column, total: Column, target: Column) -> Column:
    return (turn * total + offset + cum) / target


def _with_source(rows: DataFrame, table: DataFrame, sources: int, few: int = 10_000, salts: int = 64) -> DataFrame:
    """rows with their source's line of a table. A table of few sources is broadcast; else both sides meet by source and a
    salt, so that no source's rows meet in one task."""
    named = table.withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    if sources <= few:
        return rows.join(F.broadcast(named), same).drop("s")
    salted = named.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*ORDER), F.lit(salts)).cast("int")).join(salted, same & (F.col("salt") == F.col("t"))).drop("s", "t", "salt")


def _cut(copies: DataFrame, budget: int, few: int, bins: int) -> tuple[Row, bool] | None:
    """Where the queue ends: a copy's key (v, order, doc_id, size, row, turn), and whether that copy is still taken; None if all are.

    The finish times' range is cut into bins, and the bin in which the budget ends into bins again, until it holds few
    copies; among copies of one time the hash's range is cut likewise. Only totals of bins come to the driver, and only the
    last few copies are put in order at once.
    """
    filled = 0
    number = F.conv(F.substring("order", 1, 12), 16, 10).cast("double")
    for value in (F.col("v"), number):
        bounds = copies.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
        low, high = bounds["a"], bounds["b"]
        if low is None:
            return None
        while True:
            within = copies.filter(value.between(low, high))
            at = F.least(F.floor((value - low) / max(high - low, 1e-300) * bins), F.lit(bins - 1)).alias("bin")
            totals = within.groupBy(at).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min(value).alias("a"), F.max(value).alias("b")).collect()  # at most ``bins`` rows
            ends = None
            for r in sorted(totals, key=lambda r: r["bin"]):
                if filled + r["words"] > budget:
                    ends = r
                    break
                filled += r["words"]
            if ends is None:
                return None
            low, high = ends["a"], ends["b"]
            if ends["rows"] <= few or low == high:
                break
        copies = copies.filter(value.between(low, high))
        if ends["rows"] <= few:
            break
    key = F.struct("v", *ORDER, "turn")
    running = F.sum("size").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = copies.withColumn("running", running).agg(F.max(F.when(F.col("running") <= budget - filled, key)).alias("last"), F.min(key).alias("first")).first()
    return (ends["last"], True) if ends["last"] is not None else (ends["first"], False)


def _goes(v: Column, turn: float, cut: tuple[Row, bool] | None) -> Column:
    if cut is None:
        return F.lit(True)
    at, taken = cut
    mine = F.struct(v.alias("v"), *ORDER, F.lit(turn).alias("turn"))
    end = F.struct(F.lit(at["v"]).alias("v"), F.lit(at["order"]).alias("order"), *[F.lit(at[c]).cast("long").alias(c) for c in ORDER[1:]], F.lit(at["turn"]).alias("turn"))
    return mine <= end if taken else mine < end


def mix(docs: DataFrame, repeats: int = 3, few: int = 10_000, bins: int = 4096, slice_rows: int = 2000) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times the copies that the mix takes)."""
    return mix_sizes(sizes(docs), repeats, few, bins, slice_rows).drop("row")


def mix_sizes(sized: DataFrame, repeats: int = 3, few: int = 10_000, bins: int = 4096, slice_rows: int = 2000) -> DataFrame:
    """The mix of rows as ``sizes`` gives them.

    Running sums are taken in two steps, so that no source and no range of times lands in one task: within (source, slice of
    the hash), as many slices as the source's rows need, and over the slices' totals.
    """
    sized = stable(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    table = stable(targets(totals, repeats))
    sources, budget = table.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    queued = _with_source(sized, table, sources)
    share = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 4294967296.0
    queued = queued.withColumn("slice", F.floor(share * (1 + F.floor(F.col("n") / slice_rows))).cast("long"))
    offsets = queued.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(F.col("source").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = queued.withColumn("cum", F.sum("size").over(within))
    queued = stable(queued.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))).drop("s", "k", "n", "slice"))
    sent = (F.col("size") > 0) & (F.col("target") > 0)
    at = lambda turn: finish(F.col("offset"), F.col("cum"), turn, F.col("source_size"), F.col("target"))
    copies = queued.filter(sent).withColumn("turn", F.explode(F.array(*[F.lit(float(k)) for k in range(repeats)])))
    cut = _cut(copies.withColumn("v", at(F.col("turn"))), budget, few, bins)
    taken = F.lit(0).cast("long")
    for k in range(repeats):
        taken = taken + F.when(sent & _goes(at(F.lit(float(k))), float(k), cut), F.col("size")).otherwise(0)
    return queued.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "row")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def mix_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the mix takes, with all their columns, and ``copies`` (how often each is taken; under
    another name, with an underscore after it, where the table has that column).

    Null and empty texts have no words, so they are not taken; rows are told apart by their place, so repeated rows and null
    or repeated ids are each taken on their own; an empty table gives an empty table.
    """
    blocks = text_blocks(docs, whole=True)
    source = docs.columns.index("source") - sum(docs.columns.index(c) < docs.columns.index("source") for c in ("doc_id", "text"))
    name = fresh(docs, "copies")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in blocks_of(batch):
                own = [x if x is None else str(x) for x in block.extra[f"x{source}"].to_pylist()]
                yield block.frame(source=own, size=[len(t.split()) for t in block.texts()], row=block.rows, digest=[hashlib.md5(t).hexdigest() for t in block.texts()])

    def take(block: Block, taken: pd.DataFrame) -> pa.Table:
        copies = np.zeros(len(block.rows), dtype=np.int32)
        copies[taken["row"].to_numpy() - block.rows[0]] = taken["copies"]
        out = block.table(block.texts()).append_column(name, pa.array(copies))
        return out.filter(pa.array(copies > 0))

    mixed = mix_sizes(_ordered(blocks.mapInPandas(words, "doc_id long, source string, size long, row long, digest string"))).filter("taken > 0")
    mixed = mixed.select(block_of(F.col("row")).alias("block"), "row", (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    return unpacked(docs, blocks, mixed, take, T.StructField(name, T.IntegerType()))


ORACLE_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
t AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight,
             CAST(3 * source_size AS DOUBLE) AS most FROM t),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM t) AS DOUBLE) - coalesce(sum(most) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER r AS rn
      FROM w WINDOW r AS (ORDER BY most / weight, source IS NULL, source)),
g AS (SELECT level AS water FROM l WHERE level * weight <= most ORDER BY rn LIMIT 1),
m AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(water * weight, most) AS target FROM l, g),
q AS (SELECT d.*, m.source_size, m.target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
c AS (SELECT q.*, k.turn, (k.turn * CAST(source_size AS DOUBLE) + CAST(cum AS DOUBLE)) / target AS v
      FROM q, (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE)), (CAST(2 AS DOUBLE))) k(turn) WHERE size > 0 AND target > 0),
s AS (SELECT *, sum(size) OVER (ORDER BY v, o, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS running FROM c),
x AS (SELECT doc_id, o, size, CAST(sum(size) AS BIGINT) AS taken FROM s WHERE running <= (SELECT sum(size) FROM d) GROUP BY doc_id, o, size)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0) AS taken
FROM q LEFT JOIN x ON q.doc_id IS NOT DISTINCT FROM x.doc_id AND q.o = x.o AND q.size = x.size
"""
