"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed is a fixed mask over a run of tokens; it hashes the tokens at its places and ignores the others. Seeds of test
items and of documents that share a hash fix a diagonal (document position minus item position). Along the diagonal the
two are compared token by token, and the document is a leak if a long enough part of the item stands there with few
enough substitutions.

Tokens: lower-cased words without their characters that are neither letters nor digits.

Defined results: null and empty texts, and texts or items shorter than the shortest mask, take no part; an item that
stands in a document more than once, and documents or items that share an id, give one row for each (document id, item id),
for the best diagonal among them, each text being held against each item on its own; a null id is an id. Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import fresh, read, stable

#: Places of the tokens that each seed looks at; the others are ignored. Six tokens each, in spans of seven to nine.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 6, 7), (0, 2, 3, 4, 6, 7), (0, 1, 4, 5, 7, 8))


@dataclass(frozen=True)
class Overlap:
    """window: tokens of the item that are held against the document at once (the whole item if it is shorter); similarity:
    least share of them that must agree; least: tokens that must agree at least; small_seeds: seeds of the test set, of some
    40 bytes each, up to which their table is broadcast (beyond, both sides are shuffled by hash); small_bytes: text of the
    test set up to which it is broadcast."""

    window: int = 20
    similarity: float = 0.8
    least: int = 8
    small_seeds: int = 400_000
    small_bytes: int = 16 << 20


def tokens(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def _seeds(df: DataFrame, words: str, keep: list[str | Column], masks=MASKS) -> DataFrame:
    """One row for each place and mask that fits: the columns kept, pos, mask and seed (a 64-bit hash).

    The hash of a place is a plain expression on the exploded place, so it stays within generated code.
    """
    n = F.size(words)
    shortest = min(m[-1] for m in masks) + 1
    at = df.select(*keep, words, F.explode(F.when(n >= shortest, F.sequence(F.lit(0), n - shortest))).alias("pos"))
    keep = at.columns[:-2]
    look = F.array(*[F.array(F.lit(j), *map(F.lit, m)) for j, m in enumerate(masks)])
    at = at.select(*keep, words, "pos", F.explode(look).alias("look")).filter(F.col("pos") + F.get("look", F.lit(len(masks[0]))) < n)
    word = lambda k: F.get(F.col(words), F.col("pos") + F.get("look", F.lit(k + 1)))
    mask = F.get("look", F.lit(0))
    return at.select(*keep, words, "pos", mask.alias("mask"), F.xxhash64(mask, *[word(k) for k in range(len(masks[0]))]).alias("seed"))


def _compared(hits: DataFrame, cfg: Overlap) -> DataFrame:
    """Rows (doc_id, k, item_id, diagonal, part, item, n_item) to matches: part is the document along the item's diagonal.

    Exploding arrays of one element keeps what they hold from being computed anew at each use.
    """
    keep = ("doc_id", "k", "item_id", "diagonal", "n_item")
    same = F.zip_with("part", "item", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    add = lambda a, b: a + b
    w = F.least(F.lit(cfg.window), F.col("n_item"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("n_item") - w), lambda i: F.aggregate(F.slice("same", i + 1, w), F.lit(0), add)))
    out = hits.select(*keep, F.explode(F.array(same)).alias("same"))
    out = out.select(*keep, "same", F.explode(F.array(best)).alias("best"))
    agree = F.aggregate("same", F.lit(0), add)
    return out.filter((F.col("best") >= cfg.least) & (F.col("best") >= cfg.similarity * w)).select("doc_id", "k", "item_id", "diagonal", agree.alias("n_matched"), F.col("n_item").cast("int").alias("n_item"))


def _along(n_item: Column) -> Column:
    """The document's tokens at the item's places, null where the document has ended or not begun."""
    before = F.greatest(F.lit(0), -F.col("diagonal"))
    inside = F.slice("words", F.greatest(F.lit(0), F.col("diagonal")) + 1, n_item - before)
    return F.when(F.col("diagonal") < 0, F.concat(F.array_repeat(F.lit(None).cast("string"), before), inside)).otherwise(inside)


def matches(docs: DataFrame, items: DataFrame, cfg: Overlap = Overlap(), masks=MASKS) -> DataFrame:
    """doc_id, k (md5 of the text), item_id, diagonal, n_matched and n_item of every diagonal on which a text and an item overlap.

    Seeds meet without the items' texts, each diagonal is taken once, and only then come the texts to it.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("k"), tokens(text).alias("words"))
    items = stable(items.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).filter(F.size("item") > 0)).withColumn("it", F.monotonically_increasing_id())
    test = _seeds(items, "item", ["it", F.size("item").alias("n_item")], masks).select("mask", "seed", "it", F.col("pos").alias("at"), "n_item")
    diagonal = (F.col("pos") - F.col("at")).alias("diagonal")
    if test.limit(cfg.small_seeds + 1).count() <= cfg.small_seeds:  # rows of a fixed width, so their number bounds the broadcast
        hits = _seeds(docs, "words", ["doc_id", "k"], masks).join(F.broadcast(test), ["mask", "seed"])
        hits = hits.select("doc_id", "k", "it", "n_item", diagonal, "words").select("doc_id", "k", "it", "diagonal", _along(F.col("n_item")).alias("part"))
        hits = hits.groupBy("doc_id", "k", "it", "diagonal").agg(F.first("part").alias("part"))
    else:  # both sides meet by hash, and the documents then come to the diagonals that are left
        places = _seeds(docs, "words", ["doc_id", "k"], masks).select("mask", "seed", "doc_id", "k", "pos").join(test, ["mask", "seed"])
        places = places.select("doc_id", "k", "it", "n_item", diagonal).distinct()
        own = docs.select("k", "words").groupBy("k").agg(F.first("words").alias("words"))
        hits = places.join(own, "k").select("doc_id", "k", "it", "diagonal", _along(F.col("n_item")).alias("part"))
    size = items.agg(F.sum(F.aggregate("item", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16))).first()[0] or 0
    texts = items.select("it", "item_id", "item", F.size("item").alias("n_item"))
    return _compared(hits.join(F.broadcast(texts) if size <= cfg.small_bytes else texts, "it"), cfg)


def overlaps(docs: DataFrame, items: DataFrame, cfg: Overlap = Overlap(), masks=MASKS) -> DataFrame:
    """One row for each document and test item that overlap: doc_id, item_id, n_matched, n_item, diagonal."""
    best = F.max_by(F.struct("diagonal", "n_matched", "n_item"), F.struct("n_matched", -F.col("diagonal")))
    found = matches(docs, items, cfg, masks).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", "best.n_matched", "best.n_item", "best.diagonal")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str, few: int = 500_000) -> DataFrame:
    """Pipeline stage: the rows whose text holds no part of a test item; all columns, whatever their names, stay as they are.

    The decision hangs on the text alone, so null, repeated and shared ids make no difference; null and empty texts stay, as
    does everything where there are no items; an empty table gives an empty table. The texts that go are broadcast, as
    digests, if they are few.
    """
    leaks = stable(matches(docs, read(spark, sf_dir, "benchmark")).select(F.col("k").alias(fresh(docs, "leak"))).distinct())
    gone = leaks.columns[0]
    return docs.join(F.broadcast(leaks) if leaks.count() <= few else leaks, F.md5(F.col("text").cast("string").cast("binary")) == F.col(gone), "left_anti")


def _mask_sql(table: str, key: str) -> str:
    parts = []
    for j, m in enumerate(MASKS):
        words = " || ' ' || ".join(f"w[p + {k + 1}]" for k in m)
        parts.append(f"SELECT {key}, w, p, {j} AS mask, {words} AS seed FROM (SELECT *, unnest(range(0, len(w) - {m[-1]})) AS p FROM {table} WHERE len(w) > {m[-1]})")
    return " UNION ALL ".join(parts)


ORACLE_OP2 = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\s]+', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\s]+', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM benchmark),
ds AS ({_mask_sql("d", "doc_id")}),
bs AS ({_mask_sql("b", "item_id")}),
h AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS diagonal FROM ds JOIN bs USING (mask, seed)),
c AS (SELECT h.*, len(b.w) AS n_item, least({Overlap.window}, len(b.w)) AS win,
             list_transform(range(0, len(b.w)), lambda i: CASE WHEN i + diagonal >= 0 AND i + diagonal < len(d.w) AND d.w[i + diagonal + 1] = b.w[i + 1] THEN 1 ELSE 0 END) AS same
      FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
e AS (SELECT *, list_sum(same) AS n_matched, list_max(list_transform(range(0, n_item - win + 1), lambda i: list_sum(same[i + 1 : i + win]))) AS best FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, diagonal) AS rn FROM e
      WHERE best >= {Overlap.least} AND best >= {Overlap.similarity} * win)
SELECT doc_id, item_id, CAST(n_matched AS INTEGER) AS n_matched, CAST(n_item AS INTEGER) AS n_item, CAST(diagonal AS INTEGER) AS diagonal FROM f WHERE rn = 1
"""
