"""Near-duplicate detection by DartMinHash.

A document is a weighted set: its distinct shingles of five lower-cased words (the whole text if it has fewer), each
weighted by how often it stands in the text. Similarity is the weighted Jaccard similarity: sum of the lesser weights over
sum of the greater ones.
Darts fall on the strip (element, weight, rank) as a Poisson process that is a function of the element alone; a document
keeps those under its own weights, takes as many ranks as give it about k ln k + 2k darts, hashes each to one of k
coordinates, and keeps the least rank in each. Only darts below the rank limit are ever made, so the work is about one
hash for each element plus the darts.

Signatures are cut into bands. Documents that share a band are candidates; every link is confirmed by the weighted Jaccard
similarity itself. Classes are the connected components of the links of ``similarity`` or more among
candidates. Exact copies are merged first. Within a band's bucket not all pairs are made: every member meets the bucket's
head, the document whose bands fall into the fullest buckets (the original, where there is one), and what links to it is
one class. Pairs of the others that are in different classes then meet only if they can be similar at all: of a document's
shingles only those that also stand in another class can be shared with it, which bounds the size that a partner may have.
Partners are looked up by bucket and size, so documents that merely resemble the same original don't meet each other. The
bound is exact: no link among candidates is lost.

Defined results: null or empty texts, and texts of white space, have no shingle and are never duplicates: each is a class
of its own. Repeated rows and copies share a class; a class is named by its least doc_id, and by null if no member has
one; rows that share an id are judged each by its own text. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import Block, block_of, blocks_of, mix64, read, stable, text_blocks, unpacked, word_hashes

#: Keeps a similarity of just the limit from falling short by rounding.
ROUNDING = 1e-6


@dataclass(frozen=True)
class Darts:
    """bands * rows coordinates: at a similarity of 0.8 a pair is missed with probability (1 - 0.8**rows)**bands, about 0.0002."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4


def shingles(text: bytes, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of a text's shingles, and how often each stands in it."""
    h, _, _ = word_hashes(np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-8"), dtype=np.uint8))
    if not len(h):
        return h, np.zeros(0, dtype=np.int64)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(h))):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return np.unique(mix64(out + np.uint64(min(words, len(h)))), return_counts=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The least dart of each of k coordinates, as 64-bit hashes; elements are distinct, weights positive.

    An element's strip of weight w is cut into unit strips, the last of which is partly covered; in each unit strip darts
    arrive in rank order with exponential gaps. The rank limit grows only in the rare case that a coordinate stays empty.
    """
    strips = np.maximum(1, np.ceil(weights)).astype(np.int64)
    part = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
    own = np.repeat(weights, strips) - part
    with np.errstate(over="ignore"):
        strip = mix64(np.repeat(elements, strips) + part.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    limit = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        rank = np.full(k, np.inf)
        best = np.zeros(k, dtype=np.uint64)
        state, at, under = strip, np.zeros(len(strip)), own
        while len(state):
            with np.errstate(over="ignore"):
                state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
                where = mix64(state ^ np.uint64(0xC2B2AE3D27D4EB4F))
            at = at - np.log(_unit(state))
            alive = at < limit
            state, at, under, where = state[alive], at[alive], under[alive], where[alive]
            hit = (where >> np.uint64(32)).astype(np.float64) / float(1 << 32) < under
            cell = (where[hit] % np.uint64(k)).astype(np.int64)
            order = np.argsort(-at[hit], kind="stable")  # the least rank is written last
            better = order[at[hit][order] < rank[cell[order]]]
            rank[cell[better]] = at[hit][better]
            best[cell[better]] = state[hit][better]
        if np.isfinite(rank).all():
            return best
        limit *= 2


def _repeated(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of an element's first, second, ... occurrence: as sets of these, weighted sets have their weighted similarity."""
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return mix64(np.repeat(elements, counts) + nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def signatures(blocks: DataFrame, cfg: Darts = Darts()) -> DataFrame:
    """row, doc_id, content (a 128-bit key of the weighted set, null without a shingle) and the hashes of the bands."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in blocks_of(batch):
                content, bands = [], []
                for text in block.texts():
                    s, counts = shingles(text, cfg.words)
                    if not len(s):
                        content.append(None)
                        bands.append(None)
                        continue
                    sig = dart_signature(s, counts.astype(np.float64), cfg.bands * cfg.rows).reshape(cfg.bands, cfg.rows)
                    key = np.arange(cfg.bands, dtype=np.uint64)
                    every = s if counts.max() == 1 else _repeated(s, counts)
                    with np.errstate(over="ignore"):
                        for j in range(cfg.rows):
                            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, j])
                        content.append(f"{int(every.sum(dtype=np.uint64)):016x}{int(mix64(every).sum(dtype=np.uint64)):016x}")
                    bands.append(key.view(np.int64).tolist())
                yield block.frame(row=block.rows, content=content, bands=bands)

    return blocks.mapInPandas(sign, "doc_id long, row long, content string, bands array<long>")


def shingle_sets(blocks: DataFrame, rows: DataFrame, cfg: Darts = Darts()) -> DataFrame:
    """id and items of the rows asked for (column id): hashes of the shingles' occurrences, cut to 32 bits, which tell apart
    those of two documents."""

    def sets(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids, items = [], []
        for block in blocks_of(own):
            for row in sorted(asked["id"].tolist()):
                at = row - int(block.rows[0])
                every = _repeated(*shingles(block.bytes[block.starts[at] : block.ends[at] - 1], cfg.words))
                ids.append(row)
                items.append(np.unique((every >> np.uint64(32)).astype(np.uint32)).view(np.int32))
        return pd.DataFrame({"id": np.array(ids, dtype=np.int64), "items": pd.Series(items, dtype=object)})

    return blocks.groupBy("block").cogroup(rows.select(block_of(F.col("id")).alias("block"), "id").groupBy("block")).applyInPandas(sets, "id long, items array<int>")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in the edges (a, b), root being the least id of its component.

    Each round every id takes the least label among itself and its neighbours, and then its label's label, so a long chain
    needs a logarithmic number of rounds. All steps are joins and grouped minima.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = step.join(labels.select(F.col("id").alias("mid"), F.col("root").alias("far")), "mid")
        new = stable(jump.select("id", "old", F.least("mid", "far").alias("root")))
        changed = new.filter(F.col("root") != F.col("old")).limit(1).count()
        labels = new.select("id", "root")
        if not changed:
            return labels


def _links(pairs: DataFrame, sets: DataFrame, cfg: Darts) -> DataFrame:
    """Those of the pairs (a, b) whose exact similarity reaches the limit."""
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return met.filter(F.col("common") + ROUNDING >= cfg.similarity * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def _could_be_similar(open_: DataFrame, sets: DataFrame, bands: DataFrame, cfg: Darts, groups: int = 16, full: int = 512) -> DataFrame:
    """Pairs (a, b) of members (band, bucket, id, root) of one bucket and different classes that the bound allows.

    Only shingles that also stand in another class can be shared. With u of them in x, similarity s to y needs overlap >=
    s / (1 + s) * (|x| + |y|) and overlap <= u, so |y| <= (1 + s) / s * u - |x|, and |y| >= s * |x|: sizes are compared in
    bins of five percent, then exactly. What passes is held against a finer bound, the sum of the lesser counts over groups
    of shingles, and a pair is made only in the first band that it shares.
    """
    s, step = cfg.similarity, math.log(1.05)
    known = open_.select("id", "root").distinct().join(sets, "id")
    items = known.select("id", "root", F.explode("items").alias("item"))
    shared = items.groupBy("item").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("item")
    each = [F.count_if(F.pmod("item", F.lit(groups)) == g) for g in range(groups)]
    u = items.join(shared, "item").groupBy("id").agg(F.count("*").alias("u"), F.array(*each).alias("g"))
    sized = known.select("id", F.size("items").alias("n")).join(u, "id").withColumn("most", (1 + s) / s * F.col("u") - F.col("n") + ROUNDING).filter(F.col("most") >= s * F.col("n"))
    at = stable(open_.join(sized.join(bands, "id").select("id", "n", "most", "g", "bands"), "id"))
    bin_of = lambda x: F.floor(F.log(x) / step).cast("int")
    side = lambda k, bin_: at.select("band", "bucket", bin_.alias("bin"), *[F.col(c).alias(k + c) for c in ("id", "root", "n", "most", "g", "bands")])
    x, y = side("x_", F.explode(F.sequence(bin_of(s * F.col("n")), bin_of(F.col("most"))))), side("y_", bin_of(F.col("n")))
    place = ["band", "bucket", "bin"]
    # a full bin's members on one side are dealt out by a salt, and each of the other side's meets every part
    parts = y.groupBy(*place).agg(F.count("*").alias("m")).filter(F.col("m") > full).select(*place, F.ceil(F.col("m") / full).cast("int").alias("parts"))
    parts = stable(parts)
    parts = F.broadcast(parts) if parts.count() <= 100_000 else parts
    dealt = F.coalesce("parts", F.lit(1))
    x = x.join(parts, place, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), dealt - 1))).drop("parts")
    y = y.join(parts, place, "left").withColumn("salt", F.pmod(F.xxhash64("y_id"), dealt).cast("int")).drop("parts")
    c = F.col
    possible = F.aggregate(F.zip_with("x_g", "y_g", lambda p, q: F.least(p, q)), F.lit(0).cast("long"), lambda p, q: p + q)
    fits = (
        (c("x_root") != c("y_root")) & (c("x_id") < c("y_id")) & (c("y_n") <= c("x_most")) & (c("x_n") <= c("y_most")) & ((1 + s) * possible + ROUNDING >= s * (c("x_n") + c("y_n")))
        & (F.array_position(F.zip_with("x_bands", "y_bands", lambda p, q: p == q), True) == x["band"] + 1)
    )
    same = (x["band"] == y["band"]) & (x["bucket"] == y["bucket"]) & (x["bin"] == y["bin"]) & (x["salt"] == y["salt"])
    return x.join(y, same & fits).select(c("x_id").alias("a"), c("y_id").alias("b"))


def classes_of_rows(blocks: DataFrame, cfg: Darts = Darts()) -> DataFrame:
    """row, doc_id, class_id (the least id of the row's class) and first (the row that stands for it: the least by id, then by place)."""
    signed = stable(signatures(blocks, cfg))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    reps = signed.filter("content is not null").groupBy("content").agg(F.min(place).alias("least"), F.first("bands").alias("bands"))
    reps = stable(reps.select("content", "least", F.col("least.row").alias("id"), "bands"))
    member = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    full = member.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    member = stable(member.join(full, ["band", "bucket"]))  # only buckets of two or more
    central = member.groupBy("id").agg(F.sum("n").alias("central"))
    heads = member.join(central, "id").groupBy("band", "bucket").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("head"))
    met = stable(member.join(heads, ["band", "bucket"]).filter("id <> head").select("band", "bucket", "id", "head"))
    pairs = met.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    sets = stable(shingle_sets(blocks, member.select("id").distinct(), cfg))
    linked = stable(_links(pairs, sets, cfg))
    roots = components(linked)
    rest = met.select("band", "bucket", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))  # heads have met everyone in their bucket
    mixed = rest.groupBy("band", "bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("band", "bucket")
    more = stable(_links(_could_be_similar(stable(rest.join(mixed, ["band", "bucket"])), sets, reps.select("id", "bands"), cfg), sets, cfg))
    of = reps.select("content", "least", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if more.limit(1).count():  # they join whole classes: only their roots are put together
        side = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(c + "_root"))
        between = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(*[F.coalesce(c + "_root", c).alias(c) for c in ("a", "b")])
        of = of.join(components(stable(between.distinct())).select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root"))
    least = of.groupBy("root").agg(F.min("least").alias("head"))
    of = of.join(least, "root").select("content", "head")
    out = signed.select("row", "doc_id", "content").join(of, "content", "left")
    return out.select("row", "doc_id", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce("head.row", "row").alias("first"))


def classes(docs: DataFrame, cfg: Darts = Darts()) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of each row."""
    return classes_of_rows(text_blocks(docs), cfg).select("doc_id", "class_id")


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the least id stays (null ids last, then by place); all its columns stay as they are.

    Rows are told apart by their place, so of repeated rows one stays, and different texts that share an id, or have none,
    are judged each on its own; null and empty texts all stay; an empty table gives an empty table.
    """
    blocks = text_blocks(docs, whole=True)
    gone = classes_of_rows(blocks).filter(F.col("first") != F.col("row")).select(block_of(F.col("row")).alias("block"), "row")

    def keep(block: Block, rows: pd.DataFrame) -> pa.Table:
        stays = np.ones(len(block.rows), dtype=bool)
        stays[rows["row"].to_numpy() - block.rows[0]] = False
        return block.table(block.texts()).filter(pa.array(stays))

    return unpacked(docs, blocks, gone, keep)
